"""Queries over the tree learners. A stump and the statistics of categories have SQL; whole ensembles are held against brute force in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import intervals, learning, metrics
from tidemark.plans.queries import D, _read, query, rounded
from tidemark.trees.leafwise import LeafwiseBoosting
from tidemark.trees.newton import NewtonBoosting
from tidemark.trees.ordered import target_statistics

# A label of order lines, and columns of few values for which every value is a border.
_LINES = "d as (select l_orderkey, l_linenumber, cast(l_returnflag = 'R' as integer) as y, l_quantity as q, l_discount as c, cast(l_linenumber as double) as n from lineitem)"


def _lines(spark, d):
    line = _read(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("double").alias("label"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("c"), F.col("l_linenumber").cast("double").alias("n"))


def _stump_sql(rate: float, l2: float) -> str:
    """The best of all borders of three columns by slope and curvature at the mean, and the scores of its two sides."""
    sides = " union all ".join(f"select '{f}' as f, {f} as v, count(*) as n, sum(y) as s from d group by {f}" for f in "qcn")
    return f"""with {_LINES}, m as (select avg(y) as p, count(*) as n, sum(y) as s from d), k as ({sides}),
l as (select f, v, sum(n) over w as nl, sum(s) over w as sl, max(v) over (partition by f) as high from k window w as (partition by f order by v)),
g as (select f, v, (sl - nl * p) as gl, nl * p * (1 - p) as hl, (m.s - sl - (m.n - nl) * p) as gr, (m.n - nl) * p * (1 - p) as hr, p from l, m where v < high),
b as (select *, gl * gl / (hl + {l2}) + gr * gr / (hr + {l2}) as gain from g order by gain desc, case f when 'q' then 0 when 'c' then 1 else 2 end, v limit 1)
select l_orderkey, l_linenumber, round(ln(p / (1 - p)) + {rate} * case when (case f when 'q' then q when 'c' then c else n end) > v then gr / (hr + {l2}) else gl / (hl + {l2}) end, 6) as score from d, b"""


@query(_stump_sql(0.5, 1.0))
def newton_stump(spark, d):
    """One second-order tree of one level: borders from the weighted sketch, sums from one pass."""
    rows = _lines(spark, d)
    out = NewtonBoosting(["q", "c", "n"], trees=1, depth=1, rate=0.5, bins=500).fit(rows).transform(rows)
    return out.select("l_orderkey", "l_linenumber", F.round("rawPrediction", 6).alias("score"))


@query(_stump_sql(0.25, 2.0))
def leafwise_stump(spark, d):
    """One tree of two leaves, from bundled columns and a histogram by subtraction."""
    rows = _lines(spark, d)
    out = LeafwiseBoosting(["q", "c", "n"], trees=1, leaves=2, rate=0.25, l2=2.0, bins=1000).fit(rows).transform(rows)
    return out.select("l_orderkey", "l_linenumber", F.round("rawPrediction", 6).alias("score"))


@query(f"""with e as (select event_id, user_id, event_type, cast(value > 50 as integer) as y from events)
select event_id, round((coalesce(sum(y) over u, 0) + 0.3 * 2) / (count(*) over u + 2), {D}) as by_user, round((coalesce(sum(y) over t, 0) + 0.3 * 2) / (count(*) over t + 2), {D}) as by_type from e
window u as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), t as (partition by event_type order by event_id rows between unbounded preceding and 1 preceding)""")
def category_statistics(spark, d):
    """Of each category the mean label of strictly earlier rows; the four types hold all rows, and are in no single task."""
    e = _read(spark, d, "events").select("event_id", "user_id", "event_type", (F.col("value") > 50).cast("int").alias("y"))
    out = target_statistics(e, ["user_id", "event_type"], "y", "event_id", 0.3, 2.0)
    # means of whole labels often end in a 5 after D digits; their doubles may lie just below: scaled first they are whole and a half again, as in SQL
    ties = lambda c: F.round(F.col(c) * 10.0**D) / 10.0**D
    return out.select("event_id", ties("__ts0").alias("by_user"), ties("__ts1").alias("by_type"))


_FEW = {"ordered_boosting": {"key": ["event_id"], "depth": 3}, "leafwise_boosting": {"leaves": 6, "key": ["event_id"], "top": 0.3, "other": 0.3}, "newton_boosting": {"depth": 3}, "extra_trees": {"depth": 4}}


def _by_fold(kind: str):
    def run(spark, d):
        e = _read(spark, d, "events").select("event_id", "ts", "event_type", F.col("value").alias("amount"), F.hour("ts").cast("double").alias("hour"), (F.col("user_id") % 5).cast("string").alias("part"), (F.col("event_type") == "purchase").cast("double").alias("label"))
        folds = intervals.by_rows(e, 2, ("ts", "event_id"), 20)
        out = learning.out_of_fold(e, learning.build_pipeline(kind, ["amount", "hour"], ["part"], trees=3, **_FEW[kind]), folds)
        return rounded(metrics.average_precision(out.filter("__fold__ >= 0"), "label", "pred_0", by=("__fold__",)))

    run.__name__ = f"{kind}_by_fold"
    run.__doc__ = f"Average precision by fold of ``{kind}``, trained before each fold's gap."
    return query(None)(run)


for _kind in _FEW:
    _by_fold(_kind)
