"""Blending and comparing out-of-fold predictions.

A prediction table has ``__row__``, ``__fold__`` (-1: never validated, so its
predictions are NULL) and ``pred_0`` and so on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ranges import running

ROW, FOLD = "__row__", "__fold__"


def _predictions(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c.startswith("pred_")), key=lambda c: int(c[5:]))


def check_covered(df: DataFrame) -> None:
    """Raises unless all predictions of a row are there exactly where its fold is."""
    missing = [F.col(c).isNull() | F.isnan(c) for c in _predictions(df)]
    some, every = missing[0], missing[0]
    for m in missing[1:]:
        some, every = some | m, every & m
    bad = df.agg(F.count_if(some != every).alias("partial"), F.count_if(every != (F.col(FOLD) < 0)).alias("coverage")).first()
    if bad["partial"] or bad["coverage"]:
        raise ValueError(f"{bad['partial']} rows have some predictions only; {bad['coverage']} don't fit their fold")


def check_compatible(a: DataFrame, b: DataFrame, keys: Sequence[str] = (ROW, FOLD)) -> None:
    """Raises unless both tables have the same rows and folds, each once."""
    x, y = (d.groupBy(*keys).count() for d in (a, b))
    if x.exceptAll(y).limit(1).count() or y.exceptAll(x).limit(1).count() or x.filter("count > 1").limit(1).count():
        raise ValueError("the tables don't have the same rows")


def blend(tables: Sequence[DataFrame], weights: Sequence[float], check: bool = True) -> DataFrame:
    """The weighted sum of aligned predictions; NULL where they are NULL."""
    if len(tables) != len(weights) or len(tables) < 2 or any(not math.isfinite(w) or w < 0 for w in weights) or abs(sum(weights) - 1) > 1e-8:
        raise ValueError("weights must be finite, not negative and add up to 1, one for each of two or more tables")
    names = _predictions(tables[0])
    if check:
        _check_aligned(tables, names)
    out = tables[0].select("*", *[(F.col(c) * weights[0]).alias(f"_b_{c}") for c in names]).drop(*names)
    for i, (t, w) in enumerate(zip(tables[1:], weights[1:], strict=True), 1):
        own = t.select(ROW, *[(F.col(c) * w).alias(f"_t{i}_{c}") for c in names])
        out = out.join(own, ROW)
        out = out.withColumns({f"_b_{c}": F.col(f"_b_{c}") + F.col(f"_t{i}_{c}") for c in names}).drop(*[f"_t{i}_{c}" for c in names])
    return out.withColumnsRenamed({f"_b_{c}": c for c in names})


def _check_aligned(tables: Sequence[DataFrame], names: Sequence[str]) -> None:
    """Raises unless all tables have the same rows and folds, each once, and predictions where their fold is.

    One aggregation by row over the union of all tables: each row must come once
    from each table, with one fold, and whole.
    """
    parts = []
    for i, t in enumerate(tables):
        if _predictions(t) != list(names):
            raise ValueError("the tables don't have the same predictions")
        gaps = sum(((F.col(c).isNull() | F.isnan(c)).cast("int") for c in names), F.lit(0))
        parts.append(t.select(F.col(ROW).alias("_r"), F.lit(1 << i).cast("long").alias("_t"), F.col(FOLD).alias("_f"), gaps.alias("_g")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    k = len(tables)
    seen = rows.groupBy("_r").agg(
        F.count(F.lit(1)).alias("n"), F.bit_or("_t").alias("t"), F.min("_f").alias("lo"), F.max("_f").alias("hi"),
        F.count("_f").alias("f"), F.max((F.col("_g").between(1, len(names) - 1)).cast("int")).alias("partial"), F.max(((F.col("_g") == len(names)) != (F.col("_f") < 0)).cast("int")).alias("coverage"),
    )
    apart = (F.col("n") != k) | (F.col("t") != (1 << k) - 1) | (F.col("lo") != F.col("hi")) | (F.col("f") != k)
    bad = seen.agg(F.count_if(apart).alias("apart"), F.count_if(F.col("partial") == 1).alias("partial"), F.count_if(F.col("coverage") == 1).alias("coverage")).first()
    if bad["apart"]:
        raise ValueError(f"the tables don't have the same rows: {bad['apart']} differ")
    if bad["partial"] or bad["coverage"]:
        raise ValueError(f"{bad['partial']} rows have some predictions only; {bad['coverage']} don't fit their fold")


def blend_files(parts: Sequence[tuple[str, float]], path: str, spark: SparkSession, identity: dict | None = None) -> DataFrame:
    """Blends saved prediction tables (path and weight of each), saves the blend and returns it as saved.

    Its identity names the parts with their weights and content hashes, so a locked
    blend can be told from one of other inputs.
    """
    from tidemark.sources.tables import read_predictions, save_predictions

    tables, named = [], []
    for where, weight in parts:
        own, meta = read_predictions(spark, where)
        tables.append(own)
        named.append({"path": where, "weight": weight, "content": meta["content"]})
    ids = [c for c in tables[0].columns if c not in (ROW, FOLD) and not c.startswith("pred_")]
    save_predictions(blend(tables, [w for _, w in parts]), path, ids, {**(identity or {}), "parts": named})
    return read_predictions(spark, path)[0]


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """``name``: rank of ``column`` among all rows, ties sharing their mean; NULL stays NULL.

    Ranks come from counts of distinct values, summed over ranges of values, so
    no task orders the whole table.
    """
    steps = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running(steps, (), "_v", ["_n"]).select("_v", (F.col("c__n") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def rank_average(df: DataFrame, columns: Sequence[str], name: str = "rank_average") -> DataFrame:
    """Mean of the columns' average ranks, divided by the rows: a blend that ignores scale."""
    total = df.agg(F.count(F.lit(1))).first()[0] or 1
    return _ranked_mean(df, columns, name, total)


def rank_average_classes(tables: Sequence[DataFrame]) -> DataFrame:
    """Rank averages of each class's probability over aligned tables, scaled to add up to 1 in a row."""
    names = _predictions(tables[0])
    _check_aligned(tables, names)
    out = tables[0].drop(*names)
    for i, t in enumerate(tables):
        out = out.join(t.select(ROW, *[F.col(c).alias(f"_{i}_{c}") for c in names]), ROW)
    total = tables[0].agg(F.count(names[0])).first()[0] or 1
    for c in names:
        out = _ranked_mean(out, [f"_{i}_{c}" for i in range(len(tables))], c, total)
    whole = sum((F.col(c) for c in names), F.lit(0.0))
    return out.withColumns({c: F.col(c) / whole for c in names} if len(names) > 1 else {}).drop(*[f"_{i}_{c}" for i in range(len(tables)) for c in names])


def _ranked_mean(df: DataFrame, columns: Sequence[str], name: str, total: int) -> DataFrame:
    out = df
    for i, c in enumerate(columns):
        out = average_ranks(out, c, f"_r{i}")
    mean = sum((F.col(f"_r{i}") for i in range(len(columns))), F.lit(0.0)) / len(columns)
    return out.withColumn(name, mean / total).drop(*[f"_r{i}" for i in range(len(columns))])


def top_k(df: DataFrame, score: str, k: int, ties: str = ROW) -> DataFrame:
    """The ``k`` rows with the highest score, the lower row number first on ties."""
    return df.orderBy(F.desc(score), ties).limit(k)


def diversity(df: DataFrame, a: str, b: str, ks: Sequence[int] = (1000, 5000), row: str = ROW) -> DataFrame:
    """``pearson, spearman`` and ``top_k_overlap`` (share of common rows) of two predictions."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_ranks(average_ranks(rows, a, "_ra"), b, "_rb")
    out = ranked.agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"))
    for k in ks:
        x, y = (top_k(rows.select(row, c), c, k, row).select(row) for c in (a, b))
        out = out.crossJoin(x.join(y, row, "left_semi").agg((F.count(F.lit(1)) / k).alias(f"top_{k}_overlap")))  # one row each
    return out


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, spearman`` of every pair of columns."""
    out = df.select(*columns).dropna()
    for c in columns:
        out = average_ranks(out, c, f"_r_{c}")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    found = out.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(f"_r_{a}", f"_r_{b}").alias("spearman")) for a, b in pairs]).alias("p"))
    return found.select(F.explode("p").alias("p")).select("p.*")


def compare_numbers(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], rtol: float = 1e-7, atol: float = 1e-9) -> DataFrame:
    """``column, n, missing, different, max_abs_difference``: |a - b| against atol + rtol |b|, rows matched by key."""
    x = a.select(key, F.lit(True).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    y = b.select(key, F.lit(True).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = x.join(y, key, "full_outer")
    absent = F.count_if(F.col("_a").isNull() | F.col("_b").isNull())

    def one(c: str) -> Column:
        p, q = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        ok = p.eqNullSafe(q) | (F.abs(p - q) <= atol + rtol * F.abs(q))
        present = F.col("_a").isNotNull() & F.col("_b").isNotNull()
        return F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), absent.alias("missing"), F.count_if(present & ~F.coalesce(ok, F.lit(False))).alias("different"), F.max(F.abs(p - q)).alias("max_abs_difference"))

    return both.agg(F.array(*[one(c) for c in columns]).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def weighted_score(first: float, second: float, weights: tuple[float, float] = (0.3, 0.7)) -> float:
    return weights[0] * first + weights[1] * second


def verdict(deltas: Sequence[float], flat: float = 0.0005) -> str:
    """WIN if no window loses and one wins by more than ``flat``, LOSE the other way round, else FLAT-MIXED."""
    if all(d >= -flat for d in deltas) and any(d > flat for d in deltas):
        return "WIN"
    if all(d <= flat for d in deltas) and any(d < -flat for d in deltas):
        return "LOSE"
    return "FLAT-MIXED"


def deltas(a: DataFrame, b: DataFrame, score: str, by: str = "window") -> DataFrame:
    """``by, first, second, delta`` of two score tables, and ``verdict`` over all of them (:func:`verdict`)."""
    both = a.select(by, F.col(score).alias("first")).join(b.select(by, F.col(score).alias("second")), by, "full_outer").withColumn("delta", F.col("second") - F.col("first"))
    got = verdict([float("nan") if r["delta"] is None else r["delta"] for r in both.select("delta").collect()])  # one row a window
    return both.withColumn("verdict", F.lit(got))


def upsert(records: DataFrame, new: DataFrame, key: str = "experiment") -> DataFrame:
    """The ledger with ``new`` records in place of those of the same key; columns that only one has are NULL in the other."""
    if new.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} isn't unique among the new records")
    return records.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def comparison(records: DataFrame, contract: str, metric: str, higher_is_better: bool = True, contract_column: str = "contract") -> DataFrame:
    """Experiments of one contract, best first."""
    order = F.desc_nulls_last(metric) if higher_is_better else F.asc_nulls_last(metric)
    return records.filter(F.col(contract_column) == contract).orderBy(order, "experiment")
