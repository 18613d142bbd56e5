"""Queries over the driver's tables for everything but the history families, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import DAY, split_past, split_trailing, windowed_distinct
from tidemark.operators import audit, blend, history, intervals, learning, metrics, splits, static
from tidemark.plans import feature_oracles as fo
from tidemark.plans import transactions
from tidemark.session import stored

D = 5
_REGISTRY: dict[str, tuple] = {}

# The folds of the event month and of the order years.
EVENT_FOLDS = (("2024-01-11", "2024-01-18"), ("2024-01-18", "2024-01-25"))
SPLIT = "2024-01-15"
WINDOWS = {"early": ("2024-01-11", "2024-01-20"), "late": ("2024-01-18", "2024-01-25"), "all": ("2024-01-11", "2024-01-25")}


def query(sql: str | None):
    def add(fn):
        _REGISTRY[fn.__name__] = (fn, sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int = D) -> DataFrame:
    return df.select(*[(F.round(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)) for f in df.schema.fields])


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Events as two scored models: a label, and scores with many ties."""
    e = _read(spark, d, "events")
    return e.select(
        F.col("event_id").alias("__row__"), F.col("ts").alias("timestamp"), (F.col("event_type") == "purchase").cast("int").alias("y"),
        F.floor("value").alias("s1"), F.col("value").alias("s2"), (F.least(F.col("value"), F.lit(400.0)) / 401).alias("p"), "user_id", "value",
    )


SCORED = "sc as (select event_id as __row__, ts as timestamp, cast(event_type = 'purchase' as integer) as y, floor(value) as s1, value as s2, least(value, 400.0) / 401 as p, user_id, value from events)"


def _ap_sql(source: str, score: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    group = f"group by {by}" if by else ""
    return f"""g as (select {key}{score} as s, sum(y) as tp, count(*) as n from {source} group by {key}{score}),
c as (select *, sum(tp) over ({part}order by s desc) as ctp, sum(n) over ({part}order by s desc) as cn from g),
r as (select {key}cast(sum(n) as bigint) as n, cast(sum(tp) as bigint) as positives, round(sum(tp * ctp / cn) / nullif(sum(tp), 0), {D}) as average_precision from c {group})"""


# --- row-local columns and profiles -----------------------------------------


@query(f"""with {fo.ORDER_LINES.replace('select l_orderkey * 10', "select l_shipdate, case when l_returnflag <> 'N' then l_returnflag end as dt, l_orderkey * 10", 1)}
select transaction_id, round(y, {D}) as log_amount, cast(hour(l_shipdate) as integer) as hour, cast(isodow(l_shipdate) - 1 as integer) as weekday, cast(isodow(l_shipdate) >= 6 as integer) as is_weekend,
cast(g = '?g' as integer) as merchant_category_missing, cast(dt is null as integer) as device_type_missing, cast(l = '?l' as integer) as location_missing from base""")
def static_features(spark, d):
    rows = transactions.order_lines(spark, d)
    return rounded(static.add_static(rows).select("transaction_id", "log_amount", "hour", "weekday", "is_weekend", "merchant_category_missing", "device_type_missing", "location_missing"))


def _profile_sql() -> str:
    names = static.PROFILES["device_location"]
    cols = ", ".join(fo.rounded(c, e, D) for f in names for c, e in fo.FAMILY_SQL[f].items())
    return f"with {fo.EVENTS}, {fo.MORE} select transaction_id, {cols} from t"


@query(_profile_sql())
def feature_profile(spark, d):
    rows = transactions.event_stream(spark, d)
    names = static.PROFILES["device_location"]
    out = static.add_profile(rows, "device_location")
    cols = [c for f in names for c in history.FAMILIES[f].columns()]
    return out.select("transaction_id", *[F.round(F.col(c) + fo.NUDGE, fo.digits_of(c, D)).alias(c) if fo.is_float(c) else F.col(c).cast("long").alias(c) for c in cols])


@query("""select l_orderkey, l_linenumber, l_quantity + 1 as family_size, cast(l_quantity + 1 = 1 as integer) as alone,
case when regexp_matches(l_returnflag || ', ' || l_linestatus || '. x', ',\\s*([^.]*)\\.') then regexp_extract(l_returnflag || ', ' || l_linestatus || '. x', ',\\s*([^.]*)\\.', 1) end as title from lineitem""")
def row_features(spark, d):
    line = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("SibSp"), F.lit(0).alias("Parch"), F.concat("l_returnflag", F.lit(", "), "l_linestatus", F.lit(". x")).alias("Name"))
    return static.add_row_features(line).select("l_orderkey", "l_linenumber", F.col("FamilySize").alias("family_size"), F.col("IsAlone").alias("alone"), F.col("Title").alias("title"))


@query(f"""select event_id, count(*) over w as past_group_count, round(avg(value) over w + {fo.NUDGE}, {D}) as past_group_mean from events
window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)""")
def past_group_mean(spark, d):
    e = _read(spark, d, "events").select("event_id", "user_id", "ts", "value")
    out = history.past_group(e, "user_id", ("ts", "event_id"), "value")
    return out.select("event_id", "past_group_count", F.round(F.col("past_group_mean") + fo.NUDGE, D).alias("past_group_mean"))


@query(f"with {fo.ORDER_LINES}, {fo.MORE} select transaction_id, c as customer_key, us, {fo.n(fo.P('c'))} as prior_count, cast(coalesce(sum(cast(round(x * 100) as bigint)) {fo.P('c')}, 0) as bigint) as prior_cents, round({fo.since(fo.P('c'))}, 6) as since_last from t")
def split_key_history(spark, d):
    """Customer history with each key dealt by time bucket: what a key with a third of all rows needs."""
    rows = history.prepare(stored(transactions.order_lines(spark, d).select("transaction_id", "customer_id", "amount", "timestamp")))
    out = split_past(rows, "_c", {"cents": F.round(F.col("_x") * 100).cast("long")}, bucket=180 * DAY)
    return out.select("transaction_id", F.col("customer_id").alias("customer_key"), "us", "prior_count", F.coalesce("cents", F.lit(0)).alias("prior_cents"), F.round((F.col("us") - F.col("prior_last")) / 1e6, 6).alias("since_last"))


@query(f"with {fo.ORDER_LINES}, {fo.MORE} select transaction_id, us, m as merchant_key, {fo.n(fo.R(30 * fo.D, 'm'))} as recent_count, cast(coalesce(sum(cast(round(x * 100) as bigint)) {fo.R(30 * fo.D, 'm')}, 0) as bigint) as recent_cents from t")
def split_key_trailing(spark, d):
    """Thirty days of a merchant, with each merchant dealt by time bucket."""
    rows = history.prepare(stored(transactions.order_lines(spark, d).select("transaction_id", "merchant_id", "amount", "timestamp")))
    out = split_trailing(rows, "_m", 30 * DAY, {"cents": F.round(F.col("_x") * 100).cast("long")}, bucket=90 * DAY)
    return out.select("transaction_id", "us", F.col("_m").alias("merchant_key"), "recent_count", F.coalesce("cents", F.lit(0)).alias("recent_cents"))


@query(f"with {fo.ORDER_LINES}, {fo.MORE} select transaction_id, us, m as merchant_key, cast(count(distinct c) {fo.R(30 * fo.D, 'm')} as bigint) as customers_30d from t")
def windowed_distinct_sweep(spark, d):
    rows = history.prepare(transactions.order_lines(spark, d).select("transaction_id", "customer_id", "merchant_id", "amount", "timestamp"))
    out = windowed_distinct(rows.select("transaction_id", "_m", "_c", "us"), "_m", "_c", 30 * DAY, "customers_30d")
    return out.select("transaction_id", "us", F.col("_m").alias("merchant_key"), "customers_30d")


def _seeded_sql() -> str:
    names = ("customer_history", "customer_merchant")
    cols = ", ".join(fo.rounded(c, e, D) for f in names for c, e in fo.FAMILY_SQL[f].items())
    return f"with {fo.EVENTS}, {fo.MORE}, o as (select transaction_id, us, {cols} from t) select * exclude (us) from o where us >= epoch_us(timestamp '{SPLIT}')"


@query(_seeded_sql())
def seeded_inference(spark, d):
    rows = transactions.event_stream(spark, d)
    names = ("customer_history", "customer_merchant")
    out = history.seeded(rows.filter(F.col("timestamp") < _at(SPLIT)), rows.filter(F.col("timestamp") >= _at(SPLIT)), names)
    cols = [c for f in names for c in history.FAMILIES[f].columns()]
    return out.select("transaction_id", *[F.round(F.col(c) + fo.NUDGE, fo.digits_of(c, D)).alias(c) if fo.is_float(c) else F.col(c).cast("long").alias(c) for c in cols])


# --- splits -------------------------------------------------------------------


@query(f"select event_id, case {' '.join(f"when ts >= timestamp '{a}' and ts < timestamp '{b}' then {k}" for k, (a, b) in enumerate(EVENT_FOLDS))} else -1 end as __fold__ from events")
def calendar_folds(spark, d):
    return splits.calendar_folds(_read(spark, d, "events").select("event_id", "ts"), EVENT_FOLDS, "ts").select("event_id", "__fold__")


@query(" union all ".join(f"select {k} as fold, count(*) filter (ts < timestamp '{a}') as n_train, count(*) filter (ts >= timestamp '{a}' and ts < timestamp '{b}') as n_valid from events" for k, (a, b) in enumerate(EVENT_FOLDS)))
def fold_sizes(spark, d):
    return splits.fold_sizes(_read(spark, d, "events").select("ts"), EVENT_FOLDS, "ts")


@query(f"""with w as (select event_id, pow(2.0, -(epoch_us((select max(ts) from events)) - epoch_us(ts)) / (60.0 * {DAY})) as w from events)
select event_id, round(w / (select avg(w) from w), {D}) as weight from w""")
def recency_weights(spark, d):
    return rounded(splits.recency_weight(_read(spark, d, "events").select("event_id", "ts"), 60.0, "ts").select("event_id", "weight"))


@query("""with n as (select count(*) as n from events), o as (select event_id, row_number() over (order by ts, event_id) - 1 as i from events),
f as (select n - cast(ceil(n * 0.2) as bigint) as first from n)
select event_id, case when i >= first then 'valid' when i >= first - 50 then 'gap' else 'train' end as split from o, f""")
def time_holdout(spark, d):
    return splits.time_holdout(_read(spark, d, "events").select("event_id", "ts"), 0.2, ("ts", "event_id"), 50).select("event_id", "split")


@query("""with n as (select count(*) as n from events), o as (select event_id, row_number() over (order by ts, event_id) - 1 as i from events),
f as (select n // 6 as size, n - 5 * (n // 6) as first from n)
select event_id, cast(case when i < first and first - i <= 20 then -2 when i < first then -1 else (i - first) // size end as integer) as __fold__ from o, f""")
def time_series_folds(spark, d):
    return splits.time_folds(_read(spark, d, "events").select("event_id", "ts"), 5, ("ts", "event_id"), 20, mark=-2).select("event_id", "__fold__")


@query("""with k as (select event_type, count(*) as n from events group by event_type), f as (select unnest(range(5)) as f)
select cast(f as integer) as __fold__, event_type, n // 5 + cast(f < n % 5 as bigint) as n from k, f""")
def stratified_folds(spark, d):
    """Sizes of the folds in each class; which rows are in them is a matter of the seed."""
    e = splits.kfold(_read(spark, d, "events").select("event_id", "event_type"), 5, ("event_id",), stratify="event_type")
    return e.groupBy("__fold__", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, cast(1 as bigint) as folds, count(*) as n from events group by user_id")
def group_folds(spark, d):
    """Every group in one fold."""
    e = splits.group_fold(_read(spark, d, "events").select("event_id", "user_id"), 5, "user_id")
    return e.groupBy("user_id").agg(F.count_distinct("__fold__").alias("folds"), F.count(F.lit(1)).alias("n"))


# Folds with a gap between training and validation, and some that share training rows.
GAP_FOLDS = (("2024-01-09", "2024-01-11", "2024-01-18"), ("2024-01-15", "2024-01-18", "2024-01-25"), ("2024-01-25", "2024-01-25", "2024-01-28"))
_PLACED = "o as (select *, row_number() over (order by ts, event_id) - 1 as i from events), n as (select count(*) as n from events)"
_STARTS = f"{_PLACED}, f as (select f, n - (5 - f) * (n // 6) as start, n // 6 as size from n, (select unnest(range(5)) as f))"


@query(f"""with {_STARTS} select cast(f as integer) as fold, count(*) filter (i < start - 20) as n_train, count(*) filter (i >= start - 20 and i < start) as n_gap,
count(*) filter (i >= start and i < start + size) as n_valid, max(ts) filter (i < start - 20) as train_last, min(ts) filter (i >= start) as valid_first from o, f group by f""")
def fold_intervals(spark, d):
    """Folds of equal rows with a gap of 20 before each: rows and edges of both parts."""
    e = _read(spark, d, "events").select("event_id", "ts")
    folds = intervals.by_rows(e, 5, ("ts", "event_id"), 20)
    return folds.summary(e, "ts").select("fold", "n_train", "n_gap", "n_valid", "train_last", "valid_first")


@query(f"with {_STARTS} select event_id, cast(f as integer) as fold, case when i < start - 20 then 'train' when i < start then 'gap' else 'valid' end as part from o, f where i < start + size")
def fold_membership(spark, d):
    """Every part that every row has in every fold."""
    e = _read(spark, d, "events").select("event_id", "ts")
    return intervals.by_rows(e, 5, ("ts", "event_id"), 20).membership(e).select("event_id", "fold", "part")


@query(" union all ".join(f"select {k} as fold, count(*) filter (ts < timestamp '{a}') as n_train, count(*) filter (ts >= timestamp '{a}' and ts < timestamp '{b}') as n_gap, count(*) filter (ts >= timestamp '{b}' and ts < timestamp '{c}') as n_valid from events" for k, (a, b, c) in enumerate(GAP_FOLDS)))
def calendar_intervals(spark, d):
    e = _read(spark, d, "events").select("ts")
    return intervals.calendar(GAP_FOLDS, "ts").summary(e).select("fold", "n_train", "n_gap", "n_valid")


@query(f"""with {_PLACED}, k as (select n - cast(ceil(n * 0.2) as bigint) as start from n)
select count(*) filter (i < start - 50) as n_train, count(*) filter (i >= start - 50 and i < start) as n_gap, count(*) filter (i >= start) as n_valid from o, k""")
def holdout_interval(spark, d):
    e = _read(spark, d, "events").select("event_id", "ts")
    return intervals.holdout(e, 0.2, ("ts", "event_id"), 50).summary(e).select("n_train", "n_gap", "n_valid")


# --- metrics -------------------------------------------------------------------


@query(f"with {SCORED}, {_ap_sql('sc', 's1')} select * from r")
def average_precision(spark, d):
    return rounded(metrics.average_precision(_scored(spark, d), "y", "s1"))


@query(f"""with {SCORED}, k as (select y, rank() over (order by s1) + (count(*) over (partition by s1) - 1) / 2 as r from sc)
select count(*) as n, cast(sum(y) as bigint) as positives, round((sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), {D}) as roc_auc from k""")
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(_scored(spark, d), "y", "s1"))


@query(f"""with {SCORED}, w as (select *, unnest([{', '.join(f"case when timestamp >= timestamp '{a}' and timestamp < timestamp '{b}' then '{n}' end" for n, (a, b) in WINDOWS.items())}]) as win from sc),
v as (select y, s2, win as "window" from w where win is not null), {_ap_sql('v', 's2', '"window"')} select * from r""")
def windowed_ap(spark, d):
    conditions = {n: (F.col("timestamp") >= _at(a)) & (F.col("timestamp") < _at(b)) for n, (a, b) in WINDOWS.items()}
    return rounded(metrics.windowed(_scored(spark, d), conditions, metrics.average_precision, "y", "s2"))


@query(f"""with {SCORED}, v as (select y, s1, case when value < 20 then 'low' when value between 20 and 100 then 'middle' else 'high' end as bucket from sc),
{_ap_sql('v', 's1', 'bucket')} select *, round(positives / n, {D}) as prevalence from r""")
def bucket_support(spark, d):
    v = F.col("value")
    return rounded(audit.bucket_support(_scored(spark, d), F.when(v < 20, "low").when(v.between(20, 100), "middle").otherwise("high"), "y", "s1"))


@query(f"""select count(*) as n, round(avg(abs(l_extendedprice - 2000 * l_quantity)), 2) as mae, round(avg(pow(l_extendedprice - 2000 * l_quantity, 2)), 0) as mse, round(sqrt(avg(pow(l_extendedprice - 2000 * l_quantity, 2))), 2) as rmse,
round(1 - avg(pow(l_extendedprice - 2000 * l_quantity, 2)) / var_pop(l_extendedprice), {D}) as r2 from lineitem""")
def regression_metrics(spark, d):
    line = _read(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 2000).alias("p"))
    r = metrics.regression(line, "l_extendedprice", "p")
    return r.select("n", F.round("mae", 2).alias("mae"), F.round("mse", 0).alias("mse"), F.round("rmse", 2).alias("rmse"), F.round("r2", D).alias("r2"))


@query(f"""with {SCORED}, c as (select y, cast(p >= 0.25 as integer) as q from sc),
m as (select count(*) as n, count(*) filter (y = q) as ok, count(*) filter (y = 1 and q = 1) as tp, count(*) filter (y = 0 and q = 1) as fp, count(*) filter (y = 1 and q = 0) as fn from c)
select n, round(ok / n, {D}) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), {D}) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), {D}) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), {D}) as f1 from m""")
def classification_metrics(spark, d):
    rows = _scored(spark, d).withColumn("q", metrics.labels_from(F.col("p"), 0.25))
    return rounded(metrics.classification(rows, "y", "q"))


@query(f"""with e as (select event_type as y, case when value < 10 then 'view' when value < 40 then 'click' else event_type end as q from events),
k as (select distinct y as k from e), t as (select k, count(*) filter (y = k) as s, count(*) filter (q = k) as p, count(*) filter (y = k and q = k) as tp from e, k group by k)
select cast(sum(s) as bigint) as n, round(sum(tp) / sum(s), {D}) as accuracy, round(avg(coalesce(tp / nullif(p, 0), 0)), {D}) as precision, round(avg(coalesce(tp / nullif(s, 0), 0)), {D}) as recall, round(avg(coalesce(2 * tp / nullif(s + p, 0), 0)), {D}) as f1 from t""")
def multiclass_metrics(spark, d):
    v = F.col("value")
    rows = _read(spark, d, "events").select(F.col("event_type").alias("y"), F.when(v < 10, "view").when(v < 40, "click").otherwise(F.col("event_type")).alias("q"))
    return rounded(metrics.classification(rows, "y", "q", "macro"))


@query(f"with {SCORED} select count(*) as n, round(avg(-case when y = 1 then ln(least(greatest(p, 1e-15), 1 - 1e-15)) else ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) end), {D}) as log_loss from sc")
def log_loss(spark, d):
    return rounded(metrics.log_loss(_scored(spark, d), "y", "p"))


@query("select count(*) as n, count(*) filter (value < 0 or value > 1) as out_of_range, cast(0 as bigint) as not_summing from events")
def probability_checks(spark, d):
    return metrics.probability_faults(_read(spark, d, "events"), ["value"])


# --- blends ----------------------------------------------------------------------


def _oof(spark, d, score: str) -> DataFrame:
    e = splits.calendar_folds(_scored(spark, d), EVENT_FOLDS)
    return e.select("__row__", "__fold__", F.when(F.col("__fold__") >= 0, F.col(score).cast("double")).alias("pred_0"), "y")


OOF = f"oof as (select *, case {' '.join(f"when timestamp >= timestamp '{a}' and timestamp < timestamp '{b}' then {k}" for k, (a, b) in enumerate(EVENT_FOLDS))} else -1 end as __fold__ from sc)"


@query(f"with {SCORED}, {OOF} select __row__, __fold__, round(case when __fold__ >= 0 then 0.75 * p + 0.25 * s1 end, {D}) as pred_0 from oof")
def blend_weighted(spark, d):
    a, b = _oof(spark, d, "p").drop("y"), _oof(spark, d, "s1").drop("y")
    return rounded(blend.blend([a, b], [0.75, 0.25]).select("__row__", "__fold__", "pred_0"))


@query(f"""with {SCORED}, r as (select __row__, rank() over (order by s1) + (count(*) over (partition by s1) - 1) / 2 as a, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 as b, count(*) over () as n from sc)
select __row__, round((a + b) / 2 / n, 8) as rank_average from r""")
def rank_average(spark, d):
    return rounded(blend.rank_average(_scored(spark, d).select("__row__", "s1", "p"), ["s1", "p"]).select("__row__", "rank_average"), 8)


@query(f"""with {SCORED}, r as (select s1, p, rank() over (order by s1) + (count(*) over (partition by s1) - 1) / 2 as a, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 as b from sc)
select count(*) as n, round(corr(s1, p), {D}) as pearson, round(corr(a, b), {D}) as spearman,
round((select count(*) from (select __row__ from (select __row__ from sc order by s1 desc, __row__ limit 1000) x where __row__ in (select __row__ from sc order by p desc, __row__ limit 1000))) / 1000, {D}) as top_1000_overlap from r""")
def diversity(spark, d):
    return rounded(blend.diversity(_scored(spark, d).select("__row__", "s1", "p"), "s1", "p", (1000,)))


@query(f"""with {SCORED}, r as (select rank() over (order by s1) + (count(*) over (partition by s1) - 1) / 2 as a, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 as b, rank() over (order by user_id) + (count(*) over (partition by user_id) - 1) / 2 as c from sc)
select 's1' as a, 's1' as b, 1.0 as spearman union all select 'p', 'p', 1.0 union all select 'user_id', 'user_id', 1.0 union all select 's1', 'p', round(corr(a, b), {D}) from r
union all select 's1', 'user_id', round(corr(a, c), {D}) from r union all select 'p', 'user_id', round(corr(b, c), {D}) from r""")
def spearman_matrix(spark, d):
    return rounded(blend.spearman_matrix(_scored(spark, d), ["s1", "p", "user_id"]))


@query(f"with {SCORED} select __row__, s1 from sc order by s1 desc, __row__ limit 100")
def top_k(spark, d):
    return blend.top_k(_scored(spark, d).select("__row__", F.col("s1").cast("double").alias("s1")), "s1", 100)


@query(f"with {SCORED} select 'p' as \"column\", count(*) as n, cast(0 as bigint) as missing, count(*) filter (__row__ % 10 = 0 and p > 0) as different, round(max(case when __row__ % 10 = 0 then p * 1e-3 else 0 end), 8) as max_abs_difference from sc")
def compare_predictions(spark, d):
    a = _scored(spark, d).select("__row__", "p")
    b = a.withColumn("p", F.when(F.col("__row__") % 10 == 0, F.col("p") * 1.001).otherwise(F.col("p")))
    return rounded(blend.compare_numbers(b, a, "__row__", ["p"]), 8)


# --- audits -----------------------------------------------------------------------


@query(f"with {fo.ORDER_LINES} " + " union all ".join(f"select '{c}' as \"column\", count(*) as n, count(*) filter ({k} = '?{k}') as missing, round(avg(cast({k} = '?{k}' as integer)), {D}) as missing_rate from base" for c, k in (("device_id", "d"), ("merchant_category", "g"), ("location", "l"))))
def missingness(spark, d):
    return rounded(audit.missingness(transactions.order_lines(spark, d), ["device_id", "merchant_category", "location"]))


@query(f"with {fo.ORDER_LINES} select cast(d = '?d' as integer) || '' || cast(g = '?g' as integer) || cast(l = '?l' as integer) as pattern, count(*) as n from base group by 1 order by n desc, 1 limit 5")
def missing_patterns(spark, d):
    return audit.missing_patterns(transactions.order_lines(spark, d), ["device_id", "merchant_category", "location"])


def _numeric_sql() -> str:
    one = []
    for c in ("l_quantity", "l_extendedprice", "l_tax"):
        tiles = ", ".join(f"round(quantile_cont({c}, {p}), 4) as p{round(p * 100):02d}" for p in audit.PERCENTILES)
        far = f"(select count(*) from lineitem where {c} < (select quantile_cont({c}, 0.25) - 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) from lineitem) or {c} > (select quantile_cont({c}, 0.75) + 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) from lineitem))"
        one.append(f"select '{c}' as \"column\", count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c}) as low, max({c}) as high, {tiles}, {far} as extreme, round(skewness({c}), 4) as skew from lineitem")
    return " union all ".join(one)


@query(_numeric_sql())
def numeric_profile(spark, d):
    return rounded(audit.numeric_profile(_read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), 4)


@query(" union all ".join(f"select '{c}' as \"column\", count(v) as \"distinct\", count(*) filter (n = 1 and v is not null) as singletons, count(*) filter (n < 10 and v is not null) as rare, max(n) as top_n from (select cast({c} as varchar) as v, count(*) as n from lineitem group by 1)" for c in ("l_suppkey", "l_partkey", "l_returnflag")))
def categorical_profile(spark, d):
    return audit.categorical_profile(_read(spark, d, "lineitem"), ["l_suppkey", "l_partkey", "l_returnflag"])


@query(f"select l_returnflag as value, count(*) as n, round(count(*) / (select count(*) from lineitem), {D}) as share from lineitem group by 1")
def value_counts(spark, d):
    return rounded(audit.value_counts(_read(spark, d, "lineitem"), "l_returnflag"))


_SIDES = f"a as (select * from events where ts < timestamp '{SPLIT}'), b as (select * from events where ts >= timestamp '{SPLIT}')"


def _sides(spark, d):
    e = _read(spark, d, "events")
    return e.filter(F.col("ts") < _at(SPLIT)), e.filter(F.col("ts") >= _at(SPLIT))


@query(f"""with {_SIDES}, x as (select user_id as v, count(*) / (select count(*) from a) as s from a group by 1), y as (select user_id as v, count(*) / (select count(*) from b) as s from b group by 1)
select 'user_id' as "column", round(sum(abs(coalesce(x.s, 0) - coalesce(y.s, 0))) / 2, {D}) as tv_distance, count(*) filter (y.s is null) as only_a, count(*) filter (x.s is null) as only_b from x full outer join y on x.v = y.v""")
def tv_drift(spark, d):
    return rounded(audit.tv_drift(*_sides(spark, d), "user_id"))


@query(f"with {_SIDES} select 'value' as \"column\", {', '.join(f'round((select quantile_cont(value, {p}) from {t}), 4) as {t}_p{round(p * 100):02d}' for t in 'ab' for p in (0.05, 0.5, 0.95))}")
def numeric_drift(spark, d):
    return rounded(audit.numeric_drift(*_sides(spark, d), ["value"]), 4)


@query(f"""with {_SIDES} {' union all '.join(f'''select '{c}' as "column", cast((select count(distinct {c}) from a) as bigint) as in_a, cast((select count(distinct {c}) from b) as bigint) as in_b,
cast((select count(*) from (select distinct {c} from a intersect select distinct {c} from b)) as bigint) as shared''' for c in ('user_id', 'props'))}""")
def entity_overlap(spark, d):
    return audit.entity_overlap(*_sides(spark, d), ["user_id", "props"])


@query("select user_id, props, count(*) as n, count(distinct event_type) as labels from events group by user_id, props having count(distinct event_type) > 1")
def label_conflicts(spark, d):
    return audit.label_conflicts(_read(spark, d, "events"), ["user_id", "props"], "event_type")


@query(f"with {_SIDES} select user_id, event_type, props from a intersect select user_id, event_type, props from b")
def vector_overlap_join(spark, d):
    return audit.vector_overlap(*_sides(spark, d), ["user_id", "event_type", "props"])


@query("with g as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2) select cast(sum(n) as bigint) as n, count(*) as \"distinct\", cast(sum(n - 1) as bigint) as duplicates from g")
def dedupe_count(spark, d):
    return audit.duplicates(_read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"with {_SIDES} select distinct props from a where props not in (select props from b)")
def only_in(spark, d):
    return audit.only_in(*_sides(spark, d), "props")


@query("""with l as (select o_orderdate as t, lag(o_orderdate) over (order by o_orderkey) as p from orders)
select count(*) as n, min(t) as first, max(t) as last, count(distinct t) as "distinct", count(*) filter (t < p) as backward from l""")
def time_profile(spark, d):
    return audit.time_profile(_read(spark, d, "orders"), "o_orderdate", "o_orderkey")


@query(f"with {_SIDES} select (select min(ts) from a) as a_first, (select max(ts) from a) as a_last, (select min(ts) from b) as b_first, (select max(ts) from b) as b_last, false as overlap")
def time_overlap(spark, d):
    return audit.time_overlap(*_sides(spark, d), "ts")


@query("select 'ts' as \"column\", 1.0 as parseable, true as time_like union all select 'event_type', 0.0, false")
def time_like(spark, d):
    return audit.time_like(_read(spark, d, "events"), ["ts", "event_type"])


@query(f"""select 'l_quantity' as "column", false as equal, round(corr(l_quantity, l_extendedprice), {D}) as correlation from lineitem union all select 'l_extendedprice', true, 1.0
union all select 'l_returnflag', false, null""")
def target_leaks(spark, d):
    return rounded(audit.target_leaks(_read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_extendedprice", "l_returnflag"]))


@query(f"select event_type, round(avg(cast(value > 0 as integer)), {D}) as positive, round(avg(cast(value >= 50 as integer)), {D}) as large from events group by event_type")
def coverage(spark, d):
    return rounded(audit.coverage(_read(spark, d, "events"), {"positive": F.col("value") > 0, "large": F.col("value") >= 50}, ("event_type",)))


@query(f"select event_type, count(value) as n, round(quantile_cont(value, 0.5), 4) as median, round(quantile_cont(value, 0.9), 4) as p90, min(value) as low, max(value) as high, round(avg(cast(value <> 0 as integer)), 4) as nonzero from events group by event_type")
def deviation_summary(spark, d):
    return rounded(audit.deviation_summary(_read(spark, d, "events"), "value", ("event_type",)), 4)


@query(f"""with {fo.EVENTS}, {fo.MORE}, k as (select cast({fo.n(fo.P('c', 'm'))} = 0 as integer) as new_merchant, cast({fo.n(fo.P('c', 'g'))} = 0 as integer) as new_category, x from t)
select new_merchant, new_category, count(*) as n, round(avg(x), {D}) as mean_amount from k group by 1, 2""")
def cross_buckets(spark, d):
    out = history.features(transactions.event_stream(spark, d), ["customer_merchant", "customer_category"])
    g = out.groupBy(F.col("customer_merchant_is_new").alias("new_merchant"), F.col("customer_category_is_new").alias("new_category"))
    return rounded(g.agg(F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean_amount")))


# --- preprocessing and joins ----------------------------------------------------------


@query(f"""with {fo.ORDER_LINES}, m as (select g from base where g <> '?g' group by g order by count(*) desc, g limit 1)
select transaction_id, x as amount, case when g = '?g' then (select g from m) else g end as merchant_category, round(x / (select stddev_pop(x) from base), {D}) as scaled from base""")
def impute_and_scale(spark, d):
    rows = stored(transactions.order_lines(spark, d).select("transaction_id", "amount", "merchant_category"))  # read five times, joined once
    filled = learning.impute(rows, learning.fit_imputer(rows, ["amount"], ["merchant_category"])).withColumn("scaled", F.col("amount"))
    return rounded(learning.scale(filled, learning.fit_scaler(filled, ["scaled"])).select("transaction_id", "amount", "merchant_category", "scaled"))


@query("select o_orderkey as id, round(o_totalprice / 600000 + 1e-9, 6) as score from orders")
def submission(spark, d):
    from tidemark.sources.tables import build_submission

    o = _read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 600000 + 1e-9, 6).alias("pred_0"))
    return build_submission(o, _read(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", "score")


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-02-01' order by o_totalprice desc, o_orderkey limit 50")
def ranked_interval(spark, d):
    from pyspark.sql import Window

    o = _read(spark, d, "orders").filter((F.col("o_orderdate") >= _at("1996-01-01")) & (F.col("o_orderdate") < _at("1996-02-01")))
    top = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)  # so the window below has 50 rows
    return top.select("o_orderkey", "o_totalprice", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


def registry() -> dict[str, tuple]:
    return _REGISTRY
