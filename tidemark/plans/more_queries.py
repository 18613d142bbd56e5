"""Queries over sources, sinks, splits, saved tables and estimators, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.functions.windows import event_us, parse_time
from tidemark.operators import audit, blend, history, intervals, learning, metrics, splits, static
from tidemark.plans import experiment, transactions
from tidemark.plans import feature_oracles as fo
from tidemark.plans.queries import D, EVENT_FOLDS, OOF, SCORED, SPLIT, WINDOWS, _STARTS, _ap_sql, _at, _oof, _read, _scored, query, rounded
from tidemark.session import shared_path
from tidemark.sources import tables


# --- sources and sinks --------------------------------------------------------


@query("select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, o_totalprice from orders")
def csv_round_trip(spark, d):
    path = shared_path(spark, "orders.csv")
    tables.save_frame(_read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return tables.read_table(spark, path, id_columns=["o_orderkey"])


@query("select cast(s_suppkey as varchar) as s_suppkey, s_name, s_acctbal from supplier")
def tsv_scan(spark, d):
    path = shared_path(spark, "supplier.tsv")
    _read(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).option("sep", "\t").csv(path)
    return tables.read_table(spark, path, id_columns=["s_suppkey"])


@query("select n_name, cast(n_nationkey as bigint) as n_nationkey, cast(n_regionkey as bigint) as n_regionkey from nation")
def jsonl_scan(spark, d):
    path = shared_path(spark, "nation.jsonl")
    _read(spark, d, "nation").write.json(path)
    return tables.read_table(spark, path).select("n_name", "n_nationkey", "n_regionkey")


@query("select r_name, cast(r_regionkey as bigint) as r_regionkey from region")
def json_scan(spark, d):
    """One document that holds all rows."""
    path = shared_path(spark, "region.json")
    r = _read(spark, d, "region")  # five rows
    r.agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value")).coalesce(1).write.text(path)
    return tables.read_table(spark, path).select("r_name", "r_regionkey")


@query("select cast(7 as bigint) as n")
def limited_scan(spark, d):
    return tables.read_table(spark, f"{d}/orders.parquet", limit=7).agg(F.count(F.lit(1)).alias("n"))


@query("select cast(50 as bigint) as kept, count(*) as total, cast(0 as bigint) as strangers from orders")
def sampled_rows(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey")
    some, total = tables.sampled(o, 50)
    return some.agg(F.count_distinct("o_orderkey").alias("kept")).select("kept", F.lit(total).cast("long").alias("total"), F.lit(some.join(o, "o_orderkey", "left_anti").count()).alias("strangers"))


@query("select cast(3 as bigint) as files, true as filled")
def inventory(spark, d):
    path = shared_path(spark, "parts")
    _read(spark, d, "orders").select("o_orderkey").repartition(3).write.parquet(path)
    return tables.inventory(spark, path).agg(F.count(F.lit(1)).alias("files"), F.bool_and(F.col("length") > 0).alias("filled"))


@query(f"""with {fo.EVENTS} select cast(transaction_id as varchar) as transaction_id, c as customer_id, round(y, {D}) as log_amount, x as amount, cast(event_type = 'purchase' as integer) as fraud
from base join events on event_id = transaction_id""")
def training_load(spark, d):
    """Written, scanned with checked columns and ids as text, and given a profile."""
    path = shared_path(spark, "transactions.parquet")
    rows = transactions.event_stream(spark, d).withColumn("fraud", (F.col("merchant_category") == "purchase"))
    rows.withColumn("fraud", F.coalesce("fraud", F.lit(False)).cast("int")).write.parquet(path)
    return rounded(tables.load_transactions(spark, path).select("transaction_id", "customer_id", "log_amount", "amount", "fraud"))


@query(f"""with {fo.EVENTS} select x as amount, age as account_age_days, cast(event_type = 'purchase' as integer) as fraud from base join events on event_id = transaction_id""")
def training_frame(spark, d):
    """What is learned from has no ids and times."""
    e = transactions.event_stream(spark, d).select("transaction_id", "customer_id", "timestamp", "amount", F.col("account_age_days").cast("long").alias("account_age_days"), F.coalesce((F.col("merchant_category") == "purchase").cast("int"), F.lit(0)).alias("fraud"))
    return static.training_frame(e, "fraud")


@query(f"with {SCORED}, {OOF} select __row__, user_id, __fold__, case when __fold__ >= 0 then p end as pred_0 from oof")
def saved_predictions(spark, d):
    path = shared_path(spark, "predictions")
    own = splits.calendar_folds(_scored(spark, d), EVENT_FOLDS)
    tables.save_predictions(own.select("__row__", "user_id", "__fold__", F.when(F.col("__fold__") >= 0, F.col("p")).alias("pred_0")), path, ["user_id"], {"model": "p"})
    return tables.read_predictions(spark, path)[0]


@query("select l_orderkey, l_linenumber, l_quantity from lineitem")
def matrix_cache(spark, d):
    path, line = shared_path(spark, "matrix"), _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    tables.materialized(line, path)
    return tables.materialized(line, path)


@query("""select event_id, cast(user_id as varchar) as category, coalesce(case when user_id % 3 > 0 then event_type end, '') as text,
replace(props, '|', '/') || ' x' as cell, '{"k":' || json_extract_string(props, '$.k') || '}' as nested from events""")
def clean_cells(spark, d):
    e = _read(spark, d, "events").select(
        "event_id", static.clean_category(F.col("user_id")).alias("category"), static.clean_text(F.when(F.col("user_id") % 3 > 0, F.col("event_type"))).alias("text"),
        static.brief(F.concat("props", F.lit("\r\nx"))).alias("cell"), F.from_json("props", "k int").alias("nested"),
    )
    return static.nested_text(e)


@query("select event_id, epoch_us(date_trunc('second', ts)) as us from events")
def parsed_times(spark, d):
    """Times written in five ways, seconds since the epoch among them."""
    e = _read(spark, d, "events").select("event_id", F.date_trunc("second", "ts").alias("t"))
    ways = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss")
    text = F.unix_timestamp("t").cast("string")
    for k, way in enumerate(ways):
        text = F.when(F.col("event_id") % 5 == k, F.date_format("t", way)).otherwise(text)
    return e.select("event_id", F.unix_micros(parse_time(text)).alias("us"))


@query("""select * from (values ('entity', 'customer_id'), ('entity', 'merchant_id'), ('entity', 'merchant_category'), ('entity', 'device_id'), ('entity', 'device_type'), ('entity', 'account_age_days'),
('id', 'transaction_id'), ('id', 'customer_id'), ('id', 'merchant_id'), ('id', 'device_id'), ('time', 'timestamp'), ('geo', 'location')) t(role, "column")""")
def column_roles(spark, d):
    return audit.roles_table(transactions.event_stream(spark, d))


# --- the stream ---------------------------------------------------------------------

_STREAMED = ("customer_history", "customer_merchant", "customer_velocity", "account_consistency")
_SEVERAL = ("merchant_new_customers", "customer_history", "device_sharing", "amount_30d")


def _stream_sql(families) -> str:
    more, source = "", "t"
    if "account_consistency" in families:
        more, source = fo._extra("account_consistency")
    cols = ", ".join(fo.rounded(c, e, D) for f in families for c, e in fo.FAMILY_SQL[f].items())
    return f"with {fo.EVENTS}, {fo.MORE}{more} select cast(transaction_id as varchar) as transaction_id, us, {cols} from {source}"


def _stream_in(spark, d, path, condition=None, closing=True):
    """The events as files of a stream, in the order of their times, with a closing row."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = transactions.event_stream(spark, d).drop("device_type").withColumn("transaction_id", F.col("transaction_id").cast("string"))
    own = e if condition is None else e.filter(condition)
    own.repartitionByRange(3, "timestamp").write.parquet(path)
    if closing:
        end = e.limit(1).withColumns({"transaction_id": F.lit("end"), "customer_id": F.lit("end"), "merchant_id": F.lit("end"), "device_id": F.lit("end"), "timestamp": _at("2100-01-01")})
        end.write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).parquet(path)


def _streamed(spark, events, families, path, **how):
    from tidemark.streaming.history import stream_features

    q = stream_features(events, families, **how).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    cols = [c for f in families for c in fo.FAMILY_SQL[f]]
    out = spark.read.parquet(f"{path}/out")
    return out.select("transaction_id", "us", *[F.round(F.col(c) + fo.NUDGE, fo.digits_of(c, D)).alias(c) if fo.is_float(c) else F.col(c).cast("long").alias(c) for c in cols])


@query(_stream_sql(_STREAMED))
def stream_history(spark, d):
    """The events as a stream of files: features equal to those of the batch."""
    path = shared_path(spark, "stream")
    return _streamed(spark, _stream_in(spark, d, f"{path}/in"), _STREAMED, path)


@query(_stream_sql(_SEVERAL))
def stream_several_keys(spark, d):
    """Families of merchants, customers and devices from one streaming query."""
    path = shared_path(spark, "stream")
    return _streamed(spark, _stream_in(spark, d, f"{path}/in"), _SEVERAL, path)


@query(_stream_sql(_STREAMED))
def stream_continued(spark, d):
    """A query that stops in the middle of the events, a snapshot of its state, and another that goes on from it."""
    from tidemark.streaming.history import snapshot

    path = shared_path(spark, "stream")
    first = _streamed(spark, _stream_in(spark, d, f"{path}/1/in", F.col("timestamp") < _at(SPLIT), closing=False), _STREAMED, f"{path}/1")
    states = {}
    for lead, df in snapshot(spark, f"{path}/1/state", _STREAMED).items():
        df.write.parquet(f"{path}/snapshot{lead}")
        states[lead] = spark.read.parquet(f"{path}/snapshot{lead}")
    second = _streamed(spark, _stream_in(spark, d, f"{path}/2/in", F.col("timestamp") >= _at(SPLIT)), _STREAMED, f"{path}/2", snapshots=states)
    return first.unionByName(second)


# --- subsets and profiles of features ------------------------------------------


def _feature_columns(out, cols):
    return out.select("transaction_id", *[F.round(F.col(c) + fo.NUDGE, fo.digits_of(c, D)).alias(c) if fo.is_float(c) else F.col(c).cast("long").alias(c) for c in cols])


_SUBSET = ("customer_merchant_count_share", "customer_prior_count", "customer_merchant_is_new")


@query(f"with {fo.EVENTS}, {fo.MORE} select transaction_id, {', '.join(fo.rounded(c, {**fo.FAMILY_SQL['customer_history'], **fo.FAMILY_SQL['customer_merchant']}[c], D) for c in _SUBSET)} from t")
def requested_features(spark, d):
    """Columns of two families in the order of the request."""
    out = history.build(transactions.event_stream(spark, d), ["customer_history", "customer_merchant"], _SUBSET)
    return _feature_columns(out, out.columns[-len(_SUBSET) :])


def _profile(name: str):
    names = [f for f in static.PROFILES[name] if f != "account_consistency"]
    cols = [c for f in names for c in fo.FAMILY_SQL[f]]
    made = ", ".join(fo.rounded(c, e, D) for f in names for c, e in fo.FAMILY_SQL[f].items())
    local = f"round(y, {D}) as log_amount, cast(us % {fo.D} // {fo.H} as integer) as hour"

    def run(spark, d):
        out = static.add_profile(transactions.event_stream(spark, d), name)
        own = _feature_columns(out, cols).drop("transaction_id").columns if cols else []
        kept = out.select("transaction_id", F.round("log_amount", D).alias("log_amount"), F.col("hour").cast("int").alias("hour"), *[F.round(F.col(c) + fo.NUDGE, fo.digits_of(c, D)).alias(c) if fo.is_float(c) else F.col(c).cast("long").alias(c) for c in own])
        return kept

    run.__name__ = f"profile_{name}"
    return query(f"with {fo.EVENTS}, {fo.MORE} select transaction_id, {local}{', ' + made if made else ''} from t")(run)


for _name in static.PROFILES:
    if _name != "device_location":  # that one is ``feature_profile``
        _profile(_name)


# --- splits and metrics on distinct values and wide rows ----------------------------


_DISTINCT = "sc as (select cast(event_type = 'purchase' as integer) as y, value + event_id * 1e-7 as s1, props from events)"


@query(f"""with {_DISTINCT}, k as (select y, row_number() over (order by s1) as r from sc)
select count(*) as n, cast(sum(y) as bigint) as positives, round((sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) as roc_auc from k""")
def roc_auc_distinct(spark, d):
    e = _read(spark, d, "events").select((F.col("event_type") == "purchase").cast("int").alias("y"), (F.col("value") + F.col("event_id") * 1e-7).alias("s1"), "props")
    return rounded(metrics.roc_auc(e, "y", "s1"), 9)


@query("""with n as (select count(*) as n from events), o as (select *, row_number() over (order by ts, event_id) - 1 as i from events),
f as (select n - cast(ceil(n * 0.2) as bigint) as first from n)
select event_id, user_id, event_type, value, props, case when i >= first then 'valid' when i >= first - 50 then 'gap' else 'train' end as split from o, f""")
def time_holdout_wide(spark, d):
    return splits.time_holdout(_read(spark, d, "events"), 0.2, ("ts", "event_id"), 50).drop("ts")


@query("""with n as (select count(*) as n from events), o as (select *, row_number() over (order by ts, event_id) - 1 as i from events),
f as (select n // 6 as size, n - 5 * (n // 6) as first from n)
select event_id, user_id, event_type, value, props, cast(case when i < first and first - i <= 20 then -2 when i < first then -1 else (i - first) // size end as integer) as __fold__ from o, f""")
def time_folds_wide(spark, d):
    return splits.time_folds(_read(spark, d, "events"), 5, ("ts", "event_id"), 20, mark=-2).drop("ts")


def _split_sql() -> str:
    n = "(select count(*) from events)"
    return f"""with f as (select unnest(range(3)) as f), k as (select event_type, count(*) as n from events group by 1)
select 'kfold' as kind, cast(f as integer) as __fold__, {n} // 3 + cast(f < {n} % 3 as bigint) as n from f
union all select 'stratified', cast(f as integer), cast(sum(n // 3 + cast(f < n % 3 as bigint)) as bigint) from k, f group by f
union all select 'time', f.f, case when f.f < 0 then {n} - 3 * ({n} // 4) else {n} // 4 end from (select unnest([-1, 0, 1, 2]) as f) f
union all select 'time_holdout', f.f, case when f.f < 0 then {n} - cast(ceil({n} * 0.2) as bigint) else cast(ceil({n} * 0.2) as bigint) end from (select unnest([-1, 0]) as f) f
union all select 'calendar_time', case {' '.join(f"when ts >= timestamp '{a}' and ts < timestamp '{b}' then {k}" for k, (a, b) in enumerate(EVENT_FOLDS))} else -1 end, count(*) from events group by 2
union all select 'group', 0, 0 union all select 'stratified_group', 0, 0"""


@query(_split_sql())
def make_splits(spark, d):
    """Rows of each fold by kind, from the dispatcher that checks them; of the group kinds the groups in more than one fold."""
    e = _read(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("timestamp"))
    parts = []
    for kind in splits.KINDS:
        label = "event_type" if kind == "stratified" else "_bought"
        own, _ = splits.make_splits(e.withColumn("_bought", (F.col("event_type") == "purchase").cast("int")), kind, ["event_id"], 3, label=label, group="user_id", bounds=EVENT_FOLDS)
        if "group" in kind:
            split = own.groupBy("user_id").agg(F.count_distinct("__fold__").alias("k")).filter("k > 1")
            parts.append(split.agg(F.lit(kind).alias("kind"), F.lit(0).alias("__fold__"), F.count(F.lit(1)).alias("n")))
        else:
            parts.append(own.groupBy(F.lit(kind).alias("kind"), "__fold__").agg(F.count(F.lit(1)).alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_CLASSES = {"view": "greatest(60 - value, 1)", "click": "greatest(value, 1)", "purchase": "greatest(value - 20, 1)", "error": "cast(10 as double)"}
_MULTI = "mc as (select event_type as y, " + ", ".join(f"{e} as w_{k}" for k, e in _CLASSES.items()) + " from events where event_type in ('" + "', '".join(_CLASSES) + "'))"


def _multi(spark, d):
    e = _read(spark, d, "events").filter(F.col("event_type").isin(*_CLASSES))
    return e.select(F.col("event_type").alias("y"), *[F.expr(x).alias(f"w_{k}") for k, x in _CLASSES.items()])


def _ovr_sql() -> str:
    one = " union all ".join(f"select '{k}' as k, w_{k} as s, cast(y = '{k}' as integer) as y from mc" for k in _CLASSES)
    return f"""with {_MULTI}, l as ({one}), r as (select k, y, rank() over (partition by k order by s) + (count(*) over (partition by k, s) - 1) / 2 as r from l),
a as (select k, (sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) as auc from r group by k)
select (select count(*) from mc) as n, round(avg(auc), {D}) as roc_auc from a"""


@query(_ovr_sql())
def roc_auc_multiclass(spark, d):
    return rounded(metrics.multiclass_roc_auc(_multi(spark, d), "y", {k: f"w_{k}" for k in _CLASSES}))


@query(f"with {_MULTI} select count(*) as n, round(avg(-ln(case y {' '.join(f"when '{k}' then w_{k}" for k in _CLASSES)} end / ({' + '.join(f'w_{k}' for k in _CLASSES)}))), {D}) as log_loss from mc")
def log_loss_multiclass(spark, d):
    return rounded(metrics.multiclass_log_loss(_multi(spark, d), "y", {k: f"w_{k}" for k in _CLASSES}))


@query(f"with {SCORED} select cast(user_id % 7 as bigint) as part, round(sum(abs(y - p)), 3) as score from sc group by 1")
def custom_metric(spark, d):
    """A user's own function of each group's columns."""
    rows = _scored(spark, d).withColumn("part", F.col("user_id") % 7)
    return rounded(metrics.custom(rows, lambda y, p: (y - p).abs().sum(), ["y", "p"], ["part"]), 3)


@query(f"""with {SCORED}, {OOF}, v as (select y, s1, __fold__ from oof where __fold__ >= 0), {_ap_sql('v', 's1', '__fold__')}
select count(*) as folds, round(avg(average_precision), 4) as mean, round(stddev_pop(average_precision), 4) as std from r""")
def fold_summary(spark, d):
    rows = _oof(spark, d, "s1").filter("__fold__ >= 0")
    scores = [r["average_precision"] for r in metrics.average_precision(rows, "y", "pred_0", by=("__fold__",)).collect()]
    mean, std = audit.mean_and_std(scores)
    return rounded(spark.createDataFrame([(len(scores), mean, std)], "folds long, mean double, std double"), 4)


# --- saved blends, records and verdicts -----------------------------------------------


@query(f"with {SCORED}, {OOF} select __row__, __fold__, round(case when __fold__ >= 0 then 0.4 * p + 0.6 * s1 end, {D}) as pred_0 from oof")
def saved_blend(spark, d):
    """Two saved tables, checked against their content hashes, blended and saved with their identity."""
    parts = []
    for score, weight in (("p", 0.4), ("s1", 0.6)):
        path = shared_path(spark, f"oof_{score}")
        tables.save_predictions(_oof(spark, d, score).drop("y"), path, [], {"score": score})
        parts.append((path, weight))
    return rounded(blend.blend_files(parts, shared_path(spark, "blend"), spark))


@query(f"""with {SCORED}, {OOF}, v as (select * from oof where __fold__ >= 0), r as (select __row__, {', '.join(f'(rank() over (order by {e}) + (count(*) over (partition by {e}) - 1) / 2) as {n}' for n, e in (('a', 'p'), ('b', 's1 / 1000'), ('c', '1 - p'), ('e', '1 - s1 / 1000')))} from v),
m as (select __row__, (a + b) / 2 as u, (c + e) / 2 as v from r)
select o.__row__, o.__fold__, round(u / (u + v) + {fo.NUDGE}, {D}) as pred_0, round(v / (u + v) + {fo.NUDGE}, {D}) as pred_1 from oof o left join m using (__row__)""")
def rank_average_classes(spark, d):
    """Two models' class probabilities as rank averages that add up to 1."""
    both = [_oof(spark, d, s).drop("y").withColumn("pred_0", F.col("pred_0") / k).withColumn("pred_1", 1 - F.col("pred_0")) for s, k in (("p", 1), ("s1", 1000))]
    return rounded(blend.rank_average_classes(both).withColumns({c: F.col(c) + fo.NUDGE for c in ("pred_0", "pred_1")}))


@query("select s_suppkey as experiment, s_nationkey as contract, s_acctbal as score, row_number() over (order by s_acctbal desc, s_suppkey) as place from supplier where s_nationkey = 3")
def experiment_ranking(spark, d):
    from pyspark.sql import Window

    records = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("experiment"), F.col("s_nationkey").alias("contract"), F.col("s_acctbal").alias("score"))
    best = blend.comparison(records, "3", "score")  # one contract's experiments, few rows
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "experiment")).cast("long"))


@query("""select s_suppkey as experiment, case when s_suppkey % 4 = 0 then s_acctbal + 1 else s_acctbal end as score, case when s_suppkey % 4 = 0 then 'again' end as note from supplier
union all select -1, 0.5, 'new'""")
def ledger_upsert(spark, d):
    records = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("experiment"), F.col("s_acctbal").alias("score"))
    again = records.filter("experiment % 4 = 0").select("experiment", (F.col("score") + 1).alias("score"), F.lit("again").alias("note"))
    return blend.upsert(records, again.unionByName(spark.createDataFrame([(-1, 0.5, "new")], "experiment long, score double, note string")))


@query(f"""with {SCORED}, w as (select *, unnest([{', '.join(f"case when timestamp >= timestamp '{a}' and timestamp < timestamp '{b}' then '{n}' end" for n, (a, b) in WINDOWS.items())}]) as win from sc),
v as (select y, s1, 401 - s2 as s3, win as "window" from w where win is not null), {_ap_sql('v', 's1', '"window"')}, {_ap_sql('v', 's3', '"window"').replace('g as (', 'g2 as (').replace('c as (select *', 'c2 as (select *').replace('from g)', 'from g2)').replace('r as (select', 'r2 as (select').replace('from c group', 'from c2 group')},
b as (select r."window", r.average_precision as first, r2.average_precision as second from r join r2 using ("window")),
z as (select *, second - first as delta from b)
select "window", first, second, round(delta, 3) as delta,
  case when (select min(delta) from z) >= -0.0005 and (select max(delta) from z) > 0.0005 then 'WIN' when (select max(delta) from z) <= 0.0005 and (select min(delta) from z) < -0.0005 then 'LOSE' else 'FLAT-MIXED' end as verdict from z""")
def window_verdict(spark, d):
    """Two models' scores by window, their differences and the verdict."""
    rows = _scored(spark, d).withColumn("s3", 401 - F.col("s2"))
    conditions = {n: (F.col("timestamp") >= _at(a)) & (F.col("timestamp") < _at(b)) for n, (a, b) in WINDOWS.items()}
    a, b = (metrics.windowed(rows, conditions, metrics.average_precision, "y", s) for s in ("s1", "s3"))
    out = blend.deltas(a, b, "average_precision")
    return out.select("window", *[F.round(c, k).alias(c) for c, k in (("first", D), ("second", D), ("delta", 3))], "verdict")


_REFERENCES = {"early": 0.25, "late": 0.15, "all": 0.3}


@query(f"""with {SCORED}, w as (select *, unnest([{', '.join(f"case when timestamp >= timestamp '{a}' and timestamp < timestamp '{b}' then '{n}' end" for n, (a, b) in WINDOWS.items())}]) as win from sc),
v as (select y, s1, win as "window" from w where win is not null), {_ap_sql('v', 's1', '"window"')},
k as (select * from (values {', '.join(f"('{w}', {x})" for w, x in _REFERENCES.items())}) t("window", reference))
select "window", average_precision as score, cast(reference as double) as reference, round(average_precision - reference, 3) as delta, average_precision - reference < -0.02 as failed from r join k using ("window")""")
def early_screen(spark, d):
    """Scores of windows against references given beforehand, and which of them stop an experiment."""
    conditions = {n: (F.col("timestamp") >= _at(a)) & (F.col("timestamp") < _at(b)) for n, (a, b) in WINDOWS.items()}
    out = metrics.early_screen(_scored(spark, d), "y", "s1", conditions, _REFERENCES, dict.fromkeys(_REFERENCES, 0.02))
    return out.select("window", F.round("score", D).alias("score"), "reference", F.round("delta", 3).alias("delta"), "failed")


@query(f"with {SCORED}, {OOF}, v as (select y, p, __fold__ from oof where __fold__ >= 0), {_ap_sql('v', 'p', '__fold__')} select __fold__, average_precision from r")
def replayed_scores(spark, d):
    """Scores of a saved table, recomputed after its content was verified and held against those stored."""
    path, oof = shared_path(spark, "replay"), _oof(spark, d, "p")
    tables.save_predictions(oof.drop("y"), path, [], {})
    stored = experiment.score_folds(oof.withColumnRenamed("y", "label"), "label")
    got = experiment.replay(spark, path, oof.select("__row__", F.col("y").alias("label")), "label", stored)
    return rounded(spark.createDataFrame([(int(k), v) for k, v in got.items()], "__fold__ int, average_precision double"))


# --- encodings and estimators -----------------------------------------------------------


@query("""select p_partkey, x.k as place, round(case when x.k = 0 then p_retailprice when x.k = rank then 1 else 0 end, 4) as value
from (select p_partkey, p_retailprice, dense_rank() over (order by p_type) as rank, (select count(distinct p_type) from part) as kinds from part), (select unnest(range(200)) as k) x where x.k <= kinds""")
def one_hot(spark, d):
    part = _read(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    model = Pipeline(stages=learning.encoding(["p_retailprice"], ["p_type"])).fit(part)
    out = model.transform(part).select("p_partkey", F.posexplode(vector_to_array("features")).alias("place", "value"))
    return out.select("p_partkey", F.col("place").cast("long").alias("place"), F.round("value", 4).alias("value"))


@query(f"""with w as (select p_partkey, unnest(regexp_extract_all(lower(p_name), '\\w\\w+')) as t from part), n as (select count(*) as n from part),
f as (select t, count(distinct p_partkey) as df from w group by t), c as (select p_partkey, t, count(*) as tf from w group by 1, 2),
v as (select p_partkey, tf * ln((n + 1) / (df + 1)) as x from c join f using (t), n), s as (select p_partkey, sqrt(sum(x * x)) as norm, max(x) as high, sum(x) as total, count(*) as words from v group by 1)
select p_partkey, words, round(high / norm, {D}) as high, round(total / norm, {D}) as total from s""")
def tfidf(spark, d):
    part = _read(spark, d, "part").select("p_partkey", "p_name")
    model = Pipeline(stages=learning.encoding([], text="p_name")).fit(part)
    a = model.transform(part).select("p_partkey", vector_to_array("features").alias("v"))
    one = a.select("p_partkey", F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("words"), F.array_max("v").alias("high"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"))
    return rounded(one)


_LINE = "l_extendedprice as y, l_quantity as x from lineitem"


@query("select l_orderkey, l_linenumber, round(l_quantity * (select regr_slope(l_extendedprice, l_quantity) from lineitem) + (select regr_intercept(l_extendedprice, l_quantity) from lineitem), 2) as pred_0 from lineitem")
def linear_regression(spark, d):
    line = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("label"))
    model = learning.build_pipeline("linear", ["l_quantity"]).fit(line)
    return learning.predict(model, line).select("l_orderkey", "l_linenumber", F.round("pred_0", 2).alias("pred_0"))


@query("""select 'l_quantity' as feature, round(regr_slope(l_extendedprice, l_quantity), 2) as importance from lineitem""")
def importances(spark, d):
    line = _read(spark, d, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    return rounded(learning.importances(learning.build_pipeline("linear", ["l_quantity"]).fit(line), line), 2)


@query(f"""with {_STARTS}, m as (select f, start, size, regr_slope(value, user_id) as slope, regr_intercept(value, user_id) as icept from o, f where i < start - 20 group by all)
select event_id, cast(coalesce(f, -1) as integer) as __fold__, round(icept + slope * user_id, 4) as pred_0 from o left join m on i >= start and i < start + size""")
def out_of_fold(spark, d):
    """Each fold predicted by a line through the rows before its gap; the gap's rows play no part."""
    e = _read(spark, d, "events").select("event_id", "ts", F.col("user_id").cast("double").alias("x"), F.col("value").alias("label"))
    folds = intervals.by_rows(e, 5, ("ts", "event_id"), 20)
    out = learning.out_of_fold(e, learning.build_pipeline("linear", ["x"]), folds)
    return rounded(out.select("event_id", "__fold__", "pred_0"), 4)


@query(" union all ".join(f"select '{k}' as kind, count(*) as n, cast(0 as bigint) as missing from part" for k in ("forest", "boosted", "forest_regressor", "boosted_regressor", "svm")))
def estimators(spark, d):
    """Every row gets a prediction from each estimator."""
    part = _read(spark, d, "part").select("p_size", "p_type", "p_retailprice", F.when(F.col("p_size") > 25, 1.0).otherwise(0.0).alias("label"))
    parts = []
    for kind in ("forest", "boosted", "forest_regressor", "boosted_regressor", "svm"):
        small = {"maxIter": 3} if kind != "forest" and kind != "forest_regressor" else {"numTrees": 3}
        model = learning.build_pipeline(kind, ["p_retailprice"], ["p_type"], **small).fit(part)
        parts.append(learning.predict(model, part).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred_0").isNull() | F.isnan("pred_0")).alias("missing")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_CERTIFIED = f"""with e as (select event_id, ts from events), n as (select count(*) as n, count(*) filter (ts < timestamp '{SPLIT}') as early from e)
{' union all '.join(f"select '{p}' as property, cast({x} as bigint) as rows, cast(0 as bigint) as differing from n" for p, x in zip(experiment.PROPERTIES, ("early", "1", "n", "n", "early", "n", "n - early"), strict=True))}"""


@query(_CERTIFIED)
def certification(spark, d):
    """The properties of a family on the events: how many rows were compared, and how many differ."""
    e = transactions.event_stream(spark, d).withColumn("fraud", F.coalesce((F.col("merchant_category") == "purchase").cast("int"), F.lit(0)))
    return experiment.certify_table(e, "customer_merchant", SPLIT)


@query(f"with {SCORED}, v as (select y, s1, cast(user_id % 7 as bigint) as part from sc), {_ap_sql('v', 's1', 'part')} select part, average_precision as score from r")
def mergeable_metric(spark, d):
    """Average precision as a user's own aggregate: states of map tasks that merge."""
    from tidemark.operators.mergeable import BinnedPrecision

    rows = _scored(spark, d).select("y", F.col("s1").cast("double").alias("s1"), (F.col("user_id") % 7).alias("part"))
    return rounded(metrics.custom(rows, BinnedPrecision(100_000, 0.0, 100_000.0), ["y", "s1"], ["part"]))


@query("""select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net, l_shipdate > timestamp '1996-01-01' as late from lineitem""")
def matrix_parts(spark, d):
    """Row-local columns from a cache of parts: a second call finds all of them by the digests of its files."""
    from tidemark.sources.matrix import cached

    path = shared_path(spark, "matrix")
    _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate").repartition(5).write.parquet(f"{path}/in")
    make = lambda df: df.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"), (F.col("l_shipdate") > _at("1996-01-01")).alias("late"))
    _, first = cached(spark, f"{path}/in", {"net": 1}, make, f"{path}/made", 8)
    out, second = cached(spark, f"{path}/in", {"net": 1}, make, f"{path}/made", 8)
    if not first or second:
        raise RuntimeError("the cache didn't find what it had made")
    return out


@query("select s_nationkey, count(*) as n, cast(1 as bigint) as ones from supplier group by 1")
def one_hot_columns(spark, d):
    """A column of 0 and 1 for each nation of the suppliers; every row has one of them."""
    s = _read(spark, d, "supplier").select("s_nationkey")
    model = learning.OneHotColumns(["s_nationkey"], 5_000).fit(s)
    hot = model.transform(s)
    total = sum((F.col(c) for c in model.names), F.lit(0.0))
    return hot.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max(total).cast("long").alias("ones"))


@query(f"with {fo.ORDER_LINES}, {fo.MORE} select transaction_id, us, {', '.join(fo.rounded(c, e, D) for c, e in fo.FAMILY_SQL['merchant_amount'].items())} from t")
def heavy_key_features(spark, d):
    """A family for which every merchant of more than 100 rows is read chunk by chunk."""
    rows = transactions.order_lines(spark, d).select("transaction_id", "customer_id", "merchant_id", "amount", "timestamp")
    out = history.features(rows, ["merchant_amount"], split_over=100)
    cols = list(fo.FAMILY_SQL["merchant_amount"])
    return out.select("transaction_id", event_us(F.col("timestamp")).alias("us"), *[F.round(F.col(c) + fo.NUDGE, fo.digits_of(c, D)).alias(c) if fo.is_float(c) else F.col(c).cast("long").alias(c) for c in cols])
