"""The history families as DuckDB SQL, column by column, for the oracle."""

from __future__ import annotations

H, D = 3_600_000_000, 86_400_000_000

ORDER_LINES = """base as (select l_orderkey * 10 + l_linenumber as transaction_id, coalesce(cast(o_custkey as varchar), '?c') as c, coalesce(cast(l_suppkey as varchar), '?m') as m,
 coalesce(case when l_partkey % 50 <> 0 then cast(l_partkey as varchar) end, '?d') as d, coalesce(case when p_brand <> 'Brand#13' then p_brand end, '?g') as g,
 coalesce(case when s_nationkey <> 7 then cast(s_nationkey as varchar) end, '?l') as l, l_extendedprice as x, ln(1 + l_extendedprice) as y,
 epoch_us(l_shipdate) as us, cast(l_linenumber * 7 as bigint) as age
 from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)"""
EVENTS = """ev as (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events),
base as (select event_id as transaction_id, cast(user_id as varchar) as c, cast(k % 23 as varchar) as m,
 coalesce(case when k % 17 <> 0 then cast(k % 17 as varchar) end, '?d') as d, coalesce(case when event_type <> 'error' then event_type end, '?g') as g,
 coalesce(case when k % 5 <> 0 then cast(k % 5 as varchar) end, '?l') as l, value as x, ln(1 + value) as y, epoch_us(ts) as us, k as age from ev)"""

MORE = """t as (select *, cast(floor(us / {D}) as bigint) as day, least(cast(floor((us % {D}) / {H}) as bigint) // 6, 3) as part, (cast(floor(us / {D}) as bigint) + 3) % 7 as wday,
 cast(floor(us / {D}) as bigint) - age as born,
 case when row_number() over (partition by d, c order by us) = 1 then 1 else 0 end as new_dc,
 case when row_number() over (partition by m, c order by us) = 1 then 1 else 0 end as new_mc from base)""".replace("{D}", str(D)).replace("{H}", str(H))


def P(*k: str) -> str:
    return f"over (partition by {', '.join(k)} order by us range between unbounded preceding and 1 preceding)"


def R(width: int, *k: str, until: int = 0) -> str:
    return f"over (partition by {', '.join(k)} order by us range between {width} preceding and {until + 1} preceding)"


def n(w: str) -> str:
    return f"count(*) {w}"


def since(w: str, when: str = "us") -> str:
    return f"(us - max({when}) {w}) / 1e6"


def share(a: str, b: str, empty: str = "null") -> str:
    return f"coalesce(({a}) / nullif({b}, 0), {empty})"


def amounts(k: str, p: str) -> dict[str, str]:
    w = P(k)
    return {
        f"{p}_prior_mean_amount": f"avg(x) {w}", f"{p}_prior_mean_log_amount": f"avg(y) {w}", f"{p}_prior_std_log_amount": f"stddev_pop(y) {w}",
        f"{p}_amount_to_prior_mean": f"x / (avg(x) {w} + 1)",
        f"{p}_log_amount_zscore": f"case when {n(w)} >= 5 then (y - avg(y) {w}) / greatest(stddev_pop(y) {w}, 0.1) end",
    }


def pair(a: str, b: str, p: str, empty: str, new: str | None, recency: bool) -> dict[str, str]:
    w = P(a, b)
    out = {f"{p}_prior_count": n(w)}
    if new:
        out[f"{p}_{new}"] = f"cast({n(w)} = 0 as integer)"
    if recency:
        out[f"{p}_seconds_since_last"] = since(w)
    return out | {f"{p}_count_share": share(n(w), n(P(a)), empty)}


def broad(k: str, p: str) -> dict[str, str]:
    return {f"{p}_prior_1h_count": n(R(H, k)), f"{p}_prior_24h_count": n(R(D, k)), f"{p}_prior_7d_count": n(R(7 * D, k)), f"{p}_1h_vs_7d_rate_ratio": f"({n(R(H, k))} + 1) / ({n(R(7 * D, k))} / 168 + 1)"}


def _new(flag: str, k: str, p: str, s: str, widths, base) -> dict[str, str]:
    out = {}
    for name, width in widths:
        w = R(width - 1, k)
        out[f"{p}_{name}"] = f"coalesce(sum({flag}) {w}, 0)"
        out[f"{s}_{name}"] = share(f"coalesce(sum({flag}) {w}, 0)", base(w), "0")
    return out



FAMILY_SQL: dict[str, dict[str, str]] = {
    "customer_history": {
        "customer_prior_count": n(P("c")), "customer_first_seen": f"cast({n(P('c'))} = 0 as integer)", "customer_seconds_since_last": since(P("c")),
        "customer_observed_age_seconds": f"(us - min(us) {P('c')}) / 1e6", **amounts("c", "customer"), "customer_log_amount_minus_prior_mean": f"y - avg(y) {P('c')}",
    },
    "customer_device": pair("c", "d", "customer_device", "null", "new", True),
    "customer_location": pair("c", "l", "customer_location", "null", "new", True),
    "device_global": {
        "device_prior_count": n(P("d")), "device_prior_distinct_customer_count": f"count(distinct c) {P('d')}",
        "device_prior_distinct_customer_count_excluding_current": f"count(distinct c) {P('d')} - cast({n(P('d', 'c'))} > 0 as integer)",
        "device_seconds_since_last": since(P("d")), "device_observed_age_seconds": f"(us - min(us) {P('d')}) / 1e6",
        "device_prior_other_customer_transaction_count": f"{n(P('d'))} - {n(P('d', 'c'))}",
        "customer_share_of_device_prior_transactions": share(n(P("d", "c")), n(P("d"))),
    },
    "customer_velocity_1h": {"customer_prior_1h_count": n(R(H, "c"))},
    "device_velocity_1h": {"device_prior_1h_count": n(R(H, "d"))},
    "customer_velocity": broad("c", "customer"),
    "device_velocity": broad("d", "device"),
    "amount_30d": {
        "customer_30d_count": n(R(30 * D, "c")), "customer_30d_mean_amount": f"avg(x) {R(30 * D, 'c')}", "customer_30d_mean_log_amount": f"avg(y) {R(30 * D, 'c')}",
        "customer_amount_to_30d_mean": f"x / (avg(x) {R(30 * D, 'c')} + 1)", "customer_log_amount_minus_30d_mean": f"y - avg(y) {R(30 * D, 'c')}",
        "customer_30d_to_lifetime_mean_ratio": f"(avg(x) {R(30 * D, 'c')} + 1) / (avg(x) {P('c')} + 1)",
    },
    "customer_merchant": pair("c", "m", "customer_merchant", "0", "is_new", True),
    "customer_category": pair("c", "g", "customer_category", "0", "is_new", True),
    "merchant_history": {
        "merchant_prior_transaction_count": n(P("m")), "merchant_seconds_since_last": since(P("m")), "merchant_prior_unique_customers": f"count(distinct c) {P('m')}",
        "merchant_transactions_24h": n(R(D, "m")), "merchant_unique_customers_24h": f"count(distinct c) {R(D, 'm')}",
    },
    "device_sharing": {
        **{f"device_unique_customers_{s}": f"count(distinct c) {R(w, 'd')}" for s, w in (("24h", D), ("7d", 7 * D))},
        **{f"device_other_customers_{s}": f"count(distinct c) {R(w, 'd')} - cast({n(R(w, 'd', 'c'))} > 0 as integer)" for s, w in (("24h", D), ("7d", 7 * D))},
        "device_7d_unique_to_lifetime_unique_ratio": f"count(distinct c) {R(7 * D, 'd')} / greatest(count(distinct c) {P('d')}, 1)",
    },
    "merchant_amount": amounts("m", "merchant"),
    "customer_new_merchants": {
        **_new("new_mc", "c", "customer_new_merchants", "customer_new_merchant_share", (("7d", 7 * D), ("30d", 30 * D)), n),
        "customer_seconds_since_last_new_merchant": since(P("c"), "case when new_mc = 1 then us end"),
    },
    "merchant_new_customers": {
        **_new("new_mc", "m", "merchant_new_customers", "merchant_new_customer_share", (("24h", D), ("7d", 7 * D)), lambda w: f"count(distinct c) {w}"),
        "merchant_seconds_since_last_new_customer": since(P("m"), "case when new_mc = 1 then us end"),
    },
    "device_location": pair("d", "l", "device_location", "null", "is_new", True),
    "temporal_habits": {"customer_daypart_share": share(n(P("c", "part")), n(P("c")), "0"), "customer_weekday_share": share(n(P("c", "wday")), n(P("c")), "0")},
    "device_merchant": pair("d", "m", "device_merchant", "0", None, False),
    "merchant_location": pair("m", "l", "merchant_location", "0", None, False),
    "merchant_acceleration": {"merchant_transactions_1h": n(R(H, "m")), "merchant_log_rate_change_1h_vs_previous_1h": f"ln(1 + {n(R(H, 'm'))}) - ln(1 + {n(R(2 * H, 'm', until=H))})"},
    "account_consistency": {
        "customer_creation_day_deviation": "case when md is null then 0 else born + md.day end", "customer_creation_day_abs_deviation": "abs(case when md is null then 0 else born + md.day end)",
        "customer_creation_day_mode_share": f"case when md is null then 0 else md.n / {n(P('c'))} end",
    },
}


def _extra(name: str) -> tuple[str, str]:
    if name != "account_consistency":
        return "", "t"
    upto = "count(*) over (partition by c, born order by us range between unbounded preceding and current row)"
    return f", u as (select *, {upto} as upto from t), v as (select *, max({{'n': upto, 'day': -born}}) {P('c')} as md from u)", "v"


def family_sql(name: str, view: str, digits: int = 5) -> str:
    extra, source = _extra(name)
    cols = ", ".join(rounded(c, e, digits) for c, e in FAMILY_SQL[name].items())
    return f"with {view}, {MORE}{extra} select transaction_id, c as customer_key, us, {cols} from {source}"


def is_float(name: str) -> bool:
    return any(w in name for w in ("seconds", "mean", "share", "ratio", "std", "zscore", "log", "_transactions")) and "transactions_" not in name and not name.endswith("transaction_count")


def digits_of(name: str, digits: int = 5) -> int:
    """Whole microseconds stay as they are; sums of amounts carry most of the noise of addition."""
    return 6 if "seconds" in name else 3 if "mean_amount" in name else digits


#: Added before rounding, so that a value halfway between two roundings isn't left to the last bit of a sum.
NUDGE = 1e-7


def rounded(name: str, expr: str, digits: int) -> str:
    return f"round({expr} + {NUDGE}, {digits_of(name, digits)}) as {name}" if is_float(name) else f"cast({expr} as bigint) as {name}"
