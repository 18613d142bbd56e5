"""The history families computed row by row in plain Python, for small tables."""

import math
import statistics

from tidemark.functions.windows import DAY, HOUR


def brute(rows):
    """``rows``: dicts of us, c, d, m, g, l, x and born. A list of all columns of each row."""
    return [_row(r, [p for p in rows if p["us"] < r["us"]]) for r in rows]


def _row(r, past):
    t, out = r["us"], {}
    of = lambda *keys: [p for p in past if all(p[k] == r[k] for k in keys)]
    within = lambda rows, width, open_left=False, until=0: [p for p in rows if (p["us"] > t - width if open_left else p["us"] >= t - width) and p["us"] < t - until]
    ago = lambda rows: (t - max(p["us"] for p in rows)) / 1e6 if rows else None
    age = lambda rows: (t - min(p["us"] for p in rows)) / 1e6 if rows else None
    mean = lambda v: math.fsum(v) / len(v) if v else None
    y = math.log1p(r["x"])
    c, d, m = of("c"), of("d"), of("m")

    def amounts(p, rows):
        avg, logs = mean([q["x"] for q in rows]), [math.log1p(q["x"]) for q in rows]
        std = statistics.pstdev(logs) if logs else None
        out.update({
            f"{p}_prior_mean_amount": avg, f"{p}_prior_mean_log_amount": mean(logs), f"{p}_prior_std_log_amount": std,
            f"{p}_amount_to_prior_mean": r["x"] / (avg + 1) if rows else None,
            f"{p}_log_amount_zscore": (y - mean(logs)) / max(std, 0.1) if len(rows) >= 5 else None,
        })

    out.update(customer_prior_count=len(c), customer_first_seen=int(not c), customer_seconds_since_last=ago(c), customer_observed_age_seconds=age(c))
    amounts("customer", c)
    out["customer_log_amount_minus_prior_mean"] = y - mean([math.log1p(q["x"]) for q in c]) if c else None
    amounts("merchant", m)

    for name, keys, new, recency, empty in (
        ("customer_device", "cd", "new", True, None), ("customer_location", "cl", "new", True, None), ("customer_merchant", "cm", "is_new", True, 0.0),
        ("customer_category", "cg", "is_new", True, 0.0), ("device_location", "dl", "is_new", True, None), ("device_merchant", "dm", None, False, 0.0), ("merchant_location", "ml", None, False, 0.0),
    ):
        own, whole = of(*keys), of(keys[0])
        out[f"{name}_prior_count"] = len(own)
        out[f"{name}_count_share"] = len(own) / len(whole) if whole else empty
        if new:
            out[f"{name}_{new}"] = int(not own)
        if recency:
            out[f"{name}_seconds_since_last"] = ago(own)

    people, own = {p["c"] for p in d}, of("d", "c")
    out.update(
        device_prior_count=len(d), device_prior_distinct_customer_count=len(people), device_prior_distinct_customer_count_excluding_current=len(people - {r["c"]}),
        device_seconds_since_last=ago(d), device_observed_age_seconds=age(d), device_prior_other_customer_transaction_count=len(d) - len(own),
        customer_share_of_device_prior_transactions=len(own) / len(d) if d else None,
    )
    for p, rows in (("customer", c), ("device", d)):
        hour, day, week = (len(within(rows, w)) for w in (HOUR, DAY, 7 * DAY))
        out.update({f"{p}_prior_1h_count": hour, f"{p}_prior_24h_count": day, f"{p}_prior_7d_count": week, f"{p}_1h_vs_7d_rate_ratio": (hour + 1) / (week / 168 + 1)})
    month = within(c, 30 * DAY)
    avg, logs = mean([q["x"] for q in month]), mean([math.log1p(q["x"]) for q in month])
    out.update(
        customer_30d_count=len(month), customer_30d_mean_amount=avg, customer_30d_mean_log_amount=logs, customer_amount_to_30d_mean=r["x"] / (avg + 1) if month else None,
        customer_log_amount_minus_30d_mean=y - logs if month else None, customer_30d_to_lifetime_mean_ratio=(avg + 1) / (mean([q["x"] for q in c]) + 1) if month else None,
    )
    day = within(m, DAY)
    out.update(
        merchant_prior_transaction_count=len(m), merchant_seconds_since_last=ago(m), merchant_prior_unique_customers=len({p["c"] for p in m}),
        merchant_transactions_24h=len(day), merchant_unique_customers_24h=len({p["c"] for p in day}),
    )
    for name, width in (("24h", DAY), ("7d", 7 * DAY)):
        kinds = {p["c"] for p in within(d, width)}
        out.update({f"device_unique_customers_{name}": len(kinds), f"device_other_customers_{name}": len(kinds - {r["c"]})})
    out["device_7d_unique_to_lifetime_unique_ratio"] = out["device_unique_customers_7d"] / max(len(people), 1)

    def firsts(rows, key):
        """Of each value of ``key`` one of its earliest rows."""
        seen = {}
        for p in rows:
            if p[key] not in seen or p["us"] < seen[p[key]]["us"]:
                seen[p[key]] = p
        return list(seen.values())

    new = firsts(c, "m")
    for name, width in (("7d", 7 * DAY), ("30d", 30 * DAY)):
        some, rows = within(new, width, True), within(c, width, True)
        out.update({f"customer_new_merchants_{name}": len(some), f"customer_new_merchant_share_{name}": len(some) / len(rows) if rows else 0.0})
    out["customer_seconds_since_last_new_merchant"] = ago(new)
    new = firsts(m, "c")
    for name, width in (("24h", DAY), ("7d", 7 * DAY)):
        some, kinds = within(new, width, True), {p["c"] for p in within(m, width, True)}
        out.update({f"merchant_new_customers_{name}": len(some), f"merchant_new_customer_share_{name}": len(some) / len(kinds) if kinds else 0.0})
    out["merchant_seconds_since_last_new_customer"] = ago(new)

    part = lambda p: min(p["us"] % DAY // HOUR // 6, 3)
    weekday = lambda p: (p["us"] // DAY + 3) % 7
    for name, of_row in (("daypart", part), ("weekday", weekday)):
        out[f"customer_{name}_share"] = sum(of_row(p) == of_row(r) for p in c) / len(c) if c else 0.0
    a, b = len(within(m, HOUR)), len(within(m, 2 * HOUR, until=HOUR))
    out.update(merchant_transactions_1h=a, merchant_log_rate_change_1h_vs_previous_1h=math.log1p(a) - math.log1p(b))
    days = [p["born"] for p in c if p["born"] is not None]
    off, part_of = 0, 0.0
    if days and r["born"] is not None:
        usual = min(set(days), key=lambda k: (-days.count(k), k))
        off, part_of = r["born"] - usual, days.count(usual) / len(c)
    out.update(customer_creation_day_deviation=off, customer_creation_day_abs_deviation=abs(off), customer_creation_day_mode_share=part_of)
    return out
