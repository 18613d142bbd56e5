"""Row-local columns of a transaction table, and the closed feature profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.history import FAMILIES, features

STATIC_NUMBERS = ("amount", "log_amount", "hour", "weekday", "is_weekend", "merchant_category_missing", "device_type_missing", "location_missing", "account_age_days")


def add_static(df: DataFrame, time: str = "timestamp", amount: str = "amount") -> DataFrame:
    """``log_amount, hour, weekday`` (Monday 0), ``is_weekend`` and flags of missing categories."""
    day = F.weekday(F.col(time))
    return df.withColumns({
        "log_amount": F.log1p(F.col(amount)),
        "hour": F.hour(F.col(time)),
        "weekday": day,
        "is_weekend": (day >= 5).cast("int"),
        **{f"{c}_missing": F.col(c).isNull().cast("int") for c in ("merchant_category", "device_type", "location")},
    })


def add_row_features(df: DataFrame, name: str = "Name", siblings: str = "SibSp", parents: str = "Parch") -> DataFrame:
    """``FamilySize, IsAlone, Title`` of a passenger-like table, for the columns that it has."""
    out, have = df, set(df.columns)
    if {siblings, parents} <= have:
        size = F.col(siblings) + F.col(parents) + 1
        out = out.withColumns({"FamilySize": size, "IsAlone": (size == 1).cast("int")})
    if name in have:
        pattern = r",\s*([^.]*)\."  # fixed value: the title stands between comma and full stop
        out = out.withColumn("Title", F.when(F.col(name).rlike(pattern), F.regexp_extract(name, pattern, 1)))
    return out


def clean_category(c: Column) -> Column:
    return c.cast("string")


def clean_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def brief(c: Column, limit: int = 180) -> Column:
    """One line for a report cell."""
    return F.substring(F.regexp_replace(F.regexp_replace(c.cast("string"), r"[\r\n]+", " "), r"\|", "/"), 1, limit)


def nested_text(df: DataFrame) -> DataFrame:
    """Struct, map and array columns as JSON text."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "map", "array")]
    return df.withColumns({n: F.to_json(F.col(n)) for n in nested}) if nested else df


# The named profiles. Each adds families to the one before it.
_BASE = ("customer_history", "customer_device", "customer_location", "device_global", "customer_velocity_1h", "device_velocity_1h")
_PAIRS = (*_BASE, "customer_merchant")
_HISTORY = (*_PAIRS, "merchant_history")
PROFILES: dict[str, tuple[str, ...]] = {
    "static": (),
    "customer_history": _BASE[:1],
    "relationships": _BASE[:3],
    "device_global": _BASE[:4],
    "velocity": _BASE,
    "broad_velocity": (*_BASE[:4], "customer_velocity", "device_velocity"),
    "merchant_onehot": _BASE,  # with the merchant itself as a category
    "amount_30d": (*_BASE, "amount_30d"),
    "customer_merchant": _PAIRS,
    "customer_category": (*_PAIRS, "customer_category"),
    "device_sharing": (*_PAIRS, "device_sharing"),
    "merchant_history": _HISTORY,
    "merchant_amount": (*_HISTORY, "merchant_amount"),
    "customer_new_merchants": (*_HISTORY, "customer_new_merchants"),
    "merchant_new_customers": (*_HISTORY, "merchant_new_customers"),
    "device_location": (*_HISTORY, "device_location"),
    "everything": tuple(f for f in FAMILIES if f not in ("customer_velocity_1h", "device_velocity_1h")),
}
FORBIDDEN = ("transaction_id", "customer_id", "merchant_id", "device_id", "timestamp")
MAX_CATEGORIES = 64
#: Ids that a profile may have among its categories, and how many values they may have.
ALLOWED = {"merchant_onehot": {"merchant_id": 5_000}}


def add_profile(df: DataFrame, profile: str, **how) -> DataFrame:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    out = add_static(df)
    return features(out, PROFILES[profile], **how) if PROFILES[profile] else out


def check_profile(df: DataFrame, feature_columns: Sequence[str], categories: Sequence[str] = (), target: str | None = None, limit: int = MAX_CATEGORIES, profile: str | None = None) -> None:
    """Raises for ids, times or the target among the features, and for categories with too many values (null counts)."""
    allowed = ALLOWED.get(profile, {})
    bad = [c for c in feature_columns if (c in FORBIDDEN and c not in allowed) or c == target]
    if bad:
        raise ValueError(f"not allowed as features: {sorted(bad)}")
    if categories:
        counts = df.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in categories]).first()
        if many := {c: counts[c] for c in categories if (counts[c] or 0) > allowed.get(c, limit)}:
            raise ValueError(f"more than {limit} values: {many}")


def training_frame(df: DataFrame, target: str, categories: Sequence[str] = (), profile: str | None = None) -> DataFrame:
    """The columns to learn from and the target: ids and times are left out (but those that the profile allows), and the rest is checked."""
    if target not in df.columns:
        raise ValueError(f"no column {target}")
    allowed = [c for c in ALLOWED.get(profile, {}) if c in df.columns]
    columns = [c for c in df.columns if (c not in FORBIDDEN or c in allowed) and c != target]
    check_profile(df, columns, [*categories, *[c for c in allowed if c not in categories]], target, profile=profile)
    return df.select(*columns, target)


def assert_superset(parent: DataFrame, child: DataFrame) -> None:
    """The child's columns are the parent's, in order, and what was added after them."""
    if child.columns[: len(parent.columns)] != parent.columns:
        raise ValueError("the parent's columns must come first and unchanged")
