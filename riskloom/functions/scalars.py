"""Column functions of the domain."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.contract import CARD_KEY_COLUMNS, VELOCITY_FILLS

#: 2017-12-01T00:00:00Z, from which transaction offsets count.
EPOCH_S = 1_512_086_400


def finite(x: Column) -> Column:
    """NaN and the infinities become null, the one missing value in here."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def to_event_timestamp(dt: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH_S) + dt.cast("bigint"))


def make_card_id(columns: Sequence[str | Column] = CARD_KEY_COLUMNS) -> Column:
    """Whole numbers joined by ``_``, missing ones as ``na``; a fractional value fails the query."""

    def part(c: str | Column) -> Column:
        x = (F.col(c) if isinstance(c, str) else c).cast("double")
        whole = F.when(x == F.floor(x), x.cast("bigint").cast("string"))
        return F.when(x.isNull() | F.isnan(x), F.lit("na")).otherwise(F.coalesce(whole, F.raise_error(F.lit("fractional card key")).cast("string")))

    return F.concat_ws("_", *[part(c) for c in columns])


def add_keys_and_timestamp(df: DataFrame, dt: str = "TransactionDT") -> DataFrame:
    return df.withColumns({"card_id": make_card_id(), "event_timestamp": to_event_timestamp(F.col(dt))})


def amount_log(a: Column) -> Column:
    return F.log1p(a)


def amount_to_mean_ratio(a: Column, mean: Column) -> Column:
    """a / mean; 1 where either is missing or not a number, or the mean is 0."""
    num = lambda x: finite(x.cast("string").try_cast("double"))
    return F.coalesce(num(a) / F.nullif(num(mean), F.lit(0.0)), F.lit(1.0))


def coerce_numeric(x: Column) -> Column:
    """To float; what doesn't parse, overflows or isn't finite is null."""
    return finite(x.cast("string").try_cast("float"))


def fill_missing_velocity(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(F.col(c).cast("float")), F.lit(v).cast("float")) for c, v in VELOCITY_FILLS.items() if c in df.columns})


def number_key(x: Column) -> Column:
    """The key spelling of a numeric category: whole numbers without a fraction, others as they are spelt; null stays null."""
    whole = (x == F.floor(x)) & (F.abs(x) < 2.0**63)
    return F.when(whole, x.cast("decimal(20,0)").cast("string")).otherwise(x.cast("string"))


def text_key(x: Column) -> Column:
    """The same for text, so that ``13.0`` sent as text meets 13."""
    n = x.try_cast("double")
    return F.when(x.rlike(r"^[+-]?[0-9]+\.0+$") & (F.abs(n) < 2.0**63), F.regexp_replace(F.regexp_replace(x, r"\.0+$", ""), r"^\+", "")).otherwise(x)


def reindex_map(m: Column, names: Sequence[str]) -> list[Column]:
    """One column for each name; absent keys are null, other keys are dropped."""
    return [F.try_element_at(m, F.lit(n)).alias(n) for n in names]


def finite_values(m: Column) -> Column:
    return F.transform_values(m, lambda _, v: finite(v))


def safe_ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0 or missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def event_time_seconds(published: Column, now: Column, clock: Column, skew_s: float) -> Column:
    """Publish time; the join clock where it is missing or more than ``skew_s`` ahead."""
    return F.when(published.isNull() | (published > now + F.lit(skew_s)), clock).otherwise(published)


def hash_u32(seed: int, *ids: Column) -> Column:
    """Uniform 32 bits of a seed and ids, the same in any engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_u32_sql(seed: int, *ids: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {' || chr(58) || '.join(f'{i}::VARCHAR' for i in ids)}), 1, 8))::BIGINT"


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def safe_float(text: Column) -> Column:
    """A text as a number; null if it doesn't parse or isn't finite."""
    return finite(text.try_cast("double"))


def six_decimals(x: Column) -> Column:
    """A value as a tag keeps it; a model is served with what its tag says."""
    return F.format_string("%.6f", x)


def backoff_column(attempt: Column, base: float = 0.5, cap: float = 30.0) -> Column:
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))


def backoff_s(attempt: int, base: float = 0.5, cap: float = 30.0, jitter: float = 0.0) -> float:
    """Capped exponential delay before a retry, plus a share of jitter."""
    return min(cap, base * 2**attempt) * (1 + jitter)
