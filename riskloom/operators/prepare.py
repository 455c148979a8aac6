"""Validation, cleaning, splitting and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.contract import LABEL, NUMERIC_COLUMNS, require_columns
from riskloom.functions.ordering import ranked
from riskloom.functions.scalars import hash_u32

# -- Constraints


def validation_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, failures``: rows for which each condition isn't true, all counted in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("failures")) for n in rules])).alias("x")).select("x.*")


#: Pinned columns of raw transactions: type, whether it may be missing. Other columns may be there.
TRANSACTION_COLUMNS = {
    "TransactionID": ("bigint", False), LABEL: ("bigint", False), "TransactionDT": ("bigint", False), "TransactionAmt": ("double", False), "ProductCD": ("string", False),
    "card4": ("string", True), "card6": ("string", True), "C1": ("double", True), "C14": ("double", True), "D1": ("double", True), "D15": ("double", True),
    "dist1": ("double", True), "dist2": ("double", True), "addr1": ("double", True), "addr2": ("double", True),
}
IDENTITY_COLUMNS = {"TransactionID": ("bigint", False)}


def transaction_rules() -> dict[str, Column]:
    """Conditions on values, of coerced columns."""
    c = F.col
    return {
        "id_not_negative": c("TransactionID") >= 0, "label_binary": c(LABEL).isin(0, 1), "time_positive": c("TransactionDT") > 0,
        "amount_positive": c("TransactionAmt") > 0, "product_known": c("ProductCD").isin("W", "H", "C", "S", "R"),
    }


def identity_rules() -> dict[str, Column]:
    return {"id_not_negative": F.col("TransactionID") >= 0}


def coerced(df: DataFrame, columns: dict[str, tuple[str, bool]]) -> DataFrame:
    """The pinned columns cast to their types; what doesn't parse is null, NaN too."""
    out = {}
    for c, (kind, _) in columns.items():
        x = F.col(c).try_cast(kind)
        out[c] = F.when(~F.isnan(x), x) if kind == "double" else x
    return df.withColumns(out)


def schema_report(df: DataFrame, columns: dict[str, tuple[str, bool]], rules: dict[str, Column], key: str) -> DataFrame:
    """``rule, failures`` of every check, all collected: pinned columns that are absent, values that don't fit their type, missing
    values where none may be, the ``rules`` on coerced values (a missing value fails its null check only), and repeated keys.
    """
    absent = [c for c in columns if c not in df.columns]
    if absent:
        return df.sparkSession.createDataFrame([(f"column:{c}", 1) for c in absent], "rule string, failures bigint")
    raw = [F.col(c).alias(f"__raw_{c}") for c in columns]
    both = coerced(df.select("*", *raw), columns)
    checks = {f"type:{c}": F.col(f"__raw_{c}").isNull() | F.col(c).isNotNull() | (F.col(f"__raw_{c}").cast("string") == "NaN") for c in columns}
    checks |= {f"null:{c}": F.col(c).isNotNull() for c, (_, nullable) in columns.items() if not nullable}
    checks |= {name: F.coalesce(ok, F.lit(True)) for name, ok in rules.items()}
    repeated = duplicate_keys(coerced(df, columns).where(F.col(key).isNotNull()), key).agg(F.lit(f"unique:{key}").alias("rule"), F.coalesce(F.sum("copies"), F.lit(0)).alias("failures"))
    return validation_report(both, checks).union(repeated)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """``key, copies`` of keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def label_rate_gate(df: DataFrame, label: str, low: float = 0.005, high: float = 0.15) -> DataFrame:
    """``rate, passed``: the mean label, and whether it lies in the closed band."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("rate")).select("rate", F.coalesce(F.col("rate").between(low, high), F.lit(False)).alias("passed"))


def require_unique(df: DataFrame, key: str, side: str) -> None:
    found = [r[0] for r in duplicate_keys(df, key).limit(5).collect()]
    if found:
        raise ValueError(f"{side}: {key} is not unique, for example {found}")


def merge_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that keeps every left row; ValueError if a key repeats on either side."""
    require_unique(left, key, "left")
    require_unique(right, key, "right")
    return left.join(right, key, "left")


def downcast(df: DataFrame) -> DataFrame:
    """Doubles to float, longs to the smallest integer type that holds the column's values (one pass to find out)."""
    longs = [f.name for f in df.schema if isinstance(f.dataType, T.LongType)]
    casts = {f.name: F.col(f.name).cast("float") for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    if longs:
        span = df.agg(*[F.min(c).alias(f"a_{c}") for c in longs], *[F.max(c).alias(f"b_{c}") for c in longs]).first()
        for c in longs:
            lo, hi = span[f"a_{c}"] or 0, span[f"b_{c}"] or 0
            kind = next((k for k, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)) if -(1 << bits) <= lo and hi < 1 << bits), None)
            if kind:
                casts[c] = F.col(c).cast(kind)
    return df.withColumns(casts)


def select_contract(df: DataFrame, columns: Sequence[str], label: str = LABEL) -> DataFrame:
    """The contract's columns in order, and the label as a small integer; KeyError names missing ones."""
    require_columns(df, [*columns, label])
    return df.select(*columns, F.col(label).cast("tinyint"))


def input_example(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows in order of a key: what a model's input looks like."""
    return df.orderBy(order).limit(n)


def append_columns(df: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """Join by key; ValueError if any other column is on both sides."""
    both = (set(df.columns) & set(other.columns)) - {key}
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")
    return df.join(other, key)


def event_reason(amount: Column, transaction_id: Column, card_id: Column, corrupt: Column, payload: Column, v: Column | None = None, categorical: Column | None = None) -> Column:
    """Why an event goes to the dead letters: null for a good one, else ``empty_payload``, ``deserialize_error`` or ``rejected``."""
    good = amount.isNotNull() & ~F.isnan(amount) & (amount > 0) & (amount <= 1e6) & F.length(transaction_id).between(1, 128) & F.length(card_id).between(1, 128)
    if v is not None:
        good = good & F.coalesce((F.size(v) <= 256) & F.forall(F.map_values(v), lambda x: x.isNull() | (~F.isnan(x) & (F.abs(x) < float("inf")))), F.lit(True))
    if categorical is not None:
        good = good & F.coalesce((F.size(categorical) <= 256) & F.forall(F.map_values(categorical), lambda x: x.isNull() | (F.length(x) <= 256)), F.lit(True))
    return F.when(payload.isNull() | (F.length(payload) == 0), "empty_payload").when(corrupt, "deserialize_error").when(~F.coalesce(good, F.lit(False)), "rejected")


def raw_attributes(df: DataFrame, v: Sequence[str], categorical: Sequence[str]) -> Column:
    """The nested struct of a transaction event: numeric fields and two maps."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double")) if c in df.columns else F.lit(None).cast("double")
    v_map = F.map_from_arrays(F.array(*map(F.lit, v)), F.array(*[number(c) for c in v])) if v else F.create_map().cast("map<string,double>")
    c_map = F.map_from_arrays(F.array(*map(F.lit, categorical)), F.array(*[F.col(c).cast("string") for c in categorical])) if categorical else F.create_map().cast("map<string,string>")
    return F.struct(*[number(c).alias(c) for c in NUMERIC_COLUMNS], v_map.alias("v"), c_map.alias("categorical"))


# -- Splits and samples: contracts of size and strata are exact; which rows are taken follows a portable hash.


def time_split(df: DataFrame, *, key: str, tie: str, val: float, test: float, holdout: float) -> DataFrame:
    """Adds ``split``: the latest floor(n * holdout) rows, before them test, then val; the earliest rest is train.

    ValueError if nothing is left for train.
    """
    n = df.count()
    sizes = {"val": int(n * val), "test": int(n * test), "holdout": int(n * holdout)}
    train = n - sum(sizes.values())
    if train <= 0:
        raise ValueError("no training rows")
    r = F.col("__rank")
    split = F.when(r <= train, "train").when(r <= train + sizes["val"], "val").when(r <= train + sizes["val"] + sizes["test"], "test").otherwise("holdout")
    return ranked(df, key, [tie], "__rank").withColumn("split", split).drop("__rank")


SPLIT_ORDER = ("train", "val", "test", "holdout")


def split_bounds(df: DataFrame, key: str) -> DataFrame:
    """``split, n, first, last, chronological``: whether each split starts after the previous non-empty one ends."""
    per = df.groupBy("split").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    order = F.array_position(F.array(*map(F.lit, SPLIT_ORDER)), F.col("split"))
    before = F.lag("last").over(Window.orderBy(order))  # four rows
    return per.withColumn("chronological", F.coalesce(before < F.col("first"), F.lit(True)))


def assert_chronological(df: DataFrame, key: str) -> None:
    bad = [r["split"] for r in split_bounds(df, key).where("not chronological").collect()]
    if bad:
        raise ValueError(f"splits overlap in time at {bad}")


def check_split_name(name: str) -> str:
    if name not in SPLIT_ORDER:
        raise ValueError(f"unknown split {name!r}")
    return name


def stratified_sample(df: DataFrame, *, size: int, label: str, id: str, seed: int = 42) -> DataFrame:
    """About ``size`` rows with every label's share kept; all rows if there are no more.

    Each label keeps round-half-even(n_label * size / n) rows, those with the smallest hash.
    """
    n = df.count()
    if size >= n:
        return df
    quota = df.groupBy(label).agg(F.bround(F.count("*") * F.lit(size / n), 0).cast("bigint").alias("__quota"))
    hashed = ranked(df.withColumn("__hash", hash_u32(seed, F.col(id))), "__hash", [id], "__rank", groups=[label])
    return hashed.join(quota, label).where("__rank <= __quota").select(*df.columns)


def uniform_sample(df: DataFrame, n: int, id: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, those with the smallest hash: a distributed top-k, dealt to partitions again by id."""
    return df.orderBy(hash_u32(seed, F.col(id)), id).limit(n).repartition(F.col(id))


def stratified_folds(df: DataFrame, *, k: int, label: str, id: str, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1, each label dealt evenly in hash order."""
    hashed = ranked(df.withColumn("__hash", hash_u32(seed, F.col(id))), "__hash", [id], "__rank", groups=[label])
    return hashed.withColumn("fold", ((F.col("__rank") - 1) % k).cast("int")).drop("__hash", "__rank")


def require_enough_per_class(df: DataFrame, label: str, k: int) -> None:
    least = df.groupBy(label).count().agg(F.count("*").alias("classes"), F.min("count").alias("n")).first()
    if least["classes"] < 2 or least["n"] < k:
        raise ValueError(f"each class needs at least {k} rows")
