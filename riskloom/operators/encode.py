"""Frequency and target encodings as lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import number_key, text_key


def _key(df: DataFrame, c: str) -> Column:
    return text_key(F.col(c)) if dict(df.dtypes)[c] == "string" else number_key(F.col(c))


def _long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """A row for each column's key of each row: ``column, key`` besides ``keep``. A missing value is a key of its own, null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _key(df, c).alias("key")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*")


def frequency_map(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, key, freq``: share of each key among all rows."""
    total = df.count()
    return _long(df, columns).groupBy("column", "key").agg((F.count("*") / F.lit(float(total))).alias("freq"))


def fit_encoder(df: DataFrame, columns: Sequence[str], label: str, smoothing: float = 20.0) -> tuple[DataFrame, float]:
    """``column, key, freq, target`` of every key of every column, in one aggregation, and the prior (mean label).

    The target is (sum of labels + smoothing * prior) / (rows + smoothing).
    """
    total, prior = df.agg(F.count("*"), F.avg(F.col(label).cast("double"))).first()
    m, prior = float(smoothing), float(prior or 0.0)
    table = _long(df, columns, [label]).groupBy("column", "key").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("s"))
    return table.select("column", "key", (F.col("n") / F.lit(float(max(total, 1)))).alias("freq"), ((F.col("s") + m * prior) / (F.col("n") + m)).alias("target")), prior


def transform_encoder(df: DataFrame, encoder: DataFrame, prior: float, columns: Sequence[str], id: str) -> DataFrame:
    """Adds ``<c>_freq`` and ``<c>_target`` as floats; an unseen key has frequency 0 and the prior as target.

    Columns are unpivoted, joined once with the lookup table (broadcast by size, else shuffled) and gathered by id.
    """
    found = _long(df, columns, [id]).alias("v").join(encoder.alias("e"), F.expr("v.column = e.column and v.key <=> e.key"), "left")
    values = [F.max(F.when(F.col("v.column") == c, F.coalesce(x, F.lit(d)))).cast("float").alias(f"{c}_{n}") for c in columns for n, x, d in (("freq", F.col("e.freq"), 0.0), ("target", F.col("e.target"), prior))]
    return df.join(found.groupBy(F.col(f"v.{id}").alias(id)).agg(*values), id)


def oof_targets(df: DataFrame, columns: Sequence[str], label: str, fold: str, id: str, smoothing: float = 20.0) -> DataFrame:
    """``id, column, target_oof``: each row's target from the other folds only, with those folds' prior.

    One aggregation per (column, key, fold); out-of-fold sums are totals minus the fold's own. A key unseen in the
    other folds takes their prior.
    """
    m = float(smoothing)
    long = _long(df, columns, [id, label, fold])
    per = long.groupBy("column", "key", fold).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("s"))
    every = per.groupBy("column", "key").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    folds = df.groupBy(fold).agg(F.count("*").alias("fn"), F.sum(F.col(label).cast("double")).alias("fs"))
    an, sa = folds.agg(F.sum("fn"), F.sum("fs")).first()
    priors = folds.select(F.col(fold), ((F.lit(float(sa or 0)) - F.col("fs")) / (F.lit(float(an or 0)) - F.col("fn"))).alias("prior"))
    rest = per.alias("p").join(every.alias("e"), F.expr("p.column = e.column and p.key <=> e.key")).join(F.broadcast(priors), fold)  # a row for each fold
    on, os = F.col("tn") - F.col("n"), F.col("ts") - F.col("s")
    rest = rest.select(F.col("p.column").alias("column"), F.col("p.key").alias("key"), F.col(fold), F.when(on > 0, (os + m * F.col("prior")) / (on + m)).otherwise(F.col("prior")).alias("target_oof"))
    joined = long.alias("v").join(rest.alias("r"), F.expr(f"v.column = r.column and v.key <=> r.key and v.`{fold}` = r.`{fold}`"))
    return joined.select(F.col(f"v.{id}").alias(id), F.col("v.column").alias("column"), "target_oof")
