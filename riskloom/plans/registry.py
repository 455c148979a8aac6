"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def wrap(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return wrap


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded to six decimals under its name."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def big(c: str | Column, name: str | None = None) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or c)


def rounded(df: DataFrame) -> DataFrame:
    """Every double rounded to six decimals, every other whole number as bigint."""
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])
