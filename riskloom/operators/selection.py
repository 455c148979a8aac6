"""Selection of columns from a wide numeric block: missingness, rank correlation, greedy clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.contract import SelectionParams
from riskloom.functions.ordering import running
from riskloom.functions.scalars import safe_ratio
from riskloom.operators.prepare import uniform_sample
from riskloom.sources.tables import written


def v_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.fullmatch(r"V[0-9]+", c)]


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, rate``: share of nulls, all columns in one pass."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rate")) for c in columns])).alias("x")).select("x.*")


#: Cells of a tile of columns: two tiles of eight bytes a cell are what a task holds.
TILE_CELLS = 4_000_000


def mean_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the values of each column; ties share the mean of their places."""
    out = np.empty(x.shape)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(x[order, k]) != 0]))
        ends = np.append(starts[1:], len(order))
        out[order, k] = np.repeat((starts + 1 + ends) / 2, ends - starts)
    return out


def pair_correlations(left: np.ndarray, right: np.ndarray, min_periods: int) -> np.ndarray:
    """Rank correlations of each column of ``left`` with each of ``right`` over the rows where both are there (NaN: missing); NaN where undefined.

    Columns that miss the same rows are ranked once for each such group on the other side, and their products are one matrix product.
    """
    def patterns(x: np.ndarray) -> list[tuple[np.ndarray, list[int]]]:
        groups: dict[bytes, list[int]] = {}
        for k in range(x.shape[1]):
            groups.setdefault(np.packbits(np.isnan(x[:, k])).tobytes(), []).append(k)
        return [(~np.isnan(x[:, at[0]]), at) for at in groups.values()]

    out = np.full((left.shape[1], right.shape[1]), np.nan)
    for here, a in patterns(left):
        for there, b in patterns(right):
            both = here & there
            if both.sum() >= max(min_periods, 1):
                x, y = (mean_ranks(m[both][:, at]) for m, at in ((left, a), (right, b)))
                x, y = x - x.mean(axis=0), y - y.mean(axis=0)
                size = np.sqrt(np.outer((x * x).sum(axis=0), (y * y).sum(axis=0)))
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[np.ix_(a, b)] = np.where(size > 0, x.T @ y / size, np.nan)
    return out


def spearman(df: DataFrame, columns: Sequence[str], id: str, min_periods: int = 1000, tile_cells: int = TILE_CELLS) -> DataFrame:
    """``a, b, rho`` for every pair a < b of columns: rank correlation over rows where both are there.

    Ranks are recomputed within each pair's rows, ties share their mean rank; NaN is missing. Pairs of fewer than ``min_periods``
    rows, or with a constant side, have null; pairs that no row has both of have none. Tasks turn their rows into pieces of columns, and
    each pair of tiles of columns is one task, which holds these columns whole: with more rows a tile has fewer columns, at last one. A cell is sent once for each tile, not for each column.
    """
    names = sorted(columns)
    rows = max(df.count(), 1)
    width = max(1, min(len(names), tile_cells // rows))
    tiles = -(-len(names) // width)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                chunk = batch["__row"].iloc[0]  # no two batches have a row in common
                yield pd.DataFrame({"column": np.arange(len(names)), "chunk": chunk, "cells": [batch[c].to_numpy(np.float64).tobytes() for c in names]})

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["column", "chunk"])
        cells = {k: np.frombuffer(b"".join(part["cells"]), np.float64) for k, part in group.groupby("column")}
        one, two = (int(group[c].iloc[0]) for c in ("one", "two"))
        left, right = ([k for k in cells if k // width == tile] for tile in (one, two))
        rho = pair_correlations(np.column_stack([cells[k] for k in left]), np.column_stack([cells[k] for k in right]), min_periods)
        return pd.DataFrame([(names[a], names[b], rho[i, j]) for i, a in enumerate(left) for j, b in enumerate(right) if a < b], columns=["a", "b", "rho"])

    wide = df.select(*[F.col(c).cast("double").alias(c) for c in names], F.monotonically_increasing_id().alias("__row"))
    tile = F.floor(F.col("column") / width).cast("int")
    cut = wide.mapInPandas(pieces, "column int, chunk bigint, cells binary")
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumns({"one": F.least(tile, "other"), "two": F.greatest(tile, "other")})
    found = pairs.groupBy("one", "two").applyInPandas(work, "a string, b string, rho double")
    return found.select("a", "b", F.when(~F.isnan("rho"), F.col("rho")).alias("rho"))


def label_association(df: DataFrame, columns: Sequence[str], label: str, id: str, min_periods: int = 1000) -> DataFrame:
    """``column, strength``: absolute rank correlation with the label; 0 where it is undefined.

    Ranks come from running counts of distinct values over ranges of values, so no task holds a whole column.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.col(label).cast("double").alias("y"), F.explode(pairs).alias("p")).select("y", "p.*").where("x is not null and y is not null")
    long = written(long.groupBy("column", "x", "y").agg(F.count("*").alias("w")), "column-values")
    ranks = long
    for v, name in (("x", "rx"), ("y", "ry")):
        counts = long.groupBy("column", v).agg(F.sum("w").alias("n"))
        upto = running(counts, v, [], {"upto": F.col("n")}, groups=["column"])
        ranks = ranks.join(upto.select("column", v, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).alias(name)), ["column", v])
    w, x, y = F.col("w"), F.col("rx"), F.col("ry")
    sums = ranks.groupBy("column").agg(F.sum("w").alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"))
    n = F.col("n")
    spread = F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy")))
    stats = sums.select("column", "n", safe_ratio(n * F.col("sxy") - F.col("sx") * F.col("sy"), spread).alias("rho"))
    found = stats.select("column", F.when(F.col("n") >= min_periods, F.abs("rho")).alias("s"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(found, "column", "left").select("column", F.coalesce("s", F.lit(0.0)).alias("strength"))


def decorrelate(strength: dict[str, float], rho: dict[tuple[str, str], float | None], threshold: float) -> list[str]:
    """Leaders in order of strength, then name: each claims every column correlated with it at ``threshold`` or more."""
    left = sorted(strength, key=lambda c: (-strength[c], c))
    leaders = []
    while left:
        lead = left.pop(0)
        leaders.append(lead)
        left = [c for c in left if abs(rho.get((min(c, lead), max(c, lead))) or 0.0) < threshold]
    return leaders


def select_block(df: DataFrame, label: str, id: str, params: SelectionParams = SelectionParams(), seed: int = 42, *, whole: bool = False) -> list[str]:
    """The kept columns of the V block, by name: dense enough, spread apart, the strongest ``max_features``.

    Correlations are taken on at most ``sample_rows`` rows, or with ``whole`` on all; only the matrix of a few hundred columns reaches the driver.
    """
    columns = v_columns(df)
    if not columns:
        return []
    dense = [r["column"] for r in missing_rates(df, columns).where(F.col("rate") <= params.max_missing).collect()]
    if not dense:
        return []
    rows = df.select(id, label, *dense)
    sample = written(rows if whole else uniform_sample(rows, params.sample_rows, id, seed), "selection")
    strength = {r["column"]: r["strength"] for r in label_association(sample, dense, label, id, params.min_periods).collect()}
    rho = {(r["a"], r["b"]): r["rho"] for r in spearman(sample, dense, id, params.min_periods).collect()}
    leaders = decorrelate(strength, rho, params.max_correlation)
    return sorted(sorted(leaders, key=lambda c: (-strength[c], c))[: params.max_features])
