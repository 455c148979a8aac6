"""Population drift, alert latches and cooldowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ordering import quantiles, ranked, running
from riskloom.operators.velocity import asof_join
from riskloom.sources.tables import written

FLOOR = 1e-4


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")).select("p.*").withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def baseline_edges(baseline: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """``feature, edges``: exact baseline quantiles that cut each feature into at most ``bins`` parts, each edge once; no edges without values."""
    cuts = quantiles(_long(baseline, columns), "feature", "x", [i / bins for i in range(1, bins)])
    named = baseline.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return named.join(F.broadcast(cuts), "feature", "left").select("feature", F.array_sort(F.array_distinct(F.coalesce("q", F.array().cast("array<double>")))).alias("edges"))


def _binned(df: DataFrame, edges: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``feature, bin`` and the rows in each, under ``name``. Bin i holds values above i edges (-1: missing)."""
    joined = _long(df, columns).join(F.broadcast(edges.select("feature", "edges")), "feature")  # a row for each column
    at = F.when(F.col("x").isNull(), -1).otherwise(F.size(F.filter("edges", lambda e: e < F.col("x"))))
    return joined.select("feature", at.alias("bin")).groupBy("feature", "bin").agg(F.count("*").alias(name))


def baseline_bins(baseline: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """``feature, edges, counts``: what a PSI needs of its baseline, a row for each column; ``counts`` maps bins to rows."""
    edges = written(baseline_edges(baseline, columns, bins), "baseline-edges")
    counts = _binned(baseline, edges, columns, "b").groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "b"))).alias("counts"))
    return written(edges.join(counts, "feature", "left").withColumn("counts", F.coalesce("counts", F.create_map().cast("map<int,bigint>"))), "baseline-bins")


def psi_against(known: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, psi`` of ``current`` against ``baseline_bins``: population stability index over the bins, shares floored at 1e-4."""
    seen = _binned(current, known, columns, "c")
    expected = known.select("feature", F.explode("counts").alias("bin", "b"))
    counts = expected.join(seen, ["feature", "bin"], "full").fillna(0, ["b", "c"])
    total = counts.groupBy("feature").agg(F.sum("b").alias("tb"), F.sum("c").alias("tc"))
    share = lambda n, t: F.greatest(F.col(n) / F.col(t), F.lit(FLOOR))
    parts = counts.join(total, "feature").where("tb > 0 and tc > 0").select("feature", share("b", "tb").alias("e"), share("c", "tc").alias("a"))
    return parts.groupBy("feature").agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))


def psi(baseline: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """``feature, psi``: population stability index over baseline-quantile bins and a bin for missing values."""
    return psi_against(baseline_bins(baseline, columns, bins), current, columns)


def drift_summary(scores: DataFrame, threshold: float = 0.2) -> DataFrame:
    """``drifted`` (features strictly above), ``max_psi``, ``share``; zeros when there are none."""
    over = F.col("psi") > threshold
    return scores.agg(F.count_if(over).alias("drifted"), F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"), F.coalesce(F.avg(over.cast("double")), F.lit(0.0)).alias("share"))


def top_psi(scores: DataFrame, n: int = 15) -> DataFrame:
    return scores.orderBy(F.desc("psi"), "feature").limit(n)


def distribution_distances(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """``ks, wasserstein`` of one column: the largest gap between the two distribution functions, and its integral."""
    side = lambda df, b, c: df.select(F.col(column).cast("double").alias("x"), F.lit(b).cast("bigint").alias("b"), F.lit(c).cast("bigint").alias("c")).where("x is not null and not isnan(x)")
    both = side(baseline, 1, 0).union(side(current, 0, 1)).groupBy("x").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    tb, tc = both.agg(F.sum("b"), F.sum("c")).first()
    if not tb or not tc:
        return both.sparkSession.createDataFrame([(None, None)], "ks double, wasserstein double")
    cum = running(both, "x", [], {"cb": F.col("b"), "cc": F.col("c")})
    gap = F.abs(F.col("cb") / F.lit(float(tb)) - F.col("cc") / F.lit(float(tc)))
    # The next value comes by a join on positions: no window runs over all rows.
    steps = ranked(cum.select("x", gap.alias("gap")), "x", [], "r")
    nexts = steps.select((F.col("r") - 1).alias("r"), F.col("x").alias("next"))
    return steps.join(nexts, "r", "left").agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * (F.coalesce("next", "x") - F.col("x"))).alias("wasserstein"))


def drift_report(baseline: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """``feature, psi, ks, wasserstein`` of every column; missing and infinite values count for the PSI only."""
    both = _long(baseline, columns).withColumns({"b": F.lit(1).cast("bigint"), "c": F.lit(0).cast("bigint")}).union(_long(current, columns).withColumns({"b": F.lit(0).cast("bigint"), "c": F.lit(1).cast("bigint")}))
    per = written(both.where("x is not null and abs(x) < double('infinity')").groupBy("feature", "x").agg(F.sum("b").alias("b"), F.sum("c").alias("c")), "distinct-values")
    total = per.groupBy("feature").agg(F.sum("b").alias("tb"), F.sum("c").alias("tc"))
    cum = running(per, "x", [], {"cb": F.col("b"), "cc": F.col("c")}, groups=["feature"])
    gaps = cum.join(total, "feature").where("tb > 0 and tc > 0").select("feature", "x", F.abs(F.col("cb") / F.col("tb") - F.col("cc") / F.col("tc")).alias("gap"))
    steps = written(ranked(gaps, "x", [], "r", groups=["feature"]), "distribution-gaps")
    nexts = steps.select("feature", (F.col("r") - 1).alias("r"), F.col("x").alias("next"))  # the next value by a join on positions
    distances = steps.join(nexts, ["feature", "r"], "left").groupBy("feature").agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * (F.coalesce("next", "x") - F.col("x"))).alias("wasserstein"))
    return psi(baseline, current, columns, bins).join(distances, "feature", "full")


def breach_latch(cycles: DataFrame, *, order: str, breached: Column, required: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``fires``: true where a streak of breaches reaches ``required``; re-armed by a recovery.

    Rows whose condition is null (skipped cycles) neither extend nor end a streak and never fire.
    """
    b = cycles.withColumn("__b", breached)
    island = F.sum(F.when(F.col("__b"), 0).when(~F.col("__b"), 1)).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    marked = b.withColumn("__i", F.coalesce(island, F.lit(0)))
    nth = F.sum(F.col("__b").cast("int")).over(Window.partitionBy(*by, "__i").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("fires", F.coalesce(F.col("__b") & (nth == required), F.lit(False))).drop("__b", "__i")


def cooldown(events: DataFrame, *, by: str, at_s: str, seconds: float) -> DataFrame:
    """``by, at_s``: in time order, the times that fire when at least ``seconds`` have passed since the last that did.

    Each time points to the first one that may fire after it. Who is reached from a key's first time is found by doubling: in each
    round the reached are joined with pointers of twice the length, so a key of any size takes as many rounds as its
    number of firings has binary digits, and no key is gathered. Null times never fire; equal times are one.
    """
    times = written(events.select(F.struct(F.col(by).alias("k")).alias("k"), F.col(at_s).cast("double").alias("t")).where("t is not null").distinct(), "times")
    # The first time at or after t + seconds is the last one at or before it when time runs backwards.
    left, right = times.select("k", "t", (-(F.col("t") + seconds)).alias("at")), times.select("k", F.col("t").alias("next"), (-F.col("t")).alias("at"))
    jumps = asof_join(left, right, by="k", us="at", right_tie="next", values=["next"], width_us=max(seconds, 1e-3) * 16)
    jumps = written(jumps.select("k", "t", "next").where("next is not null"), "jumps")
    reached = written(times.groupBy("k").agg(F.min("t").alias("t")), "reached")
    while not jumps.isEmpty():
        reached = written(reached.union(reached.join(jumps, ["k", "t"]).select("k", F.col("next").alias("t"))), "reached")
        twice = jumps.alias("a").join(jumps.alias("b"), F.expr("a.k = b.k and a.next = b.t"))
        jumps = written(twice.select("a.k", "a.t", "b.next"), "jumps")
    return reached.select(F.col("k.k").alias(by), F.col("t").alias(at_s))
