"""Ranking, threshold, cost and calibration metrics of scored rows (``label`` 0 or 1, ``score``).

Curves are built on one row per distinct score with running totals over ranges of scores, so a tied run of scores
counts as one step and no task holds all rows. Undefined values are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.contract import CostMatrix
from riskloom.functions.ordering import ranked, running
from riskloom.functions.scalars import safe_ratio
from riskloom.sources.tables import written

COSTS = CostMatrix()


def require_binary(df: DataFrame, label: str = "label", score: str | None = "score") -> None:
    """ValueError if a label isn't 0 or 1, or a score is missing or not finite."""
    bad = [F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False)))]
    if score:
        s = F.col(score).cast("double")
        bad.append(F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))))
    if any(df.agg(*bad).first()):
        raise ValueError("labels must be 0 or 1 and scores finite")


def both_classes(df: DataFrame, label: str = "label") -> DataFrame:
    """``both``: whether there is a positive and a negative."""
    return df.agg((F.coalesce(F.sum(label), F.lit(0)).between(1, F.count("*") - 1)).alias("both"))


def _confusion(threshold: float | Column, label: str, score: str) -> list[Column]:
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    return [F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn")]


def confusion(df: DataFrame, threshold: float, *, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*_confusion(threshold, label, score))


def expected_cost(df: DataFrame, threshold: float, costs: CostMatrix = COSTS, *, by: Sequence[str] = ()) -> DataFrame:
    """``cost`` and ``cost_per_row`` (null for no rows)."""
    c = confusion(df, threshold, by=by)
    cost = F.col("fn") * F.lit(float(costs.false_negative)) + F.col("fp") * F.lit(float(costs.false_positive))
    return c.select(*by, cost.alias("cost"), safe_ratio(cost, F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("cost_per_row"))


def classification(df: DataFrame, threshold: float, *, by: Sequence[str] = ()) -> DataFrame:
    c, (tp, fp, tn, fn) = confusion(df, threshold, by=by), (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(*by, safe_ratio(tp, tp + fp).alias("precision"), safe_ratio(tp, tp + fn).alias("recall"), safe_ratio(fp, fp + tn).alias("fpr"), safe_ratio(tp + fp, tp + fp + tn + fn).alias("flagged_rate"))


def brier(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"))


def score_curve(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """A row for each distinct score: ``n, p`` at it, ``cum_n, cum_p`` at it and above."""
    per = df.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("p"))
    return running(per, "score", [], {"cum_n": F.col("n"), "cum_p": F.col("p")}, groups=by, descending=True)


def auprc(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Average precision over distinct descending scores; null unless both classes are there."""
    c = score_curve(df, by=by)
    out = c.groupBy(*by).agg(F.sum(F.col("p") * F.col("cum_p") / F.col("cum_n")).alias("s"), F.sum("p").alias("pos"), F.sum("n").alias("all"))
    return out.select(*by, F.when((F.col("pos") > 0) & (F.col("pos") < F.col("all")), F.col("s") / F.col("pos")).alias("auprc"))


def pr_curve(df: DataFrame) -> DataFrame:
    """``score, precision, recall`` at each distinct score as threshold."""
    total = df.agg(F.sum("label")).first()[0] or 0
    return score_curve(df).select("score", (F.col("cum_p") / F.col("cum_n")).alias("precision"), safe_ratio(F.col("cum_p"), F.lit(float(total))).alias("recall"))


def recalls_at_k(df: DataFrame, ks: Sequence[float], *, id: str = "id") -> DataFrame:
    """``k, recall`` when the max(1, ceil(n * k)) highest scores are flagged, ties by id, all from one ranking; null for k outside (0, 1] or no positives."""
    r = written(ranked(df.select(id, "label", "score"), "score", [id], "r", descending=True).select("label", "r"), "ranked-scores")
    cuts = [F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(k)))) for k in ks]
    totals = r.agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    hits = r.join(totals).groupBy().agg(F.max("p").alias("p"), *[F.coalesce(F.sum(F.when(F.col("r") <= c, F.col("label"))), F.lit(0)).alias(f"h{i}") for i, c in enumerate(cuts)])  # with a row of totals
    rows = [F.struct(F.lit(float(k)).alias("k"), (safe_ratio(F.col(f"h{i}"), F.col("p")) if 0 < k <= 1 else F.lit(None).cast("double")).alias("recall")) for i, k in enumerate(ks)]
    return hits.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def recall_at_k(df: DataFrame, k: float, *, id: str = "id") -> DataFrame:
    return recalls_at_k(df, [k], id=id).select("recall")


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """``bin, n, mean_score, positive_share`` over equal bins of [0, 1]; an edge belongs to the lower bin, empty bins are absent."""
    bin_ = F.least(F.greatest(F.ceil(F.col("score") * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("positive_share"))


def class_weight(df: DataFrame) -> DataFrame:
    """``weight``: negatives for each positive; 1 if a class is absent."""
    return df.agg(F.count_if(F.col("label") == 0).alias("n"), F.count_if(F.col("label") == 1).alias("p")).select(F.when((F.col("n") > 0) & (F.col("p") > 0), F.col("n") / F.col("p")).otherwise(F.lit(1.0)).alias("weight"))


def cost_curve(df: DataFrame, costs: CostMatrix = COSTS) -> DataFrame:
    """At each distinct score as threshold: ``threshold, cost, recall, flagged_rate, precision``."""
    n, p = df.agg(F.count("*"), F.sum("label")).first()
    n, p = float(n), float(p or 0)
    tp, flagged = F.col("cum_p"), F.col("cum_n")
    cost = (F.lit(p) - tp) * F.lit(float(costs.false_negative)) + (flagged - tp) * F.lit(float(costs.false_positive))
    return score_curve(df).select(F.col("score").alias("threshold"), cost.alias("cost"), safe_ratio(tp, F.lit(p)).alias("recall"), (flagged / F.lit(n)).alias("flagged_rate"), (tp / flagged).alias("precision"))


def best_threshold(df: DataFrame, costs: CostMatrix = COSTS, *, recall_floor: float = 0.1, alert_budget: float = 0.1) -> DataFrame:
    """The cheapest feasible row of the cost curve; of equal costs the highest threshold. No row if none is feasible."""
    feasible = cost_curve(df, costs).where((F.col("recall") >= recall_floor) & (F.col("flagged_rate") <= alert_budget))
    return feasible.orderBy("cost", F.desc("threshold")).limit(1)


def select_threshold(df: DataFrame, costs: CostMatrix = COSTS, **limits: float) -> dict:
    found = best_threshold(df, costs, **limits).collect()
    if not found:
        raise ValueError("no threshold meets the recall floor within the alert budget")
    return found[0].asDict()


def report(df: DataFrame, threshold: float, costs: CostMatrix = COSTS, ks: Sequence[float] = (0.005, 0.01, 0.05)) -> DataFrame:
    """One row: size, positives, average precision, recalls at k, Brier, threshold metrics and cost."""
    head = df.agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"), *_confusion(threshold, "label", "score"))
    row = head.first().asDict() | auprc(df).first().asDict() | classification(df, threshold).first().asDict() | expected_cost(df, threshold, costs).first().asDict()
    row |= {f"recall_at_{k:g}": r["recall"] for k, r in zip(ks, recalls_at_k(df, ks).collect(), strict=True)}
    return df.sparkSession.createDataFrame([row], ", ".join(f"`{k}` {'bigint' if isinstance(v, int) else 'double'}" for k, v in row.items()))


def profile(df: DataFrame) -> DataFrame:
    """``column, type, nulls, min, max`` (as text) of every column, in one pass."""
    cols = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    aggs = [x for i, c in enumerate(cols) for x in (F.count_if(F.col(c).isNull()).alias(f"n{i}"), F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"b{i}"))]
    kinds = dict(df.dtypes)
    parts = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(f"n{i}").alias("nulls"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max")) for i, c in enumerate(cols)]
    return df.agg(*aggs).select(F.explode(F.array(*parts)).alias("x")).select("x.*")
