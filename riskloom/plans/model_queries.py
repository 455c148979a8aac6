"""Queries that train on the driver's tables; SQL where it can say the fit: isotonic calibration, leaf-wise trees over features of few values."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.contract import CostMatrix, Params
from riskloom.functions.scalars import amount_log, hash_u32_sql
from riskloom.operators import metrics, model, prepare, velocity
from riskloom.operators.boosting import Growth, fit_leafwise
from riskloom.operators.gate import Registry
from riskloom.plans.feature_queries import _SPLIT_SQL
from riskloom.plans.registry import query, rounded
from riskloom.sources.tables import TRANSACTIONS_SQL, driver_folder, transactions, written

FEATURES = ["amount", "amt_log", "v_count", "v_sum", "v_mean", "v_max", "gap_s"]


def training_rows(spark, d):
    t = velocity.seconds_since_previous(velocity.velocity(transactions(spark, d)))
    t = t.withColumns({"amt_log": amount_log(F.col("amount")), "v_mean": F.when(F.col("v_count") > 0, F.col("v_mean")), "label": (F.col("v_count") + F.col("amount") / 20 + F.col("id") % 5 > 8).cast("int")})
    return prepare.time_split(t.select("id", "us", "label", *FEATURES), key="us", tie="id", val=0.15, test=0.15, holdout=0.15)


@query()
def model_backtest(spark, d):
    rows = written(training_rows(spark, d), "training-rows")
    small = model.Hyper(rounds=5, depth=3, trees=5)
    bundle, _ = model.train_and_gate(rows, FEATURES, Registry(driver_folder(spark)), Params(recall_floor=0.05, alert_budget=0.9), small, families=("gbt", "linear"))
    return model.backtest(bundle, rows.where("split = 'holdout'").drop("split"))


def _outcomes(spark, d):
    """Scores in hundredths and an outcome that rises with them, with noise, by split."""
    t = transactions(spark, d).withColumn("hundredths", F.floor(F.col("score") * 100))
    t = t.select("id", "us", ((F.col("hundredths") + F.col("id") * 37 % 101) > 110).cast("int").alias("label"), (F.col("hundredths") / F.lit(100.0)).alias("raw_score"))
    return prepare.time_split(t, key="us", tie="id", val=0.15, test=0.15, holdout=0.15)


_LIMITS = Params(recall_floor=0.1, alert_budget=0.9)
# A pool's value is the highest, over its left ends, of the lowest mean, over its right ends.
_CALIBRATED = f"""WITH s AS MATERIALIZED (SELECT id, split, hundredths / 100.0::DOUBLE AS x, ((hundredths + id * 37 % 101) > 110)::INT AS label FROM (SELECT id, floor(score * 100)::BIGINT AS hundredths FROM {TRANSACTIONS_SQL}) JOIN {_SPLIT_SQL} USING (id)),
halves AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {hash_u32_sql(_LIMITS.seed, "id")}, id) - 1) % 2 AS half FROM s WHERE split = 'val'),
f AS MATERIALIZED (SELECT x, sum(label) AS y, count(*) AS n, sum(sum(label)) OVER (ORDER BY x) AS cy, sum(count(*)) OVER (ORDER BY x) AS cn FROM halves WHERE half = 0 GROUP BY x),
iso AS MATERIALIZED (SELECT x, max(lowest) AS p FROM (SELECT i.x AS x, j.x AS since, min((k.cy - j.cy + j.y) / (k.cn - j.cn + j.n)) AS lowest FROM f i JOIN f j ON j.x <= i.x JOIN f k ON k.x >= i.x GROUP BY 1, 2) GROUP BY x),
line AS (SELECT g.x, CASE WHEN lo.x IS NULL THEN hi.p WHEN hi.x IS NULL OR lo.x = hi.x THEN lo.p ELSE lo.p + (hi.p - lo.p) * (g.x - lo.x) / (hi.x - lo.x) END AS p
 FROM (SELECT DISTINCT x FROM s) g ASOF LEFT JOIN iso lo ON g.x >= lo.x ASOF LEFT JOIN iso hi ON g.x <= hi.x),
c AS MATERIALIZED (SELECT s.id, s.split, s.x, s.label, half, greatest(0.0::DOUBLE, least(1.0::DOUBLE, p)) AS score FROM s JOIN line USING (x) LEFT JOIN halves USING (id)),
curve AS (SELECT score, sum(n) OVER w AS flagged, sum(y) OVER w AS hit, sum(n) OVER () AS n, sum(y) OVER () AS y FROM (SELECT score, count(*) AS n, sum(label) AS y FROM c WHERE half = 1 GROUP BY score) WINDOW w AS (ORDER BY score DESC)),
chosen AS MATERIALIZED (SELECT round(score, 6) AS threshold FROM curve WHERE hit / y >= 0.1 AND flagged / n <= 0.9 ORDER BY (y - hit) * 100.0::DOUBLE + (flagged - hit) * 5.0::DOUBLE, score DESC LIMIT 1)"""


def _calibrated(spark, d):
    """Calibrator, threshold and the scored rows of test and holdout."""
    rows = written(_outcomes(spark, d), "outcomes")
    calibrator, threshold = model.calibrate(rows.where("split = 'val'").select("id", "label", "raw_score"), _LIMITS)
    return threshold, model.calibrated(rows.where("split in ('test', 'holdout')"), calibrator)


@query(f"{_CALIBRATED} SELECT id, split, round(score, 6) AS score, score >= threshold AS decision FROM c, chosen WHERE split IN ('test', 'holdout')")
def calibrated_scores(spark, d):
    threshold, scored = _calibrated(spark, d)
    return rounded(scored.select("id", "split", "score", (F.col("score") >= threshold).alias("decision")))


_AP = "(SELECT sum(y * cy / cn) / sum(y) FROM (SELECT y, sum(y) OVER (ORDER BY v DESC) AS cy, sum(n) OVER (ORDER BY v DESC) AS cn FROM (SELECT {0} AS v, sum(label) AS y, count(*) AS n FROM c WHERE split = '{1}' GROUP BY 1)))"
_RECALL = "(SELECT sum(label) FILTER (r <= greatest(1, ceil(n::DOUBLE * {0}::DOUBLE))) / sum(label) FROM (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS r, count(*) OVER () AS n FROM c WHERE split = 'holdout'))"


@query(f"""{_CALIBRATED}, k AS (SELECT split, count(*) AS n, sum(label) AS positives, avg(pow(score - label, 2)) AS brier, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
 count(*) FILTER (score < threshold AND label = 0) AS tn, count(*) FILTER (score < threshold AND label = 1) AS fn FROM c, chosen WHERE split IN ('test', 'holdout') GROUP BY split)
SELECT n, positives::BIGINT AS positives, round(brier, 6) AS brier, tp, fp, tn, fn, round({_AP.format("score", "holdout")}, 6) AS auprc, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fpr, round((tp + fp) / n, 6) AS flagged_rate,
 round(fn * 100.0::DOUBLE + fp * 5.0::DOUBLE, 6) AS cost, round((fn * 100.0::DOUBLE + fp * 5.0::DOUBLE) / n, 6) AS cost_per_row, round({_RECALL.format(0.005)}, 6) AS recall_at_0_005, round({_RECALL.format(0.01)}, 6) AS recall_at_0_01, round({_RECALL.format(0.05)}, 6) AS recall_at_0_05,
 threshold, round({_AP.format("x", "test")}, 6) AS test_auprc, (SELECT round((fn * 100.0::DOUBLE + fp * 5.0::DOUBLE) / n, 6) FROM k WHERE split = 'test') AS test_cost FROM k, chosen WHERE split = 'holdout'""")
def holdout_report(spark, d):
    """What the gate reads of test rows and the report of the holdout, at the threshold that validation rows chose."""
    threshold, scored = _calibrated(spark, d)
    scored = written(scored, "calibrated-scores")
    ap, cost = model.gate_inputs(scored.where("split = 'test'"), threshold, CostMatrix())
    report = metrics.report(scored.where("split = 'holdout'").select("id", "label", "score"), threshold)
    report = report.toDF(*[c.replace(".", "_") for c in report.columns])
    return rounded(report.withColumns({"threshold": F.lit(threshold), "test_auprc": F.lit(ap), "test_cost": F.lit(cost)}))


# Every value of these features is more frequent than one bin of 64, so each is an edge; category and the remainder can be missing.
_GROWTH = Growth(rounds=2, depth=2, leaves=3, rate=0.3, ridge=1.0, min_rows=5)
_WEIGHT = 2.0


def _few_values(spark, d):
    kinds = F.when(F.col("category") != "error", F.length("category"))
    t = transactions(spark, d).select(
        "id", "us", F.least(F.floor(F.col("amount") / 10), F.lit(11)).alias("tens"), (F.floor(F.col("us") / 3600000000) % 24).alias("hour"),
        F.when(F.col("id") % 7 != 3, F.col("id") * 31 % 11).alias("rest"), kinds.alias("kind"),
    )
    label = F.col("tens") + F.floor(F.col("hour") / 8) * 3 + F.when(F.col("kind").isNull(), 4).otherwise(0) + F.col("id") * 37 % 11 > 13
    return prepare.time_split(t.withColumn("label", label.cast("int")), key="us", tie="id", val=0.15, test=0.15, holdout=0.15)


_FEW_SQL = f"""SELECT id, split, ((tens + hour // 8 * 3 + CASE WHEN kind IS NULL THEN 4 ELSE 0 END + id * 37 % 11) > 13)::INT AS y, [tens, hour, rest, kind] AS xs FROM (
 SELECT id, least(floor(amount / 10), 11)::BIGINT AS tens, (us // 3600000000) % 24 AS hour, CASE WHEN id % 7 <> 3 THEN id * 31 % 11 END AS rest, CASE WHEN category <> 'error' THEN length(category) END AS kind FROM {TRANSACTIONS_SQL}) JOIN {_SPLIT_SQL} USING (id)"""


def _splits_sql(rows: str) -> str:
    """The best split of each node of training rows ``(node, g, h, xs)``: every value of every feature, and both sides for the missing."""
    r = f"{_GROWTH.ridge}::DOUBLE"
    return f"""(SELECT node, f, x, ml, gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 6) DESC, f, x, ml DESC) AS place FROM (
 SELECT node, f, x, ml, lg * lg / (lh + {r}) + (g - lg) * (g - lg) / (h - lh + {r}) - g * g / (h + {r}) AS gain FROM (
 SELECT c.node, f, x, ml, c.g + CASE WHEN ml THEN mg ELSE 0 END AS lg, c.h + CASE WHEN ml THEN mh ELSE 0 END AS lh, c.n + CASE WHEN ml THEN mn ELSE 0 END AS ln, t.g AS g, t.h AS h, t.n AS n FROM (
 SELECT node, f, x, sum(g) FILTER (x IS NOT NULL) OVER w AS g, sum(h) FILTER (x IS NOT NULL) OVER w AS h, sum(n) FILTER (x IS NOT NULL) OVER w AS n, coalesce(sum(g) FILTER (x IS NULL) OVER v, 0) AS mg, coalesce(sum(h) FILTER (x IS NULL) OVER v, 0) AS mh, coalesce(sum(n) FILTER (x IS NULL) OVER v, 0) AS mn
 FROM (SELECT node, f, xs[f] AS x, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {rows}, (VALUES (1), (2), (3), (4)) k(f) GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY node, f ORDER BY x), v AS (PARTITION BY node, f)) c
 JOIN (SELECT node, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {rows} GROUP BY node) t ON t.node = c.node, (VALUES (true), (false)) m(ml) WHERE x IS NOT NULL)
 WHERE ln >= {_GROWTH.min_rows} AND n - ln >= {_GROWTH.min_rows})) WHERE place = 1 AND gain > 0)"""


def _trees_sql() -> str:
    """Two trees of three leaves: the root's split, then the better one of its children's; the next tree starts from the margins of the last."""
    start = f"ln({_WEIGHT}::DOUBLE * sum(y) FILTER (split = 'train') / count(*) FILTER (split = 'train' AND y = 0))"
    parts = [f"m0 AS MATERIALIZED (SELECT *, (SELECT {start} FROM rows) AS margin FROM rows)"]
    goes_left = "CASE WHEN xs[f] IS NULL THEN ml ELSE xs[f] <= x END"
    for k in range(_GROWTH.rounds):
        weight = f"(CASE WHEN y = 1 THEN {_WEIGHT}::DOUBLE ELSE 1.0::DOUBLE END)"
        parts += [
            f"a{k} AS MATERIALIZED (SELECT *, {weight} * (p - y) AS g, {weight} * p * (1 - p) AS h, '' AS node FROM (SELECT *, 1 / (1 + exp(-margin)) AS p FROM m{k}))",
            f"r{k} AS MATERIALIZED (SELECT * FROM {_splits_sql(f'(SELECT * FROM a{k} WHERE split = $$train$$)')})",
            f"b{k} AS MATERIALIZED (SELECT a.* EXCLUDE (node), CASE WHEN {goes_left} THEN 'l' ELSE 'r' END AS node FROM a{k} a JOIN r{k} USING (node))",
            f"s{k} AS MATERIALIZED (SELECT * FROM {_splits_sql(f'(SELECT * FROM b{k} WHERE split = $$train$$)')} ORDER BY gain DESC LIMIT 1)",
            f"c{k} AS MATERIALIZED (SELECT b.* EXCLUDE (node), CASE WHEN s.node IS NULL THEN b.node WHEN {goes_left} THEN b.node || 'l' ELSE b.node || 'r' END AS node FROM b{k} b LEFT JOIN s{k} s ON s.node = b.node)",
            f"m{k + 1} AS MATERIALIZED (SELECT id, split, y, xs, margin + step AS margin FROM c{k} JOIN (SELECT node, -{_GROWTH.rate}::DOUBLE * sum(g) / (sum(h) + {_GROWTH.ridge}::DOUBLE) AS step FROM c{k} WHERE split = 'train' GROUP BY node) USING (node))",
        ]
    return f"WITH rows AS MATERIALIZED ({_FEW_SQL}), " + ",\n".join(parts) + f"\nSELECT id, round(1 / (1 + exp(-margin)), 6) AS score FROM m{_GROWTH.rounds}"


@query(_trees_sql())
def leafwise_scores(spark, d):
    """Two leaf-wise trees fitted on train, their scores of all rows."""
    rows = written(_few_values(spark, d), "few-values")
    part = {s: rows.where(F.col("split") == s) for s in ("train", "val")}
    fitted = fit_leafwise(part["train"], part["val"], ["tens", "hour", "rest", "kind"], _GROWTH, weight=_WEIGHT)
    return rounded(fitted.transform(rows).select("id", model.vector_to_array("probability")[1].alias("score")))
