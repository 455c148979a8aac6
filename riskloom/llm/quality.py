"""Quality scores by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import id_back, id_text, materialize

#: At most so many trusted positives, and so many unlabelled documents, are used to fit.
FIT_ROWS = 20_000
CUT = 0.3
#: An estimated class prior stays within these.
PRIOR_BOUNDS = (0.02, 0.98)
FOLDS = 5
_HIDDEN, _STEPS, _BATCH, _RATE, _DECAY = 12, 700, 1024, 0.02, 1e-3

# Byte classes: lower, upper, digit, blank, newline, sentence end, bar, other ASCII marks, beyond ASCII, control.
_CLASS = np.full(256, 7)
for _chars, _n in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t", 3), (b"\n", 4), (b".!?", 5), (b"|", 6), (range(128, 256), 8), (range(9), 9), (range(14, 32), 9)):
    _CLASS[list(_chars)] = _n

FEATURES = [
    "log_bytes", "log_words", "log_lines", "lower", "upper", "digit", "blank", "newline", "stops", "bars", "marks", "beyond_ascii", "control",
    "byte_entropy", "mean_word", "std_word", "longest_word", "short_words", "capital_words", "distinct_words", "top_word", "same_as_last",
    "distinct_pairs", "distinct_lines", "mean_line", "marked_words", "deflated", "no_words",
]


def text_features(text: str | None) -> list[float]:
    """Shape of a whole text: make-up of its bytes, its words, repetition. No word or letter is known by itself."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(FEATURES) - 2) + [1.0]
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    shares = np.bincount(_CLASS, weights=counts, minlength=10) / len(raw)
    p = counts[counts > 0] / len(raw)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = len(words)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    return [
        np.log1p(len(raw)), np.log1p(n), np.log1p(len(lines)), shares[0], shares[1], shares[2], shares[3], shares[4], shares[5], shares[6], shares[7], shares[8], shares[9],
        float(-(p * np.log2(p)).sum()), lengths.mean(), lengths.std(), np.log1p(lengths.max()), (lengths <= 2).mean(), sum(map(bytes.istitle, words)) / n, len(seen) / n, max(seen.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(pairs) / max(n - 1, 1), len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)), sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n, len(zlib.compress(raw, 1)) / len(raw), 0.0,
    ]


def _featurize(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "x": [np.asarray(text_features(t), np.float32) for t in batch["text"]]})

    rows = docs.select(id_text("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return id_back(rows.mapInPandas(work, "doc_id string, text_hash bigint, x array<float>"), "doc_id")


class Scorer:
    """A small network fitted to the non-negative unbiased risk of positives and unlabelled rows."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        draw = np.random.default_rng(7)
        self.w = [draw.normal(0, 0.3, (len(mean), _HIDDEN)), np.zeros(_HIDDEN), draw.normal(0, 0.3, _HIDDEN), np.zeros(1), np.zeros(len(mean))]

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def _forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.w[0] + self.w[1])
        return h, h @ self.w[2] + self.w[3] + z @ self.w[4]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(self._scaled(x))[1], -30, 30)))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Scorer:
        """Minimise prior * E_P[loss+] + max(0, E_U[loss-] - prior * E_P[loss-]) with the logistic loss.

        When the second term falls below zero, its gradient is followed the other way (and the first left out),
        so that fitting noise cannot push it below what a risk may be. Without a prior the two samples are told apart, with
        equal weights.
        """
        p, u = self._scaled(positive), self._scaled(unlabelled)
        draw, m, v = np.random.default_rng(11), [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, _STEPS + 1):
            zp, zu = (z[draw.integers(0, len(z), _BATCH)] for z in (p, u))
            z = np.vstack([zp, zu])
            h, g = self._forward(z)
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            if prior is None:
                d = np.concatenate([s[:_BATCH] - 1, s[_BATCH:]]) / _BATCH
            else:
                loss_minus = np.logaddexp(0, np.clip(g, -30, 30))
                negative = loss_minus[_BATCH:].mean() - prior * loss_minus[:_BATCH].mean()
                d_negative = np.concatenate([-prior * s[:_BATCH], s[_BATCH:]]) / _BATCH
                d_positive = np.concatenate([prior * (s[:_BATCH] - 1), np.zeros(_BATCH)]) / _BATCH
                d = d_positive + d_negative if negative >= 0 else -d_negative
            back = np.outer(d, self.w[2]) * (1 - h**2)
            grads = [z.T @ back, back.sum(0), h.T @ d, d.sum(keepdims=True), z.T @ d]
            rate = _RATE * (1 - step / (_STEPS + 1))
            for i, grad in enumerate(grads):
                grad = grad + _DECAY * self.w[i] * (i != 3)
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from scores that rank positives higher.

    Above any score, positives alone would stand in the ratio of the two samples' shares, and others only add: so the least
    ratio bounds the share from above. The score is chosen at which ratio and its sampling error together are least; a standard
    error is added, as too small a share costs good text and too large a one lets some bad text pass.
    """
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    above = [1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x) for x in (positive, unlabelled)]
    error = 1.01 * sum(math.sqrt(math.log(40) / (2 * len(x))) for x in (positive, unlabelled))
    some = above[0] > 0
    p, u = above[0][some], above[1][some]
    at = np.argmin((u + error) / p)
    a, b = u[at], p[at]
    deviation = math.sqrt(a * (1 - a) / len(unlabelled) + (a / b) ** 2 * b * (1 - b) / len(positive)) / b
    return float(np.clip(a / b + deviation, *PRIOR_BOUNDS))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, std: np.ndarray) -> float:
    """The class prior of ``unlabelled`` from it and the positives alone: scores fitted on one half judge the other, both ways."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    found = []
    for fit, judge in ((0, 1), (1, 0)):
        scorer = Scorer(mean, std).fit(positive[fit::2], unlabelled[fit::2], None)
        found.append(best_bin(scorer.scores(positive[judge::2]), scorer.scores(unlabelled[judge::2])))
    return sum(found) / 2


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, cut: float = CUT) -> DataFrame:
    """Quality of every whole text of ``docs (doc_id, text, ...)``, as ``labels (doc_id, quality)`` marks it.

    Returns one row per input row: ``doc_id, held_out, score, predicted`` (score >= ``cut``), and ``text_hash``.
    Rows whose crc32(doc_id as text) mod 5 is 0 are held out: the fit uses neither their labels nor their texts.
    Of the others, those labelled 1 are the trusted positives and those without a label the unlabelled text
    (all others where every row has a label); at most ``fit_rows`` of each, those with the smallest hash of the id,
    go to the driver as rows of 28 numbers. The class prior is estimated from these two samples (``estimate_prior``); labels of
    0 are used nowhere, but that an id labelled both ways counts as not labelled. Means and deviations, which scale the
    features, are taken over the texts of all documents.

    Null and empty texts get a score like others, texts of any length are read whole. Null ids are never held out or
    learnt from. Of an id that repeats with several texts the one with the smallest hash is learnt from. Without
    positives or unlabelled rows all scores are 0.5. Repeated rows give repeated results; an empty table gives an empty
    result; other columns, of either table, are ignored.
    """
    features = materialize(_featurize(docs), "text-features")
    n = len(FEATURES)
    marks = labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int")).where(~_held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality")
    learnable = features.where(~_held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min_by("x", "text_hash").alias("x"))
    known = learnable.join(marks, "doc_id", "left")

    def bounded(df: DataFrame) -> np.ndarray:
        got = df.orderBy(F.xxhash64("doc_id"), "doc_id").select("x").limit(fit_rows).toArrow().column("x").combine_chunks()
        return got.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)

    positive, unlabelled = bounded(known.where("quality = 1")), bounded(known.where("quality is null"))
    if not len(unlabelled):
        unlabelled = bounded(known)
    out = features.withColumn("held_out", _held_out())
    if len(positive) and len(unlabelled):
        moments = features.select(*[f(F.col("x")[i].cast("double")) for f in (F.avg, F.stddev_pop) for i in range(n)]).first()
        mean, std = np.array(moments[:n]), np.array(moments[n:])
        scorer = Scorer(mean, std).fit(positive, unlabelled, estimate_prior(positive, unlabelled, mean, std))

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(scorer.scores(np.stack(x.to_numpy()).astype(np.float64)) if len(x) else [], dtype="float64")

        out = out.withColumn("score", score("x"))
    else:
        out = out.withColumn("score", F.lit(0.5))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"), "text_hash")
