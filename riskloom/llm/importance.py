"""Importance resampling towards a target: hashed n-gram counts of both sides, weights from their ratio, a draw by Gumbel keys."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import id_back, id_text, materialize
from riskloom.llm.decontaminate import SEPARATORS

GRAMS, BUCKETS, MIN_WORDS, PERCENT, SALT = 1, 10_000, 20, 10, 2024
#: Letters and digits stay, A-Z as a-z; other ASCII parts words; bytes beyond ASCII belong to words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def word_bytes(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Shifts:
    """What appending n bytes does to the CRCs before them: a matrix over GF(2) for each n.

    A matrix is held as its 32 columns, whole numbers of 32 bits. That of n bytes is a product of those of powers of two, which come
    from the one of a zero bit by squaring. For use on many CRCs it is spread to four tables of 256, one for each byte of a CRC.
    """

    def __init__(self):
        bit = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)  # the reversed polynomial of CRC-32
        for _ in range(3):
            bit = self._apply(bit, bit)
        self.powers, self.places, self.tables = [bit], {}, np.empty((0, 4, 256), np.uint32)

    @staticmethod
    def _apply(columns: np.ndarray, crcs: np.ndarray) -> np.ndarray:
        """The matrix applied to each of ``crcs``: the XOR of the columns at its set bits."""
        bits = (crcs[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
        return np.bitwise_xor.reduce(bits * columns, axis=1)

    def _table(self, n: int) -> np.ndarray:
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)  # no byte: the identity
        for k in range(n.bit_length()):
            if k == len(self.powers):
                self.powers.append(self._apply(self.powers[-1], self.powers[-1]))
            if n >> k & 1:
                columns = self._apply(self.powers[k], columns)
        each = np.arange(256, dtype=np.uint32)
        return np.array([self._apply(columns, each << np.uint32(8 * i)) for i in range(4)])

    def join(self, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """CRCs of two byte strings after each other, from theirs and the second ones' lengths."""
        kinds, at = np.unique(lengths, return_inverse=True)
        new = [n for n in kinds.tolist() if n not in self.places]
        if new:
            self.places |= {n: len(self.places) + i for i, n in enumerate(new)}
            self.tables = np.concatenate([self.tables, *(self._table(n)[None] for n in new)])
        row = np.array([self.places[n] for n in kinds.tolist()], np.int64)[at]
        moved = self.tables[row, 0, left & 255]
        for i in range(1, 4):
            moved = moved ^ self.tables[row, i, (left >> np.uint32(8 * i)) & 255]
        return moved ^ right


def gram_crcs(words: Sequence[bytes], grams: int, shifts: Shifts) -> np.ndarray:
    """CRC-32 of every run of 1 to ``grams`` words joined by a space, by the number of words and then in order; no run is ever built."""
    crcs = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    if grams == 1 or len(words) < 2:
        return crcs
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    spaced = shifts.join(np.full(len(words), zlib.crc32(b" "), np.uint32), crcs, lengths)
    out = [crcs]
    for g in range(2, min(grams, len(words)) + 1):
        out.append(shifts.join(out[-1][:-1], spaced[g - 1 :], lengths[g - 1 :] + 1))
    return np.concatenate(out)


def bucket_counts(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts (text)`` fall in each bucket. A task sends one sum for each bucket."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shifts, total = Shifts(), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(gram_crcs(word_bytes(text), grams, shifts) % buckets, minlength=buckets)
        used = np.nonzero(total)[0]
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    counts = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInPandas(work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source share of each bucket, one added to each count, rounded down."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigher(gain: np.ndarray, grams: int) -> Callable:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shifts = Shifts()
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = word_bytes(text)
                crcs = gram_crcs(words, grams, shifts)
                out.append((len(words), len(crcs), int(gain[crcs % len(gain)].sum())))
            yield pd.concat([batch[["doc_id"]], pd.DataFrame(out, columns=["n_words", "n_features", "weight"], index=batch.index)], axis=1)

    return work


def resample(docs: DataFrame, target: DataFrame, *, grams: int = GRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, salt: int = SALT) -> DataFrame:
    """Draw ``percent`` of the rows of ``docs (doc_id, text, ...)`` so that their n-grams are spread like those of ``target (text, ...)``.

    Features are runs of 1 to ``grams`` words, counted in ``buckets`` by their CRC-32. A row's ``weight`` is the sum of its features'
    gains (``gains``), its ``score`` adds Gumbel noise that hangs on ``salt`` and doc_id alone, so the highest scores are a draw without
    replacement in proportion to exp(weight / 1000). Of the rows with ``min_words`` words the share ``percent`` is drawn. Returns one row per row
    of ``docs``: ``doc_id, n_features, weight, score, rank`` (from 1 by falling score, ties to the smaller id; null if not drawn).

    Ranks come from ranges of the order: each range is numbered in its own task and the counts of those before are added. Only bucket
    counts and range sizes reach the driver.

    Null texts and texts without words have no features, weight 0 and are never drawn unless ``min_words`` is 0. A null doc_id takes the noise of an empty id and comes last
    among ties; repeated rows have equal scores and each takes a rank of its own. Empty ``docs`` give no rows; an empty ``target`` has no counts, which is no error. Texts are taken whole; other columns are ignored.
    """
    gain = gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    weighed = id_back(docs.select(id_text("doc_id"), "text").mapInPandas(_weigher(gain, grams), "doc_id string, n_words bigint, n_features bigint, weight bigint"), "doc_id")
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")
    columns = {"score": F.col("weight") + noise, "eligible": F.col("n_words") >= min_words, "row": F.monotonically_increasing_id()}
    scored = materialize(weighed.withColumns(columns).drop("n_words"), "scores")

    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranges = materialize(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "score-ranges")
    sizes = sorted((r["part"], r["n"], r["k"]) for r in ranges.groupBy("part").agg(F.count("*").alias("n"), F.count_if("eligible").alias("k")).collect())  # a row for each range
    before = np.cumsum([0, *(n for _, n, _ in sizes)]).tolist()
    drawn = sum(k for *_, k in sizes) * percent // 100
    offsets = docs.sparkSession.createDataFrame([(p, b) for (p, *_), b in zip(sizes, before, strict=False)], "part int, before bigint")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    placed = ranges.join(F.broadcast(offsets), "part").withColumn("rank", place)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("eligible") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


def resampling_sql(buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, salt: int = SALT) -> str:
    """The query over single words in SQL. The CRC of a distinct word is folded over its bytes, eight steps of the polynomial each."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')".format(SEPARATORS.removesuffix("+").replace("[", "[^") + "+")
    bits = "c"
    for _ in range(8):
        bits = f"(SELECT xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END) FROM (SELECT {bits} AS x))"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
b AS MATERIALIZED (SELECT {words} AS w FROM benchmark),
dw AS MATERIALIZED (SELECT doc_id, unnest(w) AS w FROM d), bw AS MATERIALIZED (SELECT unnest(w) AS w FROM b),
t AS MATERIALIZED (SELECT c AS byte, {bits} AS step FROM (SELECT unnest(range(256)) AS c)),
v AS MATERIALIZED (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
f(w, h, i, c) AS (SELECT w, h, 0, 4294967295::BIGINT FROM v UNION ALL
  SELECT w, h, i + 1, xor(c >> 8, step) FROM f JOIN t ON byte = xor(c & 255, ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) WHERE 2 * i < len(h)),
k AS MATERIALIZED (SELECT w, xor(c, 4294967295) % {buckets} AS k FROM f WHERE 2 * i = len(h)),
s AS (SELECT k, count(*) AS s FROM dw JOIN k USING (w) GROUP BY k), u AS (SELECT k, count(*) AS t FROM bw JOIN k USING (w) GROUP BY k),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM u)::DOUBLE AS all_t),
g AS MATERIALIZED (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {buckets}) / ((s + 1)::DOUBLE * (all_t + {buckets}))))::BIGINT AS g FROM s LEFT JOIN u USING (k), n),
e AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM dw JOIN k USING (w) JOIN g USING (k) GROUP BY doc_id),
x AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{salt}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN e USING (doc_id)),
r AS (SELECT *, n_features >= {min_words} AS ok, row_number() OVER (PARTITION BY n_features >= {min_words} ORDER BY score DESC, doc_id) AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND place <= {percent} * (SELECT count(*) FROM x WHERE n_features >= {min_words}) // 100 THEN place END AS rank FROM r
"""
