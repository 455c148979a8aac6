"""Vector codes: each part of a vector is named by the nearest entry of that part's codebook of whole numbers, fitted in rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialize, maybe_broadcast

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows whose distances to all entries are held at once.
_STEP = 4096


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part and its squared distance: two arrays (parts, rows).

    ``vectors`` is (rows, parts, width), ``books`` (parts, entries, width), both int64. |v - c|^2 = |v|^2 - 2vc + |c|^2 is exact
    where it fits 63 bits, even if a term wraps. Of equal distances the first entry is taken.
    """
    v = np.ascontiguousarray(vectors.transpose(1, 0, 2))
    away = (v * v).sum(axis=2)[:, :, None] - 2 * (v @ books.transpose(0, 2, 1)) + (books * books).sum(axis=2)[:, None, :]
    nearest = away.argmin(axis=2)
    return nearest, np.take_along_axis(away, nearest[:, :, None], axis=2)[:, :, 0]


def _matrix(batch: pa.RecordBatch, parts: int, at: int = 0) -> np.ndarray:
    rows = batch.column("v")[at : at + _STEP]
    return rows.flatten().to_numpy().reshape(len(rows), parts, -1)


def _sums(books: np.ndarray) -> Callable:
    """For each entry that a task's parts were assigned to: the sum of each position and the number of parts."""
    parts, entries, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                vectors = _matrix(batch, parts, at)
                chosen = (assign(vectors, books)[0][:, None, :] == np.arange(entries)[None, :, None]).astype(np.int64)
                total += chosen @ vectors.transpose(1, 0, 2)
                used += chosen.sum(axis=2)
        p, e = np.nonzero(used)
        cells = [np.repeat(x, width) for x in (p, e)] + [np.tile(np.arange(width), len(p)), total[p, e].reshape(-1), np.repeat(used[p, e], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["part", "entry", "position", "total", "n"])

    return work


def _codes(books: np.ndarray) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for at in range(0, batch.num_rows, _STEP):
                nearest, away = assign(_matrix(batch, len(books), at), books)
                codes += [row.tobytes().hex() for row in np.ascontiguousarray(nearest.T.astype(np.uint8))]
                errors.append(away.sum(axis=0))
            found = [pa.array(codes, pa.string()), pa.array(np.concatenate(errors or [np.empty(0, np.int64)]))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *found], names=["vec_id", "label", "code", "error"])

    return work


def whole_vectors(vectors: DataFrame, column: str, parts: int, scale: int) -> DataFrame:
    """``(vec_id, label, v)``: the vectors that can be coded, as whole numbers floor(scale * x), with zeros up to a multiple of ``parts``."""
    present = vectors.select(F.col("vec_id").cast("bigint"), "label", F.col(column).cast("array<double>").alias("x"))
    present = present.where(F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    length = present.groupBy(F.size("x").alias("length")).count().agg(F.max_by("length", F.struct("count", "length"))).first()[0]
    if not length:
        return present.where(F.lit(False)).select("vec_id", "label", F.array().cast("array<bigint>").alias("v"))
    most = int((2**61 / length) ** 0.5)
    coded = present.where(F.size("x") == length).where(F.forall("x", lambda x: F.abs(x * scale) < most))
    return coded.select("vec_id", "label", F.concat(F.transform("x", lambda x: F.floor(x * scale).cast("bigint")), F.array_repeat(F.lit(0).cast("bigint"), -length % parts)).alias("v"))


def first_books(kept: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The vectors of the smallest ids, cut into parts: (parts, entries, width); None without rows."""
    ids = [r[0] for r in kept.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    rows = kept.where(F.col("vec_id").isin(ids)) if ids else kept
    least = [r["v"] for r in rows.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()]  # a row for each of the entries
    return np.array(least, np.int64).reshape(len(least), parts, -1).transpose(1, 0, 2).copy() if least else None


def fit_books(kept: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after ``rounds`` of assigning every part and moving each entry to the floor of its parts' mean; unused entries stay."""
    cells = "part bigint, entry bigint, position bigint, total bigint, n bigint"
    for _ in range(rounds):
        sums = kept.select("v").mapInArrow(_sums(books), cells).groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in sums.collect():  # as many rows as the codebooks have numbers
            books[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, *, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Codes of the vectors of ``vectors (vec_id, label, <column>, ...)``.

    Components become floor(scale * x); each of ``parts`` equal parts has a codebook of ``entries`` entries, at first those of
    the smallest vec_ids, then moved in ``rounds`` rounds to the floor of the mean of the parts nearest to them (squared
    distance, ties to the lower index). Returns one row per coded vector: ``vec_id, code`` (two hex digits a part), ``error``
    (squared distances, summed), ``label_error`` (``error`` summed over the label, nulls together), ``codebooks_sha256``.

    The codebooks (parts * entries * width numbers, whatever the table's size) go to the tasks; a task sends one sum for each of
    their numbers back into the shuffle, so neither a label nor a vector that many rows share makes a large group.

    Left out: null vectors, those with null or infinite components or NaN, those of another length than most (of two lengths as frequent
    the longer one counts) and those with components so large that a distance could pass 63 bits (2^61 / length, root, after scaling; 46,000
    for 64 components). Empty vectors, if most are, and empty tables give an empty result. A length that ``parts`` doesn't divide
    is filled with zeros. A null vec_id is coded and starts no entry, unless no row has an id; an id that
    repeats starts one entry, with its least vector. With fewer ids than ``entries`` the codebooks are shorter. Repeated rows give repeated results; other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    kept = materialize(whole_vectors(vectors, column, parts, scale), "whole-vectors")
    books = first_books(kept, parts, entries)
    if books is not None:
        books = fit_books(kept, books, rounds)
    kind = kept.schema["label"].dataType.simpleString()
    codes = _codes(books if books is not None else np.zeros((parts, 1, 1), np.int64))
    coded = materialize(kept.mapInArrow(codes, f"vec_id bigint, label {kind}, code string, error bigint"), "codes")
    per_label = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = coded.join(maybe_broadcast(per_label, "1 + octet_length(coalesce(cast(of as string), '')) / 64"), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books) if books is not None else "").alias("codebooks_sha256"))


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The query in SQL: one pair of steps (assign, move) for each round."""
    floor_mean = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
    steps = [
        f"q AS MATERIALIZED (SELECT vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, m, v[m * (len(v) // {parts}) + 1 : (m + 1) * (len(v) // {parts})] AS v FROM q, (SELECT unnest(range({parts})) AS m))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM q ORDER BY vec_id LIMIT {entries}))",
        "c0 AS MATERIALIZED (SELECT m, e, v AS c FROM p JOIN f USING (vec_id))",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS MATERIALIZED (SELECT vec_id, m, any_value(label) AS label, any_value(v) AS v, min({{'d': d, 'e': e}}) AS best FROM (SELECT p.*, e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, c)])::BIGINT AS d FROM p JOIN c{k} USING (m)) GROUP BY vec_id, m)"
        )
        if k < rounds:
            steps.append(
                f"c{k + 1} AS MATERIALIZED (SELECT m, e, coalesce(n.c, c{k}.c) AS c FROM c{k} LEFT JOIN (SELECT m, e, list(x ORDER BY i) AS c FROM (SELECT m, e, i, {floor_mean} AS x FROM (SELECT m, best.e AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY m, e, i) GROUP BY m, e) n USING (m, e))"
            )
    steps.append(f"r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY m) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY m, e)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, h"
