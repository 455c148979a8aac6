"""Line deduplication over overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialize, maybe_broadcast, row_key

SPAN = 3


def _staying(lines: Column, covered: Column) -> Column:
    """The lines at other positions than ``covered``, in the time it takes to sort the positions: a log may have a million lines."""
    at = lambda positions, stays: F.transform(positions, lambda i: F.struct(i.alias("i"), F.lit(stays).alias("stays")))
    others = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    marks = F.sort_array(F.concat(at(others, True), at(covered, False)))
    return F.array_compact(F.zip_with(lines, marks, lambda line, mark: F.when(mark["stays"], line)))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later occurrences of repeated passages cut from ``text``.

    Lines end at ``\\n`` and are compared as they are. A window is three consecutive lines of a document, not all
    blank. Of equal windows anywhere in the table the first by (doc_id, text hash, line) stays; the lines that
    any later one covers are removed, so passages of three lines or more go whole, however their windows overlap.
    Every removed line stands at the same place of an earlier occurrence, so the first one always remains.

    Adds ``n_lines`` (lines of the text as given; null text: none) and ``n_removed`` (both replace columns of those
    names). An empty table gives an empty result. Texts of fewer than three lines, blank and null ones stay as they are; a text whose lines all go becomes
    empty. A null doc_id comes first in the order; rows that repeat an id and text whole count as one document and
    are treated alike. Other columns pass through.
    """
    split = F.split(F.col("text"), "\n")
    lines = docs.select(row_key().alias("doc"), split.alias("l"))
    each = lines.select("doc", "l", F.posexplode_outer("l").alias("pos", "first")).where(F.col("pos") + SPAN <= F.size("l"))
    three = [F.col("first"), *[F.get("l", F.col("pos") + k) for k in range(1, SPAN)]]
    windows = each.where(F.trim(F.concat(*three)) != "").select(F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit(1), *three).alias("h2"), F.struct("doc", "pos").alias("at"))
    windows = materialize(windows, "line-windows")
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("at").alias("kept")).where("n > 1").drop("n")
    later = windows.join(maybe_broadcast(materialize(repeated, "repeated-windows")), ["h1", "h2"]).where("at <> kept")
    covered = later.select("at.doc", F.explode(F.array(*[F.col("at.pos") + k for k in range(SPAN)])).alias("pos"))
    covered = materialize(covered.groupBy("doc").agg(F.collect_set("pos").alias("covered")), "covered-lines")

    named = docs.drop("n_lines", "n_removed")
    own = F.struct(*[F.col(f"`{c}`") for c in named.columns])  # so that no column can clash with those of the join
    joined = named.select(row_key().alias("doc"), own.alias("own")).join(maybe_broadcast(covered, "size(covered)"), "doc", "left")
    text = F.when(F.col("covered").isNull(), F.col("own.text")).otherwise(F.array_join(_staying(F.split(F.col("own.text"), "\n"), F.col("covered")), "\n"))
    out = [text.alias(c) if c == "text" else F.col(f"own.`{c}`") for c in named.columns]
    n_lines = F.when(F.col("own.text").isNull(), 0).otherwise(F.size(F.split(F.col("own.text"), "\n")))
    return joined.select(*out, n_lines.cast("bigint").alias("n_lines"), F.coalesce(F.size("covered"), F.lit(0)).cast("bigint").alias("n_removed"))


LINES_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, l[i] AS a, l[i + 1] AS b, l[i + 2] AS c FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 2)) AS i FROM d WHERE len(l) > 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS nth FROM w WHERE trim(a || b || c, ' ') <> ''),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE nth > 1) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string([l[i] for i in generate_series(1, len(l)) if not list_contains(gone, i)], chr(10)) END AS text
FROM d LEFT JOIN g USING (doc_id)
"""
