"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower, materialize, maybe_broadcast, row_key

#: Everything that isn't an ASCII letter, an ASCII digit or beyond ASCII parts words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
#: Bits of the map that tells which shingles a large benchmark can have: 64 in a row, so a million rows at most.
MAP_BITS = 1 << 26


def words(col):
    return F.array_remove(F.split(ascii_lower(F.coalesce(col, F.lit(""))), SEPARATORS), "")


def _shingle(array: str, at: str, first: str, width: int):
    """Hash of ``width`` words of ``array`` from position ``at`` (0-based), whose first word is at hand."""
    return F.xxhash64(F.col(first), *[F.get(F.col(array), F.col(at) + k) for k in range(1, width)])


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows: the words joined by spaces, their number, shingle width and shingle hashes in order."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumns({"length": F.least(F.lit(window), F.size("w")), "width": F.least(F.lit(SHINGLE), F.size("w"))})
    starts = items.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("i"))
    return starts.select("item_id", "length", "width", F.slice("w", F.col("i"), F.col("length")).alias("w")).withColumn("window", F.array_join("w", " "))


def _tokens(windows: DataFrame) -> DataFrame:
    """``(window, length, width, j, token)``: each shingle of each window with its offset."""
    each = windows.select("window", "length", "width", "w").dropDuplicates(["window"]).select("*", F.posexplode("w").alias("j", "first"))
    token = F.when(F.col("width") == 1, _shingle("w", "j", "first", 1)).when(F.col("width") == 2, _shingle("w", "j", "first", 2)).otherwise(_shingle("w", "j", "first", 3))
    return each.where(F.col("j") + F.col("width") <= F.col("length")).select("window", "length", "width", "j", token.alias("token"))


def _known_only(rows: DataFrame, vocabulary: DataFrame, limit: int | None = None) -> DataFrame:
    """The ``rows (token, ...)`` whose token is in ``vocabulary (token)``, a written table.

    A small vocabulary goes to every task. Of a larger one a bit map goes there first, whose size is bounded, so that few rows of others reach the shuffled join.
    """
    known = maybe_broadcast(vocabulary, limit=limit)
    if known is not vocabulary:
        return rows.join(known, "token")
    bit = F.pmod(F.xxhash64("token"), F.lit(MAP_BITS))
    row, place = F.shiftright(bit, 6), bit.bitwiseAND(63).cast("int")
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
    bits = vocabulary.groupBy(row.alias("row")).agg(F.bit_or(one(place)).alias("bits"))
    some = rows.withColumn("row", row).join(F.broadcast(bits), "row").where(F.col("bits").bitwiseAND(one(place)) != 0)
    return some.drop("row", "bits").join(vocabulary, "token")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, limit: int | None = None) -> DataFrame:
    """Where windows of benchmark items occur in documents, word for word.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
    Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII. Returns one row per row of
    ``docs (doc_id, text, ...)``: ``doc_id, n_words, n_hit`` (words inside any occurrence), ``n_items`` (items with
    an occurring window), ``items_sha256`` (of their ids, sorted as strings, joined by commas), ``contaminated, text_hash``.

    One pass over the texts keeps the positions of three-word shingles that the benchmark has at all; the same
    pass counts words. Shingles are then ordered by how often the whole corpus has them: containment of a
    whole window needs every one of its shingles, so a prefix of one, the rarest, finds all candidates.
    Those within the document's bounds are verified shingle by shingle. What of the benchmark is within ``limit`` (``BROADCAST_ROWS``) goes to every
    task; beyond that a bit map of its shingles does (``_known_only``), and the joins are shuffled.

    An item without an id counts as one of the ``n_items`` and has no id in ``items_sha256``. Null texts, texts without words and
    an empty benchmark give no hits; empty ``docs`` give no rows. Rows that
    repeat an id and text whole give equal rows; a null doc_id is an id like others. Texts of any length are read whole. Other columns are ignored.
    """
    windows = materialize(_windows(benchmark, window), "windows")
    tokens = materialize(_tokens(windows), "window-tokens")
    widths = [r[0] for r in tokens.select("width").distinct().collect()] or [SHINGLE]  # of 1, 2 and 3

    # The element after the last word marks the end: every document keeps that row, which carries its word count.
    end = F.lit(None).cast("string")
    text = docs.select(row_key().alias("doc"), words(F.col("text")).alias("w"))
    text = text.select("doc", "w", F.posexplode_outer(F.concat("w", F.array(end))).alias("pos", "first"))
    found = []
    for width in sorted(widths, reverse=True):
        vocabulary = tokens.where(F.col("width") == width).select("token").distinct()
        if width == max(widths):
            vocabulary = vocabulary.union(docs.sparkSession.sql("select 0L")).distinct()
        token = F.when(F.col("first").isNull(), F.lit(0)).otherwise(_shingle("w", "pos", "first", width))
        rows = text.select("doc", "pos", "first", F.size("w").alias("n_words"), token.alias("token"))
        found.append(_known_only(rows, materialize(vocabulary, "vocabulary"), limit).select("doc", "pos", "n_words", F.col("first").isNull().alias("end"), "token", F.lit(width).alias("width")))
    hits = materialize(_all(found), "hits")
    at = hits.where("not end").select("doc", "pos", "n_words", "token", "width")

    heavy = "1 + octet_length(window) div 32"
    rarity = materialize(at.groupBy("token", "width").agg(F.count("*").alias("n")), "rarity")
    ranked = tokens.join(maybe_broadcast(rarity, limit=limit), ["token", "width"])
    prefix = ranked.groupBy("window", "length", "width").agg(F.min_by(F.struct("token", "j"), F.struct("n", "j")).alias("p")).select("window", "length", "width", "p.*")
    prefix = materialize(prefix, "prefixes")
    candidates = at.join(maybe_broadcast(prefix, heavy, limit), ["token", "width"]).select("doc", (F.col("pos") - F.col("j")).alias("start"), "window", "length", "n_words")
    candidates = candidates.where("start >= 0 and start + length <= n_words").select("doc", "start", "window").distinct()
    needed = candidates.join(maybe_broadcast(tokens, heavy, limit), "window").select("doc", "start", "window", "length", "width", (F.col("start") + F.col("j")).alias("pos"), "token")
    there = needed.join(at.select("doc", "pos", "token", "width"), ["doc", "pos", "token", "width"], "left_semi")
    occurs = materialize(there.groupBy("doc", "start", "window", "length", "width").agg(F.count("*").alias("n")).where("n = length - width + 1"), "occurrences")

    covered = occurs.select("doc", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    holders = materialize(windows.select("window", "item_id").distinct(), "window-items")
    pairs = occurs.select("doc", "window").distinct().join(maybe_broadcast(holders, heavy, limit), "window").select("doc", "item_id").distinct()
    items = pairs.groupBy("doc").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("ids"))
    per_doc = covered.join(items, "doc", "left")

    ends = hits.where("end").select("doc", F.col("n_words").cast("bigint").alias("n_words")).join(per_doc, "doc", "left")
    zero = F.lit(0).cast("bigint")
    return ends.select(
        "doc.doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "doc.text_hash",
    )


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS l, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
       FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - {WINDOW}, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS win
       FROM (SELECT doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
occ AS (SELECT dw.doc_id, dw.i, dw.l, bw.item_id FROM dw JOIN bw USING (l, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
