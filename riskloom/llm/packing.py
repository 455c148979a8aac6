"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import id_back, id_text, materialize

#: Permitted sequence lengths, what each sequence costs besides its length, and pieces packed together in one task.
SIZES = (256, 512, 1024, 2048)
OVERHEAD = 8
GROUP_PIECES = 20_000


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def best_fit(lengths: Sequence[int], open_size: Callable[[int, int], int]) -> list[int]:
    """The bin of each piece, in the order given: the open bin it fills best; if none has room, a new one.

    ``open_size(i, n)`` gives the size, at least n, of the bin that is opened for piece i. Of bins with equal room the
    one opened first is taken.
    """
    bins, room, free, out = 0, {}, [], []  # room -> bins that have it; free: rooms in order
    for i, n in enumerate(lengths):
        at = bisect_left(free, n)
        if at < len(free):
            left = free[at]
            chosen = room[left].pop(0)
            if not room[left]:
                del room[left], free[at]
        else:
            left, chosen, bins = open_size(i, n), bins, bins + 1
        left -= n
        if left:
            if left in room:
                insort(room[left], chosen)
            else:
                room[left] = [chosen]
                insort(free, left)
        out.append(chosen)
    return out


class LeastCost:
    """Chooses the size of each bin as it is opened: the least expected cost for each token it will hold.

    What a bin will hold is expected from the pieces still to come, in decreasing order: the largest that fits, again and
    again. It is then downsized. Of equal costs the larger size wins.
    """

    def __init__(self, lengths: Sequence[int], sizes: Sequence[int], overhead: int):
        self.sizes, self.overhead = sizes, overhead
        values, firsts = np.unique(-np.asarray(lengths, np.int64), return_index=True)
        self.values, self.ends = values.tolist(), [*firsts[1:].tolist(), len(lengths)]  # negated, so ascending; where each value's pieces end
        self.starts = firsts.tolist()

    def expected(self, i: int, n: int, size: int) -> int:
        """Tokens in a bin of ``size`` opened for piece i of length n."""
        room, k = size - n, bisect_left(self.values, -n)
        while room:
            k = bisect_left(self.values, -room, k)
            if k == len(self.values):
                break
            left = self.ends[k] - max(self.starts[k], i + 1)
            room += self.values[k] * min(left, room // -self.values[k])
            k += 1
        return size - room

    def __call__(self, i: int, n: int) -> int:
        best = None
        for size in reversed(self.sizes):
            if size < n:
                break
            used = self.expected(i, n, size)
            cost = self.sizes[bisect_left(self.sizes, used)] + self.overhead
            if best is None or cost * best[1] < best[0] * used:
                best = (cost, used, size)
        return best[2]


def pack_group(lengths: Sequence[int], sizes: Sequence[int], overhead: int) -> tuple[list[int], list[int], int]:
    """Bins of the pieces (in decreasing order) and the final size of each bin.

    Each bin is opened at the size of least expected cost (``LeastCost``) and at the end downsized to its contents. A sequence
    costs its size plus ``overhead``. Opening all bins at one size, for each permitted one, is tried besides; the cheapest
    whole is taken, of equal ones the first.
    """
    ways = [LeastCost(lengths, sizes, overhead)] if len(lengths) else []
    ways += [lambda i, n, opened=opened: sizes[bisect_left(sizes, max(n, opened))] for opened in reversed(sizes)]
    best = None
    for way in ways:
        at = best_fit(lengths, way)
        used = np.bincount(at, weights=lengths).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        final = np.asarray(sizes)[np.searchsorted(sizes, used)]
        cost = int(final.sum() + overhead * len(final))
        if best is None or cost < best[2]:
            best = (at, final.tolist(), cost)
    return best


def _numbered(rows: DataFrame, step: int = 1_000) -> DataFrame:
    """A row for each of the ``copies``, numbered from 0 by ``copy``: exploded twice, so that no long array is made."""
    blocks = rows.withColumn("copy", F.explode(F.expr(f"sequence(0L, copies - 1, {step}L)")))
    return blocks.withColumn("copy", F.explode(F.expr(f"sequence(copy, least(copy + {step - 1}L, copies - 1))"))).drop("copies")


def pack(docs: DataFrame, *, length: Column | None = None, sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack every document of ``docs (doc_id, text, ...)`` into sequences of permitted ``sizes``.

    ``length`` gives a document's tokens (words by default). Documents longer than the largest size are cut into
    pieces of it and a rest. Pieces are dealt by a hash to groups of about ``group_pieces``, whose number
    follows the input, and each group is packed in decreasing order of length (see ``pack_group``).

    Returns a row for each piece: ``doc_id, n_tokens, piece, start, length, bin_id, offset, bin_used, bin_size``;
    ``bin_id`` is unique over all groups. Null, empty and blank texts have one piece of length 0 and no bin (nulls).
    Null ids and repeated rows are packed like others: pieces of one id are told apart by their texts, those of rows
    repeated whole by a number, so that no id fills a group. Texts of any length are taken whole; an empty table gives an
    empty result; other columns are ignored. The result depends on ids, texts and lengths only, not on how the table is
    laid out; rows repeated whole share their places in some order.
    """
    sizes = sorted(set(sizes))
    if not sizes or sizes[0] < 1 or overhead < 0:
        raise ValueError("sizes must be positive and the overhead not negative")
    top = sizes[-1]
    n = F.greatest(F.coalesce(length if length is not None else word_count(F.col("text")), F.lit(0)), F.lit(0)).cast("bigint")
    text = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint"), n.alias("n_tokens"), text.alias("hash"))
    counted = _numbered(rows.groupBy("doc_id", "n_tokens", "hash").agg(F.count("*").alias("copies")))
    pieces = counted.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / top) - 1, F.lit(0)).cast("int"))).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece").cast("bigint") * top)
    pieces = materialize(pieces.withColumn("length", F.least(F.lit(top), F.col("n_tokens") - F.col("start"))), "pieces")
    groups = max(1, -(-pieces.where("length > 0").count() // group_pieces))

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame["number"] = pd.array([None if x is None else int(x) for x in frame["doc_id"]], "Int64")
        frame = frame.sort_values(["length", "number", "piece", "n_tokens"], ascending=[False, True, True, True], kind="stable", na_position="first")
        at, final, _ = pack_group(frame["length"].tolist(), sizes, overhead)
        frame["bin_id"] = np.int64(key[0] << 32) + np.asarray(at, np.int64)
        frame["bin_size"] = np.asarray(final, np.int64)[at]
        frame["offset"] = frame.groupby("bin_id")["length"].cumsum() - frame["length"]
        frame["bin_used"] = frame.groupby("bin_id")["length"].transform("sum")
        return frame[["doc_id", "n_tokens", "piece", "start", "length", "bin_id", "offset", "bin_used", "bin_size"]]

    schema = "doc_id string, n_tokens bigint, piece int, start bigint, length bigint, bin_id bigint, offset bigint, bin_used bigint, bin_size bigint"
    dealt = pieces.where("length > 0").withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "hash", "copy"), F.lit(groups))).drop("hash", "copy")
    packed = id_back(dealt.withColumn("doc_id", id_text("doc_id")).groupBy("group").applyInPandas(work, schema), "doc_id")
    none = F.lit(None).cast("bigint")
    empty = pieces.where("length = 0").select("doc_id", "n_tokens", "piece", "start", "length", *[none.alias(c) for c in ("bin_id", "offset", "bin_used", "bin_size")])
    return packed.union(empty)
