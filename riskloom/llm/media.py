"""Media columns: lossless PNG in binary columns, and low-frequency cosine hashes of what is read back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import id_back, id_text, materialize

#: Bytes in a row of the image; payloads are padded to a multiple of it.
WIDTH = 64
#: Fixed values of the format: the signature; colour type 0 (grey), 8 bits a sample.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
_HEADER = struct.Struct(">IIBBBBB")
_CHUNK = 1 << 16
#: Deflate's effort; rows that are filtered at once; bytes of payload that are handled together, so that memory is bounded.
LEVEL, _ROWS_AT_ONCE, _TOGETHER = 4, 1 << 14, 1 << 22
_SIDE, _LOW = 32, 8

_K = np.arange(_SIDE)
_COSINES = np.cos(np.pi * (2 * _K[None, :] + 1) * np.arange(_LOW)[:, None] / (2 * _SIDE))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _predicted(left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What filter 4 predicts: of left, above and corner the one nearest to left + above - corner, in this order of preference."""
    guess = left + above - corner
    d_left, d_above, d_corner = np.abs(guess - left), np.abs(guess - above), np.abs(guess - corner)
    return np.where((d_left <= d_above) & (d_left <= d_corner), left, np.where(d_above <= d_corner, above, corner))


def filter_rows(rows: np.ndarray, first: np.ndarray, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The filter of each row of 8-bit samples and the rows after it: 0 none, 1 left, 2 above, 3 their mean, 4 see ``_predicted``.

    ``first`` marks each image's first row. Without ``kinds`` each row takes the filter that leaves the fewest distinct values, of
    equal ones the first: that serves deflate better on text than the least sum of magnitudes, which suits photographs.
    """
    if kinds is None:
        kinds = np.empty(len(rows), np.int64)
        chosen = None
    else:
        chosen = kinds
    out = np.empty_like(rows)
    for lo in range(0, len(rows), _ROWS_AT_ONCE):
        hi = min(lo + _ROWS_AT_ONCE, len(rows))
        x = rows[lo:hi].astype(np.int16)
        left, above, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
        left[:, 1:], above[1:] = x[:, :-1], x[:-1]
        if lo:
            above[0] = rows[lo - 1]
        above[first[lo:hi]] = 0
        corner[:, 1:] = above[:, :-1]
        residues = [(x - by).astype(np.uint8) for by in (0, left, above, (left + above) // 2, _predicted(left, above, corner))]
        if chosen is None:
            kinds[lo:hi] = np.argmin([np.count_nonzero(np.diff(np.sort(r, axis=1), axis=1), axis=1) for r in residues], axis=0)
        out[lo:hi] = np.stack(residues)[kinds[lo:hi], np.arange(hi - lo)]
    return kinds, out


def unfilter_rows(rows: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Undo ``filter_rows`` for many images at once.

    A sample needs those to its left and above it, so samples are done along diagonals: in each step every row takes its next
    sample, one behind the row above. Rows that don't need the row above (filters 0 and 1, first rows) start anew, all of them
    at step 0.
    """
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    n, width = rows.shape
    at = np.arange(n)
    start = first | (kinds <= 1)
    depth = at - np.maximum.accumulate(np.where(start, at, 0))
    order = np.argsort(depth, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = at
    above_row = np.where(first[order], n, place[order - 1]) * (width + 1)  # row n stays 0, as does column 0
    depth, kind, source = depth[order], kinds[order], rows[order].ravel()
    flat = np.zeros((n + 1) * (width + 1), np.int16)
    ends = np.searchsorted(depth, np.arange(-width, depth[-1] + width + 1) if n else [], side="right")
    for t in range(int(depth[-1]) + width if n else 0):
        lo, hi = ends[t], ends[t + width]  # rows of depth t - width + 1 to t
        if lo == hi:
            continue
        c = t - depth[lo:hi]
        here = at[lo:hi] * (width + 1) + c
        left, above, corner, k = flat[here], flat[above_row[lo:hi] + c + 1], flat[above_row[lo:hi] + c], kind[lo:hi]
        by = np.where(k == 4, _predicted(left, above, corner), np.where(k == 3, (left + above) >> 1, np.where(k == 2, above, np.where(k == 1, left, 0))))
        flat[here + 1] = (source[at[lo:hi] * width + c] + by) & 255
    return flat[: n * (width + 1)].reshape(n, width + 1)[place, 1:].astype(np.uint8)


def encode_png(rows: np.ndarray, kinds: np.ndarray, level: int = LEVEL) -> bytes:
    """A grey PNG of rows of samples that are already filtered."""
    packed = zlib.compress(np.hstack([kinds.astype(np.uint8)[:, None], rows]).tobytes(), level)
    data = b"".join(_chunk(b"IDAT", packed[i : i + _CHUNK]) for i in range(0, len(packed), _CHUNK))
    return SIGNATURE + _chunk(b"IHDR", _HEADER.pack(rows.shape[1], len(rows), 8, 0, 0, 0, 0)) + data + _chunk(b"IEND", b"")


def encode_images(payloads: Sequence[bytes], kind: int | None = None) -> list[bytes]:
    """A PNG of ``WIDTH`` columns for each payload (a positive multiple of that long), every row under its best filter or under ``kind``."""
    counts = [len(p) // WIDTH for p in payloads]
    ends = np.cumsum(counts)
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH)
    first = _firsts(counts)
    kinds, body = filter_rows(rows, first, None if kind is None else np.full(len(rows), kind))
    return [encode_png(body[e - n : e], kinds[e - n : e]) for n, e in zip(counts, ends, strict=True)]


def _firsts(counts: Sequence[int]) -> np.ndarray:
    first = np.zeros(sum(counts), bool)
    first[np.cumsum([0, *counts[:-1]])[: len(counts)]] = True
    return first


def decode_images(images: Sequence[bytes]) -> list[np.ndarray]:
    """The samples of each image; images of one width are unfiltered together."""
    raw = [read_png(m) for m in images]
    out: list[np.ndarray] = [r[:, 1:] for r in raw]
    for width in {r.shape[1] for r in raw}:
        those = [i for i, r in enumerate(raw) if r.shape[1] == width and len(r)]
        if those:
            whole = np.vstack([raw[i] for i in those])
            counts = [len(raw[i]) for i in those]
            samples = unfilter_rows(whole[:, 1:], _firsts(counts), whole[:, 0].astype(np.int64))
            for i, part in zip(those, np.split(samples, np.cumsum(counts)[:-1]), strict=True):
                out[i] = part
    return out


def read_png(media: bytes) -> np.ndarray:
    """The rows of an 8-bit grey PNG, each its filter and its filtered samples; ValueError if a checksum, size or mark is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, parts = 8, None, []
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(data) != n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise ValueError(f"chunk {kind!r} is damaged")
        at += 12 + n
        if kind == b"IHDR":
            header = _HEADER.unpack(data)
        elif kind == b"IDAT":
            parts.append(data)
        elif kind == b"IEND":
            break
    else:
        raise ValueError("no end mark")
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlace")
    width, height = header[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    return raw.reshape(height, width + 1)


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as hex: which low-frequency cosine coefficients of the image, shrunk to 32 x 32 by means, exceed their median."""
    total = np.zeros((len(image) + 1, image.shape[1]))
    np.cumsum(image, axis=0, out=total[1:])
    cuts = np.linspace(0, len(image), _SIDE + 1)
    low = np.minimum(cuts.astype(np.int64), len(image) - 1)
    sums = total[low] + (cuts - low)[:, None] * image[low]
    rows = np.diff(sums, axis=0) * (_SIDE / len(image))
    small = rows.reshape(_SIDE, _SIDE, -1).mean(axis=2)
    c = (_COSINES @ small @ _COSINES.T).ravel().round(6)
    return np.packbits(c > np.median(c[1:])).tobytes().hex()


def _runs(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that together have about ``_TOGETHER`` bytes, or one that alone has more."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > _TOGETHER:
            yield lo, i
            lo, total = i, 0
        total += n
    if len(sizes) > lo:
        yield lo, len(sizes)


def store_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every text of ``docs`` as a PNG in a binary column.

    The payload is the text in UTF-8 (null: empty) with bytes 0 up to a positive multiple of 64. Each row of the image has
    the filter that suits it best (see ``filter_rows``).
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            media = []
            for lo, hi in _runs([len(r) for r in raw]):
                media += encode_images([r + b"\0" * (-len(r) % WIDTH or (0 if r else WIDTH)) for r in raw[lo:hi]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(r) for r in raw], "media": media})

    return id_back(docs.select(id_text("doc_id"), "text").mapInPandas(work, "doc_id string, n_bytes bigint, media binary"), "doc_id")


def media_features(stored: DataFrame) -> DataFrame:
    """Digests and cosine hash of the stored images ``(doc_id, n_bytes, media)``, from their bytes as read back."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            images = (x for lo, hi in _runs((batch["n_bytes"] + WIDTH).tolist()) for x in decode_images(batch["media"].iloc[lo:hi].tolist()))
            for media, image in zip(batch["media"], images, strict=True):
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image)))
            frame = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            frame.insert(0, "n_bytes", batch["n_bytes"])
            frame.insert(0, "doc_id", batch["doc_id"])
            yield frame

    schema = "doc_id string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return id_back(stored.select(id_text("doc_id"), "n_bytes", "media").mapInPandas(work, schema), "doc_id")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text of ``docs (doc_id, text, ...)`` as a PNG, read the stored bytes back and describe them.

    One row per input row: ``doc_id, n_bytes`` (without padding), ``payload_bytes, payload_sha256, tail_crc32`` (of
    the last 64 bytes), ``media_bytes, media_sha256, feature`` (cosine hash). Equal texts give equal values. Null and
    empty texts are 64 bytes 0; texts of any length are stored whole; null ids and repeated rows are handled like others; an
    empty table gives an empty result; other columns are ignored.
    A damaged image raises ValueError. Nothing is shuffled.
    """
    return media_features(materialize(store_media(docs), "media"))
