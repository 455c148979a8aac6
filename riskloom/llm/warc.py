"""WARC archives in seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import id_back, id_text, materialize, maybe_broadcast

#: A frame is closed at so many bytes of records, a bundle at so many compressed bytes.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 22
#: Fixed values of the seekable format: mark of the skippable frame, mark of its footer, descriptor (checksums follow).
_SKIPPABLE, _SEEKABLE, _CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ARCHIVES = "bundle string, content binary, n_records bigint, index array<struct<record_id: string, frame: int, offset: bigint, length: bigint>>"
_RECORDS = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


def record_id(page_id: str | None, digest: str) -> str:
    """The record's identifier; pages without an id are told apart by their payload."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}' if page_id is not None else f'payload/{digest}')}"


def _field(name: str, value: str) -> bytes:
    """A header line; a value with control characters goes base64-encoded under the name with -Base64."""
    if re.search(r"[\x00-\x1f\x7f]|^\s|\s$", value):
        return f"{name}-Base64: {base64.b64encode(value.encode('utf-8', 'surrogatepass')).decode()}\r\n".encode()
    return f"{name}: {value}\r\n".encode("utf-8", "surrogatepass")


def make_record(page_id: str | None, url: str | None, payload: bytes, n: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or with ``refers_to`` a revisit record, whose block ends with the HTTP header."""
    head = [b"WARC/1.1\r\n", _field("WARC-Type", "response" if refers_to is None else "revisit"), _field("WARC-Record-ID", f"<{record_id(page_id, digest)}>"), _field("WARC-Date", date)]
    if url is not None:
        head.append(_field("WARC-Target-URI", url))
    if page_id is not None:
        head.append(_field("X-Page-Id", page_id))
    if refers_to is not None:
        head += [_field("WARC-Refers-To", f"<{record_id(refers_to, digest)}>"), _field("X-Refers-To-Page-Id", refers_to), _field("WARC-Profile", _REVISIT)]
    block = _HTTP + payload if refers_to is None else _HTTP
    head += [_field("WARC-Payload-Digest", f"sha1:{digest}"), _field("X-Payload-Length", str(n)), _field("Content-Type", "application/http; msgtype=response"), _field("Content-Length", str(len(block)))]
    return b"".join(head) + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields (names in lower case), block, and where the next record starts."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("no WARC record here")
    fields = {}
    for line in lines:
        name, _, value = line.partition(": ")
        name = name.lower()
        if name.endswith("-base64"):
            name, value = name[:-7], base64.b64decode(value).decode("utf-8", "surrogatepass")
        fields[name] = value
    start, n = end + 4, int(fields["content-length"])
    if data[start + n : start + n + 4] != b"\r\n\r\n":
        raise ValueError("a record has the wrong length")
    return fields, data[start : start + n], start + n + 4


class BundleWriter:
    """Records in independent frames; ``close`` appends the seek table and returns the bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.body, self.open, self.entries, self.index, self.size, self.fill = [], [], [], [], 0, 0

    def add(self, name: str, record: bytes) -> None:
        if self.open and self.fill + len(record) > self.frame_bytes:
            self._end_frame()
        self.index.append((name, len(self.entries), self.fill, len(record)))
        self.open.append(record)
        self.fill += len(record)

    def _end_frame(self) -> None:
        raw = b"".join(self.open)
        packed = self.packer.compress(raw)
        self.body.append(packed)
        self.entries.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.size += len(packed)
        self.open, self.fill = [], 0

    def close(self) -> bytes:
        if self.open:
            self._end_frame()
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), _CHECKED, _SEEKABLE)
        return b"".join(self.body) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int, int]]:
    """Of each frame: where it starts, compressed size, size, checksum; from the footer alone."""
    count, descriptor, mark = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    if mark != _SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if descriptor & _CHECKED else 8
    table = len(bundle) - 9 - count * width
    if struct.unpack_from("<II", bundle, table - 8) != (_SKIPPABLE, count * width + 9):
        raise ValueError("the seek table is damaged")
    out, at = [], 0
    for i in range(count):
        packed, raw, *check = struct.unpack_from("<III"[: 1 + width // 4], bundle, table + i * width)
        out.append((at, packed, raw, check[0] if check else -1))
        at += packed
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int, int]) -> bytes:
    at, packed, raw, check = frame
    data = zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=raw)
    if len(data) != raw or check not in (-1, xxhash.xxh64_intdigest(data) & 0xFFFFFFFF):
        raise ValueError("a frame is damaged")
    return data


def _described(fields: dict[str, str], block: bytes) -> tuple:
    n, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        n, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest:
            raise ValueError("a payload doesn't have its digest")
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return (page, fields.get("warc-target-uri"), n, digest, fields["warc-type"], refers)


def write_archives(pages: DataFrame, *, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """WARC records of ``pages (page_id, url, html, ...)`` in bundles: ``bundle, content, n_records, index``.

    The payload is the html in UTF-8 (null: empty). Of records whose equal payloads have at least ``min_bytes``
    bytes, the one with the smallest page_id is a response, the others revisit it. ``index`` maps record
    identifiers to frame, offset in the frame and length. Rows that repeat the smallest page_id are all responses;
    pages without an id revisit an equal payload that has one, else are responses. Null urls have no target; urls and pages
    of any length are taken whole; an empty table gives no bundles; other columns are ignored. Each task bundles its own
    rows; only digests and ids of payloads that occur twice are shuffled or sent out.
    """
    payload = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"))
    firsts = base.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null").drop("n")
    joined = base.join(maybe_broadcast(materialize(firsts, "repeated-payloads")), "sha1", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    size = F.octet_length("html").cast("bigint")
    rows = joined.select(id_text("page_id"), "url", F.when(refers.isNull(), F.col("html")).alias("html"), size.alias("n"), "sha1", refers.cast("string").alias("refers_to"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = BundleWriter(frame_bytes)

        def done() -> pd.DataFrame:
            content = writer.close()
            index = [{"record_id": r, "frame": f, "offset": o, "length": n} for r, f, o, n in writer.index]
            return pd.DataFrame({"bundle": [f"{hashlib.sha256(content).hexdigest()[:32]}.warc.zst"], "content": [content], "n_records": [len(index)], "index": [index]})

        for batch in batches:
            for page, url, html, n, sha1, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["n"], batch["sha1"], batch["refers_to"], strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                writer.add(record_id(page, digest), make_record(page, url, b"" if html is None else html.encode("utf-8", "surrogatepass"), n, digest, refers_to, date))
                if writer.size >= bundle_bytes:
                    yield done()
                    writer = BundleWriter(frame_bytes)
        if writer.index:
            yield done()

    return rows.mapInPandas(work, _ARCHIVES)


def _fetch(bundle: bytes, places: Iterable[dict]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records at ``places (record_id, frame, offset, length)``; each frame is found by the seek table and unpacked once."""
    table, at, data = seek_table(bundle), -1, b""
    for place in sorted(places, key=lambda x: (x["frame"], x["offset"])):
        if place["frame"] != at:
            at = place["frame"]
            data = read_frame(bundle, table[at])
        fields, block, end = parse_record(data, place["offset"])
        if fields["warc-record-id"] != f"<{place['record_id']}>" or end - place["offset"] != place["length"]:
            raise ValueError("the index names another record")
        yield fields, block


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the bundles ``(bundle, content, n_records, index)``, each reached through its entry of the index.

    Returns ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``. Frame checksums, identifiers and
    response digests are verified, and that the entries cover every frame without gap or overlap, so that each record is
    read exactly once. No bundles give no rows; other columns are ignored.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle, index in zip(batch["content"], batch["index"], strict=True):
                covered: dict[int, int] = {}
                for x in sorted(index, key=lambda x: (x["frame"], x["offset"])):
                    if covered.get(x["frame"], 0) != x["offset"]:
                        raise ValueError("the index has a gap")
                    covered[x["frame"]] = x["offset"] + x["length"]
                if covered != {k: raw for k, (_, _, raw, _) in enumerate(seek_table(bundle))}:
                    raise ValueError("the index doesn't cover the bundle")
                yield _frame([_described(*record) for record in _fetch(bundle, index)])

    return id_back(archives.select("content", "index").mapInPandas(work, _RECORDS), "page_id", "refers_to")


def find_records(archives: DataFrame, ids: DataFrame) -> DataFrame:
    """The records named in ``ids (record_id)``: only the frames that hold them are unpacked. Unknown and null identifiers give no rows."""
    places = archives.select("bundle", F.explode("index").alias("i")).select("bundle", "i.*").join(maybe_broadcast(ids.select("record_id").distinct()), "record_id")
    wanted = places.groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("places"))  # at most a bundle's records

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle, at in zip(batch["content"], batch["places"], strict=True):
                yield _frame([_described(*record) for record in _fetch(bundle, at)])

    return id_back(archives.select("bundle", "content").join(maybe_broadcast(wanted, "size(places)"), "bundle").select("content", "places").mapInPandas(work, _RECORDS), "page_id", "refers_to")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def archive_pages(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write every page to archives in the shared folder and read the records back through their index.

    Rows, nulls, repeats, empty tables and other columns: see ``write_archives`` and ``read_archives``.
    """
    return read_archives(materialize(write_archives(pages, min_bytes=min_bytes), "archives"))


_DIGIT = "strpos('0123456789abcdef', c) - 1"
_BITS = f"array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111', ({_DIGIT}) * 4 + 1, 4) for c in string_split(sha1(h), '')], '')"
_FIVE = " + ".join(f"{16 >> k} * substr(bits, 5 * i + {k + 1}, 1)::INT" for k in range(5))

#: The query's rows; the digest's base32 is spelt out from its bits.
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
b AS (SELECT page_id, first, strlen(h) AS payload_bytes, {_BITS} AS bits FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1) for i in generate_series(0, 31)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
