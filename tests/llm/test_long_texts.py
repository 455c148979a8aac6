"""Texts of a million characters among short ones: read whole, by every operator that lacks such a case elsewhere."""

import base64
import hashlib

from riskloom.llm import media, packing, quality, warc

from .helpers import docs, prose
from .test_ops import pages

LONG = prose(7, 250_000)


def test_packing(spark):
    rows = packing.pack(docs(spark, [(1, LONG), (2, "a b c")])).where("doc_id = 1").orderBy("piece").collect()
    assert sum(x["length"] for x in rows) == rows[0]["n_tokens"] == 250_000
    assert [x["start"] for x in rows] == [sum(y["length"] for y in rows[:i]) for i in range(len(rows))]


def test_archives(spark):
    got = {x["page_id"]: x for x in warc.archive_pages(pages(spark, [(1, "http://a/", LONG), (2, "http://b/", LONG), (3, "http://c/", "x")])).collect()}
    assert got[1]["payload_bytes"] == len(LONG) and got[2]["refers_to"] == 1
    assert got[2]["payload_digest"] == base64.b32encode(hashlib.sha1(LONG.encode()).digest()).decode()


def test_quality(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    got = quality.score_quality(docs(spark, [(i, prose(i, 50) if i % 2 else "!! ?? " * 30) for i in range(40)] + [(100, LONG), (101, "z" * 1_000_000)]), labels).collect()
    assert len(got) == 42 and all(0 <= x["score"] <= 1 for x in got)


def test_media(spark):
    got = {x["doc_id"]: x for x in media.media_columns(docs(spark, [(1, LONG), (2, "ü" * 600_000)])).collect()}
    for i, text in ((1, LONG), (2, "ü" * 600_000)):
        raw = text.encode()
        padded = raw + bytes(-len(raw) % 64)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
