"""The stages one after another, against what each must do to small tables."""

import pytest
from pyspark.sql import functions as F

from riskloom.llm import common
from riskloom.llm import pipeline as cp
from riskloom.llm.common import materialize, scratch, table
from riskloom.llm.decontaminate import contamination
from riskloom.llm.licenses import scan_licenses
from riskloom.llm.lines import dedup_lines
from riskloom.llm.minhash import near_duplicates
from riskloom.llm.urls import judge_urls
from riskloom.llm.warc import archive_pages

from .helpers import DOCS, docs, prose


@pytest.fixture
def folder(spark, tmp_path):
    bench = spark.createDataFrame([(1, prose(99_999, 14)), (2, None)], "item_id bigint, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    marks = [(i, int(i % 4 != 0)) for i in range(400)]
    spark.createDataFrame(marks, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def rows(n=600):
    out = []
    for i in range(n):
        text = "\n".join(prose(i * 10 + k, 12).capitalize() + "." for k in range(5))
        out.append((i, text.upper().replace(" ", "!! ") if i % 4 == 0 else text))
    return out


def test_stages(spark, folder):
    made = rows()
    passage = "\n".join(prose(5000 + k, 20) for k in range(4))
    extra = [(1001, prose(7001, 30).capitalize() + ".\n" + passage), (1002, prose(7002, 30).capitalize() + ".\n" + passage), (1004, made[7][1]), (1003, made[3][1].replace("\n", " ")), (1005, made[5][1].replace("\n", "  ")), (1006, prose(1006, 60).capitalize() + ". " + prose(99_999, 14)), (1007, ""), (1009, None), (None, prose(77, 80).capitalize() + ".")]
    df = docs(spark, made + extra)
    columns = df.columns
    kept = {}
    for name, stage in cp.STAGES:
        df = materialize(stage(spark, df, folder), "test-stage")
        if name != "packing":
            assert df.columns == columns
        kept[name] = {x["doc_id"] for x in df.select("doc_id").collect()}
        if name == "line_dedup":
            texts = {x["doc_id"]: x for x in df.collect()}
    bad = {i for i, _ in made if i % 4 == 0}
    assert len(kept["quality_filter"] & bad) <= 3 and len({i for i, _ in made} - bad - kept["quality_filter"]) <= 3
    assert passage in texts[1001]["text"] and passage not in texts[1002]["text"]
    assert 1004 not in texts  # nothing of it is left
    assert all(x["n_chars"] == len(x["text"] or "") for x in texts.values())
    assert not {1003, 1005} & kept["near_dedup"] and {3, 5} <= kept["near_dedup"]
    assert 1006 not in kept["decontaminate"] and kept["near_dedup"] - kept["decontaminate"] == {1006}
    assert kept["packing"] == kept["decontaminate"] and None in kept["packing"]


def test_repeated_ids(spark, folder):
    """An id that repeats with another text keeps the rows that nothing speaks against."""
    a, b = prose(1, 40), prose(2, 40)
    df = docs(spark, [(1, a), (3, a), (3, b)])
    assert sorted(x["doc_id"] for x in cp.near_dedup(spark, df, folder).collect()) == [1, 3, 3]
    df = docs(spark, [(1, prose(99_999, 14)), (1, b), (None, prose(99_999, 14))])
    assert [x["text"] for x in cp.decontaminate(spark, df, folder).collect()] == [b]


def test_near_copies_without_id(spark, folder):
    """Copies without an id and rows repeated whole go like others; rows without any words have no copies."""
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 40)
    df = docs(spark, [(None, a), (5, a), (None, a), (None, b), (None, b), (None, b + " "), (4, c), (4, c), (9, c), (None, None), (8, "")])
    got = cp.near_dedup(spark, df, folder)
    assert got.columns == df.columns
    assert sorted(((x["doc_id"], (x["text"] or "").strip()) for x in got.collect()), key=repr) == sorted([(5, a), (None, b), (4, c), (None, ""), (8, "")], key=repr)


def test_empty(spark, folder):
    df = spark.createDataFrame([], DOCS)
    for _, stage in cp.STAGES:
        df = stage(spark, df, folder)
        assert df.collect() == []


def test_run_equals_stages(spark, folder):
    docs(spark, rows(80), clash=False).write.parquet(f"{folder}/documents.parquet")
    df = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES:
        df = materialize(stage(spark, df, folder), "test-stage")
    key = lambda x: (x["doc_id"], x["piece"])
    assert sorted(cp.run(spark, folder).collect(), key=key) == sorted(df.select(*[F.col(c) for c in df.columns]).collect(), key=key)


def test_scratch_leaves_only_what_is_written_outside(spark):
    with scratch(spark):
        inner = materialize(spark.range(5), "inner")
        outer = materialize(inner.where("id > 2"), "outer", outside=True)
    assert outer.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(inner.inputFiles()[0].rsplit("/", 1)[0]).count()


def test_settings_of_the_session_come_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 777)
        materialize(spark.range(3), "settings")
        assert spark.conf.get(name) == "777"
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("rows_", [0, 500_000])
def test_joins_broadcast_or_not(spark, folder, monkeypatch, rows_):
    """Sides beyond the limit are shuffled: the same rows either way."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows_)
    passage = "\n".join(prose(5000 + k, 20) for k in range(4))
    copies = [(i, f"{prose(i, 30)}\n{passage}\nReleased under the MIT License.") for i in range(20)] + [(40 + i, prose(i // 2, 60)) for i in range(20)] + [(99, f"{prose(3, 20)} {prose(99_999, 14)}"), (None, "x y z"), (98, None)]
    df = docs(spark, copies)
    lines = dedup_lines(df).where("n_removed > 0").count()
    near = {(x["doc_id"], x["component_id"]) for x in near_duplicates(df).where("not kept").collect()}
    assert lines == 19 and near == {(41 + 2 * i, 40 + 2 * i) for i in range(10)}
    assert [x["doc_id"] for x in contamination(df, table(spark, folder, "benchmark")).where("contaminated").collect()] == [99]
    assert scan_licenses(df).where("licenses = 'MIT'").count() == 20
    pages = spark.createDataFrame([(i, f"http://best{i % 3}casino.org/", "same" if i % 2 else str(i)) for i in range(30)], "page_id bigint, url string, html string")
    assert judge_urls(pages, df).where("verdict = 'block'").count() == 30 and archive_pages(pages).where("record_type = 'revisit'").count() == 14
    assert cp._without(df.withColumn("text_hash", F.lit(1)).drop("text_hash"), df.where("doc_id = 99").select("doc_id", F.xxhash64("text").alias("text_hash")), "gone").count() == len(copies) - 1
