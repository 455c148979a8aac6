"""Line dedup and decontamination: SQL twins and edge cases; no Python in their plans."""

import duckdb
import pandas as pd
import pytest

from riskloom.llm.decontaminate import CONTAMINATION_SQL, _known_only, contamination
from riskloom.llm.lines import LINES_SQL, dedup_lines

from .helpers import DOCS, docs, prose


def sql_rows(sql, **tables):
    c = duckdb.connect()
    for name, rows in tables.items():
        c.register(f"t_{name}", pd.DataFrame(rows, columns=["item_id" if name == "benchmark" else "doc_id", "text"]).astype({"text": "object"}))
        c.execute(f"CREATE VIEW {name} AS SELECT {'item_id' if name == 'benchmark' else 'doc_id'}::BIGINT AS {'item_id' if name == 'benchmark' else 'doc_id'}, text::VARCHAR AS text FROM t_{name}")
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    return sorted((dict(zip(names, x, strict=True)) for x in r.fetchall()), key=repr)


def spark_rows(df):
    return sorted((x.asDict() for x in df.collect()), key=repr)


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("EvalPython", "PythonUDF", "InArrow", "InPandas"))


BENCH = [(1, prose(1, 30)), (2, "Only four Words here"), (3, "uno"), (4, "two words"), (5, ""), (6, None), (10, prose(1, 12)), (11, "…!"), (12, "a a a a a a a a a a a a")]
CONTAMINATED = [
    (0, f"{prose(50, 20)} {prose(1, 30)} {prose(51, 20)}"), (1, f"x, {prose(1, 11).upper()}!"), (2, "ONLY-four words, here. only four words here"), (3, "uno duo uno"),
    (4, prose(1, 9)), (5, None), (6, ""), (7, "... !!"), (8, "two  words two words"), (9, prose(3, 400)), (10, "only four words"), (11, "Ä uno É"), (12, "a " * 30), (13, prose(9, 20_000) + " " + prose(1, 10)),
]


@pytest.mark.parametrize("limit", [None, 0, 5])
def test_contamination(spark, limit):
    """With a benchmark within the bound of what is sent out, far beyond it, and beyond it in part."""
    items = spark.createDataFrame(BENCH, "item_id bigint, text string")
    out = contamination(docs(spark, CONTAMINATED), items, limit=limit).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    no_python(out)
    expected = sql_rows(CONTAMINATION_SQL, documents=CONTAMINATED, benchmark=BENCH)
    key = lambda x: x["doc_id"]
    assert sorted(spark_rows(out), key=key) == sorted(expected, key=key)
    assert sum(x["contaminated"] for x in expected) >= 6


def test_bit_map_holds_every_known_token(spark):
    """Beyond the bound the map is one row for 64 bits; known tokens pass it, nearly all others stop there."""
    tokens = spark.range(0, 3000, 3).selectExpr("xxhash64(id) AS token")
    rows = spark.range(3000).selectExpr("xxhash64(id) AS token", "id")
    out = _known_only(rows, tokens, limit=10)
    assert sorted(x["id"] for x in out.collect()) == list(range(0, 3000, 3))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and plan.count("Join") == 2
    assert sorted(x["id"] for x in _known_only(rows, tokens).collect()) == list(range(0, 3000, 3))


@pytest.mark.parametrize("bench", [[], [(1, None)], [(7, "zz yy xx")]])
def test_contamination_of_nothing(spark, bench):
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    rows = [(1, "a b c"), (None, "zz, YY xx"), (None, "zz, YY xx"), (2, None)]
    got = spark_rows(contamination(docs(spark, rows), items))
    assert len(got) == 4 and sum(x["contaminated"] for x in got) == (2 if bench == [(7, "zz yy xx")] else 0)
    assert contamination(spark.createDataFrame([], DOCS), items).collect() == []


LINES = [
    (1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\nz"), (3, "b\nc\nd"), (4, "a\nb"), (5, "\n\n\n\n"), (6, "\n\n\n"), (7, None), (8, ""), (9, "q\nq\nq\nq\nq\nq"),
    (10, "only one line"), (11, "m\nn\no\nm\nn\no\nm\nn\no"), (12, " a\nb\nc"), (13, "\n".join(f"l{i}" for i in range(3000))), (14, "k\n" + "\n".join(f"l{i}" for i in range(1000, 2000))),
]


def test_lines(spark):
    out = dedup_lines(docs(spark, LINES)).select("doc_id", "n_lines", "n_removed", "text")
    no_python(out)
    got = {x["doc_id"]: x for x in spark_rows(out)}
    assert list(got.values()) == [x for i in got for x in sql_rows(LINES_SQL, documents=LINES) if x["doc_id"] == i]
    assert got[2]["text"] == "x\nz" and got[3]["text"] == "" and got[9]["text"] == "q" and got[11]["text"] == "m\nn\no" and got[14]["text"] == "k"


def test_a_document_of_very_many_lines(spark):
    """Half of its lines go: the work is that of a sort of positions."""
    rows = [(1, "\n".join(f"l{i}" for i in range(200_000))), (2, "\n".join(f"l{i}" if i % 8 < 4 else f"m{i}" for i in range(300_000)))]
    got = {x["doc_id"]: x for x in dedup_lines(docs(spark, rows)).select("doc_id", "n_removed", "text").collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 100_000
    assert got[2]["text"].split("\n") == [f"l{i}" if i % 8 < 4 else f"m{i}" for i in range(300_000) if i % 8 >= 4 or i >= 200_000]


def test_lines_repeats_and_columns(spark):
    df = docs(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nd")])
    out = dedup_lines(df)
    assert set(out.columns) == set(df.columns)
    got = spark_rows(out.select("doc_id", "text", "n_removed"))
    # A null id comes first, so its passage is the one that stays.
    assert got == [{"doc_id": 1, "text": "", "n_removed": 3}, {"doc_id": 1, "text": "", "n_removed": 3}, {"doc_id": None, "text": "a\nb\nc\nd", "n_removed": 0}]
    assert spark_rows(dedup_lines(docs(spark, [(1, "a\nb\nc"), (1, "a\nb\nc")])).select("n_removed")) == [{"n_removed": 0}, {"n_removed": 0}]
    assert dedup_lines(spark.createDataFrame([], DOCS)).collect() == []
