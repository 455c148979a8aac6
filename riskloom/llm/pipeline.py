"""The stages of the corpus pipeline: quality filter, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of ``documents``. An empty table gives an empty result; columns beyond ``doc_id`` and ``text`` pass through under
any names that don't start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import materialize, maybe_broadcast, row_key, scratch, table
from riskloom.llm.decontaminate import contamination
from riskloom.llm.lines import dedup_lines
from riskloom.llm.minhash import near_duplicates
from riskloom.llm.packing import pack
from riskloom.llm.quality import score_quality


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows that ``gone`` names by ``doc_id`` and ``text_hash``."""
    keys = materialize(gone.select(F.struct("doc_id", "text_hash").alias("__gone__")).distinct(), name)
    return docs.join(maybe_broadcast(keys), row_key() == F.col("__gone__"), "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like others. Rows are told apart by id and text: rows repeated whole stay or go together, an
    id with several texts keeps those that are not rejected; null ids are ids like others.
    """
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scored.where("predicted = 0"), "rejected")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages are cut; documents of which nothing is left go.

    Null, empty and short texts stay as they are. Rows repeated whole are one document here and are left to ``near_dedup``;
    of ties the first by id and text keeps the passage, null ids first.
    """
    cut = dedup_lines(docs).where("n_removed = 0 or trim(text) <> ''")
    changed = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return cut.withColumns(changed).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: the one with the smallest id.

    Rows are told apart by a number, so rows without an id and rows repeated whole are copies like others; ids come
    before none. An id that stays with some text keeps each of its other texts once. Null and blank texts are no copies.
    """
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    near = near_duplicates(numbered.select(F.col("__row").alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias("__row"), "component_id")
    found = materialize(numbered.select("__row", "doc_id", F.xxhash64("text").alias("__text")).join(near, "__row"), "near-groups")
    groups = found.groupBy("component_id").agg(F.count("*").alias("n"), F.min_by("__row", F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first"))
    groups = materialize(groups.where("n > 1").drop("n"), "near-firsts")
    rest = materialize(found.join(maybe_broadcast(groups), "component_id").where("__row <> first").select("__row", "doc_id", "__text"), "near-copies")

    kept = found.join(maybe_broadcast(rest.select("__row")), "__row", "left_anti").join(maybe_broadcast(rest.select("doc_id").distinct()), "doc_id", "left_semi")
    kept = materialize(kept.select("doc_id", "__text").distinct(), "kept-ids")
    named = rest.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").join(kept, ["doc_id", "__text"], "left_anti")
    gone = materialize(rest.join(named.groupBy("doc_id", "__text").agg(F.min("__row").alias("__row")), "__row", "left_anti").select("__row"), "gone-copies")
    return numbered.join(maybe_broadcast(gone), "__row", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go.

    Null texts and texts without words stay. Rows are told apart by id and text.
    """
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"), "contaminated")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the packed sequences: every document's pieces. Null and blank texts are one piece of length 0 without a bin."""
    return pack(docs)


STAGES = [("quality_filter", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: The classifier, the signatures and best-fit packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's tables are deleted once its rows are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            docs = materialize(kept, f"stage-{name}", outside=True)
    return STAGES[-1][1](spark, docs, sf_dir)
