"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.codes import codes_sql, encode_vectors
from riskloom.llm.common import table
from riskloom.llm.decontaminate import CONTAMINATION_SQL, contamination
from riskloom.llm.extract import extract_main_text
from riskloom.llm.importance import resample, resampling_sql
from riskloom.llm.licenses import licenses_sql, scan_licenses
from riskloom.llm.lines import LINES_SQL, dedup_lines
from riskloom.llm.media import media_columns
from riskloom.llm.minhash import NEAR_SQL, near_duplicates
from riskloom.llm.packing import pack
from riskloom.llm.quality import score_quality
from riskloom.llm.signature_trees import JACCARD_SQL, jaccard_classes
from riskloom.llm.urls import judge_urls
from riskloom.llm.warc import WARC_SQL, archive_pages


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(table(spark, sf_dir, "embeddings"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), words=3, percent=90)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OPERATORS = [op1_extract, op2_packing, op3_warc, op4_licenses, op5_minhash, op6_urls, op7_lines, op8_quality, op9_decontaminate, op10_media, op11_codes, op12_jaccard, op13_resample]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}

#: The other operators are tested against brute force, round trips and held-out labels.
ORACLE: dict[str, str] = {
    "op3_warc": WARC_SQL, "op4_licenses": licenses_sql(), "op5_minhash": NEAR_SQL, "op7_lines": LINES_SQL, "op9_decontaminate": CONTAMINATION_SQL,
    "op11_codes": codes_sql(), "op12_jaccard": JACCARD_SQL, "op13_resample": resampling_sql(),
}
