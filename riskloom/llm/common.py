"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that a Python worker gets or a Parquet scan decodes at once; documents can be long.
BATCH_ROWS = 500
_BATCH_SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
#: Rows up to which a side of a join is sent to every executor (ids and short keys only).
BROADCAST_ROWS = 500_000
_LOCAL: dict[str, str] = {}
#: Folders of the scratches that are open, innermost last.
_FOLDERS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Unset, a local run gets a new folder; a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL.get("dir")
        if not base:
            base = _LOCAL["dir"] = tempfile.mkdtemp(prefix="riskloom-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most ``BATCH_ROWS`` inside: thousands of whole texts in one array strain an executor's heap. The session's settings come back after."""
    before = {name: spark.conf.get(name) for name in _BATCH_SETTINGS}
    try:
        for name, value in before.items():
            spark.conf.set(name, min(int(value), BATCH_ROWS))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end: what is still wanted must be written outside before."""
    _FOLDERS.append(f"scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, f"{_tables(spark)}/{_FOLDERS.pop()}")


def clear_tables(spark: SparkSession) -> None:
    """Delete every table that this application has written; results that still read them are lost."""
    _delete(spark, _tables(spark))


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/riskloom/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, *partition_by: str, outside: bool = False) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends there and lost executors cost nothing.

    ``outside`` puts it beside the open ``scratch``, so that it outlasts that.
    """
    spark = df.sparkSession
    path = "/".join([_tables(spark), *([] if outside else _FOLDERS[-1:]), f"{name}-{uuid.uuid4().hex}"])
    with small_batches(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, weight: str = "1", limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows (or their ``weight``, summed) are at most ``limit`` (``BROADCAST_ROWS``); else as it is, for a shuffled join.

    Rows must be ids and short keys: half a million of them are some tens of megabytes. ``df`` is counted, so it should be a written table.
    """
    return F.broadcast(df) if (df.agg(F.expr(f"sum({weight})")).first()[0] or 0) <= (BROADCAST_ROWS if limit is None else limit) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's. Queries read through this; it lowers the session's batches for good, as their results are read later."""
    for option in _BATCH_SETTINGS:
        spark.conf.set(option, min(int(spark.conf.get(option)), BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(name: str):
    """An id as text, as it goes through Python workers: pandas would turn whole numbers beside nulls into floats."""
    return F.col(name).cast("bigint").cast("string").alias(name)


def id_back(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def ascii_lower(col):
    """A-Z to a-z; other letters stay as they are. Pure ASCII takes the fast path."""
    plain = F.octet_length(col) == F.char_length(col)
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def row_key():
    """Names a document by its id and a hash of its text: null ids compare equal, rows repeated whole are one document."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
