"""Reading and writing tables, and the adapters that give the driver's tables the roles of this domain."""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.contract import require_columns


_LOCAL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """A driver table, only the given columns; zone-less timestamps become UTC timestamps (and the session's zone UTC)."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)})


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] = ()) -> DataFrame:
    """A CSV file with a header under a given schema: only the wanted columns are parsed."""
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=True)
    return df.select(*columns) if columns else df


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A Parquet table pruned to columns that must all be there."""
    df = spark.read.parquet(path)
    require_columns(df, columns)
    return df.select(*columns)


def columns_matching(names: Sequence[str], pattern: str = r"V[0-9]+") -> list[str]:
    return [c for c in names if re.fullmatch(pattern, c)]


def matching_columns(spark: SparkSession, path: str, pattern: str = r"V[0-9]+") -> list[str]:
    """Names in a Parquet table's schema that match whole; no data is read."""
    return [c for c in spark.read.parquet(path).schema.fieldNames() if re.fullmatch(pattern, c)]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Unset, a local run gets a new folder; a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="riskloom-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return _LOCAL["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table of this application's; ``clear_written`` deletes them all."""
    return f"{shared_folder(spark)}/riskloom/tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what reads it twice computes it once, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def driver_folder(spark: SparkSession) -> str:
    """A new folder of the shared one for small files that the driver writes; a URL where that is one."""
    path = new_path(spark, "files").removeprefix("file://").removeprefix("file:")
    if "://" not in path:
        os.makedirs(path, exist_ok=True)
    return path


def clear_written(spark: SparkSession) -> None:
    """Delete every table written by ``written``; results that still read them are lost."""
    delete_path(spark, f"{shared_folder(spark)}/riskloom/tables-{spark.sparkContext.applicationId}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, with all in it, wherever it lies; nothing if there is none."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def write_table(df: DataFrame, path: str) -> None:
    """Overwrite; Spark's commit protocol makes the files visible at the end of the job only."""
    df.write.mode("overwrite").parquet(path)


def _file_system(path: str) -> tuple:
    """The JVM, the file system's context and the path of a URL."""
    spark = SparkSession.getActiveSession()
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark._jvm, spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(found.toUri(), spark._jsc.hadoopConfiguration()), found


def write_json(value: object, path: str) -> None:
    """Write small state of the driver's: to a neighbour file first, then renamed over the target. URLs go through Spark's file systems."""
    text = json.dumps(value, sort_keys=True, indent=1)
    if "://" in path:
        jvm, files, target = _file_system(path)
        temporary, kinds = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp"), jvm.org.apache.hadoop.fs
        files.mkdir(target.getParent(), kinds.permission.FsPermission.getDirDefault(), True)
        fs = temporary.getFileSystem(SparkSession.getActiveSession()._jsc.hadoopConfiguration())
        out = fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        over = SparkSession.getActiveSession().sparkContext._gateway.new_array(getattr(kinds, "Options$Rename"), 1)
        over[0] = getattr(kinds, "Options$Rename").OVERWRITE
        files.rename(temporary, target, over)
        return
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(fd, "w") as f:
        f.write(text)
    os.replace(temporary, path)


def read_text(path: str) -> str:
    """A small file of the driver's; URLs go through Spark's file systems."""
    if "://" in path:
        return "\n".join(r["value"] for r in SparkSession.getActiveSession().read.text(path, wholetext=True).collect())
    with open(path) as f:
        return f.read()


def read_json(path: str, default: object = None) -> object:
    """What ``write_json`` wrote; ``default`` where there is no such file and a default is given."""
    if default is not None:
        if "://" in path:
            _, files, target = _file_system(path)
            there = files.util().exists(target)
        else:
            there = os.path.exists(path)
        if not there:
            return default
    return json.loads(read_text(path))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of every file below a path, for lineage."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def bytes_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def event_label():
    return (F.get_json_object("props", "$.k").cast("int") < 4).cast("int")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as transactions: id, card, ts, us, amount, category, label, score."""
    df = load(spark, sf_dir, "events")
    return df.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("card"), "ts", F.unix_micros("ts").alias("us"), F.col("value").alias("amount"),
        F.col("event_type").alias("category"), event_label().alias("label"), (F.col("value") / (F.col("value") + F.lit(50.0))).alias("score"),
    )


TRANSACTIONS_SQL = """(SELECT event_id AS id, user_id AS card, ts, epoch_us(ts) AS us, value AS amount, event_type AS category,
 (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) < 4)::INT AS label, value / (value + 50.0::DOUBLE) AS score FROM events)"""


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as transactions, many at equal times: id, card, ts, us, amount, category, label."""
    df = load(spark, sf_dir, "orders")
    return df.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("card"), F.col("o_orderdate").alias("ts"), F.unix_micros("o_orderdate").alias("us"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("category"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


ORDERS_SQL = """(SELECT o_orderkey AS id, o_custkey AS card, o_orderdate AS ts, epoch_us(o_orderdate) AS us, o_totalprice AS amount,
 o_orderpriority AS category, (o_orderstatus = 'F')::INT AS label FROM orders)"""


def wide_block(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """``embeddings`` as a block V1.. with some values missing: id, label, V1 .. V<width>."""
    df = load(spark, sf_dir, "embeddings")
    cells = [F.when((F.col("vec_id") * 7 + i) % 11 != 0, F.col("embedding")[i].cast("double")).alias(f"V{i + 1}") for i in range(width)]
    return df.select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("label"), *cells)


def wide_block_sql(width: int = 64) -> str:
    cells = ", ".join(f"CASE WHEN (vec_id * 7 + {i}) % 11 <> 0 THEN embedding[{i + 1}]::DOUBLE END AS V{i + 1}" for i in range(width))
    return f"(SELECT vec_id AS id, (label = 0)::INT AS label, {cells} FROM embeddings)"
