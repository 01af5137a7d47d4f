"""Helpers shared by the training-data operators: shared folder, materialising, hashing."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; documents are whole texts, so a batch stays at a few MB.
BATCH_ROWS = 512

#: Bytes of input (as stored) for each partition of an exchange.
PARTITION_BYTES = 8 << 20

#: A key is hot if it holds more than one in so many rows.
HOT = 1000

MASK64 = (1 << 64) - 1


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small: a batch of whole texts must fit in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions_for(df: DataFrame, each: int = PARTITION_BYTES) -> int:
    """Partitions for an exchange of what `df` reads: the session's number, or more where its input is larger.

    The size is that of the files below the plan; tables of unknown size (local rows) count nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-sum(x for x in sizes if x < 1 << 56) // each))


def bucket_keys(spark: SparkSession, n: int) -> np.ndarray:
    """A key for each of n buckets, such that repartition(n, key) gives every bucket a partition of its own."""
    found = spark.range(0, 32 * n, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id")).collect()  # n rows
    keys = np.arange(n)  # a partition that no key falls to leaves its bucket to another
    for p, key in found:
        keys[p] = key
    return keys


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """left joined with `right`, a materialised table of one row for each key, whose `weight` counts the key's rows in left.

    Keys of more than one in HOT rows, so fewer than HOT of them, are broadcast and their rows stay
    where they are; all others are shuffled, none of which can fill a task.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot, cold = (right.where(F.expr(f"{weight} * {HOT} {sign} {total}")) for sign in (">", "<="))
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one spark.checkpoint.dir names.

    Only where the setting is absent on a single machine (tests) is a temporary folder
    chosen, and recorded in the session so that later calls agree; a cluster needs the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/textloom/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()  # Spark's cleaner then drops the shuffle files of what is now a table
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more: what came of them is a table itself."""
    for t in tables:
        discard(t.sparkSession, t._loom_path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def crc32_u32(ids) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def batch_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
