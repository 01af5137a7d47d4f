"""Document registry and structure files: append-only tables with a latest-wins view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "document_id string, filename string, size_bytes long, uploaded_at string, stats string"


def register(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def land(files: DataFrame, path: str) -> DataFrame:
    """Keeps uploads (document_id, filename, content) as they came, a partition each, and returns their registry rows,
    stamped with the time in UTC; an upload of a document that is there replaces it."""
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return files.select("document_id", "filename", F.octet_length("content").cast("long").alias("size_bytes"), now.alias("uploaded_at"), F.lit(None).cast("string").alias("stats"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of every document; a missing registry is empty, broken lines are skipped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], REGISTRY)
    rows = spark.read.schema(REGISTRY).option("mode", "DROPMALFORMED").json(path).where("document_id is not null")
    fields = [c.split()[0] for c in REGISTRY.split(", ")]
    latest = rows.groupBy("document_id").agg(F.max_by(F.struct(*fields[1:]), "uploaded_at").alias("r"))
    return latest.select("document_id", *[f"r.{f}" for f in fields[1:]])


def current_document(registry: DataFrame, id_col: str = "document_id", time_col: str = "uploaded_at") -> DataFrame:
    """The id that was added last."""
    return registry.agg(F.max_by(id_col, F.struct(time_col, id_col)).alias(id_col))


def save_structures(structures: DataFrame, path: str) -> None:
    """JSON files, one partition a document; saving a document again replaces it."""
    structures.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").json(path)


def load_structure(spark: SparkSession, path: str, document_id: str, schema) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).where(F.col("document_id") == document_id)


def save_report(lines: DataFrame, path: str) -> None:
    """The lines of chunk reports as text files, one folder a document."""
    ordered = lines.repartition("document_id").sortWithinPartitions("document_id", "line_key").select("document_id", "line")
    ordered.write.mode("overwrite").partitionBy("document_id").text(path)
