"""Streaming ingest: landed payload files are cleaned and written batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.config import DEFAULTS, Settings
from textloom.operators import clean
from textloom.sources import pages as P
from textloom.sources import parsing


def landed(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of (document_id, payload) from JSON files that arrive in a folder."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(path)
    return raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("document_id"), F.try_parse_json("value").alias("payload"))


def landed_documents(spark: SparkSession, path: str, parser: str, **options: str) -> DataFrame:
    """A stream of (document_id, payload) from files of any kind, parsed in the tasks; what fails has no payload."""
    return parsing.parsed(spark, path, stream=True, parser=parser, **options).select("document_id", "payload")


def clean_stream(stream: DataFrame, out: str, checkpoint: str, settings: Settings = DEFAULTS) -> StreamingQuery:
    """Cleans every micro-batch of whole documents and replaces their partitions under `out`.

    A batch that is run again after a failure overwrites the same partitions, so the
    result is the same; problems of payloads go to `out`/problems.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        P.check_payloads(batch).where("problem is not null").write.mode("overwrite").parquet(f"{out}/problems/batch={batch_id}")
        kept = clean.kept_items(clean.clean(P.payload_pages(batch), settings)).select("document_id", "page_idx", "item_idx", "page", "kind", "text")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(f"{out}/items")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
