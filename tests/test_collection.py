"""Collections: whole snapshots under concurrent writers, few files for many documents."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from textloom.sources.collection import Collection

SCHEMA = "document_id string, child_id string, dense array<float>"


def points(spark, document, ids, extra=None):
    df = spark.createDataFrame([(document, i, [1.0, 2.0]) for i in ids], SCHEMA)
    return df if extra is None else df.withColumn("extra", F.lit(extra))


def ids(df):
    return sorted(r.child_id for r in df.collect())


def test_versions_and_documents(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c", buckets=3)
    with pytest.raises(FileNotFoundError):
        c.upsert(points(spark, "a", ["1"]))
    assert [c.ensure(d) for d in (3, 2, 2)] == ["created", "recreated", "kept"] and ids(c.read()) == []
    c.upsert(points(spark, "a", ["1", "2"]).unionByName(points(spark, "b", ["3"])))
    c.upsert(points(spark, "a", ["4"], extra=7))
    assert ids(c.read()) == ["3", "4"] and {r.extra for r in c.read().collect()} <= {7, None}
    assert ids(c.read(3)) == ["1", "2", "3"] and c.count("a") == 1 and c.count("zz") == 0
    c.delete(["a", "not there"])
    assert ids(c.read()) == ["3"] and c.versions() == [1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="2 components"):
        c.upsert(points(spark, "b", ["9"]).withColumn("dense", F.array(F.lit(1.0).cast("float"))))
    assert ids(c.read()) == ["3"] and len(c.versions()) == 5  # what failed left nothing that is read
    assert c.vacuum(1) >= 1 and ids(c.read()) == ["3"] and c.versions() == [5]
    c.upsert(points(spark, "b", []))
    assert ids(c.read()) == ["3"]


def test_many_documents_make_few_files(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c", buckets=5)
    c.ensure(1)
    many = spark.range(30_000).select(F.col("id").cast("string").alias("document_id"), F.col("id").cast("string").alias("child_id"), F.array(F.lit(1.0).cast("float")).alias("dense"))
    c.upsert(many)
    assert len(list((tmp_path / "c" / "data").rglob("*.parquet"))) == 5 and c.read().count() == 30_000
    assert c.of_document("77").count() == 1 and len(c.of_document("77").inputFiles()) == 1


def test_concurrent_writers_keep_one_whole(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    Collection(spark, path, buckets=2).ensure(2)
    errors = []

    def write(k):
        try:
            mine = Collection(spark, path)
            mine.upsert(points(spark, "same", [f"{k}-{i}" for i in range(20)]).unionByName(points(spark, f"own{k}", [f"own{k}"])))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    c = Collection(spark, path)
    rows = c.read().collect()
    same = {r.child_id.split("-")[0] for r in rows if r.document_id == "same"}
    assert len(same) == 1 and sum(r.document_id == "same" for r in rows) == 20
    assert {r.document_id for r in rows} == {"same", *(f"own{k}" for k in range(4))} and len(c.versions()) == 5
