"""The source of parsed documents: batches, streams, and files that cannot be parsed."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from textloom.sources import pages as P
from textloom.sources import parsing


def payload(text):
    return json.dumps({"pages": [{"page": 1, "items": [{"type": "text", "value": text}]}]})


def land(folder, name, content):
    path = os.path.join(folder, name)
    with open(path + ".part", "w") as f:
        f.write(content)
    os.rename(path + ".part", path)


def test_batch_with_a_lane_for_errors(spark, tmp_path):
    for name, content in {"a.json": payload("One."), "b.json": "{", "c.json": payload("Two."), "_hidden.json": "x", "note.txt": "x"}.items():
        land(tmp_path, name, content)
    (tmp_path / "d.json").write_bytes(b"\xff\xfe")
    df = parsing.parsed(spark, f"file://{tmp_path}", suffix=".json", taskBytes="40")
    got = {r.document_id: r.error for r in df.select("document_id", "error").collect()}
    assert got["a"] is None and got["c"] is None and got["b"] == "not json" and got["d"].startswith("UnicodeDecodeError") and set(got) == {"a", "b", "c", "d"}
    assert df.rdd.getNumPartitions() >= 3  # dealt by size
    pages = P.payload_pages(df.where("error is null").select("document_id", "payload"))
    assert sorted(r.raw for r in P.items(pages).collect()) == ["One.", "Two."]
    assert parsing.parsed(spark, f"file://{tmp_path}/nothing").count() == 0


def test_a_parser_by_name(spark, tmp_path):
    land(tmp_path, "x.bin", "7")
    land(tmp_path, "y.bin", "seven")
    df = parsing.parsed(spark, f"file://{tmp_path}", parser="json:loads")  # gives a number, or raises
    got = {r.document_id: (r.error or "").split(":")[0] for r in df.select("document_id", "error").collect()}
    assert got == {"x": "TypeError", "y": "JSONDecodeError"}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, out, point = (str(tmp_path / x) for x in ("in", "out", "cp"))
    os.mkdir(folder)

    def run():
        stream = parsing.parsed(spark, f"file://{folder}", stream=True, maxFilesPerBatch="2", settleSeconds="0").select("document_id", F.col("error"), F.to_json("payload").alias("payload"))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", point).start()
        q.processAllAvailable()
        q.stop()

    for k in range(5):
        land(folder, f"d{k}.json", payload(f"Text {k}."))
    run()
    assert sorted(r.document_id for r in spark.read.parquet(out).collect()) == [f"d{k}" for k in range(5)]
    time.sleep(0.05)
    land(folder, "late.json", "{")
    run()
    rows = {r.document_id: r.error for r in spark.read.parquet(out).collect()}
    assert rows == {**{f"d{k}": None for k in range(5)}, "late": "not json"} and spark.read.parquet(out).count() == 6
