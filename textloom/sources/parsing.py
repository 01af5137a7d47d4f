"""A Spark source of parsed documents: batch and stream, with a lane for what cannot be parsed.

    spark.dataSource.register(ParsedDocuments)
    spark.read.format("parsed_documents").option("path", ...).option("parser", "package.module:function").load()

The parser takes a file's bytes and gives the payload's JSON text. Files are listed by the
driver and dealt to tasks by size; a file is read and parsed in the task. A parser that
raises, or gives no text, makes a row with an error and no payload. The offset of the stream
is the last file by (modification time, path): a batch is the files between two offsets, so a
batch that is run again after a failure has the same files. A file is taken once it has
lain for `settleSeconds`, so that none with an earlier time comes up behind the offset.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "document_id string, path string, size_bytes long, payload string, error string"


@dataclass
class Files(InputPartition):
    """Files of one task: (path, size)."""

    of: list[tuple[str, int]]


def loaded(name: str) -> Callable[[bytes], str]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def as_text(content: bytes) -> str:
    """The parser of files that are payloads already."""
    return content.decode()


class _Files:
    """Listing and reading, for both readers."""

    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}
        self.path, self.suffix = given["path"], given.get("suffix", "")
        self.parser = given.get("parser", "textloom.sources.parsing:as_text")
        self.task_bytes, self.most = int(given.get("taskbytes", 64 << 20)), int(given.get("maxfilesperbatch", 1000))
        self.settle_ns = int(float(given.get("settleseconds", 2)) * 1e9)

    def listed(self) -> list[tuple[int, str, int]]:
        """(modification time in ns, path, size) of all files, in this order; names with _ or . in front are passed by."""
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        infos = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = [i for i in infos if i.type == pyarrow.fs.FileType.File and i.base_name[0] not in "_." and i.base_name.endswith(self.suffix)]
        return sorted((i.mtime_ns or 0, i.path, i.size) for i in names)

    def dealt(self, files: list[tuple[int, str, int]]) -> list[Files]:
        out: list[Files] = []
        held = 0
        for _, path, size in files:
            if not out or held + size > self.task_bytes:
                out.append(Files([]))
                held = 0
            out[-1].of.append((path, size))
            held += size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        parse = loaded(self.parser)
        for path, size in partition.of:
            name = path.rsplit("/", 1)[-1].rpartition(".")[0] or path.rsplit("/", 1)[-1]
            try:
                with fs.open_input_stream(path) as f:
                    payload = parse(f.read())
                if not isinstance(payload, str):
                    raise TypeError(f"the parser gave {type(payload).__name__}, no text")
                yield name, path, size, payload, None
            except Exception as e:  # noqa: BLE001  a parser raises what it likes
                yield name, path, size, None, f"{type(e).__name__}: {e}"


class _Batch(_Files, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(self.listed()) or [Files([])]


class _Stream(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"mtime": -1, "path": ""}

    def latestOffset(self) -> dict:
        self.at = getattr(self, "at", None) or self.initialOffset()
        ahead = [f for f in self.listed() if f[:2] > (self.at["mtime"], self.at["path"]) and f[0] <= time.time_ns() - self.settle_ns][: self.most]
        if ahead:
            self.at = {"mtime": ahead[-1][0], "path": ahead[-1][1]}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.at = end if not getattr(self, "at", None) or (self.at["mtime"], self.at["path"]) < (end["mtime"], end["path"]) else self.at
        low, high = ((o["mtime"], o["path"]) for o in (start, end))
        return self.dealt([f for f in self.listed() if low < f[:2] <= high]) or [Files([])]

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class ParsedDocuments(DataSource):
    """Options: path; parser (module:function); suffix; taskBytes; of streams maxFilesPerBatch and settleSeconds."""

    @classmethod
    def name(cls) -> str:
        return "parsed_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def parsed(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """(document_id, path, size_bytes, payload, error) of the files of a folder; the payload is a variant, null where there is
    an error or no JSON."""
    spark.dataSource.register(ParsedDocuments)
    raw = (spark.readStream if stream else spark.read).format("parsed_documents").options(path=path, **options).load()
    broken = F.when(F.col("error").isNull() & F.try_parse_json("payload").isNull(), "not json")
    return raw.withColumn("error", F.coalesce("error", broken)).withColumn("payload", F.try_parse_json("payload"))
