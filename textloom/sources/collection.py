"""A collection of vector points: snapshots of buckets, committed by manifests.

    <path>/_manifests/00000000000000000007.json    what version 7 is made of
    <path>/data/<commit>/bucket=<b>/*.parquet      a bucket as some commit left it

Points lie in buckets by a hash of their document, so that any number of documents makes as
many files as there are buckets. A change rewrites the buckets it touches next to the old
ones and then publishes a manifest under the next number, which only one writer can
create: readers see one version or the other, whole. A writer that comes second takes up
the newer version; only where both changed the same bucket does it make its change again.
Old versions stay readable until `vacuum`.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tries of a commit that meets others on its way.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Others changed the same buckets each time."""


@dataclass(frozen=True)
class Manifest:
    version: int
    dim: int
    buckets: int
    schema: str = ""
    files: dict[str, str] = field(default_factory=dict)  # bucket: folder


class Collection:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"

    # --- manifests ---

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("_manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest manifest, or that of a version; None where there is none."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            return None
        at = self._path(f"{self.path}/_manifests/{version or known[-1]:020d}.json")
        stream = self._fs.open(at)
        try:
            return Manifest(**json.loads(bytes(stream.readAllBytes())))
        finally:
            stream.close()

    def _publish(self, m: Manifest) -> bool:
        """Creates the manifest of a version; False if another writer did before."""
        final, part = f"{self.path}/_manifests/{m.version:020d}.json", f"{self.path}/_manifests/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(part), False)
        out.write(bytearray(json.dumps(m.__dict__).encode()))
        out.close()
        if not self._local:
            return self._fs.rename(self._path(part), self._path(final))  # does not replace what is there
        bare = lambda p: self._path(p).toUri().getPath()
        try:
            os.link(bare(part), bare(final))  # a local rename would replace
            return True
        except FileExistsError:
            return False
        finally:
            self._fs.delete(self._path(part), False)

    # --- reading ---

    def _folders(self, m: Manifest, only: list[str] | None = None) -> list[str]:
        return [f"{self.path}/data/{f}" for b, f in sorted(m.files.items()) if only is None or b in only]

    def _rows(self, m: Manifest, only: list[str] | None = None) -> DataFrame:
        folders = self._folders(m, only)
        schema = StructType.fromJson(json.loads(m.schema)) if m.schema else "document_id string, child_id string, dense array<float>"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All points of the newest version, or of an older one."""
        m = self.manifest(version)
        if m is None:
            raise FileNotFoundError(f"no collection at {self.path}" + (f", version {version}" if version else ""))
        return self._rows(m)

    def of_document(self, document_id: str) -> DataFrame:
        """A document's points; its bucket alone is read."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(document_id))).first()[0]
        m = self.manifest()
        return self._rows(m, [str(bucket)]).where(F.col("document_id") == document_id)

    def count(self, document_id: str) -> int:
        return self.of_document(document_id).count()

    # --- changes ---

    def _bucket(self, document: Column) -> Column:
        m = self.manifest()
        return F.pmod(F.xxhash64(document.cast("string")), F.lit(m.buckets if m else self.buckets)).cast("int")

    def ensure(self, dim: int) -> str:
        """'created' or 'kept', or 'recreated' where it was made for another dimension (its points go)."""
        for _ in range(ATTEMPTS):
            m = self.manifest()
            if m and m.dim == dim:
                return "kept"
            self._fs.mkdirs(self._path(f"{self.path}/_manifests"))
            if self._publish(Manifest(m.version + 1 if m else 1, dim, self.buckets)):
                return "recreated" if m else "created"
        raise Conflict(self.path)

    def _change(self, documents: DataFrame, points: DataFrame | None) -> None:
        """Replaces the rows of `documents` (document_id, bucket) by `points`."""
        touched = sorted(str(r.bucket) for r in documents.select("bucket").distinct().collect())  # as many as there are buckets
        if not touched:
            return
        seen: Manifest | None = None
        made: dict[str, str] = {}
        for _ in range(ATTEMPTS):
            m = self.manifest()
            if seen is None or any(m.files.get(b) != seen.files.get(b) for b in touched) or m.dim != seen.dim:
                seen, commit = m, uuid.uuid4().hex
                old = self._rows(m, touched) if any(b in m.files for b in touched) else None
                kept = old.join(documents.select("document_id"), "document_id", "left_anti") if old is not None else None
                rows = points if kept is None else kept if points is None else kept.unionByName(points, allowMissingColumns=True)
                made = {}
                if rows is not None:
                    schema = rows.schema
                    out = rows.withColumn("bucket", self._bucket(F.col("document_id")))
                    out.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{commit}")
                    made = {n.removeprefix("bucket="): f"{commit}/{n}" for n in self._names(f"data/{commit}") if n.startswith("bucket=")}
            files = {b: f for b, f in m.files.items() if b not in touched} | made
            text = self._widened(m.schema, schema) if made else m.schema
            if self._publish(replace(m, version=m.version + 1, files=files, schema=text)):
                return
        raise Conflict(self.path)

    @staticmethod
    def _widened(old: str, new: StructType) -> str:
        """The columns that there were, and new ones behind."""
        known = StructType.fromJson(json.loads(old)) if old else StructType([])
        return StructType([*known.fields, *(f for f in new.fields if f.name not in known.names)]).json()

    def upsert(self, points: DataFrame) -> None:
        """Replaces the documents that occur in `points`, whole. A point with another number of components is an error."""
        m = self.manifest()
        if m is None:
            raise FileNotFoundError(f"no collection at {self.path}: call ensure first")
        wrong = F.raise_error(F.lit(f"dense vectors need {m.dim} components")).cast(dict(points.dtypes)["dense"])
        checked = points.withColumn("dense", F.when(F.size("dense") == m.dim, F.col("dense")).otherwise(wrong))
        self._change(points.select(F.col("document_id"), self._bucket(F.col("document_id")).alias("bucket")).distinct(), checked)

    def delete(self, document_ids: list[str]) -> None:
        """Removes documents; missing ones are no error."""
        asked = self.spark.createDataFrame([(d,) for d in document_ids], "document_id string")
        self._change(asked.withColumn("bucket", self._bucket(F.col("document_id"))), None)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last `keep` versions and the folders that none of these name; number of folders deleted."""
        known = self.versions()
        used = {f.split("/")[0] for v in known[-keep:] for f in self.manifest(v).files.values()}
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/_manifests/{v:020d}.json"), False)
        gone = [n for n in self._names("data") if n not in used]
        for n in gone:
            self._fs.delete(self._path(f"{self.path}/data/{n}"), True)
        return len(gone)
