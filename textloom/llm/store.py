"""Content-addressed token store: chunks cut by rolling hashes, recipes and Merkle manifests.

Layout of a store folder (all written and read by Spark):

    entries/kind=chunk   digest, n_ids, width, payload (ids, little endian): every chunk once
    recipes              part, page, doc_id, row_id, start, n_tokens, steps, root, in ascending doc_id order
    manifest             part, page, n_docs, n_tokens, root: Merkle root of a page of recipes

A document's ids are cut where a rolling hash of the last ids says so, so equal
passages give equal chunks wherever they stand. A chunk's address is the digest
of its ids; a recipe's steps are the addresses and lengths of its chunks. Each task
sends a chunk's ids once; the exchange is by digest for ids and by row for recipes, so
a chunk that every document holds travels once a task. `start` counts within a part;
a part's first id follows from the manifest, which has a row for each PAGE recipes.

Reading checks every chunk against its address, every document against its root,
its chunks and its length, and every page against the manifest. crc32 is linear: a
document's is the xor of its chunks' crcs, each shifted by the bytes that follow it, so
ids are never shuffled when they are read back and no document's chunks meet in a list.

Defined cases: null text is empty (the end id alone); null doc_id sorts first;
repeated ids and rows keep a row each (ties in the order of row_id); an empty
table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import MASK64, arrow_batches, batch_of, id_text, new_path, partitions_for, splitmix
from textloom.llm.ids import byte_bpe

END_ID = 0
WINDOW = 16
LEAST, MEAN, MOST = 128, 512, 2048
DIGEST = 16
#: Digests that a task remembers; beyond, it starts afresh and may send a chunk again.
SEEN = 500_000
#: Recipes of a row of the manifest.
PAGE = 4096
#: A step of a recipe: a chunk's address and its number of ids.
STEP = np.dtype([("digest", f"V{DIGEST}"), ("n", "<u4")])
_BASE = 0x9E3779B97F4A7C15


def rolling(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mixed polynomial hash of the `window` ids (a power of two) from each place on."""
    h, power, n = splitmix(ids.astype(np.uint64)), _BASE, 1
    while n < window and len(h) > n:
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power & MASK64, 2 * n
    return splitmix(h)


def cut_points(ids: np.ndarray, window: int = WINDOW, least: int = LEAST, mean: int = MEAN, most: int = MOST, marks: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of ids; `marks`: places after a window whose hash cuts, if known."""
    n = len(ids)
    if n <= least:
        return [n] if n else []
    if marks is None:
        marks = np.flatnonzero((rolling(ids, window) & np.uint64(mean - 1)) == 0) + window
    ends, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > most:
            last += most
            ends.append(last)
        if m - last >= least or m == n and m > last:
            ends.append(m)
            last = m
    return ends


def digest_of(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd last node goes up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=DIGEST).digest() for x in leaves] or [b"\0" * DIGEST]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=DIGEST).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _shifted(crc: int, matrix: list[int]) -> int:
    out, i = 0, 0
    while crc:
        if crc & 1:
            out ^= matrix[i]
        crc >>= 1
        i += 1
    return out


class CrcJoin:
    """crc32 of a concatenation from the crcs of its parts, and of parts by what follows them."""

    def __init__(self):
        one = [0xEDB88320] + [1 << k for k in range(31)]  # a zero bit appended
        two = [_shifted(one[k], one) for k in range(32)]
        four = [_shifted(two[k], two) for k in range(32)]
        self.powers = [[_shifted(four[k], four) for k in range(32)]]  # a zero byte appended
        self.tables: list[np.ndarray] = []

    def _table(self, k: int) -> np.ndarray:
        """(4, 256): what 2^k zero bytes make of each byte of a crc."""
        while len(self.tables) <= k:
            p = self.powers[-1]
            self.tables.append(np.array([[_shifted(v << (8 * byte), p) for v in range(256)] for byte in range(4)], np.uint32))
            self.powers.append([_shifted(x, p) for x in p])
        return self.tables[k]

    def shift(self, crcs: np.ndarray, follow: np.ndarray) -> np.ndarray:
        """Crcs as they are after `follow` more zero bytes; xor of a document's gives its own."""
        out, follow, k = crcs.astype(np.uint32), follow.astype(np.int64), 0
        while len(follow) and follow.max() >> k:
            own = np.flatnonzero(follow >> k & 1)
            c, t = out[own], self._table(k)
            out[own] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
            k += 1
        return out

    def __call__(self, first: int, second: int, second_bytes: int) -> int:
        return int(self.shift(np.array([first], np.uint32), np.array([second_bytes]))[0]) ^ second


_ENTRY = pa.schema([("deal", pa.int64()), ("kind", pa.string()), ("digest", pa.binary()), ("n_ids", pa.int64()), ("width", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("row_id", pa.int64())])
_ENTRY_DDL = "deal long, kind string, digest binary, n_ids long, width int, payload binary, doc_id long, row_id long"


def _encode(tokenizer_path: str):
    def run(batches):
        from pyspark import TaskContext

        t, seen = byte_bpe(tokenizer_path), set()
        end = np.array([END_ID], np.uint32)
        row_id = TaskContext.get().partitionId() << 36
        for b in batches:
            rows = []
            every = t.encode(b.column("text").to_pylist())
            flat = np.concatenate([x for ids in every for x in (ids, end)]) if every else end
            flat = flat.astype("<u4", copy=False)
            width = 2 if flat.max() < 65536 else 4
            stored, raw = flat.astype(f"<u{width}", copy=False), memoryview(flat).cast("B")
            marks = np.flatnonzero((rolling(flat) & np.uint64(MEAN - 1)) == 0) + WINDOW
            at = 0
            for d, ids in zip(b.column("doc_id").to_pylist(), every):
                n = len(ids) + 1
                lo, hi = np.searchsorted(marks, (at + WINDOW, at + n + 1)) if n > LEAST else (0, 0)
                steps, last = [], 0
                for stop in cut_points(flat[at : at + n], marks=marks[lo:hi] - at):
                    a, z, n_ids = at + last, at + stop, stop - last
                    last = stop
                    key = hashlib.blake2b(raw[4 * a : 4 * z], digest_size=DIGEST).digest()
                    steps.append((key, n_ids))
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        rows.append((int.from_bytes(key[:8], "little", signed=True), "chunk", key, n_ids, width, stored[a:z].tobytes(), None, None))
                at += n
                rows.append(((row_id * 0x9E3779B97F4A7C15) % (1 << 63), "recipe", np.array(steps, STEP).tobytes(), n, None, merkle([k for k, _ in steps]), d, row_id))
                row_id += 1
            for lo in range(0, len(rows), 4000):
                yield batch_of({f.name: [r[i] for r in rows[lo : lo + 4000]] for i, f in enumerate(_ENTRY)}, _ENTRY)

    return run


def _once(batches):
    """Drops chunks that another task has sent to this partition already.

    It remembers the digests of a partition, whose size is bounded: partitions follow the input's size.
    """
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        for kind, key in zip(b.column("kind").to_pylist(), b.column("digest").to_pylist()):
            keep.append(kind != "chunk" or key not in seen)
            if kind == "chunk":
                seen.add(key)
        yield b.filter(pa.array(keep, pa.bool_()))


_RECIPE = pa.schema([("part", pa.int32()), ("page", pa.int64()), ("doc_id", pa.int64()), ("row_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("steps", pa.binary()), ("root", pa.binary())])
_RECIPE_DDL = "part int, page long, doc_id long, row_id long, start long, n_tokens long, steps binary, root binary"


def _numbered(page: int):
    """Recipes in order, with their page and the ids of the part before them."""

    def run(batches):
        from pyspark import TaskContext

        part, seen, start = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = np.asarray(b.column("n_tokens"))
            ends = start + np.cumsum(n)
            yield batch_of({"part": np.full(len(n), part), "page": (seen + np.arange(len(n))) // page, "start": ends - n} | {c: b.column(c) for c in ("doc_id", "row_id", "n_tokens", "steps", "root")}, _RECIPE)
            seen, start = seen + len(n), int(ends[-1]) if len(n) else start

    return run


_MANIFEST = pa.schema([("part", pa.int32()), ("page", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())])
_MANIFEST_DDL = "part int, page long, n_docs long, n_tokens long, root binary"


def _roots(rows: pa.Table) -> pa.Table:
    """One manifest row of a page of recipes."""
    t = rows.sort_by("start")
    return pa.table({"part": t["part"][:1], "page": t["page"][:1], "n_docs": [t.num_rows], "n_tokens": [sum(t["n_tokens"].to_pylist())], "root": [merkle(t["root"].to_pylist())]}, schema=_MANIFEST)


def _manifest(recipes: DataFrame) -> DataFrame:
    """Pages are of PAGE recipes, so a task's group is bounded."""
    return recipes.select("part", "page", "start", "n_tokens", "root").groupBy("part", "page").applyInArrow(_roots, _MANIFEST_DDL)


def write_store(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", page: int = PAGE) -> str:
    """Writes the store of all documents and returns its folder."""
    spark = docs.sparkSession
    arrow_batches(spark)
    path = path or new_path(spark, "store")
    rows = id_text(docs, id_col, text_col)
    n = partitions_for(rows)
    entries = rows.mapInArrow(_encode(tokenizer_path), _ENTRY_DDL)
    entries.repartition(n, "deal").mapInArrow(_once, _ENTRY_DDL).drop("deal").write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/entries")
    made = spark.read.schema("digest binary, n_ids long, payload binary, doc_id long, row_id long, kind string").parquet(f"{path}/entries").where("kind = 'recipe'")
    parts = max(1, n // 4)
    ordered = made.select("doc_id", "row_id", F.col("n_ids").alias("n_tokens"), F.col("digest").alias("steps"), F.col("payload").alias("root")).repartitionByRange(parts, "doc_id", "row_id").sortWithinPartitions("doc_id", "row_id")
    ordered.mapInArrow(_numbered(page), _RECIPE_DDL).write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(spark.read.schema(_RECIPE_DDL).parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    return path


def _chunk_facts(batches):
    """Checks every chunk against its address; its length and crc."""
    schema = pa.schema([("digest", pa.binary()), ("n_ids", pa.int64()), ("crc", pa.int64())])
    for b in batches:
        crcs = []
        for key, n, width, payload in zip(*(b.column(c).to_pylist() for c in ("digest", "n_ids", "width", "payload"))):
            raw = np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()
            if len(raw) != 4 * n or hashlib.blake2b(raw, digest_size=DIGEST).digest() != key:
                raise ValueError(f"chunk {key.hex()} is damaged")
            crcs.append(zlib.crc32(raw))
        yield batch_of({"digest": b.column("digest"), "n_ids": b.column("n_ids"), "crc": crcs}, schema)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, n_ids long, width int, payload binary, kind string").parquet(f"{path}/entries").where("kind = 'chunk'").drop("kind")


_STEP_DDL = "row_id long, seq int, digest binary, n long, follow long"


def _steps(batches):
    """Checks every recipe against its root; a row for each of its chunks, with the ids that follow it."""
    schema = pa.schema([("row_id", pa.int64()), ("seq", pa.int32()), ("digest", pa.binary()), ("n", pa.int64()), ("follow", pa.int64())])
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            own = b.slice(lo, 256)
            held = [np.frombuffer(x, STEP) for x in own.column("steps").to_pylist()]
            for s, root, n in zip(held, *(own.column(c).to_pylist() for c in ("root", "n_tokens"))):
                if merkle([bytes(x) for x in s["digest"]]) != root or int(s["n"].sum()) != n:
                    raise ValueError("a recipe does not match its root")
            sizes = np.array([len(s) for s in held], np.int64)
            flat, first = np.concatenate(held), np.cumsum(sizes) - sizes
            n = flat["n"].astype(np.int64)
            ends = np.cumsum(n)
            yield batch_of({"row_id": np.repeat(own.column("row_id").to_numpy(), sizes), "seq": np.arange(len(flat)) - np.repeat(first, sizes), "digest": [bytes(x) for x in flat["digest"]], "n": n, "follow": np.repeat(ends[first + sizes - 1], sizes) - ends}, schema)


def _shift_crcs(batches):
    schema = pa.schema([("row_id", pa.int64()), ("n", pa.int64()), ("n_ids", pa.int64()), ("crc", pa.int64())])
    join = CrcJoin()
    for b in batches:
        crc = join.shift(b.column("crc").to_numpy(), 4 * b.column("follow").to_numpy())
        yield batch_of({c: b.column(c) for c in ("row_id", "n", "n_ids")} | {"crc": crc.astype(np.int64)}, schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, row_id, ids (array) of every document, rebuilt from recipes and chunks.

    A document's ids are one row, so they meet in one task: as large as the document.
    """
    arrow_batches(spark, 4000)
    recipes = spark.read.schema(_RECIPE_DDL).parquet(f"{path}/recipes")
    schema = pa.schema([("digest", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def opened(batches):
        for b in batches:
            yield batch_of({"digest": b.column("digest"), "ids": [np.frombuffer(p, f"<u{w}").astype(np.int64) for w, p in zip(b.column("width").to_pylist(), b.column("payload").to_pylist())]}, schema)

    ids = chunks(spark, path).mapInArrow(opened, "digest binary, ids array<long>")
    steps = recipes.select("row_id", "n_tokens", "steps", "root").mapInArrow(_steps, _STEP_DDL)
    whole = steps.join(ids, "digest").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("s"))
    return recipes.select("doc_id", "row_id").join(whole, "row_id").select("doc_id", "row_id", F.expr("flatten(transform(s, x -> x.ids))").alias("ids"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks of every document, all from the files and verified."""
    arrow_batches(spark, 4000)
    recipes = spark.read.schema(_RECIPE_DDL).parquet(f"{path}/recipes")
    manifest = spark.read.schema(_MANIFEST_DDL).parquet(f"{path}/manifest")
    said = manifest.select("part", "page", F.col("n_docs").alias("d"), F.col("n_tokens").alias("t"), F.col("root").alias("r"))
    if _manifest(recipes).join(said, ["part", "page"], "full_outer").where("not (n_docs <=> d and n_tokens <=> t and root <=> r)").limit(1).count():
        raise ValueError("a page of recipes does not match the manifest")
    total, starts = 0, []
    for part, n in sorted(manifest.groupBy("part").agg(F.sum("n_tokens")).collect()):  # as many rows as the writer had parts
        starts.append((part, total))
        total += n
    base = spark.createDataFrame(starts, "part int, base long")
    facts = chunks(spark, path).mapInArrow(_chunk_facts, "digest binary, n_ids long, crc long")
    steps = recipes.select("row_id", "n_tokens", "steps", "root").mapInArrow(_steps, _STEP_DDL)
    shifted = steps.join(facts, "digest").select("row_id", "n", "n_ids", "crc", "follow").mapInArrow(_shift_crcs, "row_id long, n long, n_ids long, crc long")
    read = shifted.groupBy("row_id").agg(F.sum("n_ids").alias("n_read"), F.count("*").alias("n_chunks"), F.bit_xor("crc").alias("ids_crc32"), F.bool_and(F.col("n") == F.col("n_ids")).alias("as_said"))
    order = recipes.join(F.broadcast(base), "part").select("doc_id", "row_id", "n_tokens", (F.col("base") + F.col("start")).alias("start"))
    whole = F.col("as_said") & (F.col("n_read") == F.col("n_tokens"))
    checked = order.join(read, "row_id", "left").withColumn("n_tokens", F.when(F.coalesce(whole, F.lit(False)), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document does not match its recipe")).cast("long")))
    return checked.select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks")
