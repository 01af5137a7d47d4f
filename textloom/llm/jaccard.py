"""N-gram Jaccard join: blocked sparse matrix products of document by n-gram incidence.

The matrix has a row for each distinct shingle set and a column for each shingle.
It is never whole in one place:

1. Tasks hash the shingles of their documents and deal the incidences, as sorted
   blobs, to column buckets. A bucket counts each column and sends back only
   columns that more than one row holds (the others add nothing to any overlap).
2. A row whose shared columns are fewer than 75 % of its size links with nothing:
   the overlap with any partner must reach that bound. The rest is the reduced matrix.
3. In the order of column counts, rarest first, two rows that link share a column
   among the first `size - ceil(0.75 size) + 1` of each. Rows are chained along such
   columns, in order of size and only while the sizes allow a link; the chains'
   components split the matrix into independent diagonal parts.
4. A part is cut into blocks of rows. Every pair of blocks is one product of a
   block by the other's transpose, accumulated over column slices; overlaps below
   the bound that the sizes give are discarded. Only spanning links and link
   counts leave the product, so pairs are never rows.
5. Components of the spanning links are the classes.

Rows with equal sets are one row with a weight: each task sends one row for a set, with
the ids of its documents, and the classes of equal sets, by 128-bit digest, are numbered.
Shingles are 64-bit hashes of five 64-bit word hashes. Buckets follow the size of the
input, and each has a partition of its own.

Defined cases: null, empty or wordless text has an empty set and links with
nothing; with fewer than five words the whole sequence is the one shingle; equal
rows are linked; a null doc_id keeps its row, and a class of null ids alone has a null
component; repeated ids are linked by their texts only. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import arrow_batches, batch_of, bucket_keys, id_text, join_unique, materialise, partitions_for, release, splitmix
from textloom.llm.components import components, forest

WIDTH = 5
#: Link when 100 * overlap >= PERCENT * union.
PERCENT = 75
#: Rows of a block; a product of two blocks holds this many overlaps squared.
BLOCK = 1024
#: Columns of a slice of a product.
SLICE = 1024
#: Incidences that a task gathers before it deals them, at least; and the most column buckets.
GATHER, BUCKETS = 150_000, 20_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())  # bytes: only A-Z have a lower case


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64) * _ODD[5]
    for k in range(n):
        h = splitmix(h + w[k : len(w) - n + 1 + k] * _ODD[k % 5]) if k == n - 1 else (h + w[k : len(w) - n + 1 + k] * _ODD[k % 5]) * _ODD[0]
    return np.unique(h)


def least_overlap(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Overlap that a set of n needs with any partner: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def _pack(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted 64-bit values as differences of the fewest bytes that hold them."""
    d = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return width, np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(width: int, blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


#: One row type for all exchanges of step 1 and 2: kind, keys and up to three blobs.
_FLOW = pa.schema([("deal", pa.int64()), ("kind", pa.string()), ("part", pa.int64()), ("bucket", pa.int32()), ("width", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_FLOW_DDL = "deal long, kind string, part long, bucket int, width int, a binary, b binary, c binary"
_META = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("n", "<i8"), ("digest", "V16"), ("own", "<i4")])


def _incidences(keys: np.ndarray, width: int):
    """Documents to one meta row and a posting row for each column bucket, by gathered part."""
    buckets = len(keys)
    most = max(GATHER, 500 * buckets)

    def emit(part, docs, sets):
        meta = np.zeros(len(docs), _META)
        first: dict[bytes, int] = {}
        for i, (d, s) in enumerate(zip(docs, sets)):
            key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            meta[i] = (0 if d is None else d, d is not None, len(s), np.void(key), first.setdefault(key, i))
        yield {"deal": part, "kind": "meta", "part": part, "bucket": -1, "width": 0, "a": meta.tobytes(), "b": b"", "c": b""}
        own = [i for i in range(len(docs)) if meta["own"][i] == i and len(sets[i])]
        if not own:
            return
        cols = np.concatenate([sets[i] for i in own])
        rows = np.repeat(np.asarray(own, np.uint32), [len(sets[i]) for i in own])
        order = np.argsort(cols, kind="stable")
        cols, rows = cols[order], rows[order].astype("<u2" if len(docs) < 65536 else "<u4")
        edges = np.searchsorted(cols, np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64))
        for k, (lo, hi) in enumerate(zip([0, *edges], [*edges, len(cols)])):
            if hi > lo:
                w, blob = _pack(cols[lo:hi])
                yield {"deal": int(keys[k]), "kind": "post", "part": part, "bucket": k, "width": w, "a": blob, "b": rows[lo:hi].tobytes(), "c": b"\x02" if rows.itemsize == 2 else b"\x04"}

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        docs, sets, size = [], [], 0

        def flush():
            nonlocal docs, sets, size, part
            rows = list(emit(part, docs, sets))
            docs, sets, size, part = [], [], 0, part + 1
            for lo in range(0, len(rows), 500):
                yield batch_of({f.name: [r[f.name] for r in rows[lo : lo + 500]] for f in _FLOW}, _FLOW)

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                docs.append(d)
                sets.append(shingles(t, width))
                size += len(sets[-1])
                if size >= most:
                    yield from flush()
        if docs:
            yield from flush()

    return run


def _shared_columns(batches):
    """Bucket tasks: columns that several rows hold, numbered, back to the parts that hold them."""

    def finish(bucket, posts):
        posts.sort(key=lambda x: x[0])
        cols = [_unpack(w, a) for _, w, a, _, _ in posts]
        sizes = [len(c) for c in cols]
        flat = np.concatenate(cols)
        del cols
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(start, len(ordered)))
        number = np.empty(len(flat), np.uint32)
        number[order] = np.repeat(np.cumsum(count > 1) - 1, count).astype(np.uint32)
        df = np.empty(len(flat), np.uint8)
        df[order] = np.repeat(np.minimum(count, 255), count)
        del flat, ordered, order
        at = 0
        for (part, _, _, own, kind), n in zip(posts, sizes):
            keep = df[at : at + n] > 1
            if keep.any():
                own = np.frombuffer(own, "<u2" if kind == b"\x02" else "<u4")[keep].astype("<u4")
                yield batch_of({"deal": [part], "kind": ["post"], "part": [part], "bucket": [bucket], "width": [0], "a": [number[at : at + n][keep].astype("<u4").tobytes()], "b": [own.tobytes() if len(own) == 0 or own.max() > 65535 else own.astype("<u2").tobytes()], "c": [df[at : at + n][keep].tobytes()]}, _FLOW)
            at += n

    by_bucket: dict[int, list] = {}
    for b in batches:
        for r in b.to_pylist():
            if r["kind"] == "meta":
                yield batch_of({f.name: [r[f.name]] for f in _FLOW}, _FLOW)
            else:
                by_bucket.setdefault(r["bucket"], []).append((r["part"], r["width"], r["a"], r["b"], r["c"]))
    for bucket in sorted(by_bucket):
        yield from finish(bucket, by_bucket.pop(bucket))


_ROW = pa.schema([("kind", pa.string()), ("ids", pa.list_(pa.int64())), ("low", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("cols", pa.binary()), ("prefix", pa.int32())])
_ROW_DDL = "kind string, ids array<long>, low long, n long, digest binary, cols binary, prefix int"


def _rows(percent: int):
    """Part tasks: rows of the reduced matrix, and every distinct set's size, digest and documents."""

    def finish(meta_blob, posts):
        posts.sort(key=lambda x: x[0])
        meta = np.frombuffer(meta_blob, _META)
        digests = [bytes(x) for x in meta["digest"]]
        order = np.argsort(meta["own"], kind="stable")
        sets, first = np.unique(meta["own"][order], return_index=True)
        ids = [None if not h else int(d) for d, h in zip(meta["doc_id"][order], meta["has_id"][order])]
        of = [ids[a:z] for a, z in zip(first, [*first[1:], len(ids)])]
        for lo in range(0, len(sets), 4096):
            own = sets[lo : lo + 4096]
            members = of[lo : lo + 4096]
            yield batch_of({"kind": ["set"] * len(own), "ids": members, "low": [min((x for x in m if x is not None), default=None) for m in members], "n": meta["n"][own], "digest": [digests[i] for i in own], "cols": [None] * len(own), "prefix": [None] * len(own)}, _ROW)
        if not posts:
            return
        cols = np.concatenate([np.frombuffer(a, "<u4").astype(np.uint64) | np.uint64(k << 32) for k, a, _, _ in posts])
        rows = np.concatenate([np.frombuffer(b, "<u2" if 2 * len(c) == len(b) else "<u4").astype(np.int64) for _, _, b, c in posts])
        df = np.concatenate([np.frombuffer(c, np.uint8) for _, _, _, c in posts])
        order = np.lexsort((cols, df, rows))
        cols, rows = cols[order], rows[order]
        shared = np.bincount(rows, minlength=len(meta))
        need = least_overlap(meta["n"], percent)
        ends = np.cumsum(shared)
        kept = [i for i in np.flatnonzero(shared >= need) if shared[i]]
        for lo in range(0, len(kept), 256):
            own = kept[lo : lo + 256]
            yield batch_of({"kind": ["row"] * len(own), "ids": [None] * len(own), "low": [None] * len(own), "n": meta["n"][own], "digest": [digests[i] for i in own], "cols": [cols[ends[i] - shared[i] : ends[i]].tobytes() for i in own], "prefix": [int(shared[i] - need[i] + 1) for i in own]}, _ROW)

    def run(batches):
        meta: dict[int, bytes] = {}
        posts: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == "meta":
                    meta[r["part"]] = r["a"]
                else:
                    posts.setdefault(r["part"], []).append((r["bucket"], r["a"], r["b"], r["c"]))
        for part in sorted(meta):
            yield from finish(meta.pop(part), posts.pop(part, []))

    return run


_PREFIX = pa.schema([("deal", pa.int64()), ("col", pa.binary()), ("node", pa.binary()), ("n", pa.binary())])
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _prefixes(keys: np.ndarray):
    def run(batches):
        for b in batches:
            cols = [np.frombuffer(c, "<u8")[:k] for c, k in zip(b.column("cols").to_pylist(), b.column("prefix").to_pylist())]
            if not cols:
                continue
            sizes = [len(c) for c in cols]
            flat = np.concatenate(cols)
            node, n = np.repeat(b.column("node").to_numpy(), sizes), np.repeat(b.column("n").to_numpy(), sizes)
            deal = keys[(splitmix(flat) % np.uint64(len(keys))).astype(np.int64)]
            order = np.argsort(deal, kind="stable")
            at = np.flatnonzero(np.diff(deal[order], prepend=-1))
            out = {"deal": [], "col": [], "node": [], "n": []}
            for own in np.split(order, at[1:]):
                out["deal"].append(int(deal[own[0]]))
                for k, v in (("col", flat), ("node", node), ("n", n.astype("<i8"))):
                    out[k].append(v[own].tobytes())
            yield batch_of(out, _PREFIX)

    return run


def _chains(percent: int):
    """Bucket tasks: rows that hold a column, chained in order of size while a link is possible."""

    def run(batches):
        cols, nodes, sizes = [], [], []
        for b in batches:
            for c, d, n in zip(*(b.column(k).to_pylist() for k in ("col", "node", "n"))):
                cols.append(np.frombuffer(c, "<u8"))
                nodes.append(np.frombuffer(d, "<i8"))
                sizes.append(np.frombuffer(n, "<i8"))
        if not cols:
            return
        c, d, n = np.concatenate(cols), np.concatenate(nodes), np.concatenate(sizes)
        order = np.lexsort((d, n, c))
        c, d, n = c[order], d[order], n[order]
        ok = (c[1:] == c[:-1]) & (100 * n[:-1] >= percent * n[1:]) & (d[1:] != d[:-1])
        u, v = forest(d[1:][ok], d[:-1][ok])
        for lo in range(0, len(u), 50_000):
            yield batch_of({"u": u[lo : lo + 50_000], "v": v[lo : lo + 50_000]}, _EDGE)

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None, width: int = SLICE) -> np.ndarray:
    """Overlap counts of row sets a by b (or by themselves), summed over column slices."""
    every = a if b is None else a + b
    sizes = [len(x) for x in every]
    uniq, col = np.unique(np.concatenate(every), return_inverse=True)
    row = np.repeat(np.arange(len(every)), sizes)
    held = np.bincount(col, minlength=len(uniq))
    number = np.cumsum(held > 1) - 1  # columns that one row holds add nothing
    use = held[col] > 1
    col, row = number[col[use]], row[use]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out = np.zeros((len(a), len(a if b is None else b)), np.float32)
    total = int(col[-1]) + 1 if len(col) else 0
    for lo in range(0, total, width):
        i, j = np.searchsorted(col, (lo, lo + width))
        m = np.zeros((len(every), min(width, total - lo)), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        out += m[: len(a)] @ (m if b is None else m[len(a) :]).T
    return out


_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def _products(percent: int):
    """Pair-of-blocks tasks: spanning links (u, v) and weighted link counts (u, null, links)."""

    def product(rows):
        first, second = [r for r in rows if r["b"] == r["i"]], [r for r in rows if r["b"] == r["j"]]
        same = rows[0]["i"] == rows[0]["j"]
        if not first or not second:
            return
        sets = lambda side: [np.frombuffer(r["cols"], "<u8") for r in side]
        arr = lambda side, k: np.array([r[k] for r in side], np.int64)
        n, m = arr(first, "n"), arr(second, "n")
        least = -(-percent * (n[:, None] + m[None, :]) // (100 + percent))  # overlap bound from both sizes
        o = overlaps(sets(first), None if same else sets(second))
        link = o >= least
        if same:
            np.fill_diagonal(link, False)
        x, y = np.nonzero(link)
        if not len(x):
            return
        left, right = arr(first, "node"), arr(second, "node")
        u, v = forest(left[x], right[y])
        yield from zip(u.tolist(), v.tolist(), [0] * len(u))
        counts = [(left, link @ arr(second, "weight"))] + ([] if same else [(right, link.T @ arr(first, "weight"))])
        for node, c in counts:
            for k in np.flatnonzero(c):
                yield int(node[k]), None, int(c[k])

    def run(batches):
        rows, key, out = [], None, []
        for b in batches:
            for r in b.to_pylist():
                now = (r["component"], r["i"], r["j"])
                if now != key and rows:
                    out += product(rows)
                    rows = []
                key = now
                rows.append(r)
            if len(out) > 20_000:
                yield batch_of({f.name: [x[k] for x in out] for k, f in enumerate(_LINK)}, _LINK)
                out = []
        if rows:
            out += product(rows)
        yield batch_of({f.name: [x[k] for x in out] for k, f in enumerate(_LINK)}, _LINK)

    return run


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents it links with) of every document."""
    arrow_batches(docs.sparkSession, 256)
    texts = id_text(docs, id_col, text_col)
    n = min(BUCKETS, partitions_for(texts))
    keys = bucket_keys(docs.sparkSession, n)
    shared = texts.mapInArrow(_incidences(keys, width), _FLOW_DDL).repartition(n, "deal").mapInArrow(_shared_columns, _FLOW_DDL)
    reduced = materialise(shared.repartition(n, "deal").mapInArrow(_rows(percent), _ROW_DDL), "reduced")
    sets = reduced.where("kind = 'set'").select("ids", "low", "n", "digest")
    same = sets.where("n > 0").groupBy("digest").agg(F.sum(F.size("ids")).alias("weight"), F.count("*").alias("parts"), F.min("low").alias("low"))
    classes = materialise(same.withColumn("node", F.monotonically_increasing_id()), "sets")
    once = reduced.where("kind = 'row'").select("digest", "n", "cols", "prefix").dropDuplicates(["digest"])
    rows = materialise(once.join(classes.select("digest", "node", "weight"), "digest"), "rows")
    chained = rows.select("node", "n", "cols", "prefix").mapInArrow(_prefixes(keys), "deal long, col binary, node binary, n binary").repartition(n, "deal").mapInArrow(_chains(percent), "u long, v long")
    parts = materialise(components(chained, "chains"), "parts")
    sizes = materialise(parts.groupBy("component").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / block).cast("int")), "sizes")
    placed = join_unique(parts, sizes, "component", "size").select("node", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("b"))
    pairs = rows.join(placed, "node").select("component", "node", "n", "weight", "cols", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("component", "node", "n", "weight", "cols", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    blocks = pairs.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    links = materialise(blocks.mapInArrow(_products(percent), "u long, v long, links long"), "links")
    release(rows, parts, sizes)
    joined = components(links.where("v is not null").select("u", "v"), "classes")
    counts = links.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    facts = materialise(classes.join(joined, "node", "left").join(counts, "node", "left").select("digest", "weight", "parts", "low", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "facts")
    least = materialise(facts.groupBy("component").agg(F.count("*").alias("members"), F.min("low").alias("component_id")), "least")
    named = materialise(join_unique(facts, least, "component", "members").select("digest", "weight", "parts", "component_id", "links"), "named")
    linked = join_unique(sets.where("n > 0"), named, "digest", "parts").select(F.explode("ids").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    alone = sets.where("n = 0").select(F.explode("ids").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their class, with all their columns.

    Rows that repeat an id with the same text stay once, the first by its other columns (as
    JSON); texts without words are no one's copies and all stay. Rows of one id with different texts stay or go together.
    """
    found = jaccard_join(docs, width, percent, id_col=id_col, text_col=text_col)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__loom_id")).distinct()
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    stay = docs.withColumn("__loom_key", key).join(kept, F.col("__loom_key").eqNullSafe(F.col("__loom_id")), "left_semi")
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != text_col]))
    order = Window.partitionBy("__loom_key", F.xxhash64(text)).orderBy(others)
    first = stay.withColumn("__loom_no", F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.row_number().over(order)).otherwise(1))
    return first.where("__loom_no = 1").select(*docs.columns)
