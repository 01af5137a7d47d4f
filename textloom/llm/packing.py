"""Best-fit packing of documents into sequences, by hierarchical residual rounds.

Documents become token pieces of at most `size` tokens (only longer documents are
cut; the remainder is the first piece). Full pieces are sequences at once. The
others are dealt to nodes by hash; every node packs its items best-fit, longest
first, emits the bins that are nearly full and hands its underfull bins on as
items. Neighbouring nodes meet in one node of the next round, as many as make
`merge_bins` underfull bins, until one is left, which emits all. So a node holds a
bounded number of items or bins. A bin travels as one row with its members, and a bin
that not even the smallest item left in the round could enter is emitted early. If a
round leaves so many underfull bins that the next would have over three quarters of
its nodes, bins do not go together any more, and all are emitted.

Defined cases: null text is empty (one piece, the end id alone); ties are settled
by the members' bytes, so a repeated task gives the same bins; repeated rows are
packed each; an empty table gives no row.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_batches, batch_of, id_text, materialise
from textloom.llm.ids import byte_bpe

SIZE = 2048
END_ID = 0
#: A bin with at most this many free tokens is nearly full and leaves before the last round.
SLACK = 4
#: Items of a node of the first round, and bins of a node of the later ones.
NODE_ITEMS, MERGE_BINS = 40_000, 200_000

MEMBER = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "bin_id long, node long, fill int, done boolean, members binary"


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the remainder first, then full ones."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))] if n else []


def best_fit(fills: list[int], size: int = SIZE) -> list[list[int]]:
    """Best-fit decreasing over item sizes, already sorted longest first: item numbers by bin.

    Bins are kept by free space; the set of free spaces in use is one integer, so
    the tightest bin that fits is a shift and a lowest-bit away.
    """
    by_free: list[list[list[int]]] = [[] for _ in range(size + 1)]
    used, bins = 0, []
    for i, n in enumerate(fills):
        fit = used >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                used &= ~(1 << free)
        else:
            free, b = size, []
            bins.append(b)
        b.append(i)
        by_free[free - n].append(b)
        used |= 1 << (free - n)
    return bins


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: tokenised once, no ids leave the task."""
    arrow_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        t = byte_bpe(tokenizer_path)
        for b in batches:
            rows = []
            for d, ids in zip(b.column("doc_id").to_pylist(), t.encode(b.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False)
                rows += [(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), size))]
            yield batch_of({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema)

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def _round(level: int, size: int, slack: int):
    schema = pa.schema([("bin_id", pa.int64()), ("node", pa.int64()), ("fill", pa.int32()), ("done", pa.bool_()), ("members", pa.binary())])

    def run(batches):
        nodes: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            for node, fill, members in zip(b.column("node").to_pylist(), b.column("fill").to_pylist(), b.column("members").to_pylist()):
                nodes.setdefault(node, []).append((fill, members))
        for node in sorted(nodes):
            items = sorted(nodes[node], key=lambda x: (-x[0], x[1]))
            packed = best_fit([n for n, _ in items], size)
            fills = [sum(items[i][0] for i in b) for b in packed]
            for lo in range(0, len(packed), 2000):
                part = range(lo, min(lo + 2000, len(packed)))
                yield batch_of({"bin_id": [(level << 56) | (node << 28) | k for k in part], "node": [node for _ in part], "fill": [fills[k] for k in part], "done": [size - fills[k] <= slack for k in part], "members": [b"".join(items[i][1] for i in packed[k]) for k in part]}, schema)

    return run


def pack(items: DataFrame, size: int = SIZE, slack: int = SLACK, node_items: int = NODE_ITEMS, merge_bins: int = MERGE_BINS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    `items` is read several times: pass a materialised table.
    """
    spark = items.sparkSession
    whole = items.where(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < size)
    n = max(1, math.ceil(rest.count() / node_items))
    packing = pa.schema([("node", pa.int64()), ("fill", pa.int32()), ("members", pa.binary())])

    def rows(batches):
        for b in batches:
            c = {f: b.column(f).to_pylist() for f in ("doc_id", "piece", "start", "length", "ids_crc32")}
            m = np.zeros(b.num_rows, MEMBER)
            m["doc_id"], m["has_id"] = [0 if x is None else x for x in c["doc_id"]], [x is not None for x in c["doc_id"]]
            m["piece"], m["start"], m["length"], m["crc"] = c["piece"], c["start"], c["length"], c["ids_crc32"]
            yield batch_of({"node": b.column("node"), "fill": c["length"], "members": [x.tobytes() for x in m]}, packing)

    dealt = rest.withColumn("node", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(n)))
    level_in = dealt.mapInArrow(rows, "node long, fill int, members binary")
    done, level = None, 0
    while True:
        out = materialise(level_in.repartition(n, "node").mapInArrow(_round(level, size, slack), BINS), f"bins{level}")
        least = out.where("not done").agg(F.min("fill")).first()[0]
        full = F.col("done") if least is None else F.col("done") | (size - F.col("fill") < least)
        after = math.ceil(out.where(~full).count() / merge_bins)
        last = not after or n == 1 or after > 0.75 * n
        leaving = out if last else out.where(full)
        done = leaving if done is None else done.unionByName(leaving)
        if last:
            break
        level_in = out.where(~full).select(F.floor(F.col("node") * after / n).cast("long").alias("node"), "fill", "members")
        n, level = after, level + 1
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def placed(batches):
        for b in batches:
            for seq, members in zip(b.column("bin_id").to_pylist(), b.column("members").to_pylist()):
                m = np.frombuffer(members, MEMBER)
                ends = np.cumsum(m["length"].astype(np.int64))
                yield batch_of({"doc_id": [int(d) if h else None for d, h in zip(m["doc_id"], m["has_id"])], "piece": m["piece"], "start": m["start"], "length": m["length"].astype(np.int64), "ids_crc32": m["crc"].astype(np.int64), "sequence_id": np.full(len(m), seq), "offset": ends - m["length"]}, schema)

    columns = [f.name for f in schema]
    return whole.select(columns).unionByName(done.select("bin_id", "members").mapInArrow(placed, f"{PIECES}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places, in as few sequences as best fit finds."""
    return pack(materialise(pieces(docs, tokenizer_path, size, id_col, text_col), "pieces"), size)
