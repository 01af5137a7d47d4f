"""Approximate nearest neighbours: anisotropic quantisation, four-bit scans, exact reranking.

Vectors are scaled to length one, so the largest cosine is the largest inner
product. Product codes of four bits a subspace are fitted with a loss that counts
the residual along the vector `eta` times as much as the residual across it: only
the parallel part shifts the inner products of queries that score high. A block
of candidates is scanned with 8-bit lookup tables (one for each query, 16 entries
a subspace); the best `rerank` of a block are scored exactly on the original
vectors in double precision.

Every valid row is indexed; the codebooks are fitted on at most `fit_rows` rows
(those with the smallest hashes). Queries and candidates are dealt to blocks of
bounded size, a task holds one pair of blocks, and only `k` rows of each query and
block leave it.

Defined cases: vectors that are null, zero, of another length than most, or hold
a null or non-finite component take no part, neither as query nor as candidate;
rows of the query's own vec_id are no candidates of it; ties go to the smaller
vec_id; with fewer than `k` candidates all are returned; empty tables give no row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import arrow_batches, batch_of, materialise

CENTROIDS = 16
SUB_DIM = 2
#: Inner products from here on are the ones whose error counts.
SCORE_THRESHOLD = 0.2
FIT_ROWS = 20_000
FIT_ROUNDS = 6
BLOCK = 4096
QUERY_BLOCK = 512
RERANK = 192


def parallel_weight(dim: int, threshold: float = SCORE_THRESHOLD) -> float:
    """How much more the parallel residual counts, for unit vectors of `dim` components."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


class Quantiser:
    """codebooks: (subspaces, 16, sub_dim)."""

    def __init__(self, codebooks: np.ndarray, dim: int, eta: float):
        self.codebooks, self.dim, self.eta = codebooks, dim, eta

    def split(self, x: np.ndarray) -> np.ndarray:
        m, _, s = self.codebooks.shape
        return np.pad(x, ((0, 0), (0, m * s - self.dim))).reshape(len(x), m, s)

    def encode(self, unit: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (eta - 1) (r . x)^2, from the nearest centroids."""
        x, books = self.split(unit), self.codebooks
        codes = np.stack([((x[:, m, None] - books[m]) ** 2).sum(2).argmin(1) for m in range(len(books))], 1)
        dots = np.stack([((x[:, m] - books[m][codes[:, m]]) * x[:, m]).sum(1) for m in range(len(books))], 1)
        total = dots.sum(1)
        for _ in range(passes):
            for m in range(len(books)):
                r = x[:, m, None] - books[m]
                along = (r * x[:, m, None]).sum(2)
                loss = (r**2).sum(2) + (self.eta - 1) * ((total - dots[:, m])[:, None] + along) ** 2
                codes[:, m] = loss.argmin(1)
                new = along[np.arange(len(x)), codes[:, m]]
                total += new - dots[:, m]
                dots[:, m] = new
        return codes.astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """8-bit lookup tables (queries, subspaces, 16), on one scale for each query."""
        t = np.einsum("qms,mks->qmk", self.split(queries), self.codebooks)
        t -= t.min(2, keepdims=True)
        scale = t.max((1, 2), keepdims=True)
        return np.round(t / np.where(scale > 0, scale, 1) * 255).astype(np.uint8)


def fit(unit: np.ndarray, seed: int = 1, rounds: int = FIT_ROUNDS) -> Quantiser:
    """Codebooks by alternating anisotropic assignment and weighted least squares."""
    dim = unit.shape[1]
    m = math.ceil(dim / SUB_DIM)
    q = Quantiser(np.zeros((m, CENTROIDS, SUB_DIM)), dim, parallel_weight(dim))
    x = q.split(unit)
    rng = np.random.default_rng(seed)
    q.codebooks = np.stack([x[rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS), j] for j in range(m)])
    for _ in range(rounds):
        codes = q.encode(unit, passes=1)
        dots = np.stack([((x[:, j] - q.codebooks[j][codes[:, j]]) * x[:, j]).sum(1) for j in range(m)], 1)
        total = dots.sum(1)
        for j in range(m):
            v, c = x[:, j], codes[:, j]
            w = q.eta - 1
            outer = np.eye(SUB_DIM) + w * v[:, :, None] * v[:, None, :]
            right = v + w * v * (total - dots[:, j] + (v * v).sum(1))[:, None]
            for k in np.unique(c):
                own = c == k
                q.codebooks[j, k] = np.linalg.solve(outer[own].sum(0), right[own].sum(0))
            new = ((v - q.codebooks[j][c]) * v).sum(1)
            total += new - dots[:, j]
            dots[:, j] = new
    return q


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of table entries (queries, candidates); 32-bit."""
    out = np.zeros((len(tables), len(codes)), np.int32)
    for m in range(codes.shape[1]):
        out += tables[:, m][:, codes[:, m]]
    return out


def valid(vector: Column) -> Column:
    inf = F.lit(float("inf"))
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision of one query and rows."""
    return (rows * query).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS) -> tuple[DataFrame, Quantiser | None]:
    """(vec_id, vector, codes) of every valid row, materialised, and the quantiser."""
    spark = vectors.sparkSession
    arrow_batches(spark, 4096)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return materialise(rows.withColumn("codes", F.lit(b"")), "index"), None
    rows = rows.where(F.size("vector") == sizes[0].d)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("vector").toPandas()
    q = fit(_unit(_matrix(sample["vector"])))
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("codes", pa.binary())])

    def encode(batches):
        for b in batches:
            v = np.asarray(b.column("vector").values, np.float64).reshape(b.num_rows, -1) if b.num_rows else None
            codes = q.encode(_unit(v)) if b.num_rows else np.zeros((0, 2), np.uint8)
            codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
            packed = codes[:, ::2] | codes[:, 1::2] << 4
            yield batch_of({"vec_id": b.column("vec_id"), "vector": b.column("vector"), "codes": [c.tobytes() for c in packed]}, schema)

    return materialise(rows.mapInArrow(encode, "vec_id long, vector array<double>, codes binary"), "index"), q


def search(index: DataFrame, q: Quantiser | None, queries: DataFrame, k: int = 5, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found of every query (vec_id, vector).

    Rows of `queries` that share an id are queries of their own, each with its own vector and
    k rows; candidates that have the query's id are its own and are not found.
    """
    spark = index.sparkSession
    out = "query_row long, query_id long, vec_id long, score double"
    if q is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_c, n_q = (max(1, math.ceil(df.count() / size)) for df, size in ((index, BLOCK), (queries, QUERY_BLOCK)))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    numbered = queries.select(F.monotonically_increasing_id().alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"))  # columns of its own: queries may be rows of the index
    left = numbered.select("query_row", "query_id", "asked", F.pmod(F.xxhash64("query_row"), F.lit(n_q)).cast("int").alias("qb"), blocks(n_c).alias("cb"))
    right = index.select("vec_id", "vector", "codes", F.pmod(F.xxhash64("vec_id"), F.lit(n_c)).cast("int").alias("cb"), blocks(n_q).alias("qb"))
    m = len(q.codebooks)

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_row": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        b = b.sort_values("vec_id", kind="stable")
        ids, rows, asked = b["vec_id"].to_numpy(), _matrix(b["vector"]), _matrix(a["asked"])
        packed = np.frombuffer(b"".join(b["codes"]), np.uint8).reshape(len(b), -1)
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(b), -1)[:, :m]
        key = scan(q.tables(_unit(asked)), codes).astype(np.int64) * len(b) + np.arange(len(b))[::-1]
        key[a["query_id"].to_numpy()[:, None] == ids] = -1
        take = min(len(b), max(rerank, k))
        best = np.argpartition(-key, take - 1, axis=1)[:, :take]
        found = []
        for i, (row, query) in enumerate(zip(a["query_row"], a["query_id"])):
            at = np.sort(best[i][key[i, best[i]] >= 0])
            s = cosine(asked[i], rows[at])
            top = np.lexsort((ids[at], -s))[:k]
            found.append(pd.DataFrame({"query_row": row, "query_id": query, "vec_id": ids[at[top]], "score": s[top]}))
        return pd.concat(found)

    near = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(pair, out)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
