"""Vector store operations: exact dense and sparse top-k, rank fusion, ordered lookup, upsert.

Filters are applied below every top-k, so they prune partitions and rows of the scan.
A search takes one query and ends in a limit of partial results, never in a sort of all
scores; points are kept by `sources.collection`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions.vectors import cosine
from textloom.sources.collection import Collection


def payload_filter(document_id: str | None = None, parent_ids: list[str] | None = None, child_ids: list[str] | None = None, **equal) -> Column:
    """Conjunction of equalities and memberships."""
    out = F.lit(True)
    if document_id is not None:
        out &= F.col("document_id") == document_id
    for name, values in (("parent_id", parent_ids), ("child_id", child_ids)):
        if values:
            out &= F.col(name).isin(values)
    for name, value in equal.items():
        out &= F.col(name) == value
    return out


def dense_top_k(points: DataFrame, query: list[float], k: int, where: Column | None = None, id_col: str = "child_id", vector_col: str = "dense") -> DataFrame:
    """(id, score) of the k points of largest cosine; ties to the smaller id."""
    rows = points if where is None else points.where(where)
    score = cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))
    return rows.select(F.col(id_col), score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def sparse_top_k(points: DataFrame, query: dict[int, float], k: int, where: Column | None = None, id_col: str = "child_id", sparse_col: str = "sparse") -> DataFrame:
    """(id, score) by the inner product over shared term ids; only points that share one."""
    rows = points if where is None else points.where(where)
    terms = rows.select(F.col(id_col), F.explode(sparse_col).alias("term", "weight")).where(F.col("term").isin(list(query)))
    weight = F.create_map(*[F.lit(x) for t, w in sorted(query.items()) for x in (t, float(w))])
    return terms.groupBy(id_col).agg(F.sum(F.col("weight") * F.element_at(weight, F.col("term"))).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def fuse(ranked: list[DataFrame], k: int, id_col: str = "child_id", rrf_k: int = DEFAULTS.rrf_k) -> DataFrame:
    """Reciprocal rank fusion of (id, score) lists: each is a top-k, so its ranks fit one task."""
    one = Window.partitionBy("list").orderBy(F.desc("score"), id_col)
    lists = [r.select(id_col, "score", F.lit(i).alias("list")) for i, r in enumerate(ranked)]
    every = lists[0]
    for r in lists[1:]:
        every = every.unionByName(r)
    votes = every.withColumn("rank", F.row_number().over(one)).select(id_col, (F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("vote"))
    return votes.groupBy(id_col).agg(F.sum("vote").alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def hybrid_search(points: DataFrame, dense: list[float], sparse: dict[int, float] | None, k: int, where: Column | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Dense top-k alone, or the fusion of dense and sparse lists of over_fetch * k."""
    if not sparse:
        return dense_top_k(points, dense, k, where)
    n = settings.over_fetch * k
    return fuse([dense_top_k(points, dense, n, where), sparse_top_k(points, sparse, n, where)], k, rrf_k=settings.rrf_k)


def fetch(points: DataFrame, ids: list, id_col: str = "child_id") -> DataFrame:
    """Rows of the given ids in the caller's order: repeated ids repeat, unknown ids drop."""
    spark = points.sparkSession
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"pos int, {id_col} {dict(points.dtypes)[id_col]}")
    return points.join(F.broadcast(asked), id_col).orderBy("pos")  # the caller's list, as long as a request


def points_of(children: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vector points: children with their vectors, joined by id; both page columns are kept."""
    return children.join(embeddings.select("child_id", "dense", "sparse"), "child_id")


def ensure_collection(spark: SparkSession, path: str, dim: int = DEFAULTS.embedding_dim) -> str:
    """'created' or 'kept', or 'recreated' where the collection was made for another dimension (its points go)."""
    return Collection(spark, path).ensure(dim)


def upsert(points: DataFrame, path: str, dim: int = DEFAULTS.embedding_dim) -> None:
    """Replaces the documents that occur in `points`, whole, in a collection of this dimension (made, if there is none)."""
    store = Collection(points.sparkSession, path)
    held = store.manifest()
    if held is None:
        store.ensure(dim)
    elif held.dim != dim:
        raise ValueError(f"the collection has {held.dim} components, not {dim}")
    store.upsert(points)


def delete_document(spark: SparkSession, path: str, document_id: str) -> None:
    """Removes a document's points; a missing one is no error."""
    Collection(spark, path).delete([document_id])


def count_points(spark: SparkSession, path: str, document_id: str) -> int:
    return Collection(spark, path).count(document_id)


def stored_points(spark: SparkSession, path: str) -> DataFrame:
    return Collection(spark, path).read()
