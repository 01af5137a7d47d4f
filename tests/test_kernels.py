"""Order-dependent steps over sentences against plain or column versions."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions import kernels as K
from textloom.functions import text as T
from textloom.operators import chunk

RNG = random.Random(7)


def test_border_equals_every_try():
    for _ in range(2000):
        a, b = ([RNG.choice("ab") for _ in range(RNG.randint(0, 9))] for _ in range(2))
        assert K.border(a, b) == max(k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k])


def test_border_of_very_long_texts(spark):
    same = ["w", "v"] * 50_000
    df = spark.createDataFrame([(" ".join(["x", *same]), " ".join([*same, "y"])), (None, "a"), ("", "a"), ("b a", "a c")], "a string, b string")
    assert [r.k for r in df.select(T.word_overlap(F.col("a"), F.col("b")).alias("k")).collect()] == [100_000, None, 0, 1]


def test_last_sentence_equals_the_column(spark):
    pieces = ["Dr. ", "He went. ", "e.g. ", "See Fig. 3 now. ", "It is 3.14 wide! ", '"Quoted." ', "no capital. then ", "Why? (Because.) ", "\n", "\x1c", "vol. 2. ", "End", "Table. 4-1 holds. ", "Étage. Été. "]
    texts = ["", " ", *["".join(RNG.choice(pieces) for _ in range(RNG.randint(1, 9))) for _ in range(150)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.last_sentence(F.col("t")).alias("last"), T.is_meaningful(F.col("t")).alias("means")).collect():
        assert (K.last_sentence(r.t), K.meaningful(r.t)) == (r.last, r.means), repr(r.t)


def test_vectors_of_rows():
    rows = [[[1.0, 2.0], [3.0]], None, [], [None, [4.0]], [[5.0, 6.0]]]
    for array in (pa.array(rows), pa.array([[[9.0]], *rows]).slice(1)):
        got = K.rows_of_vectors(array)
        assert [None if r is None else [list(v) for v in r] for r in got] == [[[1.0, 2.0], [3.0]], None, [], [[], [4.0]], [[5.0, 6.0]]]
    assert K.rows_of_vectors(pa.array([None, []], pa.list_(pa.list_(pa.float64())))) == [None, []]


def test_missing_and_unequal_vectors_are_not_similar():
    v = [np.array([1.0, 0.0]), np.zeros(0), np.array([1.0]), np.zeros(2)]
    assert K.pack_similar(["a", "b", "c", "d"], v, 99, 0.5) == ["a", "b", "c", "d"]
    assert K.pack_similar(["a", "b"], [v[0], v[0]], 99, 0.5) == ["a b"] and K.pack_similar([], [], 9, 0.5) == []


def test_children_of_odd_parents(spark):
    rows = [("d", "p0", 0, 1, 3, None, ["One is here now.", "Two is there now."], [[1.0], [1.0]]), ("d", "p1", 1, None, None, "x", [], []), ("d", "p2", 2, 4, 2, "x", ["Three is gone away."], None), ("d", "p3", 3, 1, 1, "x", None, None)]
    df = spark.createDataFrame(rows, "document_id string, parent_id string, parent_order int, page_start int, page_end int, content string, sentences array<string>, vectors array<array<float>>").withColumn("cut", F.lit(1))
    got = [(r.parent_id, r.child_order, r.page_start, r.page_end, r.content) for r in chunk.children_of(df).orderBy("parent_id").collect()]
    assert got == [("p0", 0, 1, 3, "One is here now. Two is there now."), ("p2", 0, 4, 4, "Three is gone away.")]
    assert chunk.children_of(df.limit(0)).count() == 0


def test_embedder_is_asked_for_a_batch_at_a_time(spark, tmp_path):
    calls = tmp_path / "calls"
    vector = {"a b": [1.0, 0.0], "c d": [0.9, 0.1], "a b c d": [1.0, 0.0], "e f": [0.0, 1.0]}

    def embed(texts):
        with calls.open("a") as f:
            f.write(f"{len(texts)}\n")
        assert len(set(texts)) == len(texts)
        return [vector[t] for t in texts]

    rows = [(i, ["a b", "c d", "e f"]) for i in range(40)] + [(98, []), (99, ["a b"])]
    df = spark.createDataFrame(rows, "i int, sentences array<string>").coalesce(1)
    got = {r.i: r.packed for r in chunk.pack_by_embedder(df, embed, Settings()).select("i", "packed").collect()}
    assert got == {i: (["a b c d", "e f"] if len(s) == 3 else s) for i, s in rows}
    assert calls.read_text().split() == ["2", "2"]  # of all rows together; what has a vector already is not asked for
    assert DEFAULTS.child_similarity <= 1
