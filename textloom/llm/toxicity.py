"""Toxicity scores: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with word-edge marks) and itself,
hashed to buckets; its vector is the mean of theirs, a text's vector the mean over
its words, and a two-class softmax reads it. Embeddings and softmax are trained
jointly in numpy, so an unseen misspelling shares most n-gram vectors with the
word it comes from. As the model is linear above the averages, a trained model is
one number for each bucket and a bias, which every task scores whole texts with.

Training takes at most `max_rows` labelled texts (a documented bound: those with
the smallest hashes of their ids) and at most `max_bytes` of UTF-8 in all; a text that
does not fit any more is passed by, before it is sent to the driver.

Defined cases: null or empty text, or one without words, gets the score of the
bias alone; with no labelled row of both classes every score is the share of
label 1 (0 without any labels); conflicting labels of one id are both learnt from;
null labels are not; repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_batches, batch_of, id_text

BUCKETS = 1 << 19
DIM = 8
GRAMS = (3, 4, 5)
MAX_ROWS = 13_000
MAX_BYTES = 48_000_000
EPOCHS = 8
RATE = 2.0
#: A bucket that n training texts hold starts and learns at n / (n + RARE) of the rate: rare ones are damped, not left out.
RARE = 10
SEED = 7
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def buckets(word: str, n_buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word and its n-grams."""
    w = f"<{word}>"
    grams = dict.fromkeys([w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)])
    grams[w] = None
    return [zlib.crc32(g.encode()) % n_buckets for g in grams]


class Model:
    """weights: one number for each bucket; score = 1 / (1 + exp(-(bias + mean over words)))."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}
        self.at = array("f", weights).__getitem__  # single entries come faster than from numpy

    def word(self, w: str) -> float:
        v = self.known.get(w)
        if v is None:
            if len(self.known) > 400_000:
                self.known.clear()
            v = self.known[w] = self._mean(buckets(w, len(self.weights)))
        return v

    def _mean(self, found: list[int]) -> float:
        return sum(map(self.at, found)) / len(found)

    def score(self, text: str) -> float:
        found = words(text)
        known = self.known.get
        total = sum([self.word(w) if (v := known(w)) is None else v for w in found])
        return float(1 / (1 + np.exp(-np.clip(self.bias + (total / len(found) if found else 0.0), -500, 500))))


def train(texts: list[str], labels: list[int], n_buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, seed: int = SEED, rate: float = RATE, rare: float = RARE) -> Model:
    """Joint training of bucket embeddings and softmax by Adagrad on shuffled mini-batches."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        return Model(np.zeros(n_buckets, np.float32), float(np.log(p / (1 - p))) if len(y) else -500.0)
    ids: dict[str, int] = {}
    rows, counts, at, grams, sizes = array("i"), array("f"), [0], array("i"), array("i")
    for t in texts:
        c: dict[int, int] = {}
        for w in words(t):
            k = ids.get(w)
            if k is None:
                k = ids[w] = len(ids)
                found = buckets(w, n_buckets)
                grams.extend(found)
                sizes.append(len(found))
            c[k] = c.get(k, 0) + 1
        n = sum(c.values())
        rows.extend(c.keys())
        counts.extend(v / n for v in c.values())
        at.append(len(rows))
    del ids
    rows, counts, at, g_ids = np.asarray(rows), np.asarray(counts), np.asarray(at), np.asarray(grams)
    g_at = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    def spans(starts, ends):
        n = ends - starts
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n), n

    held = np.zeros(n_buckets, np.int64)
    for lo, hi in zip(at, at[1:]):
        if hi > lo:
            held[np.unique(g_ids[spans(g_at[rows[lo:hi]], g_at[rows[lo:hi] + 1])[0]])] += 1
    damp = held / np.maximum(held + rare, 1)
    sizes = np.maximum(np.diff(g_at), 1)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (dim, n_buckets)) / dim * damp  # a row for each dimension
    out = rng.normal(0, 1, (dim, 2)) / dim
    bias = np.zeros(2)
    g_emb, g_out, g_bias = np.full(n_buckets, 1e-8), np.full((dim, 2), 1e-8), np.full(2, 1e-8)
    number = np.zeros(max(n_buckets, len(sizes)), np.int64)

    def distinct(index):
        """Distinct entries, and the number of each entry among them; without a sort."""
        held = np.zeros(len(number), bool)
        held[index] = True
        found = np.flatnonzero(held)
        number[found] = np.arange(len(found))
        return found, number[index]

    def add(size, index, values):
        return np.stack([np.bincount(index, v, size) for v in values])

    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 64):
            docs = order[lo : lo + 64]
            pos, n_words = spans(at[docs], at[docs + 1])
            doc_of = np.repeat(np.arange(len(docs)), n_words)
            uniq, word_of = distinct(rows[pos])
            gpos, n_grams = spans(g_at[uniq], g_at[uniq + 1])
            ub, inv = distinct(g_ids[gpos])
            g_word = np.repeat(np.arange(len(uniq)), n_grams)
            own = emb[:, ub]
            vec = np.add.reduceat(own[:, inv], np.cumsum(n_grams) - n_grams, axis=1) / sizes[uniq] if len(uniq) else np.zeros((dim, 0))
            text = add(len(docs), doc_of, vec[:, word_of] * counts[pos]).T
            z = text @ out + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            err = p.copy()
            err[np.arange(len(docs)), y[docs].astype(int)] -= 1
            d_text = out @ err.T
            d_out, d_bias = text.T @ err, err.sum(axis=0)
            d_vec = add(len(uniq), word_of, d_text[:, doc_of] * counts[pos]) / sizes[uniq]
            d_emb = add(len(ub), inv, d_vec[:, g_word])
            g_emb[ub] += (d_emb**2).mean(axis=0)
            emb[:, ub] = own - rate * damp[ub] * d_emb / np.sqrt(g_emb[ub])
            g_out += d_out**2
            out -= rate * d_out / np.sqrt(g_out)
            g_bias += d_bias**2
            bias -= rate * d_bias / np.sqrt(g_bias)
    return Model(((out[:, 1] - out[:, 0]) @ emb).astype(np.float32), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, held_out, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """A bounded sample of the labelled texts that are not held out: smallest id hashes first."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "y").limit(max_rows)
    texts = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= max_bytes).orderBy("h", "doc_id", "y", "text")
    rows, size = [], 0
    for r in texts.select("text", "y", F.octet_length("text").alias("n")).toLocalIterator():
        if size + r.n > max_bytes:
            continue
        size += r.n
        rows.append((r.text, r.y))
    return [t for t, _ in rows], [y for _, y in rows]


def third(doc_id):
    """The held-out fold: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every text."""
    arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # n_buckets floats
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        m = Model(*sent.value)
        for b in batches:
            s = [m.score(t) for t in b.column("text").to_pylist()]
            yield batch_of({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": s, "predicted": [int(x >= threshold) for x in s]}, schema)

    rows = id_text(docs, id_col, text_col).withColumn("held_out", third(F.col("doc_id")))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return scored(docs, train(*training_rows(docs, labels, third, label=label, id_col=id_col, text_col=text_col)), threshold, id_col, text_col)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns; null text is scored as empty."""
    arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # n_buckets floats

    def run(batches):
        m = Model(*sent.value)
        for b in batches:
            yield b.filter(pa.array([m.score(t or "") < threshold for t in b.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
