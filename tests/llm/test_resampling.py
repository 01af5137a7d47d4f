"""Importance resampling against a plain version in Python: re, zlib, math and one sort."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import resample as R

RNG = random.Random(13)
GIANT = "é" * 700 + "x" * 1500
TEXTS = [
    (0, None), (1, ""), (2, " .,;\n"), (3, "Alpha beta alpha"), (3, "the id comes twice " * 6), (4, GIANT + " " + "Word9 " * 30), (5, "one two " * 9 + "three"), (6, "one two " * 9 + "three four"),
    (None, "a null id that has words enough to be drawn, more than twenty of them: a b c d e f g h i j k"), (7, "日本語 の 文 " * 12), (8, "Aa1" + "\x7f" + "b{c}d~e`f@g[h"),
    *[(20 + i % 15, " ".join(RNG.choice(["alpha", "Beta", "gamma", "x1", "ÉTÉ"]) for _ in range(25 + i % 15))) for i in range(60)],
]
TARGET = ["Alpha alpha x1", None, "beta 日本語", ""]


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(text, most):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, buckets, most, share, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in runs(x, most)), Counter(bucket(f) for x in target for f in runs(x, most))
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for d, x in docs:
        f = runs(x, most)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[2]))
    ranks = {}
    for k, r in enumerate(able[: share * len(able) // 100]):
        ranks.setdefault(tuple(r), []).append(k + 1)
    return Counter((*r[:4], ranks[tuple(r)].pop(0) if ranks.get(tuple(r)) else None) for r in out)


@pytest.mark.parametrize("most,share,block", [(1, 10, 4 << 20), (1, 100, 64), (3, 40, 4 << 20), (2, 0, 50)])
def test_equals_a_plain_version(spark, monkeypatch, most, share, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rows = [(d, x, 1, "k", 2) for d, x in TEXTS] + [(5, TEXTS[6][1], 1, "k", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, bucket string, rank int").repartition(3)
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    got = R.resample(docs, target, share=share, buckets=97, most=most)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain([r[:2] for r in rows], TARGET, 97, most, share, R.LEAST_WORDS)


def test_blocks_of_a_column(monkeypatch):
    array = pa.array([x or "" for _, x in TEXTS])
    for block in (7, 40, 1 << 20):
        monkeypatch.setattr(R, "BLOCK", block)
        for part, rows in ((array, TEXTS), (array.slice(3, 9), TEXTS[3:12]), (array.cast(pa.large_string()), TEXTS), (array.slice(0, 0), [])):
            for most in (1, 2, 4):
                got = Counter((int(r), int(b)) for rr, bb in R.features(part, 10_000, most) for r, b in zip(rr, bb))
                assert got == Counter((i, zlib.crc32(f.encode()) % 10_000) for i, (_, x) in enumerate(rows) for f in runs(x, most))


def test_crc_of_runs_of_any_length():
    data = np.frombuffer(random.Random(1).randbytes(9000), np.uint8)
    start, length = np.array([0, 5, 17, 100, 3000, 8999, 40]), np.array([256, 257, 512, 2700, 255, 1, 0])
    assert (~R.run_crcs(data, start, length)).tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(start, length)]


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_words_follow_from_runs(most):
    counts = [sum(max(0, n - k) for k in range(most)) for n in range(40)]
    assert R._words_of(np.array(counts), most).tolist() == list(range(40)) if most > 1 else True


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert R.resample(docs, some).count() == 0
    assert [tuple(r) for r in R.resample(some, docs, share=100, buckets=10).select("n_features", "rank").collect()] == [(30, 1)]


def test_drawn_texts_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 30, i) for i in range(20)], "doc_id long, text string, n int")
    drawn = R.resample(docs, docs.limit(3))
    kept = R.drawn_texts(docs, drawn)
    assert kept.columns == ["doc_id", "text", "n", "rank"] and sorted(r.rank for r in kept.collect()) == [1, 2]
