"""Tags against a plain Viterbi walk, and the shapes of titles that must pass or fail."""

from __future__ import annotations

import itertools
import random
import re

from pyspark.sql import functions as F

from textloom.functions import tagger as G
from textloom.functions import titles

RNG = random.Random(9)


def emission(w):
    low, of = w.lower(), None
    for tag, known in G.LEXICON.items():
        if low in known:
            of = {tag: 0}
    if of is None and re.match(r"\d", w):
        of = {"9": 0, "N": -10}
    if of is None and re.fullmatch("[A-Z]{2,}s?", w):
        of = {"N": 0}
    if of is None:
        of = next((s for p, s in G.SUFFIXES if re.search(p, low)), G.UNKNOWN)
    return {t: of.get(t, G.OTHER) for t in G.TAGS}


def plain_tags(ws):
    """The best of all sequences of tags."""
    e = [emission(w) for w in ws]
    best = max(itertools.product(range(len(G.TAGS)), repeat=len(ws)), key=lambda p: (sum(e[i][G.TAGS[t]] for i, t in enumerate(p)) + sum(G.FOLLOWS.get((G.TAGS[a], G.TAGS[b]), 0) for a, b in zip(p, p[1:]))))
    score = sum(e[i][G.TAGS[t]] for i, t in enumerate(best)) + sum(G.FOLLOWS.get((G.TAGS[a], G.TAGS[b]), 0) for a, b in zip(best, best[1:]))
    return score, "".join(G.TAGS[t] for t in best)


def score(ws, ts):
    return sum(emission(w)[t] for w, t in zip(ws, ts)) + sum(G.FOLLOWS.get(p, 0) for p in zip(ts, ts[1:]))


def test_tags_are_a_best_sequence(spark):
    some = ["the", "Learning", "algorithm", "quickly", "of", "famous", "would", "42", "SVM", "walked", "classical", "make", "regression"]
    cases = [[RNG.choice(some) for _ in range(RNG.randint(1, 4))] for _ in range(40)]
    rows = spark.createDataFrame([(c,) for c in cases] + [([],)], "ws array<string>")
    for r in rows.select("ws", G.tags(F.col("ws")).alias("t")).collect():
        assert len(r.t) == len(r.ws) and (not r.ws or score(r.ws, r.t) == plain_tags(r.ws)[0]), (r.ws, r.t)


def test_shapes_of_titles(spark):
    good = ["Linear Regression", "Learning Algorithm", "k-Nearest Neighbors", "SVM", "The Cost Function", "Chapter 4", "Gradient Descent (SVM)", "Analysis of Variance"]
    bad = ["Stepping", "Stepping Back", "Fortunately", "Learning Algorithm Would", "Introduction to", "Overview of", "", "...", "It is", "How to"]
    rows = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string").select("t", G.is_noun_phrase(F.col("t")).alias("np"))
    got = {r.t: r.np for r in rows.collect()}
    assert [t for t in good if got[t]] == good and not [t for t in bad if got[t]] and not got[None]


def test_noun_chunks(spark):
    cases = {
        "It is often said that the Linear Model works quickly": "Linear Model", "we would use SVM and a small tree": "SVM", "they were using a small tree": "small tree", "it was fortunately there": "", "": "",
        "he described algorithms": "algorithms",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.c for r in rows.select("t", G.first_noun_chunk(F.col("t")).alias("c")).collect()} == cases


def test_titles_take_the_tagger(spark):
    rows = spark.createDataFrame([("Stepping Back",), ("Root Growth",)], "t string")
    valid = titles.is_valid_title(F.col("t"), is_noun_phrase=G.is_noun_phrase)
    assert [r.v for r in rows.select(valid.alias("v")).collect()] == [False, True]
    label = titles.fallback_title(F.lit("it is said that the Linear Model works quickly"), is_noun_phrase=G.is_noun_phrase, noun_chunk=G.first_noun_chunk)
    assert rows.select(label.alias("l")).first().l == "Linear Model"
