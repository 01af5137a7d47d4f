"""Secrets and their owners against a plain version with re and sets."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from textloom.llm import secret_scan as S

RNG = random.Random(11)
LIVE, COPIED, MANY = "a1b2c3d4e5f60718aa", "Zz9Yy8Xx7Ww6Vv5Uu4Tt", "q1w2e3r4t5y6u7i8o9"
ROWS = [
    (1, None, "o1", "r1"), (2, "", "o1", "r1"), (3, "token: abc, secret='abcdef' PASSWD = \"x.y/z+1=\" Api_Key:zzzzzz apikey=12345", "o1", "r1"), (3, "token: abc", "o2", "r1"),
    (4, "secret: token: abcdef token=token=abcdefgh token==abcdef", "o1", "r1"), (5, "日本😀 password=" + LIVE + " é", "o1", "r1"), (6, "here it is again: " + LIVE + ".", "o2", "r9"), (7, "AKIA" + "B" * 15 + " AKIA" + "B7C8" * 4 + " xAKIAAKIA" + "Z" * 20, "o3", "r3"),
    (8, "0" * 23 + " " + "f" * 24 + "g" + "0123456789abcdef" * 3, "o3", "r3"), (None, f"token={COPIED} and {COPIED}", "o1", "r1"), (10, COPIED, "o2", "r1"), (11, COPIED, "o3", None), (12, COPIED, None, None), (12, COPIED, None, None),
    *[(20 + i, f"key {MANY}", "o1", f"r{i}") for i in range(7)], (40, "ſecret=abcdef toKen=abcdef ſecret", "o1", "r1"), (41, "token = \"" + "z9" * 700 + "\" " * 900, "o1", "r1"),
    (42, " ".join(f"password=p{i}q{i}rstuvw" for i in range(700)), "o1", "r1"), (43, "x" * 300_000 + " token=a1b2c3d4e5f6 " + "ab " * 50_000, "o4", "r1"), (44, "/usr/lib/some-path/2024-01-02/abcdefgh", "o4", "r1"),
]


def plain(rows, owners=S.MOST_OWNERS, repositories=S.MOST_REPOSITORIES):
    alive = lambda v: len(re.findall("[A-Za-z][0-9]", v)) >= 2 and len(set(v)) >= 8
    base, some, held = [], [], defaultdict(lambda: (set(), set()))
    for _, text, owner, repository in rows:
        text, spans, found = text or "", [], set()
        for k, p, g, least in ((0, r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), (1, "AKIA[A-Z0-9]+", 0, 20), (2, "[0-9a-f]+", 0, 24), (3, "[A-Za-z0-9+/_-]{16,}={0,2}", 0, 0)):
            for m in re.finditer(p, text):
                if len(m[g]) >= least:
                    if k < 3:
                        spans.append((m.start(), k, m.end()))
                    if k in (0, 3) and alive(m[g]):
                        found.add((m.end() - len(m[g]), m.end(), m[g]))
        for _, _, v in found:
            held[v][0].add(owner or "")
            held[v][1].add((owner or "", repository or ""))
        base.append(sorted(spans))
        some.append(found)
    out = Counter()
    for (d, *_), spans, found in zip(rows, base, some):
        live = [(a, 3, b) for a, b, v in found if len(held[v][0]) <= owners and len(held[v][1]) <= repositories]
        show = lambda x: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(x))
        n = Counter(k for _, k, _ in spans)
        out[d, n[0], n[1], n[2], hashlib.sha256(show(spans).encode()).hexdigest(), show(spans + live), len(live), len(found) - len(live)] += 1
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in ROWS], "doc_id long, text string, owner string, repo string, base string, row int, hash int").repartition(3)


def test_equals_a_plain_version(docs):
    assert Counter(map(tuple, S.digests(S.find_secrets(docs, "owner", "repo")).collect())) == plain(ROWS)


def test_owners_part_examples_from_live_values(docs):
    got = {r.doc_id: r for r in S.digests(S.find_secrets(docs, "owner", "repo")).collect()}
    assert got[6].spans == f"live:18:{18 + len(LIVE)}" and "live" in got[5].spans  # two owners, also without a keyword
    assert got[10].n_copied == 1 and got[10].spans == "" and got[20].n_copied == 1  # four owners; seven repositories
    assert got[None].n_assign == 1 and "live" not in got[None].spans  # a base span stays, example or not


@pytest.mark.parametrize("block", [1, 2, 5])
def test_places_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    texts = ["".join(RNG.choice("ab-é😀") for _ in range(n)) for n in range(40)] + ["aaaa", "", "-a", "a-"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", S.matches(df.text, "a(b*)", 1).alias("m")).collect():
        assert [tuple(x) for x in r.m] == [(m.start(), m.end(), m[1]) for m in re.finditer("a(b*)", r.text)]


def test_empty_table(docs):
    assert S.digests(S.find_secrets(docs.limit(0), "owner", "repo")).count() == 0


def test_no_python(docs):
    plan = S.scan(docs, "owner", "repo")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
