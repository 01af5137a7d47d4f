"""Conversation repair against plain versions: enumeration of all edits, and a walk over explicit strings."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from textloom.llm import repair as R

RNG = random.Random(12)
SCHEMA = "conv_id long, turn long, role string, text string, n int, cost int, edit string"


def label(initial, fault):
    return (initial if initial in "sua" else "", fault in ("blank", "duplicate"), fault == "truncated")


def accepted(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def enumerated(labels):
    """The least (cost, audit) of all edits with up to two insertions at each place, letter by letter."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    for ins in itertools.product(gaps, repeat=len(labels) + 1):
        for ops in itertools.product("KRD", repeat=len(labels)):
            if any(d and o != "D" for o, (_, d, _) in zip(ops, labels)):
                continue
            for new in itertools.product("ua", repeat=ops.count("R")):
                new, roles, audit, cost = iter(new), ins[0], "I" * len(ins[0]), 2 * sum(map(len, ins))
                for o, (i, _, cut), x in zip(ops, labels, ins[1:]):
                    roles += {"K": i or "?", "R": next(new) if o == "R" else "", "D": ""}[o] + x
                    audit += o + "I" * len(x)
                    cost += {"K": 0, "R": 2, "D": 3}[o] + (cut and o != "D")
                if accepted(roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_paths_equal_enumeration(n):
    kinds = [(i, d, c) for i in ("s", "u", "a", "") for d, c in ((False, False), (True, False), (False, True))]
    some = list(itertools.product(kinds, repeat=n))
    for labels in some if n < 2 else RNG.sample(some, 60 if n == 2 else 12):
        p = R.Paths(R.START)
        for x in labels:
            p.step(x)
        assert R.joined([p.cells()]) == enumerated(labels), labels


def test_ranges_multiply_to_the_whole():
    for _ in range(200):
        labels = [label(RNG.choice("suax"), RNG.choice(["", "", "blank", "truncated"])) for _ in range(RNG.randint(0, 30))]
        whole = R.Paths(R.START)
        for x in labels:
            whole.step(x)
        cuts = sorted(RNG.randint(0, len(labels)) for _ in range(3))
        pieces = []
        for a, b in zip([0, *cuts], [*cuts, len(labels)]):
            parts = [R.Paths(e) for e in (R.STATES if a else [R.START])]
            for x in labels[a:b]:
                for p in parts:
                    p.step(x)
            pieces.append([c for p in parts for c in p.cells()])
        assert R.joined(pieces) == R.joined([whole.cells()])


def plain(rows):
    """Every conversation by strings: rows (conv_id, turn, role, text, n)."""
    out, convs = {}, defaultdict(list)
    for c, t, role, text, n in rows:
        convs[c] += [(t, role, text)] * n
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            last = re.sub(r"[ \t-\r]+\Z", "", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        at = {0: (0, "", [])}
        after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
        grown = lambda at: [(s2, (w[0] + 2 * k, w[1] + "I" * k, w[2] + made)) for s, w in at.items() for k, s2, made in chains(s)]

        def chains(s):
            yield 0, s, []
            made = []
            for k in (1, 2):
                i = "a" if s == 2 else "u"
                s, made = after[s, i], [*made, {"u": "user:", "a": "assistant:"}[i]]
                yield k, s, made

        for (_, role, text), fault in zip(own, faults):
            new = defaultdict(list)
            for s, (cost, audit, made) in grown(at):
                new[s].append((cost + 3, audit + "D", made))
                if fault not in ("blank", "duplicate"):
                    for op, i, r in (("K", role[:1], role), ("R", "u", "user"), ("R", "a", "assistant")):
                        if (s, i) in after:
                            new[after[s, i]].append((cost + 2 * (op == "R") + (fault == "truncated"), audit + op, [*made, f"{r}:{text}"]))
            at = {s: min(w) for s, w in new.items()}
        cost, audit, made = min(w for s, w in grown(at) if s in (0, 3))
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        f = Counter(faults)
        out[c] = (c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f["blank"], f["duplicate"], f["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest(), made)
    return out


def table():
    rows = [(1, 0, "user", "Hi.", 1), (1, 1, "assistant", "Yes!", 1), (2, None, "user", "a", 2), (2, None, "assistant", "  ", 1), (None, 5, "user", "q?", 1), (None, 5, "user", "q?", 1), (None, None, " ", " ", 1), (3, 1, "user", "gone", 0), (3, 2, "user", "gone", 0)]
    rows += [(4, 0, "assistant", "long " * 40_000 + ".", 1), (4, 9, "", "x.\n", 1), (4, 9, "tool", "x.\x0b", 3), (5, 7, "system", "only.", 1)]
    for c in range(10, 30):
        rows += [(c, t, RNG.choice(["user", "assistant", "system", "tool"]), RNG.choice(["a.", "b", "", "c!", "d? "]), RNG.choice([1, 1, 1, 2, 0])) for t in range(RNG.randint(1, 12))]
    return rows + [(99, t, RNG.choice(["user", "assistant"]), RNG.choice(["a.", "b", "", f"{t}!", "d? "]), 1) for t in range(600)]


@pytest.mark.parametrize("parts", [1, 7])
def test_tables_equal_a_plain_version(spark, parts, monkeypatch):
    monkeypatch.setattr(R, "partitions_for", lambda df: parts)
    rows = table()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA).repartition(3)
    want = plain(rows)
    assert sorted(map(repr, (tuple(r) for r in R.audits(df).collect()))) == sorted(repr(w[:-1]) for w in want.values())
    turns = defaultdict(list)
    for r in R.repaired(df).orderBy("place").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    assert dict(turns) == {c: w[-1] for c, w in want.items() if w[-1]}
    if parts == 7:
        assert R.ranges(df).where("conv_id = 99").count() > 1


def test_damage(spark):
    rows = [(c, t, r, x, 1) for c in (1, 2, None) for t in [*range(40), None] for r, x in ((None, None), ("system", "A.b!c?"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, way int")
    want = Counter()
    for c, t, r, x, _ in rows:
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x, r = x or " ", r or " "
        want[c, t, "user" if way == 4 else r, {1: "", 2: re.sub("[.!?]", "", x)}.get(way, x), {0: 0, 3: 2}.get(way, 1)] += 1
    assert Counter(map(tuple, R.damage(df).collect())) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert R.audits(R.damage(df)).count() == 0 and R.repaired(df).count() == 0
