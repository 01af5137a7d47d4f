"""Conversation structure repair as a shortest path through composed finite-state machines.

A conversation is an input acceptor: one arc for each row, labelled with the initial of its
role and its fault. An edit transducer keeps, reroles or deletes what it reads and
inserts turns, at costs. A role grammar accepts `(s?(ua)+)?`. Their composition is never
built: the arcs that a label has between grammar states are composed when the label
is first met, and rows are taken in order, which is a topological order. Weights are
(cost, label string), compared in that order; a label string has one initial for each edit.

Label strings are never compared letter by letter on the way. Insertions go in front of
the edit of the next row, which makes a row's edits one token of a prefix-free code, so
that of two strings over the same rows none begins the other; the order of the strings
of the four states is four small ranks, and a row leaves four bytes to trace back.

The work is spread by rows, not by conversations. Rows without their texts, equal ones
counted, are sorted and cut into ranges of (conversation, turn); a range of a conversation
becomes a matrix of weights from grammar state to grammar state, as such weights
are a semiring, and the matrices of a conversation are multiplied in order. So a
conversation that holds most of the table is many ranges. Its texts are read once more
after that, in order and one at a time: what they are mended to is a stream (as is
its digest), of which a task holds a batch.

Faults, the first of which counts for a row: blank (no character but white space), duplicate
(role and text were seen before in the conversation), truncated (the last character that is
no white space ends no sentence).

Defined cases: rows go by turn, null turns first, rows of one turn by role and then by the
SHA-256 of their texts; equal rows are duplicates of one another; null roles and texts are
one space; rows of a null conversation are one conversation; a conversation all of whose
rows were dropped has no edits, zero counts and an empty result; an empty table gives
no rows; any text length. Columns other than the four and the number of copies are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import partitions_for

#: The role grammar: where an initial leads from a state, and the states in which a conversation may end.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, START, FINAL = range(4), 0, (0, 3)
#: The edit transducer: costs, and the roles it can write.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
WRITTEN = {"u": "user", "a": "assistant"}
#: What can be done at one row, insertions before it included, in ASCII order: a prefix-free code.
TOKENS = sorted("I" * k + edit for k in STATES for edit in "KRD")
SPACE = " \t\n\x0b\x0c\r"
NEVER = 1 << 60


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n) of rows that are damaged in one of five ways, by a checksum of their place; n copies are meant."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(way == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(way == 0, 0).when(way == 3, 2).otherwise(1).alias("n"))


# --- the composed machine -------------------------------------------------------------------------


@lru_cache(None)
def insertions(state: int) -> tuple[tuple[int, int], ...]:
    """(turns inserted, state after them); a state that was passed is not entered again, as that costs and gains nothing."""
    found, at = [(0, state)], state
    while len(found) < len(STATES):
        ahead = [GRAMMAR[at, i] for i in WRITTEN if (at, i) in GRAMMAR]
        if not ahead or ahead[0] in [s for _, s in found]:
            break
        at = ahead[0]
        found.append((len(found), at))
    return tuple(found)


@lru_cache(None)
def arcs(initial: str, doomed: bool, cut: bool) -> tuple[tuple[int, int, int, int], ...]:
    """(from, to, cost, token) of a row's label: the least weight between any two states of the grammar."""
    edits = [("D", None, DELETE)]
    if not doomed:
        edits += [("K", initial, KEEP + CUT * cut), *(("R", i, REROLE + CUT * cut) for i in WRITTEN)]
    best: dict = {}
    for state in STATES:
        for k, mid in insertions(state):
            for letter, out, cost in edits:
                to = mid if out is None else GRAMMAR.get((mid, out))
                if to is not None:
                    weight = (INSERT * k + cost, TOKENS.index("I" * k + letter))
                    best[state, to] = min(best.get((state, to), weight), weight)
    return tuple((a, b, *w) for (a, b), w in sorted(best.items()))


class Paths:
    """The least paths from one state through the rows so far, to each state."""

    def __init__(self, entry: int):
        self.cost, self.rank, self.back = [NEVER] * 4, [0] * 4, bytearray()
        self.entry, self.cost[entry] = entry, 0

    def step(self, label: tuple[str, bool, bool]) -> None:
        best: list = [None] * 4
        for a, b, cost, token in arcs(*label):
            if self.cost[a] < NEVER:
                weight = (self.cost[a] + cost, self.rank[a], token, a)
                if best[b] is None or weight < best[b]:
                    best[b] = weight
        order = {x: i for i, x in enumerate(sorted({w[1:3] for w in best if w}))}
        self.cost = [w[0] if w else NEVER for w in best]
        self.rank = [order[w[1:3]] if w else 0 for w in best]
        self.back += bytes((w[2] << 2 | w[3]) if w else 0 for w in best)

    def cells(self) -> list[dict]:
        out = []
        for state in STATES:
            if self.cost[state] < NEVER:
                tokens, at = [], state
                for place in range(len(self.back) - 4, -4, -4):
                    step = self.back[place + at]
                    tokens.append(TOKENS[step >> 2])
                    at = step & 3
                out.append({"entry": self.entry, "exit": state, "cost": self.cost[state], "audit": "".join(reversed(tokens))})
        return out


def joined(pieces: list[list[dict]]) -> tuple[int, str]:
    """(cost, label string) of a conversation from the matrices of its ranges, in order."""
    at = {START: (0, "")}
    for cells in pieces:
        ahead: dict = {}
        for c in cells:
            if c["entry"] in at:
                cost, audit = at[c["entry"]]
                weight = (cost + c["cost"], audit + c["audit"])
                ahead[c["exit"]] = min(ahead.get(c["exit"], weight), weight)
        at = ahead
    return min((cost + INSERT * k, audit + "I" * k) for state, (cost, audit) in at.items() for k, mid in insertions(state) if mid in FINAL)


def mended(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that remain; the role of a written turn is the one that the grammar allows."""
    state = START

    def written() -> str:
        return next(i for i in WRITTEN if (state, i) in GRAMMAR)

    for edit in audit:
        if edit == "I":
            out = written()
            yield edit, WRITTEN[out], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            out = written() if edit == "R" else role[:1]
            yield edit, WRITTEN[out] if edit == "R" else role, text
        state = GRAMMAR[state, out]


# --- on tables ----------------------------------------------------------------------------------

_STATS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_ENDS = "first string, last string, first_turn long, last_turn long"
_PIECE = f"cells array<struct<entry:int,exit:int,cost:long,audit:string>>, {', '.join(s + ' long' for s in _STATS)}, {_ENDS}"
LEGAL = {"su", "ua", "au"}


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _facts(rows: DataFrame) -> DataFrame:
    """Rows without their texts: digest, faults, number of equal rows. Only digests tell texts apart."""
    ends = F.rtrim(F.col("text"), F.lit(SPACE))
    facts = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), (ends == "").alias("blank"), (~F.right(ends, F.lit(1)).isin(".", "!", "?")).alias("cut"), "n")
    facts = facts.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.sum("n").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = facts.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    seen = ~F.coalesce(F.col("first").eqNullSafe(place), F.lit(True))
    return facts.join(first, same, "left").select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "blank", "cut", seen.alias("seen"), "n")


class _Range:
    """What is known of a conversation's rows in one range of the order."""

    def __init__(self, entries):
        self.paths = [Paths(e) for e in entries]
        self.stats = dict.fromkeys(_STATS, 0)
        self.first = self.last = self.first_turn = self.last_turn = None

    def add(self, turn, initial: str, blank: bool, cut: bool, seen: bool, n: int) -> None:
        for copy in range(n):
            again = not blank and (seen or copy > 0)
            self.stats["blank"] += blank
            self.stats["duplicate"] += again
            self.stats["truncated"] += cut and not blank and not again
            if self.first is None:
                self.first = initial
            else:
                self.stats["illegal"] += self.last + initial not in LEGAL
            self.last = initial
            for p in self.paths:
                p.step((initial if initial in "sua" else "", blank or again, cut and not blank and not again))
        if n and turn is not None and turn != self.last_turn:
            self.stats["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def row(self, conv_id) -> dict:
        cells = [c for p in self.paths for c in p.cells()]
        return {"conv_id": conv_id, "seq": TaskContext.get().partitionId(), "cells": cells, **self.stats, "first": self.first, "last": self.last, "first_turn": self.first_turn, "last_turn": self.last_turn}


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(spark_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)


def ranges(rows: DataFrame) -> DataFrame:
    """A row for each range of the order and conversation in it: the matrix of weights, counts and ends."""
    keys = [F.col("conv_id").asc_nulls_first(), *_order()]
    dealt = _facts(rows).repartitionByRange(partitions_for(rows), *keys).sortWithinPartitions(*keys)
    schema = dealt.select("conv_id").sparkSession.createDataFrame([], f"conv_id {dict(rows.dtypes)['conv_id']}, seq int, {_PIECE}").schema
    arrow = _arrow(schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            entries = STATES  # what leads to the first conversation of a range is not known here
            for conv_id, group in groupby(_tuples(batches), key=lambda r: r[0]):
                piece, entries = _Range(entries), [START]
                for r in group:
                    piece.add(*r[1:])
                yield piece.row(conv_id)

        yield from _batches(found(), arrow, 100)

    return dealt.select("conv_id", "turn", "initial", "blank", "cut", "seen", F.col("n").cast("int").alias("n")).mapInArrow(pieces, schema)


def _streams(rows: DataFrame) -> DataFrame:
    """Every conversation's ranges and then its rows in order, in one partition."""
    made = ranges(rows)
    piece = F.struct("cells", *_STATS, "first", "last", "first_turn", "last_turn").alias("piece")
    heads = made.select("conv_id", F.lit(0).alias("kind"), "seq", piece)
    texts = rows.where("n > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.sha2("text", 256).alias("digest"), "text", F.col("n").cast("int").alias("n"))
    both = heads.unionByName(texts, allowMissingColumns=True)
    return both.repartition(partitions_for(rows), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", "seq", *_order()).select("conv_id", "piece", "role", "text", "n")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, facts of the conversation, its turns after repair) one after another."""
    for conv_id, group in groupby(_tuples(batches), key=lambda r: r[0]):
        pieces, after = [], ()
        for r in group:
            if r[1] is None:
                after = (r,)
                break
            pieces.append(r[1])
        facts = {s: sum(p[s] for p in pieces) for s in _STATS}
        some = [p for p in pieces if p["first"] is not None]
        facts["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(some, some[1:]))
        timed = [p for p in pieces if p["first_turn"] is not None]
        turns = facts.pop("turns") - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
        facts["gaps"] = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - turns if timed else 0
        facts["cost"], facts["audit"] = joined([p["cells"] for p in pieces])
        said = ((role, text) for _, _, role, text, n in chain(after, group) for _ in range(n))
        yield conv_id, facts, mended(facts["audit"], said)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, role, text), places from 0."""
    schema = rows.sparkSession.createDataFrame([], f"conv_id {dict(rows.dtypes)['conv_id']}, place long, edit string, role string, text string").schema
    arrow = _arrow(schema)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = ({"conv_id": c, "place": k, "edit": e, "role": r, "text": t} for c, _, out in _conversations(batches) for k, (e, r, t) in enumerate(out))
        yield from _batches(turns, arrow)

    return _streams(rows).mapInArrow(mend, schema)


def audits(rows: DataFrame) -> DataFrame:
    """A row for every conversation: gaps in its turns, counts of faults and of illegal neighbours, the cost of its repair, the
    edits' initials, and the SHA-256 of the repaired `role:text`, joined by line ends."""
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = rows.sparkSession.createDataFrame([], f"conv_id {dict(rows.dtypes)['conv_id']}, {', '.join(n + ' long' for n in numbers)}, audit string, repaired_sha256 string").schema
    arrow = _arrow(schema)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv_id, facts, turns in _conversations(batches):
            digest = hashlib.sha256()
            for k, (_, role, text) in enumerate(turns):
                digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
            yield {"conv_id": conv_id, **facts, "repaired_sha256": digest.hexdigest()}

    return _streams(rows).mapInArrow(lambda batches: _batches(found(batches), arrow), schema)
