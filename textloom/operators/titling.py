"""Titles of a document: batches for a model, distinct titles, reviewed titles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions.titles import fallback_title, is_blocklisted, is_valid_title


def _roman(n: int) -> str:
    out = ""
    for value, mark in ((50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out, n = out + mark, n - value
    return out


NUMERALS = [_roman(n) for n in range(1, 60)]


def family_batches(parents: DataFrame, children: DataFrame, size: int = DEFAULTS.title_batch) -> DataFrame:
    """(document_id, batch, pos, level, id, content): `size` parents a batch, each followed by its
    children; a parent's only child is not sent, as it repeats the parent."""
    w = Window.partitionBy("document_id").orderBy("parent_order")
    p = parents.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    n = children.groupBy("parent_id").agg(F.count("*").alias("n"))
    several = children.join(n, "parent_id").where("n > 1").select("parent_id", "child_order", "child_id", "content")
    own = p.select("document_id", "batch", F.struct("parent_order", F.lit(-1).alias("child_order")).alias("o"), F.lit("section").alias("level"), F.col("parent_id").alias("id"), "content")
    below = several.join(p.select("document_id", "parent_id", "parent_order", "batch"), "parent_id").select("document_id", "batch", F.struct("parent_order", "child_order").alias("o"), F.lit("subsection").alias("level"), F.col("child_id").alias("id"), "content")
    rows = own.unionByName(below)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("document_id", "batch").orderBy("o"))).drop("o")


def make_unique(rows: DataFrame, group: str, order: str, title: str = "title", content: str = "content", max_words: int = 6, label: Column | None = None) -> DataFrame:
    """Titles that do not repeat within a group: the first use stays; a later or blank one takes a
    label from its own text, if that is new; else the next Roman numeral that is free.

    The numeral follows the one that a title ends in, as a word of its own, and has no end.
    Rows of a group pass by in order; what is held of them is the titles in use.
    """
    label = fallback_title(F.col(content), max_words) if label is None else label
    kept = rows.columns
    ready = rows.withColumn(title, F.coalesce(title, F.lit(""))).withColumn("__label", F.coalesce(label, F.lit("")))
    dealt = ready.repartition(F.col(group)).sortWithinPartitions(group, order)
    at = [kept.index(group), kept.index(title), len(kept)]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, used, ahead = object(), set(), {}
        for batch in batches:
            names = []
            for g, t, own in zip(*(batch.column(i).to_pylist() for i in at)):
                if g != held:
                    held, used, ahead = g, set(), {}
                names.append(next((x for x in (t, own) if x and x not in used), None) or _numbered(t or own or "Key Concept", used, ahead))
                used.add(names[-1])
            columns = batch.columns[: len(kept)]
            columns[at[1]] = pa.array(names, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    return dealt.mapInArrow(name, ready.select(kept).schema)


def _numbered(base: str, used: set[str], ahead: dict) -> str:
    """The base with the next numeral that is free; `ahead` remembers by stem and start how far numerals are taken."""
    stem, _, end = base.rpartition(" ")
    last = NUMERALS.index(end) + 1 if stem and end in NUMERALS else 0
    stem, start = (stem, last + 1) if last > 1 else (base, 2)
    n = ahead.get((stem, start), start)
    while (made := f"{stem} {NUMERALS[n - 1] if n <= len(NUMERALS) else n}") in used:
        n += 1
    ahead[stem, start] = n + 1
    return made


def reviewed(rows: DataFrame, verdicts: DataFrame, good: int = 8, settings: Settings = DEFAULTS) -> DataFrame:
    """Titles with a reviewer's proposals (id, score, verdict, proposal) applied: a title that is kept
    or scores `good` stays; else the proposal, if it is valid, no filler and not in use."""
    used = rows.groupBy("document_id").agg(F.collect_set("title").alias("used"))
    joined = rows.join(verdicts, "id", "left").join(used, "document_id", "left")
    fit = is_valid_title(F.col("proposal"), settings.title_min_words, settings.title_max_words) & ~is_blocklisted(F.col("proposal")) & ~F.array_contains("used", F.col("proposal"))
    change = (F.col("verdict") != "KEEP") & (F.col("score") < good) & fit
    return joined.withColumn("title", F.when(F.coalesce(change, F.lit(False)), F.col("proposal")).otherwise(F.col("title"))).select(*rows.columns)
