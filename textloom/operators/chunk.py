"""Two-level chunks: parents by similarity and size, children by packed sentences.

Set-oriented steps are windows over (document, order); greedy steps, whose next
move depends on what was gathered, are Arrow functions over the ordered sentences of
one parent, which the parent's size limit bounds. Ids are hashes of the document, the
level and the place, so a repeated task makes the same ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions import kernels as K
from textloom.functions import text as T
from textloom.functions.vectors import cosine


def chunk_id(document: Column, level: str, *places: Column) -> Column:
    return F.sha2(F.concat_ws("/", document, F.lit(level), *[p.cast("string") for p in places]), 256)


def paragraphs(items: DataFrame) -> DataFrame:
    """(document_id, para_idx, text, page) in document order from kept items."""
    w = Window.partitionBy("document_id").orderBy("page_idx", "item_idx")
    return items.where("text <> ''").select("document_id", (F.row_number().over(w) - 1).alias("para_idx"), "text", "page")


def islands(rows: DataFrame, group: str, order: str, vector: str, threshold: float) -> DataFrame:
    """Adds `island`: a new one where the cosine with the row before falls below the threshold."""
    w = Window.partitionBy(group).orderBy(order)
    brk = F.when(F.lag(vector).over(w).isNull(), 0).when(cosine(F.lag(vector).over(w), F.col(vector)) < threshold, 1).otherwise(0)
    return rows.withColumn("brk", brk).withColumn("island", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("brk")


def gather(rows: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """One row for each group and key: texts joined in order, first and last page."""
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    out = rows.groupBy(group, key).agg(parts.alias("parts"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.min(order).alias("first"))
    return out.withColumn("content", T.strip(F.array_join(F.transform("parts", lambda p: p["text"]), " "))).drop("parts")


def drop_small(parents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return parents.where(T.count_tokens(F.col("content"), settings.words_per_token) > settings.parent_drop_tokens)


def merge_small(parents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Parents under the limit join the one before; a short first one takes the second in.

    Whether a parent joins depends on its own size only, so the groups are a running
    sum of the parents that do not; the first group joins the second if it is short.
    A group has the words of its parents together: all is told from sizes, and texts are
    joined once, where the windows have brought a document together.
    """
    whole = Window.partitionBy("document_id")
    w = whole.orderBy("parent_order")
    small = lambda n: (n / F.lit(settings.words_per_token)).cast("int") < settings.parent_merge_tokens
    sized = parents.select("document_id", "parent_order", "page_start", "page_end", "content", T.count_words(F.col("content")).alias("n"))
    starts = sized.withColumn("starts", ((~small(F.col("n"))) | (F.row_number().over(w) == 1)).cast("int"))
    grouped = starts.withColumn("grp", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    short = small(F.sum(F.when(F.col("grp") == 1, F.col("n"))).over(whole))
    merged = grouped.withColumn("grp", F.when(short & (F.col("grp") == 1), 2).otherwise(F.col("grp")))
    parts = F.array_sort(F.collect_list(F.struct("parent_order", "content")))
    out = merged.groupBy("document_id", "grp").agg(parts.alias("parts"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
    return out.select("document_id", F.col("parts")[0]["parent_order"].alias("parent_order"), "page_start", "page_end", T.strip(F.array_join(F.transform("parts", lambda p: p["content"]), " ")).alias("content"))


def pack_words(sentences: Column, most: int) -> Column:
    """Greedy packing of sentences into texts of at most `most` words; a long sentence stays whole."""

    def step(s: Column, n: Column) -> Column:  # words of a joined text are the sum of its parts' words
        row = lambda starts, words: F.struct(starts.alias("starts"), words.alias("n"), (s["i"] + 1).alias("i"))
        return F.when((s["i"] == 1) | (s["n"] + n > most), row(F.concat(s["starts"], F.array(s["i"])), n)).otherwise(row(s["starts"], s["n"] + n))

    def packed(all_: Column, starts: Column) -> Column:
        """Texts from one start to before the next: each is joined once, whatever it grew from."""
        ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(all_) + 1))
        return F.transform(starts, lambda a, k: F.array_join(F.slice(all_, a, F.get(ends, k) - a), " "))

    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n"), F.lit(1).alias("i"))
    starts = lambda all_: F.aggregate(F.transform(all_, T.count_words), start, step, lambda s: s["starts"])
    solid = F.filter(F.transform(sentences, T.strip), lambda x: x != "")
    return T.let(solid, lambda all_: T.let(starts(all_), lambda at: packed(all_, at)))


def split_large(parents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Parents above the ceiling are cut at sentences; pieces keep the page range."""
    most = settings.parent_max_words
    large = T.count_words(F.col("content")) > most
    pieces = F.when(large, pack_words(T.split_sentences(F.col("content"), settings), most)).otherwise(F.array("content"))
    return parents.select("document_id", "parent_order", "page_start", "page_end", F.posexplode(pieces).alias("piece", "content"))


def parents_of(groups: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The three size rules over (document_id, parent_order, page_start, page_end, content)."""
    out = split_large(merge_small(drop_small(groups, settings), settings), settings)
    w = Window.partitionBy("document_id").orderBy("parent_order", "piece")
    numbered = out.withColumn("ordinal", F.row_number().over(w) - 1)
    return numbered.select(chunk_id(F.col("document_id"), "parent", F.col("parent_order"), F.col("piece")).alias("parent_id"), "document_id", F.col("ordinal").alias("parent_order"), "page_start", "page_end", "content")


def pack_similar(sentences: Column, vectors: Column, most: int, threshold: float) -> Column:
    """Packs sentences while the size allows and the running mean of vectors stays similar."""

    @F.arrow_udf("array<string>")
    def packed(s: pa.Array, v: pa.Array) -> pa.Array:
        return _cut(s, v, most, threshold)

    return packed(sentences, vectors.cast("array<array<double>>"))


def _cut(s: pa.Array, v: pa.Array, most: int, threshold: float, after=lambda groups: groups) -> pa.Array:
    """What `after` makes of the packed texts of rows (sentences, vectors)."""
    none, out = np.zeros(0), []
    for texts, vectors in zip(s.to_pylist(), K.rows_of_vectors(v)):
        some = (vectors or [])[: len(texts or [])]
        out.append(None if texts is None else after(K.pack_similar([x or "" for x in texts], [*some, *[none] * (len(texts) - len(some))], most, threshold)))
    return pa.array(out, pa.list_(pa.string()))


def _over_lists(f, rows: pa.Array) -> pa.Array:
    return pa.array([None if r is None else f([s or "" for s in r]) for r in rows.to_pylist()], pa.list_(pa.string()))


def pack_by_embedder(parents: DataFrame, embed, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds `packed` to parents with `sentences`, where there are no vectors: what was gathered so far and the
    next sentence are embedded at each step. For the few parents whose vectors are missing or do not fit.

    The parents of a batch go ahead together: a step asks once for the texts that any of
    them needs and that have no vector yet.
    """

    def walk(rows: list[list[str]]) -> list[list[str]]:
        out: list[list[str]] = [[] for _ in rows]
        at, known = [0] * len(rows), {}
        while True:
            open_ = []
            for i, sentences in enumerate(rows):
                while at[i] < len(sentences):
                    s = sentences[at[i]]
                    if out[i] and len(out[i][-1].split()) + len(s.split()) <= settings.child_max_words:
                        open_.append(i)
                        break
                    out[i].append(s)
                    at[i] += 1
            if not open_:
                return out
            asked = list(dict.fromkeys(t for i in open_ for t in (out[i][-1], rows[i][at[i]]) if t not in known))
            known.update(zip(asked, (np.asarray(v, float) for v in embed(asked)) if asked else ()))
            for i in open_:
                s = rows[i][at[i]]
                if K.similar(known[out[i][-1]], known[s], settings.child_similarity):
                    out[i][-1] = f"{out[i][-1]} {s}"
                else:
                    out[i].append(s)
                at[i] += 1
            held = {out[i][-1] for i in open_}  # a text that grew is not met again
            known = {t: v for t, v in known.items() if t in held}

    @F.arrow_udf("array<string>")
    def packed(sentences: pa.Array) -> pa.Array:
        return pa.array(walk([[s or "" for s in r or []] for r in sentences.to_pylist()]), pa.list_(pa.string()))

    return parents.withColumn("packed", packed("sentences"))


def floor_small(groups: Column, settings: Settings = DEFAULTS) -> Column:
    """Drops meaningless fragments and merges short groups backwards, within the size limit."""

    @F.arrow_udf("array<string>")
    def kept(rows: pa.Array) -> pa.Array:
        return _over_lists(lambda g: K.floor_small(g, settings), rows)

    return kept(groups)


def overlap(bodies: Column, settings: Settings = DEFAULTS) -> Column:
    """Every body starts with the last sentence of the one before, if it fits and is not in it."""

    @F.arrow_udf("array<string>")
    def lapped(rows: pa.Array) -> pa.Array:
        return _over_lists(lambda b: K.overlapped(b, settings), rows)

    return lapped(bodies)


def dispatch_pages(bodies: Column, start: Column, end: Column) -> Column:
    """Array of (page_start, page_end): the page range spread by share of words, half-even."""
    s = F.coalesce(start, F.lit(1))
    e = F.when(end.isNull() | (end < s), s).otherwise(end)
    span = (e - s).cast("double")
    first = F.struct(F.array().cast("array<struct<page_start:int,page_end:int>>").alias("out"), F.lit(0.0).alias("cum"))

    def spread(counts: Column, total: Column) -> Column:
        def step(acc: Column, n: Column) -> Column:
            cum = acc["cum"] + n / total * span
            low = F.greatest(s, F.least(e, s + F.bround(acc["cum"]).cast("int")))
            high = F.greatest(low, F.least(e, s + F.bround(cum).cast("int")))
            return F.struct(F.concat(acc["out"], F.array(F.struct(low.alias("page_start"), high.alias("page_end")))).alias("out"), cum.alias("cum"))

        return F.aggregate(counts, first, step, lambda a: a["out"])

    total = lambda counts: F.greatest(F.aggregate(counts, F.lit(0), lambda a, x: a + x), F.lit(1))
    return T.let(F.transform(bodies, T.count_words), lambda counts: T.let(total(counts), lambda n: spread(counts, n)))


def children_of(parents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Children of parents (with `sentences` and `vectors`, one vector a sentence, or with `packed` texts).

    A parent that is mostly numbered questions is one child as it is.
    """
    own = ["document_id", "parent_id", "parent_order", "page_start", "page_end", "content", "whole"]
    ready = parents.withColumn("whole", T.is_question_text(F.col("content"), settings.question_share, settings))
    given = [F.col("packed")] if "packed" in parents.columns else [F.col("sentences"), F.col("vectors").cast("array<array<double>>").alias("vectors")]
    ready = ready.select(*own, *given)
    made = lambda groups: K.overlapped(K.floor_small(groups, settings), settings)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.columns[len(own) :]
            done = _over_lists(made, rest[0]) if len(rest) == 1 else _cut(*rest, settings.child_max_words, settings.child_similarity, made)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], done], names=[*own, "cut"])

    kinds = dict(ready.dtypes)
    asked = ready.mapInArrow(cut, ", ".join(f"{c} {kinds[c]}" for c in own) + ", cut array<string>")
    bodies = F.when(F.col("whole"), F.array(T.strip(F.col("content")))).otherwise(F.col("cut"))
    rows = asked.withColumn("bodies", bodies).withColumn("ranges", dispatch_pages(F.col("bodies"), F.col("page_start"), F.col("page_end")))
    span = F.struct(F.col("page_start").alias("page_start"), F.col("page_end").alias("page_end"))
    out = rows.select("document_id", "parent_id", "parent_order", "whole", span.alias("span"), F.posexplode(F.arrays_zip("bodies", "ranges")).alias("child_order", "c"))
    page = lambda k: F.when(F.col("whole"), F.col(f"span.{k}")).otherwise(F.col(f"c.ranges.{k}")).alias(k)
    return out.select(chunk_id(F.col("document_id"), "child", F.col("parent_order"), F.col("child_order")).alias("child_id"), "parent_id", "document_id", "parent_order", "child_order", page("page_start"), page("page_end"), F.col("c.bodies").alias("content"))


def overlap_warnings(parents: DataFrame, children: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adjacent parents that share words, adjacent children that share more than a sentence."""

    @F.arrow_udf("int")
    def last_words(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else len(K.last_sentence(t, settings).split()) for t in texts.to_pylist()], pa.int32())

    w = Window.partitionBy("document_id").orderBy("parent_order")
    p = parents.select("document_id", F.col("parent_id").alias("id"), F.lag("parent_id").over(w).alias("before"), T.word_overlap(F.lag("content").over(w), F.col("content")).alias("shared"), F.lit(0).alias("allowed"), F.lit("parent").alias("level"))
    v = Window.partitionBy("document_id", "parent_id").orderBy("child_order")
    before = F.lag("content").over(v)
    c = children.select("document_id", F.col("child_id").alias("id"), F.lag("child_id").over(v).alias("before"), before.alias("b"), "content")
    c = c.select("document_id", "id", "before", T.word_overlap(F.col("b"), F.col("content")).alias("shared"), last_words("b").alias("allowed"), F.lit("child").alias("level"))
    return p.unionByName(c).where("before is not null and shared > allowed")
