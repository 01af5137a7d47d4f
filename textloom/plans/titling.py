"""Titles by a model: family batches with a window of recent titles, second tries, reviews, candidates.

A batch is one call for a few parents and their children. As a call is told what was
accepted last, batch k of every document is asked in round k: documents go side by
side, and a document's rounds are as many as it has batches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions import titles as T
from textloom.functions.text import first_tokens
from textloom.operators import titling
from textloom.plans.ask import Chat, answered
from textloom.sources.shared import materialise

#: Words of a passage that a call sees.
PREVIEW = 250
_NONE = "array<string>"


def _listed(c: Column, nothing: str) -> Column:
    return F.coalesce(F.when(F.size(c) > 0, F.array_join(c, "; ")), F.lit(nothing))


def batch_prompts(rows: DataFrame) -> DataFrame:
    """(document_id, prompt) of batch rows (pos, level, content) with the `recent` titles of their document."""
    entry = F.concat(F.col("pos").cast("string"), F.lit(". ["), F.upper("level"), F.lit("] "), first_tokens(F.col("content"), PREVIEW))
    whole = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("line")))).alias("e"), F.first("recent").alias("recent"))
    head = F.concat(F.lit("Write one short heading for each passage, in order, one a line. Headings differ from one another.\nHeadings just before: "), _listed(F.col("recent"), "none"), F.lit("\n\n"))
    return whole.select("document_id", F.concat(head, F.array_join(F.transform("e", lambda x: x["line"]), "\n")).alias("prompt"))


def batch_titles(rows: DataFrame, chat: Chat, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds `header` to batch rows: the reply's line of the row's place as a title, '' if it is missing or not valid."""
    replies = answered(batch_prompts(rows), "prompt", "raw", chat)
    lines = replies.select("document_id", F.posexplode(T.title_list(F.coalesce("raw", F.lit("")))).alias("at", "line")).select("document_id", (F.col("at") + 1).alias("pos"), T.clean_title(F.col("line"), settings.title_max_words, T.noun_test(settings)).alias("header"))
    good = T.is_valid_title(F.col("header"), settings.title_min_words, settings.title_max_words, T.noun_test(settings))
    return rows.join(lines, ["document_id", "pos"], "left").withColumn("header", F.when(good, F.col("header")).otherwise(""))


def second_tries(rows: DataFrame, chat: Chat, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds `title` to rows (content, header, used): one more call that names the rejected header and titles in
    use; if its title is not acceptable, a label from the passage, if that is free; else the title as it came."""
    taken = F.slice(F.array_distinct(F.concat(F.filter(F.array("header"), lambda h: h != ""), F.array_sort("used"))), 1, settings.title_recent)
    prompt = F.concat(F.lit("The heading "), F.coalesce(F.when(F.col("header") != "", F.concat(F.lit("'"), F.col("header"), F.lit("'"))), F.lit("of the last try")), F.lit(" does not do. Write another short one, none of: "), _listed(taken, "none"), F.lit("\n\n"), first_tokens(F.col("content"), PREVIEW))
    asked = answered(rows.withColumn("__prompt", prompt), "__prompt", "__raw", chat)
    named = asked.withColumn("__new", T.clean_title(F.col("__raw"), settings.title_max_words)).withColumn("__label", T.fallback_title(F.col("content"), is_noun_phrase=T.noun_test(settings), noun_chunk=T.chunk_finder(settings)))
    label_free = (F.col("__label") != "") & ~F.array_contains("used", F.col("__label"))
    return named.withColumn("title", F.when(T.accept(F.col("__new"), F.col("used"), settings), F.col("__new")).when(label_free, F.col("__label")).otherwise(F.col("__new"))).drop("__prompt", "__raw", "__new", "__label")


def family_titles(parents: DataFrame, children: DataFrame, chat: Chat, settings: Settings = DEFAULTS) -> DataFrame:
    """(document_id, level, id, title) of all parents, and of children that are not their parent's only one."""
    rows = materialise(titling.family_batches(parents, children, settings.title_batch), "batches")
    last = rows.agg(F.max("batch")).first()[0]
    done: list[DataFrame] = []
    state = rows.select("document_id", F.array().cast(_NONE).alias("used"), F.array().cast(_NONE).alias("recent")).distinct()
    for batch in range(0 if last is None else last + 1):
        own = batch_titles(rows.where(F.col("batch") == batch).join(state, "document_id"), chat, settings)
        first = F.row_number().over(Window.partitionBy("document_id", "header").orderBy("pos")) == 1
        judged = materialise(own.withColumn("good", T.accept(F.col("header"), F.col("used"), settings) & first), "judged")
        kept = judged.where("good").withColumn("title", F.col("header"))
        now = kept.groupBy("document_id").agg(F.collect_set("title").alias("now"))
        bad = judged.where("not good").join(now, "document_id", "left").withColumn("used", F.array_union("used", F.coalesce("now", F.array().cast(_NONE)))).drop("now")
        columns = ["document_id", "batch", "pos", "level", "id", "title"]
        named = materialise(kept.select(columns).unionByName(second_tries(bad, chat, settings).select(columns)), "titles")
        done.append(named)
        ordered = named.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("n")).select("document_id", F.transform("n", lambda x: x["title"]).alias("n"))
        tail = F.concat("recent", F.coalesce("n", F.array().cast(_NONE)))
        state = materialise(state.join(ordered, "document_id", "left").select("document_id", F.array_union("used", F.coalesce("n", F.array().cast(_NONE))).alias("used"), F.slice(tail, F.greatest(F.size(tail) - settings.title_recent + 1, F.lit(1)), settings.title_recent).alias("recent")), "used")
    if not done:
        return rows.select("document_id", "level", "id", F.lit("").alias("title"))
    return reduce(DataFrame.unionByName, done).select("document_id", "level", "id", "title")


def review_prompts(rows: DataFrame) -> DataFrame:
    """(document_id, section_id, prompt) of titled rows (section_id, pos, level, title, content)."""
    entry = F.concat(F.col("pos").cast("string"), F.lit(". ["), F.upper("level"), F.lit("] "), F.col("title"), F.lit(" :: "), first_tokens(F.col("content"), PREVIEW))
    whole = rows.groupBy("document_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("line")))).alias("e"))
    ask = F.lit("Judge each heading against its passage. One line each: number. score=1-10 KEEP, REFINE or REPLACE: better heading\n\n")
    return whole.select("document_id", "section_id", F.concat(ask, F.array_join(F.transform("e", lambda x: x["line"]), "\n")).alias("prompt"))


def reviewed_titles(rows: DataFrame, chat: Chat, settings: Settings = DEFAULTS) -> DataFrame:
    """Titled rows (document_id, section_id, pos, level, id, title, content) after one review call a section."""
    said = answered(review_prompts(rows), "prompt", "raw", chat)
    lines = said.select("document_id", "section_id", F.explode(T.review_rows(F.coalesce("raw", F.lit("")))).alias("r"))
    verdicts = lines.select("document_id", "section_id", F.col("r.idx").alias("pos"), "r.score", "r.verdict", T.clean_title(F.col("r.title"), settings.title_max_words).alias("proposal"))
    mine = rows.select("document_id", "section_id", "pos", "id").join(verdicts, ["document_id", "section_id", "pos"])
    return titling.reviewed(rows, mine.select("id", "score", "verdict", "proposal"), settings=settings)


def first_candidate(candidates: Column, used: Column, n: int = 3, settings: Settings = DEFAULTS) -> Column:
    """The first of the first n candidate lines that is an acceptable title, or ''."""
    cleaned = F.transform(F.slice(candidates, 1, n), lambda c: T.clean_title(c, settings.title_max_words))
    return F.coalesce(F.try_element_at(F.filter(cleaned, lambda c: T.accept(c, used, settings)), F.lit(1)), F.lit(""))


def candidate_titles(rows: DataFrame, chat: Chat, n: int = 3, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds `title` to rows (content, used): the first acceptable one of n that a call offers."""
    prompt = F.concat(F.lit(f"Offer {n} short headings for this passage, one a line.\n\n"), first_tokens(F.col("content"), PREVIEW))
    asked = answered(rows.withColumn("__prompt", prompt), "__prompt", "__raw", chat)
    return asked.withColumn("title", first_candidate(T.title_list(F.coalesce("__raw", F.lit(""))), F.col("used"), n, settings)).drop("__prompt", "__raw")

