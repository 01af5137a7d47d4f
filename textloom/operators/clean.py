"""Cleaning of parsed documents: repeated lines, junk rules, repairs, keep-first duplicates.

Everything is a map over items but for two groupings: line keys by document (with
partial counts) and kept texts by document. Texts are grouped by a digest, so a
document that holds a third of all rows is spread over the cluster, and so is a text that does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions import fixed as X
from textloom.functions.classify import category
from textloom.functions.text import clean_text, count_alpha_words, is_blank, nfkc, repeat_key, strip, strip_inline_footnotes, strip_inline_garbage, strip_options
from textloom.sources.pages import items
from textloom.sources.shared import materialise


def repeated_lines(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(document_id, key) of lines that top or bottom 60 % of a document's pages (3 at least).

    A page's first and last lines are taken from its own array: no window, no shuffle
    but the counts by key.
    """
    k = settings.header_lines
    texts = F.filter(F.transform("items", lambda i: F.coalesce(i["value"], F.lit(""))), lambda t: ~is_blank(t))
    ends = pages.select("document_id", texts.alias("t"))
    lines = ends.select("document_id", F.explode(F.array(F.struct(F.lit("top").alias("side"), F.slice("t", 1, k).alias("lines")), F.struct(F.lit("bottom").alias("side"), F.slice("t", F.greatest(F.size("t") - k + 1, F.lit(1)), F.lit(k)).alias("lines")))).alias("e"))
    keyed = nfkc(lines.select("document_id", "e.side", F.explode(F.transform("e.lines", strip)).alias("line")), "line").select("document_id", "side", repeat_key(F.col("line")).alias("key"))
    counts = keyed.groupBy("document_id", "side", "key").count()
    sizes = pages.groupBy("document_id").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(settings.header_least), (F.col("n") * F.lit(settings.header_share)).cast("int"))
    return counts.join(sizes, "document_id").where((F.col("n") >= 3) & (F.col("count") >= least)).select("document_id", "key").distinct()


def judged_items(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Every non-empty item with its cleaned text, its category (null: kept so far), footnotes."""
    solid = items(pages).where(~is_blank(F.coalesce("item.value", F.lit(""))))
    rows = nfkc(solid.withColumn("text", F.col("raw")), "text").withColumn("base", clean_text(F.col("text"))).drop("text")
    keys = repeated_lines(pages, settings).withColumn("repeated", F.lit(True))
    rows = rows.withColumn("key", repeat_key(F.col("base"))).join(keys, ["document_id", "key"], "left")
    options = strip_options(F.col("base"))[1] if settings.cut_options else F.lit(False)
    garbage, broken = strip_inline_garbage(F.col("base"))
    rows = rows.withColumn("category", category(F.col("base"), F.col("repeated"))).withColumn("options", options).withColumn("bare", garbage).withColumn("broken", broken)
    noted, notes = strip_inline_footnotes(F.col("bare")) if settings.cut_footnotes else (F.col("bare"), F.lit(0))
    rows = rows.withColumn("noted", noted).withColumn("notes", notes).withColumn("final", F.when(F.col("notes") > 0, strip(F.col("noted"))).otherwise(F.col("bare")))
    junk = (
        F.when(F.col("category").isNotNull(), F.col("category"))
        .when(F.col("options"), "mcq")
        .when(F.col("bare") == "", "empty")
        .when((F.col("broken") >= 1) & (count_alpha_words(F.col("bare")) < X.OCR_WORDS), "ocr_garbage")
        .when(F.col("final") == "", "empty")
    )
    heading = F.col("kind") == "heading"
    return rows.select(
        "document_id", "page_idx", "item_idx", "page", "kind", "raw", "item",
        F.when(heading, F.col("base")).otherwise(F.col("final")).alias("text"),
        F.when(~heading, junk).alias("category"),
        F.when(~heading & (junk.isNull() | (F.col("final") == "")) & F.col("category").isNull(), F.col("notes")).otherwise(0).alias("notes"),
    )


#: A text is hot if it is more than one in so many items; fewer texts than this can be.
HOT = 1000


def keep_first(rows: DataFrame) -> DataFrame:
    """Marks texts that an earlier kept item of the document has as duplicates.

    The first place of a text is a minimum by (document, digest), summed up before it is
    shuffled; only texts that occur again are joined back. Those that are hot, fewer than HOT,
    are broadcast and their items stay where they are; so do items that are not asked.
    """
    place = F.struct("page_idx", "item_idx")
    asked = F.col("category").isNull() & (F.col("text") != "")
    rows = rows.withColumn("__digest", F.when(asked, F.substring(F.sha2("text", 256), 1, 32)))
    first = rows.where("__digest is not null").groupBy("document_id", "__digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    hot = F.col("n") * HOT > rows.count()
    near = rows.join(F.broadcast(first.where(hot).select("document_id", "__digest", F.col("first").alias("__hot"))), ["document_id", "__digest"], "left")
    apart = F.concat(F.lit("#"), F.xxhash64("document_id", "page_idx", "item_idx").cast("string"))  # meets nothing, and spreads
    keyed = near.withColumn("__key", F.when(F.col("__hot").isNull() & F.col("__digest").isNotNull(), F.col("__digest")).otherwise(apart))
    cold = first.where(~hot).select("document_id", F.col("__digest").alias("__key"), F.col("first").alias("__cold"))
    marked = keyed.join(cold, ["document_id", "__key"], "left")
    again = F.coalesce(place != F.coalesce("__hot", "__cold"), F.lit(False))
    return marked.withColumn("category", F.when(again, "duplicate").otherwise(F.col("category"))).drop("__digest", "__key", "__hot", "__cold")


def clean(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Judged items with duplicates marked; kept items have a null category and a text.

    The judged items are written once: the search for first places reads them twice.
    """
    return keep_first(materialise(judged_items(pages, settings), "judged"))


def kept_items(cleaned: DataFrame) -> DataFrame:
    """Items that stay, with their new value (and markdown, where the item had one)."""
    kept = cleaned.where("category is null and text <> ''")
    item = F.col("item").withField("value", F.col("text")).withField("md", F.when(F.col("item.md").isNotNull(), F.col("text")))
    return kept.withColumn("item", item)


def cleaned_pages(cleaned: DataFrame) -> DataFrame:
    """Page rows of what stays; pages without items go."""
    rows = kept_items(cleaned).groupBy("document_id", "page_idx").agg(F.first("page").alias("page"), F.array_sort(F.collect_list(F.struct("item_idx", "item"))).alias("i"))
    return rows.select("document_id", "page_idx", "page", F.transform("i", lambda x: x["item"]).alias("items"))


def cleaning_stats(cleaned: DataFrame) -> DataFrame:
    """One row a document: counts, characters before and after, percentage removed, one pass."""
    gone = F.col("category").isNotNull()
    left = F.when(~gone, F.length("text")).otherwise(0)
    out = cleaned.groupBy("document_id").agg(
        F.count("*").alias("processed"),
        F.count_if(gone).alias("removed"),
        F.count_if(F.col("category") == "duplicate").alias("duplicates"),
        F.sum("notes").cast("long").alias("footnotes"),
        F.sum(F.length("raw")).alias("chars_before"),
        F.sum(left).alias("chars_after"),
    )
    share = (F.col("chars_before") - F.col("chars_after")) / F.col("chars_before") * 100
    return out.withColumn("percent_removed", F.when(F.col("chars_before") > 0, F.bround(share, 2)).otherwise(0.0))


def categories(cleaned: DataFrame) -> DataFrame:
    """Removed items by document and category."""
    return cleaned.where("category is not null").groupBy("document_id", "category").agg(F.count("*").alias("n"))


def ranked_categories(cleaned: DataFrame) -> DataFrame:
    """Categories with their place in a document's report: most items first, ties by name."""
    w = Window.partitionBy("document_id").orderBy(F.desc("n"), "category")
    return categories(cleaned).withColumn("place", F.row_number().over(w))
