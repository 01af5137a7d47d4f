"""Section trees, bounded contexts and the chunk report: ordered nesting of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions import text as T


def section_tree(parents: DataFrame, children: DataFrame) -> DataFrame:
    """One row a parent with its children nested in order. Children without a title are in
    `child_ids` and `subsection_titles` but have no row in `subsections`."""
    child = F.struct("child_order", "child_id", "title", "page_start", "page_end")
    nested = children.groupBy("document_id", "parent_id").agg(F.array_sort(F.collect_list(child)).alias("c"), F.count("*").alias("n"), F.count_distinct("child_id").alias("ids"))
    sound = F.when((F.col("n") == F.col("ids")) & ~F.exists("c", lambda x: x["child_id"].isNull() | (x["child_id"] == "")), F.col("c")).otherwise(F.raise_error(F.lit("child ids of a parent are empty or repeat")).cast("void"))
    nested = nested.withColumn("c", sound).drop("n", "ids")
    own = parents.select("document_id", "parent_id", "parent_order", "title", F.col("page_start").alias("page_start"), F.col("page_end").alias("page_end"))
    joined = own.join(nested, ["document_id", "parent_id"], "left").withColumn("c", F.coalesce("c", F.array().cast(nested.schema["c"].dataType)))
    shown = F.filter("c", lambda x: x["title"].isNotNull() & (x["title"] != ""))
    row = lambda x, i: F.struct(x["child_id"].alias("child_id"), x["title"].alias("title"), x["page_start"].alias("page_start"), x["page_end"].alias("page_end"), i.alias("order"))
    return joined.select("document_id", "parent_id", "parent_order", F.lit("parent").alias("chunk_type"), "title", F.col("title").alias("parent_title"), "page_start", "page_end", F.transform("c", lambda x: x["title"]).alias("subsection_titles"), F.transform("c", lambda x: x["child_id"]).alias("child_ids"), F.size("c").alias("child_count"), F.transform(shown, row).alias("subsections"))


def structures(tree: DataFrame) -> DataFrame:
    """One row a document: its sections in order with totals."""
    section = F.struct(F.col("parent_order"), *[F.col(c) for c in tree.columns if c not in ("document_id", "parent_order")])
    return tree.groupBy("document_id").agg(F.count("*").alias("section_count"), F.sum("child_count").alias("child_count"), F.array_sort(F.collect_list(section)).alias("sections"))


def tree_context(rows: DataFrame, group: str, order: str, snippet: int | None = None, limit: int | None = None) -> DataFrame:
    """(group, context): headings when the section changes, subheadings, texts, in order.

    rows: section_key, section, title, content. With `snippet`, texts are cut to so many
    words and follow their heading directly; with `limit`, the whole is cut to so many.
    """
    w = Window.partitionBy(group).orderBy(order)
    key = F.col("section_key")
    new = F.lag(order).over(w).isNull() | key.isNull() | ~key.eqNullSafe(F.lag(key).over(w))
    head = F.when(new, F.concat(F.lit("## "), F.coalesce("section", F.lit("Untitled"))))
    sub = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("### "), F.col("title")))
    content = F.coalesce("content", F.lit(""))
    if snippet is None:
        piece = F.concat_ws("\n\n", head, sub, F.when(content != "", content))
    else:
        cut = T.first_tokens(content, snippet)
        body = F.concat_ws("\n", sub, F.when(cut != "", cut))
        piece = F.concat_ws("\n\n", head, body)
    parts = rows.select(group, F.col(order).alias("o"), piece.alias("piece"))
    joined = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("o", "piece"))).alias("p"))
    text = F.array_join(F.filter(F.transform("p", lambda x: x["piece"]), lambda x: x != ""), "\n\n")
    return joined.select(group, (text if limit is None else T.first_tokens(text, limit)).alias("context"))


def chunk_report(parents: DataFrame, children: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(document_id, line_key, line): the report's lines; order by line_key to print."""
    rule, thin = "=" * 72, "-" * 72
    text = lambda c: F.coalesce(c, F.lit(""))
    show = lambda c, default: F.coalesce(F.when(c != "", c), F.lit(default))
    pages = F.concat(F.coalesce(F.col("page_start").cast("string"), F.lit("None")), F.lit("-"), F.coalesce(F.col("page_end").cast("string"), F.lit("None")))
    size = F.concat(F.lit(" | words="), T.count_words(text(F.col("content"))), F.lit(" | est_tokens="), T.reported_tokens(text(F.col("content")), settings.words_per_token))
    n = children.groupBy("document_id", "parent_id").agg(F.count("*").alias("n"))
    p = parents.join(n, ["document_id", "parent_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    head = F.concat(F.lit("SECTION "), show(F.col("title"), "UNTITLED"), F.lit(" | id="), F.col("parent_id"), F.lit(" | pages="), pages, size, F.lit(" | subsections="), F.col("n"))
    p_lines = p.select("document_id", "parent_order", F.lit(-1).alias("child_order"), F.posexplode(F.array(F.lit(""), F.lit(rule), head, F.lit(thin), text(F.col("content")), F.lit(""))).alias("i", "line"))
    c = children.drop("parent_order").join(p.select("document_id", "parent_id", "parent_order", "n"), ["document_id", "parent_id"])
    sub = F.concat(F.lit("  SUBSECTION "), F.col("child_order") + 1, F.lit("/"), F.col("n"), F.lit(" "), show(F.col("title"), "(single subsection - suppressed)"), F.lit(" | id="), F.col("child_id"), F.lit(" | pages="), pages, size)
    c_lines = c.select("document_id", "parent_order", "child_order", F.posexplode(F.array(F.lit(thin), sub, F.lit(thin), text(F.col("content")), F.lit(""))).alias("i", "line"))
    totals = parents.groupBy("document_id").agg(F.count("*").alias("np")).join(children.groupBy("document_id").agg(F.count("*").alias("nc")), "document_id", "left")
    t_lines = totals.select("document_id", F.lit(-1).alias("parent_order"), F.lit(-1).alias("child_order"), F.posexplode(F.array(F.lit(rule), F.concat(F.lit("CHUNKING REPORT | document_id="), F.col("document_id")), F.concat(F.lit("parents="), F.col("np"), F.lit(" | children="), F.coalesce("nc", F.lit(0))), F.lit(rule))).alias("i", "line"))
    lines = t_lines.unionByName(p_lines).unionByName(c_lines)
    return lines.select("document_id", F.struct("parent_order", "child_order", "i").alias("line_key"), "line")
