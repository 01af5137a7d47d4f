"""Parsed documents: payload files, checks, and adapters from plain tables to pages and items.

A page row is (document_id, page_idx, page, items); items are ordered structs. The
order of a document is (page_idx, item_idx) everywhere.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import strip

ITEM = "struct<type:string,value:string,md:string,lvl:int>"
PAYLOAD = f"pages array<struct<page:int,items:array<{ITEM}>>>, error string"
KINDS = ["heading", "text", "table"]


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row a payload file: document_id (the file's name), payload (a variant)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value")
    return raw.select(F.regexp_replace("f", r"\.json$", "").alias("document_id"), F.try_parse_json("value").alias("payload"))


def parsed_payloads(files: DataFrame, parse) -> DataFrame:
    """Payloads of binary files (path, content) by a parser, `parse(content: bytes) -> str` (JSON), on the executors."""
    @F.pandas_udf("string")
    def parsed(contents: pd.Series) -> pd.Series:
        return contents.map(parse)

    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(name.alias("document_id"), F.try_parse_json(parsed("content")).alias("payload"))


def check_payloads(payloads: DataFrame) -> DataFrame:
    """(document_id, problem) of every payload: null where it is sound.

    A document needs a non-empty list of pages; every page a list of items (which may
    be empty) and a whole number or null as its page (no boolean); items are
    headings, texts or tables with a string or null value; one item at least.
    """
    kind = lambda c, path: F.schema_of_variant(F.try_variant_get(c, path, "variant"))
    pages = F.try_variant_get("payload", "$.pages", "array<variant>")
    head = payloads.select("document_id", pages.alias("pages"), F.col("payload").isNull().alias("broken"))
    page = head.select("document_id", F.explode_outer("pages").alias("p")).select("document_id", "p", F.try_variant_get("p", "$.items", "array<variant>").alias("items"), F.coalesce(kind(F.col("p"), "$.page"), F.lit("VOID")).alias("number"))
    bad_page = page.groupBy("document_id").agg(F.bool_or(F.col("items").isNull()).alias("no_items"), F.bool_or(~F.col("number").isin("BIGINT", "VOID")).alias("bad_number"), F.sum(F.when(F.col("items").isNotNull(), F.size("items")).otherwise(0)).alias("n"))
    item = page.select("document_id", F.explode("items").alias("i")).select("document_id", F.try_variant_get("i", "$.type", "string").alias("type"), F.coalesce(kind(F.col("i"), "$.value"), F.lit("VOID")).alias("value"))
    bad_item = item.groupBy("document_id").agg(F.bool_or(~F.coalesce(F.col("type").isin(KINDS), F.lit(False))).alias("bad_type"), F.bool_or(~F.col("value").isin("STRING", "VOID")).alias("bad_value"))
    found = head.join(bad_page, "document_id", "left").join(bad_item, "document_id", "left")
    problem = (
        F.when(F.col("broken"), "not json")
        .when(F.coalesce(F.size("pages"), F.lit(0)) <= 0, "no pages")
        .when(F.col("no_items"), "a page has no item list")
        .when(F.col("bad_number"), "a page number is no whole number")
        .when(F.coalesce("n", F.lit(0)) == 0, "no items")
        .when(F.col("bad_type"), "an item has an unknown type")
        .when(F.col("bad_value"), "an item value is no text")
    )
    return found.select("document_id", problem.alias("problem"))


def payload_pages(payloads: DataFrame) -> DataFrame:
    """Page rows of sound payloads."""
    sound = payloads.join(check_payloads(payloads).where("problem is null"), "document_id", "left_semi")
    typed = sound.select("document_id", F.try_variant_get("payload", "$.pages", f"array<struct<page:int,items:array<{ITEM}>>>").alias("pages"))
    return typed.select("document_id", F.posexplode("pages").alias("page_idx", "p")).select("document_id", "page_idx", "p.page", "p.items")


def line_pages(documents: DataFrame) -> DataFrame:
    """A text table as pages: `source` is the document, a row a page, its lines the items."""
    items = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("text").alias("type"), x.alias("value"), F.lit(None).cast("string").alias("md"), F.lit(None).cast("int").alias("lvl")))
    return documents.select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_idx"), F.col("doc_id").cast("int").alias("page"), items.alias("items"))


def row_pages(documents: DataFrame) -> DataFrame:
    """A text table as documents of one page each: doc_id is the document, its lines the items."""
    return line_pages(documents.withColumn("source", F.col("doc_id").cast("string"))).withColumn("page_idx", F.lit(0).cast("long")).withColumn("page", F.lit(1))


def html_pages(pages: DataFrame) -> DataFrame:
    """Web pages as documents of one page: headings from <h1>, texts from <p>, in order."""
    tag = r"(?is)<h1\b[^>]*>.*?</h1\s*>|<p\b[^>]*>.*?</p\s*>"
    found = F.regexp_extract_all("html", F.lit(tag), F.lit(0))
    body = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?is)^<[^>]*>|</[^>]*>$", ""), "<[^>]*>", "")
    item = lambda x: F.struct(F.when(F.lower(F.substring(x, 2, 2)) == "h1", "heading").otherwise("text").alias("type"), body(x).alias("value"), F.lit(None).cast("string").alias("md"), F.lit(None).cast("int").alias("lvl"))
    return pages.select(F.col("page_id").cast("string").alias("document_id"), F.lit(0).cast("long").alias("page_idx"), F.lit(1).alias("page"), F.transform(found, item).alias("items"))


def items(pages: DataFrame) -> DataFrame:
    """(document_id, page_idx, item_idx, page, kind, raw, item): raw is the stripped value."""
    rows = pages.select("document_id", "page_idx", "page", F.posexplode("items").alias("item_idx", "item"))
    kind = F.coalesce(F.when(F.col("item.type") != "", F.col("item.type")), F.lit("text"))
    return rows.select("document_id", "page_idx", "item_idx", "page", kind.alias("kind"), strip(F.coalesce("item.value", F.lit(""))).alias("raw"), "item")


def item_counts(pages: DataFrame) -> DataFrame:
    """Items of each kind by document."""
    return items(pages).groupBy("document_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS], F.count_if(~F.col("kind").isin(KINDS)).alias("other"))
