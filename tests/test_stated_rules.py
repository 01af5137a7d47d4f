"""Queries against their SQL on texts that plain prose seldom holds."""

from __future__ import annotations

from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom import queries as E
from textloom import set_queries, text_queries  # noqa: F401  add their queries
from textloom.config import DEFAULTS
from textloom.functions import classify
from textloom.functions import fixed as X
from textloom.functions import kernels as K
from textloom.functions import text as T
from textloom.operators import chunk, dedupe

from test_queries import rows

DOCUMENTS = [
    (1, "a. a. a. a. a. Reed of it.\nIt is password=27ec36519098e6eeb2 Rehare was there.", "en", "s1"),
    (2, "a. a. a. a. a. Reed of it.\nA line of its own.", "en", "s1"),
    (3, "It was so. 12 Later they left.\nIt was so.12Later they left.", "en", "s2"),
]


def same_as_sql(spark, folder, name, tables):
    con = duckdb.connect()
    for table, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    assert rows(E.QUERIES[name](spark, str(folder)).toPandas()) == rows(con.sql(E.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["category_ranks", "clean_categories", "clean_stats", "keep_first_dedupe", "pages_after_cleaning", "paragraph_stream"])
def test_cleaning_keeps_what_its_sql_keeps(spark, tmp_path, name):
    same_as_sql(spark, tmp_path, name, {"documents": (DOCUMENTS, "doc_id long, text string, lang string, source string")})


def rules_without_guards(s):
    """The first rule, each tried on every text."""
    n = T.count_alpha_words(s)
    m = T.matches
    rules = [
        ("page_number", m(s, X.PAGE_NUMBER)),
        ("decorative", m(s, X.DECORATIVE) | (~T.has_letters(s) & (F.length(s) >= 3))),
        ("empty", ~T.has_letters(s)),
        ("copyright_boilerplate", m(s, X.BOILERPLATE) | m(s, X.COPYRIGHT)),
        ("watermark", m(s, X.WATERMARK) & (n <= X.WATERMARK_WORDS)),
        ("figure_caption", m(s, X.CAPTION) & (n <= X.CAPTION_WORDS)),
        ("figure_caption", m(s, X.CAPTION_SEPARATOR) & ~m(s, X.CAPTION_REFERENCE)),
        ("running_head", (m(s, X.RUNNING_HEAD_LEADING) | m(s, X.RUNNING_HEAD_TRAILING)) & (n <= X.RUNNING_HEAD_WORDS)),
        ("footnote", m(s, X.FOOTNOTE, False)),
        ("toc", m(s, X.TOC, False)),
        ("bibliography", m(s, X.BIBLIOGRAPHY)),
        ("credit_source", m(s, X.CREDIT) & (n <= X.CREDIT_WORDS)),
        ("url", m(s, X.URL_ONLY)),
        ("diagram_fragment", m(s, X.DIAGRAM)),
    ]
    return F.coalesce(*[F.when(test, name) for name, test in rules])


TEXTS = """page 3|7|- 7 -|* * *|== ==|...|COPYRIGHT 2020 x|all rights reserved|an ISBN here|published by y|the publisher|legal disclaimer: z
this page intentionally left blank|Printed in the United States|no part of this book may|Confidential|do not copy|DO NOT DISTRIBUTE|for internal use only|for review use|unapproved|unedited copy|draft
figure 3|Fig. 3 a|TABLE 4: b|tab. 5|Equation 6.1.|eq. 7 shows|exhibit 8|diagram 9|plate 10|12 | chapter x|chapter 2 it 14|Section a 3|part b 4|module c 5|lesson d 6|unit e 7|appendix f 8
12 Later it|Intro .... 12|Intro … 12-13|references|Bibliography:|works cited|further reading.|Source: a|data source b|credit: c|image credit d|photo by e|courtesy of f|adapted from g|reprinted h|reproduced with permission i|with permission from j|this image is k
https://a.b|www.a.b. http://c.d|launch!|data|training set|new instance|feature 1|feature|class?|value example|can be automated|study the problem|analyze errors|evaluate solution|input|output|update data
Plain words of it.|ımage credit a|ſection a 3|FİGURE 3|dıagram 9|Reed ٣|... ٣|١٢ Later it|the ıſbn here""".replace("\n", "|").split("|")


def test_guards_hide_no_rule(spark):
    df = spark.createDataFrame([(t.strip(),) for t in TEXTS if t.strip()], "t string").repartition(2)
    got = df.select("t", classify.category(F.col("t")).alias("got"), rules_without_guards(F.col("t")).alias("want")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]
    assert len({r.want for r in got}) == 13


@pytest.mark.parametrize("text, want", [("He met Dr. Who. It was so.", ["He met Dr. Who.", "It was so."]), ("Pi is 3.14 now. Fig. 3.2 is it! No. 5 etc. A", ["Pi is 3.14 now.", "Fig. 3.2 is it!", "No. 5 etc. A"]), (" \n ", []), ("A line.\nB line. C", ["A line.", "B line.", "C"]), (None, None)])
def test_sentences(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.split_sentences(F.col("t")).alias("s")).first().s == want


def test_work_on_sentences_grows_with_the_text(spark):
    """Sentences and packs are made by folds that copy nothing they gathered: no aggregate whose state is text."""
    df = spark.range(1).selectExpr("repeat('It was so. ', 20000) AS t").select(T.split_sentences(F.col("t")).alias("s"))
    packed = df.select(chunk.pack_words(F.col("s"), 1000).alias("p"))
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "cur" not in plan and "out" not in plan.split("starts")[0]
    assert [len(p.split()) for p in packed.first().p] == [999] * 60 + [60]


def test_banks_in_capitals_keep_an_eszett(spark, tmp_path):
    turns = [(1, 0, "user", "enßau der"), (1, 1, "assistant", "enßau der mit"), (1, 2, "assistant", "mit ßst er")]
    same_as_sql(spark, tmp_path, "wordbank_check", {"conversations": (turns, "conv_id long, turn long, role string, text string")})


def test_only_near_pairs_are_stored(spark):
    """Sets that meet on common tokens but cannot be near are told apart before anything is kept of them."""
    common = [f"c{i}" for i in range(20)]
    df = spark.createDataFrame([(i, [f"u{i}-{k}" for k in range(30)] + common + [f"p{i % 50}"]) for i in range(200)], "i int, t array<string>")
    pairs = dedupe.near_pairs(df, "i", "t", 0.35)
    assert pairs.count() == 0
    near = spark.createDataFrame([(i, common[i : i + 10]) for i in range(11)], "i int, t array<string>")
    want = {(a, b) for a in range(11) for b in range(a + 1, 11) if (10 - b + a) / (10 + b - a) >= 0.35}
    assert {(r.a, r.b) for r in dedupe.near_pairs(near, "i", "t", 0.35).collect()} == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect(ha" in plan


def _long(word: str, n: int = 70) -> str:
    return " ".join([word.capitalize(), *[word] * n])


@pytest.mark.parametrize("name", ["chunk_children", "chunk_report", "overlap_invariants"])
def test_children_follow_their_sql(spark, tmp_path, name):
    """An abbreviation that is a sentence of its own, also at the start of a child; letters beyond ASCII at a word's edge; a reference."""
    ends = [f"{_long('ba')}. Al. Taga, ciesdo.", f"{_long('ba')}. Ed. Al. Taga, ciesdo.", f"{_long('ba')} of ed. Al. Taga, ciesdo.", f"{_long('ba')}. Ta enöbeen.", f"{_long('ba')} (table. 3 is so.", f"Al. {_long('ba')}."]
    docs = [(i, f"{a} {_long('syllables')}.", "en", "s", 0) for i, a in enumerate(ends)] + [(9, "Al. Ed. No. 7 it is.", "en", "s", 0)]
    same_as_sql(spark, tmp_path, name, {"documents": (docs, "doc_id long, text string, lang string, source string, n_chars long")})


def test_last_sentence_with_lone_abbreviations(spark):
    stated = replace(DEFAULTS, join_lone=False)
    last = lambda t: (K.last_sentence(t), K.last_sentence(t, stated))
    assert last("He went. Al. Taga.") == ("Al. Taga.", "Taga.")
    assert last("He met al. Ed. Taga.") == ("He met al. Ed. Taga.",) * 2
    assert last("Al. Taga.") == ("Al. Taga.",) * 2 and last("It is. Ed. Al. Taga.") == ("Ed. Al. Taga.", "Taga.") and last("") == ("", "")


def test_chunks_are_made_once(spark, sf):
    """Parents are merged behind one exchange, and the report and the overlaps read chunks that are stored."""
    lines = spark.createDataFrame([("d", i, i, i, " ".join(["word"] * n)) for i, n in enumerate([50, 60, 300, 50, 200])], "document_id string, parent_order int, page_start int, page_end int, content string")
    merged = chunk.merge_small(lines)
    plan = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert [(r.parent_order, r.page_end, len(r.content.split())) for r in merged.orderBy("parent_order").collect()] == [(0, 3, 460), (4, 4, 200)]
    for name in ("chunk_report", "overlap_invariants"):
        assert "MapInArrow" not in E.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_a_number_after_a_structural_word_stays(spark):
    texts = {"1. One 2) two (3. x) 12 . y": "One two (x) y", "See Chapter 3. And 4. it": "See Chapter 3. And it", "module  ( 5) z 123. q": "module  ( 5) z 123. q", "Row... 7. a": "Row... 7. a", "1.5 a": "1.5 a"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.s for r in df.select("t", T.strip_list_markers(F.col("t")).alias("s")).collect()} == texts


@pytest.mark.parametrize("name", ["split_sentences", "size_pack"])
def test_sentences_follow_their_sql(spark, tmp_path, name):
    """A text without sentences has no row; what looks like a reference ends a sentence, if its last word is no abbreviation."""
    texts = [None, "", " \n ", "It is on the table. 3 are so.", "See (Fig. 3) and (eq. 4 or Fig. 5 of it.", "An Equation. 2-1 is. No. 7 it is.", "Al. Ed. Taga. B. c", "Pi is 3.14. Is it? 4 is.", "a", f"{_long('word', 900)}. {_long('word', 30)}. {_long('next', 40)}."]
    same_as_sql(spark, tmp_path, name, {"documents": ([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")})
