from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import titles
from textloom.functions.classify import category
from textloom.functions.questions import allowed_fields, has_forbidden_phrase, jaccard, without_diacritics


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Who left. He ran.", ["Dr. Who left.", "He ran."]),
        ("It is 4.91 m. Next one.", ["It is 4.91 m.", "Next one."]),
        ("See Fig. 3 here. Then go.", ["See Fig. 3 here.", "Then go."]),
        ("no capital. here either", ["no capital. here either"]),
        ("", []),
        ("   ", []),
        ('He said. "Yes" she said.', ["He said.", '"Yes" she said.']),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, T.split_sentences, text) == want


def test_null_text(spark):
    assert one(spark, T.split_sentences, None) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("tech-\nniques work", "techniques work"),
        ("tech‐ niques", "techniques"),
        ("a wrapped\nline here", "a wrapped line here"),
        ("It ends.\nNew line", "It ends.\nNew line"),
        ("called .", "called."),
        ("one\n\n\n\ntwo", "one\n\ntwo"),
        ("a\tb  c ", "a\tb c".replace("\t", " ")),
    ],
)
def test_clean_text(spark, text, want):
    assert one(spark, T.clean_text, text) == want


def test_nfkc_folds_only_where_needed(spark):
    df = T.nfkc(spark.createDataFrame([("ﬁne",), ("plain é",), (None,)], "t string"), "t")
    assert {r.t for r in df.collect()} == {"fine", "plain é", None}


def test_options_block(spark):
    assert one(spark, lambda c: T.strip_options(c)[0], "It is a real sentence. A) one B) two C) three") == "It is a real sentence."
    assert one(spark, lambda c: T.strip_options(c)[0], "A) one B) two C) three") == ""
    assert one(spark, lambda c: T.strip_options(c)[1], "Only A) one option") is False


@pytest.mark.parametrize(("text", "want"), [("1. First 2) second", "First second"), ("Chapter 3. Next", "Chapter 3. Next"), ("- item one", "item one"), ("state-of-the-art", "state-of-the-art")])
def test_list_markers(spark, text, want):
    assert one(spark, T.strip_list_markers, text) == want


@pytest.mark.parametrize(("text", "want"), [("Page 9", "page_number"), ("***", "decorative"), ("12", "page_number"), ("ISBN 123 text", "copyright_boilerplate"), ("References:", "bibliography"), ("Some prose stays here", None)])
def test_categories(spark, text, want):
    assert one(spark, category, text) == want


def test_repeated_line_rule_comes_before_page_number(spark):
    assert spark.range(1).select(category(F.lit("12"), F.lit(True)).alias("c")).first().c == "header_footer"


def test_digits_vanish_from_line_keys(spark):
    assert one(spark, T.repeat_key, "My Book - 12") == "my book" == one(spark, T.repeat_key, "My Book | 7")


def test_prepared_sentences_drop_direct_repeats(spark):
    assert one(spark, T.prepare_sentences, "Cells divide fast. Cells divide, fast. Roots drink water. Want") == ["Cells divide fast.", "Roots drink water."]


@pytest.mark.parametrize(("title", "ok"), [("Cost Functions", True), ("Overview", False), ("Cell Cell", False), ("What Now?", False), ("Descent (SVM)", True), ("Descent (svm)", False), ("Root (bad", False), ("A, B", False)])
def test_titles(spark, title, ok):
    assert one(spark, titles.is_valid_title, title) is ok


def test_title_replies(spark):
    assert one(spark, titles.title_list, "1. Cells\n\n- Roots\n3) Leaves") == ["Cells", "Roots", "Leaves"]
    rows = one(spark, titles.review_rows, "1. score=8 KEEP: Cells\nnoise\n1. score: 3 replace: \"Roots\"")
    assert [(r.idx, r.score, r.verdict, r.title) for r in rows] == [(1, 3, "REPLACE", "Roots")]
    assert one(spark, lambda c: titles.appears_in(F.lit("cell wall"), c), "The Cell Wall, of plants") is True


def test_forbidden_and_jaccard(spark):
    assert one(spark, has_forbidden_phrase, "As Shown In the text") is True
    j = spark.range(1).select(jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("j"), jaccard(F.array().cast("array<string>"), F.array(F.lit("b"))).alias("e")).first()
    assert (round(j.j, 6), j.e) == (0.333333, 0.0)


def test_diacritics(spark):
    assert {r.t for r in without_diacritics(spark.createDataFrame([("Éa",), ("x",)], "t string"), "t").collect()} == {"Ea", "x"}


def test_coupled_fields(spark):
    get = lambda q, f, a: set(spark.range(1).select(allowed_fields(F.lit(q), F.array(*[F.lit(x) for x in f]).cast("array<string>"), F.lit(a)).alias("r")).first().r)
    assert get("mcq", ["Options"], "FIX_OPTIONS") == {"options", "correct_answer"}
    assert get("essay", [], "FIX_ANSWER") == {"reference_answer", "key_points"}
    assert get("true_false", ["nonsense"], "FIX_QUESTION") == {"statement"}
    assert get("short_answer", [], "?") == {"question", "reference_answer"}
