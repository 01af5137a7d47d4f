"""Replies, plans and titles written by hand, with results written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import questions as Q
from textloom.functions import text as T
from textloom.functions import titles
from textloom.operators import planning, review

_REPLIES = [
    (1, "mcq", '{"questions":[{"question":" Q? ","options":{"a":"1","B":"2","c":"3","d":"4"},"correct_answer":"b"},{"question":"Q2","options":["x","","y","z"],"correct_answer":"A"}]}'),
    (2, "mcq", '```json\n[{"question_text":"L","options":["p","q","r","s","t"],"correct_answer":"e"},{"question":"","options":["p","q","r","s"],"correct_answer":"A"}]\n```'),
    (3, "true_false", '[{"statement":"S","answer":true},{"question":"T","answer":"FALSE"},{"statement":"U","answer":"maybe"}]'),
    (4, "short_answer", '[{"question":"Why","model_answer":"Because"},{"question":"Why"},3]'),
    (5, "essay", '[{"question":"E","answer":"R","key_points":["a"," ","b"]},{"question":"E","answer":"R","key_points":"a"},{"question":"E2","reference_answer":"R2"}]'),
    (6, "fill_in_the_blank", '[{"question":"A ___","answer":"x"},{"question":"B ___","answers":["x","y","z"]},{"question":"C ___","answers":["x"," "]}]'),
    (7, "mcq", "no json here"),
]




def parsed(spark):
    raw = spark.createDataFrame(_REPLIES, "reply_id int, qtype string, raw string")
    items = raw.select("reply_id", "qtype", F.posexplode(Q.questions_from(Q.extract_json(F.col("raw")))).alias("seq", "item"))
    return items.select("reply_id", "qtype", "seq", Q.normalize(F.col("qtype"), F.col("item")).alias("q"))


def test_replies(spark):
    got = {(r.reply_id, r.seq): r.stem for r in parsed(spark).where("q is not null").withColumn("stem", Q.question_text(F.col("qtype"), F.col("q"))).collect()}
    assert got == {(1, 0): "Q?", (2, 0): "L", (3, 0): "S", (3, 1): "T", (4, 0): "Why", (5, 0): "E", (5, 2): "E2", (6, 0): "A ___", (6, 2): "C ___"}


def test_rendering(spark):
    rows = parsed(spark).where("q is not null and qtype in ('true_false', 'short_answer')").withColumn("model_number", F.lit(1)).withColumn("o", F.struct("reply_id", "seq"))
    got = {r.qtype: r.markdown for r in review.render(review.numbered(rows, "o")).collect()}
    assert got == {"short_answer": "## Short Answer\n\n3. Why\n   **Answer:** Because", "true_false": "## True / False\n\n1. S\n   **Answer: True**\n\n2. T\n   **Answer: False**"}


_PLAN = '{"exams":[{"model_number":1,"questions":[{"question_type":"mcq","topic":"Cell walls","concept_to_test":"layers of plants"},{"question_type":"mcq","topic":"Root","concept_to_test":"water uptake"},{"question_type":"essay","topic":"","concept_to_test":"x"}]},{"model_number":"2","questions":[{"question_type":"mcq","topic":"cell walls","concept_to_test":"plants layers"},{"question_type":"quiz","topic":"t","concept_to_test":"c"}]},{"model_number":9,"questions":[]}]}'


def test_plans(spark):
    plan = planning.parse_plans(spark.createDataFrame([("p", _PLAN)], "plan_id string, raw string").select("plan_id", F.parse_json("raw").alias("reply")), 3)
    tasks = spark.createDataFrame([("p", m, t, 1) for m in (1, 2, 3) for t in ("mcq", "essay")], "plan_id string, model_number int, qtype string, want int")
    errors = {r.error for r in planning.plan_errors(plan, tasks).collect()}
    assert errors == {
        "model 3 is missing", "model 1 has 2 mcq items, required 1", "model 2 has 0 essay items, required 1", "model 3 has 0 mcq items, required 1", "model 3 has 0 essay items, required 1",
        "model 1 essay: an item has no topic or concept", "mcq: models 1 and 2 plan the same concept",
    }
    assert {(r.model_number, r.qtype, r.concept) for r in planning.trim(plan, tasks).collect()} == {(1, "essay", "x"), (1, "mcq", "layers of plants"), (2, "mcq", "plants layers")}
    assert {(r.model_number, r.qtype, r.missing) for r in planning.deficits(plan, tasks).collect()} == {(2, "essay", 1), (3, "essay", 1), (3, "mcq", 1)}


_TITLES = ["**1. Cost functions: Linear models**", "Overview", "Introduction to cells", "the k-Nearest (svm) approach and", "Cells, roots", "Cell Cell", "What now?", "Gradient Descent (SVM)", "Root (bad", "- \"deep learning\"."]


def test_titles(spark):
    named = spark.createDataFrame(list(enumerate(_TITLES)), "i int, raw string").select("i", "raw", titles.clean_title(F.col("raw")).alias("title"))
    got = [(r.title, r.valid) for r in named.withColumn("valid", titles.is_valid_title(F.col("title"))).orderBy("i").collect()]
    assert got == [
        ("Cost Functions: Linear Models", True), ("Overview", False), ("Introduction to Cells", True), ("The k-Nearest (SVM) Approach", True), ("Cells, Roots", False), ("Cell Cell", False), ("What Now?", False),
        ("Gradient Descent (SVM)", True), ("Root (bad", False), ('Deep Learning"', True),
    ]
    assert [r.i for r in named.where(titles.is_blocklisted(F.col("raw"))).orderBy("i").collect()] == [1, 2]


def test_footnotes(spark):
    cases = {"It was so. 12 Later they left": ("It was so. Later they left", 1), "See (Figure 1-6).1To train": ("See (Figure 1-6).To train", 1), "Neural networks2 Some more": ("Neural networks Some more", 1), "No marks in here": ("No marks in here", 0), "Two. 3 Then four. 5 Six": ("Two. Then four. Six", 2)}
    text, n = T.strip_inline_footnotes(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.alias("x"), n.alias("n"))
    assert {r.t: (r.x, r.n) for r in rows.collect()} == cases
