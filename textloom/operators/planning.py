"""Plans of question sets: parsing, checks, trimming, deficits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions import fixed as X
from textloom.functions.questions import plain_tokens
from textloom.functions.text import strip
from textloom.operators.dedupe import limit_by, near_pairs


def parse_plans(replies: DataFrame, models: int, reply: str = "reply") -> DataFrame:
    """(plan_id, model_number, qtype, item_idx, topic, concept) from replies (plan_id, a variant).

    Entries without a whole model number, or with an unknown type, go; of entries with
    the same number the last counts; numbers outside 1..models go.
    """
    text = lambda c, p: strip(F.coalesce(F.try_variant_get(c, p, "string"), F.lit("")))
    exams = replies.select("plan_id", F.posexplode(F.try_variant_get(reply, "$.exams", "array<variant>")).alias("e", "exam"))
    number = F.coalesce(F.try_variant_get("exam", "$.model_number", "int"), F.try_variant_get("exam", "$.model_number", "string").try_cast("int"))
    numbered = exams.withColumn("model_number", number).where(F.col("model_number").between(1, models))
    last = numbered.withColumn("no", F.row_number().over(Window.partitionBy("plan_id", "model_number").orderBy(F.desc("e")))).where("no = 1")
    q = last.select("plan_id", "model_number", F.posexplode(F.try_variant_get("exam", "$.questions", "array<variant>")).alias("p", "q"))
    typed = q.select("plan_id", "model_number", "p", text(F.col("q"), "$.question_type").alias("qtype"), text(F.col("q"), "$.topic").alias("topic"), text(F.col("q"), "$.concept_to_test").alias("concept")).where(F.col("qtype").isin(X.QUESTION_TYPES))
    w = Window.partitionBy("plan_id", "model_number", "qtype").orderBy("p")
    return typed.select("plan_id", "model_number", "qtype", (F.row_number().over(w) - 1).alias("item_idx"), "topic", "concept")


def added_items(items: DataFrame) -> DataFrame:
    """Plan rows of offered items (plan_id, model_number, qtype, missing, top, p, item): those of the asked
    type with a topic and a concept, numbered on from `top`, `missing` at most."""
    text = lambda p: strip(F.coalesce(F.try_variant_get("item", p, "string"), F.lit("")))
    keys = ["plan_id", "model_number", "qtype"]
    read = items.select(*keys, "missing", "top", "p", text("$.question_type").alias("said"), text("$.topic").alias("topic"), text("$.concept_to_test").alias("concept"))
    fit = limit_by(read.where("said = qtype and topic <> '' and concept <> ''"), keys, "p", F.col("missing"))
    no = F.row_number().over(Window.partitionBy(*keys).orderBy("p"))
    return fit.select(*keys, (F.col("top") + no).cast("int").alias("item_idx"), "topic", "concept")


def section_counts(questions: DataFrame) -> DataFrame:
    """Questions by model and type."""
    return questions.groupBy("model_number", "qtype").agg(F.count("*").alias("questions"))


def planned_questions(plan: DataFrame, questions: DataFrame, order: str = "seq") -> DataFrame:
    """Questions with the topic and concept of the plan item of their place among their model's questions of their type."""
    w = Window.partitionBy("model_number", "qtype").orderBy(order)
    placed = questions.withColumn("item_idx", F.row_number().over(w) - 1)
    return placed.join(plan.select("model_number", "qtype", "item_idx", "topic", "concept"), ["model_number", "qtype", "item_idx"], "left")


def counts(plan: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requested and planned items (plan_id, model_number, qtype, want, got); tasks: plan_id, model_number, qtype, want."""
    got = plan.groupBy("plan_id", "model_number", "qtype").agg(F.count("*").alias("got"))
    return tasks.join(got, ["plan_id", "model_number", "qtype"], "left").withColumn("got", F.coalesce("got", F.lit(0)))


def deficits(plan: DataFrame, tasks: DataFrame) -> DataFrame:
    return counts(plan, tasks).where("got < want").withColumn("missing", F.col("want") - F.col("got"))


def concept_tokens(plan: DataFrame) -> DataFrame:
    words = F.array_union(plain_tokens(F.col("topic")), plain_tokens(F.col("concept")))
    return plan.withColumn("tokens", F.array_except(words, F.array(*[F.lit(w) for w in X.LOW_SIGNAL_WORDS])))


def repeated_concepts(plan: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pairs of plan items of one type and different models that plan the same concept."""
    rows = concept_tokens(plan).withColumn("item", F.struct("model_number", "item_idx"))
    rows = rows.withColumn("item_id", F.struct("plan_id", "qtype", "model_number", "item_idx"))
    pairs = near_pairs(rows, "item_id", "tokens", settings.plan_overlap, ["plan_id", "qtype"], differ="model_number")
    return pairs.select("a.plan_id", "a.qtype", F.col("a.model_number").alias("model_a"), F.col("a.item_idx").alias("item_a"), F.col("b.model_number").alias("model_b"), F.col("b.item_idx").alias("item_b"), "overlap")


def plan_errors(plan: DataFrame, tasks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(plan_id, error) of missing models, wrong counts, blank items and repeated concepts."""
    models = tasks.select("plan_id", "model_number").distinct().join(plan.select("plan_id", "model_number").distinct(), ["plan_id", "model_number"], "left_anti")
    missing = models.select("plan_id", F.format_string("model %d is missing", "model_number").alias("error"))
    wrong = counts(plan, tasks).where("got <> want").select("plan_id", F.format_string("model %d has %d %s items, required %d", "model_number", "got", "qtype", "want").alias("error"))
    blank = plan.where("topic = '' or concept = ''").select("plan_id", F.format_string("model %d %s: an item has no topic or concept", "model_number", "qtype").alias("error"))
    again = repeated_concepts(plan, settings).select("plan_id", F.format_string("%s: models %d and %d plan the same concept", "qtype", "model_a", "model_b").alias("error"))
    return missing.unionByName(wrong).unionByName(blank).unionByName(again)


def trim(plan: DataFrame, tasks: DataFrame) -> DataFrame:
    """Plan items beyond the requested count go, from the end; unrequested types go."""
    joined = plan.join(tasks, ["plan_id", "model_number", "qtype"])
    return limit_by(joined, ["plan_id", "model_number", "qtype"], "item_idx", F.col("want")).drop("want")
