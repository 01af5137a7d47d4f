"""Question ids and numbers, verdict coverage, repair write-back, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import fixed as X
from textloom.functions.questions import allowed_fields, changed_fields, ordered_options, settled_action


def assign_ids(rows: DataFrame, order: str) -> DataFrame:
    """Fills missing question ids, going on from the highest of the model and type."""
    prefix = F.concat(F.lit("model"), F.col("model_number").cast("string"), F.lit("_"), F.col("qtype"), F.lit("_"))
    seq = F.when(F.col("question_id").startswith(prefix), F.substring(F.col("question_id"), F.length(prefix) + 1, F.length("question_id")).try_cast("int"))
    part = Window.partitionBy("model_number", "qtype")
    empty = F.coalesce("question_id", F.lit("")) == ""
    no = F.sum(empty.cast("int")).over(part.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("question_id", F.when(empty, F.concat(prefix, (F.coalesce(F.max(seq).over(part), F.lit(0)) + no).cast("string"))).otherwise(F.col("question_id")))


def type_rank(qtype: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in X.QUESTION_TYPES]), qtype)


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Adds `number`: one sequence through an exam's types in their fixed order."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("model_number").orderBy(type_rank(F.col("qtype")), order)))


def settled_verdicts(raw: DataFrame, questions: DataFrame) -> DataFrame:
    """One verdict a question: the last reported for its id, or, if none, a failed one.

    raw: model_number, question_id, seq, question_valid, answer_valid, action, fields_to_fix.
    Unknown ids are dropped; a question without a verdict never passes.
    """
    last = raw.withColumn("no", F.row_number().over(Window.partitionBy("model_number", "question_id").orderBy(F.desc("seq")))).where("no = 1").drop("no", "seq")
    joined = questions.select("model_number", "question_id", "qtype").join(last.withColumn("said", F.lit(True)), ["model_number", "question_id"], "left")
    said = F.coalesce("said", F.lit(False))
    q_ok, a_ok = F.coalesce("question_valid", F.lit(True)), F.coalesce("answer_valid", F.lit(True))
    action = settled_action(q_ok, a_ok, F.coalesce("action", F.lit("")), F.col("fields_to_fix"))
    return joined.select(
        "model_number", "question_id", "qtype",
        (said & q_ok).alias("question_valid"), (said & a_ok).alias("answer_valid"),
        F.when(said, action).otherwise("FIX_QUESTION_AND_ANSWER").alias("action"),
        F.coalesce("fields_to_fix", F.array().cast("array<string>")).alias("fields_to_fix"),
    )


def exam_verdicts(verdicts: DataFrame) -> DataFrame:
    """By model: questions, invalid ones, and whether all pass."""
    ok = F.col("action") == "PASS"
    return verdicts.groupBy("model_number").agg(F.count("*").alias("questions"), F.count_if(~ok).alias("invalid"), F.bool_and(ok).alias("all_pass"))


def apply_repairs(questions: DataFrame, repairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Questions (question_id, qtype, q) with accepted repairs (question_id, seq, q) written back.

    The first repair of an id counts; it must be normal (not null), change something, and
    change nothing that its verdict does not allow.
    """
    first = repairs.withColumn("no", F.row_number().over(Window.partitionBy("question_id").orderBy("seq"))).where("no = 1").select("question_id", F.col("q").alias("new"), F.lit(True).alias("offered"))
    joined = questions.join(first, "question_id", "left").join(verdicts.select("question_id", "action", "fields_to_fix"), "question_id", "left")
    changed = changed_fields(F.col("q"), F.col("new"))
    allowed = allowed_fields(F.col("qtype"), F.col("fields_to_fix"), F.coalesce("action", F.lit("PASS")))
    outcome = (
        F.when(F.col("offered").isNull(), "none")
        .when(F.col("new").isNull(), "malformed")
        .when(F.size(changed) == 0, "unchanged")
        .when(F.size(F.array_except(changed, allowed)) > 0, "not_allowed")
        .otherwise("repaired")
    )
    out = joined.withColumn("outcome", outcome)
    return out.withColumn("q", F.when(F.col("outcome") == "repaired", F.col("new")).otherwise(F.col("q"))).drop("new", "offered", "action", "fields_to_fix")


def question_lines(qtype: Column, number: Column, q: Column) -> Column:
    """The markdown lines of one question."""
    options = F.transform(ordered_options(q["options"]), lambda o: F.concat(F.lit("   "), o["key"], F.lit(". "), o["value"]))
    head = F.concat(number.cast("string"), F.lit(". "), F.coalesce(F.when(qtype == "true_false", q["statement"]).otherwise(q["question"]), F.lit("")))
    points = F.transform(F.coalesce(q["key_points"], F.array().cast("array<string>")), lambda k: F.concat(F.lit("   - "), k))
    bold = lambda label, text: F.concat(F.lit(f"   **{label}"), text)
    body = (
        F.when(qtype == "mcq", F.concat(options, F.array(bold("Answer: ", F.concat(q["correct_answer"], F.lit("**"))))))
        .when(qtype == "true_false", F.array(bold("Answer: ", F.concat(q["answer"], F.lit("**")))))
        .when(qtype == "essay", F.concat(F.array(bold("Reference answer:** ", q["reference_answer"])), points))
        .when(qtype == "fill_in_the_blank", F.array(bold("Answer:** ", F.array_join(q["answers"], ", "))))
        .otherwise(F.array(bold("Answer:** ", q["reference_answer"])))
    )
    return F.concat(F.array(head), body, F.array(F.lit("")))


def render(rows: DataFrame, banks: DataFrame | None = None) -> DataFrame:
    """(model_number, qtype, markdown) of numbered questions; banks: model_number, terms."""
    lines = rows.select("model_number", "qtype", "number", question_lines(F.col("qtype"), F.col("number"), F.col("q")).alias("lines"))
    grouped = lines.groupBy("model_number", "qtype").agg(F.array_sort(F.collect_list(F.struct("number", "lines"))).alias("l"))
    label = F.element_at(F.create_map(*[F.lit(x) for p in X.TYPE_LABELS.items() for x in p]), F.col("qtype"))
    head = F.array(F.concat(F.lit("## "), label), F.lit(""))
    if banks is not None:
        grouped = grouped.join(banks, "model_number", "left")
        box = F.concat(F.lit('<div class="word-bank"><strong>Word Bank</strong><br>'), F.array_join("terms", " · "), F.lit("</div>"))
        head = F.when((F.col("qtype") == "fill_in_the_blank") & (F.coalesce(F.size("terms"), F.lit(0)) > 0), F.concat(head, F.array(box, F.lit("")))).otherwise(head)
    text = F.array_join(F.concat(head, F.flatten(F.transform("l", lambda x: x["lines"]))), "\n")
    return grouped.select("model_number", "qtype", F.rtrim(F.regexp_replace(text, r"\s+\z", "")).alias("markdown"))


def exams(rendered: DataFrame) -> DataFrame:
    """One markdown text a model, sections in the fixed order of types."""
    parts = rendered.groupBy("model_number").agg(F.array_sort(F.collect_list(F.struct(type_rank(F.col("qtype")).alias("r"), "markdown"))).alias("p"))
    return parts.select("model_number", F.array_join(F.transform("p", lambda x: x["markdown"]), "\n\n").alias("markdown"))


def bank_check(items: DataFrame, banks: DataFrame) -> DataFrame:
    """(model_number, missing, distractors): answers outside the bank, terms that answer nothing.

    items: model_number, answers; banks: model_number, terms; both compared as normal tokens.
    """
    from textloom.functions.questions import plain_tokens

    key = lambda c: F.array_join(plain_tokens(c), " ")
    used = items.groupBy("model_number").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("answers", key)))).alias("used"))
    joined = banks.join(used, "model_number", "left").withColumn("used", F.coalesce("used", F.array().cast("array<string>"))).withColumn("keys", F.transform("terms", key))
    return joined.select("model_number", F.array_sort(F.array_except("used", "keys")).alias("missing"), F.size(F.filter("keys", lambda k: ~F.array_contains(F.col("used"), k))).alias("distractors"))


def blank_errors(items: DataFrame, banks: DataFrame, tasks: DataFrame, distractors: int = 2) -> DataFrame:
    """(model_number, error) of a fill-in section: counts, blanks, bank membership, distractors.

    items: model_number, item_idx, question, answers; banks: model_number, terms; tasks: model_number, want.
    """
    from textloom.functions.questions import has_forbidden_phrase, plain_tokens

    key = lambda c: F.array_join(plain_tokens(c), " ")
    no = F.col("item_idx") + 1
    n = tasks.join(items.groupBy("model_number").agg(F.count("*").alias("n")), "model_number", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wrong = n.where("n <> want").select("model_number", F.format_string("%d items, required %d", "n", "want").alias("error"))
    asked = items.where(F.trim("question") != "")
    unasked = items.where(F.trim("question") == "").select("model_number", F.format_string("item %d: no question", no).alias("error"))
    many = asked.where(~F.size("answers").between(1, 2)).select("model_number", F.format_string("item %d: %d answers", no, F.size("answers")).alias("error"))
    known = banks.select("model_number", F.transform("terms", key).alias("keys"))
    said = asked.select("model_number", "item_idx", F.explode("answers").alias("a")).join(known, "model_number", "left")
    outside = said.where(~F.coalesce(F.array_contains("keys", key(F.col("a"))), F.lit(False))).select("model_number", F.format_string("item %d: '%s' is not in the word bank", no, "a").alias("error"))
    phrase = asked.where(has_forbidden_phrase(F.col("question"))).select("model_number", F.format_string("item %d: a forbidden phrase", no).alias("error"))
    unused = bank_check(asked.select("model_number", "answers"), banks).where(F.col("distractors") != distractors).select("model_number", F.format_string(f"%d distractors, required {distractors}", "distractors").alias("error"))
    return wrong.unionByName(unasked).unionByName(many).unionByName(outside).unionByName(phrase).unionByName(unused)
