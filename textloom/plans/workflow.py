"""Workflows over the operators: ingest of parsed documents, and bounded question-set loops.

Models sit behind the protocols of `plans.ask`, so that nothing here needs a network.
Loops end after a fixed number of attempts; each attempt works only on what is still
missing (a deficit or a failed row), found by joins, and counts alone reach the driver.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions import fixed as X
from textloom.functions import questions as Q
from textloom.functions import text as T
from textloom.operators import chunk, clean, planning, review, search, structure, titling
from textloom.operators.dedupe import accept_greedily, limit_by
from textloom.plans.ask import Chat, Embed, Ledger, answered, embedded
from textloom.plans.titling import family_titles
from textloom.sources import pages as P
from textloom.sources import registry
from textloom.sources.shared import materialise


@dataclass
class Ingested:
    cleaned: DataFrame
    stats: DataFrame
    parents: DataFrame
    children: DataFrame
    warnings: DataFrame
    points: DataFrame
    structures: DataFrame
    report: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)


def ingest(pages: DataFrame, embed: Embed, chat: Chat | None = None, settings: Settings = DEFAULTS) -> Ingested:
    """Pages to cleaned items, parents, children, points, structures and report."""
    seconds: dict[str, float] = {}

    def timed(name: str, df: DataFrame) -> DataFrame:
        began = time.time()
        out = materialise(df, name)
        seconds[name] = round(time.time() - began, 3)
        return out

    cleaned = timed("cleaning", clean.clean(pages, settings))
    rows = timed("paragraphs", embedded(chunk.paragraphs(clean.kept_items(cleaned)), "text", "vector", embed))
    islands = chunk.islands(rows, "document_id", "para_idx", "vector", settings.parent_similarity)
    groups = chunk.gather(islands, "document_id", "island", "para_idx").withColumnRenamed("first", "parent_order")
    parents = timed("parents", chunk.parents_of(groups.drop("island"), settings))
    sentences = parents.withColumn("sentences", T.prepare_sentences(F.col("content"), settings))
    flat = sentences.select("parent_id", F.posexplode("sentences").alias("i", "sentence"))
    vectors = embedded(flat, "sentence", "v", embed).groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vectors"))
    ready = sentences.join(vectors, "parent_id", "left").withColumn("vectors", F.coalesce("vectors", F.array().cast("array<array<float>>")))
    children = timed("children", chunk.children_of(ready, settings))
    if chat is None:
        parents, children = (rows.withColumn("title", F.lit(None).cast("string")) for rows in (parents, children))
    else:
        named = timed("titles", family_titles(parents, children, chat, settings))  # a parent's only child has no title of its own
        of = lambda level, key: named.where(F.col("level") == level).select(F.col("id").alias(key), "title")
        parents = timed("parent_titles", titling.make_unique(parents.join(of("section", "parent_id"), "parent_id", "left"), "document_id", "parent_order"))
        children = timed("child_titles", children.join(of("subsection", "child_id"), "child_id", "left"))
    points = embedded(children, "content", "dense", embed).withColumn("sparse", F.lit(None).cast("map<int,float>"))
    tree = structure.section_tree(parents, children)
    return Ingested(cleaned, clean.cleaning_stats(cleaned), parents, children, chunk.overlap_warnings(parents, children, settings), timed("embeddings", points), structure.structures(tree), structure.chunk_report(parents, children, settings), seconds)


def publish(spark: SparkSession, done: Ingested, folder: str, uploads: DataFrame, dim: int) -> None:
    """Writes points, structures, report and registry rows under a folder."""
    search.ensure_collection(spark, f"{folder}/points", dim)
    search.upsert(done.points, f"{folder}/points", dim)
    registry.save_structures(done.structures, f"{folder}/structures")
    registry.save_report(done.report, f"{folder}/reports")
    registry.register(uploads, f"{folder}/registry")


def checked_request(types: dict[str, int], models: int, difficulty: str = "mix") -> list[tuple[str, int]]:
    """The tasks of a request, or ValueError: 1 to 4 models, known types, at least one question."""
    unknown = set(types) - set(X.QUESTION_TYPES)
    if unknown:
        raise ValueError(f"unknown question types: {sorted(unknown)}")
    if not 1 <= models <= 4:
        raise ValueError("1 to 4 models")
    if difficulty not in ("easy", "medium", "hard", "mix"):
        raise ValueError("unknown difficulty")
    tasks = [(t, types[t]) for t in X.QUESTION_TYPES if types.get(t, 0) > 0]
    if not tasks or any(n < 0 for n in types.values()):
        raise ValueError("at least one question, and no negative count")
    return tasks


def contexts(points: DataFrame, child_ids: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """(context, planner_context) of the selected chunks, in the caller's order."""
    if not child_ids:
        raise ValueError("select at least one chunk")
    rows = search.fetch(points, child_ids).select(F.lit(1).alias("request"), "pos", F.coalesce("parent_id", "parent_title").alias("section_key"), F.col("parent_title").alias("section"), F.col("chunk_title").alias("title"), "content")
    full = structure.tree_context(rows, "request", "pos", limit=None).select("request", T.first_tokens(F.col("context"), settings.generation_context_tokens).alias("context"))
    light = structure.tree_context(rows, "request", "pos", settings.snippet_tokens, settings.planner_context_tokens).withColumnRenamed("context", "planner_context")
    return full.join(light, "request").drop("request")


def ask_json(prompts: DataFrame, chat: Chat, settings: Settings = DEFAULTS, ledger: Ledger | None = None, salt: str = "") -> DataFrame:
    """Adds `reply` (a variant). Replies that do not parse are sent back to be mended, twice at most. With a ledger a
    rerun asks only what was not answered; `salt` is the step and attempt, so that equal prompts of two attempts differ."""
    done = None
    rows = materialise(answered(prompts, "prompt", "raw", chat, ledger, salt).withColumn("reply", Q.extract_json(F.col("raw"))).withColumn("json", F.to_json("reply")).drop("reply"), "replies")
    for attempt in range(settings.json_repairs + 1):
        good, bad = rows.where("json is not null"), rows.where("json is null")
        done = good if done is None else done.unionByName(good)
        if attempt == settings.json_repairs or not bad.limit(1).count():
            done = done.unionByName(bad)
            break
        mend = bad.withColumn("mend", F.concat(F.lit("This reply is no valid JSON. Send the same content as JSON only.\n\n"), "raw")).drop("raw", "json")
        rows = materialise(answered(mend, "mend", "raw", chat, ledger, f"{salt}/mend {attempt}").withColumn("json", F.to_json(Q.extract_json(F.col("raw")))).drop("mend"), "replies")
    return done.withColumn("reply", F.try_parse_json("json")).drop("json", "raw")


def plan_until_sound(prompts: DataFrame, tasks: DataFrame, models: int, chat: Chat, settings: Settings = DEFAULTS, ledger: Ledger | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan, errors): asks again with the errors in the prompt while there are any, 3 times at most."""
    asked = prompts
    for attempt in range(settings.plan_attempts):
        plan = materialise(planning.parse_plans(ask_json(asked, chat, settings, ledger, f"plan {attempt}"), models), "plan")
        errors = materialise(planning.plan_errors(plan, tasks, settings), "plan-errors")
        if attempt == settings.plan_attempts - 1 or not errors.limit(1).count():
            break
        noted = errors.groupBy("plan_id").agg(F.array_join(F.array_sort(F.collect_list("error")), "\n").alias("errors"))
        asked = prompts.join(noted, "plan_id").withColumn("prompt", F.concat("prompt", F.lit("\n\nThe last plan had these faults:\n"), "errors")).drop("errors")
    return planning.trim(plan, tasks), errors


def filled_plan(plan: DataFrame, tasks: DataFrame, contexts: DataFrame, chat: Chat, settings: Settings = DEFAULTS, ledger: Ledger | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan, deficits left): what a plan lacks is asked for by model and type, twice at most, then the plan is trimmed.

    contexts: plan_id, prompt (what the plan is about). Added items come behind those that
    a model has; a reply counts for its own type only, up to the missing number.
    """
    keys = ["plan_id", "model_number", "qtype"]
    for attempt in range(settings.fill_attempts):
        short = materialise(planning.deficits(plan, tasks).select(*keys, "missing"), "deficits")
        if not short.limit(1).count():
            break
        held = plan.groupBy(*keys).agg(F.max("item_idx").alias("top"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "topic", "concept"))), "\n").alias("held"))
        asked = short.join(held, keys, "left").join(contexts, "plan_id")
        prompt = F.concat(F.lit("Add "), F.col("missing").cast("string"), F.lit(" plan items of type "), F.col("qtype"), F.lit(" for model "), F.col("model_number").cast("string"), F.lit(" as a JSON array, on other concepts than these:\n"), F.coalesce("held", F.lit("none")), F.lit("\n\n"), F.col("prompt"))
        said = ask_json(asked.select(*keys, "missing", F.coalesce("top", F.lit(-1)).alias("top"), prompt.alias("prompt")), chat, settings, ledger, f"fill {attempt}")
        more = planning.added_items(said.select(*keys, "missing", "top", F.posexplode(Q.questions_from(F.col("reply"))).alias("p", "item")))
        plan = materialise(plan.unionByName(more), "plan")
    return planning.trim(plan, tasks), planning.deficits(plan, tasks)


def repaired_items(items: DataFrame, chat: Chat, settings: Settings = DEFAULTS, ledger: Ledger | None = None, salt: str = "repair") -> DataFrame:
    """Valid questions (model_number, qtype, pos, q) out of raw items (model_number, qtype, pos, raw) that break their
    type's rules: sent back with the rules, twice at most; only what is still broken is sent again."""
    done, open_ = None, items.select("model_number", "qtype", "pos", F.col("raw").alias("broken"))
    for attempt in range(settings.repair_attempts):
        prompt = F.concat(F.lit("This question of type "), F.col("qtype"), F.lit(" lacks fields or has wrong ones. Mend its structure, keep its content, reply as JSON.\n"), F.col("broken"))
        said = ask_json(open_.withColumn("prompt", prompt), chat, settings, ledger, f"{salt}/{attempt}")
        judged = materialise(said.select("model_number", "qtype", "pos", F.to_json(F.coalesce(F.try_element_at(Q.questions_from(F.col("reply")), F.lit(1)), "reply")).alias("new"), "broken").withColumn("q", Q.normalize(F.col("qtype"), F.try_parse_json("new"))), "repaired-items")
        good = judged.where("q is not null").select("model_number", "qtype", "pos", "q")
        done = good if done is None else done.unionByName(good)
        open_ = judged.where("q is null").select("model_number", "qtype", "pos", F.coalesce("new", "broken").alias("broken"))
        if not open_.limit(1).count():
            break
    return done


def generate(tasks: DataFrame, plan: DataFrame, context: str, chat: Chat, settings: Settings = DEFAULTS, ledger: Ledger | None = None) -> DataFrame:
    """Accepted questions (model_number, qtype, seq, q) for tasks (plan_id, model_number, qtype, want).

    Each attempt asks only for what is missing, with the plan's unfilled items: a model's
    objective types (choice, true or false, blanks) in one call, each other type in its own.
    Items that break their type's rules are sent back once. All replies so far are then
    accepted in one order, so earlier questions, of earlier models too, hold back later
    ones that repeat them.
    """
    spark = tasks.sparkSession
    keys = ["model_number", "qtype"]
    taken = spark.createDataFrame([], f"model_number int, qtype string, seq long, q {Q.QUESTION}")
    call = F.when(F.col("qtype").isin(X.OBJECTIVE_TYPES), "objective").otherwise(F.col("qtype"))
    for attempt in range(settings.plan_attempts):
        got = taken.groupBy(*keys).agg(F.count("*").alias("got"))
        missing = tasks.join(got, keys, "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < want")
        if not missing.limit(1).count():
            break
        open_ = missing.join(plan, ["plan_id", *keys], "left").where("item_idx is null or item_idx >= got")
        each = open_.groupBy(*keys).agg(F.first(F.col("want") - F.col("got")).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "topic", "concept"))), "\n").alias("items"))
        part = F.concat(F.lit("Write "), F.col("n").cast("string"), F.lit(" questions of type "), F.col("qtype"), F.lit(" on these concepts:\n"), F.col("items"))
        whole = each.withColumn("call", call).groupBy("model_number", "call").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(review.type_rank(F.col("qtype")).alias("r"), part.alias("t")))), lambda x: x["t"]), "\n\n").alias("parts"), F.collect_set("qtype").alias("types"))
        prompt = F.concat("parts", F.lit('\n\nReply as JSON {"questions": [...]}, each with its question_type.\n\nText:\n' + context))
        replies = ask_json(whole.select("model_number", "call", "types", prompt.alias("prompt")), chat, settings, ledger, f"questions {attempt}")
        said = replies.select("model_number", "call", "types", F.posexplode(Q.questions_from(F.col("reply"))).alias("pos", "item"))
        typed = said.withColumn("qtype", F.when(F.size("types") == 1, F.col("types")[0]).otherwise(Q.item_type(F.col("item"))))
        found = materialise(typed.where("qtype is not null").select(*keys, "pos", Q.normalize(F.col("qtype"), F.col("item")).alias("q"), F.to_json("item").alias("raw")), "items")
        good, bad = found.where("q is not null").select(*keys, "pos", "q"), found.where("q is null")
        if bad.limit(1).count():
            good = good.unionByName(repaired_items(bad, chat, settings, ledger, f"questions {attempt}/repair"))
        seq = F.lit(attempt).cast("long") * 10**9 + F.col("model_number") * 10**7 + review.type_rank(F.col("qtype")) * 10**6 + F.col("pos")
        every = taken.unionByName(good.select(*keys, seq.alias("seq"), "q")).withColumn("request", F.lit(1))
        text = Q.question_text(F.col("qtype"), F.col("q"))
        judged = accept_greedily(every, "request", "seq", F.col("qtype"), F.array_join(Q.plain_tokens(text), " "), Q.readings(F.col("q")), Q.has_forbidden_phrase(text), settings.near_duplicate)
        kept = judged.where("verdict = 'accepted'").join(tasks.select(*keys, "want"), keys)
        taken = materialise(limit_by(kept, keys, "seq", F.col("want")).select("model_number", "qtype", "seq", "q"), "questions")
    return taken


def assemble(questions: DataFrame, banks: DataFrame | None = None) -> DataFrame:
    """One markdown exam a model: ids, one numbering through all sections, rendering."""
    named = review.assign_ids(questions.withColumn("question_id", F.lit(None).cast("string")), "seq")
    return review.exams(review.render(review.numbered(named, "seq"), banks))


def judged_by(asked: DataFrame, judge: Chat, settings: Settings = DEFAULTS, ledger: Ledger | None = None, salt: str = "judge") -> DataFrame:
    """Verdict rows of (model_number, question_id, prompt): a question to which the reply has no verdict is asked about once more."""
    field = lambda n, t: F.try_variant_get("reply", f"$.{n}", t).alias(n)
    fields = [("question_valid", "boolean"), ("answer_valid", "boolean"), ("action", "string"), ("fields_to_fix", "array<string>")]
    done = None
    for again in range(2):
        said = ask_json(asked, judge, settings, ledger, f"{salt}/{again}")
        read = materialise(said.select("model_number", "question_id", "prompt", F.lit(again + 1).alias("seq"), *[field(*f) for f in fields]), "judged")
        whole = "question_valid is not null and answer_valid is not null"
        done = read.where(whole) if done is None else done.unionByName(read.where(whole))
        missing = read.where(f"not ({whole})")
        if again or not missing.limit(1).count():
            return done.drop("prompt")
        asked = missing.select("model_number", "question_id", F.concat("prompt", F.lit("\n\nThe last reply had no verdict on this question: give question_valid and answer_valid.")).alias("prompt"))


def validate_and_repair(questions: DataFrame, judge: Chat, mend: Chat, settings: Settings = DEFAULTS, ledger: Ledger | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions, verdicts): local checks first, the judge for the rest, repairs of failed rows, twice at most.

    questions: model_number, question_id, qtype, q. A question without a verdict after a second try has failed.
    The models of a set go side by side, so that each has all attempts.
    """
    open_ = questions
    verdicts = None
    for attempt in range(settings.repair_attempts + 1):
        local = Q.local_verdict(F.col("qtype"), F.col("q"), F.lit(None).cast("array<string>"))
        checked = open_.withColumn("local", local)
        found = checked.where("local is not null").select("model_number", "question_id", F.lit(0).alias("seq"), "local.question_valid", "local.answer_valid", "local.action", "local.fields_to_fix")
        asked = checked.where("local is null").withColumn("prompt", F.concat(F.lit("Judge this question. Reply as JSON.\n"), F.to_json("q")))
        judged = judged_by(asked.select("model_number", "question_id", "prompt"), judge, settings, ledger, f"judge {attempt}")
        verdicts = materialise(review.settled_verdicts(found.unionByName(judged), open_), "verdicts")
        failed = verdicts.where("action <> 'PASS'")
        if attempt == settings.repair_attempts or not failed.limit(1).count():
            break
        todo = open_.join(failed.select("question_id", "action"), "question_id").withColumn("prompt", F.concat_ws("\n", F.lit("Repair this question. Reply as JSON."), "action", F.to_json("q")))
        replies = ask_json(todo.select("question_id", "qtype", "prompt"), mend, settings, ledger, f"mend {attempt}")
        repairs = replies.select("question_id", F.lit(0).alias("seq"), Q.normalize(F.col("qtype"), F.col("reply")).alias("q"))
        open_ = materialise(review.apply_repairs(open_, repairs, verdicts).drop("outcome"), "repaired")
    return open_, verdicts


@dataclass
class QuestionSet:
    plan: DataFrame
    errors: DataFrame
    deficits: DataFrame
    questions: DataFrame
    verdicts: DataFrame
    exams: DataFrame


def question_set(prompts: DataFrame, tasks: DataFrame, models: int, context: str, planner: Chat, writer: Chat, judge: Chat, mend: Chat, settings: Settings = DEFAULTS, ledger: Ledger | None = None) -> QuestionSet:
    """From a planning prompt (plan_id, prompt) and tasks (plan_id, model_number, qtype, want) to exams.

    Nodes: a plan, asked again while it has faults; what it still lacks, asked for by model and
    type; questions, asked for while some are missing; ids; judgement and repair; rendering.
    Each node's result is a table, and with a ledger each reply is kept: a run that was
    stopped anywhere asks, when it is begun again, only what it had not been told.
    """
    plan, errors = plan_until_sound(prompts, tasks, models, planner, settings, ledger)
    plan, short = filled_plan(plan, tasks, prompts, planner, settings, ledger)
    plan = materialise(plan, "plan")
    written = generate(tasks, plan, context, writer, settings, ledger)
    named = materialise(review.assign_ids(written.withColumn("question_id", F.lit(None).cast("string")), "seq"), "named")
    settled, verdicts = validate_and_repair(named.select("model_number", "question_id", "qtype", "q"), judge, mend, settings, ledger)
    final = materialise(settled.join(named.select("question_id", "seq"), "question_id"), "settled")
    return QuestionSet(plan, errors, short, final, verdicts, review.exams(review.render(review.numbered(final, "seq"))))
