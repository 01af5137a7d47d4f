from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import questions as Q
from textloom.operators import chunk, planning, search
from textloom.plans import titling
from textloom.plans import workflow as W
from textloom.sources import pages as P
from textloom.sources import registry
from textloom.streaming import ingest as S


def make_embed():
    return lambda texts: [[float(len(t.split())), float(t.count("e")), 1.0] for t in texts]


def test_ingest_and_contexts(spark):
    names = "one two three four five six seven eight nine ten".split()
    body = lambda k: " ".join(f"The {k} grows in place {names[i % 10]} and drinks water from soil number {names[i // 10]}." for i in range(40))
    df = spark.createDataFrame([("d", 0, 1, [("text", body("root"), None, None), ("text", body("leaf"), None, None)])], f"document_id string, page_idx long, page int, items array<{P.ITEM}>")
    done = W.ingest(df, make_embed(), chat=lambda prompts: ["Plant Growth"] * len(prompts))
    assert done.parents.count() >= 1 and done.children.count() >= 1
    assert done.structures.first().child_count == done.children.count()
    points = done.points.withColumn("parent_title", F.lit("T")).withColumn("chunk_title", F.col("title"))
    ids = [r.child_id for r in done.children.orderBy("child_order").collect()]
    context = W.contexts(points, ids).first()
    assert context.context.startswith("## T") and context.planner_context.startswith("## T")
    with pytest.raises(ValueError):
        W.contexts(points, [])


def test_requests():
    assert W.checked_request({"essay": 1, "mcq": 2}, 2) == [("mcq", 2), ("essay", 1)]
    for bad in (({"quiz": 1}, 1), ({"mcq": 0}, 1), ({"mcq": 1}, 5)):
        with pytest.raises(ValueError):
            W.checked_request(*bad)


def test_broken_json_is_mended(spark):
    def chat(prompts):
        return ['{"a": 1}' if "no valid JSON" in p else "{broken" for p in prompts]

    out = W.ask_json(spark.createDataFrame([(1, "go")], "i int, prompt string"), chat)
    assert out.select(F.to_json("reply").alias("j")).first().j == '{"a":1}'
    never = W.ask_json(spark.createDataFrame([(1, "go")], "i int, prompt string"), lambda p: ["{broken"] * len(p))
    assert never.first().reply is None


def test_plans_are_asked_again_with_their_faults(spark):
    item = lambda t, c: {"question_type": "mcq", "topic": t, "concept_to_test": c}
    short = json.dumps({"exams": [{"model_number": 1, "questions": []}]})
    good = json.dumps({"exams": [{"model_number": 1, "questions": [item("Root", "water"), item("Leaf", "light")]}]})

    def chat(prompts):
        return [good if "faults" in p else short for p in prompts]

    tasks = spark.createDataFrame([("p", 1, "mcq", 1)], "plan_id string, model_number int, qtype string, want int")
    plan, errors = W.plan_until_sound(spark.createDataFrame([("p", "plan it")], "plan_id string, prompt string"), tasks, 1, chat)
    assert [r.topic for r in plan.collect()] == ["Root"]
    assert errors.count() == 1  # two items where one was asked for: trimmed after the last attempt


def test_validation_loop_repairs_only_what_failed(spark):
    make = lambda q, r: F.from_json(F.lit(json.dumps({"question": q, "reference_answer": r})), Q.QUESTION)
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "model_number int, question_id string").withColumn("qtype", F.lit("short_answer")).withColumn("q", F.when(F.col("question_id") == "a", make("Q", "")).otherwise(make("Q2", "A2")))
    judge = lambda prompts: ['{"question_valid": true, "answer_valid": true, "action": "PASS"}'] * len(prompts)
    mend = lambda prompts: ['{"question": "Q", "reference_answer": "mended"}'] * len(prompts)
    out, verdicts = W.validate_and_repair(rows, judge, mend)
    assert {r.question_id: r.q.reference_answer for r in out.collect()} == {"a": "mended", "b": "A2"}
    assert {r.action for r in verdicts.collect()} == {"PASS"}


def test_streamed_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"pages": [{"page": 1, "items": [{"type": "text", "value": f"A sentence of {name} stays."}, {"type": "text", "value": "12"}]}]}))
    (tmp_path / "in" / "bad.json").write_text("{")
    q = S.clean_stream(S.landed(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/items"))
    assert sorted(r.text for r in got.collect()) == ["A sentence of a stays.", "A sentence of b stays."]
    assert spark.read.parquet(str(tmp_path / "out/problems")).count() == 1


def test_generation_fills_only_what_is_missing(spark):
    def chat(prompts):
        first = {"statement": "Roots drink rain water", "answer": "True"}
        again = {"statement": "Roots drink the rain water", "answer": "False"}
        other = {"statement": "Leaves catch bright light", "answer": "True"}
        return [json.dumps({"questions": [first, again] if "Write 2" in p else [other]}) for p in prompts]

    tasks = spark.createDataFrame([("p", 1, "true_false", 2)], "plan_id string, model_number int, qtype string, want int")
    plan = spark.createDataFrame([("p", 1, "true_false", i, f"t{i}", "c") for i in range(2)], "plan_id string, model_number int, qtype string, item_idx int, topic string, concept string")
    out = W.generate(tasks, plan, "text", chat)
    assert [r.q.statement for r in out.orderBy("seq").collect()] == ["Roots drink rain water", "Leaves catch bright light"]
    assert W.assemble(out).first().markdown.startswith("## True / False\n\n1. Roots drink rain water\n   **Answer: True**\n\n2. Leaves")


def families(spark):
    parents = spark.createDataFrame([("d", f"p{i}", i, f"Passage of parent {i}") for i in range(6)], "document_id string, parent_id string, parent_order int, content string")
    children = spark.createDataFrame([("p0", 0, "c0", "first child"), ("p0", 1, "c1", "second child"), ("p1", 0, "c2", "an only child")], "parent_id string, child_order int, child_id string, content string")
    return parents, children


def test_families_are_titled_in_batches(spark, tmp_path):
    log = str(tmp_path / "log")

    def chat(prompts):
        with open(log, "a") as f:
            f.writelines(json.dumps(p) + "\n" for p in prompts)
        out = []
        for p in prompts:
            if p.startswith("Write one short heading for each"):
                asked = [x for x in p.split("\n\n")[1].split("\n")]
                out.append("\n".join(f"{i + 1}. {'Cell Walls' if 'parent 3' in x or 'parent 0' in x else 'Heading ' + x.split()[-1].title() + ' Here'}" for i, x in enumerate(asked)))
            else:
                out.append("Root Growth")
        return out

    got = {r.id: r.title for r in titling.family_titles(*families(spark), chat).collect()}
    assert got["p0"] == "Cell Walls" and got["p3"] == "Root Growth" and got["c0"] == "Heading Child Here" and "c2" not in got
    assert set(got) == {"p0", "p1", "p2", "p3", "p4", "p5", "c0", "c1"}
    prompts = [json.loads(x) for x in open(log)]
    batches = [p for p in prompts if p.startswith("Write one short heading for each")]
    assert len(batches) == 2 and "[SUBSECTION] first child" in batches[0] and "just before: none" in batches[0]
    assert "Root Growth" in batches[1] and "parent 4" in batches[1]
    assert any("'Cell Walls' does not do" in p for p in prompts)


def test_second_tries_fall_back(spark):
    rows = spark.createDataFrame([("a", "Overview", "about k-means clusters of points", ["Cell Walls"]), ("b", "", "zz", [])], "id string, header string, content string, used array<string>")
    got = {r.id: r.title for r in titling.second_tries(rows, lambda p: ["Cell Walls"] * len(p)).collect()}
    assert got["a"].startswith("k-means") and got["b"] == "Cell Walls"


def test_titles_are_reviewed_a_section_a_call(spark):
    rows = spark.createDataFrame([("d", "s", 1, "section", "p0", "Old Heading", "x"), ("d", "s", 2, "subsection", "c0", "Fine Heading", "y")], "document_id string, section_id string, pos int, level string, id string, title string, content string")
    got = titling.reviewed_titles(rows, lambda p: ["1. score=3 REPLACE: Plant Cells\n2. score=9 KEEP: Other Words"] * len(p))
    assert {r.id: r.title for r in got.collect()} == {"p0": "Plant Cells", "c0": "Fine Heading"}


def test_candidates(spark):
    rows = spark.createDataFrame([("x", ["Plant Cells"])], "content string, used array<string>")
    assert titling.candidate_titles(rows, lambda p: ["1. Overview\n2. Plant Cells\n3. Root Growth\n4. Leaf Form"] * len(p)).first().title == "Root Growth"


def test_plans_are_filled(spark):
    tasks = spark.createDataFrame([("p", m, t, 2) for m in (1, 2) for t in ("mcq", "essay")], "plan_id string, model_number int, qtype string, want int")
    plan = spark.createDataFrame([("p", 1, "mcq", i, f"t{i}", f"c{i}") for i in range(3)] + [("p", 1, "essay", 0, "e", "f")], "plan_id string, model_number int, qtype string, item_idx int, topic string, concept string")
    contexts = spark.createDataFrame([("p", "the text")], "plan_id string, prompt string")

    def chat(prompts):
        out = []
        for p in prompts:
            kind = p.split("of type ")[1].split()[0]
            out.append(json.dumps([{"question_type": kind, "topic": f"new {i}", "concept_to_test": f"{kind} {i} {len(p)}"} for i in range(3)] + [{"question_type": "quiz", "topic": "x", "concept_to_test": "y"}]))
        return out

    got, left = W.filled_plan(plan, tasks, contexts, chat)
    assert planning.counts(got, tasks).where("got <> want").count() == 0 and left.count() == 0
    assert {(r.item_idx, r.topic) for r in got.where("model_number = 1 and qtype = 'essay'").collect()} == {(0, "e"), (1, "new 0")}
    assert W.filled_plan(plan, tasks, contexts, lambda p: ["[]"] * len(p))[1].count() == 3


def test_invalid_items_are_repaired(spark):
    items = spark.createDataFrame([(1, "short_answer", 0, '{"question":"Why"}'), (1, "short_answer", 1, '{"question":"How"}')], "model_number int, qtype string, pos int, raw string")

    def chat(prompts):
        return ['{"question": "Why", "reference_answer": "So"}' if "Why" in p else "[]" for p in prompts]

    assert [(r.pos, r.q.reference_answer) for r in W.repaired_items(items, chat).collect()] == [(0, "So")]


def test_objective_types_share_a_call(spark, tmp_path):
    log = str(tmp_path / "log")

    def chat(prompts):
        with open(log, "a") as f:
            f.writelines("call\n" for p in prompts)
        both = [{"question_type": "true_false", "statement": "Roots drink rain water", "answer": "True"}, {"question_type": "fill_in_the_blank", "question": "Leaves catch ___ daily", "answer": "light"}]
        return [json.dumps({"questions": both if "true_false" in p else [{"question": "Why do stems bend", "reference_answer": "Wind"}]}) for p in prompts]

    tasks = spark.createDataFrame([("p", 1, t, 1) for t in ("true_false", "fill_in_the_blank", "short_answer")], "plan_id string, model_number int, qtype string, want int")
    plan = spark.createDataFrame([("p", 1, t, 0, "t", "c") for t in ("true_false", "fill_in_the_blank", "short_answer")], "plan_id string, model_number int, qtype string, item_idx int, topic string, concept string")
    out = W.generate(tasks, plan, "text", chat)
    assert {r.qtype for r in out.collect()} == {"true_false", "fill_in_the_blank", "short_answer"}
    assert len(open(log).readlines()) == 2
    assert {r.topic for r in planning.planned_questions(plan, out).collect()} == {"t"}


def test_packing_by_an_embedder(spark):
    rows = spark.createDataFrame([("d", "p", 0, 1, 1, "x", ["one two three", "one two four", "ten"])], "document_id string, parent_id string, parent_order int, page_start int, page_end int, content string, sentences array<string>")
    embed = lambda texts: [[1.0, 0.0] if "one" in t else [0.0, 1.0] for t in texts]
    assert chunk.pack_by_embedder(rows, embed).first().packed == ["one two three one two four", "ten"]


def test_collections_uploads_and_parsers(spark, tmp_path):
    path = str(tmp_path / "points")
    assert [search.ensure_collection(spark, path, d) for d in (2, 2, 3)] == ["created", "kept", "recreated"]
    files = spark.createDataFrame([("d", "a.pdf", bytearray(b"%PDF"))], "document_id string, filename string, content binary")
    row = registry.land(files, str(tmp_path / "up")).first()
    assert row.size_bytes == 4 and row.uploaded_at.endswith("+00:00") and bytes(spark.read.parquet(str(tmp_path / "up")).first().content) == b"%PDF"
    raw = spark.createDataFrame([("/x/a.b.pdf", bytearray(b"hello"))], "path string, content binary")
    got = P.parsed_payloads(raw, lambda b: json.dumps({"pages": [{"page": 1, "items": [{"type": "text", "value": b.decode()}]}]}))
    assert P.payload_pages(got).first().asDict()["document_id"] == "a.b"


def test_a_question_set_from_plan_to_exam(spark, tmp_path):
    """A plan that lacks an item, a question that fails and is mended; a second run of it all asks nothing."""
    log = str(tmp_path / "log")
    item = lambda k: {"question_type": "short_answer", "topic": f"Topic {k}", "concept_to_test": f"idea {k} {'abcdef'[k]}"}
    plan = json.dumps({"exams": [{"model_number": 1, "questions": [item(1)]}]})
    more = json.dumps([item(2), item(3)])
    written = json.dumps({"questions": [{"question": "Why do roots drink rain", "reference_answer": "Thirst"}, {"question": "How do leaves catch light", "reference_answer": "wrong"}]})

    def said(prompts, answer):
        with open(log, "a") as f:
            f.writelines("call\n" for _ in prompts)
        return [answer(p) for p in prompts]

    planner = lambda prompts: said(prompts, lambda p: more if p.startswith("Add ") else plan)
    writer = lambda prompts: said(prompts, lambda p: written)
    judge = lambda prompts: said(prompts, lambda p: json.dumps({"question_valid": True, "answer_valid": "wrong" not in p, "action": "FIX_ANSWER" if "wrong" in p else "PASS"}))
    mend = lambda prompts: said(prompts, lambda p: json.dumps({"question": "How do leaves catch light", "reference_answer": "Pigment"}))
    tasks = spark.createDataFrame([("p", 1, "short_answer", 2)], "plan_id string, model_number int, qtype string, want int")
    prompts = spark.createDataFrame([("p", "plan it")], "plan_id string, prompt string")
    run = lambda: W.question_set(prompts, tasks, 1, "text", planner, writer, judge, mend, ledger=W.Ledger(f"file://{tmp_path}/ledger"))
    done = run()
    assert {r.topic for r in done.plan.collect()} == {"Topic 1", "Topic 2"} and done.deficits.count() == 0
    markdown = done.exams.first().markdown
    assert markdown.startswith("## Short Answer\n\n1. Why do roots drink rain\n   **Answer:** Thirst") and "Pigment" in markdown and "wrong" not in markdown
    assert {r.action for r in done.verdicts.collect()} == {"PASS"}
    calls = len(open(log).readlines())
    assert run().exams.first().markdown == markdown and len(open(log).readlines()) == calls
