from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions import questions as Q
from textloom.functions import text as T
from textloom.operators import chunk, clean, dedupe, review, search, structure, titling
from textloom.sources import pages as P
from textloom.sources import registry


def pages(spark, docs):
    item = lambda v: ("text", v, None, None) if not isinstance(v, tuple) else (*v, None, None)
    rows = [(d, i, i + 1, [item(v) for v in p]) for d, ps in docs.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, f"document_id string, page_idx long, page int, items array<{P.ITEM}>")


def test_payload_checks(spark, tmp_path):
    good = {"pages": [{"page": 1, "items": [{"type": "text", "value": "a b"}]}, {"page": None, "items": []}]}
    bad = {"none": {}, "empty": {"pages": []}, "noitems": {"pages": [{"page": 1}]}, "notlist": {"pages": [{"items": 3}]}, "nothing": {"pages": [{"items": []}]}, "bool": {"pages": [{"page": True, "items": [{"type": "text", "value": "x"}]}]}, "kind": {"pages": [{"items": [{"type": "image", "value": "x"}]}]}, "value": {"pages": [{"items": [{"type": "text", "value": 3}]}]}}
    for name, body in {"good": good, **bad}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "broken.json").write_text("{")
    payloads = P.read_payloads(spark, str(tmp_path))
    problems = {r.document_id: r.problem for r in P.check_payloads(payloads).collect()}
    assert problems.pop("good") is None
    assert set(problems) == {*bad, "broken"} and all(problems.values())
    assert [(r.document_id, r.page_idx, r.page) for r in P.payload_pages(payloads).orderBy("page_idx").collect()] == [("good", 0, 1), ("good", 1, None)]


def test_headers_go_and_duplicates_stay_once(spark):
    docs = {"d": [[f"My Book - {i}", f"Unique sentence number {'abcdef'[i]} stays here.", "Repeated body text."] for i in range(5)]}
    out = clean.clean(pages(spark, docs))
    got = {(r.page_idx, r.item_idx): r.category for r in out.collect()}
    assert all(got[i, 0] == "header_footer" for i in range(5))
    assert all(got[i, 2] == "header_footer" for i in range(5))  # five times at the bottom
    assert all(got[i, 1] is None for i in range(5))


def test_headings_skip_junk_rules_but_not_duplicates(spark):
    out = clean.clean(pages(spark, {"d": [[("heading", "References"), ("heading", "References"), "Figure 3 small", "Text that stays."]]}))
    assert [r.category for r in out.orderBy("item_idx").collect()] == [None, "duplicate", "figure_caption", None]
    stats = clean.cleaning_stats(out).first()
    assert (stats.processed, stats.removed, stats.duplicates) == (4, 2, 1)


def test_cleaned_pages_keep_markdown_in_step(spark):
    df = spark.createDataFrame([("d", 0, 1, [("text", "It is so. 12 Later on", "md", None)])], f"document_id string, page_idx long, page int, items array<{P.ITEM}>")
    item = clean.cleaned_pages(clean.clean(df)).first()["items"][0]
    assert item.value == item.md == "It is so. Later on"


def test_empty_pages(spark):
    assert clean.clean(pages(spark, {}).limit(0)).count() == 0


def plain_pack(sentences, vectors, most, threshold):
    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    out, cur, mean, n = [], None, None, 0
    for s, v in zip(sentences, vectors):
        if cur is not None and len(f"{cur} {s}".split()) <= most and cos(mean, v) >= threshold:
            cur, mean, n = f"{cur} {s}", [(a * n + b) / (n + 1) for a, b in zip(mean, v)], n + 1
        else:
            if cur is not None:
                out.append(cur)
            cur, mean, n = s, v, 1
    return out + ([cur] if cur is not None else [])


def test_similar_packing_is_the_plain_walk(spark):
    import random

    rng = random.Random(4)
    cases = [([" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 30))) for _ in range(n)], [[rng.random() - 0.3 for _ in range(3)] for _ in range(n)]) for n in (0, 1, 2, 7, 25)]
    df = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(cases)], "i int, s array<string>, v array<array<double>>")
    got = {r.i: r.p for r in df.select("i", chunk.pack_similar(F.col("s"), F.col("v"), 40, 0.5).alias("p")).collect()}
    assert got == {i: plain_pack(s, v, 40, 0.5) for i, (s, v) in enumerate(cases)}


def test_long_sentence_stays_whole(spark):
    df = spark.createDataFrame([(["a b", "c d e f g", "h"],)], "s array<string>")
    assert df.select(chunk.pack_words(F.col("s"), 3).alias("p")).first().p == ["a b", "c d e f g", "h"]


def test_floor_and_overlap(spark):
    get = lambda f, x: spark.createDataFrame([(x,)], "s array<string>").select(f(F.col("s")).alias("r")).first().r
    long = "Roots " + "drink water " * 40 + "daily."
    assert get(chunk.floor_small, ["of the", long, "Leaves eat light now."]) == [f"{long} Leaves eat light now."]
    assert get(chunk.floor_small, ["Small head text here.", long]) == [f"Small head text here. {long}"]
    assert get(chunk.overlap, ["One here. Two here.", "Three there."]) == ["One here. Two here.", "Two here. Three there."]
    assert get(lambda c: chunk.overlap(c, Settings(child_max_tokens=5)), ["One here. Two here.", "Three there."]) == ["One here. Two here.", "Three there."]


def test_small_parents_merge_backwards(spark):
    word = lambda n: " ".join(["w"] * n)
    sizes = [60, 200, 50, 45, 30, 300]  # 30 words are dropped; 60 joins the second
    df = spark.createDataFrame([("d", i, i, i, word(n)) for i, n in enumerate(sizes)], "document_id string, parent_order int, page_start int, page_end int, content string")
    out = chunk.parents_of(df).orderBy("parent_order").collect()
    assert [(len(r.content.split()), r.page_start, r.page_end) for r in out] == [(60 + 200 + 50 + 45, 0, 3), (300, 5, 5)]


def test_large_parent_is_cut_at_sentences(spark):
    text = " ".join(["Word " * 99 + "end."] * 15)
    df = spark.createDataFrame([("d", 0, 2, 9, text)], "document_id string, parent_order int, page_start int, page_end int, content string")
    out = chunk.parents_of(df).orderBy("parent_order").collect()
    assert [len(r.content.split()) for r in out] == [900, 600] and {(r.page_start, r.page_end) for r in out} == {(2, 9)}


def test_question_parent_is_one_child(spark):
    text = "1. how does it go? 2. why is it so? 3. who did it?"
    df = spark.createDataFrame([("d", "p", 0, 1, 1, text)], "document_id string, parent_id string, parent_order int, page_start int, page_end int, content string")
    ready = df.withColumn("sentences", T.prepare_sentences(F.col("content"))).withColumn("vectors", F.transform("sentences", lambda s: F.array(F.lit(1.0).cast("float"))))
    assert df.select(T.is_question_text(F.col("content"), DEFAULTS.question_share).alias("q")).first().q in (True, False)
    assert chunk.children_of(ready).count() >= 1


def test_overlap_warnings(spark):
    p = spark.createDataFrame([("d", "a", 0, "x y z"), ("d", "b", 1, "y z w")], "document_id string, parent_id string, parent_order int, content string")
    c = spark.createDataFrame([("d", "a", "c1", 0, "One two. Three four."), ("d", "a", "c2", 1, "Three four. Five.")], "document_id string, parent_id string, child_id string, child_order int, content string")
    assert [(r.level, r.shared) for r in chunk.overlap_warnings(p, c).collect()] == [("parent", 2)]


def test_untitled_children_are_counted_but_not_shown(spark):
    p = spark.createDataFrame([("d", "p", 0, "T", 1, 2), ("d", "q", 1, None, 3, 3)], "document_id string, parent_id string, parent_order int, title string, page_start int, page_end int")
    c = spark.createDataFrame([("d", "p", 1, "c2", "B", 2, 2), ("d", "p", 0, "c1", None, 1, 1)], "document_id string, parent_id string, child_order int, child_id string, title string, page_start int, page_end int")
    tree = structure.section_tree(p, c)
    row = tree.orderBy("parent_order").first()
    assert row.child_ids == ["c1", "c2"] and row.subsection_titles == [None, "B"] and [(s.child_id, s.order) for s in row.subsections] == [("c2", 0)]
    doc = structure.structures(tree).first()
    assert (doc.section_count, doc.child_count, [s.title for s in doc.sections]) == (2, 2, ["T", None])


def test_fetch_keeps_the_callers_order(spark):
    points = spark.createDataFrame([("a", 1), ("b", 2)], "child_id string, x int")
    assert [r.child_id for r in search.fetch(points, ["b", "a", "z", "b"]).collect()] == ["b", "a", "b"]


def test_search_filters_below_the_limit(spark):
    points = spark.createDataFrame([(i, "d" if i % 2 else "e", [float(i), 1.0], {1: float(i)}) for i in range(10)], "child_id int, document_id string, dense array<double>, sparse map<int,double>")
    where = search.payload_filter("e")
    assert [r.child_id for r in search.dense_top_k(points, [1.0, 0.0], 3, where).collect()] == [8, 6, 4]
    assert [r.child_id for r in search.hybrid_search(points, [1.0, 0.0], {1: 1.0}, 2, where).collect()] == [8, 6]


def test_points_replace_a_document(spark, tmp_path):
    path = str(tmp_path / "points")
    make = lambda d, ids: spark.createDataFrame([(d, i, [1.0, 2.0]) for i in ids], "document_id string, child_id string, dense array<double>")
    search.upsert(make("a", ["1", "2"]), path, 2)
    search.upsert(make("b", ["3"]), path, 2)
    search.upsert(make("a", ["4"]), path, 2)
    assert sorted(r.child_id for r in search.stored_points(spark, path).collect()) == ["3", "4"]
    search.delete_document(spark, path, "a")
    search.delete_document(spark, path, "missing")
    assert search.count_points(spark, path, "b") == 1


def test_registry(spark, tmp_path):
    path = str(tmp_path / "reg")
    assert registry.documents(spark, path).count() == 0
    row = lambda i, t: spark.createDataFrame([(i, "f", 1, t, "{}")], registry.REGISTRY)
    for i, t in (("a", "2024-01-01"), ("b", "2024-03-01"), ("a", "2024-02-01")):
        registry.register(row(i, t), path)
    found = registry.documents(spark, path)
    assert {(r.document_id, r.uploaded_at) for r in found.collect()} == {("a", "2024-02-01"), ("b", "2024-03-01")}
    assert registry.current_document(found).first()[0] == "b"


def test_near_pairs_equal_the_nested_loop(spark):
    import random

    rng = random.Random(2)
    rows = [(i, sorted({f"t{rng.randint(0, 12)}" for _ in range(rng.randint(0, 8))})) for i in range(40)]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and len({*x} & {*y}) / len({*x} | {*y}) >= 0.35}
    got = dedupe.near_pairs(spark.createDataFrame(rows, "i int, t array<string>"), "i", "t", 0.35)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_greedy_acceptance_is_the_plain_walk(spark):
    import random

    rng = random.Random(3)
    rows = [("g", i, rng.choice(["mcq", "essay"]), [f"t{rng.randint(0, 9)}" for _ in range(5)], rng.random() < 0.1) for i in range(30)] + [("h", 0, "mcq", ["t1"], False)]
    df = spark.createDataFrame(rows, "g string, o int, q string, t array<string>, f boolean").withColumn("t", F.array_distinct("t")).withColumn("k", F.array_join("t", " "))
    got = {(r.g, r.o): r.verdict for r in dedupe.accept_greedily(df, "g", "o", F.col("q"), F.col("k"), F.create_map(F.lit("mcq"), "t", F.lit("essay"), "t"), F.col("f"), 0.35).collect()}
    want, seen, taken = {}, {}, {}
    for g, o, q, t, f in rows:
        t = list(dict.fromkeys(t))
        s, a = seen.setdefault(g, set()), taken.setdefault(g, [])
        if f:
            want[g, o] = "forbidden"
            continue
        key = (q, " ".join(t))
        v = "duplicate" if key in s else "near_duplicate" if any(len({*t} & {*x}) / len({*t} | {*x}) >= 0.35 for x in a) else "accepted"
        s.add(key)
        if v == "accepted":
            a.append(t)
        want[g, o] = v
    assert got == want


def test_independent_set_over_many_ranges(spark):
    """Chains, stars and random edges of one large group and some small ones, against one walk in order."""
    import random

    rng = random.Random(5)
    edges = {("chain", i, i + 1) for i in range(400)} | {("star", 0, i) for i in range(1, 300)} | {("back", i, 299) for i in range(299)}
    edges |= {("mixed", *sorted(rng.sample(range(600), 2))) for _ in range(900)} | {(f"g{rng.randint(0, 20)}", *sorted(rng.sample(range(9), 2))) for _ in range(80)}
    df = spark.createDataFrame([(g, (a, a), (b, b)) for g, a, b in edges], "g string, a struct<o:long,id:long>, b struct<o:long,id:long>")
    got = {(r.g, r.b): r.accepted for r in dedupe.first_independent(df, 700).collect()}
    assert got == {(r.g, r.b): r.accepted for r in dedupe.first_independent(df).collect()}
    before, want = {}, {}
    for g, a, b in edges:
        before.setdefault((g, b), []).append(a)
    for g, b in sorted(before):
        want[g, b] = not any(want.get((g, a), True) for a in before[g, b])
    assert got == want


def test_greedy_acceptance_of_odd_rows(spark):
    rows = [(None, 1, "mcq", ["a", "b"], None), (None, 2, "mcq", ["b", "a"], False), (None, 2, None, ["a"], False), ("g", 1, "mcq", [], False), ("g", 2, "mcq", [], False), ("g", 3, "essay", [], False), ("g", 4, "mcq", ["a"], True), ("g", 5, "mcq", ["a"], False), ("g", 6, "mcq", ["a"], False)]
    df = spark.createDataFrame(rows, "g string, o int, q string, t array<string>, f boolean").withColumn("k", F.array_join("t", " "))
    judge = lambda d: dedupe.accept_greedily(d, "g", "o", F.col("q"), F.col("k"), F.create_map(F.lit("mcq"), "t", F.lit("essay"), "t"), F.col("f"), 0.35)
    got = {(r.g, r.o, r.q): r.verdict for r in judge(df).collect()}
    assert got == {(None, 1, "mcq"): "accepted", (None, 2, "mcq"): "near_duplicate", (None, 2, None): "accepted", ("g", 1, "mcq"): "accepted", ("g", 2, "mcq"): "duplicate", ("g", 3, "essay"): "accepted", ("g", 4, "mcq"): "forbidden", ("g", 5, "mcq"): "accepted", ("g", 6, "mcq"): "duplicate"}
    assert judge(df).columns == [*df.columns, "verdict"] and judge(df.limit(0)).count() == 0


def test_ids_continue(spark):
    rows = spark.createDataFrame([(1, "mcq", 0, "model1_mcq_4"), (1, "mcq", 1, None), (1, "mcq", 2, ""), (1, "essay", 0, None)], "model_number int, qtype string, o int, question_id string")
    got = {(r.qtype, r.o): r.question_id for r in review.assign_ids(rows, "o").collect()}
    assert got == {("mcq", 0): "model1_mcq_4", ("mcq", 1): "model1_mcq_5", ("mcq", 2): "model1_mcq_6", ("essay", 0): "model1_essay_1"}


def test_missing_verdict_never_passes(spark):
    q = spark.createDataFrame([(1, "a", "mcq"), (1, "b", "mcq")], "model_number int, question_id string, qtype string")
    raw = spark.createDataFrame([(1, "a", 0, False, True, "PASS", []), (1, "a", 1, True, True, "PASS", []), (1, "zz", 0, True, True, "PASS", [])], "model_number int, question_id string, seq int, question_valid boolean, answer_valid boolean, action string, fields_to_fix array<string>")
    v = review.settled_verdicts(raw, q)
    assert {r.question_id: r.action for r in v.collect()} == {"a": "PASS", "b": "FIX_QUESTION_AND_ANSWER"}
    assert review.exam_verdicts(v).first().all_pass is False


def test_local_verdicts(spark):
    make = lambda **k: spark.range(1).select(F.from_json(F.lit(json.dumps(k)), Q.QUESTION).alias("q"))
    act = lambda t, df, bank=None: df.select(Q.local_verdict(F.lit(t), F.col("q"), F.array(*[F.lit(b) for b in bank]) if bank else F.lit(None).cast("array<string>"))["action"].alias("a")).first().a
    four = {"A": "1", "B": "2", "C": "3", "D": "4"}
    assert act("mcq", make(question="q", options=four, correct_answer="A")) is None
    assert act("mcq", make(question="q", options=four | {"D": "1"}, correct_answer="A")) == "FIX_OPTIONS"
    assert act("mcq", make(question="q", options=four, correct_answer="E")) == "FIX_OPTIONS"
    assert act("true_false", make(statement=" ", answer="True")) == "FIX_QUESTION"
    assert act("true_false", make(statement="s", answer="perhaps")) == "FIX_ANSWER"
    assert act("fill_in_the_blank", make(question="no blank", answers=["x"])) == "FIX_QUESTION"
    assert act("fill_in_the_blank", make(question="a ___", answers=["x"]), ["y"]) == "FIX_OPTIONS"
    assert act("essay", make(question="q", reference_answer="")) == "FIX_ANSWER"


def test_types_read_one_another_their_own_way(spark):
    q = spark.range(1).select(F.from_json(F.lit(json.dumps({"question": "roots drink", "reference_answer": "water deep"})), Q.QUESTION).alias("q")).select(Q.readings(F.col("q")).alias("m")).first().m
    assert sorted(q["mcq"]) == ["drink", "roots"] and sorted(q["short_answer"]) == ["deep", "drink", "roots", "water"] and q["true_false"] == []


def test_blank_section_errors(spark):
    items = spark.createDataFrame([(1, 0, "A ___ here", ["cell"]), (1, 1, "", ["x"]), (1, 2, "As shown in ___", ["a", "b", "c"]), (1, 3, "B ___", ["moss"])], "model_number int, item_idx int, question string, answers array<string>")
    banks = spark.createDataFrame([(1, ["Cell", "leaf", "stem"])], "model_number int, terms array<string>")
    got = {r.error for r in review.blank_errors(items, banks, spark.createDataFrame([(1, 3)], "model_number int, want int")).collect()}
    assert got == {"4 items, required 3", "item 2: no question", "item 3: 3 answers", "item 3: 'a' is not in the word bank", "item 3: 'b' is not in the word bank", "item 3: 'c' is not in the word bank", "item 4: 'moss' is not in the word bank", "item 3: a forbidden phrase"}


def test_unique_titles(spark):
    rows = [("d", i, t, c) for i, (t, c) in enumerate([("Cells", "x"), ("Cells", "the k-means clusters grow"), ("Cells", "a b"), ("", "a b"), ("Cells II", "a b"), ("Cells II", "a b"), (None, "a b")])] + [("e", 0, "Cells", "x")]
    df = spark.createDataFrame(rows, "document_id string, o int, title string, content string")
    got = {(r.document_id, r.o): r.title for r in titling.make_unique(df, "document_id", "o").collect()}
    assert got == {("d", 0): "Cells", ("d", 1): "k-means Clusters Grow", ("d", 2): "Cells II", ("d", 3): "Key Concept II", ("d", 4): "Cells III", ("d", 5): "Cells IV", ("d", 6): "Key Concept III", ("e", 0): "Cells"}


def test_family_batches(spark):
    p = spark.createDataFrame([("d", f"p{i}", i, "c") for i in range(6)], "document_id string, parent_id string, parent_order int, content string")
    c = spark.createDataFrame([("p0", 0, "c0", "x"), ("p1", 1, "c2", "x"), ("p1", 0, "c1", "x")], "parent_id string, child_order int, child_id string, content string")
    got = {(r.batch, r.pos): r.id for r in titling.family_batches(p, c).collect()}
    assert got == {(0, 1): "p0", (0, 2): "p1", (0, 3): "c1", (0, 4): "c2", (0, 5): "p2", (0, 6): "p3", (1, 1): "p4", (1, 2): "p5"}


def test_reviewed_titles(spark):
    rows = spark.createDataFrame([("d", "a", "Old Name"), ("d", "b", "Good Name"), ("d", "c", "Bad Name")], "document_id string, id string, title string")
    v = spark.createDataFrame([("a", 3, "REPLACE", "Cell Walls"), ("b", 9, "REPLACE", "Other Thing"), ("c", 2, "REFINE", "Overview")], "id string, score int, verdict string, proposal string")
    assert {r.id: r.title for r in titling.reviewed(rows, v).collect()} == {"a": "Cell Walls", "b": "Good Name", "c": "Bad Name"}
