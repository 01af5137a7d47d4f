"""Model calls: one a prompt, whatever fails or is repeated."""

from __future__ import annotations

import json
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.plans import workflow as W
from textloom.plans.ask import Ledger, Loaded, answered, embedded


def logging_chat(log, reply=lambda p: p.upper()):
    def chat(prompts):
        with open(log, "a") as f:
            f.writelines(json.dumps(p) + "\n" for p in prompts)
        return [reply(p) for p in prompts]

    return chat


def asked(log):
    return Counter(json.loads(x) for x in open(log)) if os.path.exists(log) else Counter()


def test_a_prompt_is_asked_once(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(i, f"p{i % 7}" if i else None) for i in range(50)], "i int, prompt string").repartition(5)
    ledger = Ledger(f"file://{tmp_path}/ledger", batch=2)
    out = answered(rows, "prompt", "reply", logging_chat(log), ledger)
    assert out.columns == ["i", "prompt", "reply"]
    for _ in range(2):  # a second action reads what the first one got
        assert {r.i: r.reply for r in out.collect()} == {i: f"P{i % 7}" if i else None for i in range(50)}
    answered(rows, "prompt", "reply", logging_chat(log), ledger).collect()
    assert asked(log) == {f"p{i}": 1 for i in range(7)}
    more = rows.withColumn("prompt", F.concat("prompt", F.lit("!"))).unionByName(rows)
    assert answered(more, "prompt", "reply", logging_chat(log), ledger).where("prompt = 'p3!'").first().reply == "P3!"
    assert asked(log) == {f"p{i}{x}": 1 for i in range(7) for x in ("", "!")}
    answered(rows, "prompt", "reply", logging_chat(log), ledger, salt="other").collect()
    assert asked(log)["p1"] == 2


def test_a_task_that_dies_is_repeated_without_asking_again(spark, tmp_path):
    log, dead = str(tmp_path / "log"), str(tmp_path / "dead")
    good = logging_chat(log)

    def dying(prompts):
        if os.path.exists(log) and len(open(log).readlines()) >= 12:
            open(dead, "w").close()
            os._exit(1)  # the worker is lost in the middle of its task
        return good(prompts)

    rows = spark.createDataFrame([(f"p{i}",) for i in range(40)], "prompt string")
    ledger = Ledger(f"file://{tmp_path}/ledger", batch=3)
    with pytest.raises(Exception):
        answered(rows, "prompt", "reply", dying, ledger)
    assert os.path.exists(dead) and asked(log)
    out = answered(rows, "prompt", "reply", good, ledger)
    assert {r.prompt: r.reply for r in out.collect()} == {f"p{i}": f"P{i}" for i in range(40)}
    lost = [p for p, n in asked(log).items() if n > 1]
    assert max(asked(log).values()) <= 2 and len(lost) <= 3 * 4  # at most the batches that other tasks had under way when the job was cancelled


def test_late_short_and_failing_replies(spark, tmp_path):
    def chat(prompts):
        if "slow" in prompts:
            time.sleep(30)
        if "short" in prompts:
            return []
        if "bad" in prompts:
            raise RuntimeError("no such model")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(p,) for p in ("a", "b", "slow", "short", "bad", "c")], "prompt string").coalesce(1)
    ledger = Ledger(f"file://{tmp_path}/ledger", timeout=1.0, retries=0, pause=0.0)
    got = {r.prompt: (r.reply, (r.error or "").split(":")[0]) for r in answered(rows, "prompt", "reply", chat, ledger, error="error").collect()}
    assert got == {"a": ("A", ""), "b": ("B", ""), "c": ("C", ""), "slow": (None, "CallTimeout"), "short": (None, "ValueError"), "bad": (None, "RuntimeError")}
    again = answered(rows, "prompt", "reply", lambda ps: [p.upper() for p in ps], ledger)
    assert {r.prompt for r in again.where("reply is null").collect()} == set()


def test_a_workflow_is_taken_up_again(spark, tmp_path):
    log = str(tmp_path / "log")
    first = {"statement": "Roots drink rain water", "answer": "True"}
    other = {"statement": "Leaves catch bright light", "answer": "True"}
    reply = lambda p: json.dumps({"questions": [first] if "Write 2" in p else [other]})
    tasks = spark.createDataFrame([("p", 1, "true_false", 2)], "plan_id string, model_number int, qtype string, want int")
    plan = spark.createDataFrame([("p", 1, "true_false", i, f"t{i}", "c") for i in range(2)], "plan_id string, model_number int, qtype string, item_idx int, topic string, concept string")
    ledger = Ledger(f"file://{tmp_path}/ledger", model="m", retries=0)

    good = logging_chat(log, reply)

    def stops(prompts):
        if any("Write 1" in p for p in prompts):
            raise RuntimeError("stopped between two attempts")
        return good(prompts)

    W.generate(tasks, plan, "text", stops, ledger=ledger)
    before = asked(log)
    assert sum(before.values()) == 1
    out = W.generate(tasks, plan, "text", logging_chat(log, reply), ledger=ledger)
    assert [r.q.statement for r in out.orderBy("seq").collect()] == [first["statement"], other["statement"]]
    assert max(asked(log).values()) == 1 and sum(asked(log).values()) == 2


def test_a_missing_verdict_is_asked_for_once_more(spark, tmp_path):
    log = str(tmp_path / "log")
    good = '{"question_valid": true, "answer_valid": false, "action": "FIX_ANSWER", "fields_to_fix": ["answer"]}'
    reply = lambda p: "{}" if p.startswith("never") or "no verdict" not in p and p.startswith("late") else good
    rows = spark.createDataFrame([(1, p, f"{p} question") for p in ("soon", "late", "never")], "model_number int, question_id string, prompt string")
    got = {r.question_id: r.seq for r in W.judged_by(rows, logging_chat(log, reply)).collect()}
    assert got == {"soon": 1, "late": 2} and sum(asked(log).values()) == 5


def test_each_text_is_embedded_once(spark, tmp_path):
    log, made = str(tmp_path / "log"), str(tmp_path / "made")

    counted = logging_chat(log)

    def make():
        with open(made, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [[float(len(t)), 1.0] for t in (counted(texts) and texts)]

    rows = spark.createDataFrame([(i, ["a", "bbb", None, "", "cc"][i % 5]) for i in range(60)], "i int, text string").repartition(6)
    out = embedded(rows, "text", "v", Loaded(make, ["warm"]), batch=2)
    for _ in range(2):
        assert {r.i: r.v for r in out.collect()} == {i: [[1.0, 1.0], [3.0, 1.0], [0.0, 1.0], [0.0, 1.0], [2.0, 1.0]][i % 5] for i in range(60)}
    counts = asked(log)
    warm = counts.pop("warm")
    assert counts == {"a": 1, "bbb": 1, "": 1, "cc": 1}
    pids = open(made).read().split()
    assert len(pids) == len(set(pids)) == warm  # once in each worker process
