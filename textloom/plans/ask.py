"""Models behind two small protocols, called batch by batch on the executors.

    embed(texts: list[str]) -> list[list[float]]
    chat(prompts: list[str]) -> list[str]

Replies go through a ledger: a folder of small Parquet files, each a batch of replies under
the hashes of their prompts. A prompt that is in the ledger is not asked again, whether
by a second action, another run or a task that is repeated: prompts lie in tasks and
batches by their hashes, so a repeated task makes the same batches and finds the files
of those it finished. A file appears whole, by a rename.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.shared import materialise, shared_dir

Embed = Callable[[list[str]], list[list[float]]]
Chat = Callable[[list[str]], list[str]]


class CallTimeout(Exception):
    """A model did not reply in time."""


_LOADED: dict[str, object] = {}


class Loaded:
    """A model that each worker process makes once, by `make()`, and warms up by one call; used like the model itself."""

    def __init__(self, make: Callable[[], Callable], warm_up: list[str] | None = None):
        self.make, self.warm_up, self.name = make, warm_up, uuid.uuid4().hex

    def __call__(self, texts: list[str]):
        if self.name not in _LOADED:
            model = self.make()
            if self.warm_up:
                model(self.warm_up)
            _LOADED[self.name] = model
        return _LOADED[self.name](texts)


@dataclass(frozen=True)
class Ledger:
    """Where replies are kept and how calls are made; `model` is part of a reply's key."""

    path: str
    model: str = ""
    batch: int = 16
    timeout: float = 600.0
    retries: int = 2
    pause: float = 1.0

    def replies(self, spark: SparkSession) -> DataFrame:
        """(key, reply) of all that was answered; a prompt that two tasks asked at one time counts once."""
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(root)
        return spark.read.schema("key string, reply string").parquet(self.path).dropDuplicates(["key"])

    def missing(self, spark: SparkSession, keyed: DataFrame) -> DataFrame:
        return keyed.join(self.replies(spark).select("key"), "key", "left_anti")


def in_time(call: Callable, texts: list[str], seconds: float):
    """call(texts), or CallTimeout. The call goes on in a thread of its own that nothing waits for."""
    out: dict = {}

    def run() -> None:
        try:
            out["value"] = call(texts)
        except BaseException as e:  # noqa: BLE001  handed to the caller
            out["error"] = e

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if "error" in out:
        raise out["error"]
    if "value" not in out:
        raise CallTimeout(f"no reply in {seconds:g} s")
    return out["value"]


def _replies_to(prompts: list[str], chat: Chat, ledger: Ledger) -> list[tuple[str | None, str | None]]:
    """(reply, error) of each prompt: the batch is tried `retries` times more, then its prompts one by one, so that
    one that cannot be answered does not hold back the others."""

    def tried(some: list[str], times: int) -> list:
        for k in range(times):
            try:
                replies = list(in_time(chat, some, ledger.timeout))
                if len(replies) != len(some):
                    raise ValueError(f"{len(replies)} replies to {len(some)} prompts")
                return replies
            except Exception as e:  # noqa: BLE001  a client raises what it likes
                error = e
                if k < times - 1:
                    time.sleep(ledger.pause * 2**k)
        raise error

    try:
        return [(r, None) for r in tried(prompts, ledger.retries + 1)]
    except Exception as e:  # noqa: BLE001
        if len(prompts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [x for p in prompts for x in _replies_to([p], chat, replace(ledger, retries=0))]


def _asking(chat: Chat, ledger: Ledger) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers (key, prompt) rows, writes each batch to the ledger, and gives (key, error)."""

    def answer(fs: pyarrow.fs.FileSystem, root: str, rows: list[tuple[str, str]]) -> list[tuple[str, str | None]]:
        name = hashlib.sha256("".join(k for k, _ in rows).encode()).hexdigest()
        final = f"{root}/{name}.parquet"
        held: set[str] = set()
        while fs.get_file_info(final).type == pyarrow.fs.FileType.File:  # an earlier attempt of this task was here
            held |= set(pq.read_table(final, columns=["key"], filesystem=fs).column(0).to_pylist())
            final = f"{root}/{name}-{len(held)}.parquet"
        rows = [r for r in rows if r[0] not in held]
        said = _replies_to([p for _, p in rows], chat, ledger) if rows else []
        good = [(k, r) for (k, _), (r, e) in zip(rows, said) if e is None]
        if good:
            table = pa.table({"key": [k for k, _ in good], "reply": pa.array([r for _, r in good], pa.string())})
            part = f"{root}/_{name}-{uuid.uuid4().hex}"  # readers pass names with _ by
            pq.write_table(table, part, filesystem=fs)
            fs.move(part, final)
        return [(k, e) for (k, _), (_, e) in zip(rows, said) if e is not None]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(ledger.path)
        held: list[tuple[str, str]] = []
        bad: list[tuple[str, str | None]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == ledger.batch:
                    bad += answer(fs, root, held)
                    held = []
        if held:
            bad += answer(fs, root, held)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in bad], pa.string()), pa.array([e for _, e in bad], pa.string())], names=["key", "error"])

    return ask


def answered(df: DataFrame, prompt: str, into: str, chat: Chat, ledger: Ledger | None = None, salt: str = "", error: str | None = None) -> DataFrame:
    """Adds the model's reply to a prompt column; null where the prompt is null or the model failed.

    Calls are made here, once for each distinct prompt; the result reads replies only. Without
    a ledger one of its own is begun, for this call. `salt` parts replies to equal prompts
    that are meant to differ. `error` names a column for what a failed call said; failed
    calls are not kept, so that the next run asks again.
    """
    spark = df.sparkSession
    ledger = ledger or Ledger(f"{shared_dir(spark)}/textloom/replies-{uuid.uuid4().hex}")
    key = F.when(F.col(prompt).isNotNull(), F.sha2(F.concat_ws("\u0000", F.lit(ledger.model), F.lit(salt), prompt), 256))
    keyed = df.withColumn("__key", key)
    asked = keyed.where("__key is not null").groupBy(F.col("__key").alias("key")).agg(F.first(prompt).alias("prompt"))
    todo = ledger.missing(spark, asked).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    failed = materialise(todo.select("key", "prompt").mapInArrow(_asking(chat, ledger), "key string, error string"), "failed-calls")
    out = keyed.join(ledger.replies(spark).select(F.col("key").alias("__key"), F.col("reply").alias(into)), "__key", "left")
    if error:
        out = out.join(failed.select(F.col("key").alias("__key"), F.col("error").alias(error)), "__key", "left")
    return out.drop("__key")


def embedded(df: DataFrame, column: str, into: str, embed: Embed, batch: int = 64) -> DataFrame:
    """Adds a vector column. Each distinct text is embedded once; a task takes its texts by length, so that a batch
    pads little. Null text is embedded as an empty one. Vectors are computed here, and read from then on."""
    text = F.coalesce(column, F.lit(""))
    keyed = df.withColumn("__key", F.sha2(text, 256))
    texts = keyed.groupBy("__key").agg(F.first(text).alias("__text"))
    dealt = texts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__key").sortWithinPartitions(F.length("__text"), "__key")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                made = embed(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[float(x) for x in v] for v in made], pa.list_(pa.float32()))], names=["__key", into])

    done = materialise(dealt.mapInArrow(vectors, f"__key string, `{into}` array<float>"), "vectors")
    return keyed.join(done, "__key", "left").drop("__key")
