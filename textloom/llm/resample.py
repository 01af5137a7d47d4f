"""Importance resampling towards a target distribution, on hashed word features.

The words of a column of texts are found by a byte automaton that works on the Arrow
UTF-8 buffer itself, for all texts of a batch at once: one lookup table makes a byte a
lower-case word byte or nothing, differences of that mask are the word edges, and the
CRCs of all words advance together, a byte of each word in each step. Words of more
than PIECE bytes are pieces that advance side by side as well; a CRC is linear, so
the pieces are joined by tables that shift a CRC past PIECE bytes.

A feature is a run of 1 to `most` words, joined by one space, repeats counted; its bucket is
its CRC modulo the number of buckets. Counts of all source and all target features
by bucket give the gain of a bucket; a text's weight is the floored mean of its
features' gains; Gumbel noise from its id makes the largest scores a sample without
replacement in proportion to exp(weight / 1000).

Two scans of the texts: tasks add up counts of buckets (a row for each bucket and task
is shuffled), then weights are written to the shared folder, a few numbers for each row.
Gains are the only thing sent out, one number for each bucket. Ranks need no global
sort: rows are counted by score, of which there are at most RANGE, and only rows of
one score are put in order, by id. Equal rows are counted before they meet.

Defined cases: null text has no features and weight 0; texts with fewer than `least` words
are never drawn and count towards nothing but the source's features; equal ids have
equal noise, and rows that are equal in id, weight and features take following
ranks; a null id is hashed as an empty string and comes first among ties; an empty
table gives no rows; an empty target leaves all gains to the smoothing. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import id_text, materialise

BUCKETS, SHARE, LEAST_WORDS, SEED, MOST_WORDS = 10_000, 10, 20, 2024, 1
#: Bytes of a text column that are looked at together, and of a word that are one piece.
BLOCK, PIECE = 4 << 20, 256
#: Scores lie between the least gain plus the least noise and the largest of both: fewer values than this.
RANGE = 1 << 18


def _byte_table() -> np.ndarray:
    """The lower-case word byte of each byte, 0 for bytes that part words: digits, letters and all beyond ASCII are of words."""
    byte = np.arange(256)
    upper = (byte >= ord("A")) & (byte <= ord("Z"))
    word = ((byte >= ord("0")) & (byte <= ord("9"))) | ((byte >= ord("a")) & (byte <= ord("z"))) | (byte >= 0x80) | upper
    return np.where(word, byte + 32 * upper, 0).astype(np.uint8)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


WORD_BYTE, CRC = _byte_table(), _crc_table()


def _past(n: int) -> np.ndarray:
    """Four tables, one for each byte of a CRC register, that move it past n zero bytes."""
    reg = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(n):
        reg = CRC[reg & 0xFF] ^ (reg >> 8)
    return reg


PAST_PIECE = _past(PIECE)


def _advance(reg: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes data[start : start + length], a byte of each in each step."""
    order = np.argsort(-length, kind="stable")
    reg, at, left = reg[order], start[order], length[order]
    alive = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), side="right")  # runs of that many bytes or more
    for k, n in enumerate(alive):
        reg[:n] = CRC[(reg[:n] ^ data[at[:n] + k]) & 0xFF] ^ (reg[:n] >> 8)
    out = np.empty_like(reg)
    out[order] = reg
    return out


def run_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Registers after each run, from `first` or all ones; the unsigned crc32 is their complement."""
    first = np.full(len(start), 0xFFFFFFFF, np.uint32) if first is None else first
    whole = length // PIECE  # pieces of full length in front of the rest
    long = np.flatnonzero(whole)
    reg = first.copy()
    if len(long):
        n = whole[long]
        owner = np.repeat(np.arange(len(long)), n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        pieces = _advance(np.zeros(len(owner), np.uint32), data, start[long][owner] + nth * PIECE, np.full(len(owner), PIECE))
        base, r = np.cumsum(n) - n, reg[long]
        order = np.argsort(-n, kind="stable")
        for k in range(int(n.max())):
            some = order[: np.searchsorted(-n[order], -k, side="left")]  # words with more than k pieces
            x = r[some]
            r[some] = PAST_PIECE[0][x & 0xFF] ^ PAST_PIECE[1][(x >> 8) & 0xFF] ^ PAST_PIECE[2][(x >> 16) & 0xFF] ^ PAST_PIECE[3][x >> 24] ^ pieces[base[some] + k]
        reg[long] = r
    return _advance(reg, data, start + whole * PIECE, length - whole * PIECE)


def word_spans(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(lower-case bytes, starts, lengths, place of the block) of the words of texts whose edges are offsets into data.

    Blocks end where a text ends or between two words, so that a text of any length takes blocks of bounded size
    (a single word may be longer).
    """
    begin, end = int(edges[0]), int(edges[-1])
    while begin < end:
        stop = min(begin + BLOCK, end)
        while stop < end:  # on to the next edge of a word or a text
            ahead = WORD_BYTE[data[stop : stop + PIECE]] == 0
            text_end = int(edges[np.searchsorted(edges, stop)])
            gap = stop + int(ahead.argmax()) if ahead.any() else stop + PIECE
            stop, found = (text_end, True) if text_end <= gap else (gap, bool(ahead.any()))
            if found:
                break
        stop = min(stop, end)
        lower = WORD_BYTE[data[begin:stop]]
        inside = np.zeros(stop - begin + 1, bool)
        inside[:-1] = lower != 0
        before = np.zeros(stop - begin + 1, bool)
        before[1:] = inside[:-1]
        cuts = edges[(edges > begin) & (edges < stop)] - begin  # a word ends with its text
        starts = inside & ~before
        starts[cuts] |= inside[cuts]
        ends = before & ~inside
        ends[cuts] |= before[cuts]
        s = np.flatnonzero(starts)
        yield lower, s, np.flatnonzero(ends) - s, begin
        begin = stop


def _column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 edges of its texts; null texts are empty in Spark's buffers."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), edges


def features(array: pa.Array, buckets: int = BUCKETS, most: int = MOST_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, buckets) of the features of a text column, block by block."""
    data, edges = _column(array)
    tail: tuple | None = None  # the last words of a block whose text goes on: bytes of each and its row
    for lower, start, length, begin in word_spans(data, edges):
        row = np.searchsorted(edges, start + begin, side="right") - 1
        if most == 1:
            yield row, (~run_crcs(lower, start, length)).astype(np.int64) % buckets
            continue
        if tail is not None and len(row) and tail[1] == row[0]:
            held = [t for t in tail[0]]
            lower = np.concatenate([*held, lower])
            sizes = np.array([len(t) for t in held])
            start = np.concatenate([np.cumsum(sizes) - sizes, start + sizes.sum()])
            length, row, old = np.concatenate([sizes, length]), np.concatenate([np.full(len(held), row[0]), row]), len(held)
        else:
            old = 0
        lower = np.append(lower, np.uint8(32))
        reg, alive = None, np.arange(len(start))
        for k in range(most):  # the runs of k + 1 words go on from those of k words and a space
            if k:
                alive = alive[alive + k < len(start)]
                alive = alive[row[alive + k] == row[alive]]
                space = np.full(len(alive), len(lower) - 1)
                joined = run_crcs(lower, space, np.ones(len(alive), np.int64), reg[alive])
                made = run_crcs(lower, start[alive + k], length[alive + k], joined)
                reg = reg.copy()
                reg[alive] = made
            else:
                reg = run_crcs(lower, start, length)
                made = reg
            new = alive + k >= old  # runs that end among the held words were counted before
            yield row[alive[new]], (~made[new]).astype(np.int64) % buckets
        last = np.flatnonzero(row == row[-1])[-(most - 1) :] if len(row) else []
        tail = ([lower[start[i] : start[i] + length[i]] for i in last], row[-1]) if len(row) else tail


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS, most: int = MOST_WORDS) -> DataFrame:
    """(bucket, n): how many features of all texts fall to each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket in features(batch.column(0), buckets, most):
                total += np.bincount(bucket, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    counted = texts.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text")).mapInArrow(count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed source share) of each bucket."""

    def filled(counts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.float64)
        for bucket, n in counts.collect():  # a row for each bucket at most
            out[bucket] = n
        return out

    s, t = filled(source), filled(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, buckets: int = BUCKETS, most: int = MOST_WORDS) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            n = batch.num_rows
            count, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for row, bucket in features(batch.column(1), buckets, most):
                if len(row):  # rows of a block ascend for runs of one length
                    base = int(row[0])
                    c = np.bincount(row - base)
                    count[base : base + len(c)] += c
                    at = np.flatnonzero(np.r_[True, np.diff(row) > 0])
                    total[row[at]] += np.add.reduceat(gain[bucket], at)
            # k words have k + (k - 1) + ... runs, so words follow from the count of runs of one word
            words = count if most == 1 else _words_of(count, most)
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(words), pa.array(weight)], names=["doc_id", "n_features", "n_words", "weight"])

    return id_text(docs).mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")


def _words_of(count: np.ndarray, most: int) -> np.ndarray:
    """Words of texts by their number of runs of 1 to `most` words."""
    runs = np.cumsum(np.r_[0, np.arange(1, most)])  # of 0 to most - 1 words
    few = np.searchsorted(runs, count)
    return np.where(count < runs[-1] + most, few, (count - most + (most * (most + 1)) // 2) // most)


def gumbel(doc_id, seed: int = SEED):
    """floor(-1000 ln(-ln u)) of a number u between 0 and 1 that the seed and the id decide."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """Adds `rank` to materialised rows (doc_id, n_features, n_words, weight, score): 1, 2, 3 ... for those drawn, else null."""
    spark = scored.sparkSession
    able = scored.where(F.col("n_words") >= least)
    levels = sorted(able.groupBy("score").agg(F.count("*").alias("n")).collect(), reverse=True)  # at most RANGE rows
    draw = share * sum(r.n for r in levels) // 100
    ahead, reached = [], 0
    for r in levels:
        if reached >= draw:
            break
        ahead.append((r.score, reached))
        reached += r.n
    names = ["doc_id", "n_features", "weight", "score"]
    if not ahead:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    taken = F.broadcast(spark.createDataFrame(ahead, "score long, ahead long"))
    least_score = ahead[-1][0]
    drawn = (F.col("n_words") >= least) & (F.col("score") >= least_score)
    alike = scored.where(drawn).groupBy(*names).agg(F.count("*").alias("n"))
    w = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).join(taken, "score")
    each = placed.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("rank", F.col("ahead") + F.col("before") + F.col("nth"))
    inside = each.select(*names, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return inside.unionByName(scored.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS, buckets: int = BUCKETS, most: int = MOST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; `rank` of the floor(share * N / 100) drawn of the N rows
    that have at least `least` words."""
    gain = gains(bucket_counts(docs, "text", buckets, most), bucket_counts(target, "text", buckets, most), buckets)
    scored = weights(docs, gain, buckets, most).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return ranked(materialise(scored, "scores"), share, least)


def drawn_texts(docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The drawn rows of docs, with their rank; rows of equal ids are all taken if one is."""
    first = drawn.where("rank is not null").groupBy(F.col("doc_id").alias("__drawn")).agg(F.min("rank").alias("rank"))
    return docs.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("__drawn"))).drop("__drawn")
