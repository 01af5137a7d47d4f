"""Hash-compared suffix sort, and removal of byte strings that repeat anywhere in a table.

A byte is removed where a string of `length` bytes that covers it starts a second
time in the table, in any document or the same one. Steps, each an exchange by hash:

1. Texts are gathered into parts, and parts into groups that deal hashes together. In every window of `length` bytes the smallest
   keyed hash of its grams is the window's anchor; equal windows have equal anchors
   at equal places, so only windows of anchors whose gram repeats can repeat. An
   anchor's context is all bytes of the windows that it anchors.
2. Bucket tasks count grams and contexts. A context that occurs twice repeats with
   all its windows. A gram with several contexts is undecided.
3. Undecided contexts are cut into short runs of windows. The bytes that all windows
   of a run share (its core) must repeat for any of them to repeat, and a run whose
   bytes occur twice repeats as a whole. What is left lies at the ends of repeats.
4. There, tasks sort the windows that are left as suffixes: prefix polynomial
   hashes and binary search give the common extension of two suffixes, a merge
   sort compares by the byte after it, and neighbours that agree on `length` bytes,
   checked byte by byte, are one class. A class leaves its task once, with its count
   and a digest of its bytes; a last exchange merges the classes of all tasks.

So a string that a third of all documents hold is counted in every task first, and
no step collects the places of one string in one task. Hashes only choose what is
compared: a window counts as repeated if a 128-bit digest of its bytes (or of a run
or context that holds it) occurs twice.

Defined cases: null text is empty; texts shorter than `length` bytes keep all; equal
rows repeat one another; an empty table gives no row; null ids keep their rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import MASK64, arrow_batches, batch_of, bucket_keys, id_text, materialise, partitions_for, splitmix

LENGTH = 200
GRAM = 64
#: Windows of a run of step 3.
RUN = 16
#: Bytes of text in a part, and of a longer document in one go.
PART_BYTES = 1 << 18
GO_BYTES = 1 << 20
#: Bytes of text in a group of parts, which deals its hashes in one go: at least so many, and
#: so many for each bucket, so that the rows of an exchange do not grow with parts x buckets.
GROUP_BYTES = 1 << 21
GROUP_BYTES_PER_BUCKET = 12_000
#: The most buckets: a group of so many holds 240 MB of text.
BUCKETS = 20_000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    held = _POWERS.get(0)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[0] = held = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return held[0][:n], held[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * BASE^place over data[i:j]."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    out[1:] = data
    out[1:] += np.uint64(1)
    out[1:] *= up
    np.cumsum(out, out=out)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hashes of data[start:stop], whatever their place."""
    _, down = powers(len(prefix))
    return (prefix[stop] - prefix[start]) * down[start]


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by block minima from both sides."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, MASK64, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


class Anchors:
    """Anchors of the texts of a part, in order: gram hash, first and last window start."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, prefix: np.ndarray | None = None):
        self.data, self.length, self.gram = data, length, gram
        self.prefix = prefix_hashes(data) if prefix is None else prefix
        n = len(data)
        empty = np.zeros(0, np.int64)
        self.at = self.lo = self.hi = empty
        if n < length:
            return
        grams = self.prefix[gram:] - self.prefix[: n - gram + 1]
        grams *= powers(n + 1)[1][: n - gram + 1]
        grams = splitmix(grams)
        bits = np.uint64(max(1, n.bit_length()))
        keys = grams >> bits
        keys <<= bits
        keys |= np.arange(n - gram + 1, dtype=np.uint64)
        best = window_minima(keys, length - gram + 1)
        best &= np.uint64((1 << int(bits)) - 1)
        best = best.view(np.int64)
        del keys
        first = np.concatenate([[0], ends[:-1]])
        sizes = ends - first
        good = np.zeros(n + 1, np.int32)  # windows inside one text
        ok = sizes >= length
        np.add.at(good, first[ok], 1)
        np.add.at(good, ends[ok] - length + 1, -1)
        inside = np.cumsum(good[: n - length + 1]) > 0
        p = np.flatnonzero(inside)
        if not len(p):
            return
        b = best[p]
        new = np.concatenate([[True], (b[1:] != b[:-1]) | (p[1:] != p[:-1] + 1)])
        s = np.flatnonzero(new)
        self.at, self.lo, self.hi = b[s], p[s], p[np.append(s[1:], len(p)) - 1]
        self.grams = grams[self.at]

    def contexts(self) -> np.ndarray:
        """Hashes of the anchors' contexts and of the places of their windows in them."""
        h = span_hash(self.prefix, self.lo, self.hi + self.length)
        return splitmix(h ^ splitmix(((self.at - self.lo).astype(np.uint64) << np.uint64(20)) | (self.hi - self.lo).astype(np.uint64)))


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix (at most `most`) of suffixes a and b, by binary search on hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = span_hash(prefix, a, a + mid) == span_hash(prefix, b, b + mid)
        low = np.where(same, mid, low)
        high = np.where(same, high, mid - 1)
    return low


def _before(data, prefix, a, b, most) -> np.ndarray:
    """Whether suffix a sorts before b, or equals it in `most` bytes."""
    n = common_extension(prefix, a, b, most)
    end = np.minimum(n, most - 1)
    return (n >= most) | (data[a + end] < data[b + end])


def suffix_sort(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Sorts starts by the `most` bytes from there (all must be inside data).

    Suffixes that share eight bytes are one group; a bottom-up merge sort orders
    the groups, all merges of a level at once: the place of an element in its
    sibling run is a binary search by hash-compared suffixes.
    """
    head = np.zeros(len(starts), np.uint64)
    for k in range(8):
        head = head << np.uint64(8) | data[starts + k].astype(np.uint64)
    order = np.argsort(head, kind="stable")
    s, head = starts[order], head[order]
    group = np.cumsum(np.concatenate([[0], (head[1:] != head[:-1]).astype(np.int64)])) if len(s) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(s) else group
    size = np.diff(np.append(first, len(s)))
    many = np.flatnonzero(size[group] > 1)
    at, lo, n = np.arange(len(s)) - first[group], first[group], size[group]
    width, most_size = 1, int(size.max()) if len(s) else 0
    while width < most_size:
        i = many
        run = at[i] // width
        sib = run ^ 1
        low = lo[i] + np.minimum(sib * width, n[i])
        high = lo[i] + np.minimum((sib + 1) * width, n[i])
        base = low.copy()
        left = run % 2 == 0
        while True:
            open_ = low < high
            if not open_.any():
                break
            mid = np.where(open_, (low + high) // 2, 0)
            k = np.flatnonzero(open_)
            x, y = s[i[k]], s[mid[k]]
            # a left element goes before equals of its sibling run, a right one after them
            go = np.where(left[k], ~_before(data, prefix, x, y, most), _before(data, prefix, y, x, most))
            low[k] = np.where(go, mid[k] + 1, low[k])
            high[k] = np.where(go, high[k], mid[k])
        place = lo[i] + (run // 2) * 2 * width + at[i] % width + (low - base)
        merged = s.copy()
        merged[place] = s[i]
        s = merged
        width *= 2
    return s


def repeated_classes(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts and their class numbers: neighbours that agree on `length` bytes, verified."""
    s = suffix_sort(data, prefix, starts, length)
    if not len(s):
        return s, s
    same = common_extension(prefix, s[1:], s[:-1], length) >= length
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    k = np.flatnonzero(same)
    for lo in range(0, len(k), 50_000):
        own = k[lo : lo + 50_000]
        same[own] = (windows[s[own + 1]] == windows[s[own]]).all(axis=1)
    return s, np.cumsum(np.concatenate([[0], ~same]))


_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("size", "<i8")])
_PLACE = np.dtype([("part", "<u4"), ("at", "<u4"), ("ahead", "u1"), ("last", "u1")])  # anchor, anchor - first start, anchor - last start
_RUNS = np.dtype([("part", "<u4"), ("ctx", "<u4"), ("block", "u1")])
_START = np.dtype([("part", "<u4"), ("at", "<u4")])
_CTX = np.dtype([("lo", "<u4"), ("ahead", "u1"), ("last", "u1")])
_FLOW = pa.schema([("deal", pa.int64()), ("kind", pa.string()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_FLOW_DDL = "deal long, kind string, part long, a binary, b binary, c binary"


def _flow(rows: list[tuple]):
    for lo in range(0, len(rows), 400):
        yield batch_of({f.name: [r[i] for r in rows[lo : lo + 400]] for i, f in enumerate(_FLOW)}, _FLOW)


def _zip(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data, 3)


def _unzip(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(blob), np.uint8)


def _gather(part_bytes: int, group_bytes: int):
    """Documents to parts: one row with the ids and sizes, the compressed text bytes, and
    the other columns of these rows (Arrow IPC). Parts in a row are a group."""

    def run(batches):
        from pyspark import TaskContext

        group, part, held = TaskContext.get().partitionId() << 32, 0, 0
        docs, texts, size, pieces = [], [], 0, []

        def row():
            m = np.array([(0 if d is None else d, d is not None, len(t)) for d, t in zip(docs, texts)], _DOC)
            rest = b""
            if pieces and pieces[0].num_columns:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pieces[0].schema) as w:
                    for x in pieces:
                        w.write_batch(x)
                rest = _zip(sink.getvalue().to_pybytes())
            return group, "text", part, _zip(b"".join(texts)), m.tobytes(), rest

        for b in batches:
            others = b.select([n for n in b.schema.names if n not in ("__loom_id", "__loom_text")])
            from_row = 0
            for i, (d, t) in enumerate(zip(b.column("__loom_id").to_pylist(), b.column("__loom_text").to_pylist())):
                raw = t.encode()
                if texts and size + len(raw) > part_bytes:
                    if i > from_row:
                        pieces.append(others.slice(from_row, i - from_row))
                    yield from _flow([row()])
                    part, held = part + 1, held + size
                    if held >= group_bytes:
                        group, part, held = group + 1, 0, 0
                    docs, texts, size, pieces, from_row = [], [], 0, [], i
                docs.append(d)
                texts.append(raw)
                size += len(raw)
            if b.num_rows > from_row:
                pieces.append(others.slice(from_row, b.num_rows - from_row))
        if texts:
            yield from _flow([row()])

    return run


def _dealt(keys: np.ndarray, buckets: int):
    """Order of keys, and (bucket, slice) of the ordered keys."""
    order = np.argsort(keys, kind="stable")
    edges = np.searchsorted(keys[order], np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64))
    return order, [(k, slice(lo, hi)) for k, (lo, hi) in enumerate(zip([0, *edges], [*edges, len(keys)])) if hi > lo]


def _content_hashes(view: memoryview, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(view[i:j]) for i, j in zip(starts.tolist(), stops.tolist())), np.uint64, len(starts))


class _Dealer:
    """Gathers (key, content, item) arrays of a group and deals them to buckets in one go."""

    def __init__(self, keys: np.ndarray, kind: str):
        self.keys, self.kind, self.held = keys, kind, []

    def add(self, key: np.ndarray, content: np.ndarray, item: np.ndarray) -> None:
        if len(key):
            self.held.append((key, content, item))

    def rows(self, group: int) -> list[tuple]:
        if not self.held:
            return []
        key, content, item = (np.concatenate(x) for x in zip(*self.held))
        self.held = []
        order, cuts = _dealt(key, len(self.keys))
        key, content, item = key[order], content[order], item[order]
        return [(int(self.keys[k]), self.kind, group, key[s].tobytes(), content[s].tobytes(), item[s].tobytes()) for k, s in cuts]


def _posts(keys: np.ndarray, length: int, gram: int, go: int):
    """Anchors of every part, dealt by gram hash: hashes, content hashes and places."""

    def anchors(part, blob, docs, dealer):
        data = _unzip(blob)
        view, ends = memoryview(data), np.cumsum(np.frombuffer(docs, _DOC)["size"])
        for base in range(0, max(1, len(data)), go):
            # windows that start in [base, base + go): a text longer than that is anchored in steps
            stop = min(len(data), base + go + length - 1)
            a = Anchors(data[base:stop], np.unique(np.minimum(np.append(ends[(ends > base) & (ends < stop)], stop), stop)) - base, length, gram)
            if not len(a.at):
                continue
            at, lo, hi = a.at + base, a.lo + base, a.hi + base
            place = np.zeros(len(at), _PLACE)
            place["part"], place["at"], place["ahead"], place["last"] = part, at, at - lo, at - hi
            content = splitmix(_content_hashes(view, lo, hi + length) ^ splitmix((at - lo).astype(np.uint64) << np.uint64(20) | (hi - lo).astype(np.uint64)))
            dealer.add(splitmix(a.grams), content, place)  # anchors are minima: mixed again, they spread over all buckets

    def run(batches):
        group, dealer = None, _Dealer(keys, "post")
        for b in batches:
            for g, part, blob, docs in zip(*(b.column(c).to_pylist() for c in ("deal", "part", "a", "b"))):
                if g != group:
                    yield from _flow(dealer.rows(group))
                group = g
                anchors(part, blob, docs, dealer)
        yield from _flow(dealer.rows(group))

    return run


def _compare(kinds: tuple[str, str], item: np.dtype):
    """Bucket tasks: items whose key repeats. Equal contents repeat in full (first kind);
    the first item of each content of a key with several is undecided (second kind)."""

    def bucket(posts):
        posts.sort(key=lambda x: x[0])
        sizes = [len(a) // 8 for _, a, _, _ in posts]
        key, content = (np.concatenate([np.frombuffer(p[k], "<u8") for p in posts]) for k in (1, 2))
        order = np.lexsort((content, key))
        k, c = key[order], content[order]
        new_k = np.concatenate([[True], k[1:] != k[:-1]])
        new_c = new_k | np.concatenate([[True], c[1:] != c[:-1]])
        k_no, c_no = np.cumsum(new_k) - 1, np.cumsum(new_c) - 1
        full = np.empty(len(k), bool)
        full[order] = (np.bincount(c_no) > 1)[c_no]
        several = np.bincount(k_no[new_c]) > 1
        mixed = np.zeros(len(k), bool)
        mixed[order] = new_c & several[k_no]
        at = 0
        for (part, _, _, items), n in zip(posts, sizes):  # back to the group it came from
            own = np.frombuffer(items, item)
            for kind, which in zip(kinds, (full, mixed)):
                chosen = own[which[at : at + n]]
                if len(chosen):
                    yield part, kind, -1, chosen.tobytes(), b"", b""
            at += n

    def run(batches):
        by_bucket: dict[int, list] = {}
        for b in batches:
            for deal, part, a, x, c in zip(*(b.column(n).to_pylist() for n in ("deal", "part", "a", "b", "c"))):
                by_bucket.setdefault(deal, []).append((part, a, x, c))
        for k in sorted(by_bucket):
            yield from _flow(list(bucket(by_bucket.pop(k))))

    return run


def _by_group(make):
    """Streams rows sorted by (group, part, kind): results of buckets first, as arrays, then
    the group's own rows, one at a time."""

    def run(batches):
        group, state = None, None
        for b in batches:
            for g, kind, part, a, x, c in zip(*(b.column(n).to_pylist() for n in ("deal", "kind", "part", "a", "b", "c"))):
                if state is None or g != group:
                    if state is not None:
                        yield from state.end()
                    group, state = g, make(g)
                if part < 0:
                    state.found.setdefault(kind, []).append(a)
                else:
                    yield from state.item(kind, part, a, x, c)
        if state is not None:
            yield from state.end()

    return run


class _Group:
    """What the buckets sent back to a group, by part."""

    dtype = _PLACE

    def __init__(self, group: int):
        self.group, self.found, self.sorted = group, {}, {}

    def of(self, kind: str, part: int) -> np.ndarray:
        if kind not in self.sorted:
            every = np.concatenate([np.frombuffer(a, self.dtype) for a in self.found.pop(kind, [])] or [np.zeros(0, self.dtype)])
            self.sorted[kind] = every[np.argsort(every["part"], kind="stable")]
        s = self.sorted[kind]
        return s[slice(*np.searchsorted(s["part"], (part, part + 1)))]

    def end(self):
        return iter(())


def _spans(group: int, part: int, starts: np.ndarray, stops: np.ndarray) -> tuple:
    """A row of the union of spans."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order].astype(np.int64), np.maximum.accumulate(stops[order].astype(np.int64))
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return group, "span", part, s[new].astype("<u4").tobytes(), e[last].astype("<u4").tobytes(), b""


def _runs(keys: np.ndarray, length: int, run: int):
    """Group tasks: spans of contexts that repeat, and the undecided ones with their runs of windows."""

    class Runs(_Group):
        def __init__(self, group):
            super().__init__(group)
            self.dealer = _Dealer(keys, "run")

        def item(self, kind, part, blob, docs, rest):
            full, mixed = self.of("full", part), np.sort(self.of("mixed", part), order="at")
            out = []
            if len(full):
                at = full["at"].astype(np.int64)
                out.append(_spans(self.group, part, at - full["ahead"], at - full["last"] + length))
            if len(mixed):
                out.append(self.contexts(part, _unzip(blob), mixed))
            yield from _flow(out)

        def contexts(self, part, data, mixed):
            at = mixed["at"].astype(np.int64)
            lo, hi = at - mixed["ahead"], at - mixed["last"] + length
            sizes = hi - lo
            flat = data[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - lo, sizes)]
            ctx = np.zeros(len(mixed), _CTX)
            ctx["lo"], ctx["ahead"], ctx["last"] = lo, mixed["ahead"], mixed["last"]
            first, last = mixed["last"] // run, mixed["ahead"] // run  # blocks of windows by distance from the anchor
            n = (last - first + 1).astype(np.int64)
            no = np.repeat(np.arange(len(mixed)), n)
            block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            near, far = np.maximum(block * run, mixed["last"][no]), np.minimum(block * run + run - 1, mixed["ahead"][no])
            core = splitmix(span_hash(prefix_hashes(data), at[no] - block * run, at[no] - block * run - run + 1 + length) + block.astype(np.uint64))
            content = splitmix(_content_hashes(memoryview(data), at[no] - far, at[no] - near + length) ^ splitmix((near << 8 | far).astype(np.uint64)))
            item = np.zeros(len(no), _RUNS)
            item["part"], item["ctx"], item["block"] = part, no, block
            self.dealer.add(core, content, item)
            return self.group, "ctx", part, _zip(flat.tobytes()), ctx.tobytes(), b""

        def end(self):
            return _flow(self.dealer.rows(self.group))

    return _by_group(Runs)


def _windows(keys: np.ndarray, length: int, run: int):
    """Group tasks: windows of undecided runs, sorted as suffixes; classes that repeat in a part
    are spans, and one window of every class goes to the other tasks' classes."""

    class Windows(_Group):
        dtype = _RUNS

        def __init__(self, group):
            super().__init__(group)
            self.dealer = _Dealer(keys, "window")

        def item(self, kind, part, blob, ctx, rest):
            ctx = np.frombuffer(ctx, _CTX)
            size = ctx["ahead"].astype(np.int64) - ctx["last"] + length
            base = np.cumsum(size) - size  # where a context starts in the stored bytes

            def starts(kind):
                item = self.of(kind, part)
                c = item["ctx"].astype(np.int64)
                ahead, last = ctx["ahead"][c].astype(np.int64), ctx["last"][c].astype(np.int64)
                block = item["block"].astype(np.int64)
                near, far = np.maximum(block * run, last), np.minimum(block * run + run - 1, ahead)
                return c, ahead - far, ahead - near  # first and last window start inside the context

            out = []
            c, first, last = starts("fullrun")
            if len(c):
                out.append(_spans(self.group, part, ctx["lo"][c] + first, ctx["lo"][c] + last + length))
            c, first, last = starts("openrun")
            if len(c):
                n = last - first + 1
                own = np.repeat(c, n)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                data = _unzip(blob)
                prefix = prefix_hashes(data)
                s, label = repeated_classes(data, prefix, np.unique(base[own] + inner), length)
                holder = np.searchsorted(base, s, side="right") - 1
                real = ctx["lo"][holder].astype(np.int64) + s - base[holder]
                again = np.bincount(label)[label] > 1
                if again.any():
                    out.append(_spans(self.group, part, real[again], real[again] + length))
                rep = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
                item = np.zeros(len(rep), _START)
                item["part"], item["at"] = part, real[rep]
                self.dealer.add(splitmix(span_hash(prefix, s[rep], s[rep] + length)), _content_hashes(memoryview(data), s[rep], s[rep] + length), item)
            yield from _flow(out)

        def end(self):
            return _flow(self.dealer.rows(self.group))

    return _by_group(Windows)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64()))])
_OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, starts array<long>, stops array<long>"


class _Final(_Group):
    """Keeps a part's spans until its texts come, and then marks what goes."""

    dtype = _START
    length = LENGTH

    def __init__(self, group):
        super().__init__(group)
        self.spans = []

    def item(self, kind, part, a, b, c):
        if kind == "span":
            self.spans.append((np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")))
            return
        yield self.finish(list(self.covered(part, _unzip(a), np.frombuffer(b, _DOC))), c)
        self.spans = []

    def covered(self, part, data, docs):
        """Texts of a part in order: (id, bytes, removed flags)."""
        cover = np.zeros(len(data) + 1, np.int32)
        again = self.of("again", part)["at"].astype(np.int64)
        for starts, stops in [*self.spans, (again, again + self.length)]:
            np.add.at(cover, starts, 1)
            np.add.at(cover, stops, -1)
        gone = np.cumsum(cover[:-1]) > 0
        for d, end in zip(docs, np.cumsum(docs["size"]).tolist()):
            own = slice(end - int(d["size"]), end)
            yield int(d["doc_id"]) if d["has_id"] else None, data[own], gone[own]


def _spans_of(window: int):
    """Group tasks: what is removed of every document."""

    class Spans(_Final):
        length = window

        def finish(self, texts, rest):
            out = {f.name: [] for f in _OUT}
            for doc_id, data, gone in texts:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
                kept = data[~gone].tobytes()
                for k, v in (("doc_id", doc_id), ("n_bytes", len(data)), ("n_removed", len(data) - len(kept)), ("n_spans", len(edge) // 2), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept), ("starts", edge[::2]), ("stops", edge[1::2])):
                    out[k].append(v)
            return batch_of(out, _OUT)

    return _by_group(Spans)


def _rewritten(window: int, names: list[str], text_col: str):
    """Group tasks: the rows themselves, their text without what is removed."""

    class Rows(_Final):
        length = window

        def finish(self, texts, rest):
            kept = pa.array([data[~gone].tobytes().decode(errors="ignore") for _, data, gone in texts], pa.string())
            others = pa.ipc.open_stream(_unzip(rest).tobytes()).read_all().combine_chunks() if rest else None
            return pa.RecordBatch.from_arrays([kept if n == text_col else others.column(n).chunk(0) for n in names], names=names)

    return _by_group(Rows)


def _check(length: int, gram: int, run: int) -> None:
    if not (run < length - gram and length - gram < 256 and gram >= 8):
        raise ValueError("needs run < length - gram < 256 and grams of 8 bytes or more")


def _buckets(docs: DataFrame) -> int:
    return min(BUCKETS, partitions_for(docs))


def _group_bytes(buckets: int) -> int:
    return max(GROUP_BYTES, GROUP_BYTES_PER_BUCKET * buckets)


def _found(texts: DataFrame, n: int, length: int, gram: int, run: int) -> DataFrame:
    """Rows of groups with their texts and the spans to remove, in the order of _by_group; n: buckets."""
    keys = bucket_keys(texts.sparkSession, n)
    arrow_batches(texts.sparkSession, 32)  # rows are parts and blobs from here on
    by_deal = lambda df, f: df.repartition(n, "deal").mapInArrow(f, _FLOW_DDL)
    by_group = lambda df: df.repartition(n, "deal").sortWithinPartitions("deal", "part", "kind")
    places = by_deal(texts.withColumn("c", F.lit(b"")).mapInArrow(_posts(keys, length, gram, GO_BYTES), _FLOW_DDL), _compare(("full", "mixed"), _PLACE))
    runs = materialise(by_group(texts.withColumn("c", F.lit(b"")).unionByName(places)).mapInArrow(_runs(keys, length, run), _FLOW_DDL), "runs")
    open_runs = by_deal(runs.where("kind = 'run'"), _compare(("fullrun", "openrun"), _RUNS))
    windows = materialise(by_group(runs.where("kind = 'ctx'").unionByName(open_runs)).mapInArrow(_windows(keys, length, run), _FLOW_DDL), "windows")
    again = by_deal(windows.where("kind = 'window'"), _compare(("again", "same"), _START)).where("kind = 'again'")
    spans = runs.where("kind = 'span'").unionByName(windows.where("kind = 'span'")).unionByName(again)
    return by_group(texts.unionByName(spans))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, run: int = RUN, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), starts and stops of the removed spans."""
    _check(length, gram, run)
    arrow_batches(docs.sparkSession, 256)
    rows = id_text(docs, id_col, text_col).toDF("__loom_id", "__loom_text")
    n = _buckets(docs)
    texts = materialise(rows.mapInArrow(_gather(part_bytes, _group_bytes(n)), _FLOW_DDL), "texts")
    return _found(texts, n, length, gram, run).mapInArrow(_spans_of(length), _OUT_DDL)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, run: int = RUN, part_bytes: int = PART_BYTES, text_col: str = "text") -> DataFrame:
    """The documents with their other columns, the repeated strings cut out of the text.

    A cut inside a character drops that character's other bytes; null text becomes empty.
    """
    _check(length, gram, run)
    arrow_batches(docs.sparkSession, 256)
    rows = docs.select(F.lit(None).cast("long").alias("__loom_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__loom_text"), *[c for c in docs.columns if c != text_col])
    n = _buckets(docs)
    texts = materialise(rows.mapInArrow(_gather(part_bytes, _group_bytes(n)), _FLOW_DDL), "texts")
    schema = docs.select(*[F.col(c).cast("string").alias(c) if c == text_col else c for c in docs.columns]).schema
    return _found(texts, n, length, gram, run).mapInArrow(_rewritten(length, docs.columns, text_col), schema)
