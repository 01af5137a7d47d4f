"""SentencePiece ids and texts of whole documents, giant ones by a max-plus scan over chunks.

The text, as the model sees it (white space as U+2581, one put before it), is a
path of pieces. A chunk boundary may fall inside a piece, so the state at a
boundary is the piece that covers or ends at it; between a non-space and U+2581
no piece of the model crosses, and the state is the single "gap". Each chunk
yields a transfer matrix over the states of its two boundaries: 0 where a valid
path leads from one to the other, -inf where none does. Max-plus products of
these are associative; a tree of products over a document's chunks gives the states on
the best path, and then every chunk is traced back on its own.

For a model of merges (BPE) the weights are these: a sequence of pieces is the
model's segmentation exactly if every piece and every two neighbours encode to
themselves, so path weights are 0 or -inf and one path is left. Runs of U+2581,
whose merges tie in score, are kept whole, with the word that follows.
Between two gaps of a chunk the segmentation does not depend on the states, and
the library's encoder fills it in.

Defined cases: null text is empty and has no ids; a text of one chunk is the scan
of a single 1 x 1 matrix; a text without any gap is traced through in full;
repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_batches, batch_of, id_text, materialise
from textloom.llm.store import CrcJoin

SPACE = "▁"
CHUNK = 8_192
GAP = (-1, 0)
NO_PATH = float("-inf")
_CUT = re.compile(f"(?<!{SPACE}){SPACE}")
_RUN = re.compile(f"({SPACE}{{2,}})")


class Pieces:
    """A SentencePiece merge model: ids, scores and the neighbour test."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        self.text = [self.lib.id_to_piece(i) for i in range(n)]
        normal = [not (self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i)) for i in range(n)]
        self.ids = {self.text[i]: i for i in range(n) if normal[i]}
        self.score = {self.text[i]: self.lib.get_score(i) for i in range(n) if normal[i]}
        self.longest = max(map(len, self.ids))
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if self.lib.is_byte(i)}
        self.bytes = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(i) else p.replace(SPACE, " ").encode() if normal[i] else b"" for i, p in enumerate(self.text)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of this model spans a gap between words")
        self._valid: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by the merges alone: best score first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], NO_PATH), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def weight(self, left: str, right: str) -> float:
        """0 where right may follow left, else -inf; an empty left is a gap."""
        key = (left, right)
        if key not in self._valid:
            if len(self._valid) > 1_000_000:
                self._valid.clear()
            self._valid[key] = self.merge(left + right) == ([left, right] if left else [right])
        return 0.0 if self._valid[key] else NO_PATH

    def edges(self, text: str, at: int) -> list[str]:
        """Pieces that start here (an unknown character is a piece of its own)."""
        found = [text[at : at + n] for n in range(2, min(self.longest, len(text) - at) + 1) if text[at : at + n] in self.ids]
        return [text[at], *found]

    def expand(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.byte[b] for b in piece.encode()] if self.byte else [self.lib.unk_id()]

    def plain(self, text: str) -> list[int]:
        """Ids of a stretch that starts at a gap (with U+2581, which the library puts itself)."""
        return self.lib.encode(text[1:]) if text[1:] else self.expand(SPACE)


def model_text(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def boundaries(text: str, chunk: int) -> list[int]:
    """Chunk ends: every `chunk` characters, moved back to the start of a run of U+2581."""
    out = [0]
    while len(text) - out[-1] > chunk:
        b = out[-1] + chunk
        if text[b] == SPACE or text[b - 1] == SPACE:
            lo = b if text[b] == SPACE else b - 1
            while lo > out[-1] and text[lo - 1] == SPACE:
                lo -= 1
            if lo > out[-1]:
                b = lo
            else:  # a run longer than a chunk stays whole, with what follows
                m = _CUT.search(text, out[-1] + chunk)
                b = m.start() if m else len(text)
                if b >= len(text):
                    break
        out.append(b)
    return [*out, len(text)]


class Chunk:
    """text[lo:hi] with enough text around it to know the states of both boundaries.

    `first` is the position of text[lo] in the document. States are (start, end)
    of a piece in the document, or GAP.
    """

    def __init__(self, model: Pieces, text: str, lo: int, hi: int, first: int):
        self.m, self.text, self.lo, self.hi, self.shift = model, text, lo, hi, first - lo
        self.cuts = self._gaps()
        self.ins, self.outs = self._states(lo), self._states(hi)

    def _gaps(self) -> list[int]:
        """First and last gap in text[lo:hi]: starts of runs of U+2581."""
        first = _CUT.search(self.text, self.lo, self.hi)
        if not first:
            return []
        last = self.text.rfind(SPACE, self.lo, self.hi)
        while last > 0 and self.text[last - 1] == SPACE:
            last -= 1
        return [first.start(), max(last, first.start())]

    def _states(self, b: int) -> list[tuple[int, int]]:
        t, m = self.text, self.m
        if b <= 0 or b >= len(t) or t[b] == SPACE and t[b - 1] != SPACE:
            return [GAP]
        lo = b - 1
        while lo > 0 and b - lo < m.longest and t[lo] != SPACE:
            lo -= 1
        found = [(s, s + len(p)) for s in range(lo, b) for p in m.edges(t, s) if s + len(p) >= b and m.weight("", p) == 0]
        return [(s + self.shift, e + self.shift) for s, e in sorted(set(found))]

    def _piece(self, state: tuple[int, int]) -> str:
        return self.text[state[0] - self.shift : state[1] - self.shift]

    def _forward(self, begins: list[tuple[int, str]], stop: int) -> tuple[dict, dict]:
        """Valid paths from (position, last piece) to pieces that reach `stop`.

        Returns the reaching sets: nodes (start, piece) -> bits of begins, and
        by end position the nodes that end there.
        """
        m, t = self.m, self.text
        reach: dict[tuple[int, str], int] = {}
        ends: dict[int, list[tuple[int, str]]] = {}
        starts: dict[int, list[tuple[str, int]]] = {}
        for i, (at, last) in enumerate(begins):
            starts.setdefault(at, []).append((last, 1 << i))
        for at in range(min(starts, default=stop), stop):
            before = [*starts.get(at, ()), *((p, reach[(s, p)]) for s, p in ends.get(at, ()))]
            if not before:
                continue
            for p in m.edges(t, at):
                bits = 0
                for last, b in before:
                    if b & ~bits and m.weight(last, p) == 0:
                        bits |= b
                if bits:
                    reach[(at, p)] = bits
                    ends.setdefault(at + len(p), []).append((at, p))
        return reach, ends

    def _begins(self) -> list[tuple[int, str]]:
        return [(self.lo, "") if s == GAP else (s[1] - self.shift, self._piece(s)) for s in self.ins]

    def transfer(self) -> np.ndarray:
        """Max-plus matrix from the states of the left boundary to those of the right one."""
        m = np.full((len(self.ins), len(self.outs)), NO_PATH)
        if self.ins == [GAP] and self.outs == [GAP]:
            m[:] = 0
        elif self.cuts:
            left = np.zeros(len(self.ins)) if self.ins == [GAP] else self._to_gap(self._begins(), self.cuts[0])
            right = np.zeros(len(self.outs)) if self.outs == [GAP] else self._from(self._tail_begin(), self.outs)[0]
            m = left[:, None] + right[None, :]
        elif self.outs == [GAP]:
            m[:, 0] = self._to_gap(self._begins(), self.hi)
        else:
            m = self._from(self._begins(), self.outs)
        return m

    def _word_start(self, cut: int) -> int:
        """Start of the last U+2581 of the run at a cut."""
        while cut + 1 < len(self.text) and self.text[cut + 1] == SPACE:
            cut += 1
        return cut

    def _tail_begin(self) -> list[tuple[int, str]]:
        return [(self._word_start(self.cuts[-1]), "")]

    def _to_gap(self, begins, stop: int) -> np.ndarray:
        reach, ends = self._forward(begins, stop)
        bits = 0
        for node in ends.get(stop, ()):
            bits |= reach[node]
        return np.array([0.0 if at == stop or bits >> i & 1 else NO_PATH for i, (at, _) in enumerate(begins)])

    def _from(self, begins, outs) -> np.ndarray:
        reach, _ = self._forward(begins, self.hi)
        m = np.full((len(begins), len(outs)), NO_PATH)
        for j, state in enumerate(outs):
            bits = reach.get((state[0] - self.shift, self._piece(state)), 0)
            m[[i for i in range(len(begins)) if bits >> i & 1], j] = 0
        return m

    def _trace(self, begin: tuple[int, str], stop: int, out: tuple[int, int] | None) -> list[str]:
        """The one valid path from a begin to the gap at stop, or through the out state's piece."""
        if begin[0] == stop and out is None:
            return []
        reach, ends = self._forward([begin], stop)
        node = (out[0] - self.shift, self._piece(out)) if out else None
        path: list[str] = []
        if node is None:
            node = ends[stop][0]
        while True:
            path.append(node[1])
            if node[0] == begin[0]:
                return path[::-1]
            node = next(x for x in ends[node[0]] if x in reach and self.m.weight(x[1], node[1]) == 0)

    def ids(self, state_in: tuple[int, int], state_out: tuple[int, int]) -> list[int]:
        """Ids of the pieces that start in this chunk, on the path through both states."""
        m = self.m
        expand = lambda pieces: [i for p in pieces for i in m.expand(p)]
        begin = (self.lo, "") if state_in == GAP else (state_in[1] - self.shift, self._piece(state_in))
        out = None if state_out == GAP else state_out
        if not self.cuts:
            return expand(self._trace(begin, self.hi, out))
        found = [] if state_in == GAP else expand(self._trace(begin, self.cuts[0], None))
        first = self.lo if state_in == GAP else self.cuts[0]
        if out is None:
            return found + m.plain(self.text[first : self.hi])
        last = self.cuts[-1]
        if last > first:
            found += m.plain(self.text[first:last])
        word = self._word_start(last)
        tail = self._trace((word, ""), self.hi, out)
        run = word - last
        if run:  # a lone U+2581 at the word's start merges with the run before it
            if tail[0] == SPACE:
                run, tail = run + 1, tail[1:]
            found += m.plain(SPACE * run)
        return found + expand(tail)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices: that of both chunks together."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[int]:
    """State numbers at all boundaries on the best path, by a tree of max-plus products.

    Neighbours are composed level by level. From the root down, the states at a node's ends
    settle the one between its halves, so each level's nodes are independent.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([compose(*m[i : i + 2]) if i + 1 < len(m) else m[i] for i in range(0, len(m), 2)])
    root = levels.pop()[0]
    states = [0, int(root[0].argmax())]  # at the ends of the level's nodes
    for m in reversed(levels):
        inner = [int((m[i][states[i // 2]] + m[i + 1][:, states[i // 2 + 1]]).argmax()) if i + 1 < len(m) else None for i in range(0, len(m), 2)]
        states = [s for pair in zip(states, [*inner, None]) for s in pair if s is not None]
    return states


def encode_scanned(model: Pieces, text: str, chunk: int = CHUNK) -> list[list[int]]:
    """Ids of a text, chunk by chunk."""
    t = model_text(text)
    if not t:
        return [[]]
    b = boundaries(t, chunk)
    parts = [Chunk(model, t, lo, hi, lo) for lo, hi in zip(b, b[1:])]
    path = scan([p.transfer() for p in parts])
    return [p.ids(p.ins[i], p.outs[j]) for p, i, j in zip(parts, path, path[1:])]


def decode(model: Pieces, ids: list[int], first: bool = True) -> str:
    """Text of ids; the first chunk of a document drops the space the model put before it."""
    raw = b"".join(map(model.bytes.__getitem__, ids)).decode(errors="replace")
    return raw[1:] if first and raw[:1] == " " else raw


_loaded: dict[str, Pieces] = {}


def pieces_model(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, model_path: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_crc32, n_chunks, decoded_sha256, lossless of every text.

    Texts of one chunk are finished where they are read. Giant texts become chunk
    rows (with the text around their boundaries), dealt over the cluster: one pass
    makes the matrices, which meet by document, and a second traces chunks back.
    """
    spark = docs.sparkSession
    arrow_batches(spark, 256)
    rows = id_text(docs, id_col, text_col)
    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_chunks", pa.int64()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_())])
    ddl = "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, n_chunks long, decoded_sha256 string, lossless boolean"

    def small(batches):
        m = pieces_model(model_path)
        for b in batches:
            out = {f.name: [] for f in result}
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                (ids,) = encode_scanned(m, t, chunk)
                back = decode(m, ids)
                for k, v in (("doc_id", d), ("n_bytes", len(t.encode())), ("n_tokens", len(ids)), ("ids_crc32", zlib.crc32(np.array(ids, "<u4").tobytes())), ("n_chunks", 1), ("decoded_sha256", hashlib.sha256(back.encode()).hexdigest()), ("lossless", back == t)):
                    out[k].append(v)
            yield batch_of(out, result)

    giant = F.length("text") >= chunk
    return rows.where(~giant).mapInArrow(small, ddl).unionByName(_giants(rows.where(giant), model_path, chunk, result, ddl))


def _giants(rows: DataFrame, model_path: str, chunk: int, result: pa.Schema, ddl: str) -> DataFrame:
    row = [("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("k", pa.int32())]
    cut_schema = pa.schema([*row, ("first", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("text", pa.string())])
    row_ddl = "row_id long, doc_id long, n_bytes long, sha256 string, k int"

    def cut(batches):
        from pyspark import TaskContext

        margin, row_id = pieces_model(model_path).longest + 2, TaskContext.get().partitionId() << 36
        for b in batches:
            for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                t, raw = model_text(text), text.encode()
                ends = boundaries(t, chunk)
                sha = hashlib.sha256(raw).hexdigest()
                for at in range(0, len(ends) - 1, 64):
                    spans = [(k, a, z, max(0, a - margin)) for k, (a, z) in enumerate(zip(ends, ends[1:]))][at : at + 64]
                    yield batch_of({"row_id": [row_id] * len(spans), "doc_id": [d] * len(spans), "n_bytes": [len(raw)] * len(spans), "sha256": [sha] * len(spans), "k": [x[0] for x in spans], "first": [x[1] for x in spans], "lo": [a - o for _, a, _, o in spans], "hi": [z - o for _, _, z, o in spans], "text": [t[o : z + margin] for _, _, z, o in spans]}, cut_schema)
                row_id += 1

    parts = materialise(rows.mapInArrow(cut, f"{row_ddl}, first long, lo int, hi int, text string"), "chunks")
    matrix_schema = pa.schema([("row_id", pa.int64()), ("k", pa.int32()), ("n_in", pa.int32()), ("matrix", pa.binary())])

    def each(b):
        m = pieces_model(model_path)
        return [Chunk(m, *x) for x in zip(*(b.column(c).to_pylist() for c in ("text", "lo", "hi", "first")))]

    def transfers(batches):
        for b in batches:
            found = [c.transfer() for c in each(b)]
            yield batch_of({"row_id": b.column("row_id"), "k": b.column("k"), "n_in": [len(x) for x in found], "matrix": [(x == 0).tobytes() for x in found]}, matrix_schema)

    path_schema = pa.schema([("row_id", pa.int64()), ("k", pa.int32()), ("i", pa.int32()), ("j", pa.int32())])

    def paths(batches):
        for b in batches:
            for row_id, steps in zip(b.column("row_id").to_pylist(), b.column("steps").to_pylist()):
                p = scan([np.where(np.frombuffer(s["matrix"], bool).reshape(s["n_in"], -1), 0.0, NO_PATH) for s in steps])
                yield batch_of({"row_id": [row_id] * len(steps), "k": [s["k"] for s in steps], "i": p[:-1], "j": p[1:]}, path_schema)

    by_row = lambda df, *c: df.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("k", *c))).alias("steps"))
    path = by_row(parts.mapInArrow(transfers, "row_id long, k int, n_in int, matrix binary"), "n_in", "matrix").mapInArrow(paths, "row_id long, k int, i int, j int")
    traced_schema = pa.schema([*row, ("n_ids", pa.int64()), ("crc", pa.int64()), ("part", pa.string())])

    def trace(batches):
        m = pieces_model(model_path)
        for b in batches:
            found = [c.ids(c.ins[i], c.outs[j]) for c, i, j in zip(each(b), b.column("i").to_pylist(), b.column("j").to_pylist())]
            yield batch_of({f.name: b.column(f.name) for f in list(traced_schema)[:5]} | {"n_ids": [len(x) for x in found], "crc": [zlib.crc32(np.array(x, "<u4").tobytes()) for x in found], "part": [decode(m, x, k == 0) for x, k in zip(found, b.column("k").to_pylist())]}, traced_schema)

    traced = parts.join(path, ["row_id", "k"]).select(*parts.columns, "i", "j").mapInArrow(trace, f"{row_ddl}, n_ids long, crc long, part string")

    def joined(batches):
        join = CrcJoin()
        for b in batches:
            out = {f.name: [] for f in result}
            for steps in b.column("steps").to_pylist():
                crc, back = 0, "".join(s["part"] for s in steps)
                for s in steps:
                    crc = join(crc, s["crc"], 4 * s["n_ids"])
                sha = hashlib.sha256(back.encode()).hexdigest()
                for k, v in (("doc_id", steps[0]["doc_id"]), ("n_bytes", steps[0]["n_bytes"]), ("n_tokens", sum(s["n_ids"] for s in steps)), ("ids_crc32", crc), ("n_chunks", len(steps)), ("decoded_sha256", sha), ("lossless", sha == steps[0]["sha256"])):
                    out[k].append(v)
            yield batch_of(out, result)

    return by_row(traced, "doc_id", "n_bytes", "sha256", "n_ids", "crc", "part").mapInArrow(joined, ddl)
