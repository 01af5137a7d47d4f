"""Token ids of a byte-level BPE file, as the tokenizers library gives them.

`ByteBpe` reads one tokenizers .json file. Merges never leave a pre-token, so a text's
ids are those of its pre-tokens, one after the other. Every pre-token is encoded by the
library; its ids are kept in a table of bounded size, and pre-tokens met again are looked
up there for whole blocks of texts at once. An entry holds the pre-token's bytes (up to
16; longer ones are in a dictionary), so a lookup is exact.

Texts are split where all their characters lie in blocks with settled Unicode classes
and none of the file's special strings occurs; all other texts, and files with other
pre-tokenizers, go through the library whole. Tests compare both.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

#: Blocks with settled Unicode classes: ASCII, Latin, Cyrillic letters, kana, common ideographs.
_SETTLED = [(0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0xAC), (0xAE, 0x24F), (0x400, 0x481), (0x48A, 0x4FF), (0x2013, 0x201D), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5)]
#: Bytes of text that are split in one go; entries of the table (a power of two) and ids it may point to.
GO, SLOTS, POOL = 1 << 19, 1 << 21, 1 << 23
#: Pre-tokens of more bytes are not kept.
LONGEST = 256
_END, _SPACE, _LETTER, _NUMBER, _OTHER = range(5)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Between two such bytes a pre-token ends, whatever stands around them.
_CUT = re.compile(rb"[A-Za-z][\t\n\r -@\[-`{-~]")


def _settled(kinds: str) -> list[str]:
    return [chr(c) for lo, hi in _SETTLED for c in range(lo, hi + 1) if unicodedata.category(chr(c))[0] in kinds]


def _outside() -> re.Pattern:
    """Characters outside the settled blocks."""
    return re.compile("[^" + "".join(rf"\u{lo:04x}-\u{hi:04x}" for lo, hi in _SETTLED) + "]")


def _byte_classes() -> tuple[np.ndarray, re.Pattern, re.Pattern]:
    """Class of each byte (from 128 on: letter), and byte patterns of other numbers and signs."""
    table = np.full(256, _LETTER, np.uint8)
    for c in range(128):
        kind = unicodedata.category(chr(c))[0]
        table[c] = _SPACE if chr(c) in "\t\n\r " else _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    table[0] = _END
    several = lambda kinds: re.compile(b"|".join(re.escape(c.encode()) for c in _settled(kinds) if c > "\x7f"))
    return table, several("N"), several("PSMZC")


class Split:
    """Starts of the pre-tokens of texts that stand in one buffer, each ended by a zero byte.

    Fixed rules of this family of files: a contraction ('s 'd 'm 't 'll 've 're) where a
    pre-token would begin, else a run of letters, numbers or other signs with one space before
    it, else white space, whose last character is left to what follows.
    """

    def __init__(self):
        self.table, self.numbers, self.signs = _byte_classes()

    def classes(self, raw: bytes, data: np.ndarray) -> np.ndarray:
        c = self.table[data]
        if not raw.isascii():
            for pattern, kind in ((self.numbers, _NUMBER), (self.signs, _OTHER)):
                for m in pattern.finditer(raw):
                    c[m.start() : m.end()] = kind
        return c

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(starts, whether a start is that of an end mark)."""
        data = np.frombuffer(raw, np.uint8)
        c = self.classes(raw, data)
        new = np.empty(len(c), bool)
        new[0] = True
        np.not_equal(c[1:], c[:-1], out=new[1:])
        new |= c == _END
        space = c == _SPACE
        solid = ~space & (c != _END)
        start = new.copy()
        start[1:] &= ~((data[:-1] == 32) & solid[1:])  # one space goes with what follows
        start[:-1] |= space[:-1] & solid[1:]  # and is left by the white space before it
        quote = np.flatnonzero(data[:-1] == 39)
        quote = quote[start[quote]]
        a, b = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
        one = np.isin(a, np.frombuffer(b"sdmt", np.uint8))
        two = ((a == 108) & (b == 108)) | (((a == 118) | (a == 114)) & (b == 101))
        for held, n in ((one, 2), (two, 3)):
            at = quote[held]
            start[at + 1] = False
            start[at + n] = True
        starts = np.flatnonzero(start)
        return starts, c[starts] == _END


class ByteBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.splits = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.split, self.odd = Split(), _outside()
        self.feed = self._library(["\n"])[0][0]
        self.keys = np.zeros((3, SLOTS), np.uint64)  # first eight bytes, the next eight, number of bytes
        self._forget()

    def _forget(self) -> None:
        self.keys[2] = 0
        self.at, self.n = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.pool, self.used = np.zeros(POOL, np.uint32), 0

    def _plain(self, text: str) -> bool:
        return self.splits and not self.odd.search(text) and not any(x in text for x in self.special)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, ids: np.ndarray) -> int:
        at, self.used = self.used, self.used + len(ids)
        while self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[at : self.used] = ids
        return at

    def _words(self, words: list[bytes]) -> dict[bytes, tuple[int, int]]:
        """(place, number) in the pool of the ids of distinct pre-tokens.

        Words are encoded in one text with line feeds between: these part pre-tokens, and are one id.
        """
        lone = [w for w in words if not w.isspace()]
        made = {}
        if lone:
            ids = self._library([b"\n".join(lone).decode()])[0]
            first = self._keep(ids)
            cuts = np.concatenate([[-1], np.flatnonzero(ids == self.feed), [len(ids)]])
            made = dict(zip(lone, zip((first + cuts[:-1] + 1).tolist(), (np.diff(cuts) - 1).tolist())))
        for w in words:
            if w.isspace():
                ids = self._library([w.decode()])[0]
                made[w] = self._keep(ids), len(ids)
        return made

    def _block(self, raw: bytes) -> list[np.ndarray]:
        """Ids of each of the texts in a buffer, each ended by a zero byte."""
        if self.used > POOL // 2:
            self._forget()
        starts, ends = self.split(raw)
        sizes = np.diff(np.append(starts, len(raw)))
        eight = np.ndarray((len(raw),), "<u8", buffer=raw + bytes(16), strides=(1,))
        bits = lambda n: ~np.uint64(0) >> ((np.uint64(8) - np.clip(n, 1, 8).astype(np.uint64)) << np.uint64(3))
        one = eight[starts] & bits(sizes)
        two = np.zeros(len(starts), np.uint64)
        more = np.flatnonzero((sizes > 8) & (sizes <= 16))
        two[more] = eight[starts[more] + 8] & bits(sizes[more] - 8)
        long = sizes.astype(np.uint64)
        mixed = one * _MIX[0] ^ two * _MIX[1] ^ long * _MIX[2]
        slot = ((mixed ^ mixed >> np.uint64(29)) * _MIX[0] >> np.uint64(64 - (SLOTS - 1).bit_length())).view(np.int64)
        hit = (self.keys[0][slot] == one) & (self.keys[1][slot] == two) & (self.keys[2][slot] == long) & (sizes <= 16)
        at, n = self.at[slot], self.n[slot]
        hit |= ends
        n[ends] = 0
        lost = np.flatnonzero(~hit)
        if len(lost):
            words = [raw[a:b] for a, b in zip(starts[lost].tolist(), (starts[lost] + sizes[lost]).tolist())]
            found = {w: self.long.get(w) for w in words}
            new = self._words([w for w, x in found.items() if x is None])
            self.long.update((w, x) for w, x in new.items() if 16 < len(w) <= LONGEST)
            found |= new
            at[lost], n[lost] = np.array([found[w] for w in words], np.int64).T
            own = lost[sizes[lost] <= 16]
            s = slot[own]
            self.keys[0][s], self.keys[1][s], self.keys[2][s], self.at[s], self.n[s] = one[own], two[own], long[own], at[own], n[own]
        done = np.cumsum(n)
        ids = self.pool[np.repeat(at - done + n, n) + np.arange(done[-1])]
        return np.split(ids, done[ends][:-1])

    def _slices(self, raw: bytes) -> list[bytes]:
        """A long text in slices that are split alike."""
        out, lo = [], 0
        while len(raw) - lo > GO and (m := _CUT.search(raw, lo + GO)):
            out.append(raw[lo : m.start() + 1])
            lo = m.start() + 1
        return [*out, raw[lo:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without added special tokens."""
        plain = [self._plain(t) for t in texts]
        rest = iter(self._library([t for t, p in zip(texts, plain) if not p]))
        slices = [self._slices(t.encode()) if p else [] for t, p in zip(texts, plain)]
        made, held, size = [], [], 0
        for s in [x for own in slices for x in own]:
            if held and size + len(s) > GO:
                made += self._block(b"\0".join(held) + b"\0")
                held, size = [], 0
            held.append(s)
            size += len(s)
        if held:
            made += self._block(b"\0".join(held) + b"\0")
        made = iter(made)
        parts = lambda own: [next(made) for _ in own]
        join = lambda x: x[0] if len(x) == 1 else np.concatenate(x)
        return [join(parts(own)) if p else next(rest) for own, p in zip(slices, plain)]


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One tokenizer for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
