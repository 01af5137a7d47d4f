"""Token counts of whole texts by overlapping chunks that are spliced.

A text is encoded as chunks of `chunk` characters, with offsets, each overlapping the one
before (a text of one chunk has nothing to splice). Neighbours are joined at a common
boundary that is proven stable: an edge that ends a pre-token whatever stands around
it, at which both encodings start a token, with the same ids from there up to a margin. If
the overlap holds none, or the encodings do not agree, it is widened (doubled), back to the
last boundary at most; the chunk grows with it, so that a text without any edge costs a
bounded number of times its encoding. The result is the library's for the whole text.

Edges: before a character that follows white space; between an ASCII digit and an ASCII
letter or digit; between an ASCII letter or digit, and an ASCII sign but the apostrophe;
between a common ideograph or kana and its full stop or comma.

Defined cases: null text is empty and counts 0; a text without edges ends up encoded
whole; repeated rows are counted each.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from textloom.llm.common import arrow_batches, batch_of, id_text

CHUNK = 20_000
OVERLAP = 400
#: Tokens that must agree after a common boundary.
MARGIN = 4
_EDGE = re.compile(r"(?<=[ \n\r\t])(?=\S)|(?<=[0-9])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[A-Za-z0-9])(?=[!-&(-/:-@\[-`{-~])|(?<=[一-龥ぁ-ゖァ-ヺ])(?=[。、！？])")


#: The normaliser and the pre-tokens of the word-level files whose first two steps can be left out.
_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WIDE = re.compile("[^\x00-\uffff]")


class WordTokenizer:
    """A tokenizers .json file, without the steps of its normaliser that change nothing for a text.

    Composition (NFC) is the identity for a text that is composed, and for its parts. White
    space becomes one space, but the pre-tokenizer drops white space as such and ends
    pre-tokens there in any case. Texts that are not composed, or have characters beyond the
    basic plane, whose composition may be newer than this Python's, take all steps.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        def loaded():
            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            return t

        self.whole = self.short = loaded()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        drops = first.get("pattern") == {"Regex": _PRETOKENS} and first.get("behavior") == "Removed" and first.get("invert")
        if drops and (spec.get("normalizer") or {}).get("normalizers") == _STEPS and not any(t["normalized"] for t in spec["added_tokens"]):
            self.short = loaded()
            self.short.normalizer = normalizers.Lowercase()

    def of(self, text: str):
        """The tokenizer that a text takes."""
        return self.short if text.isascii() or unicodedata.is_normalized("NFC", text) and not _WIDE.search(text) else self.whole


class Piece:
    """The encoding of text[start:stop]; tokens from `first` on count."""

    def __init__(self, tokenizer, text: str, start: int, stop: int):
        self.encoding, self.start, self.stop, self.first = tokenizer.encode(text[start:stop], add_special_tokens=False), start, stop, 0
        self.ids: list[int] = self.encoding.ids

    def token_at(self, place: int) -> int | None:
        """The token that starts at a place of the text."""
        i = self.encoding.char_to_token(place - self.start)
        return i if i is not None and self.encoding.token_to_chars(i)[0] == place - self.start else None

    def starts(self, i: int, n: int) -> list[int]:
        return [self.start + self.encoding.token_to_chars(k)[0] for k in range(i, i + n)]


def stable_boundary(text: str, left: Piece, right: Piece, margin: int = MARGIN) -> tuple[int, int, int] | None:
    """(place, token of left, token of right) of the first proven common boundary in their overlap.

    The place is an edge, so the tokens from there on are the same in every encoding that
    sees the text from there to beyond the margin, and those before it in every one that sees it.
    """
    for m in _EDGE.finditer(text, right.start, left.stop):
        p = m.start()
        if p == right.start and p:
            continue  # right does not see what stands before
        i, j = left.token_at(p), right.token_at(p)
        if i is None or j is None:
            continue
        if i + margin > len(left.ids) or j + margin > len(right.ids):
            return None
        if left.ids[i : i + margin] == right.ids[j : j + margin] and left.starts(i, margin) == right.starts(j, margin):
            return p, i, j
    return None


def spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> Iterator[tuple[Piece, int]]:
    """Pieces in order, each with the token before which it is cut."""
    low, held = 0, Piece(tokenizer, text, 0, min(chunk, len(text)))
    while held.stop < len(text):
        width = overlap
        while True:
            start = max(low, held.stop - width)
            if start > low and not _EDGE.search(text, start + 1, held.stop):
                width *= 2
                continue
            back = held.stop - start
            new = Piece(tokenizer, text, start, min(len(text), held.stop + max(chunk - back, back)))
            cut = stable_boundary(text, held, new, margin) if start > low else None
            if cut or start == low:
                break
            width *= 2
        if cut:
            low, stop, new.first = cut
            yield held, stop
        held = new  # without a cut it starts at the last boundary and holds all since
    yield held, len(held.ids)


def encode_spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> list[int]:
    """Ids of the whole text; equal to encoding it at once."""
    return [i for piece, stop in spliced(tokenizer, text, chunk, overlap, margin) for i in piece.ids[piece.first : stop]]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, by a tokenizers .json file.

    The file must be one whose pre-tokens end at the edges (word-level pre-tokenizers that
    drop white space and part digits), which the proof of a stable boundary needs.
    """
    arrow_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        tokenizer = WordTokenizer(tokenizer_path)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [0] * len(texts)
            for t in {id(t): t for t in (tokenizer.short, tokenizer.whole)}.values():
                own = [i for i, x in enumerate(texts) if tokenizer.of(x) is t]
                one = [i for i in own if len(texts[i]) <= chunk]  # one chunk: no offsets needed
                for i, e in zip(one, t.encode_batch_fast([texts[i] for i in one], add_special_tokens=False)):
                    n[i] = len(e)
                for i in own:
                    if len(texts[i]) > chunk:
                        n[i] = sum(stop - piece.first for piece, stop in spliced(t, texts[i], chunk, overlap))
            size = pc.binary_length(b.column("text").cast(pa.binary()))
            yield batch_of({"doc_id": b.column("doc_id"), "n_bytes": size, "n_tokens": n, "over_limit": [k > limit for k in n]}, schema)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
