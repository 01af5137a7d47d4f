"""Order-dependent steps over one row's sentences, as Arrow functions.

Each of these moves on what it has put out so far, which array expressions can only say by
copying their output at every step. They are walks over word counts and places here; the
rules themselves are those of `functions.text`, on the same fixed values.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from textloom.config import DEFAULTS, Settings
from textloom.functions import fixed as X

_end = lambda p: p[:-1] + r"\Z" if p.endswith("$") else p  # noqa: E731  Python's $ also stands before a last line end
_DECIMAL, _FIGURE, _BREAK = re.compile(X.DECIMAL), re.compile(X.FIGURE_REFERENCE, re.I), re.compile(X.SENTENCE_BREAK)
_edges = lambda p, wide: p if wide else p.replace(r"\b", "(?![A-Za-z0-9_])")
_MEANS = {wide: [re.compile(_edges(_end(p), wide), re.I) for p in (X.MEANINGFUL_HEADING, X.MEANINGFUL_LABEL)] for wide in (True, False)}
_ABBREVIATIONS, _QUOTES, _FUNCTION = set(X.ABBREVIATIONS), set(X.QUOTE_TOKENS), set(X.FUNCTION_WORDS)
_BARE = re.compile("[^A-Za-z0-9]")


def last_sentence(text: str, settings: Settings = DEFAULTS) -> str:
    masked = _DECIMAL.sub("\\1\0\\2", text)
    if settings.join_references:
        masked = _FIGURE.sub("\\1\0\\2", masked)
    parts = [p for p in _BREAK.split(" ".join(masked.split())) if p]

    def short(i: int) -> bool:
        tokens = [w for w in parts[i].split() if w not in _QUOTES]
        return bool(tokens) and tokens[-1].rstrip(".").lower() in _ABBREVIATIONS

    start = len(parts) - 1
    while start > 0 and short(start - 1):  # a sentence that ends with an abbreviation goes on
        start -= 1
    if not settings.join_lone:  # one that is nothing else ends there, but at the start of the text
        joined = start == 0
        for i in range(start + 1, len(parts)):
            joined = joined or " " in parts[i - 1]
            start = start if joined else i
    return " ".join(parts[start:]).replace("\0", ".") if parts else ""


def meaningful(text: str, settings: Settings = DEFAULTS) -> bool:
    s = text.strip()
    if not s:
        return False
    content = sum(_BARE.sub("", w).lower() not in _FUNCTION for w in s.split())
    return s.endswith("?") or any(p.search(s) for p in _MEANS[settings.wide_edges]) or content >= 2


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the cosine reaches the threshold; 0 for missing, unequal or zero vectors."""
    if len(a) != len(b) or not len(a):
        return threshold <= 0
    size = np.sqrt(a @ a) * np.sqrt(b @ b)
    return bool((a @ b) / size >= threshold) if size > 0 else threshold <= 0


def pack_similar(sentences: list[str], vectors: list[np.ndarray], most: int, threshold: float) -> list[str]:
    """Texts of sentences, gathered while the size allows and the running mean of vectors stays similar."""
    ends, words, mean, n = [], 0, None, 0
    for i, (s, v) in enumerate(zip(sentences, vectors)):
        own = len(s.split())
        if n and (words + own > most or not similar(mean, v, threshold)):
            ends.append(i)
            n = 0
        mean, words, n = (v, own, 1) if n == 0 else ((mean * n + v) / (n + 1), words + own, n + 1)
    cuts = [0, *ends, len(sentences)]
    return [" ".join(sentences[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def floor_small(groups: list[str], settings: Settings) -> list[str]:
    """Drops meaningless fragments and merges short groups backwards, within the size limit."""
    most, tokens = settings.child_max_words, lambda n: int(n / settings.words_per_token)
    out: list[list[str]] = []
    sizes: list[int] = []
    for g in groups:
        n = len(g.split())
        if tokens(n) <= settings.child_drop_tokens and not meaningful(g, settings):
            continue
        if out and tokens(n) <= settings.child_merge_tokens and sizes[-1] + n <= most:
            out[-1].append(g)
            sizes[-1] += n
        else:
            out.append([g])
            sizes.append(n)
    if len(out) >= 2 and tokens(sizes[0]) <= settings.child_merge_tokens and sizes[0] + sizes[1] <= most:
        out[:2] = [out[0] + out[1]]
    return [" ".join(parts).strip() if len(parts) > 1 else parts[0] for parts in out]


def overlapped(bodies: list[str], settings: Settings) -> list[str]:
    """Every body starts with the last sentence of the one before, if it fits and is not in it."""
    out: list[str] = []
    for b in filter(None, (b.strip() for b in bodies)):
        last = last_sentence(out[-1], settings) if out else ""
        joined = f"{last} {b}".strip()
        out.append(joined if last and last not in b and len(joined.split()) <= settings.child_max_words else b)
    return out


def border(a: list[str], b: list[str]) -> int:
    """Largest k for which the last k words of a are the first k of b: a prefix function over b, then a."""
    a = a[len(a) - min(len(a), len(b)) :]
    if not a:
        return 0
    back, k = [0] * len(b), 0
    for i in range(1, len(b)):
        while k and b[i] != b[k]:
            k = back[k - 1]
        k += b[i] == b[k]
        back[i] = k
    k = 0
    for w in a:
        if k == len(b):
            k = back[k - 1]
        while k and w != b[k]:
            k = back[k - 1]
        k += w == b[k]
    return k


def rows_of_vectors(vectors: pa.ListArray) -> list[list[np.ndarray] | None]:
    """Views of the vectors of each row, in double precision; a missing vector is empty."""
    inner = vectors.flatten()
    flat = np.asarray(inner.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    ends = np.cumsum(np.nan_to_num(inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)) if len(inner) else np.zeros(0, np.int64)
    each = np.split(flat, ends[:-1]) if len(inner) else []
    out, at = [], 0
    for n in vectors.value_lengths().to_pylist():
        out.append(None if n is None else each[at : at + n])
        at += n or 0
    return out
