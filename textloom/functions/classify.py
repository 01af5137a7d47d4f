"""The first rule that calls a paragraph junk, as one CASE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import fixed as X
from textloom.functions.text import count_alpha_words, folded, has_any, has_letters, let, matches, rx, strip


def category(text: Column, repeated: Column | None = None) -> Column:
    """Junk category of a cleaned paragraph, or null; the order of the rules counts."""
    seen = F.coalesce(repeated, F.lit(False)) if repeated is not None else F.lit(False)
    return let(strip(text), lambda s: let(folded(s), lambda low: _rules(text, s, low, seen)))


def _rules(text: Column, s: Column, low: Column, repeated: Column) -> Column:
    """Patterns are tried only on texts that open as theirs do, or hold a word of theirs; words are counted last."""
    n = count_alpha_words(s)
    opened = [
        ("figure_caption", matches(s, X.CAPTION) & (n <= X.CAPTION_WORDS)),
        ("figure_caption", matches(s, X.CAPTION_SEPARATOR) & ~matches(s, X.CAPTION_REFERENCE)),
        ("running_head", (matches(s, X.RUNNING_HEAD_LEADING) | matches(s, X.RUNNING_HEAD_TRAILING)) & (n <= X.RUNNING_HEAD_WORDS)),
        ("footnote", matches(s, X.FOOTNOTE, False)),
    ]
    closed = [
        ("bibliography", matches(s, X.BIBLIOGRAPHY)),
        ("credit_source", matches(s, X.CREDIT) & (n <= X.CREDIT_WORDS)),
        ("url", matches(s, X.URL_ONLY)),
        ("diagram_fragment", matches(s, X.DIAGRAM)),
    ]
    opens = F.substring(low, 1, 4).rlike(rx(X.OPENINGS))
    toc = F.substring(s, -1, 1).rlike(r"(?U)\d") & matches(s, X.TOC, False)
    rules = [
        ("empty", text == ""),
        ("header_footer", repeated),
        ("page_number", opens & matches(s, X.PAGE_NUMBER)),
        ("decorative", (opens & matches(s, X.DECORATIVE)) | (~has_letters(s) & (F.length(s) >= 3))),
        ("empty", ~has_letters(s)),
        ("copyright_boilerplate", has_any(low, X.NOTICES) & (matches(s, X.BOILERPLATE) | matches(s, X.COPYRIGHT))),
        ("watermark", has_any(low, X.MARKS) & matches(s, X.WATERMARK) & (n <= X.WATERMARK_WORDS)),
    ]
    return _first(rules, F.coalesce(F.when(opens, _first(opened)), F.when(toc, "toc"), F.when(opens, _first(closed))))


def _first(rules: list[tuple[str, Column]], out: Column | None = None) -> Column:
    """The name of the first rule that holds, or else `out`."""
    out = F.lit(None).cast("string") if out is None else out
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out
