"""Text functions on columns: cleaning, words, sentences, list markers."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions import fixed as X
from textloom.functions.kernels import border


def rx(pattern: str, ignore_case: bool = False) -> str:
    """A pattern in Java's form: Unicode classes, the wider white space, `$` as the very end."""
    inside = lambda m: m.group(0).replace(r"\s", r"\s\x1C-\x1F")
    wide = re.sub(r"\[(?:\\.|[^\]\\])*\]", inside, pattern)
    parts = re.split(r"(\[(?:\\.|[^\]\\])*\])", wide)
    wide = "".join(p if i % 2 else p.replace(r"\s", X.SPACE) for i, p in enumerate(parts))
    return ("(?iU)" if ignore_case else "(?U)") + re.sub(r"(?<!\\)\$", r"\\z", wide)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return c.rlike(rx(pattern, ignore_case))


def strip(c: Column) -> Column:
    """Without white space at its ends; only texts that have some there are searched."""
    edges = lambda s: F.concat(F.substring(s, 1, 1), F.substring(s, -1, 1))
    return let(c, lambda s: F.when(edges(s).rlike(rx(r"\s")), F.regexp_replace(s, rx(r"^\s+|\s+$"), "")).otherwise(s))


def is_blank(c: Column) -> Column:
    return ~c.rlike(rx(r"[^\s]"))


def has_any(c: Column, texts) -> Column:
    """Whether one of these fixed texts is in it: a search of bytes."""
    return reduce(lambda a, b: a | b, [c.contains(t) for t in texts])


def folded(c: Column) -> Column:
    """Lower case, with the letters that a pattern without case takes for i, s and k."""
    return F.lower(F.when(has_any(c, "ıİſ\u212a"), F.translate(c, "ıİſ\u212a", "iisk")).otherwise(c))


def words(c: Column) -> Column:
    return F.filter(F.split(c, rx(r"\s+")), lambda w: w != "")


def count_words(c: Column) -> Column:
    return F.size(words(c))


def count_tokens(c: Column, words_per_token: float = 1.3) -> Column:
    """Tokens that a text is held to have: words / ratio, cut."""
    return (count_words(c) / F.lit(words_per_token)).cast("int")


def reported_tokens(c: Column, words_per_token: float = 1.3) -> Column:
    """The report's estimate, which multiplies."""
    return (count_words(c) * F.lit(words_per_token)).cast("int")


def count_alpha_words(c: Column) -> Column:
    return F.size(F.filter(words(c), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def has_letters(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def first_tokens(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ") if n > 0 else F.lit("")


#: Texts of these characters only are their own compatibility form.
_COMPOSED = "^[\\x00-\\x7F¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-ž–—‘’“”]*\\z"


def nfkc(df: DataFrame, column: str) -> DataFrame:
    """Compatibility normalisation. Texts that need none stay on the JVM: Python is given
    nulls in their place, so that rows are read and computed once."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    odd = F.when(~F.col(column).rlike(_COMPOSED), F.col(column))
    return df.withColumn(column, F.coalesce(normal(odd), F.col(column)))


def map_punctuation(c: Column) -> Column:
    kept = {k: v for k, v in X.PUNCTUATION.items() if v}
    gone = "".join(k for k, v in X.PUNCTUATION.items() if not v)
    return let(c, lambda s: F.when(has_any(s, X.PUNCTUATION), F.translate(s, "".join(kept) + gone, "".join(kept.values()))).otherwise(s))


_LINE_ENDS = r"\r\n|[\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
_MANY_LINES = r"[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def normalize_whitespace(c: Column) -> Column:
    """One space for runs, no space at line ends, one empty line at most. Most items are one line."""
    lines = lambda flat: F.regexp_replace(F.regexp_replace(flat, _LINE_ENDS, "\n"), r"(?U)[\s\x1C-\x1F&&[^\n]]+(?=\n|\z)", "")
    return strip(let(one_space(c), lambda flat: F.when(flat.rlike(_MANY_LINES), F.regexp_replace(lines(flat), r"\n{3,}", "\n\n")).otherwise(flat)))


def one_space(c: Column) -> Column:
    """One space for runs of spaces and tabs."""
    return let(c, lambda s: F.when(has_any(s, ["\t", "  "]), F.regexp_replace(s, "[ \t]+", " ")).otherwise(s))


def fix_hyphenation(c: Column) -> Column:
    joined = lambda s: F.when(s.contains("\n"), F.regexp_replace(s, rx(X.HYPHEN_BREAK), "")).otherwise(s)
    return let(c, lambda s: F.when(has_any(s, "\u2010\u2011"), F.regexp_replace(joined(s), rx(X.HYPHEN_LETTER), "")).otherwise(joined(s)))


def keeps_break(before: Column, line: Column) -> Column:
    """Whether a line stays on its own after the text gathered before it."""
    table = before.rlike(rx(X.TABLE_OR_CODE)) | line.rlike(rx(X.TABLE_OR_CODE))
    return matches(line, X.HEADING_PREFIX) | table | matches(line, X.FIGURE_START) | before.rlike(rx(X.SENTENCE_END))


def fix_line_breaks(c: Column) -> Column:
    """Joins wrapped lines inside paragraphs; what a line joins is all that was gathered."""

    def paragraph(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(F.regexp_replace(p, _LINE_ENDS, "\n"), "\n"), strip), lambda x: x != "")
        join = lambda acc, x: F.when(acc == "", x).otherwise(F.concat(acc, F.when(keeps_break(acc, x), "\n").otherwise(" "), x))
        return F.aggregate(lines, F.lit(""), join)

    whole = lambda s: F.array_join(F.filter(F.transform(F.split(s, rx(r"\n\s*\n")), paragraph), lambda p: p != ""), "\n\n")
    return let(c, lambda s: F.when(s.rlike(_MANY_LINES), whole(s)).otherwise(strip(s)))


def clean_text(c: Column) -> Column:
    """A text block after compatibility normalisation (see `nfkc`), cleaned."""
    joined = fix_line_breaks(fix_hyphenation(map_punctuation(c)))
    return F.regexp_replace(normalize_whitespace(joined), rx(X.SPACE_BEFORE_PUNCTUATION), "$1")


def strip_inline_footnotes(c: Column) -> tuple[Column, Column]:
    """(text, number of markers removed); texts without digits have none."""
    spaced, attached, glued = (rx(p) for p in (X.FOOTNOTE_SPACED, X.FOOTNOTE_ATTACHED, X.FOOTNOTE_GLUED))
    one = F.regexp_replace(c, spaced, " ")
    two = F.regexp_replace(one, attached, "")
    n = F.regexp_count(c, F.lit(spaced)) + F.regexp_count(one, F.lit(attached)) + F.regexp_count(two, F.lit(glued))
    digits = c.rlike(r"(?U)\d")
    return F.when(digits, F.regexp_replace(two, glued, "")).otherwise(c), F.when(digits, n).when(c.isNotNull(), 0)


def strip_inline_garbage(c: Column) -> tuple[Column, Column]:
    """(text, number of replacement characters)."""
    controls = "".join(map(chr, [*range(9), 11, 12, *range(14, 32)]))
    n = F.when(has_any(c, X.REPLACEMENT), F.length(c) - F.length(F.translate(c, X.REPLACEMENT, ""))).when(c.isNotNull(), 0)
    dirty = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}-\x{FFFF}]"
    bare = F.when(c.rlike(dirty), F.translate(c, X.REPLACEMENT + controls, "")).otherwise(c)
    linked = let(bare, lambda s: F.when(s.contains("://") | folded(s).contains("www."), F.regexp_replace(s, rx(X.URL, True), " ")).otherwise(s))
    return strip(one_space(linked)), n


def strip_options(c: Column) -> tuple[Column, Column]:
    """(text before a block of answer options, whether there is such a block)."""
    marker, answer = rx(X.OPTION_MARKER), rx(X.OPTION_ANSWER, True)
    said = c.rlike(answer)
    n = F.regexp_count(c, F.lit(marker))
    block = F.coalesce((n >= 3) | ((n == 2) & said), F.lit(False))
    at = F.regexp_instr(c, F.lit(marker))
    first = F.when(said, F.least(at, F.regexp_instr(c, F.lit(answer)))).otherwise(at)
    prose = lambda lead: F.when((count_alpha_words(lead) >= 3) & lead.rlike(rx(X.SENTENCE_END)), lead).otherwise("")
    return F.when(~block, c).otherwise(let(strip(F.substring(c, F.lit(1), first - 1)), prose)), block


def repeat_key(c: Column) -> Column:
    """Key under which a line of a page repeats: no digits, no punctuation."""
    # a run that is one space stays as it is; ASCII needs no Unicode classes
    plain = lambda s: F.regexp_replace(s, " *[^a-z_ ][^a-z_]*|  +", " ")
    wide = lambda s: F.regexp_replace(s, r"(?U) *[\W\d&&[^ ]][\W\d]*|  +", " ")
    return strip(let(F.lower(map_punctuation(c)), lambda s: F.when(F.octet_length(s) == F.length(s), plain(s)).otherwise(wide(s))))


def last_token(c: Column) -> Column:
    tokens = F.filter(words(c), lambda w: ~w.isin(X.QUOTE_TOKENS))
    return F.regexp_replace(F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit("")), r"\.+$", "")


def split_sentences(c: Column, settings: Settings = DEFAULTS) -> Column:
    """Sentences of a text; abbreviations, decimals and figure references end none."""
    masked = F.regexp_replace(c, r"(?U)" + X.DECIMAL, "$1\u0000$2")
    if settings.join_references:
        masked = F.regexp_replace(masked, rx(X.FIGURE_REFERENCE, True), "$1\u0000$2")
    flat = strip(F.regexp_replace(masked, rx(r"\s+"), " "))
    parts = F.filter(F.split(flat, rx(X.SENTENCE_BREAK)), lambda p: p != "")

    def joined(ps: Column) -> Column:
        """All parts in one text, with a line end where a sentence ends: a flat text has none of its own.
        A part before a break ends in a mark, so its last word is the token in question."""
        short = lambda p: F.lower(F.rtrim(F.substring_index(p, " ", -1), F.lit("."))).isin(X.ABBREVIATIONS)
        edge = lambda i: F.when(i == 0, "").when(short(F.get(ps, i - 1)), " ").otherwise("\n")
        return F.array_join(F.transform(ps, lambda p, i: F.concat(edge(i), p)), "")

    return F.filter(F.split(F.replace(let(parts, joined), F.lit("\u0000"), F.lit(".")), "\n"), lambda s: s != "")


def last_sentence(c: Column) -> Column:
    return F.coalesce(F.try_element_at(split_sentences(c), F.lit(-1)), F.lit(""))


def strip_list_markers(c: Column) -> Column:
    """Without bullets and small list numbers; a number after a structural word stays."""
    structural = r"(?<!(?:^|[\s(])(?i:" + "|".join(X.STRUCTURAL_WORDS) + r")\.{0,3}\s{0,9}(?:[(\[]\s{1,3})?(?:[(\[]\s{1,3})?)"
    number = r"(?=\d{1,2}\s*[.)]\s)"  # looked for first: what stands before is searched at such places only
    return F.regexp_replace(F.regexp_replace(c, rx(X.BULLET), "$1"), rx(number + structural + X.LIST_MARKER), "")


def content_words(c: Column) -> Column:
    return F.filter(words(c), lambda w: ~F.lower(F.regexp_replace(w, "[^A-Za-z0-9]", "")).isin(X.FUNCTION_WORDS))


def sentence_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def is_junk_sentence(c: Column, settings: Settings = DEFAULTS) -> Column:
    tail = X.ORPHAN_TAIL if settings.wide_edges else X.ORPHAN_TAIL.replace(r"\b", "(?<![A-Za-z0-9_])")

    def test(s: Column) -> Column:
        junk = (s == "") | s.rlike(rx(r"^[A-Za-z]\s+[A-Z]")) | (count_words(s) < 2) | matches(s, X.JUNK_LABEL) | matches(s, tail)
        return junk | (F.size(content_words(s)) == 0)

    return let(strip(c), test)


def is_question_sentence(c: Column) -> Column:
    s = strip(c)
    return s.rlike(rx("^" + X.LIST_MARKER)) & s.endswith("?")


def is_question_text(c: Column, share: float = 0.6, settings: Settings = DEFAULTS) -> Column:
    return let(split_sentences(c, settings), lambda s: (F.size(s) > 0) & (F.size(F.filter(s, is_question_sentence)) / F.greatest(F.size(s), F.lit(1)) >= share))


def is_meaningful(c: Column) -> Column:
    return let(strip(c), lambda s: (s != "") & (s.endswith("?") | matches(s, X.MEANINGFUL_HEADING) | matches(s, X.MEANINGFUL_LABEL) | (F.size(content_words(s)) >= 2)))


def word_overlap(a: Column, b: Column) -> Column:
    """Largest k for which the last k words of a are the first k of b; null if either is null. Linear in their words."""

    @F.arrow_udf("int")
    def shared(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if s is None or t is None else border(s.split(), t.split()) for s, t in zip(x.to_pylist(), y.to_pylist())], pa.int32())

    return shared(a, b)


def prepare_sentences(c: Column, settings: Settings = DEFAULTS) -> Column:
    """The sentences that child chunks are packed from: no markers, junk or direct repeats."""
    kept = F.filter(split_sentences(strip_list_markers(c), settings), lambda s: ~is_junk_sentence(s, settings))

    def step(acc: Column, s: Column) -> Column:
        fresh = lambda key: F.when(~key.eqNullSafe(acc["key"]), F.struct(F.concat(acc["out"], F.array(strip(s))).alias("out"), key.alias("key"))).otherwise(acc)
        return let(sentence_key(s), fresh)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("key"))
    return F.aggregate(kept, start, step, lambda acc: acc["out"])
