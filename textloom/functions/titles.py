"""Titles: cleaning, title case, validity, block lists and reply grammars, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions import fixed as X
from textloom.functions import tagger
from textloom.functions.text import count_words, first_tokens, let, matches, rx, strip, words


def title_case(c: Column) -> Column:
    """Title case that keeps acronyms and k-/t- terms, lowers small words, raises bracketed words."""
    small = [F.lit(w) for w in X.SMALL_WORDS]

    def up(w: Column) -> Column:
        return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))

    def piece(p: Column) -> Column:
        return F.when(F.substring(p, 1, 1).rlike(r"^\p{Lu}"), p).when(F.lower(p).isin(*small), F.lower(p)).otherwise(up(p))

    def one(w: Column, i: Column) -> Column:
        inner = F.regexp_extract(w, r"^\(([A-Za-z]{2,})\)$", 1)
        return (
            F.when(F.regexp_replace(w, "[^A-Za-z0-9-]", "").rlike("^[A-Z]{2,}$"), w)
            .when(w.rlike(r"^[kKtT]-[A-Za-z0-9]+$"), w)
            .when(inner != "", F.concat(F.lit("("), F.when(F.lower(inner).isin(*small), F.lower(inner)).otherwise(F.upper(inner)), F.lit(")")))
            .when((i > 0) & F.lower(w).isin(*small), F.lower(w))
            .when(w.contains("-"), F.array_join(F.transform(F.split(w, "-"), piece), "-"))
            .otherwise(up(w))
        )

    return F.array_join(F.transform(words(c), one), " ")


def is_explained(clause: Column, is_noun_phrase=lambda c: F.lit(True)) -> Column:
    """Whether what follows a colon reads like a sentence: empty, long, or no noun phrase."""
    return (clause == "") | (count_words(clause) > 4) | ~is_noun_phrase(clause)


def clean_title(raw: Column, max_words: int = 0, is_noun_phrase=lambda c: F.lit(True)) -> Column:
    """A reply line as a title: no markdown, numbering, tags, quotes or trailing marks."""
    t = F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"\*\*|__", "")
    for pattern in (r"^\s*#+\s*", r"^\s*[-*•]\s+", r"^\s*\d+(?:[.:-]\d+)*(?:[.:-]\s*)?", r"^\s*\[(?:SECTION|SUBSECTION)\]\s*"):
        t = strip(F.regexp_replace(t, rx(pattern), ""))
    t = F.regexp_replace(F.regexp_replace(t, '^"+|"+$', ""), "^'+|'+$", "")
    for pattern in ("[.。]+$", "[,;:]+$", "[-—]+$"):
        t = F.regexp_replace(t if pattern != "[.。]+$" else strip(t), pattern, "")
    t = strip(t)
    before, after = strip(F.substring_index(t, ":", 1)), strip(F.regexp_replace(t, "^[^:]*:", ""))
    t = F.when(~t.contains(":"), t).when(is_explained(after, is_noun_phrase), before).otherwise(F.concat(before, F.lit(": "), after))
    t = strip(F.regexp_replace(t, rx(r"\s+"), " "))
    if max_words > 0:
        t = first_tokens(t, max_words)
    w = words(t)
    tail = F.aggregate(F.reverse(w), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] & F.lower(F.regexp_replace(x, r"^\(+|\(+$", "")).isin(X.SMALL_WORDS)).alias("on"), (s["n"] + F.when(s["on"] & F.lower(F.regexp_replace(x, r"^\(+|\(+$", "")).isin(X.SMALL_WORDS), 1).otherwise(0)).alias("n")), lambda s: s["n"])
    kept = F.slice(w, F.lit(1), F.greatest(F.size(w) - tail, F.least(F.size(w), F.lit(1))))
    return title_case(F.array_join(kept, " "))


def is_valid_title(c: Column, low: int = DEFAULTS.title_min_words, high: int = DEFAULTS.title_max_words, is_noun_phrase=lambda c: F.lit(True)) -> Column:
    n = count_words(c)
    inside = F.regexp_extract_all(c, F.lit(r"\(([^)]*)\)"), F.lit(1))
    bad = matches(c, r"\b(\w+)\s+\1\b") | c.rlike(r"[?,&\n]") | c.rlike(r"(?U)\b\d+[.:)]") | c.rlike(rx(r"(^|\s)[-*•]\s"))
    balanced = F.length(F.regexp_replace(c, r"[^(]", "")) == F.length(F.regexp_replace(c, r"[^)]", ""))
    return F.coalesce((strip(c) != "") & n.between(low, high) & is_noun_phrase(c) & ~bad & balanced & F.forall(inside, lambda x: x.rlike(r"^[A-Z]{2,5}\z")), F.lit(False))


def is_blocklisted(c: Column) -> Column:
    low = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), rx(r"\s+"), " ")
    starts = F.exists(F.array(*[F.lit(p) for p in X.FILLER_PREFIXES]), lambda p: low.startswith(p))
    return (low == "") | low.isin(X.TITLE_BLOCKLIST) | starts


def appears_in(title: Column, text: Column) -> Column:
    """Whether the title's words stand in the text in a row, ignoring case and punctuation."""
    spaced = lambda c: F.concat(F.lit(" "), F.trim(F.lower(F.regexp_replace(c, r"(?U)[\W_]+", " "))), F.lit(" "))
    return (spaced(title) != "  ") & spaced(text).contains(spaced(title))


def title_list(raw: Column) -> Column:
    """Titles of a numbered reply, one a line."""
    lines = F.transform(F.split(raw, r"\r\n|[\n\r]"), lambda x: strip(F.regexp_replace(strip(x), rx(X.LIST_LEAD), "")))
    return F.filter(lines, lambda x: x != "")


def review_rows(raw: Column) -> Column:
    """Map of title number to (score, verdict, title) of a review reply; the last line of a number counts."""
    p = rx(X.REVIEW_LINE, True)
    lines = F.filter(F.transform(F.split(raw, r"\r\n|[\n\r]"), strip), lambda x: x.rlike(p))
    quoted = lambda x: strip(F.regexp_replace(F.regexp_replace(strip(x), '^"+|"+$', ""), "^'+|'+$", ""))
    rows = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, p, 1).cast("int").alias("idx"), F.regexp_extract(x, p, 2).cast("int").alias("score"), F.upper(F.regexp_extract(x, p, 3)).alias("verdict"), quoted(F.regexp_extract(x, p, 4)).alias("title")))
    return F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda o: o["idx"] == r["idx"]))


def noun_test(settings: Settings):
    """The test of noun phrases that the settings ask for: the tagger's, or one that accepts all."""
    return tagger.is_noun_phrase if settings.tag_titles else lambda c: F.lit(True)


def chunk_finder(settings: Settings):
    return tagger.first_noun_chunk if settings.tag_titles else lambda c: F.lit("")


def accept(c: Column, used: Column, settings: Settings = DEFAULTS) -> Column:
    return is_valid_title(c, settings.title_min_words, settings.title_max_words, noun_test(settings)) & ~is_blocklisted(c) & ~F.array_contains(used, c)


def _bare(w: Column) -> Column:
    return F.regexp_replace(w, "[^A-Za-z0-9-]", "")


def looks_like_heading(c: Column, low: int, high: int, is_noun_phrase=lambda c: F.lit(True)) -> Column:
    return (c != "") & ~c.rlike(r"[,?\n]") & ~c.rlike(r"(?U)\b\d+[.:)]") & count_words(c).between(low, high) & is_noun_phrase(c)


def fallback_title(content: Column, high: int = 6, low: int = 2, is_noun_phrase=lambda c: F.lit(True), noun_chunk=lambda c: F.lit("")) -> Column:
    """A title from a passage's own words, or '' where none reads like a heading.

    Tried in turn: an acronym in brackets, a k- or t- term with the lower-case words after
    it, the tagger's first noun chunk, the first word that may stand alone.
    """
    small = X.SMALL_WORDS

    def find(w: Column, text: Column) -> Column:
        acronym = F.regexp_extract(text, r"\(([A-Z]{2,})\)", 1)
        term = F.regexp_extract(text, r"(?U)\b([kKtT]-[A-Za-z0-9]+)", 1)
        at = F.size(words(F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(r"(?U)\b[kKtT]-[A-Za-z0-9]+")) - 1)))
        head = F.coalesce(F.try_element_at(w, at + 1), F.lit(""))
        goes_on = lambda x: x.rlike(r"^\p{Ll}") & (F.length(_bare(x)) >= 3) & ~F.lower(_bare(x)).isin(small)
        tail = F.aggregate(F.slice(w, at + 2, F.lit(high)), F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("run")), lambda s, x: F.when(s["on"] & goes_on(x), F.struct(F.lit(True).alias("on"), F.concat(s["run"], F.array(x)).alias("run"))).otherwise(F.struct(F.lit(False).alias("on"), s["run"].alias("run"))), lambda s: s["run"])
        run = F.when(head.contains(term), F.array_join(F.slice(F.concat(F.array(head), tail), 1, high), " ")).otherwise(term)
        alone = F.filter(F.transform(w, _bare), lambda k: (k != "") & ~F.lower(k).isin(small) & (k.rlike(r"^\p{Lu}") | (F.length(k) > 3)) & is_noun_phrase(k))
        chunk = noun_chunk(text)
        return F.when(acronym != "", acronym).when(term != "", run).when(chunk != "", chunk).otherwise(F.coalesce(F.try_element_at(alone, F.lit(1)), F.lit("")))

    label = let(first_tokens(content, 250), lambda text: let(words(text), lambda w: find(w, text)))
    return let(label, lambda x: F.when(looks_like_heading(x, low, high, is_noun_phrase), clean_title(x, high, is_noun_phrase)).otherwise(""))
