"""A small part-of-speech tagger in column expressions, and the two tests of titles that need one.

Scores are whole numbers: what a word is by itself (closed classes by lexicon, others by
suffix and shape) and how well a tag follows another. The best sequence of tags is found
word by word (Viterbi). Whether a noun was met is part of the state, so that a title is
judged without tracing its tags back; noun chunks trace them.

The model is a few hundred literals of the plan, so nothing is sent out or loaded, and there is no
Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import let, words

#: Noun, number, verb, adjective, adverb, determiner, pronoun, preposition or conjunction, auxiliary.
TAGS = "N9VARDOPX"
HEADS, NOUNS = "N9", "N9"

# Words of closed classes, by tag.
LEXICON = {
    "D": "the a an this that these those his her their our your its my each every some any no all both".split(),
    "O": "it he she they we you i".split(),
    "P": "of in on at to for with by from as into about over under between through and or but nor vs than if because while when where which who".split(),
    "X": "is are was were be been being am do does did has have had can could will would shall should may might must cannot".split(),
    "R": "not very also just only often back away here there now then again too almost always never how why".split(),
    "V": "make makes get gets use uses see find take give go come know think show keep let explain describe understand".split(),
}
# Scores by ending, the first that fits; of what has none of them.
SUFFIXES = [
    ("(?:tion|sion|ment|ness|ity|ism|ist|ship|ance|ence|logy|graph|ture|dom|hood)s?$", {"N": 0}),
    ("ly$", {"R": 0, "A": -30, "N": -50}),
    ("(?:ous|ful|less|ive|able|ible|ical|ary|ish)$", {"A": 0, "N": -25}),
    ("(?:ize|ise|ify)s?$", {"V": 0, "N": -30}),
    ("ing$", {"V": -5, "N": -7, "A": -15}),
    ("ed$", {"V": -5, "A": -8, "N": -30}),
    ("(?:al|ic|ar)$", {"A": -5, "N": -8}),
    ("[^su]s$", {"N": 0, "V": -6, "A": -40}),
]
UNKNOWN = {"N": 0, "V": -15, "A": -15, "R": -40}
#: What else a tag scores for a word that does not name it.
OTHER = -90
# How a tag follows another; 0 where nothing is said.
FOLLOWS = {
    ("D", "N"): 8, ("D", "A"): 8, ("D", "V"): -30, ("D", "X"): -30, ("D", "D"): -20, ("D", "P"): -25, ("A", "N"): 8, ("A", "V"): -12, ("A", "A"): 0, ("N", "N"): 4, ("N", "X"): 4, ("N", "R"): -12, ("O", "V"): 6, ("O", "X"): 6, ("O", "N"): -10, ("O", "A"): -10, ("O", "R"): 2, ("X", "V"): 8, ("X", "R"): 4, ("X", "N"): -6,
    ("P", "D"): 5, ("P", "N"): 4, ("P", "V"): -6, ("P", "P"): -15, ("V", "D"): 5, ("V", "N"): 2, ("V", "P"): 4, ("V", "V"): -10, ("R", "V"): 5, ("R", "A"): 4, ("R", "N"): -8, ("9", "N"): 5, ("V", "R"): 4,
}


def _scores(of: dict[str, int]) -> list[int]:
    return [of.get(t, OTHER) for t in TAGS]


def _literal(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _emission(w: Column) -> Column:
    """Scores of the tags for a word by itself."""
    low = F.lower(w)
    out = _literal(_scores(UNKNOWN))
    for pattern, of in reversed(SUFFIXES):
        out = F.when(low.rlike(pattern), _literal(_scores(of))).otherwise(out)
    out = F.when(w.rlike(r"^[A-Z]{2,}s?$"), _literal(_scores({"N": 0}))).otherwise(out)
    out = F.when(w.rlike(r"^\d"), _literal(_scores({"9": 0, "N": -10}))).otherwise(out)
    for tag, known in LEXICON.items():
        out = F.when(low.isin(known), _literal(_scores({tag: 0}))).otherwise(out)
    return out


def tokens(c: Column) -> Column:
    """Words without the marks around them; marks alone are none."""
    bare = F.transform(words(c), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda w: w != "")


def _best(scores: Column, to: int, pick) -> Column:
    """The best way to a tag: greatest of (score before + how it follows), over the states that `pick` takes."""
    ways = [F.get(scores, F.lit(s)) + FOLLOWS.get((TAGS[s % len(TAGS)], TAGS[to]), 0) for s in range(2 * len(TAGS)) if pick(s)]
    return F.greatest(*ways)


_NEVER = -(10**6)


def is_noun_phrase(title: Column) -> Column:
    """Whether the best tags of a title have a noun or number and end on one: no dangling function word, adverb or verb."""
    n = len(TAGS)
    noun = [t in NOUNS for t in TAGS]

    def judged(ws: Column) -> Column:
        first = F.transform(F.array(_emission(F.element_at(ws, 1))), lambda e: F.array(*[F.when(F.lit(noun[s % n] == (s >= n)), F.get(e, F.lit(s % n))).otherwise(F.lit(_NEVER)) for s in range(2 * n)]))[0]

        def step(scores: Column, w: Column) -> Column:
            def ahead(e: Column) -> Column:
                without = [F.lit(_NEVER) if noun[t] else _best(scores, t, lambda s: s < n) + F.get(e, F.lit(t)) for t in range(n)]
                with_one = [_best(scores, t, (lambda s: True) if noun[t] else (lambda s: s >= n)) + F.get(e, F.lit(t)) for t in range(n)]
                return F.array(*without, *with_one)

            return let(_emission(w), ahead)

        last = F.aggregate(F.slice(ws, F.lit(2), F.size(ws)), first, step)
        return let(last, lambda s: F.array_position(s, F.array_max(s)) > n) & let(last, lambda s: F.substring(F.lit(TAGS * 2), F.array_position(s, F.array_max(s)).cast("int"), F.lit(1)).isin(list(HEADS)))

    return let(tokens(title), lambda ws: F.when(F.size(ws) > 0, judged(ws)).otherwise(F.lit(False)))


def tags(ws: Column) -> Column:
    """The best tags of an array of words, a letter each."""
    n = len(TAGS)
    start = F.struct(_emission(F.element_at(ws, 1)).alias("score"), F.array().cast("array<array<int>>").alias("backs"))

    def step(s: Column, w: Column) -> Column:
        def ahead(e: Column) -> Column:
            ways = [F.array(*[F.get(s["score"], F.lit(p)) + FOLLOWS.get((TAGS[p], TAGS[t]), 0) for p in range(n)]) for t in range(n)]
            best = F.transform(F.array(*ways), lambda x: F.struct(F.array_max(x).alias("v"), (F.array_position(x, F.array_max(x)) - 1).cast("int").alias("at")))
            return let(best, lambda b: F.struct(F.transform(b, lambda x, t: x["v"] + F.get(e, t)).alias("score"), F.concat(s["backs"], F.array(F.transform(b, lambda x: x["at"]))).alias("backs")))

        return let(_emission(w), ahead)

    def traced(s: Column) -> Column:
        last = (F.array_position(s["score"], F.array_max(s["score"])) - 1).cast("int")
        letter = lambda at: F.substring(F.lit(TAGS), at + 1, F.lit(1))
        walk = F.aggregate(F.reverse(s["backs"]), F.struct(last.alias("at"), letter(last).alias("out")), lambda x, back: let(F.get(back, x["at"]), lambda p: F.struct(p.alias("at"), F.concat(letter(p), x["out"]).alias("out"))))
        return walk["out"]

    return F.when(F.size(ws) > 0, F.aggregate(F.slice(ws, F.lit(2), F.size(ws)), start, step, traced)).otherwise("")


def chunks_of(ws: Column, t: Column) -> Column:
    """Runs of adjectives, numbers and nouns that end on a noun, as texts, of words and their tags."""
    at = lambda i: F.substring(t, i, F.lit(1))
    inside = lambda i: at(i).isin("A", "N", "9")
    starts = F.filter(F.sequence(F.lit(1), F.length(t)), lambda i: inside(i) & ((i == 1) | ~inside(F.greatest(i - 1, F.lit(1)))))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(ws, i, F.length(F.regexp_extract(F.substring(t, i, F.length(t)), "^[A9N]*N", 0))), " "))
    return F.when(F.length(t) > 0, F.filter(runs, lambda r: r != "")).otherwise(F.array().cast("array<string>"))


def noun_chunks(ws: Column) -> Column:
    return let(tags(ws), lambda t: chunks_of(ws, t))


def first_noun_chunk(content: Column, most: int = 6) -> Column:
    """A chunk of a passage as a label: the first that is capitalised and has two words; else the first with an acronym or
    a number; else the first of two words; else the first; '' if there is none."""

    def chosen(chunks: Column) -> Column:
        several = lambda c: c.contains(" ")
        pick = lambda test: F.try_element_at(F.filter(chunks, test), F.lit(1))
        return F.coalesce(pick(lambda c: several(c) & c.rlike(r"^\p{Lu}")), pick(lambda c: c.rlike(r"[A-Z]{2,}|(?<![A-Za-z])\d")), pick(several), F.try_element_at(chunks, F.lit(1)), F.lit(""))

    return let(tokens(F.substring(content, 1, 2000)), lambda ws: let(F.transform(noun_chunks(ws), lambda c: F.array_join(F.slice(F.split(c, " "), 1, most), " ")), chosen))
