"""Secrets in texts, and whose they are: DataFrame functions only.

Three base rules find assignments, access keys and hex strings. Which of these are secrets
of someone, and what else is one, the whole corpus decides: every candidate (an assigned
value or a long token) is hashed, hashes are counted by distinct repositories and
distinct owners, and a candidate that looks alive (letters and digits mixed, many
different characters) and that few owners hold is a `live` span of every document that
has it, with or without a keyword in front. What many owners hold is a copied example;
it stays a base span where it is one, and is counted apart.

Spans come from one split of a text at the matches of a rule and the matches themselves:
their lengths, summed up, are the places. Sums run in blocks of BLOCK matches, so that a
text with very many of them does not copy an array for each.

A text is scanned once; places and hashes are written to the shared folder, values are
not. Counts go by (hash, owner, repository), then (hash, owner), then hash, each summed
before it is shuffled, so that a value in most documents is one row for each task; its
verdict is broadcast, as those of fewer than HOT values are, and others are joined by
hash. Only documents with candidates are shuffled, as places.

Defined cases: null text is empty; null owners and repositories are one of each; texts without
a match have no spans and the hash of the empty string; equal rows and equal ids are
rows of their own; a match that fails its least length is dropped and what it covered is
not looked at again; letters of keywords count in either case in ASCII only; places are
code points; an empty table gives no rows; any text length. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import join_unique, materialise

#: Base rules in the order in which kinds are listed: pattern, group that is measured, its least length. Fixed values.
#: Runs take in all they can, so that of a run without a group of its own the least length can stand in the pattern: what
#: is too short is not found instead of being dropped, and what it covers holds no longer one.
RULES = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
#: What a text must hold, in small letters, for a rule to be tried on it.
HINTS = {"assign": ["password", "passwd", "secret", "token", "apikey", "api_key"], "access": ["akia"]}
KINDS = [*RULES, "live"]
#: A candidate besides assigned values, and what makes one look alive: so many digits behind letters, so many different characters.
TOKEN, LEAST_TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", 16
MIXED, LEAST_MIXED, LEAST_DISTINCT = "[A-Za-z][0-9]", 2, 8
#: A value of more owners, or of more repositories, is a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 5
BLOCK = 256

_NONE = "array<struct<start:int,end:int,value:string>>"


def _once(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(steps: Column) -> Column:
    """Ends of consecutive steps: running sums in blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))

    def sums(values: Column, start: Column) -> Column:
        first = F.struct(F.array().cast("array<int>").alias("out"), start.cast("int").alias("at"))
        return F.aggregate(values, first, lambda s, x: F.struct(F.concat(s["out"], F.array(s["at"] + x)).alias("out"), (s["at"] + x).alias("at")), lambda s: s["out"])

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        before = F.concat(F.array(F.lit(0)), sums(totals, F.lit(0)))
        return _once(before, lambda at: F.flatten(F.transform(parts, lambda p, i: sums(p, F.get(at, i)))))

    return F.when(F.size(steps) > 0, _once(blocks, joined)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value) of a pattern's matches, left to right: the places of matches, the values of a group."""
    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), all_of(0).alias("hits"), (all_of(group) if group else F.lit(None)).alias("values"))

    def found(p: Column) -> Column:
        lengths = F.transform(p["hits"], lambda h: F.length(h))
        steps = F.transform(lengths, lambda n, i: n + F.length(F.get(p["gaps"], i)))
        value = (lambda i: F.get(p["values"], i)) if group else (lambda i: F.get(p["hits"], i))
        return _once(_places(steps), lambda ends: F.transform(ends, lambda e, i: F.struct((e - F.length(F.get(p["hits"], i))).alias("start"), e.alias("end"), value(i).alias("value"))))

    return F.when(text.rlike(pattern), _once(parts, found)).otherwise(F.array().cast(_NONE))


def _alive(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.regexp_count(value, F.lit(MIXED)) >= LEAST_MIXED) & (distinct >= LEAST_DISTINCT)


def scan(docs: DataFrame, owner: str, repository: str, text_col: str = "text") -> DataFrame:
    """(doc_id, owner, repository, base, candidates) of every row: places by kind, and places and hashes of what looks alive."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whose = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((owner, "owner"), (repository, "repository"))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *whose, text.alias("text"), F.lower(text).alias("low"))

    def of_rule(kind: str, pattern: str, group: int, least: int) -> Column:
        may = F.lit(kind not in HINTS)
        for hint in HINTS.get(kind, []):
            may |= F.col("low").contains(hint)
        found = F.filter(matches(F.col("text"), pattern, group), lambda m: F.length(m["value"]) >= least)
        return F.when(may, found).otherwise(F.array().cast(_NONE))

    def of_kind(name: str, number: int) -> Column:
        return F.transform(name, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))

    for kind, rule in RULES.items():
        rows = rows.withColumn(kind, of_rule(kind, *rule))
    rows = rows.withColumn("token", matches(F.col("text"), TOKEN))
    base = F.flatten(F.array(*[of_kind(k, i) for i, k in enumerate(RULES)]))
    place = lambda m: F.struct((m["end"] - F.length(m["value"])).alias("start"), m["end"].alias("end"), F.substring(F.unhex(F.sha2(m["value"], 256)), 1, 16).alias("hash"))
    candidates = F.array_distinct(F.transform(F.filter(F.concat("assign", "token"), lambda m: _alive(m["value"])), place))
    return rows.select("doc_id", "owner", "repository", F.array_sort(base).alias("base"), candidates.alias("candidates"))


def holders(scanned: DataFrame) -> DataFrame:
    """(hash, owners, repositories, n) of every candidate value: how many distinct owners and repositories hold it, and occurrences."""
    each = scanned.select(F.explode("candidates.hash").alias("hash"), "owner", "repository")
    by_repository = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def find_secrets(docs: DataFrame, owner: str, repository: str, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """(doc_id, owner, repository, base, live, n_copied) of every row: base spans (start, kind, end), spans of owner-specific
    live-looking values, and how many of its candidates are copied examples."""
    scanned = materialise(scan(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()), "secrets")
    counts = materialise(holders(scanned), "holders")
    some = scanned.where(F.size("candidates") > 0)
    each = some.select("row", F.explode("candidates").alias("c")).select("row", "c.start", "c.end", "c.hash")
    copied = (F.col("owners") > most_owners) | (F.col("repositories") > most_repositories)
    span = F.struct("start", F.lit(len(RULES)).alias("kind"), "end")
    told = join_unique(each, counts, "hash", "n").groupBy("row").agg(F.collect_list(F.when(~copied, span)).alias("live"), F.sum(copied.cast("long")).alias("n_copied"))
    with_some = some.join(told, "row").select("doc_id", "owner", "repository", "base", F.array_sort("live").alias("live"), "n_copied")
    none = scanned.where(F.size("candidates") == 0)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return with_some.unionByName(none.select("doc_id", "owner", "repository", "base", empty.alias("live"), F.lit(0).cast("long").alias("n_copied")))


def shown(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text, of what find_secrets gives."""
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(RULES)]
    return found.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.array_sort(F.concat("base", "live"))).alias("spans"), F.size("live").cast("long").alias("n_live"), "n_copied")
