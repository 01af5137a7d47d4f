"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One pattern finds candidates in a text; every candidate is validated by its kind
(checksums, ranges of octets, areas and calendar days) and, if valid, permuted
within its format by a keyed Feistel network: digits stay digits, letters stay
letters, separators, country codes, domains and checksums stay what they are. The
permutation depends on the key, the kind and the characters only, so equal values
get equal pseudonyms in every document and different ones different pseudonyms.
Candidates that fail validation are left as they are.

Numbers next to one another: a card candidate is the whole chain of digit groups, up
to where an ip, date, ssn or phone begins. In it, at each group from the left, bare
numbers and runs of groups of four digits or more (the last may be shorter) with one
kind of separator are tried, 16 digits first, then longer before shorter; a chain
without such a card is tried as a whole. An IBAN has its country's length; where that
is unknown or does not fit, the longest run of groups that is valid counts. A phone
has 10 digits behind +1; others stop before another kind or a card in groups of four,
if they are long enough by then, and in any case at 15 digits.

Kinds: email (the local part), iban (mod 97), card (Luhn), ssn, ip (version 4),
date (1900 to 2099, as YYYY-MM-DD, D.M.YYYY or D/M/YYYY, or month first where only
that is a day; a day stays on its side of the twelfth), phone, secret (a value
that is assigned to a token, key or password).

Defined cases: null text stays null and counts 0; empty text and text without
candidates stay as they are; every other column is kept; repeated rows are
treated each. Letters and digits of an address move within their script (ALPHABETS, RANGES);
characters of other scripts stay, and an address of these alone is no replacement.
There is no shuffle and no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN_EXACT = "|".join(f"(?:{c.replace(' ', '|')})" + r"\d{2}(?: ?[A-Z0-9]{4}){" + str(n // 4 - 1) + "}" + (f"(?: ?[A-Z0-9]{{{n % 4}}})" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
_IP = _EDGE + r"(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)" + _END
_DATE = _EDGE + r"(?<!\d[./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?:\.\d{1,2}\.|/\d{1,2}/)\d{4})(?![./-]?\d)" + _END
_SSN = _EDGE + r"(?<!\d-)\d{3}-\d{2}-\d{4}(?!-?\d)" + _END
_LOCAL_PHONE = r"(?<![\p{L}\p{N}+.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + _END
#: An international phone: of North America, up to where another kind begins, or as long as it gets.
_CODE, _MOST = r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})", r"(?<!\d" + r"[ .()-]{0,2}\d" * 15 + ")"
_STOPS = f"(?!{_IP}|{_DATE}|{_SSN}|{_LOCAL_PHONE}|{_EDGE}" + r"\d{4}(?:[ -]\d{4}){3}" + _END + ")"
_NORTH_AMERICA = r"(?<![\p{L}\p{N}+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}" + _END
_PHONE = f"{_NORTH_AMERICA}|{_CODE}(?:[ .-]?{_STOPS}" + r"\d{2,4}){2,4}" + f"{_END}{_MOST}|{_CODE}" + r"(?:[ .-]?\d{2,4}){2,4}" + f"{_END}{_MOST}|{_LOCAL_PHONE}"
#: A digit group of a chain; chains stop where another kind begins.
_GROUP = r"\d++" + _END
_OTHER = f"(?!{_IP}|{_DATE}|{_SSN}|{_LOCAL_PHONE})"
#: Patterns by kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": _EDGE + f"(?:{_IBAN_EXACT}|{_IBAN})" + _END,
    "ip": _IP,
    "date": _DATE,
    "ssn": _SSN,
    "phone": _PHONE,
    "secret": r"(?<=(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Kk]ey|KEY)\s?[=:]\s?[\"'])[A-Za-z0-9_-]{16,}(?=[\"'])",
    "card": _EDGE + r"(?=\d(?:[ -]?\d){12})" + _GROUP + f"(?:[ -]{_OTHER}{_GROUP})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A card next to other digits: groups of four or more, the last may be shorter; and how many there can be.
_CARD_GROUPS, MOST_GROUPS = r"^\d{4,}(?:([ -])\d{4,}(?:\1\d{4,})*(?:\1\d{1,3})?|[ -]\d{1,3})?$", 5
#: Days from 1900-01-01 to 2099-12-31, and their factors.
FIRST_DAY, DAYS, DAY_RADIX = "1900-01-01", 73_049, 17
#: Steps in which a walk over days has come back: a step does not with a chance of 0.6 at most.
WALK = 128


def _hash(key: Column, *parts: Column) -> Column:
    """60 bits of a keyed digest as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def feistel_pair(key: Column, kind: str, a: Column, b: Column, mod_a, mod_b) -> Column:
    """Struct (a, b): a keyed permutation of Z_mod_a x Z_mod_b in alternating rounds."""
    as_long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    ma, mb = as_long(mod_a), as_long(mod_b)

    def step(s: Column, r: Column) -> Column:
        left = F.pmod(s["a"] + _hash(key, F.lit(kind), r, s["b"]), ma)
        right = F.pmod(s["b"] + _hash(key, F.lit(kind), r, s["a"]), mb)
        return F.when(r % 2 == 0, F.struct(left.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), right.alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _char(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")


def feistel_text(key: Column, kind: str, text: Column, alphabets: list[str], ranges: list[tuple[int, int]] = ()) -> Column:
    """Permutes a short string, each character within the first alphabet or range that holds it.

    The halves take turns: every character of one is shifted in its alphabet by a
    keyed digest of the other half, its place and the round.
    """

    def shift(half: Column, other: Column, r: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            h = _hash(key, F.lit(kind), r, i, other)
            out = c
            point = F.ascii(c).cast("long")  # the whole code point
            for lo, hi in reversed(ranges):
                out = F.when(point.between(lo, hi), _char(F.lit(lo) + F.pmod(point - lo + h, F.lit(hi - lo + 1).cast("long")))).otherwise(out)
            for letters in reversed(alphabets):
                at = F.call_function("locate", c, F.lit(letters))
                moved = F.call_function("substr", F.lit(letters), (F.pmod(at - 1 + h, F.lit(len(letters)).cast("long")) + 1).cast("int"), F.lit(1))
                out = F.when(at > 0, moved).otherwise(out)
            return out

        return F.array_join(F.transform(F.call_function("regexp_extract_all", half, F.lit("(?s)."), F.lit(0)), one), "")

    cut = F.floor(F.length(text) / 2).cast("int")

    def step(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(shift(s["a"], s["b"], r).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), shift(s["b"], s["a"], r).alias("b")))

    start = F.struct(F.substring(text, F.lit(1), cut).alias("a"), F.substring(text, cut + 1, F.length(text)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order."""
    chars = F.call_function("regexp_extract_all", template, F.lit("(?s)."), F.lit(0))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of a digit string; from the right, every second digit is doubled."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = (i % 2 == 0) if doubled_last else (i % 2 == 1)
        return total + F.when(twice, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)


def mod97(text: Column) -> Column:
    """Remainder by 97 of capital letters and digits, letters read as 10 to 35."""
    chars = F.call_function("regexp_extract_all", text, F.lit("."), F.lit(0))

    def step(rem: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.when(digit, (rem * 10 + F.ascii(c) - 48) % 97).otherwise((rem * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(chars, F.lit(0), step)


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = [_DIGITS, _LOWER, _UPPER, "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
#: Runs of letters or digits by code point: Latin, Greek and Cyrillic (small, then capital), Hebrew, Arabic, Devanagari, Thai, kana, ideographs, Hangul.
RANGES = [
    (0x100, 0x17F), (0x180, 0x24F), (0x3B1, 0x3C9), (0x391, 0x3A1), (0x430, 0x45F), (0x400, 0x42F), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x660, 0x669),
    (0x904, 0x939), (0x966, 0x96F), (0xE01, 0xE30), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]
#: A character that a permutation can move.
_MOVED = "[" + "".join(ALPHABETS) + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in RANGES) + "]"


def _date_parts(m: Column) -> tuple[Column, Column]:
    """(ISO text, layout) of a date; day first unless only month first is a day."""
    a, b, y = (F.regexp_extract(m, r"^(\d{1,2})([./])(\d{1,2})[./](\d{4})$", i) for i in (1, 3, 4))
    iso = lambda month, day: F.concat_ws("-", y, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    day_first = F.call_function("try_to_date", iso(b, a), F.lit("yyyy-MM-dd"))
    month_first = F.call_function("try_to_date", iso(a, b), F.lit("yyyy-MM-dd"))
    plain = F.call_function("try_to_date", m, F.lit("yyyy-MM-dd"))
    is_iso = m.rlike(r"^\d{4}-")
    return F.when(is_iso, plain).otherwise(F.coalesce(day_first, month_first)), F.when(is_iso, "iso").when(day_first.isNotNull(), "day").otherwise("month")


def walked_day(key: Column, number: Column) -> Column:
    """The day that a day (counted from the first) is permuted to, among those on whose side of the twelfth it is.

    The permutation of all days is applied until it comes back to that side, which makes
    another permutation. Days behind the twelfth are the ones that can be written month
    first and no other way, so that what is read month first is written so that it is again.
    """
    date = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
    late = lambda n: F.dayofmonth(date(n)) > 12

    def walk(s: Column, _: Column) -> Column:
        pair = feistel_pair(key, "date", s["at"] % DAY_RADIX, F.floor(s["at"] / DAY_RADIX), DAY_RADIX, DAYS // DAY_RADIX)
        moved = F.transform(F.array(pair), lambda x: x["b"] * DAY_RADIX + x["a"])
        return F.when(s["there"], s).otherwise(F.transform(moved, lambda n: F.struct(n.alias("at"), (late(n) == late(number)).alias("there")))[0])

    start = F.struct(number.cast("long").alias("at"), F.lit(False).alias("there"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, walk, lambda s: date(s["at"]))


def card_ok(m: Column) -> Column:
    d = digits_of(m)
    return F.length(d).between(13, 19) & (luhn_sum(d, False) % 10 == 0)


def card_pseudonym(m: Column, key: Column) -> Column:
    d = digits_of(m)
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    card = F.transform(F.array(feistel_text(key, "card", body, [_DIGITS])), lambda x: F.concat(x, ((10 - luhn_sum(x, True) % 10) % 10).cast("string")))[0]
    return refill(m, card)


def iban_ok(m: Column) -> Column:
    bare = F.regexp_replace(m, " ", "")
    return mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1


def iban_pseudonym(m: Column, key: Column) -> Column:
    bare = F.regexp_replace(m, " ", "")
    country = F.substring(bare, 1, 2)
    moved = feistel_text(key, "iban", F.substring(bare, F.lit(5), F.length(bare)), [_DIGITS, _UPPER])
    check = F.lpad((F.lit(98) - mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
    made = F.concat(country, check, moved)
    return F.when(m.contains(" "), F.regexp_replace(made, "(.{4})(?=.)", "$1 ")).otherwise(made)


def cards_in(chain: Column, key: Column) -> Column:
    """Struct (kinds, text) of a chain of digit groups: the cards among them, from the left."""
    groups = F.call_function("regexp_extract_all", chain, F.lit(r"[ -]?\d+"), F.lit(0))
    # by single elements: a slice would copy the whole array each time
    few = lambda g, at, n: F.concat_ws("", *[F.try_element_at(g, at + k) for k in range(n)])
    joined = lambda g, at, n: F.when(n > 0, F.array_join(F.transform(F.sequence(at, at + n - 1), lambda k: F.element_at(g, k)), "")).otherwise("")

    def hits(g: Column) -> Column:
        """(at, n, text) of the best card at each group that begins one; at counts from 0."""

        def best(x: Column, i: Column) -> Column:
            tries = F.array(*[F.struct(i.alias("at"), F.least(F.lit(n), F.size(g) - i).alias("n"), F.regexp_replace(few(g, i + 1, n), "^[ -]", "").alias("text")) for n in range(1, MOST_GROUPS + 1)])
            valid = F.filter(tries, lambda t: F.when(F.length(digits_of(t["text"])).between(13, 19) & t["text"].rlike(_CARD_GROUPS), card_ok(t["text"])).otherwise(F.lit(False)))
            common = F.filter(valid, lambda t: F.length(digits_of(t["text"])) == 16)
            return F.when(x.rlike(r"\d{4}"), F.coalesce(F.try_element_at(common, F.lit(1)), F.try_element_at(valid, F.lit(-1))))

        return F.filter(F.transform(g, best), lambda h: h.isNotNull())

    def taken(h: Column) -> Column:
        """Those that begin behind the one before."""
        none = F.slice(h, 1, 0)
        step = lambda s, x: F.when(x["at"] >= s["end"], F.struct((x["at"] + x["n"]).alias("end"), F.concat(s["of"], F.array(x)).alias("of"))).otherwise(s)
        return F.aggregate(h, F.struct(F.lit(0).alias("end"), none.alias("of")), step, lambda s: s["of"])

    def text(g: Column, of: Column) -> Column:
        end = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.element_at(of, F.greatest(j, F.lit(1)))["at"] + F.element_at(of, F.greatest(j, F.lit(1)))["n"])
        lead = lambda x: F.regexp_extract(F.element_at(g, x["at"] + 1), "^[ -]?", 0)
        parts = F.transform(of, lambda x, j: F.concat(joined(g, end(j) + 1, x["at"] - end(j)), lead(x), card_pseudonym(x["text"], key)))
        last = end(F.size(of))
        return F.concat(F.array_join(parts, ""), joined(g, last + 1, F.size(g) - last))

    def whole(g: Column, of: Column) -> Column:
        some = F.struct(F.transform(of, lambda x: F.lit("card")).alias("kinds"), text(g, of).alias("text"))
        one = F.struct(F.array(F.lit("card")).alias("kinds"), card_pseudonym(chain, key).alias("text"))
        return F.when(F.size(of) > 0, some).when(F.coalesce(F.when(F.length(chain) < 38, card_ok(chain)), F.lit(False)), one).otherwise(F.struct(F.array().cast("array<string>").alias("kinds"), chain.alias("text")))

    return F.transform(F.array(groups), lambda g: F.transform(F.array(taken(hits(g))), lambda of: whole(g, of))[0])[0]


def iban_in(m: Column, key: Column) -> Column:
    """Struct (kinds, text): the longest valid IBAN that the candidate begins with, up to a space."""
    parts = F.split(m, " ")
    starts = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), " "))
    valid = F.filter(starts, lambda t: F.when(t.rlike(f"^{_IBAN}$"), iban_ok(t)).otherwise(F.lit(False)))
    some = lambda t: F.struct(F.array(F.lit("iban")).alias("kinds"), F.concat(iban_pseudonym(t, key), F.substring(m, F.length(t) + 1, F.length(m))).alias("text"))
    none = F.struct(F.array().cast("array<string>").alias("kinds"), m.alias("text"))
    return F.coalesce(F.try_element_at(F.transform(F.slice(valid, 1, 1), some), F.lit(1)), none)


def replaced(m: Column, key: Column) -> Column:
    """Struct (kinds, text) of one candidate: what is valid in it, and the text with that replaced."""
    one = F.transform(F.array(pseudonym(m, key)), lambda p: F.struct(F.filter(F.array(p["kind"]), lambda k: k.isNotNull()).alias("kinds"), p["text"].alias("text")))[0]
    return F.when(m.rlike(r"^\d(?:[ -]?\d){12}[ \d-]*+$"), cards_in(m, key)).when(m.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]+$"), iban_in(m, key)).otherwise(one)


def pseudonym(m: Column, key: Column) -> Column:
    """Struct (kind, text) of one candidate that is neither card nor IBAN; kind is null where it is not valid."""
    d = digits_of(m)
    n = F.length(d)
    kinds: list[tuple[str, Column, Column, Column]] = []  # kind, shape, valid, pseudonym

    local, domain = F.substring_index(m, "@", 1), F.regexp_extract(m, "(?s)@.*$", 0)
    kinds.append(("email", m.contains("@"), local.rlike(_MOVED), F.concat(feistel_text(key, "email", local, ALPHABETS, RANGES), domain)))

    o = F.split(m, r"\.")
    octet = lambda i: F.element_at(o, i).cast("int")
    two = feistel_pair(key, "ip", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536)
    ip = F.transform(F.array(two), lambda s: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)]))[0]
    kinds.append(("ip", m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.forall(o, lambda x: x.cast("int") <= 255), ip))

    day, layout = _date_parts(m)
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    shifted = F.array(walked_day(key, number))
    sep = F.regexp_extract(m, "[./]", 0)
    padded = m.rlike(r"^0|^\d{2}[./]0")
    one_or_two = lambda x: F.when(padded, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    dated = F.transform(shifted, lambda x: F.when(layout == "iso", F.date_format(x, "yyyy-MM-dd")).when(layout == "day", F.concat(one_or_two(F.dayofmonth(x)), sep, one_or_two(F.month(x)), sep, F.year(x).cast("string"))).otherwise(F.concat(one_or_two(F.month(x)), sep, one_or_two(F.dayofmonth(x)), sep, F.year(x).cast("string"))))[0]
    kinds.append(("date", m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{1,2}([./])\d{1,2}\2\d{4})$"), number.between(0, DAYS - 1), dated))

    area = F.substring(d, 1, 3).cast("int")
    ssn_ok = ~area.isin(0, 666) & (area < 900) & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
    # 898 areas (1 to 899 without 666), 99 groups, 9999 serials: permuted as two numbers
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    ssn_two = feistel_pair(key, "ssn", rank, (F.substring(d, 4, 2).cast("int") - 1) * 9999 + F.substring(d, 6, 4).cast("int") - 1, 898, 99 * 9999)
    ssn = F.transform(F.array(ssn_two), lambda s: F.concat_ws("-", F.lpad((F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1)).cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0")))[0]
    kinds.append(("ssn", m.rlike(r"^\d{3}-\d{2}-\d{4}$"), ssn_ok, ssn))

    code = F.length(digits_of(F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)))
    phone = F.concat(F.substring(d, F.lit(1), code), feistel_text(key, "phone", F.substring(d, code + 1, n), [_DIGITS]))
    kinds.append(("phone", m.rlike(r"^[+(\d][\d ().-]+$"), n.between(7, 15), refill(m, phone)))

    hexed = feistel_text(key, "secret", m, ["0123456789abcdef"])
    kinds.append(("secret", m.rlike(r"^[A-Za-z0-9_-]{16,}$"), F.lit(True), F.when(m.rlike("^[0-9a-f]+$"), hexed).otherwise(feistel_text(key, "secret", m, [_DIGITS, _LOWER, _UPPER]))))

    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))
    for kind, shape, valid, text in reversed(kinds):
        out = F.when(shape, F.when(F.coalesce(valid, F.lit(False)), F.struct(F.lit(kind).alias("kind"), text.alias("text"))).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text")))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """The documents with personal data in `text_col` replaced; other columns stay.

    Whoever has the key can invert the pseudonyms: keep it apart from the documents.

    `found_col` names an array column of the kinds that were replaced, if wanted.
    """
    text = F.col(text_col)
    may = text.rlike("[0-9@\"']")
    found = F.when(may, F.call_function("regexp_extract_all", text, F.lit(ANY), F.lit(0)))
    marked = docs.withColumn("__loom_found", found)
    some = F.size("__loom_found") > 0
    marked = marked.withColumn("__loom_new", F.when(some, F.transform("__loom_found", lambda m: replaced(m, F.lit(key)))))
    between = F.call_function("split", text, F.lit(ANY), F.lit(-1))
    joined = F.array_join(F.zip_with(between, F.concat(F.transform("__loom_new", lambda x: x["text"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    out = marked.withColumn(text_col, F.when(some, joined).otherwise(text))
    if found_col:
        kinds = F.flatten(F.transform("__loom_new", lambda x: x["kinds"]))
        out = out.withColumn(found_col, F.coalesce(F.when(some, kinds), F.array().cast("array<string>")))
    return out.drop("__loom_found", "__loom_new")
