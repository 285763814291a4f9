"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Each kind has a pattern, a validator (digit counts, octet range, Luhn, mod-97)
and a starting score.  Words in the ``CONTEXT`` code points before a span, whatever
earlier spans stand there, raise or lower the score; a span is reported when its score reaches ``THRESHOLD``.  The base kinds start
at the threshold when valid and can't fall below it; the further kinds
(``iban``, ``ssn``, ``secret``) need their checksum or a context word.

Positions come from the pieces between matches: ``split`` and
``regexp_extract_all`` run the same pattern, so the n-th match starts where the
first n pieces and n-1 matches end.  Patterns use possessive runs with a
look-behind (or ``\\G``, the end of the previous match), which finds the
same leftmost matches as the plain form but never rescans a run, so a very
long run of digits or letters costs linear time.

Everything is one projection per row: no shuffle, no join, no Python.

Defined results: null and empty texts have no spans; repeated rows are judged
one by one; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import text_or_empty

THRESHOLD = 0.6
#: Code points before a span that are searched for context words.
CONTEXT = 40
BASE_KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap literal or pattern that a text must hold for the kind to occur.
    needs: str
    #: Score of a valid match, before its context is read.
    start: float
    raises: str = ""
    lowers: str = ""


#: Characters of an IBAN by country: the ISO 13616 registry, and countries that use IBANs without being in it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Exactly as long as the country's IBANs, so that a following word or IBAN is left alone; other codes as far as
    groups go, up to the next IBAN of a known country."""
    def of(length: int, codes: str) -> str:
        groups, rest = divmod(length - 4, 4)
        return (f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}"
                + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    known = "(?:" + "|".join(IBAN_LENGTHS.values()).replace(" ", "|") + ")[0-9]{2}"
    other = (rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:(?: (?!{known}))?[A-Z0-9]{{4}}){{2,7}}"
             rf"(?:(?: (?!{known}))?[A-Z0-9]{{1,3}})?")
    return ("(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(of(n, c) for n, c in IBAN_LENGTHS.items())
            + f"|{other})(?![A-Za-z0-9])")


_DIGITS = r"(?:(?<![0-9])|\G)[0-9]++"

#: Kinds in report order, base kinds first.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "@", 0.9, "mail|contact"),
    Kind("ip", _DIGITS + r"\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.7, "ip|host|server", "version|release"),
    Kind("card", r"[0-9]++(?:[ -][0-9]++)*+", r"[0-9](?:[ -]?[0-9]){11}", 0.8, "card|visa|credit|pay",
         "order|invoice|isbn"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|tel|call|mobile|fax"),
    Kind("iban", _iban_pattern(), r"[A-Z]{2}[0-9]{2}", 0.8, "iban|bank|account"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3,
         "ssn|social security", "order|invoice|part"),
    Kind("secret", r"(?:(?<![A-Za-z0-9_+/-])|\G)[A-Za-z0-9_+/-]{20,}+", r"[A-Za-z0-9_+/-]{20}", 0.3,
         "token|secret|api[ _-]?key|password|credential"),
)


def _only_digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a string of digits."""
    backwards = F.reverse(digits)

    def add(total, i):
        d = F.substr(backwards, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(match: Column) -> Column:
    """ISO 13616 check: first four characters moved to the end, letters as 10..35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(rest, i):
        code = F.ascii(F.substr(moved, i, F.lit(1)))
        value = F.when(code < 65, code - 48).otherwise(code - 55)
        return F.when(code < 65, (rest * 10 + value) % 97).otherwise((rest * 100 + value) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _octets(match: Column) -> Column:
    # a part of up to 255 after its leading zeros
    return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(
        r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _valid(kind: str, match: Column) -> Column:
    digits = _only_digits(match)
    if kind == "ip":
        return _octets(match)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34), mod97(match)).otherwise(False)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def _score(kind: Kind, near: Column) -> Column:
    out = F.lit(kind.start)
    near = F.lower(near)
    if kind.raises:
        out = out + F.when(near.rlike(rf"\b(?:{kind.raises})"), 0.4).otherwise(0.0)
    if kind.lowers:
        out = out - F.when(near.rlike(rf"\b(?:{kind.lowers})"), 0.4).otherwise(0.0)
    if kind.name in BASE_KINDS:
        out = F.greatest(out, F.lit(THRESHOLD))
    return F.round(F.least(out, F.lit(1.0)), 3)


SPAN = "struct<start:int,ord:int,end:int,kind:string,score:double>"


def spans_of(text: Column, kind: Kind) -> Column:
    """Valid spans of one kind with their scores, by start."""
    pieces = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found,
                       lambda before, match: F.struct(before.alias("before"), match.alias("match")))
    order = KINDS.index(kind)
    empty = F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def last(before, more):
        # what stands last before a place; handed on, as cutting it from the text would count from its start each time
        return F.right(F.concat(before, F.right(more, F.lit(CONTEXT))), F.lit(CONTEXT))

    def step(acc, x):
        near = last(acc["tail"], x["before"])
        start = acc["pos"] + F.char_length(x["before"])
        end = start + F.char_length(x["match"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"),
                        F.lit(kind.name).alias("kind"), _score(kind, near).alias("score"))
        hit = F.when(_valid(kind.name, x["match"]), F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))
        return F.struct(end.alias("pos"), last(near, x["match"]).alias("tail"),
                        F.concat(acc["out"], hit).alias("out"))

    hits = F.aggregate(pairs, empty, step, lambda acc: acc["out"])
    may = text.contains(kind.needs) if kind.needs == "@" else text.rlike(kind.needs)
    kept = F.filter(hits, lambda s: s["score"] >= THRESHOLD)
    return F.when(may, kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def join_spans(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind in report order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])),
                        ",")


def find_personal_data(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` with ``out_col``: array of (start, ord, end, kind, score), end exclusive, in code points."""
    text = text_or_empty(F.col(f"`{text_col}`"))
    found = F.concat(*[spans_of(text, k) for k in KINDS])
    return docs.withColumn(out_col, F.array_sort(found))


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``<kind>``; of overlapping spans the first counts."""
    def step(acc, s):
        keep = s["start"] >= acc["pos"]
        gap = F.substr(text, acc["pos"] + 1, s["start"] - acc["pos"])
        piece = F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.when(keep, s["end"]).otherwise(acc["pos"]).alias("pos"),
                        F.when(keep, piece).otherwise(acc["out"]).alias("out"))
    done = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step)
    return F.concat(done["out"], F.substr(text, done["pos"] + 1))


def _is(kind: str):
    return lambda span: span["kind"] == kind


def digest_columns(found: DataFrame, id_col: str = "doc_id", span_col: str = "pii") -> DataFrame:
    """doc_id, the count of each base kind, the digest of the base spans and all spans as text."""
    spans = F.col(span_col)
    base = F.filter(spans, lambda s: s["ord"] < len(BASE_KINDS))
    counts = [F.size(F.filter(spans, _is(n))).cast("long").alias(f"n_{n}") for n in BASE_KINDS]
    return found.select(F.col(id_col), *counts, F.sha2(join_spans(base), 256).alias("base_sha256"),
                        join_spans(spans).alias("spans"))
