"""Text patterns and per-value expressions: numeric-text test (F9) and the
PII catalogue used for detection and redaction (X2-X5).

Patterns stay in the subset that Java regex and RE2 read alike (no
look-around, no back-references, no \\b — Java's \\b is Unicode-aware and
RE2's is ASCII, so matches next to accented letters would differ).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: pandas ``to_numeric`` grammar (empty string accepted,
# blanks-only rejected, signs, decimals, exponents, inf/infinity).
NUMERIC_TEXT_PATTERN = (
    r"(?i)^(|[ \t\n\r\f]*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?"
    r"|[+-]?inf(inity)?)[ \t\n\r\f]*)$")

# The PII catalogue.  Each entry:
# type, candidate pattern, pattern of a valid candidate (None: all are),
# checksum.  A candidate takes in the whole run of digits (or letters and
# digits) that it stands in, so nothing is cut out of a longer number; a run of
# several numbers with blanks between is also searched for card numbers.
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PHONE = r"(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
PII_PATTERNS: list[tuple[str, str, str | None, str | None]] = [
    ("IBAN_CODE", r"[A-Z]{2}[0-9]{2}( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?|[A-Za-z0-9]+",
     r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,38}$", "mod97"),
    ("CREDIT_CARD", r"[0-9]([ -]?[0-9])*", r"^[0-9]([ -]?[0-9]){12,18}$", "luhn"),
    ("US_SSN", r"[0-9]+(-[0-9]+)*", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", None),
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", None, None),
    ("URL", r"https?://[^ \t\n\r<>\"']+", None, None),
    ("IP_ADDRESS", r"[0-9]+(\.[0-9]+)*", rf"^{_OCTET}(\.{_OCTET}){{3}}$", None),
    ("PHONE_NUMBER", rf"[0-9]*{_PHONE}[0-9]*", rf"^{_PHONE}$", None),
]
# A card number inside a longer run, between blanks or the run's ends.
_CARD = r"([0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})"
PII_TYPES = [t for t, *_ in PII_PATTERNS]


# Cheap necessary conditions checked before the full pattern (a row that
# fails its guard cannot hold a valid candidate), so the costly patterns only
# run on the few rows that may hold one.
PII_GUARDS = {
    "IBAN_CODE": lambda t: t.rlike("[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11}"),
    "CREDIT_CARD": lambda t: t.rlike("[0-9]([ -]?[0-9]){12}"),
    "US_SSN": lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "EMAIL_ADDRESS": lambda t: F.instr(t, "@") > 0,
    "URL": lambda t: F.instr(t, "://") > 0,
    "IP_ADDRESS": lambda t: t.rlike("[0-9][.][0-9]+[.][0-9]+[.][0-9]"),
    "PHONE_NUMBER": lambda t: t.rlike("[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}"),
}
# How sure a valid candidate of each type is.  Where candidates
# overlap the higher score wins, at equal scores the earlier type.
PII_SCORES = {"IBAN_CODE": 1.0, "CREDIT_CARD": 1.0, "US_SSN": 0.85, "EMAIL_ADDRESS": 1.0,
              "URL": 0.6, "IP_ADDRESS": 0.6, "PHONE_NUMBER": 0.4}
_SPANS = "array<struct<start:int,stop:int,type:string>>"


def _mod97(value: Column) -> Column:
    """The account number's check: first four characters moved to the end,
    letters read as 10 to 35, the remainder by 97 is 1."""
    s = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4))
    code = lambda i: F.ascii(moved.substr(i, F.lit(1)))
    step = lambda acc, i: F.when(code(i) >= 65, acc * 100 + code(i) - 55).otherwise(acc * 10 + code(i) - 48) % 97
    return (F.length(s).between(15, 34)
            & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(moved), F.lit(1))), F.lit(0), step) == 1))


def _valid(candidate: Column, shape: str | None, check: str | None) -> Column:
    ok = candidate.rlike(shape) if shape else F.lit(True)
    if check == "luhn":
        return F.when(ok, _luhn(candidate)).otherwise(False)
    if check == "mod97":
        return F.when(ok, _mod97(candidate)).otherwise(False)
    return ok


def _luhn(candidate: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(candidate, "[ -]", ""))


def _cards(run: Column) -> Column:
    """The card numbers between blanks in a run that is none as a whole, from
    the left: array of struct(start, stop) in the run, from 0."""
    def step(acc: Column, group: Column) -> Column:
        # pos: where the group begins; at: what is not yet part of a card
        card = F.regexp_extract(run.substr(acc["pos"], F.length(run)), f"^{_CARD}( |$)", 1)
        starts = (acc["pos"] >= acc["at"]) & ((acc["pos"] == 1) | (run.substr(acc["pos"] - 1, F.lit(1)) == " "))
        hit = F.when(starts & (card != ""), _luhn(card)).otherwise(False)
        span = F.struct((acc["pos"] - 1).alias("start"), (acc["pos"] - 1 + F.length(card)).alias("stop"))
        return F.struct(
            (acc["pos"] + F.length(group) + 1).alias("pos"),
            F.when(hit, acc["pos"] + F.length(card)).otherwise(acc["at"]).alias("at"),
            F.when(hit, F.concat(acc["cards"], F.array(span))).otherwise(acc["cards"]).alias("cards"))

    start = F.struct(F.lit(1).alias("pos"), F.lit(1).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("cards"))
    return F.aggregate(F.split(run, "[ -]", -1), start, step, lambda acc: acc["cards"])


def _may_hold_cards(run: Column) -> Column:
    return run.rlike(f"(^| ){_CARD}( |$)")


def _candidates(text: Column, pii_type: str) -> Column:
    """Spans of the valid candidates of one type, in order: the pieces of text
    between the candidates say where each of them stands."""
    _, pattern, shape, check = next(p for p in PII_PATTERNS if p[0] == pii_type)
    none = F.array().cast(_SPANS)
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("run"))

    def step(acc: Column, pair: Column) -> Column:
        at, run = acc["at"] + F.length(pair["piece"]), pair["run"]
        span = lambda a, b: F.struct(a.alias("start"), b.alias("stop"), F.lit(pii_type).alias("type"))
        hits = F.when(_valid(run, shape, check), F.array(span(at, at + F.length(run))))
        if check == "luhn":
            hits = hits.when(_may_hold_cards(run), F.transform(_cards(run), lambda c: span(at + c["start"], at + c["stop"])))
        # one piece of text more than candidates: the last has no partner
        return F.struct((at + F.coalesce(F.length(run), F.lit(0))).alias("at"),
                        F.when(run.isNotNull() & (F.size(hits) > 0), F.concat(acc["spans"], hits)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(PII_GUARDS[pii_type](text), F.aggregate(pairs, start, step, lambda acc: acc["spans"])).otherwise(none)


def pii_spans(text: Column, types: Sequence[str] | None = None) -> Column:
    """Array of struct(start, stop, type), code points from 0, by
    start: the valid candidates of all types, those that overlap a surer one
    left out (``PII_SCORES``).  Findings and redaction both read these spans.
    ``text`` should be a column reference, not a nested expression; null has
    none.  Row-stateless, so it also applies to a streaming DataFrame."""
    wanted = [t for t in PII_TYPES if types is None or t in types]
    none = F.array().cast(_SPANS)
    if not wanted:
        return none
    by_score = sorted(wanted, key=lambda t: -PII_SCORES[t])        # stable: at equal scores the earlier type
    overlaps = lambda s: lambda k: (k["start"] < s["stop"]) & (s["start"] < k["stop"])
    chosen = F.aggregate(F.array(*[_candidates(text, t) for t in by_score]), none,
                         lambda kept, spans: F.concat(kept, F.filter(spans, lambda s: ~F.exists(kept, overlaps(s)))))
    return F.coalesce(F.array_sort(chosen), none)


def span_texts(text: Column, spans: Column, pii_type: str) -> Column:
    """The matches of one type."""
    own = F.filter(spans, lambda s: s["type"] == pii_type)
    return F.transform(own, lambda s: text.substr(s["start"] + 1, s["stop"] - s["start"]))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by ``<TYPE>`` at its place."""
    before = lambda i: F.when(i > 0, F.get(spans, i - 1)["stop"]).otherwise(0)
    parts = F.transform(spans, lambda s, i: F.concat(text.substr(before(i) + 1, s["start"] - before(i)), F.lit("<"), s["type"], F.lit(">")))
    rest = text.substr(F.element_at(spans, -1)["stop"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)
