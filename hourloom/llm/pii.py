"""Personal data by patterns, checksums and context, in DataFrame functions only (operator 4).

Patterns propose spans, validators confirm them (parts of an address, lengths, Luhn, mod 97), and words near a span raise its
score. Spans of the base kinds always stay; spans of the further kinds stay at MIN_SCORE or more.

The further kinds are bank account numbers, social security numbers and secrets (long mixed strings near a word for a key).

Positions are code points, ends exclusive, counted from the lengths of what lies between matches. The patterns match what the
contract's patterns match: possessive repeats where nothing after them could make them give back, and a look behind (or the end of the match
before) where a match could only begin with its run of characters, so no text takes quadratic time or deep recursion.

Null is as ''. Rows are independent: repeated rows, ties and other columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each kind looks like, in the order of the kinds, the contract's four first.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,200}+=?=?(?![A-Za-z0-9_+/=-])",
}
BASE = ("email", "ip", "card", "phone")
# Score of a confirmed span, words that raise it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "secret": 0.4}
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|address|host|server", "card": "card|visa|credit|pay", "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|konto|cuenta|compte", "ssn": "ssn|social security",
    "secret": "token|secret|passw|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credential|akia[0-9a-z]{16}|gh[pousr]_|eyj",
}
CONTEXT_CHARS, CONTEXT_SCORE, MIN_SCORE = 40, 0.3, 0.6
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
SPAN = "array<struct<kind:string,start:long,end:long,value:string,score:double>>"
SLICE = 256


def luhn(digits: Column) -> Column:
    def weigh(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    each = F.transform(F.split(F.reverse(digits), "(?<=[0-9])(?=[0-9])"), weigh)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    value = F.transform(F.split(moved, "(?<=.)(?=.)"), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97) == 1


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(value, " ", ""))
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, not at each place that names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(steps: Column) -> Column:
    """Running sums of an array. Appending to a long array copies it, so sums are run over slices of SLICE elements, and over the slices: time follows the length."""
    none = F.array().cast("array<long>")

    def run(values: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(values, state, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"] + x).alias("out")), lambda a: a["out"])

    zero = F.lit(0).cast("long")

    def sliced(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / SLICE).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * SLICE + 1, F.lit(SLICE)))

    def total(values: Column) -> Column:
        return F.aggregate(values, zero, lambda a, x: a + x)

    def joined(slices: Column) -> Column:
        ends = run(F.transform(slices, total), zero)
        return F.flatten(F.transform(F.arrays_zip(slices.alias("c"), ends.alias("e")), lambda z: run(z["c"], z["e"] - total(z["c"]))))

    return F.when(F.size(steps) > 0, let(steps, lambda v: let(sliced(v), joined))).otherwise(none)


def placed(kind: str, text: Column, found: Column) -> Column:
    """Matches with their places and scores, those that fail dropped. What is near a match are CONTEXT_CHARS characters on both sides, as far as the next match of its kind."""
    n = F.size(found)
    between = F.split(text, PATTERNS[kind], -1)
    before, after = F.slice(between, F.lit(1), n), F.slice(between, F.lit(2), n)
    steps = F.transform(before, lambda gap, i: (F.length(gap) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)).cast("long"))
    rows = F.arrays_zip(found.alias("value"), running(steps).alias("start"), before.alias("before"), after.alias("after"))

    def span(x: Column) -> Column:
        near = F.lower(F.concat(F.substring(x["before"], -CONTEXT_CHARS, CONTEXT_CHARS), x["value"], F.substring(x["after"], 1, CONTEXT_CHARS)))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})"), F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value"), F.least(score, F.lit(1.0)).alias("score"))

    spans = F.transform(F.filter(rows, lambda x: confirmed(kind, x["value"])), span)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= MIN_SCORE)
    return F.when(n > 0, spans).otherwise(F.array().cast(SPAN))


def find_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with pii (in the place of a column of that name): array of kind, start, end, value and score, by kind in the order of PATTERNS, then by start."""
    text = F.col("__text")
    out = df.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # candidates in a projection of their own, so that each pattern is searched once
    need = {"email": F.instr(text, "@") > 0, "phone": F.instr(text, "+") > 0}
    found = {k: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    found["card"] = F.filter(found["card"], lambda v: F.length(v) > 0)
    out = out.withColumns({f"__{k}": F.when(need.get(k, F.lit(True)), v).otherwise(F.array().cast("array<string>")) for k, v in found.items()})
    # a document without long enough digit runs needs no places of cards
    has_card = F.exists("__card", lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(16, 19))
    out = out.withColumn("__card", F.when(has_card, F.col("__card")).otherwise(F.array().cast("array<string>")))
    spans = F.concat(*[placed(k, text, F.col(f"__{k}")) for k in PATTERNS])
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != "pii"], spans.alias("pii"))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the number of spans of each base kind, sha256 of the base spans, all spans as text."""
    spans = find_pii(df.select(id_col, text_col), text_col)
    text = F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.filter(text, lambda t: t.rlike(f"^(?:{'|'.join(BASE)}):"))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return spans.select(id_col, *counts, F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", text).alias("spans"))
