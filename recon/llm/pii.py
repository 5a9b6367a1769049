"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Everything is an expression over the text column, so it runs inside the JVM. Positions are counted in
code points: the parts between the matches of a pattern come from splitting the text by it, and a
match starts after all parts and matches before it.

Base kinds (email, ip, card, phone) are kept whenever they are valid. Further kinds are kept where their
score reaches a threshold: ``iban``, confirmed by its mod-97 checksum, and ``pan``, a card number of 13 to
15 digits that passes Luhn and has a word for cards close before it. A score starts from the kind, grows
with such a word and falls with a word that speaks against it, within CONTEXT characters before it
and after the match of its own kind before.

Some patterns differ in form from the plain ones but find the same: a run is only tried at its start,
and never given back, so that a very long run costs no more than its length.

Defined results: a null text counts as empty and has no spans, redaction leaves it null; a null doc_id is
kept; repeated rows are treated each by itself; other columns are not read, and are kept by redaction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.llm.common import bound, texts

CONTEXT = 40
BLOCK = 64
THRESHOLD = 0.5
_LOCAL = "[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    base: bool
    score: float
    words: str
    against: str = "example|sample|version|isbn"


KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, 0.8,
         "mail|e-mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, 0.6, "ip|address|host|server"),
    # A whole run of 16 to 19 digits; a longer one has no part that counts.
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", True, 0.7,
         "card|visa|credit|debit|carte|tarjeta|karte"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", True, 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
         r"(?![A-Za-z0-9])", False, 0.6, "iban|account|bank|konto|compte|cuenta"),
    Kind("pan", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9])", False, 0.3,
         "card|visa|credit|debit|amex|carte|tarjeta|karte"),
)
_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    back = F.reverse(digits(number))

    def value(i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, letters as 10 to 35 and its first four characters last, leaves 1 modulo 97."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        # A part of over three digits after leading zeros is over 255 and would not fit a number.
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substr(p, F.lit(1), F.lit(3)).cast("int") <= 255))
    if kind in ("card", "pan"):
        return luhn(match)
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def score(kind: Kind, before: Column) -> Column:
    """Score of a match by the text just before it."""
    near = F.lower(before)
    return (F.lit(kind.score) + F.when(near.rlike(rf"\b(?:{kind.words})\b"), 0.25).otherwise(0.0)
            - F.when(near.rlike(rf"\b(?:{kind.against})\b"), 0.2).otherwise(0.0))


def located(matches: Column, parts: Column) -> Column:
    """array<struct<start, match, before>> from the matches of a pattern and the parts it splits a text into.

    ``before`` ends the part before the match. Lengths are summed in two steps, within blocks of BLOCK
    matches and over blocks, so that a text of very many matches stays cheap.
    """
    def placed(matches: Column, parts: Column, steps: Column, blocks: Column) -> Column:
        def at(m: Column, i: Column) -> Column:
            upto = F.get(blocks, F.floor(i / BLOCK).cast("int")) + _sum(
                F.slice(steps, i - i % BLOCK + 1, i % BLOCK + 1))
            return F.struct((upto - F.length(m)).alias("start"), m.alias("match"),
                            F.right(F.get(parts, i), F.lit(CONTEXT)).alias("before"))

        return F.transform(matches, at)

    def with_blocks(matches: Column, parts: Column, steps: Column) -> Column:
        last = F.floor((F.size(steps) - 1) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: _sum(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
        before = bound(sums, lambda x: F.transform(x, lambda _, b: _sum(F.slice(x, F.lit(1), b))))
        return bound(before, lambda blocks: placed(matches, parts, steps, blocks))

    def with_steps(matches: Column, parts: Column) -> Column:
        steps = F.transform(matches, lambda m, i: F.length(F.get(parts, i)) + F.length(m))
        return bound(steps, lambda x: with_blocks(matches, parts, x))

    return bound(matches, lambda m: bound(parts, lambda p: with_steps(m, p)))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, n: acc + n)


def find(rows: DataFrame, text: str, spans: str) -> DataFrame:
    """Add ``spans``, an array of (kind, start, end, score) by kind and start, for a text column without nulls.

    Helper columns are dropped again; they are named after ``spans``.
    """
    names = [f"{spans}_{k.name}" for k in KINDS]
    out = rows.withColumns({n: F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)) for n, k in zip(names, KINDS)})
    found = [_spans_of(k, F.col(text), F.col(n)) for n, k in zip(names, KINDS)]
    return out.withColumn(spans, F.concat(*found)).drop(*names)


def _spans_of(kind: Kind, text: Column, matches: Column) -> Column:
    # No pattern matches often; a text without a match is not split at all.
    places = F.when(F.size(matches) > 0, located(matches, F.split(text, kind.pattern, -1)))
    right = F.filter(places, lambda x: valid(kind.name, x["match"]))

    def span(x: Column) -> Column:
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"),
                        (x["start"] + F.length(x["match"])).alias("end"), score(kind, x["before"]).alias("score"))

    scored = F.transform(right, span)
    if not kind.base:
        scored = F.filter(scored, lambda x: x["score"] >= THRESHOLD)
    return F.coalesce(scored, F.array().cast(_SPAN))


def _of_kind(spans: str, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and scores (in the order of the spans)."""
    base = [k.name for k in KINDS if k.base]
    found = find(texts(docs), "text", "found")
    count = {k: F.size(_of_kind("found", [k])).cast("bigint") for k in base}
    return found.select(
        "doc_id", *[count[k].alias(f"n_{k}") for k in base],
        F.sha2(_joined(_of_kind("found", base)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its texts replaced by [kind]; of spans that overlap, the first names all."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = find(rows.withColumn("body", F.coalesce(F.col("row.text"), F.lit(""))), "body", "found")
    spans = F.array_sort("found", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                         .otherwise(b["end"] - a["end"]))

    def step(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["upto"]
        gap = F.concat(acc["done"], F.substr("body", acc["upto"] + 1, s["start"] - acc["upto"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(ahead, gap).otherwise(acc["done"]).alias("done"),
                        F.greatest(acc["upto"], s["end"]).alias("upto"))

    clean = F.aggregate(spans, F.struct(F.lit("").alias("done"), F.lit(0).alias("upto")), step,
                        lambda acc: F.concat(acc["done"], F.substr("body", acc["upto"] + 1)))
    text = F.when(F.size("found") > 0, clean).otherwise(F.col("row.text"))
    return found.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
