"""Personal data in text: patterns propose, checksums confirm, context adjusts (DataFrame functions only, no shuffle).

Each kind has a pattern that proposes spans, leftmost and not overlapping
within the kind, and a validator.  Its score is the kind's base, more if a
context word stands in the ``CONTEXT_CHARS`` before the span; spans of
``least_score`` or more stay.  Email, ip, card (Luhn) and phone reach that
score by themselves; the further kinds are iban (mod-97), ssn (needs context)
and secret (a long hexadecimal run, needs context).

Patterns are written so that Java matches them without recursion and without
trying every start in a long run: quantifiers are possessive where nothing can
be given back, and a match can only begin where a run begins.

Positions are code points, end exclusive: ``split`` gives the text between the
matches and ``regexp_extract_all`` the matches, and both lengths are added up.

Defined cases: null text counts as empty, without spans; repeated rows are
treated one by one; an empty table gives an empty result; columns pass
through, except that result columns replace those of their name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

CONTEXT_CHARS = 40
_LOCAL = "[A-Za-z0-9._%+-]"
_RUN = "(?<![0-9])(?<![0-9][ -])"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _mod97(x: Column) -> Column:
    """An IBAN, blanks dropped: country and check digits to the end, letters as 10 to 35, rest of division by 97 is 1."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4)))

    def step(acc, c):
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _card(x: Column) -> Column:
    d = _digits(x)
    return F.length(d).between(14, 19) & F.call_function("luhn_check", d)


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # a text without a match of this quick pattern has no span
    valid: object
    base: float
    context: str


KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda x: F.lit(True), 0.7, "mail|contact|write|schreib"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", lambda x: F.rlike(x, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")), 0.6, "ip|host|address|server"),
    Kind("card", _RUN + "[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", "[0-9]{2}|[0-9][ -][0-9]", _card, 0.7, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", lambda x: F.length(_digits(x)).between(10, 15), 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", _mod97, 0.7, "iban|account|konto|bank"),
    Kind("ssn", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", lambda x: ~F.rlike(x, F.lit("^(000|666|9)|-00-|-0000$")), 0.3, "ssn|social|security"),
    Kind("secret", "(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])", "[0-9a-f]{32}", lambda x: F.rlike(x, F.lit("[0-9]")) & F.rlike(x, F.lit("[a-f]")), 0.3, "token|secret|key|password"),
)
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "secret")
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def _spans(text: Column, kind: Kind, rank: int, least_score: float) -> Column:
    """The kind's spans in one text."""
    pattern = F.lit(kind.pattern)

    def fold(between, found):
        def add(acc, i):
            gap, hit = F.get(between, i), F.get(found, i)
            return let(
                F.struct((acc["at"] + F.length(gap)).alias("s"), gap.alias("gap"), hit.alias("hit")),
                lambda v: let(
                    F.lit(kind.base) + F.when(F.rlike(F.lower(F.right(v["gap"], F.lit(CONTEXT_CHARS))), F.lit(rf"\b(?:{kind.context})")), 0.3).otherwise(0.0),
                    lambda score: F.struct(
                        (v["s"] + F.length(v["hit"])).alias("at"),
                        F.when(
                            (score >= least_score) & kind.valid(v["hit"]),
                            F.concat(acc["spans"], F.array(F.struct(v["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (v["s"] + F.length(v["hit"])).alias("end"), score.alias("score")))),
                        )
                        .otherwise(acc["spans"])
                        .alias("spans"),
                    ),
                ),
            )

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
        return F.when(F.size(found) == 0, F.array().cast(_SPANS)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, add, lambda acc: acc["spans"]))

    all_of = let(F.split(text, kind.pattern, -1), lambda between: let(F.regexp_extract_all(text, pattern, 0), lambda found: fold(between, found)))
    return F.when(F.rlike(text, F.lit(kind.gate)), all_of).otherwise(F.array().cast(_SPANS))


def find_pii(docs: DataFrame, text: str = "text", least_score: float = 0.5) -> DataFrame:
    """docs with pii: array of spans (start, rank, kind, end, score) by start, then kind as listed in KINDS."""
    df = docs.drop(*[c for c in docs.columns if c.lower() == "pii"]).withColumn("_body", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumn("_any", F.rlike("_body", F.lit("[@0-9]")))
    empty = F.array().cast(_SPANS)
    df = df.withColumns({f"_{k.name}": F.when(F.col("_any"), _spans(F.col("_body"), k, i, least_score)).otherwise(empty) for i, k in enumerate(KINDS)})
    return df.withColumn("pii", F.sort_array(F.concat(*[f"_{k.name}" for k in KINDS]))).drop("_body", "_any", *[f"_{k.name}" for k in KINDS])


def redacted(text: Column, spans: Column) -> Column:
    """text with each span, or run of spans that overlap, replaced by its first kind in brackets; null stays null."""

    def add(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["parts"], F.array(piece))).otherwise(acc["parts"]).alias("parts"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    whole = F.aggregate(spans, zero, add, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
