"""Personal data in intake notes: patterns propose spans, validators confirm them, context words adjust the score."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, starts_of, whole_text


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a digit string: every second digit from the right is doubled."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(text: Column) -> Column:
    """ISO 7064 check of an account number: the first four characters move to the end, A-Z count 10-35, remainder 1."""
    bare = F.translate(text, " ", "")
    turned = F.concat(F.substring(bare, 5, 1_000), F.substring(bare, 1, 4))
    code = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(code, F.lit(0), lambda a, v: F.when(v < 10, a * 10 + v).otherwise(a * 100 + v) % 97) == 1


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _ip(m: Column) -> Column:
    return m.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")


class Kind(NamedTuple):
    """A kind of personal data. `hint`: a character without which a text has none ('' for no such character)."""
    name: str
    pattern: str
    hint: str
    valid: Callable[[Column], Column]
    base: bool
    score: float
    context: str


# Patterns never give back characters (possessive), so long runs take linear time; they match what the plain forms match.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), True, 0.9,
         "mail|contact|write|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", _ip, True, 0.6, r"\bip\b|address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", lambda m: F.length(_digits(m)).between(14, 19) & luhn(_digits(m)), True, 0.8, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: F.length(_digits(m)).between(10, 15), True, 0.6, "phone|call|mobile|cell|whatsapp"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", mod97, False, 0.9, "iban|account|bank|transfer"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", lambda m: F.lit(True), False, 0.35, r"\bssn\b|social security"),
)
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean,score:double>>"


def _spans(text: Column, rank: int, kind: Kind, near: int, boost: float, least: float) -> Column:
    """Confirmed spans of one kind. Places come from the lengths of the pieces between matches."""
    pattern = F.lit(kind.pattern)

    def placed(m: Column) -> Column:
        def from_pieces(p: Column) -> Column:
            between = F.slice(p, F.lit(1), F.size(m))
            lengths = F.zip_with(between, m, lambda a, b: (F.length(a) + F.length(b)).cast("long"))

            def span(x: Column, k: Column) -> Column:
                start = x["at"] + F.length(F.get(p, k))
                around = F.lower(F.concat_ws(" ", F.substring(F.get(p, k), -near, near), F.substring(F.get(p, k + 1), 1, near)))
                score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(around.rlike(kind.context), boost).otherwise(0.0))
                return F.when(kind.valid(x["m"]) & (F.lit(kind.base) | (score >= least)), F.struct(
                    start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["m"])).alias("end"), F.lit(kind.name).alias("kind"),
                    F.lit(kind.base).alias("base"), score.alias("score")))

            return F.filter(F.transform(F.zip_with(m, starts_of(lengths), lambda a, b: F.struct(a.alias("m"), b.alias("at"))), span), lambda s: s.isNotNull())
        return F.when(F.size(m) > 0, let(F.split(text, kind.pattern), from_pieces).cast(SPAN)).otherwise(F.array().cast(SPAN))

    found = let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)
    return F.when(F.contains(text, F.lit(kind.hint)), found).otherwise(F.array().cast(SPAN)) if kind.hint else found


def personal_data(evidence: DataFrame, text_col: str = "intake_notes", near: int = 40, boost: float = 0.3, least: float = 0.5) -> DataFrame:
    """The input with a column `spans`: confirmed personal data of every record by start, then kind.

    A span has start, end (code points, end exclusive), kind, base, score.
    Base kinds (email, ip, card, phone) stay whenever their check holds; the
    others (iban, ssn) need a score of `least`, which words about the kind
    within `near` characters raise by `boost`. Matches of a kind do not
    overlap; spans of different kinds may.

    One projection, nothing is shuffled. Null or empty text: no spans. Nulls
    elsewhere, repeated rows and extra columns pass through; a column named
    spans is replaced.
    """
    text = whole_text(F.col(text_col))
    each = [_spans(text, k, kind, near, boost, least) for k, kind in enumerate(KINDS)]
    return evidence.withColumn("spans", F.array_sort(F.concat(*each)))


def redacted(evidence: DataFrame, text_col: str = "intake_notes") -> DataFrame:
    """The input with every personal span in `text_col` replaced by its kind in brackets.

    Spans that overlap become one, named after the first. Null text stays null.
    """
    found = personal_data(evidence.withColumn("__row", F.struct(*evidence.columns)).select("__row", F.col(text_col).alias("__text")), "__text")

    def covered(spans: Column) -> Column:
        # furthest end of the spans before each one, so that only the first of an overlapping run opens a gap
        def step(acc: Column, s: Column) -> Column:
            open_ = s["start"] >= acc["end"]
            piece = F.when(open_, F.array(F.struct(acc["end"].alias("from"), s["start"].alias("to"), s["kind"].alias("kind")))).otherwise(
                F.array().cast("array<struct<from:bigint,to:bigint,kind:string>>"))
            return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), F.concat(acc["gaps"], piece).alias("gaps"))

        start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<from:bigint,to:bigint,kind:string>>").alias("gaps"))
        return F.aggregate(spans, start, step)

    text = F.col("__text")
    clean = let(covered(F.col("spans")), lambda c: F.concat(
        F.array_join(F.transform(c["gaps"], lambda g: F.concat(F.substr(text, (g["from"] + 1).cast("int"), (g["to"] - g["from"]).cast("int")), F.lit("["), F.upper(g["kind"]), F.lit("]"))), ""),
        F.substr(text, (c["end"] + 1).cast("int"))))
    new = F.when(F.size("spans") > 0, clean).otherwise(text)
    return found.select(*[(new if c == text_col else F.col("__row").getField(c)).alias(c) for c in evidence.columns])
