"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums and ranges confirm or drop them,
and context words close before a span raise its score. Everything is one
projection: no shuffle, and documents without a digit or an at sign cost one
look each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import columns_free_of


@dataclass(frozen=True)
class Kind:
    """A kind of span. guard is a cheap test of the whole text; keep confirms a
    match; score is for a match without context; words are context words."""

    name: str
    pattern: str
    guard: Callable[[Column], Column]
    keep: Callable[[Column], Column]
    score: float
    words: str
    base: bool = True


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.split(F.reverse(digits), "")
    doubled = F.transform(F.filter(places, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 when divided by 97."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def _small_parts(m: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, "[.]"), lambda p: (F.length(bare(p)) <= 3) & (F.concat(F.lit("0"), F.substring(bare(p), 1, 3)).cast("int") <= 255))


#: In the order in which equal starts are listed. The lookbehinds and possessive
#: runs only spare the matcher starts that must fail; leftmost matches stay.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+", lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.9, "mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+", lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]"), _small_parts, 0.6, "ip|host|server|address"),
    # a chain of over 19 digits fails the check anyway, so the pattern may end there
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])", lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"), lambda m: luhn(_digits(m)), 0.7, "card|visa|pay|credit"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(9, 15), 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))), 0.8, "iban|account|bank|konto|cuenta|compte", base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda m: F.lit(True), 0.4, "ssn|social|security|tax", base=False),
)

SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int,score:double>>"
LEAST_SCORE, CONTEXT_CHARS, CONTEXT_GAIN = 0.6, 40, 0.25


BLOCK = 64  # matches that are placed together


def placed_matches(matches: Column, pieces: Column) -> Column:
    """start, m and before (the characters that context is looked for in) of each
    match, from the matches and the pieces of text around them.

    Places are sums of lengths. They are added up within blocks of matches, and
    then over the blocks, so that no array grows by one match at a time."""
    pairs = F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("p"))
    tail = lambda *parts: F.right(F.concat(*parts), F.lit(CONTEXT_CHARS))
    found = "array<struct<start:int,m:string,before:string>>"

    def block(part: Column) -> Column:
        """Places from the block's own beginning, its length, and its last characters."""
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(found).alias("found")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
                tail(a["tail"], x["p"], x["m"]).alias("tail"),
                F.concat(a["found"], F.array(F.struct((a["at"] + F.length(x["p"])).alias("start"), x["m"].alias("m"), tail(a["tail"], x["p"]).alias("before")))).alias("found"),
            ),
        )

    def in_blocks(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / BLOCK).cast("int")
        return F.when(F.size(all_) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: block(F.slice(all_, i * BLOCK + 1, F.lit(BLOCK)))))

    blocks = F.transform(F.array(pairs), in_blocks)[0]  # so that the text is matched once, not once a block
    moved = lambda a, b: F.transform(b["found"], lambda x: F.struct((x["start"] + a["at"]).alias("start"), x["m"].alias("m"), tail(a["tail"], x["before"]).alias("before")))
    whole = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{found}>").alias("found")),
        lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), tail(a["tail"], b["tail"]).alias("tail"), F.concat(a["found"], F.array(moved(a, b))).alias("found")),
    )["found"]
    return F.coalesce(F.flatten(whole), F.array().cast(found))


def spans_of(text: Column, number: int, kind: Kind) -> Column:
    """The kind's confirmed spans. Matches and the pieces between them, both
    from the same pattern, give the places by adding up lengths."""
    placed = placed_matches(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1))
    kept = F.filter(placed, lambda x: kind.keep(x["m"]))

    def scored(x: Column) -> Column:
        score = F.lit(kind.score) + F.when(F.lower(x["before"]).rlike(kind.words), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(number).alias("kind_no"), F.lit(kind.name).alias("kind"), (x["start"] + F.length(x["m"])).alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    found = F.transform(kept, scored)
    if not kind.base:
        found = F.filter(found, lambda x: x["score"] >= LEAST_SCORE)
    return F.when(kind.guard(text), found).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, text and spans, an
    array of start, kind_no, kind, end and score in order of start, then kind;
    places are code points, ends exclusive.

    Matches of a kind are leftmost and do not overlap; those that fail their
    check are dropped and not tried again further on. Spans of the four base
    kinds stay whatever their score; others need LEAST_SCORE. A null text is
    empty; ids may be null or repeated; other columns are ignored.
    """
    rows = columns_free_of(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = [spans_of(F.col("text"), i, k) for i, k in enumerate(kinds)]
    return rows.select("doc_id", "text", F.sort_array(F.concat(*parts)).alias("spans"))


def masked(found: DataFrame) -> DataFrame:
    """doc_id and the text with each span replaced by its kind in brackets;
    of spans that overlap, the first stays."""
    end = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))),
    )
    return found.select("doc_id", F.concat(end["out"], F.substring(F.col("text"), end["at"] + 1, F.length("text"))).alias("text"))
