"""Rules over rows, judged in one pass: valid rows, and rejects with their reasons.

A rule says what is broken. All rules of a table are columns of one projection,
so the table is read once however many there are; facts of other tables are
joined first, null-safe, as columns. Counts can be observed while the rows are
written, without a pass of their own.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A reason, and when it holds; null is as false."""

    reason: str
    broken: Column


def judged(rows: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """rows with problems, the reasons that hold, in the order of the rules."""
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(r.broken, F.lit(r.reason)) for r in rules])))


def split(rows: DataFrame, rules: Iterable[Rule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows as they were, and rejects with their problems."""
    all_ = judged(rows, rules)
    return all_.where(F.size("problems") == 0).drop("problems"), all_.where(F.size("problems") > 0)


def counted(judged_rows: DataFrame, rules: Iterable[Rule], name: str) -> tuple[DataFrame, Observation]:
    """Judged rows, and an observation of how many there are (rows), how many are
    valid, and how many break each rule, which fills as the rows are written."""
    seen = Observation(name)
    by_rule = [F.count_if(F.array_contains("problems", r.reason)).alias(r.reason) for r in rules]
    return judged_rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("problems") == 0).alias("valid"), *by_rule), seen


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _netloc(url: Column) -> Column:
    """What stands between the two slashes and the path of an http or https URL, else ''."""
    return F.regexp_extract(url, "^(?i:https?)://([^/?#]*)", 1)


def _sha(c: str) -> Column:
    said = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (said != "") & ~said.rlike("^[0-9a-f]{64}$")


def source_rules() -> list[Rule]:
    """What a source must say: columns title, source_type, issuing_authority,
    version, source_url, effective_date, expiry_date, page_start, page_end,
    paragraph_index, source_sha256, chunk_sha256."""
    url = F.coalesce("source_url", F.lit(""))
    law = F.col("source_type") == "law"
    return [
        Rule("no title", _blank("title")),
        Rule("unknown source type", ~F.coalesce(F.col("source_type").isin("law", "firm_rule", "tenant_private"), F.lit(False))),
        Rule("paragraph below 0", F.col("paragraph_index") < 0),
        Rule("page below 1", (F.col("page_start") < 1) | (F.col("page_end") < 1)),
        Rule("no SHA-256", _sha("source_sha256") | _sha("chunk_sha256")),
        Rule("last page before the first", F.col("page_end") < F.col("page_start")),
        Rule("expiry before effect", F.col("expiry_date") < F.col("effective_date")),
        Rule("not an http address", (url != "") & (_netloc(url) == "")),
        Rule("address with credentials", (_netloc(url) != "") & F.contains(_netloc(url), F.lit("@"))),
        Rule("address with a fragment", (_netloc(url) != "") & url.rlike("#.")),
        Rule("law without authority", law & _blank("issuing_authority")),
        Rule("law without address", law & (_netloc(url) == "")),
        Rule("law without version or date", law & _blank("version") & F.col("effective_date").isNull()),
    ]


BOX = ("x0", "top", "x1", "bottom")


def canonical_box(box: Column) -> Column:
    """A box (struct of x0, x1, and top or y0, bottom or y1; null where absent) by its four names."""
    parts = {"x0": box["x0"], "top": F.coalesce(box["top"], box["y0"]), "x1": box["x1"], "bottom": F.coalesce(box["bottom"], box["y1"])}
    return F.struct(*[v.cast("double").alias(k) for k, v in parts.items()])


def box_rules(box: Column) -> list[Rule]:
    """What a box must be. Conflicts are judged on what was given, the rest on the canonical box."""
    c = canonical_box(box)
    whole = F.lit(True)
    for part in BOX:
        whole = whole & c[part].isNotNull()
    finite = F.lit(True)
    for part in BOX:
        finite = finite & ~F.isnan(c[part]) & (F.abs(c[part]) < float("inf"))
    usable = whole & F.coalesce(finite, F.lit(False))
    negative = F.lit(False)
    for part in BOX:
        negative = negative | (c[part] < 0)
    return [
        Rule("no x0 or x1", box["x0"].isNull() | box["x1"].isNull()),
        Rule("top and y0 differ", box["top"] != box["y0"]),
        Rule("bottom and y1 differ", box["bottom"] != box["y1"]),
        Rule("no top", box["top"].isNull() & box["y0"].isNull()),
        Rule("no bottom", box["bottom"].isNull() & box["y1"].isNull()),
        Rule("not finite", whole & ~finite),
        Rule("negative", usable & negative),
        Rule("x1 before x0", usable & (c["x1"] < c["x0"])),
        Rule("bottom before top", usable & (c["bottom"] < c["top"])),
    ]


def with_facts(rows: DataFrame, facts: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """rows with a struct `name` of the facts whose key columns equal theirs,
    nulls included, or null; on maps columns of rows to those of facts. A key of
    several facts takes the least of them."""
    keyed = facts.groupBy(*[F.col(f).alias(f"__{i}") for i, f in enumerate(on.values())]).agg(F.min(F.struct(*facts.columns)).alias(name))
    met = None
    for i, r in enumerate(on):
        test = rows[r].eqNullSafe(keyed[f"__{i}"])
        met = test if met is None else met & test
    return rows.join(keyed, met, "left").drop(*[f"__{i}" for i in range(len(on))])


def hash_fits() -> Column:
    """Whether a chunk's hash is that of its content: to be asked before its facts
    are joined, so that contents need not go along."""
    return F.col("content_sha256").eqNullSafe(F.sha2("content", 256))


def chunk_rules(fits: Column | None = None) -> list[Rule]:
    """What a chunk must be, beside its document and its parent (structs
    `document` and `parent` of with_facts, null where there is none). fits says
    whether its hash is right, if that has been looked at (hash_fits)."""
    d, p = F.col("document"), F.col("parent")
    unlike = lambda c: d.isNotNull() & ~F.col(c).eqNullSafe(d[c])
    return [
        Rule("public if and only if without tenant", (F.col("scope") == "public") != F.col("tenant_id").isNull()),
        Rule("ordinal below 0", F.col("ordinal") < 0),
        Rule("last page before the first", F.col("page_end") < F.col("page_start")),
        Rule("no document", d.isNull()),
        Rule("scope unlike the document's", unlike("scope")),
        Rule("tenant unlike the document's", unlike("tenant_id")),
        Rule("no parent", F.col("parent_id").isNotNull() & p.isNull()),
        Rule("parent of another document", p.isNotNull() & ~F.col("document_id").eqNullSafe(p["document_id"])),
        Rule("hash unlike the text", ~(hash_fits() if fits is None else fits)),
    ]


def evidence_rules(tenant: str = "tenant_id") -> list[Rule]:
    """What evidence must be, beside its chunk and document (structs `chunk` and
    `document`): visible to the tenant, with both hashes as they are now."""
    c, d = F.col("chunk"), F.col("document")
    seen = (c["scope"] == "public") | (c["tenant_id"] == F.col(tenant))
    return [
        Rule("no chunk", c.isNull()),
        Rule("not visible", c.isNotNull() & ~F.coalesce(seen, F.lit(False))),
        Rule("chunk has changed", c.isNotNull() & ~F.col("source_content_sha256").eqNullSafe(c["content_sha256"])),
        Rule("document has changed", c.isNotNull() & ~F.col("source_document_sha256").eqNullSafe(d["content_sha256"])),
        Rule("rank below 1", F.col("rank") < 1),
    ]
