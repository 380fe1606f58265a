"""Findings against their evidence: unknown ids and unsupported values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import grounding_values, is_stated, with_plain_numbers


def checked(findings: DataFrame) -> DataFrame:
    """findings: text, evidence (the joined texts), evidence_ids, allowed_ids.
    Adds unknown (ids not allowed), unsupported (values the evidence does not
    state; single digits pass) and grounded."""
    evidence = with_plain_numbers(F.replace(F.coalesce("evidence", F.lit("")), F.lit(" "), F.lit("")))
    rows = findings.withColumn("unknown", F.array_except("evidence_ids", "allowed_ids")).withColumn("__e", evidence)
    # values hold no spaces and no CJK numerals, so they are plain already
    bad = F.filter(grounding_values(F.col("text")), lambda v: ~v.rlike("(?U)^\\d$") & ~is_stated(F.col("__e"), v))
    return rows.withColumn("unsupported", bad).drop("__e").withColumn("grounded", (F.size("unknown") == 0) & (F.size("unsupported") == 0))
