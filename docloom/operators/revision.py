"""Drafts reviewed and revised, for all clauses at once, round by round.

A round checks the drafts of the open clauses against their evidence, has them
reviewed, and closes clauses or has their drafts revised; generator and reviewer
are functions from DataFrame to DataFrame. Each round's drafts and states are
tables under one path, so a run that stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.grounding import checked

DRAFT = "clause long, findings array<struct<text:string,evidence_ids:array<string>>>"
Drafts = Callable[[DataFrame, DataFrame], DataFrame]


def _written(df: DataFrame, path: str) -> DataFrame:
    """df written at path, unless it is there whole already."""
    spark: SparkSession = df.sparkSession
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _ungrounded(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Clauses with a finding that names unknown evidence or states a value that its clause's evidence does not."""
    texts = evidence.groupBy("clause").agg(F.collect_set("item").alias("allowed_ids"), F.map_from_entries(F.collect_set(F.struct("item", "text"))).alias("__texts"))
    empty = F.array().cast("array<string>")
    rows = drafts.select("clause", F.explode("findings").alias("f")).join(texts, "clause", "left").select("clause", F.col("f.text").alias("text"), F.coalesce("f.evidence_ids", empty).alias("evidence_ids"), F.coalesce("allowed_ids", empty).alias("allowed_ids"), "__texts")
    cited = F.array_join(F.transform("evidence_ids", lambda i: F.coalesce(F.get(F.filter(F.map_entries("__texts"), lambda e: e["key"] == i), 0)["value"], F.lit(""))), "\n")
    bad = checked(rows.withColumn("evidence", cited)).where("not grounded")
    reason = F.when(F.size("unknown") > 0, F.concat(F.lit("unknown evidence: "), F.array_join("unknown", ","))).otherwise(F.concat(F.lit("unsupported value: "), F.col("unsupported")[0]))
    return bad.groupBy("clause").agg(F.min(reason).alias("reason"))


def settle(clauses: DataFrame, evidence: DataFrame, generate: Drafts, revise: Drafts, review: Drafts, path: str, most_revisions: int = 2) -> DataFrame:
    """clauses: clause and more; evidence: clause, item, text. generate(clauses,
    evidence) gives drafts (clause, findings: an array of text and evidence_ids);
    review(drafts, evidence) gives clause, decision (pass, revise or reject),
    evidence_gap and feedback; revise(drafts with feedback, evidence) gives new
    drafts. Gives each clause's status (complete, needs_retrieval, review_failed,
    or failed where a draft is not grounded or nothing came back), reason, the
    round that settled it, and its findings, which only complete ones have."""
    if most_revisions < 0:
        raise ValueError("revisions are not negative")
    none = F.array().cast("array<struct<text:string,evidence_ids:array<string>>>")
    asked = clauses.select("clause").distinct()
    drafts = _written(asked.join(generate(clauses, evidence).select("clause", "findings"), "clause", "left"), f"{path}/drafts=0")
    settled = []
    for turn in range(most_revisions + 1):
        bad = _ungrounded(drafts.where("findings is not null"), evidence)
        told = review(drafts.where("findings is not null").join(bad, "clause", "left_anti"), evidence).select("clause", "decision", "evidence_gap", "feedback")
        met = drafts.join(bad, "clause", "left").join(told, "clause", "left")
        status = (
            F.when(F.col("findings").isNull(), "failed")
            .when(F.col("reason").isNotNull(), "failed")
            .when(F.col("decision").isNull(), "failed")
            .when(F.col("decision") == "pass", "complete")
            .when(F.col("evidence_gap"), "needs_retrieval")
            .when((F.col("decision") == "reject") | F.lit(turn == most_revisions), "review_failed")
            .otherwise("open")
        )
        why = F.when(F.col("findings").isNull(), "no draft").otherwise(F.coalesce("reason", F.when(F.col("decision").isNull(), "no review")))
        state = _written(met.select("clause", status.alias("status"), why.alias("reason"), F.lit(turn).alias("round"), F.when(status == "complete", F.col("findings")).otherwise(none).alias("findings"), "feedback"), f"{path}/states={turn}")
        settled.append(state.where("status <> 'open'").drop("feedback"))
        open_ = state.where("status = 'open'").select("clause", "feedback")
        if turn == most_revisions or open_.isEmpty():
            break
        before = drafts.join(open_, "clause")
        drafts = _written(open_.select("clause").join(revise(before, evidence).select("clause", "findings"), "clause", "left"), f"{path}/drafts={turn + 1}")
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out
