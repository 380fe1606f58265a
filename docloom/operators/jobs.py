"""Review jobs: progress, final status, history, nested detail, state changes.

State tables are append-only; the latest row of a key is its state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("complete", "insufficient", "failed", "needs_retrieval")
ENDED = ("complete", "partial", "failed")


def progress(checkpoints: DataFrame, *keys: str) -> DataFrame:
    """total, completed, insufficient and unreviewed clauses of each job."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return checkpoints.groupBy(*keys).agg(F.count("*").alias("total"), count("complete").alias("completed"), count("insufficient").alias("insufficient"), count("queued", "needs_retrieval").alias("unreviewed"))


def final_status(checkpoints: DataFrame, *keys: str) -> DataFrame:
    """complete if all clauses are, failed if all failed, else partial; and the
    first reason, by place, of a failed job."""
    rows = checkpoints.groupBy(*keys).agg(F.bool_and(F.col("status") == "complete").alias("__c"), F.bool_and(F.col("status") == "failed").alias("__f"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("place"))).alias("__r"))
    return rows.select(*keys, F.when(F.col("__c"), "complete").when(F.col("__f"), "failed").otherwise("partial").alias("status"), F.when(~F.col("__c") & F.col("__f"), F.coalesce("__r", F.lit("all clauses failed"))).alias("reason"))


def finalized(jobs: DataFrame, checkpoints: DataFrame, *keys: str) -> DataFrame:
    """jobs (with status and failure_reason) that have not ended, as they end:
    by their checkpoints, or complete if they have no clauses."""
    told = final_status(checkpoints, *keys).select(*keys, F.col("status").alias("__status"), F.col("reason").alias("__reason"))
    rows = jobs.join(told, list(keys), "left")
    ended = F.col("status").isin(*ENDED)
    status = F.when(ended, F.col("status")).otherwise(F.coalesce("__status", F.lit("complete")))
    reason = F.when(ended, F.col("failure_reason")).otherwise(F.col("__reason"))
    return rows.select(*[status.alias(c) if c == "status" else reason.alias(c) if c == "failure_reason" else F.col(f"`{c}`") for c in jobs.columns])


def pending(clauses: DataFrame, checkpoints: DataFrame, *keys: str) -> DataFrame:
    """Clauses without a terminal checkpoint."""
    return clauses.join(checkpoints.where(F.col("status").isin(*TERMINAL)).select(*keys), list(keys), "left_anti")


def stale(jobs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Jobs that run but were not touched for so long."""
    return jobs.where((F.col("status") == "running") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes))))


def latest(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The last row of each key; the limit is taken before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def history(jobs: DataFrame, filings: DataFrame, users: DataFrame, user: str, limit: int = 100) -> DataFrame:
    """jobs (job, tenant_id, filing, requested_by, created_at and more) of filings
    (filing, tenant_id and more), joined by both keys, that the user (users: id,
    tenant_id, name) or nobody known asked for; the last of each filing, the
    newest `limit` of these. Who asked is looked up by a semi-join of the rows
    that name somebody, and the rest are added."""
    theirs = users.where(F.col("name") == user).select(F.col("id").alias("requested_by"), "tenant_id")
    asked = jobs.where("requested_by is not null").join(theirs, ["requested_by", "tenant_id"], "left_semi").unionByName(jobs.where("requested_by is null"))
    last = latest(asked.join(filings, ["filing", "tenant_id"]), ("filing", "tenant_id"), "created_at", "job")
    return last.orderBy(F.desc("created_at"), F.desc("job")).limit(limit)


def findings_in_order(findings: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Passed findings (job, clause_id, status, created_at and more) of clauses
    that have a checkpoint (job, clause_id), with their place in the job: by
    time, then by the number in the clause's id, then by the id."""
    known = checkpoints.select("job", "clause_id")
    number, name = clause_order()
    order = Window.partitionBy("job").orderBy("created_at", number, name)
    return findings.where(F.col("status") == "passed").join(known, ["job", "clause_id"], "left_semi").withColumn("place", F.row_number().over(order))


def with_requester(rows: DataFrame, users: DataFrame) -> DataFrame:
    """rows (tenant_id, subject and more) with requested_by, the id of the
    tenant's user of that name (users: id, tenant_id, name), null if there is none
    and the least if there are several."""
    known = users.groupBy("tenant_id", F.col("name").alias("subject")).agg(F.min("id").alias("requested_by"))
    return rows.join(known, ["tenant_id", "subject"], "left")


def nested(parents: DataFrame, children: DataFrame, on: list[str], order: str, *carried: str, name: str = "items") -> DataFrame:
    """Parents with their children's columns as an array in order. A parent
    without children has an empty one. A child whose order is an array stands at
    each of its places, where children that are alike count once; it is put
    there only after the shuffle."""
    if dict(children.dtypes)[order].startswith("array"):
        placed = F.transform(F.collect_set(F.struct(order, *carried)), lambda c: F.transform(c[order], lambda at: F.struct(at.alias(order), *[c[x].alias(x) for x in carried])))
        items = F.array_distinct(F.flatten(placed))
    else:
        items = F.collect_list(F.struct(order, *carried))
    grouped = children.groupBy(*on).agg(F.sort_array(items).alias(name))
    empty = F.from_json(F.lit("[]"), grouped.schema[name].dataType)
    return parents.join(grouped, on, "left").withColumn(name, F.coalesce(name, empty))


def evidence_snapshot(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """findings with evidence_ids (an array); rank is the place in it. Unknown
    ids go, but the places after them stay."""
    rows = findings.select("finding", F.posexplode("evidence_ids").alias("at", "item"))
    return rows.join(candidates, "item").select("finding", (F.col("at") + 1).alias("rank"), *candidates.columns)


def resolved(aliases: Column, ids: Column) -> Column:
    """Aliases E1, E2, ... by the ids they stand for; others as they are."""
    def one(a: Column) -> Column:
        n = F.regexp_extract(a, "^E([1-9][0-9]{0,8})$", 1)
        return F.coalesce(F.get(ids, F.when(n != "", n).cast("int") - 1), a)

    return F.transform(aliases, one)


def clause_order(clause_id: str = "clause_id") -> tuple[Column, Column]:
    """Sort keys: by the number in an id, then by the id."""
    return F.expr(f"try_cast(regexp_replace({clause_id}, '[^0-9]', '') as int)"), F.col(clause_id)


def failed(jobs: DataFrame, reason: str) -> DataFrame:
    """jobs marked failed, but for those that have ended."""
    ended = F.col("status").isin(*ENDED)
    return jobs.withColumn("failure_reason", F.when(ended, F.col("failure_reason")).otherwise(F.lit(reason))).withColumn("status", F.when(ended, F.col("status")).otherwise(F.lit("failed")))
