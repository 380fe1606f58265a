"""Jobs as a log of states with guarded, numbered transitions.

A transition reads the state, decides for all its requests at once, and appends
what changes as the next version; a version is there when its commit is, and two
writers cannot commit the same one. Each transition has a name, and one that is
run again gives what it gave before and changes nothing. A snapshot stands for
all versions up to its own, so reading costs what changed since.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from docloom.functions.text import deterministic_uuid
from docloom.operators.jobs import ENDED

JOB = "job string, tenant_id string, filing string, idempotency_key string, status string, total_clauses long, completed_clauses long, failure_reason string"
ACTIVE = ("queued", "running")
FIXED = ("tenant_id", "filing", "idempotency_key")  # said where a job is made, null in later changes
CHANGE = "__change"
Decided = tuple[DataFrame, Column, list[Column | str], list[str]]


class Conflict(RuntimeError):
    """Another writer has appended since the state was read."""


def idempotency_key(tenant: Column, sha: Column, config: Column) -> Column:
    """tenant, hash of the file, and the first eight digits of the configuration's."""
    return F.concat_ws(":", tenant, sha, F.substring(F.sha2(config, 256), 1, 8))


def rerun_key(tenant: Column, filing: Column, nonce: Column) -> Column:
    return F.concat_ws(":", tenant, filing, F.lit("rerun"), nonce)


class JobLog:
    """The log of jobs under a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 20):
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every

    def _names(self, kind: str) -> dict[int, str]:
        """Versions that are there whole, and their transitions."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return {}
        whole = [s.getPath() for s in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return {int(p.getName().split("=")[1]): p.toString() for p in whole if "=" in p.getName()}

    def _commits(self) -> dict[str, int]:
        found = self._names("commits")
        return {r["name"]: r["version"] for r in self.spark.read.schema("name string, version int").parquet(*found.values()).collect()} if found else {}

    def version(self) -> int:
        return max(self._names("commits"), default=-1)

    def _changes(self, version: int) -> DataFrame:
        """The jobs that a version changed, which stand beside its answers."""
        rows = self.spark.read.schema(f"{CHANGE} struct<{JOB}>").parquet(f"{self.path}/answers/version={version}")
        return rows.where(f"{CHANGE} is not null").select(f"{CHANGE}.*")

    def _upto(self, version: int) -> DataFrame:
        snapshots = [v for v in self._names("snapshots") if v <= version]
        start = max(snapshots, default=-1)
        parts = [self.spark.createDataFrame([], f"{JOB}, version int")]
        parts += [self.spark.read.schema(f"{JOB}, version int").parquet(f"{self.path}/snapshots/version={start}")] if snapshots else []
        parts += [self._changes(v).withColumn("version", F.lit(v)) for v in range(start + 1, version + 1)]
        rows = reduce(DataFrame.unionByName, parts)
        # a column each, so that those that a transition does not look at are not moved
        return rows.groupBy("job").agg(*[(F.max(c) if c in FIXED else F.max_by(c, "version")).alias(c) for c in rows.columns[1:]])

    def jobs(self) -> DataFrame:
        """Each job's state now."""
        return self._upto(self.version()).drop("version")

    def compact(self) -> None:
        version = self.version()
        if version >= 0:
            self._upto(version).write.mode("overwrite").parquet(f"{self.path}/snapshots/version={version}")

    def _transition(self, name: str, decide: Callable[[DataFrame], Decided]) -> DataFrame:
        """decide takes the state and gives a row for each request, which of them
        change a job, that job's columns as changed, and the columns of the answer.
        Both are written as one table, so the state is met with the requests once."""
        done = self._commits()
        if name not in done:
            version = self.version()
            n = version + 1
            met, fits, job, answer = decide(self._upto(version).drop("version"))
            change = F.when(fits, F.struct(*job))
            met.select(*answer, change.alias(CHANGE)).write.mode("overwrite").parquet(f"{self.path}/answers/version={n}")
            try:
                self.spark.createDataFrame([(name, n)], "name string, version int").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/commits/version={n}")
            except AnalysisException as e:
                raise Conflict(f"version {n} has been written by another") from e
            done = done | {name: n}
            if n % self.compact_every == self.compact_every - 1:
                self.compact()
        return self.spark.read.parquet(f"{self.path}/answers/version={done[name]}").drop(CHANGE)

    def create(self, requests: DataFrame, name: str) -> DataFrame:
        """requests (tenant_id, filing, sha256, config): a job for each key that
        has none. Answers: tenant_id, filing, job, created; of requests with one
        key the first by filing makes the job, the others get it."""

        def decide(state: DataFrame) -> Decided:
            keyed = requests.withColumn("idempotency_key", idempotency_key(F.col("tenant_id"), F.col("sha256"), F.col("config")))
            had = state.select("tenant_id", "idempotency_key", F.col("job").alias("__had"))
            first = Window.partitionBy("tenant_id", "idempotency_key").orderBy("filing")
            met = keyed.join(had, ["tenant_id", "idempotency_key"], "left").withColumn("__n", F.row_number().over(first))
            met = met.withColumns({"job": F.coalesce("__had", deterministic_uuid(F.lit("job"), F.col("tenant_id"), F.col("idempotency_key"))), "created": F.col("__had").isNull() & (F.col("__n") == 1)})
            return met, F.col("created"), ["job", "tenant_id", "filing", "idempotency_key", *_fresh()], ["tenant_id", "filing", "job", "created"]

        return self._transition(name, decide)

    def retry(self, requests: DataFrame, name: str) -> DataFrame:
        """requests (job, tenant_id): failed jobs without completed clauses are
        queued anew. Answers: job, tenant_id, refused (null where it was done)."""

        def decide(state: DataFrame) -> Decided:
            met = _own(requests.select("job", "tenant_id"), state, "status", "completed_clauses")
            refused = F.when(F.col("status").isNull(), "no such job").when((F.col("status") != "failed") | (F.col("completed_clauses") != 0), "only failed jobs without completed clauses can be retried")
            met = met.withColumn("refused", refused)
            return met, F.col("refused").isNull(), ["job", *_as_made(), *_fresh()], ["job", "tenant_id", "refused"]

        return self._transition(name, decide)

    def rerun(self, requests: DataFrame, name: str) -> DataFrame:
        """requests (job, tenant_id, nonce): a new job for the same filing, unless
        it has one that is queued or running; of several requests for a filing
        the first by nonce and job counts. Answers: job, tenant_id, nonce, new_job, refused."""

        def decide(state: DataFrame) -> Decided:
            active = state.where(F.col("status").isin(*ACTIVE)).select("tenant_id", "filing", F.lit(True).alias("__active")).distinct()
            met = _own(requests.select("job", "tenant_id", "nonce"), state, "filing").join(active, ["tenant_id", "filing"], "left")
            place = F.row_number().over(Window.partitionBy("tenant_id", "filing").orderBy("nonce", "job"))
            met = met.withColumn("refused", F.when(F.col("filing").isNull(), "no such job").when(F.col("__active") | (place > 1), "the filing has an active job"))
            met = met.withColumn("idempotency_key", rerun_key(F.col("tenant_id"), F.col("filing"), F.col("nonce")))
            met = met.withColumn("new_job", F.when(F.col("refused").isNull(), deterministic_uuid(F.lit("job"), F.col("tenant_id"), F.col("idempotency_key"))))
            return met, F.col("refused").isNull(), [F.col("new_job").alias("job"), "tenant_id", "filing", "idempotency_key", *_fresh()], ["job", "tenant_id", "nonce", "new_job", "refused"]

        return self._transition(name, decide)

    def update(self, changes: DataFrame, name: str) -> DataFrame:
        """changes (job, status, total_clauses, completed_clauses, failure_reason;
        null keeps a number): jobs that have ended stay as they are. Answers: job, refused."""

        def decide(state: DataFrame) -> Decided:
            new = changes.select("job", *[F.col(c).alias(f"__{c}") for c in ("status", "total_clauses", "completed_clauses", "failure_reason")])
            met = new.join(state, "job", "left")
            over = F.col("__completed_clauses") > F.coalesce("__total_clauses", "total_clauses")
            refused = F.when(F.col("status").isNull(), "no such job").when(F.col("status").isin(*ENDED), "the job has ended").when(over, "more clauses completed than there are")
            met = met.withColumn("refused", refused)
            moved = [F.col("__status").alias("status"), *[F.coalesce(f"__{c}", c).alias(c) for c in ("total_clauses", "completed_clauses")], F.col("__failure_reason").alias("failure_reason")]
            return met, F.col("refused").isNull(), ["job", *_as_made(), *moved], ["job", "refused"]

        return self._transition(name, decide)


def _own(requests: DataFrame, state: DataFrame, *columns: str) -> DataFrame:
    """Distinct requests (job, tenant_id and more) with columns of the tenant's own
    job, null where it has no such job. All meet by the job, as the state lies."""
    held = state.select("job", F.col("tenant_id").alias("__tenant"), *[F.col(c).alias(f"__{c}") for c in columns])
    met = requests.repartition("job").distinct().join(held, "job", "left")
    return met.select(*requests.columns, *[F.when(F.col("__tenant") == F.col("tenant_id"), F.col(f"__{c}")).alias(c) for c in columns])


def _as_made() -> list[Column]:
    return [F.lit(None).cast("string").alias(c) for c in FIXED]


def _fresh() -> list[Column]:
    """The columns of a job that has just been queued."""
    return [F.lit("queued").alias("status"), F.lit(0).cast("long").alias("total_clauses"), F.lit(0).cast("long").alias("completed_clauses"), F.lit(None).cast("string").alias("failure_reason")]
