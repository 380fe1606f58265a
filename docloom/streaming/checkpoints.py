"""Streams of checkpoints and documents: latest state and idempotent ingest.

Sources are files; batches are merged into tables by key, so that a batch that
is run again after a failure changes nothing. A state table is a folder of
batches and of snapshots; a snapshot holds what all batches up to its number
come to, so readers take the newest one and the batches after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the whole folders name=number below a path."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def last_rows(rows: DataFrame, keys: list[str], order: list[str], first: Sequence[str] = ()) -> DataFrame:
    """The last row of each key by order and then batch; first columns keep what
    the key's first batch gave them."""
    kept = [c for c in rows.columns if c not in keys and c not in first]
    merged = rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(*order, "batch")).alias("__last"), *([F.min_by(F.struct(*first), "batch").alias("__first")] if first else []))
    return merged.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in kept], *[F.col(f"__first.{c}").alias(c) for c in first])


def latest_state(stream: DataFrame, keys: list[str], order: list[str], target: str, checkpoint: str, first: Sequence[str] = (), compact_every: int = 10) -> None:
    """Append each batch's last row of each key to target, with the first
    columns as the batch's first row of the key has them; every few batches a
    snapshot is written too."""

    def merge(batch: DataFrame, number: int) -> None:
        down = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
        early = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = batch.select(*[F.first(c).over(early).alias(c) if c in first else F.col(c) for c in batch.columns], F.row_number().over(down).alias("__n")).where("__n = 1").drop("__n")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if number % compact_every == compact_every - 1:
            compact(batch.sparkSession, target, keys, order, first)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _state(spark: SparkSession, target: str, keys: list[str], order: list[str], first: Sequence[str]) -> tuple[DataFrame, int]:
    """The merged rows, with the batch of each, and the number of the last batch."""
    batches, snapshots = _numbers(spark, target, "batch"), _numbers(spark, f"{target}/snapshot", "upto")
    if not batches:
        raise ValueError(f"no batch has been written to {target}")
    upto = snapshots[-1] if snapshots else -1
    new = [f"{target}/batch={n}" for n in batches if n > upto]
    parts = [spark.read.option("basePath", target).parquet(*new).withColumn("batch", F.col("batch").cast("long"))] if new else []
    parts += [spark.read.parquet(f"{target}/snapshot/upto={upto}")] if snapshots else []
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return last_rows(rows, keys, order, first), batches[-1]


def current(spark: SparkSession, target: str, keys: list[str], order: list[str], first: Sequence[str] = ()) -> DataFrame:
    return _state(spark, target, keys, order, first)[0].drop("batch")


def compact(spark: SparkSession, target: str, keys: list[str], order: list[str], first: Sequence[str] = ()) -> None:
    """A snapshot of all batches there are. First columns keep the batch that gave
    them by standing in the earliest row: a snapshot's rows count as batch -1 for
    them, which no later batch goes before."""
    rows, last = _state(spark, target, keys, order, first)
    rows.withColumn("batch", F.lit(-1).cast("long")).write.mode("overwrite").parquet(f"{target}/snapshot/upto={last}")


def ingest_once(stream: DataFrame, keys: list[str], order: list[str], target: str, checkpoint: str) -> None:
    """Append rows whose key target does not have; the first of each key counts."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        w = Window.partitionBy(*keys).orderBy(*order)
        rows = batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        if number:  # batches before this one; its own earlier try is written over
            stored = spark.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in batch.dtypes)}, batch long").parquet(target).where(F.col("batch") < number)
            rows = rows.join(stored.select(*keys), keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
