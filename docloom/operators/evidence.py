"""Evidence for all clauses at once, round by round.

A round retrieves for the open clauses' queries, leaves out what a clause has
seen, keeps what reaches the similarity floor, and lets a judge close clauses
or ask further. Retrieval and judge are functions from DataFrame to DataFrame;
each round's tables are written to the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.retrieval import above_floor, merged_queries


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where none
    is named and all runs on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder, and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collect(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame], rounds: int = 3, floor: float = 0.5, most: int = 20) -> DataFrame:
    """queries: clause, query_no, text. retrieve gives clause, query_no, rank,
    item and vector_score; judge takes all of a clause's evidence so far
    (clause, item, round) and gives clause, enough, and next (an array of
    further query texts). Returns clause, item, round, place."""
    evidence = None
    now = kept(queries, "queries")
    for turn in range(1, rounds + 1):
        hits = merged_queries(above_floor(retrieve(now), floor), evidence, most)
        found = hits.select("clause", "item", F.lit(turn).alias("round"), "place")
        evidence = kept(found if evidence is None else evidence.unionByName(found), "evidence")
        if turn == rounds:
            break
        said = judge(evidence.join(now.select("clause").distinct(), "clause"))
        more = said.where(~F.col("enough")).select("clause", F.posexplode("next").alias("query_no", "text"))
        now = kept(more, "queries")
        if now.isEmpty():
            break
    return evidence
