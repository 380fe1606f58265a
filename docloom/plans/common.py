"""What the modules of queries share: their registry, tables, and lines of documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.evidence import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks; short ones stand for headings."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))
    n = F.length("text")
    return docs.withColumn("level", F.when(n < 20, 1).when(n < 40, 2).when(n < 60, 3))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def knowledge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a scope, a tenant and a period."""
    docs = table(spark, sf_dir, "documents")
    scope = F.when(F.col("lang") == "en", "public").when(F.col("lang") == "fr", "firm").otherwise("tenant_private")
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("n_chars"), F.lit(300)).cast("int"))
    return docs.select("doc_id", "text", scope.alias("scope"), F.when(scope != "public", F.col("source")).alias("tenant_id"), F.when(F.col("n_chars") % 7 != 0, start).alias("effective_date"), F.when(F.col("n_chars") % 5 != 0, F.date_add(start, 90)).alias("expiry_date"))
