"""Constraints as queries for the rows that break them, and idempotent appends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(rules: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """rule and n: how many rows of each table break each rule. A rule that is
    unknown for a row, as null makes it, is not broken."""
    counts = [df.agg(F.count_if(broken).alias("n")).select(F.lit(name).alias("rule"), "n") for name, (df, broken) in rules.items()]
    return reduce(DataFrame.unionByName, counts)


def orphans(rows: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key no parent has."""
    return rows.join(parents.select(*on), on, "left_anti")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_of(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The first row of each key, in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def new_rows(rows: DataFrame, stored: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """What an idempotent append would write: each key once, none stored yet."""
    return first_of(rows, tuple(keys), *order).join(stored.select(*keys), keys, "left_anti")


def conflicts(rows: DataFrame, stored: DataFrame, keys: list[str], provenance: list[str]) -> DataFrame:
    """Rows whose key is stored with another provenance."""
    old = stored.select(*keys, F.struct(*provenance).alias("__old"))
    return rows.join(old, keys).where(~F.col("__old").eqNullSafe(F.struct(*provenance))).drop("__old")


def finite(vector: Column, size: int) -> Column:
    """Whether a vector has this size and only finite parts."""
    return F.coalesce((F.size(vector) == size) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
