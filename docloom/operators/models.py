"""Models over batches of texts: embedding, scoring, and checks of what comes back.

A model is made once in each worker by a function that is sent there, and then
takes bounded batches. What it returns is checked (how many, of which length,
finite), and a batch that fails gives rows with a problem instead of stopping
the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.kernels import give_back

BATCH = 128


class Embedder(Protocol):
    def encode(self, texts: Sequence[str]) -> Any: ...


class Scorer(Protocol):
    def predict(self, pairs: Sequence[tuple[str, str]]) -> Any: ...


def _checked_vectors(made: Any, n: int, dimension: int) -> tuple[list[Any], list[str | None]]:
    vectors = list(made)
    if len(vectors) != n:
        return [None] * n, [f"{len(vectors)} vectors for {n} texts"] * n
    out, problems = [], []
    for v in vectors:
        a = np.asarray(v, np.float32).ravel()
        wrong = f"dimension {a.size}, not {dimension}" if a.size != dimension else None if np.isfinite(a).all() else "not finite"
        out.append(None if wrong else a)
        problems.append(wrong)
    return out, problems


def embedding(make: Callable[[], Embedder], dimension: int, batch: int = BATCH) -> Callable[[Column | str], Column]:
    """A function of a column of texts: a struct of vector and problem. Null texts
    have neither. Texts stay in Arrow, and a batch of them at a time is Python's."""
    if dimension < 1 or batch < 1:
        raise ValueError("dimension and batch are positive")

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for texts in columns:
            vectors, problems = [None] * len(texts), [None] * len(texts)
            some = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            for start in range(0, len(some), batch):
                at = some[start : start + batch]
                try:
                    found = _checked_vectors(model.encode(texts.take(pa.array(at)).to_pylist()), len(at), dimension)
                except Exception as e:  # what a model raises is its own
                    found = [None] * len(at), [f"{type(e).__name__}: {e}"] * len(at)
                for i, v, p in zip(at.tolist(), *found):
                    vectors[i], problems[i] = v, p
            del texts
            yield pa.StructArray.from_arrays([pa.array(vectors, pa.list_(pa.float32())), pa.array(problems, pa.string())], ["vector", "problem"])
            give_back()

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "vector array<float>, problem string")


def scoring(make: Callable[[], Scorer], batch: int = BATCH) -> Callable[[Column | str, Column | str], Column]:
    """A function of columns of queries and texts: a struct of score and problem. Null texts count as empty."""
    if batch < 1:
        raise ValueError("batch is positive")

    def run(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = make()
        for queries, texts in columns:
            scores, problems = [], []
            pairs = list(zip(queries.fillna(""), texts.fillna("")))
            for start in range(0, len(pairs), batch):
                part = pairs[start : start + batch]
                try:
                    found = [float(s) for s in model.predict(part)]
                    wrong = [f"{len(found)} scores for {len(part)} pairs"] * len(part) if len(found) != len(part) else [None if np.isfinite(s) else "not finite" for s in found]
                except Exception as e:  # what a model raises is its own
                    found, wrong = [], [f"{type(e).__name__}: {e}"] * len(part)
                scores += [None if w else s for s, w in zip(found or [0.0] * len(part), wrong)] if len(found) == len(part) or not found else [None] * len(part)
                problems += wrong
            yield pd.DataFrame({"score": pd.Series(scores, dtype="float64"), "problem": pd.Series(problems, dtype="object")})

    run.__annotations__ = {"columns": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "score double, problem string")


class LetterModel:
    """A model without weights: counts of the 26 letters in lower case, at length
    one. Texts without letters have the zero vector. A pair's score is the cosine."""

    dimension = 26

    def counts(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), 26))
        for i, t in enumerate(texts):
            # of other characters these two alone have one of the letters as their lower case
            raw = np.frombuffer(t.replace("\u0130", "i").replace("\u212a", "k").encode(), np.uint8)
            out[i] = np.bincount((raw | 32)[((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)] - 97, minlength=26)
        return out

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        c = self.counts(texts)
        n = np.sqrt((c * c).sum(axis=1, keepdims=True))
        return np.divide(c, n, out=np.zeros_like(c), where=n > 0)

    def predict(self, pairs: Sequence[tuple[str, str]]) -> np.ndarray:
        return (self.encode([q for q, _ in pairs]) * self.encode([t for _, t in pairs])).sum(axis=1)


def checked_reranking(candidates: DataFrame, returned: DataFrame, carried: Sequence[str], limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """What a reranker returned (query, item, score and the carried columns)
    against what it was given. Rows of items it was not given, with carried
    columns changed, or with scores that are not finite are rejects with a
    problem; of the rest the best score of each item counts, and each query's
    first `limit` are ranked. Candidates that carry one item twice with
    different columns are rejects too, and so are the rows returned for them."""
    known = candidates.groupBy("query", "item").agg(F.min(F.struct(*carried)).alias("__a"), F.max(F.struct(*carried)).alias("__b"))
    met = returned.withColumn("__c", F.struct(*carried)).join(known, ["query", "item"], "left")
    problem = (
        F.when(F.col("__a").isNull(), "unknown item")
        .when(~F.col("__a").eqNullSafe(F.col("__b")), "inconsistent candidates")
        .when(~F.col("__c").eqNullSafe(F.col("__a")), "provenance changed")
        .when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")), "score not finite")
    )
    met = met.withColumn("problem", problem)
    rejects = met.where("problem is not null").select(*returned.columns, "problem")
    best = met.where("problem is null").groupBy("query", "item").agg(F.max("score").alias("score"), F.first("__a").alias("__a"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("query", "item", "score", "rank", "__a.*"), rejects
