"""Whitening of embeddings from an exact scatter matrix.

Entries become whole numbers. With n vectors and the sums S of each dimension,
y = n x - S is exact; its scatter is gathered as residues: in each partition one
matrix product in doubles for each of several primes under 2^20, whose sums stay
below 2^53 and so are exact, reduced modulo the prime. Residues are added up
across partitions, and the Chinese remainder theorem gives the exact whole
numbers; there are as many primes as their proven bound needs. The covariance is
the quotient, rounded once, and eigh gives its eigenvectors in double precision.

What reaches the driver is bounded by the square of the dimension, whatever the
number of vectors. Vectors that are null, empty or hold null or non-finite
entries take no part, nor do those of another length than the commonest (ties:
the longer). Entries of 2^46 or more in magnitude raise a ValueError. Rows may
repeat and ids be null. Components whose eigenvalue is zero up to rounding are
left out, so a single vector or equal ones give no components. Extra columns do
not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import columns_free_of

SCALE, SHIFT = 64, 1_000_000
MOST_ENTRY = float(2**46)
CHUNK = 8192  # rows of a product: residues lie within 2^19 of zero, so sums stay below 2^51
Matrix = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def primes_for(bound: int, below: int = 1 << 20) -> list[int]:
    """Primes downwards from below whose product exceeds bound."""
    sieve = np.ones(below, bool)
    sieve[:2] = False
    for i in range(2, int(below**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    out, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > bound:
            return out
        out, product = [*out, p], product * p
    raise ValueError("numbers too large")


def residues(x: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """n x - S modulo p, within p / 2 of zero, as doubles."""
    r = ((x % p) * (n % p) - np.array([s % p for s in sums], np.int64)) % p
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def scatter_mod(x: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """The scatter of n x - S modulo p; every product is exact."""
    out = np.zeros((x.shape[1], x.shape[1]), np.int64)
    for s in range(0, len(x), CHUNK):
        r = residues(x[s : s + CHUNK], n, sums, p)
        out = (out + (r.T @ r).astype(np.int64)) % p
    return out


def reconstructed(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Whole numbers, within half the primes' product of zero, from residues."""
    product = 1
    for p in primes:
        product *= p
    total = np.zeros(parts[0].shape, object)
    for part, p in zip(parts, primes):
        rest = product // p
        total = total + part.astype(object) * (rest * pow(rest, -1, p))
    total = total % product
    return np.where(total > product // 2, total - product, total)


@dataclass
class Whitening:
    """What was fitted: n vectors, their sums, eigenvalues and components (in
    columns) by falling eigenvalue, the share of each, and the bound of |y|."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: list[float]
    reach: int

    def project(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whitened rows, and each row's exact sum of squares of n x - S."""
        if len(self.sums) * self.reach**2 < 2**62 and self.n * (self.reach + max(map(abs, self.sums))) < 2**62:
            y = x * self.n - np.array(self.sums, np.int64)
            return (y / self.n) @ (self.components / np.sqrt(self.values)), (y * y).sum(axis=1).tolist()
        y = x.astype(object) * self.n - np.array(self.sums, object)
        return (y / self.n).astype(np.float64) @ (self.components / np.sqrt(self.values)), (y * y).sum(axis=1).tolist()


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and embedding of the vectors that take part, and their length."""
    fit = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = columns_free_of(embeddings, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>")).where((F.size("embedding") > 0) & fit)
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.where(F.size("embedding") == size["d"]), size["d"]) if size else (rows, 0)


def whole(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The vectors of a batch as whole numbers."""
    c = batch["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    if c.size and np.abs(c).max() >= MOST_ENTRY:
        raise ValueError("an entry is too large to whiten exactly")
    return np.floor(c * SCALE).astype(np.int64) + SHIFT


def _sums(d: int) -> Matrix:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(d, object)
        low, high = np.full(d, np.iinfo(np.int64).max), np.full(d, np.iinfo(np.int64).min)
        for b in batches:
            if b.num_rows:
                x = whole(b, d)
                n += len(x)
                sums = sums + (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            yield pa.record_batch({"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0)), "low": low, "high": high})

    return run


def _scatter(d: int, n: int, sums: list[int], primes: list[int]) -> Matrix:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {p: np.zeros((d, d), np.int64) for p in primes}
        for b in batches:
            x = whole(b, d)
            for p in primes:
                totals[p] = (totals[p] + scatter_mod(x, n, sums, p)) % p
        for p, t in totals.items():
            yield pa.record_batch({"p": pa.array([p] * d, pa.int64()), "i": pa.array(range(d), pa.int32()), "row": pa.array([r.tobytes() for r in t], pa.binary())})

    return run


def _added(key: tuple, t: pa.Table) -> pa.Table:
    """Rows of one place added up modulo their prime."""
    p, i = (k.as_py() for k in key)
    total = sum(np.frombuffer(r, np.int64) for r in t["row"].to_pylist()) % p
    return pa.table({"p": pa.array([p], pa.int64()), "i": pa.array([i], pa.int32()), "row": pa.array([total.tobytes()], pa.binary())})


def scatter(rows: DataFrame, d: int) -> tuple[np.ndarray, int, list[int], int]:
    """The exact scatter of n x - S, n, S, and the largest |n x - S| there can be."""
    found = rows.mapInArrow(_sums(d), "i int, n long, s decimal(38,0), low long, high long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    reach = max(max(n * r["high"] - s, s - n * r["low"]) for r, s in zip(found, sums))
    primes = primes_for(2 * n * reach * reach + 1)
    parts = rows.mapInArrow(_scatter(d, n, sums, primes), "p long, i int, row binary").groupBy("p", "i").applyInArrow(_added, "p long, i int, row binary").collect()
    by_prime = {p: np.zeros((d, d), np.int64) for p in primes}
    for r in parts:
        by_prime[r["p"]][r["i"]] = np.frombuffer(r["row"], np.int64)
    return reconstructed([by_prime[p] for p in primes], primes), n, sums, reach


def fit(rows: DataFrame, d: int, most: int = 32) -> Whitening:
    """Eigenvectors of the covariance of the usable rows, whose largest entry is
    positive, so that the sign is settled."""
    z, n, sums, reach = scatter(rows, d)
    v = np.array([[a / n**3 for a in r] for r in z], np.float64)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = sum(z.diagonal().tolist()) / n**3
    k = min(most, int((values > max(values[0], 0.0) * d * np.finfo(float).eps).sum()))
    vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(axis=0), range(k)])
    return Whitening(n, sums, values[:k].copy(), vectors, [float(e / trace) for e in values[:k]], reach)


def _whitened(model: Whitening, d: int) -> Matrix:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w, deviation = model.project(whole(b, d))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, max(w.shape[1], 1)) if w.shape[1] else np.zeros(len(w) + 1, int), pa.int32()), pa.array(w.ravel()))
                yield pa.record_batch({"vec_id": b["vec_id"], "deviation": pa.array([Decimal(x) for x in deviation], pa.decimal128(38, 0)), "whitened": lists})

    return run


def _moments(model: Whitening, d: int) -> Matrix:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        total = np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                w, _ = model.project(whole(b, d))
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.record_batch({"i": pa.array(range(k + 1), pa.int32()), "row": pa.array(total.tolist(), pa.list_(pa.float64()))})

    return run


def identity_error(rows: DataFrame, d: int, model: Whitening) -> float:
    """The largest entry, in magnitude, of the covariance of the whitened rows less the identity."""
    k = len(model.values)
    if k == 0:
        return 0.0
    sums = rows.mapInArrow(_moments(model, d), "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((k + 1, k))
    for r in sums:
        m[r["i"], r["j"]] = r["v"] / model.n
    return float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())


def whitened(rows: DataFrame, d: int, model: Whitening) -> DataFrame:
    """vec_id, deviation (the sum of squares of n x - S, exact) and whitened (an array) of usable rows."""
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    return rows.mapInArrow(_whitened(model, d), schema)
