"""Approximate nearest neighbours by score-aware (anisotropic) quantisation.

Vectors are scaled to unit length, so the largest cosine is the largest inner
product. A coarse quantiser deals them into cells; within a cell the residual
is product-quantised with 16 centres for each pair of dimensions, four bits
each. Codes and centres minimise an anisotropic loss, which weighs the part of
the error along the vector itself, the part that changes large inner products,
more than the part across it.

A search scans codes by table look-up and ranks again by exact cosine, in double
precision, every row of a block whose table score may reach the block's k-th
best: how far table scores are off is known from the mean and covariance of the
block's own residual errors. Cells are visited in two rounds: the nearest few,
and then those that can hold a better row by the angle to their centre and the
widest angle in them. Close vectors therefore need few cells and are ranked
whole; vectors without structure rule out no cell, and there `probe` is the
share of cells that are looked into.

The quantisers are fitted on a bounded sample; every row is indexed, once, in a
stored table. Queries stream past one block of the index at a time, so a task
holds a block and a batch. Equal vectors are indexed once with their smallest
ids: of equal vectors no more than k + 1 can be among a query's k nearest, ties
going to smaller ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import columns_free_of, written

_CENTRES = 16
DEVIATIONS = 4.0  # of a block's errors, that a row may score above its table score


@dataclass
class Quantiser:
    cells: np.ndarray  # centres of cells x dimensions
    books: np.ndarray  # parts x 16 x dimensions of a part
    eta: float  # weight of the parallel error against the orthogonal one

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1])))

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.cells.T - 0.5 * (self.cells**2).sum(1), axis=1)

    def codes(self, x: np.ndarray, cell: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss."""
        parts, _, d = self.books.shape
        along = self.padded(x).reshape(len(x), parts, d)
        left = self.padded(x - self.cells[cell]).reshape(len(x), parts, d)
        dist = ((left[:, :, None, :] - self.books[None]) ** 2).sum(-1)
        code = dist.argmin(2)
        gain = ((left[:, :, None, :] - self.books[None]) * along[:, :, None, :]).sum(-1)  # of each choice, along x
        rows = np.arange(len(x))
        total = np.take_along_axis(gain, code[:, :, None], 2).sum((1, 2))
        for _ in range(rounds):
            for m in range(parts):
                rest = total - gain[rows, m, code[:, m]]
                code[:, m] = (dist[:, m] + (self.eta - 1) * (rest[:, None] + gain[:, m]) ** 2).argmin(1)
                total = rest + gain[rows, m, code[:, m]]
        return code.astype(np.uint8)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, n_cells: int, threshold: float = 0.2, rounds: int = 3, seed: int = 7) -> Quantiser:
    """Fit on unit vectors. threshold is the inner product from which scores
    matter; it sets the weight of the parallel error."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    cells = _kmeans(sample, max(1, min(n_cells, len(sample))), rng)
    parts = (dims + 1) // 2
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    q = Quantiser(cells, np.zeros((parts, _CENTRES, 2)), eta)
    own = q.cell_of(sample)
    left = q.padded(sample - cells[own])
    for m in range(parts):
        q.books[m] = _kmeans(left[:, 2 * m : 2 * m + 2], _CENTRES, rng)
    x, u = q.padded(sample), left
    n, width = len(sample), q.width
    for _ in range(rounds):
        code = q.codes(sample, own)
        # centres for fixed codes: least squares of |u - c|^2 + (eta - 1) ((u - c).x)^2
        slot = (np.arange(parts)[None] * _CENTRES + code)[:, :, None] * 2 + np.arange(2)
        slot = slot.reshape(n, width)
        design = np.zeros((n, parts * _CENTRES * 2), np.float32)
        np.put_along_axis(design, slot, x.astype(np.float32), 1)
        a = (eta - 1) * (design.T @ design).astype(float)
        a[np.diag_indices_from(a)] += np.bincount(slot.ravel(), minlength=len(a)) + 1e-3
        b = np.bincount(slot.ravel(), u.ravel(), len(a)) + (eta - 1) * (design.T @ (u * x).sum(1).astype(np.float32)) + 1e-3 * q.books.ravel()
        q.books = np.linalg.solve(a, b).reshape(q.books.shape)
    return q


def usable(vector: Column) -> Column:
    """Neither null nor empty, all parts finite, not all zero."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, number) & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest part, for range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Block:
    """A block of the index in a task: its rows, their codes, and the moments of
    what the codes leave of them."""

    x: np.ndarray
    ids: list[list[int]]
    code: np.ndarray  # a byte for each two parts
    centre: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    @classmethod
    def of(cls, q: Quantiser, cell: int, table: pa.Table) -> Block:
        x = _unit(_matrix(table["embedding"]))
        code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(x), -1)
        parts = len(q.books)
        halves = np.stack([code & 15, code >> 4], 2).reshape(len(x), -1)[:, :parts]
        decoded = q.books[np.arange(parts), halves].reshape(len(x), -1)[:, : x.shape[1]]
        left = x - q.cells[cell] - decoded
        mean = left.mean(0)
        return cls(x, table["ids"].to_pylist(), code, q.cells[cell], mean, left.T @ left / len(left) - np.outer(mean, mean))

    def best(self, q: Quantiser, one: np.ndarray, k: int, rerank: int) -> list[tuple[float, int]]:
        """The k best ids of the block for a query, as (-score, id)."""
        pairs = (len(q.books) + 1) // 2
        table = (q.books * q.padded(one[None]).reshape(-1, 1, 2)).sum(2)
        table = np.pad(table, ((0, 2 * pairs - len(table)), (0, 0)))
        both = table[1::2, :, None] + table[::2, None, :]  # of a byte: high half, low half
        near = np.take_along_axis(both.reshape(pairs, 256), self.code.T.astype(np.int64), 1).sum(0)
        top = np.argpartition(-near, rerank)[:rerank] if len(near) > rerank else np.arange(len(near))
        exact = self.x[top] @ one
        if len(top) < len(near):
            least = np.partition(exact, -min(k, len(exact)))[-min(k, len(exact))]
            off = float(self.mean @ one) + DEVIATIONS * max(float(one @ self.cov @ one), 0.0) ** 0.5
            more = np.flatnonzero(near + float(self.centre @ one) + off >= least)
            top = np.union1d(top, more)
            exact = self.x[top] @ one
        if len(top) > 4 * k:  # only what can be among the k best is sorted
            some = exact >= np.partition(exact, -k)[-k]
            top, exact = top[some], exact[some]
        return sorted((-float(s), i) for s, t in zip(exact, top) for i in self.ids[t])[:k]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, sample_rows: int = 8_000, block_rows: int = 4_096, probe: float = 0.8, rerank: int = 100, first_cells: int = 8) -> DataFrame:
    """The k nearest rows of each query row by cosine: query_id, rank, vec_id,
    score; ties go to smaller ids and a query's own row does not count.

    vectors has vec_id (long) and embedding (array of numbers); other columns
    are ignored. Embeddings that are null, empty, zero, or hold null or
    non-finite parts take no part; nor do rows with a null id, nor rows whose
    dimension is not the most common one. Rows that share a vec_id are as
    many candidates for others. sample_rows bounds the rows that the quantisers are
    fitted on, block_rows the index rows in one task. first_cells cells are
    looked into first, others, in order of their centres and up to the share
    probe of all, if their angles allow a better row. At least rerank rows of a
    block are ranked exactly, more where the block's errors allow them to be among the k best.
    """
    rows = columns_free_of(vectors, "vec_id", "embedding").withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "is_query").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    dims, n = common
    rows = rows.where(F.size("embedding") == dims).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))
    spark = vectors.sparkSession

    # equal vectors: their k + 1 smallest ids, cut before the shuffle too
    least = Window.partitionBy("k1", "k2").orderBy("vec_id")
    classes = rows.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1).groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))

    share = sample_rows / n  # by a hash of ids, so that about sample_rows come, from however many tasks
    some = rows if share >= 1 else rows.where(F.xxhash64("vec_id", F.lit(3)) < int(-(2**63) + share * 2**64))
    drawn = some.select("embedding").limit(2 * sample_rows).toArrow()
    if not drawn.num_rows:  # few distinct ids, all with high hashes
        drawn = rows.select("embedding").limit(sample_rows).toArrow()
    n_cells = int(max(1, min(1024, (n / 8) ** 0.5)))
    q = spark.sparkContext.broadcast(fit(_unit(_matrix(drawn["embedding"])), n_cells))
    cells = q.value.cells
    n_cells = len(cells)
    size = np.sqrt((cells**2).sum(1, keepdims=True))
    towards = np.divide(cells, size, out=np.zeros_like(cells), where=size > 0)  # directions of the centres

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_matrix(b.column("embedding"))) if b.num_rows else np.zeros((0, dims))
            cell = q.value.cell_of(x)
            code = q.value.codes(x, cell)
            code = np.pad(code, ((0, 0), (0, code.shape[1] % 2)))
            packed = code[:, ::2] | code[:, 1::2] << 4
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("ids"), b.column("embedding"), pa.array(cell.astype(np.int32)), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array((x * towards[cell]).sum(1))], ["k1", "ids", "embedding", "cell", "code", "lean"])

    index = written(classes.mapInArrow(indexed, "k1 long, ids array<long>, embedding array<double>, cell int, code binary, lean double"), "index")
    stats = {r.cell: (r.n, r.lean) for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.min("lean").alias("lean")).collect()}  # at most one row for each cell
    pieces = [stats[c][0] // block_rows + 1 if c in stats else 0 for c in range(n_cells)]
    widest = np.array([np.arccos(np.clip(stats[c][1], -1, 1)) if c in stats else 0.0 for c in range(n_cells)])
    per_cell = F.array(*[F.lit(max(p, 1)) for p in pieces])
    index = index.withColumn("block", F.pmod(F.col("k1"), F.element_at(per_cell, F.col("cell") + 1)).cast("int"))
    probes = max(1, min(n_cells, max(first_cells, round(probe * n_cells))))

    def routed(later: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The blocks that each query visits: of the nearest cells, or later of the others that can do better."""
            for b in batches:
                x = _unit(_matrix(b.column("query"))) if b.num_rows else np.zeros((0, dims))
                best = np.argsort(-(x @ cells.T - 0.5 * (cells**2).sum(1)), axis=1, kind="stable")
                if later:
                    angle = np.arccos(np.clip(x @ towards.T, -1, 1))
                    reach = np.cos(np.maximum(angle - widest, 0))
                    least = np.array(b.column("least").to_pylist(), float)[:, None]
                    where = [(i, int(c), p) for i, cs in enumerate(best[:, first_cells:probes]) for c in cs if reach[i, c] >= least[i, 0] - 1e-9 for p in range(pieces[c])]
                else:
                    where = [(i, int(c), p) for i, cs in enumerate(best[:, :first_cells]) for c in cs for p in range(pieces[c])]
                i = pa.array([w[0] for w in where], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("q1").take(i), b.column("q2").take(i), b.column("query").take(i), pa.array([w[1] for w in where], pa.int32()), pa.array([w[2] for w in where], pa.int32())], ["q1", "q2", "embedding", "cell", "block"])

        return run

    best_of = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of cell, block and asks: a block of the index, then its queries."""
        at, held, block = None, [], None
        for b in batches:
            t = pa.Table.from_batches([b])
            keys = np.stack([t[c].to_numpy() for c in ("cell", "block", "asks")])
            cuts = np.flatnonzero((np.diff(keys) != 0).any(0)) + 1
            for s, e in zip([0, *cuts], [*cuts, t.num_rows]):
                if s == e:
                    continue
                cell, number, asks = keys[:, s].tolist()
                if (cell, number) != at:
                    at, held, block = (cell, number), [], None
                if not asks:
                    held.append(t.slice(s, e - s))
                elif held:
                    block = block or Block.of(q.value, cell, pa.concat_tables(held))
                    part, out = t.slice(s, e - s), []
                    for q1, q2, one in zip(part["q1"].to_pylist(), part["q2"].to_pylist(), _unit(_matrix(part["embedding"]))):
                        out += [(q1, q2, i, -score) for score, i in block.best(q.value, one, k + 1, rerank)]
                    yield from pa.table([list(c) for c in zip(*out)], schema=best_of).to_batches()

    def scanned(visits: DataFrame) -> DataFrame:
        none = lambda t: F.lit(None).cast(t)
        left = index.select("cell", "block", F.lit(0).alias("asks"), none("long").alias("q1"), none("long").alias("q2"), "embedding", "ids", "code")
        right = visits.select("cell", "block", F.lit(1).alias("asks"), "q1", "q2", "embedding", none("array<long>").alias("ids"), none("binary").alias("code"))
        dealt = left.unionByName(right).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")
        return dealt.mapInArrow(streamed, "q1 long, q2 long, vec_id long, score double")

    visit = "q1 long, q2 long, embedding array<double>, cell int, block int"
    asked = written(rows.where("is_query").groupBy(F.col("k1").alias("q1"), F.col("k2").alias("q2")).agg(F.first("embedding").alias("query")), "queries")
    found = written(scanned(asked.mapInArrow(routed(False), visit)), "first")
    by_key = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    if probes > first_cells:
        last = found.withColumn("place", F.row_number().over(by_key)).where(F.col("place") == k + 1).select("q1", "q2", F.col("score").alias("least"))
        more = asked.join(last, ["q1", "q2"], "left").select("q1", "q2", "query", F.coalesce("least", F.lit(-2.0)).alias("least"))
        found = found.unionByName(scanned(more.mapInArrow(routed(True), visit)))
    short = found.withColumn("place", F.row_number().over(by_key)).where(F.col("place") <= k + 1).drop("place")
    queries = rows.where("is_query").select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = queries.join(short, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))).where("vec_id <> query_id")
    return hits.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
