"""The best rows for each of many queries, as products of blocks of matrices.

Queries below a checked size go to every task, which scans its rows once and
keeps each query's best; beyond it rows and queries are dealt into blocks whose
numbers follow the data, and each block of rows meets each block of queries in a
task of its own. Either way a task gives at most `limit` rows a query (ties are
settled by the item), so nothing that could rank is lost.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType

MOST_QUERY_BYTES = 64 << 20
ROW_BLOCK_BYTES = 64 << 20
CELLS = 4 << 20  # entries of a block's score matrix
NAMED_UNITS = 20  # a named article scores 2.0, a token 0.1
SLACK = 1e-9  # scores this close to a block's last place are computed again before they are ranked

Best = Callable[[Iterator[pa.RecordBatch], pa.Table], Iterator[pa.RecordBatch]]


_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory, where the C library can: a worker otherwise keeps
    what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def sortable(rows: DataFrame) -> bool:
    return isinstance(rows.schema["item"].dataType, (IntegralType, StringType, DateType))


def best_of(rows: DataFrame, queries: DataFrame, size: str, best: Best, schema: str, most: int = MOST_QUERY_BYTES) -> DataFrame:
    """best over all rows and queries; size is SQL for the bytes of a query. The
    result is each task's or block's best, still to be ranked."""
    total = queries.agg(F.expr(f"coalesce(sum({size}), 0) + 64 * count(*)")).first()[0]
    if total <= most:
        asked = queries.toArrow()
        return rows.mapInArrow(lambda batches: best(batches, asked), schema)
    bytes_of = " + ".join(f"coalesce(size({f.name}), 0) * 16" if f.dataType.typeName() == "array" else "16" for f in rows.schema.fields)
    row_blocks = max(1, -(-rows.agg(F.expr(f"sum({bytes_of})")).first()[0] // ROW_BLOCK_BYTES))
    query_blocks = -(-total // most)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("__r", F.pmod(F.xxhash64("item"), F.lit(row_blocks)).cast("int")).withColumn("__q", every(query_blocks))
    right = queries.withColumn("__q", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int")).withColumn("__r", every(row_blocks))

    def meet(r: pa.Table, q: pa.Table) -> pa.Table:
        found = list(best(iter(r.combine_chunks().to_batches()), q)) if r.num_rows and q.num_rows else []
        return pa.Table.from_batches(found) if found else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return left.groupBy("__r", "__q").cogroup(right.groupBy("__r", "__q")).applyInArrow(meet, schema)


def _named(batch: pa.Table, asked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows and queries where the query names the row's article."""
    if "article" not in batch.column_names or "articles" not in asked.column_names:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _held(batch["article"], asked["articles"])


def _held(values: pa.ChunkedArray, lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose value a query's list holds, and the queries."""
    lists = lists.combine_chunks()
    flat, of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    if len(flat) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    names = pc.unique(flat)
    at, place = pc.index_in(values, value_set=names), pc.index_in(flat, value_set=names).to_numpy()
    rows = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False) & pc.is_valid(values).to_numpy(zero_copy_only=False))
    order = np.argsort(place, kind="stable")
    starts, ends = (np.searchsorted(place[order], np.arange(len(names)), side) for side in ("left", "right"))
    hit = [(r, order[starts[p] : ends[p]]) for r, p in zip(rows.tolist(), pc.take(at, pa.array(rows)).to_pylist())]
    return np.repeat([r for r, _ in hit], [len(q) for _, q in hit]).astype(np.int64), np.concatenate([of[q] for _, q in hit] or [np.empty(0, np.int64)]).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.Table]:
    for b in batches:
        for start in range(0, b.num_rows, step):
            yield pa.Table.from_batches([b.slice(start, step)]).sort_by("item")
        del b
        give_back()


def _cut(found: pa.Table, order: list[tuple[str, str]], limit: int) -> pa.Table:
    """The first rows of each query in an order."""
    found = found.sort_by([("q", "ascending"), *order])
    q = found["q"].to_numpy()
    place = np.arange(len(q)) - np.searchsorted(q, q, "left")
    return found.filter(pa.array(place < limit)).combine_chunks()


def keyword_best(limit: int) -> Best:
    """rows: item, tokens, and optionally counts (of each token) and article."""

    def best(batches: Iterator[pa.RecordBatch], asked: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = asked["terms"].combine_chunks()
        terms, of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        names = pc.unique(terms)
        n_terms, n_queries = len(names), asked.num_rows
        if n_queries == 0:
            return
        wanted = np.zeros((n_terms, n_queries))
        wanted[pc.index_in(terms, value_set=names).to_numpy(), of] = 1
        kept = None
        for t in _blocks(batches, max(16, CELLS // max(n_terms, n_queries, 1024))):
            m = t.num_rows
            tokens = t["tokens"].combine_chunks()
            flat = pc.list_flatten(tokens)
            weights = pc.list_flatten(t["counts"].combine_chunks()).to_numpy() if "counts" in t.column_names else None
            at = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy() if n_terms else np.full(len(flat), -1)
            some = at >= 0
            cells = pc.list_parent_indices(tokens).to_numpy()[some] * n_terms + at[some]
            have = np.bincount(cells, np.ones(len(cells)) if weights is None else weights[some], minlength=m * n_terms)
            score = have.reshape(m, n_terms) @ wanted if n_terms else np.zeros((m, n_queries))
            del have
            score[_named(t, asked)] = NAMED_UNITS
            if "excluded" in asked.column_names:
                score[_held(t["item"], asked["excluded"])] = 0
            # rows are in order of their items, so earlier ones win ties; the key takes the place of the score, which it holds
            score *= -m
            score -= np.arange(m - 1, -1, -1)[:, None]
            top = np.argpartition(score, min(limit, m) - 1, axis=0)[:limit].copy()
            r, q = top.ravel(), np.tile(np.arange(n_queries), len(top))
            n = (-score[r, q]).astype(np.int64) // m
            del score, top
            r, q, n = r[n > 0], q[n > 0], n[n > 0]
            found = pa.table({"q": pa.array(q, pa.int32()), "item": t["item"].take(pa.array(r)), "n": pa.array(n)})
            kept = _cut(found if kept is None else pa.concat_tables([kept, found]), [("n", "descending"), ("item", "ascending")], limit)
        if kept is not None and kept.num_rows:
            out = pa.table({"query": asked["query"].combine_chunks().take(kept["q"].combine_chunks()), "item": kept["item"], "n": kept["n"]})
            yield from out.combine_chunks().to_batches()

    return best


def vector_best(limit: int) -> Best:
    """rows: item, vector, and optionally article. Vectors without a cosine (null,
    zero, other dimension, non-finite) are hits only by their article."""

    def unit(lists: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows with a usable vector of d entries, and the vectors at length one."""
        rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), d), False).to_numpy(zero_copy_only=False))
        v = pc.list_flatten(lists.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        with np.errstate(all="ignore"):
            norm = np.sqrt((v * v).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            return rows[good], v[good] / norm[good, None]

    def best(batches: Iterator[pa.RecordBatch], asked: pa.Table) -> Iterator[pa.RecordBatch]:
        n_queries = asked.num_rows
        if n_queries == 0:
            return
        vectors = asked["query_vector"].combine_chunks()
        sizes = sorted({s for s in pc.list_value_length(vectors).to_pylist() if s})
        wanted = {d: unit(vectors, d) for d in sizes}
        kept = None
        for t in _blocks(batches, max(64, min(4096, CELLS // n_queries))):
            m = t.num_rows
            mine = {d: unit(t["vector"].combine_chunks(), d) for d in sizes}
            near = np.full((m, n_queries), np.nan)
            for d in sizes:
                near[np.ix_(mine[d][0], wanted[d][0])] = mine[d][1] @ wanted[d][1].T
            worth = np.where(np.isnan(near), -np.inf, near)
            named = np.zeros((m, n_queries), bool)
            named[_named(t, asked)] = True
            worth[named] = np.where(np.isnan(near[named]), 8.0, near[named] + 10.0)  # all of these above all cosines
            if "excluded" in asked.column_names:
                worth[_held(t["item"], asked["excluded"])] = -np.inf
            last = -np.partition(-worth, min(limit, m) - 1, axis=0)[min(limit, m) - 1]
            r, q = np.nonzero((worth >= last - SLACK) & (worth > -np.inf))
            exact = np.full(len(r), np.nan)
            for d in sizes:
                row_at, query_at = np.full(m, -1), np.full(n_queries, -1)
                row_at[mine[d][0]], query_at[wanted[d][0]] = np.arange(len(mine[d][0])), np.arange(len(wanted[d][0]))
                both = (row_at[r] >= 0) & (query_at[q] >= 0)
                exact[both] = (mine[d][1][row_at[r[both]]] * wanted[d][1][query_at[q[both]]]).sum(axis=1)
            found = pa.table({"q": pa.array(q, pa.int32()), "item": t["item"].take(pa.array(r)), "named": pa.array(named[r, q]), "near": pa.array(exact, mask=np.isnan(exact))})
            kept = _cut(found if kept is None else pa.concat_tables([kept, found]), [("named", "descending"), ("near", "descending"), ("item", "ascending")], limit)
        if kept is not None and kept.num_rows:
            out = pa.table({"query": asked["query"].combine_chunks().take(kept["q"].combine_chunks()), "item": kept["item"], "named": kept["named"], "near": kept["near"]})
            yield from out.combine_chunks().to_batches()

    return best
