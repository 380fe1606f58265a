"""How the sources of a language differ in their words, exactly.

Terms are counted in tasks and sent, compressed, to blocks by a hash; a block
keeps those that enough documents of the language have, numbers them in order,
and makes a vector of counts for each group (language and source), compressed as
gaps and counts. Groups are dealt to cells which stay where they are; in each
round of a round-robin tournament (the circle method) every cell meets one
other, whose compressed vectors travel to it, and both directions are evaluated
at the meeting. Divergence adds up over terms, so blocks are independent. Local
heaps rank a group's own terms in each block.

There is a block for each BLOCK_BYTES of text, so a block's counts are bounded by
that. A task holds one cell, at most CELL_GROUPS groups, and its guest; dense
vectors are made for SPAN terms at a time. Each round is written, so that a lost
executor costs one round. Counts may reach 9e15 in all and languages 5e8 kept
terms: all arithmetic is in whole 64-bit numbers and exact up to there.

Null text, language and source are read as empty. Groups without kept terms take
part with what smoothing gives them. An empty table gives no rows. Extra columns
do not matter, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import columns_free_of, table_path, written

BLOCK_BYTES = 16 << 20
LEAST_BLOCKS = 8
SPAN = 1 << 16
CELL_GROUPS = 128
LEAST_CELL = 8
ROUNDS = 64  # cells grow to CELL_GROUPS groups rather than making more rounds than this
SCALE_STEPS = 3  # thousands in 10^9
FLUSH = 400_000

# terms: letters of ASCII, lower-cased, and everything beyond ASCII; byte by byte in UTF-8
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_COUNTS = pa.schema([("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_PARTS = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("counts", pa.binary())])
_VECTORS = "lang string, block int, source string, size long, total long, entries long, blob binary, terms binary, terms_bytes long"
_VECTORS_ARROW = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("source", pa.string()), ("size", pa.int64()), ("total", pa.int64()), ("entries", pa.int64()), ("blob", pa.binary()), ("terms", pa.binary()), ("terms_bytes", pa.int64())])
_MEETING = "kind string, lang string, g long, other long, item string, value long"
_MEETING_ARROW = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("g", pa.int64()), ("other", pa.int64()), ("item", pa.string()), ("value", pa.int64())])
Groups = dict[tuple[str, str], tuple[Counter, Counter]]


def _parts(groups: Groups, blocks: int) -> Iterator[pa.RecordBatch]:
    """The counts of a task, a row for each language and block that has any."""
    for lang in sorted({lang for lang, _ in groups}):
        sources, terms, n, docs = [], [], [], []
        for (of, source), (count, seen) in groups.items():
            if of == lang:
                sources += [source] * len(count)
                terms += count.keys()
                n += count.values()
                docs += map(seen.__getitem__, count)
        block = (np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        table = pa.table([sources, terms, n, docs], schema=_COUNTS).take(pa.array(order))
        present, starts = np.unique(block[order], return_index=True)
        for b, s, e in zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), len(terms)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _COUNTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table.slice(s, e - s).combine_chunks())
            yield pa.record_batch([pa.array([lang]), pa.array([b], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=_PARTS)


def _count(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: Groups = {}
        for b in batches:
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"]):
                words = text.as_buffer().to_pybytes().translate(_TERM_BYTES).split()
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in groups.values()) > FLUSH:
                yield from _parts(groups, blocks)
                groups.clear()
        yield from _parts(groups, blocks)

    return run


def _packed(ids: np.ndarray, n: np.ndarray) -> bytes:
    """Counts of terms in order of their numbers, as gaps and counts."""
    return pa.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + n.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def _vectors(least_docs: int):
    def run(key: tuple, parts: pa.Table) -> pa.Table:
        """The vectors of a block: of each source, and with a null source of the language."""
        lang, block = (k.as_py() for k in key)
        counts = pa.concat_tables(pa.ipc.open_stream(c).read_all() for c in parts["counts"].to_pylist())
        counts = counts.group_by(["source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        terms = counts.group_by("term").aggregate([("docs_sum", "sum"), ("n_sum", "sum")])
        terms = terms.filter(pc.greater_equal(terms["docs_sum_sum"], least_docs)).sort_by("term")
        size = terms.num_rows
        if size == 0:
            return _VECTORS_ARROW.empty_table()
        counts = counts.append_column("id", pc.index_in(counts["term"], value_set=terms["term"].combine_chunks()))
        counts = counts.filter(pc.is_valid(counts["id"])).sort_by([("source", "ascending"), ("id", "ascending")])
        ids, n = counts["id"].to_numpy().astype(np.int64), counts["n_sum"].to_numpy()
        whole = terms["n_sum_sum"].to_numpy()
        names = b"\n".join(terms["term"].to_pylist())
        rows = [(lang, block, None, size, int(whole.sum()), size, _packed(np.arange(size), whole), pa.compress(names, codec="zstd", asbytes=True), len(names))]
        at = 0
        for run in pc.value_counts(counts["source"]).to_pylist():  # in order of their first rows
            part = slice(at, at + run["counts"])
            rows.append((lang, block, run["values"], size, int(n[part].sum()), run["counts"], _packed(ids[part], n[part]), None, None))
            at = part.stop
        return pa.table([list(c) for c in zip(*rows)], schema=_VECTORS_ARROW)

    return run


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), by long division in base 1000."""
    whole, rest = np.divmod(counts + 1, total)
    for _ in range(SCALE_STEPS):
        rest *= 1000
        whole = whole * 1000 + rest // total
        rest %= total
    return whole + 1


class Vector:
    """A group's counts in a block, unpacked."""

    def __init__(self, row: dict):
        self.lang, self.g, self.size, self.over = row["lang"], row["g"], row["size"], row["total"] + row["terms_kept"]
        k = row["entries"] or 0
        raw = pa.decompress(row["blob"], decompressed_size=12 * k, codec="zstd", asbytes=True) if k else b""
        self.ids = np.cumsum(np.frombuffer(raw, "<u4", k).astype(np.int64))
        self.n = np.frombuffer(raw, "<i8", k, 4 * k)

    def span(self, start: int) -> np.ndarray:
        """The shares of SPAN terms from start on."""
        counts = np.zeros(min(SPAN, self.size - start), np.int64)
        a, b = np.searchsorted(self.ids, [start, start + SPAN])
        counts[self.ids[a:b] - start] = self.n[a:b]
        return shares(counts, self.over)


def _met(home: list[Vector], guests: list[Vector], within: bool) -> list[tuple]:
    """Both directions of each meeting of two groups; within a cell, of each two of it."""
    met = [(a, b) for j, b in enumerate(guests) for a in (home[:j] if within else home)]
    sums = dict.fromkeys([(a.g, b.g) for a, b in met] + [(b.g, a.g) for a, b in met], 0)
    for start in range(0, home[0].size, SPAN) if home else ():
        ps = [a.span(start) for a in home]
        for j, b in enumerate(guests):
            q = ps[j] if within else b.span(start)
            for a, p in zip(home[:j] if within else home, ps):
                d = p - q
                d *= d
                sums[a.g, b.g] += int((d // q).sum())
                sums[b.g, a.g] += int((d // p).sum())
    return [("pair", home[0].lang, g, other, None, v) for (g, other), v in sums.items()]


def _own_terms(group: Vector, whole: Vector, terms: list[bytes], most: int) -> list[tuple]:
    """The terms a group has more of than its language, the first `most` by a heap."""
    p, q = shares(group.n, group.over), shares(whole.n[group.ids], whole.over)
    more = p > q
    at, p, q = group.ids[more], p[more], q[more]
    best = heapq.nsmallest(most, zip((-((p - q) * (p - q) // q)).tolist(), at.tolist()))
    return [("term", group.lang, group.g, None, terms[t].decode(), -v) for v, t in best]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([list(c) for c in zip(*rows)] or [[] for _ in _MEETING_ARROW], schema=_MEETING_ARROW)


def _at_home(most: int):
    def run(key: tuple, home: pa.Table, whole: pa.Table) -> pa.Table:
        """A cell's groups with each other, and each with its language."""
        groups = [Vector(r) for r in home.to_pylist()]
        rows = _met(groups, groups, within=True)
        if whole.num_rows and groups:
            row = whole.to_pylist()[0]
            terms = pa.decompress(row["terms"], decompressed_size=row["terms_bytes"], codec="zstd", asbytes=True).split(b"\n")
            for g in groups:
                rows += _own_terms(g, Vector(row), terms, most)
        return _table(rows)

    return run


def _meet(key: tuple, home: pa.Table, guests: pa.Table) -> pa.Table:
    """A cell's groups with those of its guest."""
    return _table(_met([Vector(r) for r in home.to_pylist()], [Vector(r) for r in guests.to_pylist()], within=False) if home.num_rows and guests.num_rows else [])


def partner(cell: Column, cells: Column, turn: int) -> Column:
    """Whom a cell meets in a round, by the circle method: cells is even, turns
    count from 0 to cells - 2, and the last cell stays in the middle."""
    m = cells - 1
    other = F.pmod(F.lit(turn) - cell, m)
    return F.when(cell == m, F.pmod(F.lit(turn) * (cells / 2).cast("long"), m)).when(other == cell, m).otherwise(other)


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200, block_bytes: int = BLOCK_BYTES, cell_groups: int | None = None) -> DataFrame:
    """docs (text, lang, source): lang, source, part, item, value, rank. Part
    `pair` gives each other source of the language with the divergence from it,
    part `term` the terms (most_terms at most) that a source has more of than
    its language, by their share of the divergence. Ranks count from 1 by
    falling value and rising item."""
    spark = docs.sparkSession
    rows = columns_free_of(docs, "text", "lang", "source").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(LEAST_BLOCKS, size // block_bytes + 1)
    parts = rows.mapInArrow(_count(n_blocks), "lang string, block int, counts binary")
    vectors = written(parts.groupBy("lang", "block").applyInArrow(_vectors(least_docs), _VECTORS), "divergence-vectors")

    # groups with their sums, numbered within their language and dealt to cells
    kept = vectors.where("source is null").groupBy("lang").agg(F.sum("size").alias("terms_kept"), F.sum("total").alias("lang_total"))
    sums = vectors.where("source is not null").groupBy("lang", "source").agg(F.sum("total").alias("total"))
    g = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "terms_kept", "lang_total"])
    groups = groups.withColumns({"g": g, "groups": F.count("*").over(Window.partitionBy("lang"))})
    per_cell = F.lit(cell_groups) if cell_groups else F.least(F.lit(CELL_GROUPS), F.greatest(F.lit(LEAST_CELL), F.ceil(F.col("groups") / ROUNDS)))
    cells = {"cell": F.floor(F.col("g") / per_cell).cast("long"), "cells": F.ceil(F.ceil(F.col("groups") / per_cell) / 2).cast("long") * 2}
    groups = written(groups.withColumns(cells).drop("groups"), "divergence-groups")

    # a place for each group in each block of its language, one at least
    whole = vectors.where("source is null").select("lang", "block", "size")
    sized = groups.select("lang").distinct().join(whole, "lang", "left").na.fill(0, ["block", "size"])
    places = groups.drop("lang_total").join(sized, "lang").join(vectors.select("lang", "block", "source", "entries", "blob"), ["lang", "block", "source"], "left")
    stored = table_path(spark, "divergence-places")
    places.write.parquet(stored)
    schema = places.schema
    fresh = lambda: spark.read.schema(schema).parquet(stored)  # noqa: E731, each with columns of its own
    langs = vectors.where("source is null").join(groups.select("lang", "terms_kept", F.col("lang_total").alias("all"), "cell").distinct(), "lang")
    langs = langs.select("lang", "block", "cell", F.lit(-1).cast("long").alias("g"), "size", F.col("all").alias("total"), "terms_kept", "entries", "blob", "terms", "terms_bytes")

    keys = ["lang", "block", "cell"]
    home = fresh().repartition(*keys).persist(StorageLevel.DISK_ONLY)
    path = table_path(spark, "divergence-meetings")
    most_cells = groups.agg(F.max("cells")).first()[0] or 0
    home.groupBy(*keys).cogroup(langs.groupBy(*keys)).applyInArrow(_at_home(most_terms), _MEETING).write.parquet(f"{path}/turn=-1")
    for turn in range(most_cells - 1):
        # of two that meet, the one with the smaller number hosts if their sum is even
        to = partner(F.col("cell"), F.col("cells"), turn)
        travels = (F.pmod(F.col("cell") + to, F.lit(2)) == 0) == (F.col("cell") > to)
        guests = fresh().where(F.col("cells") - 1 > turn).where(travels).withColumn("cell", to)
        home.groupBy(*keys).cogroup(guests.groupBy(*keys)).applyInArrow(_meet, _MEETING).write.parquet(f"{path}/turn={turn}")
    home.unpersist()

    met = spark.read.schema(_MEETING).parquet(path)
    names = groups.select("lang", "g", "source")
    pair = met.where("kind = 'pair'").groupBy("lang", "g", "other").agg(F.sum("value").alias("value")).join(names.select("lang", F.col("g").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    found = pair.select("lang", "g", F.lit("pair").alias("part"), "item", "value").unionByName(met.where("kind = 'term'").select("lang", "g", F.lit("term").alias("part"), "item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "g", "part").orderBy(F.desc("value"), "item"))
    found = found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= most_terms))
    return found.join(names, ["lang", "g"]).select("lang", "source", "part", "item", "value", "rank")
