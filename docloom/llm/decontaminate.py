"""Benchmark decontamination with Aho-Corasick automata.

Texts and benchmark items are normalised alike (A-Z lower-cased, words of
digits, letters and anything beyond ASCII, one space between them). The windows
of all items go into an automaton, which scans each normalised text once; hits
are mapped back to offsets in the original text.

An automaton is made for a block of items of a stated size. A benchmark of one
block has its automaton built once in each worker, which texts stream through.
With more blocks a task takes texts in bounded batches and scans each batch with
one block's automaton after the other. Items reach the tasks by a broadcast of a
stated size; a larger benchmark makes several passes over the texts, each with a
part of the items, whose broadcast goes before the next is made. At any size
every window is found by an automaton, and texts are never shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import columns_free_of, written

BLOCK_BYTES = 400_000  # of item text behind one automaton, which takes some hundred times that
PASS_BYTES = 64 << 20  # of item text in one broadcast
BATCH_BYTES = 32 << 20  # of text that a task holds while block after block scans it

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_built: dict[tuple[str, int], "Matcher"] = {}

RESULT = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


Item = tuple[int, list[bytes]]


def blocks_of(items: list[tuple[int, str | None]], n: int, block_bytes: int) -> list[list[Item]]:
    """The words of items in blocks of about block_bytes. An item that is larger
    goes into several, which overlap by all but one word of a window."""
    blocks: list[list[Item]] = [[]]
    room = block_bytes
    for item, text in items:
        words = normal_words(text)
        start = 0
        while start < len(words):
            end, size = start, 0
            while end < len(words) and (end - start < n or size < max(room, 1)):
                size += len(words[end]) + 1
                end += 1
            blocks[-1].append((item, words[start:end]))
            room -= size
            if room <= 0:
                blocks.append([])
                room = block_bytes
            if end == len(words):
                break
            start = end - n + 1
    return [b for b in blocks if b]


class Matcher:
    """The automaton of a block of items."""

    def __init__(self, items: list[Item], n: int):
        self.automaton = ahocorasick.Automaton()
        found: dict[str, tuple[int, list[int]]] = {}
        for item, words in items:
            size = min(n, len(words))
            for i in range(len(words) - size + 1):
                _, owners = found.setdefault(f" {b' '.join(words[i : i + size]).decode()} ", (size, []))
                if item not in owners:
                    owners.append(item)
        for window, value in found.items():
            self.automaton.add_word(window, value)
        if found:
            self.automaton.make_automaton()

    def occurs(self, words: list[bytes]) -> Iterator[tuple[int, tuple[int, list[int]]]]:
        """Where each window that occurs ends in the normalised text, and its size and items."""
        return self.automaton.iter(f" {b' '.join(words).decode()} ") if words and len(self.automaton) else iter(())

    def hits(self, words: list[bytes]) -> list[tuple[int, int, list[int]]]:
        """The range of words of each window that occurs, and its items."""
        found = list(self.occurs(words))
        if not found:
            return []
        after = np.array(list(accumulate(len(w.decode()) + 1 for w in words)))  # place of the space after each word
        ends = (np.searchsorted(after, [end for end, _ in found]) + 1).tolist()
        return [(e - size, e, owners) for e, (_, (size, owners)) in zip(ends, found)]


def matcher(name: str, number: int, block: list[Item], n: int) -> Matcher:
    """Built once in each worker while it is the only one of its benchmark in use."""
    if (name, number) not in _built:
        _built.clear()
        _built[name, number] = Matcher(block, n)
    return _built[name, number]


def scanned(name: str, blocks: list[list[Item]], n: int, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[int]]]:
    """For each text, as words, the ranges that windows occupy and the items they are from."""
    out: list[tuple[list[tuple[int, int]], set[int]]] = [([], set()) for _ in texts]
    for number, block in enumerate(blocks):
        m = matcher(name, number, block, n)
        for words, (ranges, items) in zip(texts, out):
            for start, end, owners in m.hits(words):
                ranges.append((start, end))
                items.update(owners)
    return out


def items_of(benchmark: DataFrame) -> DataFrame:
    return columns_free_of(benchmark, "item_id", "text").where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()


def passes(benchmark: DataFrame, pass_bytes: int) -> list[DataFrame]:
    """The items in parts of about pass_bytes, one if they all fit."""
    items = items_of(benchmark)
    parts = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // pass_bytes + 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) for p in range(parts)] if parts > 1 else [items]


def shared_blocks(items: DataFrame, n: int, block_bytes: int) -> Broadcast:
    rows = items.collect()  # a pass's bytes at most, but for an item that is larger alone
    return items.sparkSession.sparkContext.broadcast(blocks_of(sorted((r.item_id, r.text) for r in rows), n, block_bytes))


def _node() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def found_in_passes(docs: DataFrame, parts: list[DataFrame], n: int, block_bytes: int) -> DataFrame:
    """node (a digest of a text of docs), ranges and items of the texts that hold
    any window, gathered pass by pass."""
    texts, hits = docs.select(_node().alias("node"), "text"), []
    for items in parts:
        shared = shared_blocks(items, n, block_bytes)
        hits.append(written(texts.mapInArrow(_hits(shared, n), "node string, ranges array<struct<start:long,end:long>>, items array<long>"), "hits"))
        shared.destroy()
    every = reduce(DataFrame.unionByName, hits)
    # equal texts give equal hits in each pass
    once = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    return every.groupBy("node").agg(once("ranges"), once("items"))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_hit
    (words inside a window of an item), items (ids of items with windows in
    it, ascending) and spans (the hit stretches of the original text, in code
    points, end exclusive).

    benchmark has item_id and text. A window is n consecutive words, or the
    whole item if that is shorter. A null text has no words, on either side;
    items with a null id are left out; repeated items count once; an empty
    benchmark hits nothing; rows that share a doc_id are looked at one by one;
    other columns are ignored. block_bytes bounds the item text behind one
    automaton, pass_bytes that of one broadcast; neither changes the result.
    """
    rows = columns_free_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = passes(benchmark, pass_bytes)
    if len(parts) == 1:
        return rows.mapInArrow(_scanner(shared_blocks(parts[0], n, block_bytes), n), RESULT)
    found = found_in_passes(rows, parts, n, block_bytes).withColumnRenamed("node", "__node")
    return rows.join(found, _node() == F.col("__node"), "left").select("doc_id", "text", "ranges", "items").mapInArrow(_told, RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of a
    benchmark item occurs. Null and empty texts stay, as do all rows if the
    benchmark is empty; repeated rows are treated alike."""
    parts = passes(benchmark, pass_bytes)
    if len(parts) == 1:
        return docs.where(~_hit_test(shared_blocks(parts[0], n, block_bytes), n)("text"))
    found = found_in_passes(columns_free_of(docs, "text"), parts, n, block_bytes).select(F.col("node").alias("__node"))
    return docs.join(found, _node() == F.col("__node"), "left_anti")


def _hit_test(shared: Broadcast, n: int) -> Callable[[str], Column]:
    name = uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        words = [normal_words(t) for t in texts]
        out = np.zeros(len(words), bool)
        for number, block in enumerate(shared.value):
            m = matcher(name, number, block, n)
            for i in np.flatnonzero(~out):
                out[i] = next(m.occurs(words[i]), None) is not None
        return pd.Series(out)

    return hit


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows of batches, as many together as have `most` bytes."""
    rows, size = [], 0
    for batch in batches:
        rows += zip(*(c.to_pylist() for c in batch.columns))
        size += batch.nbytes
        if size >= most:
            yield rows
            rows, size = [], 0
    yield rows


def _looked_at(shared: Broadcast, n: int, batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple]:
    """Each row (key, text) with its words and what was found in it."""
    blocks = shared.value
    for rows in _gathered(batches, BATCH_BYTES if len(blocks) > 1 else 1):
        words = [normal_words(t) for _, t in rows]
        for (key, text), w, (ranges, items) in zip(rows, words, scanned(name, blocks, n, words)):
            yield key, text, w, ranges, items


def _in_batches(rows: Iterator[tuple], make: Callable[[list[tuple]], pa.RecordBatch], size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield make(held)
            held = []
    yield make(held)


def _scanner(shared: Broadcast, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches((_result(key, text, w, ranges, sorted(items)) for key, text, w, ranges, items in _looked_at(shared, n, batches, name)), _batch)

    return run


def _hits(shared: Broadcast, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    name = uuid.uuid4().hex
    ranges_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([[{"start": s, "end": e} for s, e in r[1]] for r in rows], ranges_type), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.int64()))], ["node", "ranges", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(((key, ranges, items) for key, _, _, ranges, items in _looked_at(shared, n, batches, name) if ranges), made)

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns))
        yield _batch([_result(i, t, normal_words(t), [(x["start"], x["end"]) for x in r or ()], sorted(items or ())) for i, t, r, items in rows])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_RESULT), _RESULT)], schema=_RESULT)


def _result(doc_id: int, text: str | None, words: list[bytes], ranges: list[tuple[int, int]], items: list[int]) -> tuple:
    if not ranges:
        return doc_id, len(words), 0, [], []
    steps = np.zeros(len(words) + 1, np.int64)
    for s, e in ranges:
        steps[s] += 1
        steps[e] -= 1
    hit = np.cumsum(steps)[:-1] > 0
    at = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    spans = [{"start": at[s][0], "end": at[e - 1][1]} for s, e in zip(edges[::2], edges[1::2])]
    return doc_id, len(words), int(hit.sum()), items, spans
