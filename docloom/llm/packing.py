"""Packing documents into sequences by best-fit decreasing.

Documents are encoded, ended with an end id and cut: whole windows first, and
what is left over as one shorter piece. Pieces are dealt at random into groups
of about 50,000, and each group is packed on its own: longest piece first, each
into the open sequence that leaves the least room. A segment tree over the
remaining capacities finds that sequence. With tens of thousands of pieces in a
group, what is lost against one global packing is far below a thousandth.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import columns_free_of, written
from docloom.llm.tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_NUMBERED = _PIECE.append(pa.field("number", pa.int64()))


class CapacityTree:
    """Open sequences by remaining capacity; a node is set while some leaf
    below it has one."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        node = room + self.size
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The sequence with the least room of at least length, and its room."""
        node = length + self.size
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        room = node - self.size
        sequence = self.open[room].pop()
        if not self.open[room]:
            self.some[node] = 0
            node >>= 1
            while node and not (self.some[2 * node] or self.some[2 * node + 1]):
                self.some[node] = 0
                node >>= 1
        return sequence, room


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each piece; lengths descend."""
    tree, number, offset, used = CapacityTree(capacity), [], [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            found = (used, capacity)
            used += 1
        sequence, room = found
        number.append(sequence)
        offset.append(capacity - room)
        if room > length:
            tree.put(room - length, sequence)
    return number, offset


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity ids: doc_id, start, length, ids_crc32,
    doc_tokens (with the end id), ids (null unless keep_ids) and number, which no
    two pieces share: the task's, and the piece's within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.uint32(end_id).tobytes()
        number = (TaskContext.get().partitionId() << 40) - 1
        for batch in batches:
            rows = []
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, text in zip(ids_of, texts):
                raw = enc.encode(text) + end
                n = len(raw) // 4
                for s in range(0, n, capacity):
                    part = raw[4 * s : 4 * (s + capacity)]
                    number += 1
                    rows.append((doc_id, s, len(part) // 4, zlib.crc32(part), n, part if keep_ids else None, number))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _NUMBERED)], schema=_NUMBERED)

    return columns_free_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE + ", number long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, group_pieces: int = 50_000, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: the columns of cut_documents with sequence_id
    and offset; the pieces of a sequence lie in it without gaps from 0.

    A null or empty text is a document of the end id alone. Rows that share a
    doc_id, and null ids, are packed like any other; extra columns are ignored;
    an empty table gives no pieces. Groups of the packing have about group_pieces pieces,
    dealt by a hash of their numbers, whatever the pieces are.
    """
    pieces = written(cut_documents(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces")
    groups = int(pieces.count() // group_pieces) + 1

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        number, offset = best_fit_decreasing(table["length"].to_pylist(), capacity)
        base = key[0].as_py() << 32
        return table.select(_PIECE.names).append_column("sequence_id", pa.array(np.array(number, np.int64) + base)).append_column("offset", pa.array(offset, pa.int64()))

    # by their numbers, so that equal pieces are spread like any other
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("number"), F.lit(groups))).drop("number")
    return dealt.groupBy("g").applyInArrow(packed, PIECE + ", sequence_id long, offset long")


def sequences(packed: DataFrame, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """The sequences themselves, from pieces that kept their ids: sequence_id,
    n_tokens, and ids as little-endian bytes, padded to capacity unless the
    sequence has a power of two of ids already."""
    pad = F.lit(bytearray(np.uint32(pad_id).tobytes()))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    raw = F.aggregate(F.col("parts"), F.lit(bytearray()), lambda a, x: F.concat(a, x["ids"]))
    missing = F.when(F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0, 0).otherwise(capacity - F.col("n_tokens"))
    padding = F.aggregate(F.sequence(F.lit(0), missing), F.lit(bytearray()), lambda a, i: F.when(i == 0, a).otherwise(F.concat(a, pad)))
    return joined.select("sequence_id", "n_tokens", F.concat(raw, padding).alias("ids"))
