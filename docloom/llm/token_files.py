"""Token ids in ORC files, in id order.

Each row is a document with its ids as an array of integers, which ORC stores
run-length encoded and bit-packed. Files are in id order, with row indexes and
Bloom filters on the ids, so that a reader takes stripes in parallel and skips
files, stripes and row groups that cannot hold the ids it wants.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import columns_free_of
from docloom.llm.tokens import encoder

FILE_SCHEMA = "part int, place long, doc_id long, n_tokens long, ids array<int>"
_FILE = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, stripe_bytes: int = 64 << 20, row_group: int = 1000) -> None:
    """Encode docs (doc_id, text) and write them in ascending order of doc_id.

    A null or empty text is the end id alone. Null ids come first; rows that
    share an id are in order of a hash of their texts, null texts by 42, which is
    that hash of nothing, over however many files they go. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, place = encoder(tokenizer_path), np.uint32(end_id).tobytes(), 0
        for batch in batches:
            raw = [enc.encode(t) + end for t in batch.column(2).to_pylist()]
            counts = np.array([len(r) // 4 for r in raw], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(place, place + len(raw))), batch.column(1), pa.array(counts), ids], schema=_FILE)
            place += len(raw)

    ordered = columns_free_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    encoded = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, FILE_SCHEMA)
    encoded.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", row_group).orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with doc_ids only those, by pruned stripes and row groups."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each stored document: doc_id, start (ids of all documents
    before it), n_tokens and ids_crc32, all from the files."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            sums = [zlib.crc32(values[s:e].astype("<u4").tobytes()) for s, e in zip(offsets[:-1], offsets[1:])]
            counts = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("place"), batch.column("doc_id"), counts, pa.array(sums, pa.int64())], ["part", "place", "doc_id", "n_tokens", "ids_crc32"])

    stored = read_token_files(spark, path)
    rows = stored.mapInArrow(crc, "part int, place long, doc_id long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each file part
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))  # reads two columns, not the ids
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums, "part").select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
