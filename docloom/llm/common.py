"""Helpers that the operators share: the shared folder, lineage cuts, chunks
of documents, and the exchange of sorted hash blobs between chunks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOB_SCHEMA = "t long, bucket long, n long, keys binary, side binary"
BLOB_ARROW = pa.schema([("t", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("side", pa.binary())])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where
    none is named and all runs on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts the
    lineage and survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give freed memory back, where the C library can: a worker that has done a
    chunk otherwise keeps what its arrays took while the next stage runs."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def columns_free_of(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, so that extra columns cannot clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def chunk_count(docs: DataFrame, text: str, chunk_bytes: int) -> int:
    """Number of chunks of about chunk_bytes of text each; follows the input."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, int(total // chunk_bytes) + 1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, equal on every executor."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered hash of two arrays of hashes, element by element."""
    x = a * _A
    x ^= b + _C
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words of a concatenated array."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out = mixed(out, h[k : k + m])
    return out


def sliding_min(v: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k neighbours, by doubling."""
    m, length = v, 1
    while 2 * length <= k:
        m = np.minimum(m[:-length], m[length:])
        length *= 2
    if length < k:
        m = np.minimum(m[: len(v) - k + 1], m[k - length :])
    return m


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys by bucket, the buckets present, and where each starts."""
    b = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    present, starts = np.unique(b[order], return_index=True)
    return order, present, np.append(starts, len(keys))


def blobs(t: int, keys: np.ndarray, buckets: int, width: int = 8, side: np.ndarray | None = None) -> pa.Table:
    """One row for each bucket that has keys: the keys of chunk t there, cut to
    width bytes each, and side values in the same order."""
    order, present, starts = by_bucket(keys, buckets)
    raw = keys[order].view(np.uint8).reshape(-1, 8)[:, :width] if len(keys) else np.empty((0, width), np.uint8)
    beside = None if side is None else side[order]
    rows = [(int(b), int(e - s), raw[s:e].tobytes(), b"" if beside is None else beside[s:e].tobytes()) for b, s, e in zip(present, starts, starts[1:])]
    return pa.table([[t] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]], schema=BLOB_ARROW)


def keys_of(raw: bytes, width: int = 8) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def bits_of(replies: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The reply bits for each key of a chunk, which made the same blobs."""
    order, present, starts = by_bucket(keys, buckets)
    out = np.zeros(len(keys), bool)
    got = dict(zip(replies["bucket"].to_pylist(), replies["keys"].to_pylist()))
    for b, s, e in zip(present, starts, starts[1:]):
        out[order[s:e]] = np.unpackbits(np.frombuffer(got[int(b)], np.uint8), count=e - s).astype(bool)
    return out


def batches(table: pa.Table, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    return iter(table.to_batches(max_chunksize=rows))
