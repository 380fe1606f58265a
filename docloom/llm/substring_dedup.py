"""Substring dedup by level-wise doubling.

A window of `window` words is removed where the same words also start earlier
in the corpus (smaller id, or same id and earlier start). Windows are never
sent around whole. Each window stands for a short run of words in it, its
anchor: the run of `base` words with the smallest hash. Anchors that occur once
in the corpus are dropped; those that repeat alone are extended to twice the
length, and so on up to the window length, or until no candidates survive.
Only the survivors of the last level, the truly repeated windows, are compared
by their owners' ids and their starts.

Documents are dealt into chunks of bounded size by their ids and texts, so that
rows that share an id are spread. In each round a chunk sends
its distinct hashes, one blob for each hash bucket, and gets back one bit for
each: a text that occurs a million times sends one hash for each chunk, so no
key is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BLOB_ARROW, BLOB_SCHEMA, bits_of, blobs, chunk_count, columns_free_of, gram_hashes, keys_of, mixed, sliding_min, word_hashes

SHORT = 6  # bytes of a hash below the last level, where a chance match only costs a look at the next level
OUT = pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])


def level_lengths(window: int, base: int) -> list[int]:
    """Lengths from the shortest to the window, each twice the one before."""
    lengths = [window]
    while lengths[0] % 2 == 0 and lengths[0] // 2 >= base:
        lengths.insert(0, lengths[0] // 2)
    return lengths


class Chunk:
    """The words of a chunk's documents in id order, and what is known of their windows."""

    def __init__(self, docs: pa.Table, window: int, base: int, buckets: int) -> None:
        ids = docs["doc_id"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
        texts = docs["text"]
        self.ids = [ids[i] for i in order]
        self.words = [(texts[i].as_py() or "").encode().split() for i in order]
        self.window, self.buckets, self.lengths = window, buckets, level_lengths(window, base)
        counts = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(counts)
        self.h = word_hashes([w for ws in self.words for w in ws])
        room = np.maximum(counts - window + 1, 0)
        first = np.repeat(self.ends - counts - np.cumsum(room) + room, room)
        self.starts = first + np.arange(len(first))  # of the windows that may still repeat
        self.owner = np.repeat(np.arange(len(counts)), room)
        low = self.lengths[0]
        self.grams = gram_hashes(self.h, low)
        if len(self.starts) and len(self.lengths) > 1:
            v = (self.grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(self.grams), dtype=np.uint64)
            self.anchor = (sliding_min(v, window - low + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)[self.starts]

    def hashes_at(self, length: int) -> np.ndarray:
        """Hashes of all runs of this length, from those of half of it."""
        out, n = self.grams, self.lengths[0]
        while n < length:
            out = mixed(out[:-n], out[n:]) if len(out) > n else out[:0]
            n *= 2
        return out

    def candidates(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """At a level below the last: distinct hashes, how often each occurs
        here, and for each window the place of its own."""
        low = self.lengths[0]
        at = np.where(self.anchor + length <= self.starts + self.window, self.anchor, self.anchor + low - length)
        places, back = np.unique(at, return_inverse=True)
        keys, inverse, counts = np.unique(self.hashes_at(length)[places] & np.uint64((1 << 8 * SHORT) - 1), return_inverse=True, return_counts=True)
        return keys, counts, inverse[back]

    def keep(self, which: np.ndarray) -> None:
        self.starts, self.owner, self.anchor = self.starts[which], self.owner[which], self.anchor[which]

    def apply(self, length: int, replies: pa.Table) -> None:
        """Drop windows whose run of this length occurs once."""
        if len(self.starts):
            keys, counts, own = self.candidates(length)
            self.keep(((counts > 1) | bits_of(replies, keys, self.buckets))[own])

    def survivors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """At the last level: the distinct windows as hash and check value, and
        for each window the place of its own."""
        h = self.hashes_at(self.window)[self.starts]
        check = gram_hashes(self.h ^ np.uint64(0x5851F42D4C957F2D), self.window)[self.starts] >> np.uint64(32) if len(h) else h
        order = np.lexsort((check, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        return h[order][new], check[order][new].astype(np.uint32), group

    def leaders(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct window its earliest by (id, start within the
        document), and for each window its id and start."""
        ids = np.array([np.iinfo(np.int64).min if i is None else i for i in self.ids], np.int64)
        begin, mine = self.starts - np.concatenate(([0], self.ends))[self.owner], ids[self.owner]
        rank = np.lexsort((begin, mine, group))
        new = np.ones(len(rank), bool)
        new[1:] = group[rank][1:] != group[rank][:-1]
        return rank[new], mine, begin

    def sent(self, t: int) -> pa.Table:
        """Rows of the last level. In each bucket, keys in order of their
        owner; beside them owners and their key counts, check values and starts."""
        if not len(self.starts):
            return BLOB_ARROW.empty_table()
        h, check, group = self.survivors()
        lead, _, begin = self.leaders(group)
        owner, begin = self.owner[lead], begin[lead].astype(np.uint32)
        b = ((h >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((h, owner, b))
        present, starts = np.unique(b[order], return_index=True)
        rows = []
        for bucket, s, e in zip(present, starts, np.append(starts[1:], len(h))):
            part = order[s:e]
            who, n = np.unique(owner[part], return_counts=True)
            ids = np.array([np.iinfo(np.int64).min if self.ids[i] is None else self.ids[i] for i in who], np.int64)
            side = np.int64(len(who)).tobytes() + ids.tobytes() + n.astype(np.int64).tobytes() + check[part].tobytes() + begin[part].tobytes()
            rows.append((t, int(bucket), len(part), h[part].tobytes(), side))
        return pa.table([list(c) for c in zip(*rows)], schema=BLOB_ARROW)

    def repeated(self, replies: pa.Table) -> np.ndarray:
        """For each surviving window whether it also starts earlier."""
        h, _, group = self.survivors()
        lead, mine, begin = self.leaders(group)
        owner = self.owner[lead]
        b = ((h >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((h, owner, b))
        got = dict(zip(replies["bucket"].to_pylist(), zip(replies["n"].to_pylist(), replies["keys"].to_pylist())))
        elsewhere = np.empty(len(h), bool)
        elsewhere[order] = np.concatenate([np.unpackbits(np.frombuffer(raw, np.uint8), count=n) for _, (n, raw) in sorted(got.items())]).astype(bool)
        first = lead[group]  # here: later than the first of the same words
        later = (mine > mine[first]) | ((mine == mine[first]) & (begin > begin[first]))
        return later | elsewhere[group]

    def result(self, replies: pa.Table) -> pa.Table:
        flags = np.zeros(len(self.h) + 1, np.int64)
        if len(self.starts):
            flags[self.starts[self.repeated(replies)]] = 1
        total = np.cumsum(flags)[:-1]
        covered = total.copy()
        covered[self.window :] -= total[: -self.window or None][: max(0, len(total) - self.window)]
        gone = covered > 0
        kept, removed, at = [], [], 0
        for words, end in zip(self.words, self.ends):
            part = gone[at:end]
            n = int(part.sum())
            kept.append(b" ".join(words if not n else [w for w, g in zip(words, part.tolist()) if not g]).decode())
            removed.append(n)
            at = end
        return pa.table([self.ids, kept, [len(w) for w in self.words], removed], schema=OUT)


def _split(replies: pa.Table, level: int) -> pa.Table:
    return replies.filter(pc.equal(replies["level"], level))


def dedup_substrings(docs: DataFrame, window: int = 20, base: int = 5, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row for each row of docs (doc_id long, text string; other columns
    are ignored): doc_id, kept (the words left, joined by a space), n_words,
    n_removed. Words are runs of anything but ASCII white space.

    A null text has no words. A null doc_id sorts before all others. Rows that
    share a doc_id count as one document's rival readings: of two windows with
    the same doc_id only the one with the later start is a repeat. Texts shorter than the
    window are kept whole. An empty table gives an empty table.
    """
    chunks = chunk_count(docs, "text", chunk_bytes)
    buckets = max(1, chunks // 4)
    lengths = level_lengths(window, base)
    dealt = columns_free_of(docs, "doc_id", "text").select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("t"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def chunk_at(table: pa.Table, replies: pa.Table | None, level: int) -> Chunk:
        chunk = Chunk(table, window, base, buckets)
        for k in range(level):
            chunk.apply(lengths[k], _split(replies, k))
        return chunk

    def sent(t: int, chunk: Chunk, level: int) -> pa.Table:
        if not len(chunk.starts):
            return BLOB_ARROW.empty_table()
        if level == len(lengths) - 1:
            return chunk.sent(t)
        return blobs(t, chunk.candidates(lengths[level])[0], buckets, SHORT)

    def counted(table: pa.Table) -> pa.Table:
        parts = [keys_of(raw, SHORT) for raw in table["keys"].to_pylist()]
        _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        return answered(table, parts, counts[inverse] > 1)

    def first_owner(table: pa.Table) -> pa.Table:
        keys, checks, owners, begins = [], [], [], []
        for raw, side in zip(table["keys"].to_pylist(), table["side"].to_pylist()):
            k, n = int(np.frombuffer(side, np.int64, 1)[0]), len(raw) // 8
            keys.append(np.frombuffer(raw, np.uint64))
            owners.append(np.repeat(np.frombuffer(side, np.int64, k, 8), np.frombuffer(side, np.int64, k, 8 + 8 * k)))
            checks.append(np.frombuffer(side, np.uint32, n, 8 + 16 * k))
            begins.append(np.frombuffer(side, np.uint32, n, 8 + 16 * k + 4 * n))
        h, c, o, s = np.concatenate(keys), np.concatenate(checks), np.concatenate(owners), np.concatenate(begins)
        order = np.lexsort((s, o, c, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
        place = np.cumsum(new) - 1
        least_o, least_s = o[order][new][place], s[order][new][place]
        later = np.empty(len(h), bool)
        later[order] = (o[order] > least_o) | ((o[order] == least_o) & (s[order] > least_s))
        return answered(table, keys, later)

    def answered(table: pa.Table, parts: list[np.ndarray], flags: np.ndarray) -> pa.Table:
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        out = [np.packbits(x).tobytes() for x in np.split(flags, cuts)]
        return pa.table([table["t"].combine_chunks(), table["bucket"].combine_chunks(), table["n"].combine_chunks(), out, [b""] * len(out)], schema=BLOB_ARROW)

    def first_ask(key: tuple, table: pa.Table) -> pa.Table:
        return sent(key[0].as_py(), chunk_at(table, None, 0), 0)

    def ask_at(level: int):
        return lambda key, table, known: sent(key[0].as_py(), chunk_at(table, known, level), level)

    # one plan, in which the exchanges of texts and of answers are made once and
    # read again; answers get names of their own, so that nothing is rewritten
    replies = None
    for level in range(len(lengths)):
        chunked = dealt.groupBy("t")
        asked = chunked.applyInArrow(first_ask, BLOB_SCHEMA) if replies is None else chunked.cogroup(replies.groupBy("to")).applyInArrow(ask_at(level), BLOB_SCHEMA)
        answer = asked.groupBy("bucket").applyInArrow(first_owner if level == len(lengths) - 1 else counted, BLOB_SCHEMA).select(F.col("t").alias("to"), "bucket", "n", "keys", F.lit(level).alias("level"))
        replies = answer if replies is None else replies.unionByName(answer)

    def finished(table: pa.Table, known: pa.Table) -> pa.Table:
        return chunk_at(table, known, len(lengths) - 1).result(_split(known, len(lengths) - 1))

    return dealt.groupBy("t").cogroup(replies.groupBy("to")).applyInArrow(finished, "doc_id long, kept string, n_words long, n_removed long")
