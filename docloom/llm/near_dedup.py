"""Near-duplicates by improved consistent weighted sampling (ICWS).

A text is a weighted set of shingles, five lower-cased words each; a shingle's
weight is its count in the text times its inverse document frequency, taken
over all documents. 128 ICWS samples are drawn of a text; the first 64, four to a
band, make texts candidates that share a band, if they agree in about as many of
all samples as texts at the threshold do; candidates are verified by their weighted Jaccard similarity.
Classes are the components of the verified links. A text whose shingles that no
other document has weigh more than the threshold leaves room for cannot be
close to any other, and is not sampled at all.

Document frequencies are exact counts of 48-bit shingle hashes. Chunks of
documents send sorted, delta-coded hashes with their counts, one blob for each
range of hashes, and get back one count for each: a shingle that occurs
everywhere is sent once by each chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import BLOB_ARROW, BLOB_SCHEMA, chunk_count, columns_free_of, gram_hashes, mixed, trim, word_hashes, written
from docloom.llm.links import linked

BITS = 48
SKETCH = 128  # samples that tell whether a pair is worth verifying
DEVIATIONS = 1.3
_MASK = np.uint64((1 << BITS) - 1)
_rng = np.random.default_rng(20)
_GAMMA_R = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)  # drawn once by a fixed seed, looked up by hash
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_INV_R = 1 / _GAMMA_R


def planes(values: np.ndarray, width: int) -> bytes:
    """Bytes of the same significance together, which compresses zeros away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


class Shingles:
    """Distinct shingles of each text of a chunk, with their counts there; of
    texts that occur twice, one stands for both."""

    def __init__(self, table: pa.Table, n: int) -> None:
        first: dict[str, int] = {}
        self.copies: list[int] = []
        nodes = table["node"].to_pylist()
        for i, node in enumerate(nodes):
            if node in first:
                self.copies[first[node]] += 1
            else:
                first[node] = len(self.copies)
                self.copies.append(1)
        place = {node: i for i, node in reversed(list(enumerate(nodes)))}
        self.nodes = list(first)
        # a text's words go as soon as they are hashed: as objects they are many times the text
        words = [word_hashes((table["text"][place[node]].as_py() or "").lower().encode().split()) for node in self.nodes]
        keys, counts, owners = [], [], []
        for s in range(0, max(len(words), 1), 60_000):  # at most 2 ** 16 texts share a sort
            k, c, o = self._block(words[s : s + 60_000], n)
            keys.append(k), counts.append(c), owners.append(o + s)
        self.keys, self.counts, self.owners = (np.concatenate(x) for x in (keys, counts, owners))

    @staticmethod
    def _block(words: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        h = np.concatenate([np.empty(0, np.uint64), *words])
        room = np.where(lengths >= n, lengths - n + 1, 0)
        ends = np.cumsum(lengths)
        starts = np.repeat(ends - lengths - np.cumsum(room) + room, room) + np.arange(room.sum())
        owner = np.repeat(np.arange(len(words)), room)
        key = gram_hashes(h, n)[starts] if len(starts) else np.empty(0, np.uint64)
        short = [i for i in range(len(words)) if 0 < lengths[i] < n]  # a text of fewer words is one shingle
        key = np.concatenate([key, *[gram_hashes(h[ends[i] - lengths[i] : ends[i]], int(lengths[i])) for i in short]]) & _MASK
        owner = np.concatenate([owner, np.array(short, np.int64)])
        both, counts = np.unique(owner.astype(np.uint64) << np.uint64(BITS) | key, return_counts=True)
        return both & _MASK, counts, (both >> np.uint64(BITS)).astype(np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of the chunk, ascending, documents with each, and the
        place of each entry's key."""
        keys, back = np.unique(self.keys, return_inverse=True)
        return keys, np.bincount(back, np.array(self.copies, float)[self.owners] if len(back) else None, len(keys)).astype(np.int64), back


def _ranges(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that hold ascending keys, each a range, and where they start."""
    b = ((keys >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(BITS - 16)).astype(np.int64)
    present, starts = np.unique(b, return_index=True)
    return present, np.append(starts, len(keys))


def _asked(key: tuple, table: pa.Table, n: int, buckets: int) -> pa.Table:
    keys, docs, _ = Shingles(table, n).distinct()
    trim()
    present, starts = _ranges(keys, buckets)
    rows = [(key[0].as_py(), int(b), int(e - s), planes(np.diff(keys[s:e], prepend=np.uint64(0)), 6), planes(docs[s:e], 4)) for b, s, e in zip(present, starts, starts[1:])]
    return pa.table([list(c) for c in zip(*rows)], schema=BLOB_ARROW) if rows else BLOB_ARROW.empty_table()


def _counted(table: pa.Table) -> pa.Table:
    """Total document counts, sent back to each chunk for its own keys."""
    rows = list(zip(table["n"].to_pylist(), table["keys"].to_pylist(), table["side"].to_pylist()))
    keys = np.concatenate([np.cumsum(unplanes(k, n, 6), dtype=np.uint64) for n, k, _ in rows])
    _, back = np.unique(keys, return_inverse=True)
    del keys
    docs = np.concatenate([unplanes(s, n, 4).astype(np.float64) for n, _, s in rows])
    total = np.bincount(back, docs)[back].astype(np.int64)
    del back, docs
    trim()
    cuts = np.cumsum([n for n, _, _ in rows])[:-1]
    sent = [planes(x, 5) for x in np.split(total, cuts)]
    return pa.table([table["t"].combine_chunks(), table["bucket"].combine_chunks(), table["n"].combine_chunks(), sent, [b""] * len(sent)], schema=BLOB_ARROW)


def weights(s: Shingles, replies: pa.Table, n_docs: int, damping: float) -> tuple[np.ndarray, np.ndarray]:
    """Count times damped inverse document frequency of each entry, and whether
    its document is the only one that has it."""
    _, _, back = s.distinct()
    got = sorted(zip(replies["bucket"].to_pylist(), replies["n"].to_pylist(), replies["keys"].to_pylist()))
    df = np.concatenate([unplanes(raw, n, 5) for _, n, raw in got] or [np.empty(0, np.uint64)]).astype(float)
    if not len(back):
        return np.empty(0), np.empty(0, bool)
    return s.counts * (1 + np.log((1 + n_docs) / (1 + df[back]))) ** damping, df[back] <= 1


def icws(keys: np.ndarray, w: np.ndarray, owners: np.ndarray, n_texts: int, samples: int, seed: int = 1) -> np.ndarray:
    """ICWS samples, texts by samples; a text without shingles has zeros."""
    out = np.zeros((n_texts, samples), np.uint64)
    if not len(keys):
        return out
    starts = np.flatnonzero(np.diff(owners, prepend=-1))
    who, place, log_w = owners[starts], np.arange(len(keys), dtype=np.int64), np.log(w).astype(np.float32)
    for i in range(samples):
        z = mixed(keys, np.full(1, seed * 1000 + i, np.uint64))
        a = (z & np.uint64(0xFFFF)).astype(np.int64)
        r = _GAMMA_R[a]
        beta = (z >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w * _INV_R[a] + beta)
        log_a = _LOG_C[(z >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta) - r
        order = log_a.view(np.int32)
        order = (order ^ (order >> 31 & 0x7FFFFFFF)).astype(np.int64) << 32 | place  # sorts as the floats do, and tells the place
        best = np.minimum.reduceat(order, starts) & 0xFFFFFFFF
        out[who, i] = mixed(keys[best], (t[best].astype(np.int64) + (1 << 20)).astype(np.uint64))
    return out


def weighted_jaccard(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """Of two sets given by ascending keys and their weights."""
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[ia], wb[ib]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


def agreeing(x: np.ndarray, y: np.ndarray, least: int, strip: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y of the rows that agree in at least `least` columns."""
    found = []
    for s in range(0, len(x), strip):
        some = x[s : s + strip]
        n = np.zeros((len(some), len(y)), np.uint16)
        for k in range(x.shape[1]):
            n += some[:, k, None] == y[None, :, k]
        i, j = np.nonzero(n >= least)
        found.append((i + s, j))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def sketched_pairs(rows: DataFrame, least: int, block: int = 512, bin_rows: int = 20_000) -> DataFrame:
    """Pairs (a, b), a < b, of items of a group (g, item, component, sign, bands,
    band) that differ in component and agree in at least `least` bytes of sign;
    a pair that shares several bands is made in the first of them. Groups of
    more than about `block` items are cut into blocks and each two blocks meet
    in a table of their own; smaller groups share tables of about bin_rows."""
    bins = int(rows.count() // bin_rows) + 1
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = rows.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("item", F.lit(2)), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.struct("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = met.select(F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("g"), F.lit(bins))).otherwise(F.xxhash64(pair)).alias("k"), F.xxhash64(pair).alias("pair"), (F.col("own") > F.col("other")).alias("right"), (F.col("own") == F.col("other")).alias("same"), "item", "component", "sign", "bands", "band")

    def compared(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pair", "ascending"), ("item", "ascending")])
        items = table["item"].combine_chunks()
        part = table["component"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sign = np.frombuffer(b"".join(table["sign"].to_pylist()), np.uint8).reshape(len(table), -1)
        right, same = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("right", "same"))
        bands, band = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(table), -1), table["band"].to_numpy()
        key = table["pair"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        a, b = [], []
        for s, e in zip(starts, np.append(starts[1:], len(key))):
            at = np.arange(s, e)
            x = at if same[s] else at[~right[s:e]]
            y = at if same[s] else at[right[s:e]]
            if len(x) and len(y):
                i, j = agreeing(sign[x], sign[y], least)
                i, j = x[i], y[j]
                keep = (part[i] != part[j]) & ((i < j) if same[s] else True)
                i, j = i[keep], j[keep]
                keep = (bands[i] == bands[j]).argmax(1) == band[s]
                a.append(i[keep]), b.append(j[keep])
        a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
        return pa.table({"a": items.take(pa.array(a)), "b": items.take(pa.array(b))})

    found = met.groupBy("k").applyInArrow(compared, "a string, b string")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def text_classes(docs: DataFrame, words: int, threshold: float, bands: int, rows: int, damping: float, chunk_bytes: int, sketch: int = SKETCH) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as doc_id, node, has_words; and the class of each node
    with words."""
    chunks = chunk_count(docs, "text", chunk_bytes)
    buckets = max(1, chunks // 4)
    dealt = columns_free_of(docs, "doc_id", "text").select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("t"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("node"), "text")
    n_docs = docs.count()

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        return _asked(key, table, words, buckets)

    asked = dealt.groupBy("t").applyInArrow(ask, BLOB_SCHEMA)
    replies = written(asked.groupBy("bucket").applyInArrow(_counted, BLOB_SCHEMA).select(F.col("t").alias("to"), "bucket", "n", "keys"), "frequencies")

    def sampled(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        s = Shingles(table, words)
        w, alone = weights(s, known, n_docs, damping)
        n = len(s.nodes)
        shared, whole = np.bincount(s.owners, np.where(alone, 0, w), n), np.bincount(s.owners, w, n)
        has = (whole > 0) & (shared >= (threshold - 1e-6) * whole)  # no other text is closer than what is shared at all
        some = has[s.owners]
        signs = icws(s.keys[some], w[some], s.owners[some], n, max(sketch, bands * rows))
        trim()
        sign = (signs[has, :sketch] & np.uint64(0xFF)).astype(np.uint8)
        of_band = signs[:, : bands * rows]
        out = of_band[:, ::rows]
        for i in range(1, rows):
            out = mixed(out.ravel(), of_band[:, i::rows].ravel()).reshape(out.shape)
        out = mixed(out.ravel(), np.tile(np.arange(bands, dtype=np.uint64), len(out))).reshape(out.shape).view(np.int64)[has]
        cuts, at = np.searchsorted(s.owners, np.arange(n + 1)), np.flatnonzero(has)
        sets = [(planes(s.keys[cuts[i] : cuts[i + 1]], 6), w[cuts[i] : cuts[i + 1]].astype(np.float32).tobytes()) for i in at]
        columns = [pa.array([s.nodes[i] for i in at], pa.string()), pa.array([key[0].as_py()] * len(at), pa.int64()), pa.array(out.tolist(), pa.list_(pa.int64())), pa.array([x.tobytes() for x in sign], pa.binary()), pa.array([k for k, _ in sets], pa.binary()), pa.array([v for _, v in sets], pa.binary())]
        return pa.table(columns, names=["node", "t", "bands", "sign", "keys", "w"])

    signs = written(dealt.groupBy("t").cogroup(replies.groupBy("to")).applyInArrow(sampled, "node string, t long, bands array<long>, sign binary, keys binary, w binary"), "bands")
    # a text stands in each chunk that holds a copy; the first chunk's row speaks for it
    own = signs.groupBy("node").agg(F.min("t").alias("t"))
    sets = written(signs.join(own, ["node", "t"]).select("node", "bands", "sign", "keys", "w"), "shingles")
    members = sets.select(F.col("node").alias("item"), "sign", "bands", F.posexplode_outer("bands").alias("band", "g"))
    many = members.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    groups = written(members.join(many, "g").select("g", "item", "sign", "bands", "band"), "members")

    def similar(batches):
        for b in batches:
            keep = []
            for ka, wa, kb, wb in zip(*(b.column(c).to_pylist() for c in ("ka", "wa", "kb", "wb"))):
                va, vb = np.frombuffer(wa, np.float32).astype(float), np.frombuffer(wb, np.float32).astype(float)
                # sums of smaller and larger weights bound the similarity
                keep.append(min(va.sum(), vb.sum()) >= threshold * max(va.sum(), vb.sum()) and weighted_jaccard(unplanes(ka, len(va), 6), va, unplanes(kb, len(vb), 6), vb) >= threshold)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("keys").alias("ka"), F.col("w").alias("wa"))
        right = sets.select(F.col("node").alias("b"), F.col("keys").alias("kb"), F.col("w").alias("wb"))
        return pairs.join(left, "a").join(right, "b").mapInArrow(similar, "a string, b string")

    # of a pair at the threshold, samples agree with that probability; so many deviations less are likely enough
    least = int(sketch * threshold - DEVIATIONS * (sketch * threshold * (1 - threshold)) ** 0.5)
    parts, _ = linked(groups, verify, lambda x, y: F.lit(True), stars=3, apart=lambda rows: sketched_pairs(rows, least))
    texts = columns_free_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("node"), F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False)).alias("has_words"))
    firsts = texts.where("has_words").groupBy("node").agg(F.min("doc_id").alias("first"))
    owned = firsts.join(parts.select(F.col("item").alias("node"), "component"), "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    best = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node"))  # the smallest doc_id, null last, then the smallest digest
    classes = owned.groupBy("component").agg(best.alias("best")).select("component", F.col("best.first").alias("class_id"), F.col("best.node").alias("best"))
    return texts, owned.join(classes, "component").select("node", "class_id", (F.col("node") == F.col("best")).alias("best"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 16, rows: int = 4, damping: float = 0.5, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, node (a digest of
    the text) and class_id, the smallest doc_id among the texts linked to it.

    Equal texts are linked. Texts without words, and null ones, are not linked
    to anything: their class is their own row's id. A text of fewer than
    `words` words is one shingle. A null doc_id belongs to its text's class; a
    class of null ids alone has a null class_id. Repeated rows and ids are kept
    as they are; other columns are ignored; an empty table gives no rows.
    damping is the power that inverse document frequencies are raised to: at 1,
    a word changed in one of a thousand copies would weigh more than twice a
    word that they share, and copies would not count as such.
    """
    texts, of_node = text_classes(docs, words, threshold, bands, rows, damping, chunk_bytes)
    return texts.join(of_node.drop("best"), "node", "left").select("doc_id", "node", F.when(F.col("has_words"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 16, rows: int = 4, damping: float = 0.5, chunk_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs, with all their columns, one for each class: the one
    with the smallest doc_id, a null one last, and of rows with that id the one
    whose text has the smallest digest. Texts without words are classes of
    their own and all stay. An empty table stays empty."""
    _, of_node = text_classes(docs, words, threshold, bands, rows, damping, chunk_bytes)
    known = of_node.select(F.col("node").alias("__node"), F.col("class_id").alias("__class"), F.col("best").alias("__best"))
    keyed = docs.withColumn("__digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    joined = keyed.join(known, F.col("__digest") == F.col("__node"), "left")
    stays = joined.where(F.col("__best").isNull() | (F.col("__best") & F.col("doc_id").eqNullSafe(F.col("__class"))))
    # repeated rows are left; a text's rows are together already
    place = F.row_number().over(Window.partitionBy("__digest").orderBy(F.lit(0)))
    return stays.withColumn("__n", place).where("__best is null or __n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
