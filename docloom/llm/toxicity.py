"""Toxicity by weak supervision.

Many noisy voters look at a text: short lexicons of insults, which know no
labels, lexicons of word beginnings that a bounded sample of labelled rows
shows, at some density, almost only in toxic texts, dealt into several voters,
and patterns of style. A generative model of the votes over all documents
gives each voter's accuracy and the voters' correlations beyond the label from
their covariances: given the label, independent voters leave a covariance
matrix of rank one, and what is over is their correlation. Its posterior labels
train a linear classifier, which sees the votes and hashed counts of word
beginnings, and scores the texts.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import columns_free_of, trim, written

# fixed values: common insults
INSULTS = {
    "en": "idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile dumbass bastard asshole bitch fuck shit retard filthy vermin",
    "de": "arschloch scheiße scheisse wichser hurensohn vollidiot dummkopf schlampe missgeburt abschaum",
    "fr": "connard connasse salope putain enculé merde abruti crétin ordure imbécile",
    "es": "gilipollas cabrón puta mierda pendejo imbécil estúpido maricón basura idiota",
}
GROUPS = 8
LEVELS = (0, 2, 3, 4, 6, 9)  # occurrences in PER words; 0: once in the whole text
PER = 400
BUCKETS = 512
PART = 512  # rows that the driver looks at together
_word = re.compile(r"[^\W\d_]+").findall
_built: dict[str, tuple] = {}


@dataclass
class Model:
    stems: list[tuple[str, int, int]]  # word beginning, the density from which it counts, and its voter
    n_voters: int
    prior: float
    fires_toxic: np.ndarray  # of each voter: share of toxic, of clean texts in which it fires
    fires_clean: np.ndarray
    correlations: np.ndarray  # of the votes, beyond what the label explains
    weights: np.ndarray | None = None
    means: np.ndarray | None = None
    scales: np.ndarray | None = None
    name: str = ""  # of the model, by which workers keep what they build from it

    @property
    def share(self) -> np.ndarray:
        """Of each vote what is its own, the rest being others' it goes with."""
        return 1 / (1 + np.maximum(self.correlations, 0).sum(1))


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are only for testing; a null id has none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id and toxic of per_class rows of each label at most, chosen by a
    hash of their ids from those that are not held out, and how many rows of
    each label there are. Labels other than 0 and 1 are ignored; of several
    for one id the greatest holds."""
    usable = columns_free_of(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    some = lambda label: usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return written(some(1).unionByName(some(0)), "labels"), n


def dense(count: int, words: int, level: int) -> bool:
    return count * PER >= level * max(words, PER)


def induced_stems(docs: DataFrame, chosen: DataFrame, n: dict[int, int], per_class: int, most: int) -> list[tuple[str, int]]:
    """Word beginnings of 4 to 8 letters, with a density from which they occur
    in far more toxic rows of the sample than chance allows and hardly in clean
    ones, near copies counted once. Of each the density at which most toxic
    rows have it, and at most `most` of them, those in most toxic rows first."""
    rows = columns_free_of(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * per_class rows of two numbers

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = _word((text or "").lower())
                counts = Counter(w[:k] for w in words for k in range(4, 9) if len(w) >= k)
                found = [(s, level) for s, c in counts.items() for level in LEVELS if dense(c, len(words), level)]
                family = min((xxhash.xxh3_64_intdigest(" ".join(g)) for g in zip(words, words[1:], words[2:])), default=0) >> 1  # copies and near copies mostly share it
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.string()), pa.array([v for _, v in found], pa.int64()), pa.array([int(toxic)] * len(found), pa.int64()), pa.array([family] * len(found), pa.int64())], ["stem", "level", "toxic", "family"])

    of = {1: min(n[1], per_class), 0: min(n[0], per_class)}
    chance = of[1] / (of[0] + of[1])
    need = max(5.0, 9 / -np.log10(chance))  # odds of a billion to one against a beginning that has nothing to do with the label
    seen = rows.select("text", "toxic").mapInArrow(beginnings, "stem string, level long, toxic long, family long").distinct()
    counted = seen.groupBy("stem", "level").agg(F.sum("toxic").alias("n_toxic"), F.sum(1 - F.col("toxic")).alias("n_clean")).where((F.col("n_toxic") >= need + 4 * F.col("n_clean")) & (F.col("n_clean") <= 2.5 + 0.01 * F.col("n_toxic")))
    best = counted.groupBy("stem").agg(F.max(F.struct("n_toxic", -F.col("level"))).alias("x")).select("stem", "x.n_toxic", (-F.col("x.col2")).alias("level"))
    kept: list[tuple[str, int]] = []
    for r in best.orderBy(F.desc("n_toxic"), F.length("stem"), "stem").limit(20 * most).collect():
        if len(kept) < most and not any(r.stem.startswith(k) for k, _ in kept):
            kept.append((r.stem, int(r.level)))
    return kept


def _machine(model: Model):
    if model.name not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for i, (stem, _, _) in enumerate(model.stems):
            a.add_word(stem, (len(stem), [*a.get(stem, (0, []))[1], i]))
        if len(a):
            a.make_automaton()
        _built[model.name] = a
    return _built[model.name]


def features(model: Model, text: str | None) -> np.ndarray:
    """Hits of each lexicon voter's dense enough entries, then whether each
    pattern voter fires, then length in letters."""
    text = text or ""
    low = text.lower()
    out = np.zeros(model.n_voters + 4)
    a = _machine(model)
    if len(a):
        hits: dict[int, int] = {}
        for end, (n, entries) in a.iter(low):
            first = end - n + 1
            if not first or not low[first - 1].isalpha():
                for i in entries:
                    hits[i] = hits.get(i, 0) + 1
        words = text.count(" ") + text.count("\n") + 1 if hits else 0
        for i, count in hits.items():
            _, level, voter = model.stems[i]
            if dense(count, words, level):
                out[voter] += count
    n = len(text)
    out[-4] = text.count("!") > 0.01 * n
    out[-3] = text.isupper()
    out[-2] = text.count("\n") > 0.02 * n
    out[-1] = n
    return out


def grams(text: str | None) -> np.ndarray:
    """Rates of words by a hash of their first five letters, on a log scale."""
    words = _word((text or "").lower())
    if not words:
        return np.zeros(BUCKETS, np.float32)
    at = np.array([zlib.crc32(w[:5].encode()) for w in words], np.int64) % BUCKETS
    return np.log1p(np.bincount(at, minlength=BUCKETS) * (PER / max(len(words), PER))).astype(np.float32)


def votes(f: np.ndarray) -> np.ndarray:
    return (f[..., :-1] > 0).astype(float)


def inputs(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """What the classifier sees: whether voters fire, the number of insults,
    how many voters of insults agree, and rates of word beginnings."""
    lexical = f[..., :-4]
    agree = (lexical > 0).sum(-1, keepdims=True)
    return np.concatenate([votes(f), np.log1p(lexical.sum(-1, keepdims=True)), np.minimum(agree, 3) / 3.0, g], -1)


def label_model(moments: np.ndarray, total: float, stems: list[tuple[str, int, int]], n_voters: int, prior: float) -> Model:
    """From the sums of products of all votes (the last vote is always 1)."""
    k = len(moments) - 1
    mean = moments[-1, :k] / max(total, 1)
    cov = moments[:k, :k] / max(total, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    p = float(np.clip(prior, 0.01, 0.5))
    free = ~np.eye(k, dtype=bool) & (mean > 0)[:, None] & (mean > 0)[None]
    delta = np.where(mean > 0, 0.5 * sd, 0.0)
    for _ in range(3):
        for _ in range(200):  # the leading factor of the covariances, those left out and the diagonal filled in by the factor
            values, vectors = np.linalg.eigh(np.where(free, cov, np.outer(delta, delta)))
            lead = vectors[:, -1] * np.sqrt(max(values[-1], 0))
            lead = np.maximum(lead * np.sign(lead.sum() or 1), 0) * (mean > 0)
            moved, delta = np.abs(lead - delta).max(), lead
            if moved < 1e-9:
                break
        own = np.sqrt(np.maximum(sd**2 - delta**2, 0.1 * sd**2))
        over = np.abs(cov - np.outer(delta, delta)) / np.outer(own, own)  # pairs that stand out from the rest depend on each other
        odd = over > max(0.2, 2 * np.median(over[free])) if free.any() else np.zeros_like(free)
        if (free & odd).sum() > 0.3 * free.sum():
            break
        free &= ~odd
    if not mean[:n_voters].any():  # patterns of style alone say nothing of insults
        delta = np.zeros(k)
    both = ~np.eye(k, dtype=bool) & (mean > 0)[:, None] & (mean > 0)[None]
    within = np.sqrt(np.maximum(sd**2 - delta**2, 0.1 * sd**2))
    correlations = np.where(both, np.clip((cov - np.outer(delta, delta)) / np.outer(within, within), -1, 1), 0.0)
    gap = np.minimum(delta / np.sqrt(p * (1 - p)), 1.0)
    toxic = np.clip(mean + (1 - p) * gap, 1e-4, 1 - 1e-4)
    clean = np.clip(mean - p * gap, 1e-4, 1 - 1e-4)
    return Model(stems, n_voters, p, toxic, clean, correlations, name=uuid.uuid4().hex)


def posterior(model: Model, v: np.ndarray) -> np.ndarray:
    """Of toxic given the votes. Voters that depend on each other share a vote."""
    fired = np.log(model.fires_toxic / model.fires_clean) * model.share
    silent = np.log((1 - model.fires_toxic) / (1 - model.fires_clean)) * model.share
    logit = np.log(model.prior / (1 - model.prior)) + v @ fired + (1 - v) @ silent
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(model: Model, parts: list[tuple[np.ndarray, np.ndarray]], ridge: float = 1e-2, rounds: int = 25) -> Model:
    """Logistic regression on the posteriors of the votes, by Newton's method.
    parts are features and rates of some rows each; what the classifier sees of
    them is made a part at a time, so memory follows the largest part."""
    n = sum(len(f) for f, _ in parts)
    model.means = sum(inputs(f, g).sum(0) for f, g in parts) / n
    model.scales = np.maximum(np.sqrt(sum(((inputs(f, g) - model.means) ** 2).sum(0) for f, g in parts) / n), 1e-3)
    w = np.zeros(len(model.means) + 1)
    keep = np.full(len(w), ridge * n / 100 + 1e-6)
    keep[-1] = 1e-6
    for _ in range(rounds):
        h, d = np.diag(keep), -keep * w
        for f, g in parts:
            z = np.hstack([(inputs(f, g) - model.means) / model.scales, np.ones((len(f), 1))])
            s = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h += (z * (s * (1 - s) + 1e-6)[:, None]).T @ z
            d += z.T @ (posterior(model, votes(f)) - s)
        step = np.linalg.solve(h, d)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def _logit(model: Model, f: np.ndarray, g: np.ndarray) -> np.ndarray:
    return ((inputs(f, g) - model.means) / model.scales) @ model.weights[:-1] + model.weights[-1]


def score_of(model: Model, texts: list[str | None]) -> np.ndarray:
    out = np.zeros(len(texts))
    for s in range(0, len(texts), 256):
        some = texts[s : s + 256]
        z = _logit(model, np.array([features(model, t) for t in some]), np.array([grams(t) for t in some]))
        out[s : s + 256] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def calibrated(model: Model, z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> Model:
    """The model with its scores' scale and offset fitted to labelled rows,
    weighted to the labels' true shares; ridge ties both to what they were."""
    x, w = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - s)) - ridge * (w - [1, 0])
        h = (x * (weight * s * (1 - s))[:, None]).T @ x + ridge * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    if w[0] > 0:
        model.weights = model.weights * w[0]
        model.weights[-1] += w[1]
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3_000, most_stems: int = 300, train_rows: int = 10_000) -> Model:
    """Fit voters, label model and classifier. Labels of held-out rows are not
    read. per_class bounds the labelled rows of each label behind the induced
    lexicons and the scores' scale, most_stems the entries of these lexicons,
    and train_rows the documents behind the classifier (about so many are drawn
    by a hash of ids, twice as many at most); the votes behind the label model
    are those of all documents. Without labels of both kinds, or without
    documents, the lexicons of insults and the patterns are all there is."""
    spark = docs.sparkSession
    chosen, n = labelled_sample(labels, per_class)
    known = bool(n.get(1) and n.get(0))
    stems = induced_stems(docs, chosen, n, per_class, most_stems) if known else []
    prior = n[1] / (n[0] + n[1]) if known else 0.1
    voters = [(w, 0, i) for i, words in enumerate(INSULTS.values()) for w in words.split()]
    voters += [(s, level, len(INSULTS) + i % GROUPS) for i, (s, level) in enumerate(stems)]
    n_voters = len(INSULTS) + GROUPS
    shared = spark.sparkContext.broadcast(Model(voters, n_voters, prior, *[np.zeros(0)] * 3, name=uuid.uuid4().hex))
    rows = columns_free_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = n_voters + 4

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            f = np.array([features(shared.value, t) for t in b.column("text").to_pylist()]).reshape(b.num_rows, width)
            v = np.hstack([votes(f), np.ones((len(f), 1))])
            total += v.T @ v
            trim()
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], ["at", "value"])

    sums = rows.mapInArrow(looked, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()  # width squared rows
    moments = np.zeros(width * width)
    for r in sums:
        moments[r["at"]] = r["value"]
    moments = moments.reshape(width, width)
    model = label_model(moments, moments[-1, -1], voters, n_voters, prior)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, PART):
                part = b.slice(start, PART)
                texts = part.column("text").to_pylist()
                values = np.array(part.column("toxic").to_pylist(), float), np.array([features(shared.value, t) for t in texts]), np.array([grams(t) for t in texts])
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], ["toxic", "f", "g"])

    def drawn(some: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Features, rates and label of rows, in parts that lie where they were received."""
        got = some.select("text", "toxic").mapInArrow(described, "toxic binary, f binary, g binary").toArrow()
        read = lambda value, kind: np.frombuffer(value.as_buffer(), kind)
        return [(read(f, float).reshape(-1, width), read(g, np.float32).reshape(-1, BUCKETS), read(y, float)) for y, f, g in zip(got["toxic"], got["f"], got["g"])]

    share = train_rows / max(moments[-1, -1], 1)
    some = rows if share >= 1 else rows.where(F.xxhash64("doc_id", F.lit(11)) < int(-(2**63) + share * 2**64)).limit(2 * train_rows)
    parts = [(f, g) for f, g, _ in drawn(some.withColumn("toxic", F.lit(0)))]
    model = train(model, parts or [(np.zeros((1, width)), np.zeros((1, BUCKETS), np.float32))])
    del parts
    if known:
        rated = [(_logit(model, f, g), y.copy()) for f, g, y in drawn(rows.join(F.broadcast(chosen), "doc_id"))]  # 2 * per_class rows
        if rated:
            z, y = (np.concatenate(x) for x in zip(*rated))
            model = calibrated(model, z, y, np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9)))
    trim()  # the rows it was fitted on
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score and
    predicted. A null text is empty and scores like one; ids may be null or
    repeated; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score_of(shared.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    rows = columns_free_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns.
    A null text is empty; repeated rows are treated alike; an empty table stays
    empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        rejected = pd.Series(score_of(shared.value, list(texts)) >= 0.5)
        trim()
        return rejected

    return docs.where(~toxic("text"))
