"""Fingerprints, source divergence and whitening against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import divergence, merkle, queries, whitening

SMALL = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def root(text):
    return sha("".join(sha("".join(sha(p) for p in s.split("\n"))) for s in text.split("\n\n")))


def phrases(text):
    return set(re.findall(merkle.PHRASE, text))


def like(a, b):
    size = lambda s: sum(map(len, s))
    a, b = phrases(a), phrases(b)
    return 2 * size(a & b) / (size(a) + size(b)) if a or b else 1.0


def edited(text, after):
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def test_fingerprints_odd_rows(odd):
    rows = merkle.quarter_edits(odd).select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", F.round("near_edited", 9), F.round("near_next", 9)).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == Counter((i, root(t)) for i, t in texts)
    # each row's next is a row that may follow it
    for r in rows:
        own = [t for i, t in texts if i == r["doc_id"] and root(t) == r["fingerprint"]][0]
        later = sorted({i for i, _ in texts if i is not None and (r["doc_id"] is None or i > r["doc_id"])})
        may = [t for i, t in texts if i == r["doc_id"] or i == (later[0] if later else None) or (not later and i is None)]
        assert (r["edited"], r["edited_fingerprint"], r[5], r[6]) in [(edited(own, n), root(edited(own, n)), round(like(own, edited(own, n)), 9), round(like(own, n), 9)) for n in may]


def test_next_runs_through_all_ranges(spark, docs):
    texts = {i: f"text {i} é " * (i % 7 + 1) for i in range(0, 900, 3)}
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(docs(*texts.items()).repartition(5)).collect()}
    ids = sorted(texts)
    assert got == {i: texts[j] for i, j in zip(ids, ids[1:] + ids[:1])}


def test_next_of_a_hot_id_is_spread(docs):
    rows = docs(*[(7, f"t{i}") for i in range(300)], *[(7, "same")] * 300, (9, "last"))
    spark = rows.sparkSession
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        led = merkle.with_next(rows)
        assert led.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 400
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = [(r["text"], r["next_text"]) for r in led.collect()]
    assert sorted(t for t, _ in got) == sorted(t for _, t in got)  # one ring through all rows
    assert sum(t == "same" == n for t, n in got) == 299


def test_fingerprints_of_one_row_and_of_none(docs):
    r = merkle.quarter_edits(docs((1, "one two three four"))).first()
    assert r["edited"] == edited("one two three four", "one two three four") and r["near_next"] == 1.0
    assert merkle.quarter_edits(docs()).count() == 0


def test_long_texts_have_one_pass_each(docs):
    text = "\n".join(f"line {i} of many. And more {i}" for i in range(60_000))
    r = merkle.quarter_edits(docs((1, text), (2, "x " * 500_000))).where("doc_id = 1").first()
    assert r["fingerprint"] == root(text) and round(r["near_edited"], 2) == 0.86  # 2 * 3/4 : (1 + 3/4), for the new quarter is one phrase


def test_edits_locate_branches(docs):
    a = "title\n\nfirst par\nsecond par\n\nlast"
    b = "title\n\nfirst par\nsecond PAR\nnew\n\nlast"
    before, after = docs((1, a), (2, a), (3, "gone"), (None, a)), docs((1, a), (2, b), (None, b))
    got = {(r["doc_id"], r["side"], (a if r["side"] == "before" else b)[r["start"] : r["end"]]) for r in merkle.edits(before, after).where("doc_id is null or doc_id <> 3").collect()}
    assert got == {(i, s, t) for i in (2, None) for s, t in (("before", "second par"), ("after", "second PAR"), ("after", "new"))}
    assert [tuple(r)[:4] for r in merkle.edits(before, after).where("doc_id = 3").collect()] == [(3, "before", 0, 4)]


GROUPS = "text string, lang string, source string, term string, g long, value long"


def plain_audit(rows, least_docs=3, most=200):
    rows = [(t or "", l or "", s or "") for t, l, s, *_ in rows]
    out = {}
    for lang in {l for _, l, _ in rows}:
        words = [(s, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t, l, s in rows if l == lang]
        docs = Counter(w for _, ws in words for w in set(ws))
        kept = sorted(w for w in docs if docs[w] >= least_docs)
        count = {s: Counter(w for s2, ws in words if s2 == s for w in ws) for s in {s for s, _ in words}}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[w] for w in kept) + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in p:
            pair = [(-sum(f(p[s][w], p[o][w]) for w in kept), o) for o in p if o != s]
            term = [(-f(p[s][w], q[w]), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pair, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:most])):
                out |= {(lang, s, part, item): (-v, n) for n, (v, item) in enumerate(items, 1)}
    return out


def audited(df):
    return {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in df.collect()}


def test_divergence_rotates_through_all_cells(spark):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(300)] + ["Über", "THE", "the"]
    rows = [(" ".join(rng.choice(words, 30)), lang, f"s{i % n}", "t", 1, 2) for lang, n in (("a", 13), ("b", 6), ("c", 1)) for i in range(60)]
    df = spark.createDataFrame(rows, GROUPS)
    want = plain_audit(rows, most=7)
    for block, cell in ((500, 2), (10_000, 3), (1 << 20, 50)):
        assert audited(divergence.audit(df, most_terms=7, block_bytes=block, cell_groups=cell)) == want


def test_divergence_odd_rows(spark):
    long_ = "lang " * 50_000
    rows = [(None, None, None, None, 1, 1), ("", "x", "a", None, 1, 1), ("12 ! ?", "x", "b", "t", 1, 1), (long_, "y", "a", None, 1, 1), (long_, "y", "a", None, 1, 1), (long_, "y", None, None, 1, 1), ("lang ONCE", "y", "c", None, 1, 1), ("few", "z", "a", None, 1, 1)]
    assert audited(divergence.audit(spark.createDataFrame(rows, GROUPS))) == plain_audit(rows)
    assert divergence.audit(spark.createDataFrame([], GROUPS)).count() == 0


@pytest.mark.parametrize("cells", [2, 4, 6, 10])
def test_every_two_cells_meet_once(spark, cells):
    at = spark.range(cells).select(F.col("id").alias("c"), F.lit(cells).cast("long").alias("n"))
    met = Counter()
    for turn in range(cells - 1):
        to = {r[0]: r[1] for r in at.select("c", divergence.partner(F.col("c"), F.col("n"), turn).cast("long")).collect()}
        assert all(to[to[c]] == c != to[c] for c in to)
        met.update(frozenset(x) for x in to.items())
    assert set(met.values()) == {2} and len(met) == cells * (cells - 1) // 2


def test_shares_are_exact():
    for total in (3, 10**9 + 7, 7 * 10**15):
        counts = np.array([0, 1, total // 3, total - 1], np.int64)
        assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


VECTORS = "vec_id long, embedding array<float>, n long, i int, whitened double"


def test_scatter_is_exact(spark):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(700, 6)) * [1, 50, 1e4, 1e7, 1e9, 3]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1, 2, 0.5) for i, x in enumerate(v)], VECTORS).repartition(5)
    rows, d = whitening.usable(df)
    z, n, sums, _ = whitening.scatter(rows, d)
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in r] for r in v]
    assert sums == [sum(c) for c in zip(*x)] and n == 700
    y = [[n * a - s for a, s in zip(r, sums)] for r in x]
    assert z.tolist() == [[sum(r[i] * r[j] for r in y) for j in range(6)] for i in range(6)]


def test_whitening_of_whole_table(spark):
    df = queries.op13_whitening(spark, SMALL)
    out = df.toPandas()
    v = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    x = np.floor(np.stack(v["embedding"]).astype(np.float64) * 64).astype(np.int64) + 1_000_000
    n = len(x)
    y = n * x - x.sum(axis=0)
    cov = (y.T @ y) / n**3
    values = np.linalg.eigvalsh(cov)[::-1]
    assert len(out) == n * 32 and (out["identity_error"] < 1e-9).all()
    first = out.drop_duplicates("component").sort_values("component")
    np.testing.assert_allclose(first["explained"], values[:32] / values.sum(), rtol=1e-9)
    w = out.pivot(index="vec_id", columns="component", values="whitened").loc[v["vec_id"]].to_numpy()
    np.testing.assert_allclose(w.T @ w / n, np.eye(32), atol=1e-8)
    # a row's component is its projection: cov applied to the loading gives it back by its eigenvalue
    loadings = (y / n).T @ w / n
    np.testing.assert_allclose(loadings.T @ loadings, np.diag(values[:32]), atol=1e-6)
    want = dict(zip(v["vec_id"].tolist(), (y * y).sum(axis=1).tolist()))
    assert dict(zip(out["vec_id"], out["deviation"])) == want


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i), float(i * i), 1.0], 1, 2, 0.5) for i in range(5)]
    bad = [(10, None, 1, 2, 0.5), (11, [1.0, None, 2.0], 1, 2, 0.5), (12, [nan, 1.0, 1.0], 1, 2, 0.5), (13, [inf, 1.0, 1.0], 1, 2, 0.5), (14, [1.0, 2.0], 1, 2, 0.5), (15, [], 1, 2, 0.5)]
    rows, d = whitening.usable(spark.createDataFrame([*good, *good, (None, [2.0, 2.0, 1.0], 1, 2, 0.5), *bad], VECTORS))
    model = whitening.fit(rows, d)
    out = whitening.whitened(rows, d, model).collect()
    assert (d, model.n, len(out)) == (3, 11, 11) and all(len(r["whitened"]) == 2 for r in out)  # the third entry never changes
    assert whitening.identity_error(rows, d, model) < 1e-9
    assert len({(r["vec_id"], r["deviation"]) for r in out}) == 6
    rows, d = whitening.usable(spark.createDataFrame([good[0]] * 3, VECTORS))
    model = whitening.fit(rows, d)
    assert len(model.values) == 0 and all(r["whitened"] == [] and r["deviation"] == 0 for r in whitening.whitened(rows, d, model).collect())
    assert whitening.usable(spark.createDataFrame([], VECTORS))[1] == 0
    rows, d = whitening.usable(spark.createDataFrame([(1, [1e30], 1, 2, 0.5)], VECTORS))
    with pytest.raises(Exception, match="too large"):
        whitening.fit(rows, d)
