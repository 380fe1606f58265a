"""Channels against plain versions: nulls, ties, articles, exclusions, and blocks instead of a broadcast."""

import math
from collections import Counter

import numpy as np
import pytest

from docloom.operators import kernels, retrieval

ROWS = "item long, tokens array<string>, article string, vector array<float>"
ASKED = "query string, terms array<string>, articles array<string>, excluded array<long>, query_vector array<float>"


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(40)]
    vectors = rng.normal(size=(12, 4)).astype(np.float32)
    rows = []
    for i in range(600):
        v = vectors[i % 12] if i % 3 else vectors[i % 12] + rng.normal(size=4).astype(np.float32) * 1e-6
        tokens = rng.choice(words, rng.integers(0, 30), p=[0.4] + [0.6 / 39] * 39).tolist()
        rows.append((i, None if i % 97 == 5 else [*tokens, None] if i % 31 == 0 else tokens, "第 1 条" if i % 40 == 3 else "第2条" if i % 55 == 1 else None, None if i % 50 == 7 else [0.0] * 4 if i % 50 == 8 else [1.0, 2.0] if i % 50 == 9 else [float("nan"), 1.0, 1.0, 1.0] if i % 50 == 10 else v.tolist()))
    asked = [("a", ["w0", "w1", "w1"], ["第1条"], [0, 3, 5], vectors[0].tolist()), ("b", ["w7", None], [], None, vectors[5].tolist()), ("c", [], ["第1条", "第2条"], [], None), ("d", None, None, [1], [1.0, 2.0]), ("e", ["none"], None, None, [0.0] * 4)]
    return rows, asked


def plain_keywords(rows, asked, limit):
    out = {}
    for q, terms, articles, excluded, _ in asked:
        hits = []
        for item, tokens, article, _ in rows:
            n = Counter(tokens or [])
            s = sum(n[t] for t in set(terms or []) if t is not None) * 0.1
            s = 2.0 if article and article.replace(" ", "") in (articles or []) else s
            if s > 0 and item not in (excluded or []):
                hits.append((-s, item))
        out |= {(q, i): (n, round(-s, 9)) for n, (s, i) in enumerate(sorted(hits)[:limit], 1)}
    return out


def plain_vectors(rows, asked, limit):
    out = {}
    for q, _, articles, excluded, wanted in asked:
        hits = []
        for item, _, article, v in rows:
            named = bool(article and article.replace(" ", "") in (articles or []))
            near = None
            if v and wanted and len(v) == len(wanted):
                a, b = np.float32(v).astype(float), np.float32(wanted).astype(float)
                d = math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())
                near = float((a * b).sum() / d) if d and math.isfinite(d) else None
            if (named or near is not None) and item not in (excluded or []):
                hits.append((not named, near is None, -round(near or 0, 12), item))
        out |= {(q, i): (n, None if s is None else round(s, 9)) for n, (named, none, s, i) in enumerate([(x[0], x[1], 2.0 if not x[0] else -x[2], x[3]) for x in sorted(hits)[:limit]], 1)}
    return out


def found(df):
    return {(r["query"], r["item"]): (r["rank"], round(r["score"], 9)) for r in df.collect()}


@pytest.mark.parametrize("most", [kernels.MOST_QUERY_BYTES, 150])
def test_keyword_channel(spark, tables, monkeypatch, most):
    monkeypatch.setattr(kernels, "CELLS", 4096)
    monkeypatch.setattr(kernels, "ROW_BLOCK_BYTES", 20_000)
    monkeypatch.setattr(kernels.best_of, "__defaults__", (most,))
    rows, asked = tables
    df, q = spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(asked, ASKED)
    for limit in (1, 7, 1000):
        assert found(retrieval.keyword_channel(df, q, limit)) == plain_keywords(rows, asked, limit)


@pytest.mark.parametrize("most", [kernels.MOST_QUERY_BYTES, 150])
def test_vector_channel(spark, tables, monkeypatch, most):
    monkeypatch.setattr(kernels, "CELLS", 1024)
    monkeypatch.setattr(kernels, "ROW_BLOCK_BYTES", 20_000)
    monkeypatch.setattr(kernels.best_of, "__defaults__", (most,))
    rows, asked = tables
    df, q = spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(asked, ASKED)
    for limit in (3, 60, 1000):
        got, want = found(retrieval.vector_channel(df, q, limit)), plain_vectors(rows, asked, limit)
        # copies of a vector that differ by rounding may change places; scores by rank may not
        by_rank = lambda x: sorted((q, rank, s) for (q, _), (rank, s) in x.items())
        assert by_rank(got) == by_rank(want)
        assert {k for k, v in got.items() if v[1] == 2.0} == {k for k, v in want.items() if v[1] == 2.0}


def test_limits_are_checked(spark, tables):
    df, q = spark.createDataFrame(tables[0], ROWS), spark.createDataFrame(tables[1], ASKED)
    for bad in (0, 1001, True, 2.5):
        with pytest.raises(ValueError, match="limit"):
            retrieval.keyword_channel(df, q, bad)


def test_channels_of_nothing(spark, tables):
    df, q = spark.createDataFrame([], ROWS), spark.createDataFrame(tables[1], ASKED)
    full, none = spark.createDataFrame(tables[0], ROWS), spark.createDataFrame([], ASKED)
    for channel in (retrieval.keyword_channel, retrieval.vector_channel):
        assert channel(df, q).count() == channel(full, none).count() == 0


def test_excluded_titles_leave_room_for_others(spark):
    rows = spark.createDataFrame([(i, f"law {i}", None, None) for i in range(30)], "item long, title string, section_title string, article string")
    asked = spark.createDataFrame([("q", "Law", None, list(range(25)))], "query string, text string, articles array<string>, excluded array<long>")
    assert [r["item"] for r in retrieval.reference_channel(rows, asked, limit=4).orderBy("rank").collect()] == [25, 26, 27, 28]
