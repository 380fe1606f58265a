"""The stored keyword index: batches, replacement, hot tokens, pruned scans."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import postings, retrieval
from docloom.operators.postings import KeywordIndex, search_tokens

CHUNKS = "item string, tokens array<string>"


@pytest.fixture
def index(spark, tmp_path):
    return KeywordIndex(spark, str(tmp_path / "index"), item="string", buckets=8, file_postings=20)


def held(index):
    return {(r["token"], r["item"]): r["n"] for r in index.postings().collect()}


def test_batches_count_once(spark, index):
    one = spark.createDataFrame([("a", ["x", "y", "x"]), ("a", ["x", "y", "x"]), ("b", None), (None, ["x"]), ("c", [])], CHUNKS)
    index.ingest(one, "b1")
    index.ingest(spark.createDataFrame([("a", ["other"])], CHUNKS), "b1")  # the batch is known
    index.ingest(spark.createDataFrame([("a", ["z"]), ("d", ["x"])], CHUNKS), "b2")  # the item is known
    assert held(index) == {("x", "a"): 2, ("y", "a"): 1, ("x", "d"): 1}
    assert {r["item"]: r["n_tokens"] for r in index.items().collect()} == {"a": 3, "b": 0, "c": 0, "d": 1}


def test_half_written_batches_are_not_seen(spark, index, monkeypatch):
    rows = spark.createDataFrame([("a", ["x"])], CHUNKS)

    def lost(*a, **k):
        raise OSError("lost")

    monkeypatch.setattr(index, "_commits", lambda calls=[]: calls.append(1) or (lost() if len(calls) > 1 else {}))
    with pytest.raises(OSError):
        index.ingest(rows, "b1")
    monkeypatch.undo()
    assert held(index) == {} and glob.glob(f"{index.path}/postings/batch=b1/bucket=*")
    index.ingest(rows, "b1")
    assert held(index) == {("x", "a"): 1}


def test_a_backfill_supersedes_and_compacts(spark, index):
    index.ingest(spark.createDataFrame([("a", ["x"]), ("b", ["y"])], CHUNKS), "b1")
    index.ingest(spark.createDataFrame([("a", ["z"]), ("c", ["z"])], CHUNKS), "b2", replace=True)
    index.ingest(spark.createDataFrame([("a", ["w"])], CHUNKS), "b3", replace=True)
    want = {("w", "a"): 1, ("y", "b"): 1, ("z", "c"): 1}
    assert held(index) == want
    index.compact("c1")
    index.compact("c1")
    assert held(index) == want and set(index._commits()) == {"c1"}
    index.ingest(spark.createDataFrame([("a", ["w"]), ("d", ["w"])], CHUNKS), "b4")
    assert held(index) == want | {("w", "d"): 1}


def test_hot_tokens_are_spread_and_scans_pruned(spark, index):
    rows = spark.createDataFrame([(f"i{i:03}", ["hot", f"w{i % 50}"]) for i in range(200)], CHUNKS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.ingest(rows, "b1")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("hot")), F.lit(8))).first()[0]
    assert len(glob.glob(f"{index.path}/postings/batch=b1/bucket={bucket}/*.parquet")) >= 3
    found = index.postings(spark.createDataFrame([("hot",)], "token string"))
    assert found.count() == 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("FileScan")[1:] if "EqualTo(token,hot)" in x)
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {bucket}\)", scan)


def test_search_is_the_keyword_channel(spark, index, monkeypatch):
    rows = spark.createDataFrame([(f"i{i:03}", ["a"] * (i % 5) + ["b"] * (i % 3) + [f"w{i}"]) for i in range(60)], CHUNKS)
    index.ingest(rows, "b1")
    asked = spark.createDataFrame([("q", ["a", "b", "b"], ["第1条"], ["i004"]), ("r", ["w7", "w8"], None, None), ("s", ["none"], None, None)], "query string, terms array<string>, articles array<string>, excluded array<string>")
    articles = spark.createDataFrame([("i050", "第 1 条"), ("zzz", "第1条")], "item string, article string")
    few = rows.where("item < 'i055'").select("item")
    want = retrieval.keyword_channel(rows.join(articles, "item", "left").join(few, "item", "left_semi"), asked, 7).orderBy("query", "rank").collect()
    assert index.search(asked, 7, few, articles).orderBy("query", "rank").collect() == want and want[0]["item"] == "i050"
    monkeypatch.setattr(postings, "MOST_TERMS", 0)
    assert index.search(asked, 7, few, articles).orderBy("query", "rank").collect() == want


def test_search_tokens_take_in_what_is_known(spark):
    rows = spark.createDataFrame([("Body text", "Title", "", None, "Part 2", "第 3 条"), (None, None, None, None, None, None), ("法规", "", "Au", "No1", None, "")], "a string, b string, c string, d string, e string, f string")
    got = [r[0] for r in rows.select(search_tokens(*[F.col(c) for c in "abcdef"])).collect()]
    assert got == [["title", "part", "2", "body", "text", "第3条"], [], ["au", "no1", "法规", "法", "规"]]
