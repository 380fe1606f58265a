"""What grows with the input is moved and computed once."""

import json

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import answers, grounding, jobs, reports, retrieval
from docloom.operators.postings import KeywordIndex
from docloom.operators.transitions import JobLog
from docloom.plans import knowledge, reviews

from conftest import SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_titles_are_looked_at_where_they_are_read(spark, monkeypatch):
    titles = spark.createDataFrame([(i, t) for i in range(30) for t in ("the long title", f"no {i % 7} title", "a_b")], "item long, title string")
    terms = spark.createDataFrame([(t,) for t in ("title", "no 3", "long_t", "none", "_", "a")], "term string")
    sent = retrieval.titles_with(titles, terms, 4)
    got = sorted(map(tuple, sent.collect()))
    # one exchange by term, after each task has cut its hits to the limit
    assert "WindowGroupLimit" in plan_of(sent) and "SortMergeJoin" not in plan_of(sent)
    monkeypatch.setattr(retrieval, "MOST_SENT_TERMS", 0)
    assert sorted(map(tuple, retrieval.titles_with(titles, terms, 4).collect())) == got
    assert [i for t, i in got if t == "no 3"] == [3, 10, 17, 24] and [i for t, i in got if t == "title"] == [0, 1, 2, 3]


def test_texts_without_articles_and_headings_are_passed_over(spark):
    rows = spark.createDataFrame([("plain text",), ("第3条 x",), ("条 第3条",), ("a\n总 则\nb",), ("汉字 ab",), (None,)], "t string")
    got = rows.select(T.article_number(F.col("t")), T.may_have_heading(F.col("t")), T.word_tokens(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(None, False, ["plain", "text"]), ("第3条", True, ["第", "第", "3", "条", "条", "x"]), (None, True, ["条", "条", "第", "第", "3", "条", "条"]), (None, True, ["a", "总", "总", "则", "则", "b"]), (None, False, ["汉字", "汉", "字", "ab"]), (None, None, None)]


def test_transitions_write_once_and_only_what_changes(spark, tmp_path):
    log = JobLog(spark, str(tmp_path / "log"), compact_every=9)
    ask = spark.createDataFrame([("t", f, f"sha-{f}", "{}") for f in "ab"], "tenant_id string, filing string, sha256 string, config string")
    made = {r["filing"]: r["job"] for r in log.create(ask, "create").collect()}
    before = {r["job"]: r for r in log.jobs().collect()}
    failed = spark.createDataFrame([(made["a"], "failed", 3, 0, "lost")], "job string, status string, total_clauses long, completed_clauses long, failure_reason string")
    log.update(failed, "fail")
    asked = spark.createDataFrame([(made["a"], "t"), (made["a"], "t"), (made["b"], "x"), (made["a"], None), ("none", "t")], "job string, tenant_id string")
    told = log.retry(asked, "retry")
    no = "no such job"
    assert sorted(map(str, told.collect())) == sorted(str(r) for r in spark.createDataFrame([(made["a"], "t", None), (made["b"], "x", no), (made["a"], None, no), ("none", "t", no)], told.schema).collect())
    # one table a version, in which a change has no more than it changes
    assert {p.name for p in (tmp_path / "log").iterdir()} == {"answers", "commits"}
    assert [(r["job"], r["status"], r["filing"], r["idempotency_key"]) for r in log._changes(1).collect()] == [(made["a"], "failed", None, None)]
    assert {r["job"]: r for r in log.jobs().collect()} == before
    assert "max(filing" in plan_of(log.jobs().select("job", "filing")) and "max(idempotency_key" not in plan_of(log.jobs().select("job", "filing"))


def test_tokens_are_made_once_a_batch(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(n):
        made.add(1)
        return ["x", f"w{n % 3}", "x", None]

    rows = spark.range(40, numPartitions=3).select(F.col("id").alias("item"), tokens("id").alias("tokens"))
    index = KeywordIndex(spark, str(tmp_path / "index"), buckets=4, file_postings=10)
    index.ingest(rows, "a")
    assert made.value == 40
    assert sorted(map(tuple, index.postings().where("item = 7").collect()), key=str) == [("w1", 7, 1), ("x", 7, 2), (None, 7, 1)]
    assert index.items().where("n_tokens = 4").count() == 40
    # a batch that all of its items have left is not read, and one that none has left is not joined
    index.ingest(spark.range(40).select(F.col("id").alias("item"), F.array(F.lit("y")).alias("tokens")), "b", replace=True)
    whole = plan_of(index.postings())
    assert "batch=a" not in whole and "Join" not in whole
    index.ingest(spark.createDataFrame([(3, ["z"])], "item long, tokens array<string>"), "c", replace=True)
    assert "Join" in plan_of(index.postings()) and index.postings().groupBy("token").count().orderBy("token").collect() == [("y", 39), ("z", 1)]
    assert not any((tmp_path / "index/staged").iterdir())


def test_chunks_are_hashed_before_their_facts_are_joined(spark):
    above, below = plan_of(knowledge.chunk_rejects(spark, SMALL)).split("Join", 1)
    assert "sha2(" in below and "sha2(" not in above


def test_places_of_children_are_laid_out_after_the_shuffle(spark):
    children = spark.createDataFrame([(1, [1, 2], "x"), (1, [1, 2], "x"), (1, [2], "x"), (1, [1], "a"), (2, [], "b")], "k int, at array<int>, v string")
    got = jobs.nested(spark.range(1, 4).select(F.col("id").cast("int").alias("k")), children, ["k"], "at", "v")
    assert {r["k"]: [tuple(x) for x in r["items"]] for r in got.collect()} == {1: [(1, "a"), (1, "x"), (2, "x")], 2: [], 3: []}
    plan = plan_of(reviews.scoped_detail(spark, SMALL))
    assert "Generate" not in plan and "LeftSemi" in plan


def test_lines_of_pages_are_shuffled_once(spark):
    plan = plan_of(knowledge.page_blocks(spark, SMALL))
    texts = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "REPARTITION_BY_COL" in x]
    assert len(texts) == 1 and plan.count("Exchange hashpartitioning") <= 4  # the others are of sizes, without texts


def test_keyword_blocks_hold_their_scores_once(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from docloom.operators import kernels

    rng = np.random.default_rng(1)
    rows = pa.table({"item": np.arange(512), "tokens": [[f"w{x}" for x in rng.integers(0, 900, 30)] for _ in range(512)]})
    asked = pa.table({"query": np.arange(2_000), "terms": [[f"w{x}" for x in rng.choice(900, 5, replace=False)] for _ in range(2_000)]})
    given, peaks = [], []
    monkeypatch.setattr(kernels, "give_back", lambda: given.append(1), raising=False)
    monkeypatch.setattr(kernels, "CELLS", 512 * 2_000)  # one block, whose scores have 8 MB
    tracemalloc.start()
    got = pa.Table.from_batches(kernels.keyword_best(3)(iter(rows.to_batches()), asked)).to_pylist()
    peaks.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert given and peaks[0] < 4.5 * 8e6  # wanted, what rows have, scores and their order
    for q in (0, 7, 1_999):
        terms = set(asked["terms"][q].as_py())
        n = [(-sum(w in terms for w in ws), i) for i, ws in enumerate(rows["tokens"].to_pylist())]
        assert [(-r["n"], r["item"]) for r in got if r["query"] == q] == sorted(x for x in n if x[0])[:3]


def test_texts_for_a_model_stay_in_arrow(spark):
    import pyarrow as pa

    from docloom.operators import models

    embed = models.embedding(models.LetterModel, 26, batch=2)
    (made,) = embed.func(iter([pa.array(["ab", None, "", "b", "BB"])]))
    assert isinstance(made, pa.StructArray) and [None if r["vector"] is None else [round(x, 3) for x in r["vector"][:2]] for r in made.to_pylist()] == [[0.707, 0.707], None, [0, 0], [0, 1], [0, 1]]
    assert made.field("problem").null_count == 5


def test_payloads_are_redacted_in_their_rows(spark):
    seen = {'x"token': [1], "k,": "token", "l": ["token", {"tokens": 1}, ',"token":', '\\"token":1'], "pa\u017f\u017fword": 2, "\\": {"a": "}"}}
    secret = {"TO\u212aEN": {"a": [{"b": "]}\\\""}, []]}, "password": "\\", "authorization": -1.5, "api_key": {}, "z": [{"Token": True}]}
    rows = spark.createDataFrame([(1, json.dumps(seen)), (2, json.dumps(seen | secret)), (3, json.dumps(secret))], "i int, payload string")
    out = answers.redacted(rows, "payload")
    assert "Exchange" not in plan_of(out) and "docloom" not in plan_of(out) and "redact-" not in plan_of(out)
    gone = dict.fromkeys(secret, answers.REDACTED) | {"z": [{"Token": answers.REDACTED}]}
    assert [json.loads(r["payload"]) for r in out.orderBy("i").collect()] == [seen, seen | gone, gone]


def test_values_are_not_read_as_numerals_again(spark):
    rows = spark.createDataFrame([("2024 年 1 月 2 日，3 %，4，77，五", "二零二四年1月2日，三%，七十七", ["a"], ["a"]), ("5-6 78.5", None, ["b"], ["a"])], "text string, evidence string, evidence_ids array<string>, allowed_ids array<string>")
    out = grounding.checked(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[零〇一二三四五六七八九十百千万两]+") <= 2
    assert [(r["unsupported"], r["grounded"]) for r in out.collect()] == [([], True), (["78.5"], False)]


def test_lines_of_reports_are_made_after_they_are_placed(spark):
    """Findings that share a place, lines without a text and evidence without a finding among them."""
    names = [c for _, c in reports.FINDING]
    found = [("j", 2, "b", "x"), ("j", 2, "a", "y"), ("j", 0, None, "z"), (None, 1, "n", "n")]
    findings = spark.createDataFrame([(j, p, *[f"{v}{c}" if v else None for c in names]) for j, p, v, _ in found], "job string, place int, " + ", ".join(f"{c} string" for c in names))
    evidence = spark.createDataFrame([("j", 2, 2, "e2"), ("j", 2, 1, None), ("j", 2, 1, "e1"), ("j", 3, 1, "lost"), (None, 1, 1, "lost")], "job string, place int, rank int, line string")
    out = reports.report_lines(spark.createDataFrame([("j", "s"), ("i", None)], "job string, status string"), findings, evidence)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Generate") < plan.find("Window")
    got = {j: [r["text"] for r in out.orderBy("line").collect() if r["job"] == j] for j in ("j", "i", None)}
    each = lambda v: [f"{name}{v}{c}" if v else name for name, c in reports.FINDING]
    two = [x for pair in zip(each("a"), each("b")) for x in pair]
    assert got["j"] == ["任务：j", "状态：s", "", *each(None), "", *two, None, "证据：e1", "证据：e2", "", ""]
    assert got["i"] == ["任务：i", "状态：", ""] and got[None] == [*each("n"), ""]
