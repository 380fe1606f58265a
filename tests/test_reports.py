"""Report lines, prompts, traces, failures, orders of judges, objects, status changes."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import jobs, reports
from docloom.operators.tenants import Actor, TenantScope
from docloom.sources.objects import ObjectStore, sent_files


def test_evidence_lines_leave_out_what_is_not_there(spark):
    rows = [("T", "第1条", 3, "v2", "https://a"), (None, None, None, None, None), ("", "", 0, "", ""), ("T", None, None, "v", None)]
    df = spark.createDataFrame(rows, "t string, a string, p int, v string, u string")
    got = [r[0] for r in df.select(reports.evidence_line(*[F.col(c) for c in "tapvu"])).collect()]
    assert got == ["《T》第1条，第 3 页，v2，https://a", "《证据来源》", "《证据来源》", "《T》，v"]


def test_reports_go_over_pages(spark):
    findings = spark.createDataFrame([("j", i, "high", f"c{i}", "p", "r", None, "x") for i in range(1, 8)], "job string, place int, risk_level string, clause_id string, problem string, reason string, suggestion string, proposed_clause string")
    evidence = spark.createDataFrame([("j", 1, 2, "two"), ("j", 1, 1, "one"), ("k", 1, 1, "lost")], "job string, place int, rank int, line string")
    got = reports.report_lines(spark.createDataFrame([("j", "complete"), ("e", None)], "job string, status string"), findings, evidence).orderBy("job", "line").collect()
    assert [r["text"] for r in got if r["job"] == "e"] == ["任务：e", "状态：", ""]
    mine = [r for r in got if r["job"] == "j"]
    assert [r["text"] for r in mine[:13]] == ["任务：j", "状态：complete", "", "风险：high", "条款：c1", "问题：p", "理由：r", "建议：", "参考条款：x", "证据：one", "证据：two", "", "风险：high"]
    assert len(mine) == 3 + 7 * 7 + 2 and [r["page"] for r in mine] == [i // 46 + 1 for i in range(len(mine))]


def test_blocks_and_requests(spark):
    df = spark.createDataFrame([("q", ["a", None], ["n1", "n2"])], "q string, t array<string>, n array<string>")
    r = df.select(reports.evidence_block(F.col("t")), reports.evidence_block(F.col("t"), F.col("n")), reports.judge_request(F.col("q"), F.col("t")), reports.expansion_request(F.col("q"), 3)).first()
    assert (r[0], r[1]) == ("[E1] a\n[E2] ", "[n1] a\n[n2] ")
    assert r[2].startswith("待审核条款检索词：\nq\n\n候选证据：\n[E1] a\n[E2] \n\n请输出") and r[3].endswith("请生成不超过 3 条检索查询词，覆盖不同表述和检索角度。")


def test_traces_name_every_channel(spark):
    hits = spark.createDataFrame([("q", "b", 2, 0.5), ("q", "a", 1, 1.0)], "query string, item string, rank int, score double")
    assert json.loads(reports.traces({"vector": hits}).first()["trace"]) == {"query": "q", "channels": [{"name": "vector", "hits": [{"chunk_id": "a", "rank": 1, "score": 1.0}, {"chunk_id": "b", "rank": 2, "score": 0.5}]}, {"name": "keyword", "hits": []}, {"name": "reference", "hits": []}]}
    with pytest.raises(ValueError, match="channels"):
        reports.traces({"other": hits})


def test_failures_are_merged_by_channel(spark):
    rows = [("q", 1, "vector", "slow"), ("q", 2, "vector", "lost"), ("r", 1, "odd", "x"), ("s", 1, "vector", "x"), ("s", 1, "keyword", "x"), ("s", 1, "reference", "x")]
    got = {r["query"]: (r["failures"], r["problem"]) for r in reports.merged_failures(spark.createDataFrame(rows, "query string, at int, channel string, reason string")).collect()}
    assert got["q"] == ({"vector": "lost"}, None) and got["r"][1] == "unknown channel" and got["s"][1] == "all channels failed"


def test_judges_order_and_children(spark):
    said = spark.createDataFrame([(1, ["c", "x", "a", "c"]), (2, None)], "clause int, usable array<string>")
    held = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (1, "c", 0.3)], "clause int, item string, score double")
    assert [(r["item"], r["place"]) for r in reports.in_judges_order(said, held).orderBy("place").collect()] == [("c", 1), ("a", 2)]
    chunks = spark.createDataFrame([("p", None, 0), ("c2", "p", 2), ("c1", "p", 1), ("q", None, 3)], "id string, parent_id string, ordinal int")
    assert {r["id"]: r["children"] for r in reports.children(chunks).collect()} == {"p": ["c1", "c2"], "q": []}


def test_locators_states_labels_and_lists(spark):
    df = spark.createDataFrame([('{"article_number": "第1条", "page_start": 2, "other": 3, "bboxes": [{"x0": 1.0}]}', "partial", "", "c-1", " a ,, b"), (None, "odd", "第1条", "c", None)], "l string, s string, a string, c string, t string")
    got = df.select(reports.clause_locator(F.col("l")), reports.task_state(F.col("s")), reports.clause_label(F.col("a"), F.col("c")), reports.listed(F.col("t"))).collect()
    assert [tuple(x) if isinstance(x, tuple) else x for x in got[0]] == [("第1条", None, 2, None, '[{"x0":1}]'), "completed", "条款 c-1", ["a", "b"]]
    assert [tuple(x) if isinstance(x, tuple) else x for x in got[1]] == [(None, None, None, None, "[]"), None, "第1条", []]


def test_objects_are_written_once(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path / "store"), most=5)
    put = lambda batch, *rows: sorted(tuple(r)[::2] for r in store.put(spark.createDataFrame([(k, v) for k, v in rows], "key string, content binary"), batch).collect())
    assert put("b1", ("public/law/a", b"x"), ("public/law/a", b"x"), ("public/../b", b"x"), ("public/law/big", b"123456"), ("public/law/n", None)) == [("public/../b", "key not allowed"), ("public/law/a", "created"), ("public/law/big", "too large"), ("public/law/n", "no content")]
    assert put("b2", ("public/law/a", b"x"), ("public/law/b", b"y")) == [("public/law/a", "exists"), ("public/law/b", "created")]
    assert put("b3", ("public/law/a", b"z"), ("public/law/c", b"1"), ("public/law/c", b"2"))[0] == ("public/law/a", "conflict")
    got = {r["key"]: r["content"] for r in store.get(spark.createDataFrame([("public/law/a",), ("public/law/c",), ("none",)], "key string")).collect()}
    assert got["public/law/a"] == b"x" and got["none"] is None and got["public/law/c"] in (b"1", b"2")


def test_sent_files(spark):
    rows = [(base64.b64encode(b"abc").decode(), "n", "t"), ("!", None, None), (None, "", ""), ("", "n", "t"), ("YWJj\n", "n", "t")]
    got = sent_files(spark.createDataFrame(rows, "data string, name string, kind string"), "data", "name", "kind").collect()
    assert [(r["bytes"], r["filename"], r["content_type"], r["problem"]) for r in got] == [(b"abc", "n", "t", None), (None, "document", "application/pdf", "not base64"), (None, "document", "application/pdf", "no file"), (b"", "n", "t", None), (None, "n", "t", "not base64")]


def test_status_changes_stay_within_the_tenant(spark):
    docs = spark.createDataFrame([(1, "public", None, "active"), (2, "firm", "t", "deleted"), (3, "firm", "x", "active")], "doc int, scope string, tenant_id string, status string")
    after, told = TenantScope(Actor("u", "t", "admin")).with_status(docs, spark.createDataFrame([(1, "archived"), (2, "active"), (2, "archived"), (3, "archived"), (9, "active"), (2, "odd")], "doc int, status string"))
    assert {r["doc"]: r["status"] for r in after.collect()} == {1: "active", 2: "archived", 3: "active"}
    assert {r["doc"]: r["changed"] for r in told.collect()} == {1: False, 2: True, 3: False, 9: False}


def test_requesters_are_looked_up(spark):
    rows, users = spark.createDataFrame([("t", "ann"), ("t", "bob"), ("x", "ann")], "tenant_id string, subject string"), spark.createDataFrame([(2, "t", "ann"), (1, "t", "ann"), (3, "y", "bob")], "id int, tenant_id string, name string")
    assert {(r["tenant_id"], r["subject"]): r["requested_by"] for r in jobs.with_requester(rows, users).collect()} == {("t", "ann"): 1, ("t", "bob"): None, ("x", "ann"): None}
