"""Tenant scope, rejects in one pass, and the job log."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import rejects
from docloom.operators.rejects import Rule
from docloom.operators.tenants import AccessError, Actor, TenantScope
from docloom.operators.transitions import Conflict, JobLog


def test_who_may_act_for_whom():
    assert Actor("u", "t", "customer").acting_for() == "t" == Actor("u", "t", "customer").acting_for("t")
    assert Actor("u", "t", "admin", {"x"}).acting_for("x") == "x"
    for actor, tenant in ((Actor("u", "t", "customer", {"x"}), "x"), (Actor("u", "t", "admin"), "x"), (Actor("u", "t", "guest"), None)):
        with pytest.raises(AccessError):
            actor.acting_for(tenant)
    for bad in (lambda: Actor(" ", "t", "admin"), lambda: Actor("u", "", "admin"), lambda: Actor("u", "t", "admin", {""}), lambda: Actor("u", "t", "admin").acting_for(" ")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(AccessError):
        TenantScope(Actor("u", "t", "customer"), public_writes=True)


def test_policies_reach_the_scan(spark, tmp_path):
    rows = [(1, "public", None), (2, "firm", "t"), (3, "firm", "x"), (4, "tenant_private", "t"), (5, None, "t"), (6, "public", "t")]
    spark.createDataFrame(rows, "id int, scope string, tenant_id string").write.parquet(str(tmp_path / "k"))
    df = spark.read.parquet(str(tmp_path / "k"))
    scope = TenantScope(Actor("u", "t", "customer"))
    assert {r["id"] for r in scope.knowledge(df).collect()} == {1, 2, 4, 6}
    own = scope.private(df)
    assert {r["id"] for r in own.collect()} == {2, 4, 5, 6}
    assert "EqualTo(tenant_id,t)" in own._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="scope"):
        scope.listed(df, scope="all")


def test_appends_are_checked(spark):
    docs = spark.createDataFrame([(1, "public", None, "law"), (2, "firm", "t", "firm_rule"), (3, "public", None, "firm_rule")], "doc int, scope string, tenant_id string, source_type string")
    rows = spark.createDataFrame([(10, 1, "public", None), (11, 2, "firm", "t"), (12, 2, "firm", "x"), (13, 3, "public", None), (14, 9, "firm", "t"), (15, 1, "firm", "t"), (16, 2, "none", "t"), (17, 1, "public", "t")], "chunk int, doc int, scope string, tenant_id string")
    fine, bad = TenantScope(Actor("u", "t", "admin"), public_writes=True).appendable_chunks(rows, docs)
    assert {r["chunk"] for r in fine.collect()} == {10, 11} and fine.columns == rows.columns
    assert {r["chunk"]: r["problems"] for r in bad.collect()} == {12: ["another tenant's row", "scope or tenant unlike the document's"], 13: ["public chunks belong to public law"], 14: ["unknown document"], 15: ["scope or tenant unlike the document's"], 16: ["unknown scope", "scope or tenant unlike the document's"], 17: ["public rows have no tenant", "scope or tenant unlike the document's"]}
    fine, _ = TenantScope(Actor("u", "t", "customer")).appendable_chunks(rows, docs)
    assert {r["chunk"] for r in fine.collect()} == {11}
    fine, bad = TenantScope(Actor("u", "t", "admin"), public_writes=True).appendable_documents(docs)
    assert {r["doc"] for r in fine.collect()} == {1, 2} and bad.first()["problems"] == ["public documents are law"]


def test_rules_are_judged_in_one_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "nullif(id % 3, 0) as a").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rules = [Rule("small", F.col("id") < 10), Rule("one", F.col("a") == 1), Rule("never", F.lit(None).cast("boolean"))]
    watched, seen = rejects.counted(rejects.judged(df, rules), rules, "rules")
    assert watched._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 100, "valid": 60, "small": 10, "one": 33, "never": 0}
    fine, bad = rejects.split(df, rules)
    assert fine.count() == 60 and bad.where("id = 1").first()["problems"] == ["small", "one"]


def test_evidence_rules(spark):
    chunks = spark.createDataFrame([(1, "public", None, "c1", 1), (2, "firm", "t", "c2", 1), (3, "firm", "x", "c3", 2)], "id int, scope string, tenant_id string, content_sha256 string, doc int")
    docs = spark.createDataFrame([(1, "d1"), (2, None)], "doc int, content_sha256 string")
    rows = [(1, "t", "c1", "d1", 1), (2, "t", "c2", "d0", 1), (3, "t", "c3", None, 0), (2, "t", None, "d1", 1), (9, "t", "c1", "d1", 1)]
    met = rejects.with_facts(spark.createDataFrame(rows, "chunk_id int, tenant_id string, source_content_sha256 string, source_document_sha256 string, rank int"), chunks, {"chunk_id": "id"}, "chunk").withColumn("doc", F.col("chunk.doc"))
    met = rejects.with_facts(met, docs, {"doc": "doc"}, "document")
    got = rejects.judged(met, rejects.evidence_rules()).select("chunk_id", "source_content_sha256", "problems").collect()
    assert sorted((r[0], str(r[1]), *r[2]) for r in got) == [(1, "c1"), (2, "None", "chunk has changed"), (2, "c2", "document has changed"), (3, "c3", "not visible", "rank below 1"), (9, "c1", "no chunk")]


def test_two_writers_cannot_commit_one_version(spark, tmp_path, monkeypatch):
    ask = lambda *f: spark.createDataFrame([("t", x, f"sha-{x}", "{}") for x in f], "tenant_id string, filing string, sha256 string, config string")
    one, two = JobLog(spark, str(tmp_path / "log"), compact_every=2), JobLog(spark, str(tmp_path / "log"), compact_every=2)
    assert one.jobs().count() == 0
    got = one.create(ask("a", "a", "b"), "c1")
    assert sorted((r["filing"], r["created"]) for r in got.collect()) == [("a", False), ("a", True), ("b", True)]
    stale = two.version()
    one.create(ask("c"), "c2")
    monkeypatch.setattr(two, "version", lambda: stale)
    with pytest.raises(Conflict):
        two.create(ask("d"), "c3")
    monkeypatch.undo()
    assert {r["filing"] for r in two.jobs().collect()} == {"a", "b", "c"} and two._names("snapshots")
    again = two.create(ask("a", "d"), "c4").orderBy("filing").collect()
    assert [r["created"] for r in again] == [False, True] and again[0]["job"] == got.where("filing = 'a'").first()["job"]
    assert [r["refused"] for r in two.rerun(one.jobs().where("filing = 'a'").selectExpr("job", "tenant_id", "'n' as nonce"), "r").collect()] == ["the filing has an active job"]
