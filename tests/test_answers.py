"""Answers of models, redaction, batch models, reranking checks and the revision loop."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import answers, models, revision
from docloom.plans import reviews


def told(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, answer string")
    return f(rows, "answer").orderBy("i").collect()


def test_decisions(spark):
    fine = [
        ('{"sufficient": true, "usable_evidence_ids": [" a ", "", null, 3, true]}', (True, [], [], ["a", "None", "3", "True"], {})),
        ('  {"sufficient": "no", "missing_points": " x ", "follow_up_queries": null, "rejected_evidence": ["a", "", "a"]} ', (False, ["x"], [], [], {"a": answers.NO_REASON})),
        ('{"sufficient": 0, "rejected_evidence": {"k": " why "}}', (False, [], [], [], {"k": "why"})),
    ]
    bad = [
        (None, ["not JSON"]),
        ("", ["not JSON"]),
        ('{"sufficient": tru', ["not JSON"]),
        ("[1]", ["not an object"]),
        ("null", ["not an object"]),
        ("{}", ["sufficient is no truth value"]),
        ('{"sufficient": 2}', ["sufficient is no truth value"]),
        ('{"sufficient": true}', ["sufficient evidence needs usable evidence"]),
        ('{"sufficient": false, "x": 1}', ["unknown field"]),
        ('{"sufficient": false, "missing_points": 3, "rejected_evidence": 4}', ["missing_points is no list", "rejected_evidence is no map or list"]),
        ('{"sufficient": false, "rejected_evidence": {"a": 1}}', ["rejected_evidence is no map or list"]),
        ('{"sufficient": false, "rejected_evidence": {"a": "  "}}', ["rejected evidence needs a reason"]),
    ]
    got = told(spark, answers.decisions, *[t for t, _ in fine + bad])
    for r, (_, want) in zip(got, fine):
        assert (r["sufficient"], r["missing_points"], r["follow_up_queries"], r["usable_evidence_ids"], r["rejected_evidence"]) == want and r["problems"] == []
    for r, (_, want) in zip(got[len(fine) :], bad):
        assert r["problems"] == want and r["sufficient"] is None


def test_expansions_reviews_and_findings(spark):
    got = told(spark, answers.expansions, json.dumps({"queries": [" a ", "a", "", "x" * 513, *[f"q{i}" for i in range(9)]]}), '{"queries": []}', "{}", '{"queries": "one"}')
    assert [r["queries"] for r in got] == [["a", *[f"q{i}" for i in range(7)]], None, None, None]
    assert [r["problems"] for r in got[1:]] == [["no queries"], ["no queries"], ["queries is no list"]]
    got = told(spark, answers.reviews, '{"decision": " pass "}', '{"decision": "revise", "evidence_gap": true, "feedback": " more ", "unsupported_fields": ["a"]}', '{"decision": "maybe", "feedback": 3}')
    assert [tuple(r)[2:6] for r in got] == [("pass", [], False, ""), ("revise", ["a"], True, "more"), (None,) * 4] and got[2]["problems"] == ["unknown decision", "feedback is no text"]
    finding = dict.fromkeys(answers.FINDING, " t ") | {"risk_level": "high", "evidence_ids": ["e"]}
    texts = [json.dumps({"findings": f}) for f in ([finding], [finding | {"risk_level": "odd"}], [finding | {"evidence_ids": []}], [finding | {"title": 3}])]
    got = told(spark, answers.findings, *texts, "{}")
    assert got[0]["findings"][0]["title"] == "t" and got[0]["findings"][0]["evidence_ids"] == ["e"] and got[4]["findings"] == [] and got[4]["problems"] == []
    assert [r["problems"] for r in got[1:4]] == [["unknown risk"], ["a finding without evidence"], ["a finding lacks a text"]]


def plain_redact(v):
    if isinstance(v, dict):
        return {k: answers.REDACTED if k.lower() in answers.SECRET_KEYS else plain_redact(x) for k, x in v.items()}
    return [plain_redact(x) for x in v] if isinstance(v, list) else v


def test_redaction_at_any_depth(spark):
    deep = {"token": 1}
    for i in range(12):
        deep = {"a": [deep, i]} if i % 2 else {"Password": deep, "k": [deep, []]}
    values = [{"a": 1}, {"API_KEY": {"x": [1]}, "b": [{"token": "t"}, [{"authorization": None}, 2.5]]}, deep, [{"token": 1}, "token"], "token", {}, [], {'q"uote\n': {"password": 3}, "é": "ü\\"}, {"k": "\"token\": 1"}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] * 2 + [(97, '{"t\\u006fken": 5, "x": [0]}'), (98, None), (99, "{")]
    got = answers.redacted(spark.createDataFrame(rows, "i int, payload string"), "payload").collect()
    assert len(got) == len(rows)
    for r in got:
        want = {97: {"token": answers.REDACTED, "x": [0]}, 98: None, 99: None}.get(r["i"], plain_redact(values[r["i"]]) if r["i"] < 90 else None)
        assert (None if r["payload"] is None else json.loads(r["payload"])) == want


def test_models_fail_by_batches(spark):
    class Odd:
        """Fails on some batches, in each way there is."""

        def encode(self, texts):
            if "raise" in texts:
                raise RuntimeError("lost")
            if "few" in texts:
                return np.zeros((len(texts) - 1, 2))
            return [np.array([1.0, np.nan]) if t == "nan" else np.zeros(3) if t == "long" else np.array([1.0, len(t)]) for t in texts]

        def predict(self, pairs):
            if any(t == "raise" for _, t in pairs):
                raise RuntimeError("lost")
            return [float("inf") if t == "inf" else len(q + t) for q, t in pairs][: len(pairs) - any(t == "few" for _, t in pairs)]

    texts = ["a", "bb", "raise", "c", "few", "d", "nan", "long", None, "e"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = [r[0] for r in rows.select(models.embedding(Odd, 2, batch=2)("t")).collect()]
    assert [(r["vector"], r["problem"]) for r in got] == [([1.0, 1.0], None), ([1.0, 2.0], None), (None, "RuntimeError: lost"), (None, "RuntimeError: lost"), (None, "1 vectors for 2 texts"), (None, "1 vectors for 2 texts"), (None, "not finite"), (None, "dimension 3, not 2"), (None, None), ([1.0, 1.0], None)]
    pairs = spark.createDataFrame([("q", "a"), (None, "inf"), ("q", "raise"), ("q", None), ("q", "few"), ("q", "x")], "q string, t string").coalesce(1)
    got = [r[0] for r in pairs.select(models.scoring(Odd, batch=2)("q", "t")).collect()]
    assert [(r["score"], r["problem"]) for r in got] == [(2.0, None), (None, "not finite"), (None, "RuntimeError: lost"), (None, "RuntimeError: lost"), (None, "1 scores for 2 pairs"), (None, "1 scores for 2 pairs")]
    with pytest.raises(ValueError, match="positive"):
        models.embedding(Odd, 0)


def test_letters_of_odd_texts_match_sql(spark, tmp_path):
    texts = [None, "", " \n\t", "12 34", "é汉字", "abc z", "A" * 3 + "e" * 4, "a\u0130", "\u0130", "a\u212ae", "\u212a", "a\x00e", "e" + "b" * 31, "\uff21 \U0001d41a ſ ß e", *"aezAEZ"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(f"select doc_id, problem, v0, v4, v25 from ({reviews.ORACLES['model_embeddings']}) order by doc_id").fetchall()
    got = reviews.model_embeddings(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [repr(tuple(r)) for r in got] == [repr(r) for r in want] and sum("nan" in repr(r) for r in want) == 4
    # of all characters beyond ASCII, those whose lower case has a letter count as it
    others = [c for c in map(chr, range(128, 0x110000)) if any("a" <= x <= "z" for x in c.lower())]
    model = models.LetterModel()
    assert others == ["\u0130", "\u212a"] and (model.counts(others) == model.counts(["i", "k"])).all()


def test_reranking_is_checked(spark):
    given = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c"), ("q", 4, "d"), ("q", 4, "e"), ("q", 5, "f")], "query string, item int, sha string")
    back = spark.createDataFrame([("q", 1, "a", 0.5), ("q", 1, "a", 0.7), ("q", 2, "x", 0.9), ("q", 3, "c", float("nan")), ("q", 4, "d", 0.1), ("q", 9, "z", 0.1), ("q", 5, "f", 0.7)], "query string, item int, sha string, score double")
    ranked, bad = models.checked_reranking(given, back, ["sha"], limit=5)
    assert [tuple(r) for r in ranked.orderBy("rank").collect()] == [("q", 1, 0.7, 1, "a"), ("q", 5, 0.7, 2, "f")]
    assert {(r["item"], r["problem"]) for r in bad.collect()} == {(2, "provenance changed"), (3, "score not finite"), (4, "inconsistent candidates"), (9, "unknown item")}


def test_revision_settles_every_clause_and_resumes(spark, tmp_path):
    asked = spark.createDataFrame([(i,) for i in range(8)], "clause long")
    evidence = spark.createDataFrame([(i, "e", f"it is {100 + i}") for i in range(8)], "clause long, item string, text string")
    calls = []

    def draft(rows, says):
        return rows.select("clause", F.array(F.struct(says.alias("text"), F.array(F.when(F.col("clause") == 1, "x").otherwise("e")).alias("evidence_ids"))).alias("findings"))

    def generate(rows, _):
        calls.append("generate")
        return draft(rows.where("clause <> 2"), F.when(F.col("clause") == 3, F.lit("value 777")).otherwise(F.concat(F.lit("value "), (F.col("clause") + 100).cast("string"))))

    def revise(rows, _):
        calls.append("revise")
        return draft(rows, F.concat("feedback"))

    def review(rows, _):
        calls.append("review")
        return rows.select("clause", F.when(F.col("clause") == 0, "pass").when(F.col("clause") == 4, "reject").when((F.col("clause") == 5) & (F.col("findings")[0]["text"] == "again"), "pass").otherwise("revise").alias("decision"), (F.col("clause") == 6).alias("evidence_gap"), F.lit("again").alias("feedback"))

    want = {0: ("complete", None, 0, 1), 1: ("failed", "unknown evidence: x", 0, 0), 2: ("failed", "no draft", 0, 0), 3: ("failed", "unsupported value: 777", 0, 0), 4: ("review_failed", None, 0, 0), 5: ("complete", None, 1, 1), 6: ("needs_retrieval", None, 0, 0), 7: ("review_failed", None, 2, 0)}
    for _ in range(2):
        out = revision.settle(asked, evidence, generate, revise, review, str(tmp_path / "run"))
        assert {r["clause"]: (r["status"], r["reason"], r["round"], len(r["findings"])) for r in out.collect()} == want
    with pytest.raises(ValueError, match="negative"):
        revision.settle(asked, evidence, generate, revise, review, str(tmp_path / "run"), -1)
