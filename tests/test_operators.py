"""Hand-made cases of single operators."""

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import evidence, jobs, quality, retrieval, structure
from docloom.sources import documents


def test_child_parts_pack_lines_and_cut_long_ones():
    assert structure.child_parts("", 5) == []
    assert structure.child_parts("ab\ncd\nefg", 5) == ["ab\n", "cd\n", "efg"]
    assert structure.child_parts("abcdefghijkl\nm", 5) == ["abcde", "fghij", "kl\nm"]
    for text in ("a\n\n\nb", "x" * 23, "ab\r\ncd\n", "\n" * 9):
        assert "".join(structure.child_parts(text, 4)) == text
        assert all(len(p) <= 4 for p in structure.child_parts(text, 4))


def test_section_path_ends_deeper_headings(spark):
    rows = [("d", 0, 1, "A"), ("d", 1, 2, "B"), ("d", 2, None, "x"), ("d", 3, 1, "C"), ("d", 4, None, "y"), ("d", 5, 3, "D"), ("d", 6, 2, "E")]
    df = spark.createDataFrame(rows, "doc string, idx int, level int, text string")
    assert [r.path for r in structure.section_path(df).orderBy("idx").collect()] == ["A", "A > B", "A > B", "C", "C", "C > D", "C > E"]


def test_clauses_by_article_and_by_number(spark):
    rows = [("a", 0, "paragraph", "序"), ("a", 1, "article", "第一条 甲"), ("a", 2, "paragraph", "续"), ("a", 3, "heading", "第二章"), ("a", 4, "article", "第二条 乙")]
    rows += [("n", 0, "paragraph", "公告"), ("n", 1, "paragraph", "一、基本情况"), ("n", 2, "paragraph", "1、付款：三日"), ("n", 3, "paragraph", "内"), ("n", 4, "paragraph", "- 3 -"), ("n", 5, "paragraph", "特此公告。")]
    rows += [("p", 0, "paragraph", "only"), ("p", 1, "paragraph", " plain ")]
    got = {(r.doc, r.clause_id): r.text for r in structure.clauses(spark.createDataFrame(rows, "doc string, idx int, kind string, text string")).collect()}
    assert got == {("a", "clause-1"): "第一条 甲\n续", ("a", "clause-2"): "第二条 乙", ("n", "clause-1"): "1、付款：三日\n内", ("p", "clause-1"): "only", ("p", "clause-2"): " plain "}


def test_runs_and_page_numbers_in_articles(spark):
    """A dropped run of article headings ends the clause before it; page numbers are passed over."""
    texts = [("article", "第一条 甲"), ("paragraph", "甲正文"), ("article", "第二条 目录"), ("article", "第三条 目录"), ("paragraph", "前言散文"), ("article", "第四条 乙"), ("paragraph", "- 12 -"), ("paragraph", "乙正文")]
    rows = [("d", i, k, t) for i, (k, t) in enumerate(texts)]
    got = structure.clauses(spark.createDataFrame(rows, "doc string, idx int, kind string, text string")).orderBy("first").collect()
    assert [r.text for r in got] == ["第一条 甲\n甲正文", "第四条 乙\n乙正文"]


def test_titles_are_found_by_grams(spark):
    titles = [(1, "a law of x"), (2, "law"), (3, "a1b2"), (4, "axb"), (5, "ümlaut"), (6, ""), (7, "zz"), (8, "法规汇编"), (9, "lawyer")]
    terms = ["law", "a_b", "ml", "法规", "__", "ü", "zzz", "_w"]
    rows, asked = spark.createDataFrame(titles, "item int, title string"), spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r.term, r.item) for r in retrieval.titles_with(rows, asked, 20).collect()}
    held = lambda t, x: any(all(c in ("_", d) for c, d in zip(t, x[i:], strict=False)) for i in range(len(x) - len(t) + 1))
    assert got == {(t, i) for t in terms for i, x in titles if held(t, x)}
    assert {r.item for r in retrieval.titles_with(rows, asked, 2).where("term = 'law'").collect()} == {1, 2}


def test_contents_go(spark):
    rows = [("d", 0, 1, "封面"), ("d", 1, 2, "目 录"), ("d", 2, 2, "第一章......1"), ("d", 3, 3, "第二章......9"), ("d", 4, 3, "正文"), ("d", 5, 3, "又......2"), ("e", 0, 1, "x")]
    got = structure.without_contents(spark.createDataFrame(rows, "doc string, idx int, page int, text string"))
    assert sorted((r.doc, r.idx) for r in got.collect()) == [("d", 4), ("d", 5), ("e", 0)]


def test_channels_take_nulls_and_ties(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", None)], "item string, vector array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0], ["b"])], "query string, query_vector array<double>, excluded array<string>")
    got = retrieval.vector_channel(rows, asked, 5).orderBy("rank").collect()
    assert [(r.item, r.score) for r in got] == [("a", 1.0)]  # no vector, no article: no hit


def test_reference_terms_are_patterns(spark):
    rows = spark.createDataFrame([(1, "Tax aXb law", None), (2, "other", "第 3 条"), (3, None, None)], "item int, title string, article string")
    asked = spark.createDataFrame([("q", "a_b", ["第3条"])], "query string, text string, articles array<string>")
    assert {r.item: r.score for r in retrieval.reference_channel(rows, asked).collect()} == {1: 1.0, 2: 2.0}


def test_named_articles_come_first(spark):
    rows = [("a", [1.0, 0.0], None), ("b", [0.0, 1.0], "第 三 条"), ("c", None, "第三条"), ("d", [0.6, 0.8], "第三条"), ("e", None, "第四条"), ("f", [1.0], None), ("g", [1.0], "第三条"), ("x", [1.0, 0.0], "第三条")]
    df = spark.createDataFrame(rows, "item string, vector array<double>, article string")
    asked = spark.createDataFrame([("q", [1.0, 0.0], ["第三条"], ["x"])], "query string, query_vector array<double>, articles array<string>, excluded array<string>")
    hits = lambda n: [(r.item, r.score) for r in retrieval.vector_channel(df, asked, n, dimension=2).orderBy("rank").collect()]
    assert hits(9) == [("d", 2.0), ("b", 2.0), ("c", 2.0), ("g", 2.0), ("a", 1.0)]
    assert hits(2) == [("d", 2.0), ("b", 2.0)]


def test_section_titles_are_titles(spark):
    rows = spark.createDataFrame([(1, None, "Tax law", None), (2, "tax", None, None), (3, "x", "y", None)], "item int, title string, section_title string, article string")
    asked = spark.createDataFrame([("q", "tax", [])], "query string, text string, articles array<string>")
    assert {r.item: r.score for r in retrieval.reference_channel(rows, asked).collect()} == {1: 1.0, 2: 1.0}


def test_queries_find_articles_without_vectors(spark, tmp_path):
    from docloom.plans import registry

    at = lambda name: str(tmp_path / f"{name}.parquet")
    spark.createDataFrame([(i, [1.0] + [float(i)] * 63) for i in range(1, 31)] + [(40, None)], "vec_id long, embedding array<float>").write.parquet(at("embeddings"))
    spark.createDataFrame([(30, "第七条 甲"), (40, "第七条 乙"), (50, "第七条 丙"), (60, "第八条 丁"), (2, "plain")], "doc_id long, text string").write.parquet(at("documents"))
    spark.createDataFrame([(1, "见第 七 条")], "item_id long, text string").write.parquet(at("benchmark"))
    got = registry.queries()["vector_topk"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r.item, r.score) for r in got][:3] == [(30, 2.0), (40, 2.0), (50, 2.0)] and len(got) == 20 and 60 not in {r.item for r in got}


def test_text_queries_read_tables(spark, tmp_path):
    from docloom.plans import registry

    at = lambda name: str(tmp_path / f"{name}.parquet")
    text = "第二章 付款\n第八条 见第 九 条\n共九千零九元，利率 30%\nplain"
    spark.createDataFrame([(1, text), (2, "plain 7"), (3, None)], "doc_id long, text string").write.parquet(at("documents"))
    spark.createDataFrame([(1, 0, "付9009元"), (1, 1, "利率 31%"), (5, 0, "无"), (3, 0, "共 42 天"), (2, 0, None)], "conv_id long, turn long, text string").write.parquet(at("conversations"))
    run = lambda name: {tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    assert {r for r in run("article_refs") if r[0] >= 1_000} == {(101_001, "第八条,第九条", "第八条")}
    assert {r for r in run("heading_level") if r[0] >= 1_000} == {(101_000, 2)}
    assert {("二", 2), ("八", 8), ("九", 9), ("九千零九", 9009), ("三亿", 300_000_000)} <= run("cn_numeral")
    assert run("grounding_texts") == {(1, 0, True, ""), (1, 1, False, "31%,31"), (5, 0, False, ""), (3, 0, False, "42"), (2, 0, True, "")}


def test_evidence_rounds_skip_what_was_seen(spark):
    asked = spark.createDataFrame([("c", 0, "t")], "clause string, query_no int, text string")

    def retrieve(now):
        return now.select("clause", "query_no", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank")).select("clause", "query_no", "rank", (F.col("rank") * 10).alias("item"), F.when(F.col("rank") == 3, 0.1).alias("vector_score"))

    def judge(found):
        return found.groupBy("clause").agg(F.lit(False).alias("enough")).withColumn("next", F.array(F.lit("more")))

    got = evidence.collect(asked, retrieve, judge)
    assert sorted((r.item, r["round"], r.place) for r in got.collect()) == [(10, 1, 1), (20, 1, 2)]


def test_job_states(spark):
    c = spark.createDataFrame([(1, "failed", 2, "b"), (1, "failed", 1, "a"), (2, "complete", 1, None), (3, "complete", 1, None), (3, "failed", 2, "x")], "job int, status string, place int, reason string")
    assert {r.job: (r.status, r.reason) for r in jobs.final_status(c, "job").collect()} == {1: ("failed", "a"), 2: ("complete", None), 3: ("partial", None)}
    j = spark.createDataFrame([(1, "running", None), (2, "complete", None)], "id int, status string, failure_reason string")
    assert {r.id: r.status for r in jobs.failed(j, "x").collect()} == {1: "failed", 2: "complete"}


def test_appends_are_idempotent(spark):
    rows = spark.createDataFrame([("k", 2), ("k", 1), ("old", 3)], "key string, n int")
    stored = spark.createDataFrame([("old", 9)], "key string, n int")
    assert [tuple(r) for r in quality.new_rows(rows, stored, ["key"], "n").collect()] == [("k", 1)]
    assert [tuple(r) for r in quality.conflicts(rows, stored, ["key"], ["n"]).collect()] == [("old", 3)]


def test_keys(spark):
    df = spark.createDataFrame([("public/law/x",), ("tenants/t/firm/x",), ("tenants/t",), ("public/../x",), ("/public/x",)], "k string")
    assert [r.ok for r in df.select(documents.key_allowed(F.col("k")).alias("ok")).collect()] == [True, True, False, False, False]


def test_uuid_is_version_8(spark):
    got = spark.range(1).select(T.deterministic_uuid(F.lit("a"), F.lit('q"/é')).alias("u")).first().u
    import hashlib

    h = hashlib.sha256('["a","q\\"/é"]'.encode()).hexdigest()
    assert got == f"{h[:8]}-{h[8:12]}-8{h[13:16]}-{(int(h[16], 16) & 3) | 8:x}{h[17:20]}-{h[20:32]}"


def test_eligible_chunks(spark):
    docs = [("a", "active", "public", None, None, None), ("b", "pending", "public", None, None, None), ("c", "active", "firm", "t", "2024-01-01", "2024-12-31"), ("d", "active", "firm", "u", None, None), ("e", "active", "public", None, "2025-01-01", None), ("f", None, "public", None, None, None)]
    known = spark.createDataFrame(docs, "doc string, status string, scope string, tenant_id string, f string, t string").selectExpr("doc", "status", "scope", "tenant_id", "to_date(f) AS effective_date", "to_date(t) AS expiry_date")
    chunks = spark.createDataFrame([(i, d) for i, d in enumerate("aabcdefx")] + [(9, None)], "item int, doc string")
    got = retrieval.eligible(chunks, known, "t", F.lit("2024-06-01").cast("date"))
    assert sorted(r.item for r in got.collect()) == [0, 1, 3]


def test_locators_are_merged(spark):
    rows = [("d", 1, 2, None, 7), ("d", 0, 1, None, None), ("d", 2, 2, "第三条", 8), ("e", 0, None, None, None)]
    got = structure.merged_locators(spark.createDataFrame(rows, "doc string, idx int, page int, article string, paragraph int"), "doc")
    assert sorted(tuple(r) for r in got.collect() if r.doc == "d") == [("d", 1, 2, "第三条", 7)]
    assert [tuple(r) for r in got.where("doc = 'e'").collect()] == [("e", None, None, None, None)]


def test_jobs_end_by_their_checkpoints(spark):
    rows = spark.createDataFrame([(1, "running", None), (2, "running", None), (3, "failed", "x"), (4, "queued", None)], "job int, status string, failure_reason string")
    points = spark.createDataFrame([(1, "complete", 0, None), (1, "failed", 1, "r"), (2, "failed", 1, "late"), (2, "failed", 0, "first"), (3, "complete", 0, None)], "job int, status string, place int, reason string")
    got = {r.job: (r.status, r.failure_reason) for r in jobs.finalized(rows, points, "job").collect()}
    assert got == {1: ("partial", None), 2: ("failed", "first"), 3: ("failed", "x"), 4: ("complete", None)}
