"""The registered queries and the SQL that they are checked against.

Names of tables stand for the engine's own: documents for knowledge documents
and filings, embeddings for chunk and query vectors, benchmark for query
texts, events for checkpoints, orders, customers and line items for jobs,
filings and findings, conversations for report details.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import evidence, grounding, jobs, pages, quality, retrieval, structure
from docloom.plans import knowledge, reviews
from docloom.plans.common import QUERIES, Query, knowledge_table, lines, new_folder, query, table
from docloom.plans.oracles import ORACLES



def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (ORACLES | knowledge.ORACLES | reviews.ORACLES).items() if k in QUERIES}


# retrieval


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the articles of their documents; documents of articles are
    there without a vector too."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    d = table(spark, sf_dir, "documents").select("doc_id", T.article_number(F.col("text")).alias("article")).where("article is not null")
    return e.join(d, F.col("vec_id") == F.col("doc_id"), "full").select(F.coalesce("vec_id", "doc_id").alias("item"), "vector", "article")


def _vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.col("embedding").cast("array<double>").alias("query_vector"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), T.article_references(F.col("text")).alias("articles")).join(vectors, F.col("query") == F.col("vec_id")).select("query", "query_vector", "articles", F.array("vec_id").alias("excluded"))
    return retrieval.vector_channel(rows, asked, dimension=64)


def _keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), T.word_tokens(F.col("text")).alias("tokens"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), T.search_terms(F.col("text")).alias("terms"))
    return retrieval.keyword_channel(rows, asked)


def _section_title(text: Column) -> Column:
    """The first heading of a text, else null."""
    return F.when(T.may_have_heading(text), F.get(F.filter(F.split(text, "\n"), lambda x: T.heading_level(x).isNotNull()), 0))


def _reference_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.split("text", "\n", 2)[0].alias("title"), _section_title(F.col("text")).alias("section_title"), T.article_number(F.col("text")).alias("article"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text", T.article_references(F.col("text")).alias("articles"))
    return retrieval.reference_channel(rows, asked)


@query
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_hits(spark, sf_dir).select("query", "item", "rank", F.round("score", 9).alias("score"))


@query
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword_hits(spark, sf_dir).select("query", "item", "rank", F.round("score", 6).alias("score"))


@query
def reference_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reference_hits(spark, sf_dir).select("query", "item", "rank", "score")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = (_vector_hits, _keyword_hits, _reference_hits)
    return retrieval.fused({c: f(spark, sf_dir) for c, f in zip(retrieval.CHANNELS, hits)})


@query
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query", "item", "rank", F.round("score", 9).alias("score"), "vector_rank", "keyword_rank", "reference_rank")


@query
def similarity_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.above_floor(_fused(spark, sf_dir), 0.5).select("query", "item", "rank")


@query
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), T.word_tokens(F.col("text")).alias("tokens"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), T.search_terms(F.col("text")).alias("terms"))
    hits = _fused(spark, sf_dir).select("query", "item", "score", "rank").join(docs, "item").join(asked, "query")
    best = retrieval.reranked(hits, retrieval.lexical_score(F.col("terms"), F.col("tokens")))
    return best.select("query", "item", "rank", F.round("score", 9).alias("score"))


@query
def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [f(spark, sf_dir).select(F.col("query").alias("clause"), F.lit(n).alias("query_no"), "rank", "item") for n, f in enumerate((_keyword_hits, _reference_hits))]
    return retrieval.merged_queries(parts[0].unionByName(parts[1])).select("clause", "item", "query_no", "place")


@query
def evidence_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), T.word_tokens(F.col("text")).alias("tokens"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("clause"), F.lit(0).alias("query_no"), "text")

    vectors = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    own, theirs = (vectors.select(F.col("vec_id").alias(k), F.col("v").alias(v)) for k, v in (("clause", "a"), ("item", "b")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)

    def retrieve(now: DataFrame) -> DataFrame:
        """Keyword hits, with the cosine of clause and item where both have vectors."""
        q = now.select(F.struct("clause", "query_no").alias("query"), T.search_terms(F.col("text")).alias("terms"))
        hits = retrieval.keyword_channel(rows, q, 5).select("query.clause", "query.query_no", "rank", "item").join(own, "clause", "left").join(theirs, "item", "left")
        return hits.select("clause", "query_no", "rank", "item", (dot("a", "b") / F.sqrt(dot("a", "a")) / F.sqrt(dot("b", "b"))).alias("vector_score"))

    def judge(found: DataFrame) -> DataFrame:
        held = found.groupBy("clause").agg(F.count("*").alias("n"), F.max("round").alias("turn"))
        more = asked.select("clause", F.array(F.array_join(F.slice(T.search_terms(F.col("text")), 1, 5), " ")).alias("next"))
        return held.join(more, "clause").select("clause", (F.col("n") >= 8).alias("enough"), "next")

    return evidence.collect(asked, retrieve, judge, floor=0.02).select("clause", "item", "round", "place")


# tenants, validity, documents


@query
def visible_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.visible(knowledge_table(spark, sf_dir), "src3").select("doc_id", "scope", "tenant_id")


@query
def valid_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.valid_on(knowledge_table(spark, sf_dir), F.lit("2024-06-01").cast("date")).select("doc_id", "effective_date", "expiry_date")


@query
def eligible_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits among the documents that a tenant may see, that are active and valid on a day."""
    state = F.when(F.col("n") % 11 == 0, "pending").otherwise("active")
    known = knowledge_table(spark, sf_dir).withColumn("n", F.length("text")).select(F.col("doc_id").alias("doc"), state.alias("status"), "scope", "tenant_id", "effective_date", "expiry_date")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("doc_id").alias("doc"), T.word_tokens(F.col("text")).alias("tokens"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), T.search_terms(F.col("text")).alias("terms"))
    hits = retrieval.keyword_channel(retrieval.eligible(rows, known, "src3", F.lit("2024-06-01").cast("date")), asked)
    return hits.select("query", "item", "rank", F.round("score", 6).alias("score"))


@query
def doc_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), "doc_id", "source")
    return quality.first_of(docs, ("sha256",), "doc_id")


@query
def doc_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), "doc_id", "source", "lang")
    stored = quality.first_of(docs, ("sha256",), "doc_id")
    return quality.conflicts(docs, stored, ["sha256"], ["source", "lang"]).select("doc_id", "sha256")


@query
def doc_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), "doc_id", "lang")
    return quality.new_rows(docs.where("lang <> 'en'"), docs.where("lang = 'en'"), ["sha256"], "doc_id").select("sha256", "doc_id")


@query
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.sources.documents import key_allowed, object_key

    rows = knowledge_table(spark, sf_dir).select("doc_id", object_key(F.col("tenant_id"), F.col("scope"), F.sha2("text", 256)).alias("key"))
    return rows.withColumn("allowed", key_allowed(F.col("key")))


# structure


@query
def section_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.section_path(lines(spark, sf_dir)).select("doc", "idx", F.sha2("path", 256).alias("path_sha256"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    named = F.when(F.length("text").between(60, 89), F.concat(F.lit("第"), F.length("text").cast("string"), F.lit("条 "), F.col("text"))).otherwise(F.col("text"))
    return rows.withColumn("text", named)


@query
def article_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.carried_article(_articles(spark, sf_dir)).select("doc", "idx", "article")


@query
def article_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.runs_of(lines(spark, sf_dir), F.length("text") >= 200)


@query
def split_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("level") == 1, "heading").when(F.length("text").between(60, 89), "article").otherwise("paragraph")
    rows = lines(spark, sf_dir).withColumn("kind", kind).select("doc", "idx", "kind", "text")
    return structure.clauses(rows).select("doc", "clause_id", "first", F.sha2("text", 256).alias("text_sha256"))


@query
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select(F.lit(0).alias("doc"), "text", F.lit(True).alias("in_margin"))
    return structure.repeated_margins(rows).select(F.sha2("norm", 256).alias("norm_sha256"), "n")


@query
def margin_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = 50 + 16 * (F.col("idx") % 46)
    rows = lines(spark, sf_dir).withColumn("in_margin", pages.in_margin(top, top + 12, F.lit(842)))
    return structure.without_margins(rows).groupBy("doc").agg(F.count("*").alias("n"))


@query
def chunk_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators of runs of five lines: pages of 46 lines, article and paragraph where known."""
    rows = _articles(spark, sf_dir).withColumn("article", T.article_number(F.col("text")))
    rows = rows.select("doc", "idx", F.floor(F.col("idx") / 5).alias("part"), (F.floor(F.col("idx") / 46) + 1).alias("page"), "article", F.when(F.col("level").isNull(), F.col("idx")).alias("paragraph"))
    return structure.merged_locators(rows, "doc", "part")


@query
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("idx"), "text")
    return structure.chunked(docs).select("doc", "part", "start", F.sha2("text", 256).alias("text_sha256"))


@query
def chunk_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("idx"), "text")
    parts = structure.chunked(docs).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("p"), F.max(F.length("text")).alias("longest"))
    return parts.select("doc", F.sha2(F.array_join("p.text", ""), 256).alias("text_sha256"), (F.col("longest") <= 600).alias("fits"))


@query
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = 600
    spans = structure.placed(lines(spark, sf_dir).select("doc", "idx", "text"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.length("text").alias("n"))
    chunks = docs.select("doc", "n", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / width))).alias("chunk")).select("doc", "chunk", (F.col("chunk") * width).alias("start"), F.least(F.col("n").cast("long"), (F.col("chunk") + 1) * width).alias("end"))
    return structure.overlapping(spans, chunks, width).select("doc", "idx", "chunk", "from", "to")


@query
def block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    sha = F.sha2("text", 256)
    return rows.select("doc", "idx", F.sha2(F.concat_ws("|", sha, F.lit("pdf"), F.concat(F.lit("page:"), F.floor(F.col("idx") / 46).cast("string")), F.concat(F.lit("paragraph:"), F.col("idx").cast("string")), F.lit("type:paragraph")), 256).alias("block_id"))


@query
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.deterministic_uuid(F.lit("document"), F.col("source"), F.sha2("text", 256)).alias("id"))


@query
def idempotency_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws(":", "source", F.sha2("text", 256), F.substring(F.sha2(F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('"}')), 256), 1, 8)).alias("key"))


# text functions


@query
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = T.search_terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(terms).cast("long").alias("n_terms"), F.sha2(F.array_join(terms, " "), 256).alias("terms_sha256"))


@query
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.word_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


_TEXTS = ["第十条 付款", "第 12 条之一 交付，见第十条和第五百零二条", "  第三章 总体要求", "第一部分 合同", "第二部分 规定如下", "总 则", "第二节", "第三章：付款", "- 12 -", "第 3 页", "3 / 10", "Page 7", "目录......3", "第一章 总则 1-3", "合同金额为12.5万元，比例 5%，自2024年1月2日起", "1. 甲方 2) 乙方 30 天", "普通文字"]


def _texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_TEXTS)), "id long, text string")


def _line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select((F.col("doc") * 100_000 + F.col("idx") + 1_000).alias("id"), "text")


@query
def article_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the fixed texts, of the lines of documents that have any, and
    (ids below 0) of these lines with articles named by their lengths."""
    n = F.length("text")
    raw = _line_texts(spark, sf_dir)
    made = raw.withColumn("id", -F.col("id")).withColumn("text", F.concat(F.when(n % 5 == 0, F.concat(F.lit(" 第"), n.cast("string"), F.lit("条之二 "))).otherwise(""), F.col("text"), F.when(n % 3 == 0, F.concat(F.lit("，见第"), n.cast("string"), F.lit("条和第 "), (n + 1).cast("string"), F.lit(" 条之二，第"), n.cast("string"), F.lit("条"))).otherwise("")))
    found = lambda rows: rows.select("id", F.array_join(T.article_references(F.col("text")), ",").alias("refs"), T.article_number(F.col("text")).alias("article"))
    return found(_texts(spark)).unionByName(found(raw.unionByName(made)).where("refs <> '' or article is not null"))


@query
def heading_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the fixed texts, of the lines of documents that are headings, and
    (ids below 0) of these lines made headings by their lengths."""
    n = F.length("text")
    made = F.when(n % 9 == 1, F.concat(F.lit(" 第"), n.cast("string"), F.lit("节"))).when(n % 9 == 2, F.concat(F.lit("第"), n.cast("string"), F.lit("部分 "), F.substring("text", 1, 50))).when(n % 9 == 3, "总　则").when(n % 9 == 4, F.concat(F.lit("第"), n.cast("string"), F.lit("章：x"))).when(n % 9 == 5, F.concat(F.lit("第"), n.cast("string"), F.lit("编 "), F.col("text"))).when(n % 9 == 6, "第二部分规定如下")
    found = lambda rows: rows.select("id", T.heading_level(F.col("text")).alias("level"))
    raw = _line_texts(spark, sf_dir)
    return found(_texts(spark)).unionByName(found(raw.unionByName(raw.select((-F.col("id")).alias("id"), made.alias("text")))).where("level is not null"))


@query
def page_number_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark).unionByName(lines(spark, sf_dir).select((F.col("doc") * 100_000 + F.col("idx") + 1_000).alias("id"), "text"))
    return rows.where(T.is_page_number(F.col("text"))).select("id", "text")


@query
def toc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark).unionByName(lines(spark, sf_dir).select((F.col("doc") * 100_000 + F.col("idx") + 1_000).alias("id"), "text"))
    return rows.where(T.is_toc_entry(F.col("text"))).select("id")


@query
def cn_numeral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the fixed numerals, of those in documents, and of the ids of documents written by place and by units."""
    rows = spark.createDataFrame([("二〇二四",), ("五百零二",), ("十二",), ("一万二千三百",), ("三亿",), ("一百零五万",), ("两",), ("x",)], "text string")
    digits = "〇一二三四五六七八九"
    n = F.col("doc_id") % 100_000
    place = lambda k: F.substring(F.lit(digits), (F.floor(n / 10**k) % 10 + 1).cast("int"), F.lit(1))
    unit = lambda k, u: F.when(F.floor(n / 10**k) % 10 > 0, F.concat(place(k), F.lit(u))).otherwise("")
    docs = table(spark, sf_dir, "documents")
    by_place = docs.select(F.translate(F.col("doc_id").cast("string"), "0123456789", digits).alias("text"))
    by_units = docs.where(n > 0).select(F.concat(unit(4, "万"), unit(3, "千"), unit(2, "百"), unit(1, "十"), unit(0, "")).alias("text"))
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit(T.NUMERAL_RUN), F.lit(0))).alias("text"))
    return rows.unionByName(runs).unionByName(by_place).unionByName(by_units).distinct().select("text", T.numeral_value(F.col("text")).alias("value"))


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings, whose evidence says what they say, or less."""
    n = F.col("event_id")
    said = lambda c: c.cast("string")
    text = F.concat(F.lit("自2024年"), said(n % 12 + 1), F.lit("月3日起，比例 "), said(n % 50 + 10), F.lit("%，共 "), said(n), F.lit(".5 元，第 7 项"))
    evidence = F.concat(F.lit("2024 年"), said(n % 12 + 1), F.lit("月3日，"), F.when(n % 3 > 0, F.concat(said(n % 50 + 10), F.lit("%"))).otherwise(""), F.lit("，金额"), F.when(n % 4 > 0, said(n)).otherwise(F.concat(F.lit("1"), said(n))), F.lit(".5元，五百零二"))
    return table(spark, sf_dir, "events").select(n.alias("id"), F.concat(text, F.when(n % 5 == 0, "，502 天").otherwise("")).alias("text"), evidence.alias("evidence"), F.when(n % 6 == 0, F.array(F.lit("a"), F.lit("x"))).otherwise(F.array(F.lit("a"))).alias("evidence_ids"), F.array(F.lit("a"), F.lit("b")).alias("allowed_ids"))


@query
def grounding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.checked(_stated(spark, sf_dir)).select("id", "grounded", F.array_join("unsupported", ",").alias("unsupported"), F.array_join("unknown", ",").alias("unknown"))


def _turns_checked(rows: DataFrame) -> DataFrame:
    ids = F.array(F.col("conv_id").cast("string"))
    rows = rows.withColumns({"evidence_ids": ids, "allowed_ids": F.when(F.col("evidence").isNull(), F.array().cast("array<string>")).otherwise(ids)})
    return grounding.checked(rows).select("conv_id", "turn", "grounded", F.array_join("unsupported", ",").alias("unsupported"))


@query
def grounding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations against the document of the conversation's id."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("evidence"))
    return _turns_checked(turns.join(docs, "conv_id", "left"))


@query
def grounding_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, with their numbers, against the document of the
    conversation's id, with its number of characters."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), (F.col("turn") + 10).cast("string"), F.lit(" 项")).alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.concat("text", F.lit(" "), (F.col("n_chars") % 8 + 10).cast("string"), F.lit(" 项")).alias("evidence"))
    return _turns_checked(turns.join(docs, "conv_id", "left"))


@query
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("turn")), lambda t: t.cast("string")).alias("ids"))
    return c.select("conv_id", F.array_join(jobs.resolved(F.array(F.lit("E1"), F.lit("E2"), F.lit("E9"), F.lit("x")), F.col("ids")), ",").alias("resolved"))


@query
def embedding_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", quality.finite(F.col("embedding"), 64).alias("usable"))


# jobs


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("purchase", "signup"), "complete").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "queued").otherwise("insufficient")
    return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("clause"), "ts", status.alias("status"), F.col("event_id").alias("place"), F.when(status == "failed", F.col("event_type")).alias("reason"))


@query
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.progress(_checkpoints(spark, sf_dir), "job")


@query
def job_final_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.final_status(_checkpoints(spark, sf_dir), "job")


@query
def jobs_finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of customers as their checkpoints end them; those without any are complete."""
    c = table(spark, sf_dir, "customer")
    status = F.when(F.col("c_custkey") % 7 == 0, "failed").otherwise("running")
    rows = c.select(F.col("c_custkey").alias("job"), status.alias("status"), F.when(status == "failed", "early").alias("failure_reason"))
    return jobs.finalized(rows, _checkpoints(spark, sf_dir), "job")


@query
def pending_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _checkpoints(spark, sf_dir)
    return jobs.pending(c.select("job", "clause"), c, "job", "clause")


@query
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = jobs.latest(table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id", F.col("ts").alias("updated_at"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status")), ("job",), "updated_at", "event_id")
    return jobs.stale(last, F.lit("2024-02-01 00:00:00").cast("timestamp")).select("job", "event_id")


@query
def failed_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "running").otherwise("queued").alias("status"), F.lit(None).cast("string").alias("failure_reason"))
    return jobs.failed(rows, "retries exhausted").groupBy("status", "failure_reason").agg(F.count("*").alias("n"))


@query
def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest job of each filing of known users, the last hundred."""
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    last = jobs.latest(o, ("o_custkey",), "o_orderdate", "o_orderkey")
    return last.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_custkey", "o_orderkey", "o_orderstatus")


@query
def job_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "o_orderstatus", "c_name")


@query
def finding_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = jobs.nested(o, li, ["l_orderkey"], "l_linenumber", "l_partkey")
    return rows.select("l_orderkey", F.array_join(F.transform("items", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"), F.size("items").cast("long").alias("n"))


@query
def review_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag", "l_quantity")
    parents = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name", "o_orderstatus")
    rows = jobs.nested(parents, li, ["o_orderkey"], "l_linenumber", "l_returnflag")
    return rows.select("o_orderkey", "c_name", "o_orderstatus", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_returnflag"])), ",").alias("findings"))


@query
def evidence_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    findings = c.groupBy(F.col("conv_id").alias("finding")).agg(F.transform(F.sort_array(F.collect_list("turn")), lambda t: t * 3).alias("evidence_ids"))
    items = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("item"), "source")
    return jobs.evidence_snapshot(findings, items)


@query
def clause_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("clause-"), F.col("turn").cast("string")).alias("clause_id"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(jobs.clause_order()[0].alias("n"), "clause_id"))).alias("c")).select("conv_id", F.array_join("c.clause_id", ",").alias("clauses"))


@query
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report lines with their pages, 46 lines each."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return c.select("conv_id", n.alias("line"), (F.floor(n / 46) + 1).alias("page"), F.sha2(F.concat(F.lit("《"), F.col("role"), F.lit("》"), F.col("text")), 256).alias("text_sha256"))


@query
def redact_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of secret keys of flat JSON objects are blotted out."""
    secret = lambda k: F.lower(k).isin("api_key", "authorization", "password", "token", "k")
    props = F.from_json("props", "map<string,string>")
    shown = F.transform_values(props, lambda k, v: F.when(secret(k), F.lit("[REDACTED]")).otherwise(v))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries(shown), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return table(spark, sf_dir, "events").select("event_id", flat.alias("payload"))


@query
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = knowledge_table(spark, sf_dir)
    t = lambda n: table(spark, sf_dir, n)
    rules = {
        "public documents have no tenant": (k, (F.col("scope") == "public") != F.col("tenant_id").isNull()),
        "expiry is not before effect": (k, F.col("expiry_date") < F.col("effective_date")),
        "a document's content is there once": (quality.duplicates(t("documents"), "text"), F.lit(True)),
        "line items have orders": (quality.orphans(t("lineitem"), t("orders").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"]), F.lit(True)),
        "orders have customers": (quality.orphans(t("orders"), t("customer").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]), F.lit(True)),
        "discounts are shares": (t("lineitem"), ~F.col("l_discount").between(0, 1)),
        "line numbers are there once": (quality.duplicates(t("lineitem"), "l_orderkey", "l_linenumber"), F.lit(True)),
    }
    return quality.violations(rules)


# streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _folders(spark: SparkSession) -> tuple[str, str]:
    at = new_folder(spark, "stream")
    return f"{at}/table", f"{at}/checkpoint"


@query
def stream_checkpoint_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.streaming import checkpoints

    target, checkpoint = _folders(spark)
    rows = _stream(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    checkpoints.latest_state(rows, ["user_id"], ["ts", "event_id"], target, checkpoint)
    return checkpoints.current(spark, target, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query
def stream_dedupe_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.streaming import checkpoints

    target, checkpoint = _folders(spark)
    rows = _stream(spark, sf_dir).select("user_id", "event_type", "event_id")
    checkpoints.ingest_once(rows, ["user_id", "event_type"], ["event_id"], target, checkpoint)
    return spark.read.parquet(target).select("user_id", "event_type", "event_id")
