"""Queries over stored knowledge: the keyword index, chunk plans, tenants' views,
rejects, ordered rules and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunks, pages, rejects, retrieval, rulebook, structure
from docloom.operators.postings import KeywordIndex, search_tokens
from docloom.operators.tenants import Actor, TenantScope
from docloom.plans.common import knowledge_table, lines, new_folder, query, table
from docloom.plans.oracles import KEYWORD, KNOWLEDGE, TERMS

ORACLES: dict[str, str] = {}


def _indexed(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """Documents in three batches: those of one half, all again, and half of
    them once more; the index is as if each had come once."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "lang", T.word_tokens(F.col("text")).alias("tokens"))
    index = KeywordIndex(spark, new_folder(spark, "keyword-index"))
    index.ingest(docs.where("lang = 'en'"), "english")
    index.ingest(docs, "all")
    index.ingest(docs, "all")
    return index


@query
def indexed_keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits from the stored index."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), T.search_terms(F.col("text")).alias("terms"))
    return _indexed(spark, sf_dir).search(asked).select("query", "item", "rank", F.round("score", 6).alias("score"))


ORACLES["indexed_keyword_topk"] = f"WITH {KEYWORD} SELECT query, item, rank::INTEGER AS rank, round(score, 6) AS score FROM keyword"


@query
def keyword_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in force after an index of texts alone is filled again with the
    words of source and section, and compacted."""
    docs = table(spark, sf_dir, "documents")
    index = KeywordIndex(spark, new_folder(spark, "keyword-backfill"))
    index.ingest(docs.select(F.col("doc_id").alias("item"), T.word_tokens(F.col("text")).alias("tokens")), "first")
    none = F.lit(None).cast("string")
    tokens = search_tokens(F.col("text"), F.split("text", "\n")[0], F.col("source"), none, F.col("lang"), F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("Art "), F.col("n_chars").cast("string"))))
    index.ingest(docs.select(F.col("doc_id").alias("item"), tokens.alias("tokens")), "backfill", replace=True)
    index.compact("compacted")
    return index.postings().groupBy("token").agg(F.count("*").alias("n_items"), F.sum("n").alias("n"))


ORACLES["keyword_backfill"] = f"""
SELECT token, count(DISTINCT doc_id) AS n_items, count(*)::BIGINT AS n FROM (
  SELECT doc_id, unnest(list_concat({TERMS}, CASE WHEN n_chars % 3 = 0 THEN ['art' || n_chars] ELSE [] END)) AS token FROM (
    SELECT doc_id, n_chars, array_to_string(list_filter([string_split(text, chr(10))[1], source, lang], lambda x: x <> ''), ' ') || ' ' || text AS text FROM documents)) GROUP BY token"""


# chunk plans


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks that keep their newline. Those of a length of 1 modulo 5
    stand for article headers, whose article the lines after them carry."""
    n = F.length("text")
    header = (n % 5 == 1) & (n > 1)
    rows = lines(spark, sf_dir).select("doc", "idx", "level", F.when(header, F.concat(F.lit("第"), n.cast("string"), F.lit("条"))).otherwise(F.col("text")).alias("text"))
    carried = structure.carried_article(rows.withColumn("level", F.lit(None).cast("int")))
    none = lambda t: F.lit(None).cast(t)
    return carried.select("doc", "idx", F.sha2(F.concat_ws("|", F.col("doc").cast("string"), F.col("idx").cast("string")), 256).alias("block_id"), F.concat("text", F.lit("\n")).alias("text"), "article", none("string").alias("section_title"), (F.floor(F.col("idx") / 46) + 1).alias("page_start"), none("long").alias("page_end"), F.col("idx").alias("paragraph_index"), none("array<struct<x0:double,top:double,x1:double,bottom:double>>").alias("bboxes"))


@query
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents and children with ordinals, offsets, ids and how many blocks they touch."""
    blocks = _blocks(spark, sf_dir)
    planned, _ = chunks.plan(blocks)
    found = chunks.identified(planned, blocks, F.col("doc"))
    same = F.concat_ws("-", F.substring("id", 1, 8), F.substring("id", 10, 4))
    return found.select("doc", "ordinal", "grp", "child", "start", "end", F.sha2("text", 256).alias("text_sha256"), F.size("spans").cast("long").alias("n_spans"), F.length("id").alias("id_length"), same.rlike("^[0-9a-f]{8}-[0-9a-f]{4}$").alias("id_fits"))


@query
def chunk_plan_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.plan(_blocks(spark, sf_dir))[1]


@query
def chunk_plan_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article, pages and paragraph of each chunk, from the blocks it touches."""
    blocks = _blocks(spark, sf_dir)
    return chunks.located(chunks.plan(blocks)[0], blocks).select("doc", "ordinal", "article", "page_start", "page_end", "paragraph_index")


@query
def chunk_plan_reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts from their children, with the article headers that stand in for lines."""
    planned, _ = chunks.plan(_blocks(spark, sf_dir))
    parts = planned.where("child >= 0").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("ordinal", "text"))).alias("p"))
    return parts.select("doc", F.sha2(F.array_join("p.text", ""), 256).alias("text_sha256"))


_PLAN = r"""raw AS (SELECT doc, idx, text AS line, length(text) AS n FROM (SELECT doc_id AS doc, unnest(range(len(p))) AS idx, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))),
named AS (SELECT doc, idx, n % 5 = 1 AND n > 1 AS h, CASE WHEN n % 5 = 1 AND n > 1 THEN '第' || n || '条' ELSE line END || chr(10) AS text, last_value(CASE WHEN n % 5 = 1 AND n > 1 THEN '第' || n || '条' END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING) AS article FROM raw),
opened AS (SELECT *, NOT coalesce(article = lag(article) OVER (PARTITION BY doc ORDER BY idx), false) AS opens FROM named),
islands AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc ORDER BY idx) AS island FROM opened),
headed AS (SELECT *, min(CASE WHEN h THEN idx END) OVER (PARTITION BY doc, island) AS header FROM islands),
grouped AS (SELECT *, sum((opens OR header IS NULL OR idx <= header)::INT) OVER (PARTITION BY doc ORDER BY idx) - 1 AS grp FROM headed),
blocks AS (SELECT *, bool_and(h) OVER (PARTITION BY doc, grp) AS headless, sum(length(text)) OVER (PARTITION BY doc, grp ORDER BY idx) - length(text) AS a, sum(length(text)) OVER (PARTITION BY doc, grp ORDER BY idx) AS z FROM grouped),
fine AS (SELECT * FROM blocks ANTI JOIN (SELECT DISTINCT doc FROM blocks WHERE headless) USING (doc)),
parents AS (SELECT doc, grp, string_agg(text, '' ORDER BY idx) AS text FROM fine GROUP BY doc, grp),
cut AS (SELECT *, length(regexp_extract(text, '^\s*第[0-9]+条\s*')) AS kept FROM parents),
parts AS (SELECT doc, grp, unnest(range(len(p))) + 1 AS i, length(unnest(p)) AS n FROM (SELECT doc, grp, regexp_extract_all(substr(text, kept + 1), '[^\n]*\n') AS p FROM cut)),
fold AS (
  SELECT doc, grp, 0::BIGINT AS i, 0::BIGINT AS held, 0::BIGINT AS pos, []::BIGINT[] AS starts FROM cut
  UNION ALL
  SELECT f.doc, f.grp, p.i, CASE WHEN n > 600 THEN (n - 1) % 600 + 1 WHEN held > 0 AND held + n > 600 THEN n ELSE held + n END, pos + n,
    CASE WHEN n > 600 THEN list_transform(range((n + 599) // 600), lambda k: pos + 600 * k) WHEN held = 0 OR held + n > 600 THEN [pos] ELSE [] END
  FROM fold f JOIN parts p ON p.doc = f.doc AND p.grp = f.grp AND p.i = f.i + 1),
begun AS (SELECT doc, grp, s, row_number() OVER (PARTITION BY doc, grp ORDER BY s) - 1 AS child FROM (SELECT doc, grp, unnest(starts) AS s FROM fold)),
children AS (SELECT b.doc, b.grp, b.child, CASE WHEN b.child = 0 THEN 0 ELSE b.s + kept END AS a, coalesce(lead(b.s) OVER (PARTITION BY b.doc, b.grp ORDER BY b.s) + kept, length(text)) AS z, text FROM begun b JOIN cut USING (doc, grp)),
chunks AS (
  SELECT doc, grp, -1 AS child, 0 AS a, length(text) AS z, text FROM parents UNION ALL SELECT doc, grp, child, a, z, substr(text, (a + 1)::BIGINT, (z - a)::BIGINT) FROM children),
spans AS (SELECT c.doc, c.grp, c.child, c.a, c.z, c.text, count(*) AS n_spans, arg_min(f.article, f.idx) FILTER (f.article IS NOT NULL) AS article, min(f.idx // 46 + 1) AS page_start, max(f.idx // 46 + 1) AS page_end, min(f.idx) AS paragraph_index
  FROM chunks c JOIN fine f ON f.doc = c.doc AND f.grp = c.grp AND f.a < c.z AND f.z > c.a GROUP BY ALL),
planned AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY grp, child) - 1 AS ordinal FROM spans)"""
ORACLES["chunk_plan"] = f'''WITH RECURSIVE {_PLAN} SELECT doc::VARCHAR AS doc, ordinal::INTEGER AS ordinal, grp::INTEGER AS grp, child::INTEGER AS child, a::INTEGER AS start, z::INTEGER AS "end", sha256(text) AS text_sha256, n_spans, 36::INTEGER AS id_length, true AS id_fits FROM planned'''
ORACLES["chunk_plan_rejects"] = f"WITH RECURSIVE {_PLAN} SELECT doc::VARCHAR AS doc, idx::INTEGER AS idx, 'article header without a body' AS reason FROM blocks WHERE headless"
ORACLES["chunk_plan_locators"] = f"WITH RECURSIVE {_PLAN} SELECT doc::VARCHAR AS doc, ordinal::INTEGER AS ordinal, article, page_start::BIGINT AS page_start, page_end::BIGINT AS page_end, paragraph_index::INTEGER AS paragraph_index FROM planned"
ORACLES["chunk_plan_reconstructed"] = f"WITH RECURSIVE {_PLAN} SELECT doc::VARCHAR AS doc, sha256(string_agg(text, '' ORDER BY idx)) AS text_sha256 FROM fine GROUP BY doc"


# three channels for tenants

TENANTS = ("src3", "src5")


def _scoped(spark: SparkSession, sf_dir: str, channel: str) -> DataFrame:
    """A channel's hits among what each of two tenants may see, of documents that
    are active and valid on a day, without the items that each query excludes."""
    docs = knowledge_table(spark, sf_dir)
    status = F.when(F.length("text") % 11 == 0, "pending").otherwise("active")
    docs = docs.select(F.col("doc_id").alias("item"), F.col("doc_id").alias("doc"), "text", status.alias("status"), "scope", "tenant_id", "effective_date", "expiry_date")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text", T.search_terms(F.col("text")).alias("terms"), F.array().cast("array<string>").alias("articles"), F.sequence("item_id", F.col("item_id") + 30).alias("excluded"))
    own = vectors.where(F.size("vector") == 64).select(F.col("item").alias("query"), F.col("vector").alias("query_vector"))
    parts = []
    for tenant in TENANTS:
        seen = TenantScope(Actor("u", tenant, "customer")).knowledge(docs)
        rows = retrieval.valid_on(seen.where("status = 'active'"), F.lit("2024-06-01").cast("date"))
        if channel == "keyword":
            hits = retrieval.keyword_channel(rows.select("item", T.word_tokens(F.col("text")).alias("tokens"), T.article_number(F.col("text")).alias("article")), asked)
        elif channel == "vector":
            hits = retrieval.vector_channel(rows.join(vectors, "item", "left").select("item", "vector", T.article_number(F.col("text")).alias("article")), asked.join(own, "query"), dimension=64)
        else:
            hits = retrieval.reference_channel(rows.select("item", F.split("text", "\n")[0].alias("title"), T.article_number(F.col("text")).alias("article")), asked)
        parts.append(hits.select(F.lit(tenant).alias("tenant"), "query", "item", "rank", F.round("score", 6).alias("score")))
    return parts[0].unionByName(parts[1])


@query
def scoped_keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir, "keyword")


@query
def scoped_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir, "vector")


@query
def scoped_reference_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir, "reference")


_ELIGIBLE = f"""{KNOWLEDGE},
tenants AS (SELECT unnest(['{TENANTS[0]}', '{TENANTS[1]}']) AS tenant),
el AS (SELECT tenant, doc_id AS item, text FROM k JOIN tenants ON scope = 'public' OR (tenant_id = tenant AND scope IN ('firm', 'tenant_private'))
  WHERE length(text) % 11 <> 0 AND (effective_date IS NULL OR effective_date <= DATE '2024-06-01') AND (expiry_date IS NULL OR expiry_date >= DATE '2024-06-01')),
asked AS (SELECT item_id AS query, {TERMS} AS w FROM benchmark)"""
_BEST = "SELECT tenant, query, item, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY tenant, query ORDER BY score DESC, item) AS rank FROM hits WHERE NOT item BETWEEN query AND query + 30) WHERE rank <= 20"
ORACLES["scoped_keyword_topk"] = f"""WITH {_ELIGIBLE},
hits AS (SELECT tenant, query, item, count(*) * 0.1::DOUBLE AS score FROM (SELECT tenant, item, unnest({TERMS}) AS token FROM el)
  JOIN (SELECT DISTINCT query, unnest(CASE WHEN len(list_filter(w, lambda x: length(x) >= 2)) > 0 THEN list_filter(w, lambda x: length(x) >= 2) ELSE w END) AS token FROM asked) USING (token) GROUP BY ALL) {_BEST}"""
ORACLES["scoped_vector_topk"] = f"""WITH {_ELIGIBLE},
hits AS (SELECT tenant, query, item, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM asked JOIN embeddings q ON q.vec_id = query CROSS JOIN el JOIN embeddings e ON e.vec_id = item) {_BEST}"""
ORACLES["scoped_reference_topk"] = f"""WITH {_ELIGIBLE},
hits AS (SELECT DISTINCT tenant, query, item, 1.0::DOUBLE AS score FROM (SELECT tenant, item, lower(string_split(text, chr(10))[1]) AS title FROM el)
  JOIN (SELECT query, unnest(list_filter(w, lambda x: length(x) >= 2)[1:20]) AS term FROM asked) ON title LIKE '%' || term || '%') {_BEST}"""


@query
def scoped_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an administrator lists for another tenant: the firm's documents, and
    those of any scope that are archived."""
    status = F.element_at(F.array(*[F.lit(s) for s in ("pending", "active", "inactive", "archived", "deleted")]), (F.length("text") % 5 + 1).cast("int"))
    docs = knowledge_table(spark, sf_dir).withColumn("status", status)
    scope = TenantScope(Actor("root", "src1", "admin", frozenset(["src3"])), "src3")
    return scope.listed(docs, scope="firm").unionByName(scope.listed(docs, status="archived")).select("doc_id", "scope", "tenant_id", "status")


ORACLES["scoped_listing"] = f"""WITH {KNOWLEDGE}, s AS (SELECT *, ['pending', 'active', 'inactive', 'archived', 'deleted'][length(text) % 5 + 1] AS status FROM k WHERE scope = 'public' OR tenant_id = 'src3')
SELECT doc_id, scope, tenant_id, status FROM s WHERE scope = 'firm' AND status <> 'deleted' UNION ALL SELECT doc_id, scope, tenant_id, status FROM s WHERE status = 'archived'"""


@query
def append_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why chunks may not be appended for a tenant by an administrator who may write public ones."""
    docs = knowledge_table(spark, sf_dir).withColumn("source_type", F.when(F.col("scope") == "public", F.when(F.col("doc_id") % 4 > 0, "law").otherwise("firm_rule")).otherwise("tenant_private"))
    rows = docs.select(F.col("doc_id").alias("chunk"), F.when(F.col("doc_id") % 10 == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id") - F.col("doc_id") % 2).alias("doc"), "scope", "tenant_id")
    scope = TenantScope(Actor("root", "src3", "admin"), public_writes=True)
    _, bad = scope.appendable_chunks(rows, docs.select(F.col("doc_id").alias("doc"), "scope", "tenant_id", "source_type"))
    return bad.select("chunk", F.array_join("problems", "; ").alias("problems"))


ORACLES["append_refusals"] = f"""WITH {KNOWLEDGE},
c AS (SELECT doc_id AS chunk, CASE WHEN doc_id % 10 = 0 THEN doc_id + 1000000000 ELSE doc_id - doc_id % 2 END AS doc, scope, tenant_id FROM k),
x AS (SELECT c.*, d.scope AS s, d.tenant_id AS t, d.doc_id IS NOT NULL AS known, d.scope = 'public' AND d.doc_id % 4 > 0 AS law FROM c LEFT JOIN k d ON d.doc_id = c.doc)
SELECT chunk, concat_ws('; ', CASE WHEN scope <> 'public' AND coalesce(tenant_id, '') <> 'src3' THEN 'another tenant''s row' END, CASE WHEN NOT known THEN 'unknown document' END,
  CASE WHEN scope = 'public' AND known AND NOT coalesce(law, false) THEN 'public chunks belong to public law' END, CASE WHEN known AND (scope IS DISTINCT FROM s OR tenant_id IS DISTINCT FROM t) THEN 'scope or tenant unlike the document''s' END) AS problems FROM x WHERE problems <> ''"""


# rejects


@query
def source_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sources, with what is wrong with each."""
    p, n = table(spark, sf_dir, "pages"), F.col("page_id")
    url = F.when(n % 13 == 0, "ftp://a.b/c").when(n % 17 == 0, F.concat(F.lit("https://u:p@a.b/"), n.cast("string"))).when(n % 19 == 0, F.concat("url", F.lit("#part"))).when(n % 23 == 0, "").otherwise(F.col("url"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(n, F.lit(50)).cast("int"))
    rows = p.select("page_id", F.when(n % 29 == 0, " ").otherwise("t").alias("title"), F.when(n % 2 == 0, "law").when(n % 31 == 0, "other").otherwise("firm_rule").alias("source_type"), F.when(n % 7 > 0, "authority").alias("issuing_authority"), F.when(n % 5 > 0, "v1").alias("version"), url.alias("source_url"), F.when(n % 3 > 0, day).alias("effective_date"), F.date_add(day, (n % 11 - 2).cast("int")).alias("expiry_date"), (n % 6).alias("page_start"), (n % 4 + 1).alias("page_end"), (n % 9 - 1).alias("paragraph_index"), F.when(n % 8 > 0, F.upper(F.sha2("html", 256))).otherwise("abc").alias("source_sha256"), F.lit("").alias("chunk_sha256"))
    return rejects.split(rows, rejects.source_rules())[1].select("page_id", F.array_join("problems", "; ").alias("problems"))


ORACLES["source_rejects"] = """
WITH s AS (SELECT page_id, n % 29 = 0 AS untitled, CASE WHEN n % 2 = 0 THEN 'law' WHEN n % 31 = 0 THEN 'other' ELSE 'firm_rule' END AS y, n % 7 > 0 AS a, n % 5 > 0 AS v, n % 8 > 0 AS h, n % 3 > 0 AS e, n % 6 AS p1, n % 4 + 1 AS p2, n % 9 - 1 AS q, n % 11 - 2 AS later,
  CASE WHEN n % 13 = 0 THEN 'ftp' WHEN n % 17 = 0 THEN 'user' WHEN n % 19 = 0 THEN 'part' WHEN n % 23 = 0 THEN '' WHEN regexp_matches(url, '#.') THEN 'part' ELSE 'fine' END AS u FROM (SELECT *, page_id AS n FROM pages))
SELECT page_id, concat_ws('; ', CASE WHEN untitled THEN 'no title' END, CASE WHEN y = 'other' THEN 'unknown source type' END, CASE WHEN q < 0 THEN 'paragraph below 0' END, CASE WHEN p1 < 1 THEN 'page below 1' END, CASE WHEN NOT h THEN 'no SHA-256' END,
  CASE WHEN p2 < p1 THEN 'last page before the first' END, CASE WHEN e AND later < 0 THEN 'expiry before effect' END, CASE WHEN u = 'ftp' THEN 'not an http address' END, CASE WHEN u = 'user' THEN 'address with credentials' END, CASE WHEN u = 'part' THEN 'address with a fragment' END,
  CASE WHEN y = 'law' AND NOT a THEN 'law without authority' END, CASE WHEN y = 'law' AND u IN ('ftp', '') THEN 'law without address' END, CASE WHEN y = 'law' AND NOT v AND NOT e THEN 'law without version or date' END) AS problems FROM s WHERE problems <> ''"""


@query
def box_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from orders, with what is wrong with each; fine ones by their four names."""
    n = F.col("o_orderkey")
    v = lambda k: (n % k).cast("double")
    box = F.struct(F.when(n % 41 > 0, v(7)).alias("x0"), F.when(n % 43 > 0, v(11) + 1).alias("x1"), F.when(n % 2 == 0, v(13) - F.when(n % 47 == 0, 20).otherwise(0)).alias("top"), F.when((n % 2 == 1) | (n % 53 == 0), F.when(n % 59 == 0, float("inf")).otherwise(v(13))).alias("y0"), F.when(n % 3 > 0, v(17) + 3).alias("bottom"), F.when(n % 3 == 0, v(17) + 3).when(n % 61 == 0, v(17)).alias("y1"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", box.alias("box"))
    judged = rejects.judged(rows, rejects.box_rules(F.col("box"))).withColumn("c", rejects.canonical_box(F.col("box")))
    fine = F.size("problems") == 0
    return judged.select("o_orderkey", F.array_join("problems", "; ").alias("problems"), *[F.when(fine, F.col(f"c.{p}")).alias(p) for p in rejects.BOX])


ORACLES["box_rejects"] = """
WITH b AS (SELECT n, CASE WHEN n % 41 > 0 THEN (n % 7)::DOUBLE END AS x0, CASE WHEN n % 43 > 0 THEN (n % 11 + 1)::DOUBLE END AS x1, CASE WHEN n % 2 = 0 THEN (n % 13 - CASE WHEN n % 47 = 0 THEN 20 ELSE 0 END)::DOUBLE END AS t,
  CASE WHEN n % 2 = 1 OR n % 53 = 0 THEN CASE WHEN n % 59 = 0 THEN 'inf'::DOUBLE ELSE (n % 13)::DOUBLE END END AS y0, CASE WHEN n % 3 > 0 THEN (n % 17 + 3)::DOUBLE END AS d, CASE WHEN n % 3 = 0 THEN (n % 17 + 3)::DOUBLE WHEN n % 61 = 0 THEN (n % 17)::DOUBLE END AS y1 FROM (SELECT o_orderkey AS n FROM orders)),
c AS (SELECT *, coalesce(t, y0) AS ct, coalesce(d, y1) AS cd, x0 IS NOT NULL AND x1 IS NOT NULL AND coalesce(t, y0) IS NOT NULL AND coalesce(d, y1) IS NOT NULL AS whole FROM b),
u AS (SELECT *, whole AND isfinite(ct) AS usable FROM c),
p AS (SELECT *, concat_ws('; ', CASE WHEN x0 IS NULL OR x1 IS NULL THEN 'no x0 or x1' END, CASE WHEN t <> y0 THEN 'top and y0 differ' END, CASE WHEN d <> y1 THEN 'bottom and y1 differ' END, CASE WHEN ct IS NULL THEN 'no top' END, CASE WHEN cd IS NULL THEN 'no bottom' END,
  CASE WHEN whole AND NOT isfinite(ct) THEN 'not finite' END, CASE WHEN usable AND ct < 0 THEN 'negative' END, CASE WHEN usable AND x1 < x0 THEN 'x1 before x0' END, CASE WHEN usable AND cd < ct THEN 'bottom before top' END) AS problems FROM u)
SELECT n AS o_orderkey, problems, CASE WHEN problems = '' THEN x0 END AS x0, CASE WHEN problems = '' THEN ct END AS top, CASE WHEN problems = '' THEN x1 END AS x1, CASE WHEN problems = '' THEN cd END AS bottom FROM p"""


@query
def chunk_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks beside their documents and parents: how many break each rule."""
    docs = knowledge_table(spark, sf_dir)
    n = F.col("doc_id")
    rows = docs.select(n.alias("id"), F.when(n % 37 == 0, -n - 1).otherwise(n).alias("document_id"), F.when(n % 5 > 0, n - n % 5).alias("parent_id"), F.when(n % 31 == 0, "firm").otherwise(F.col("scope")).alias("scope"), "tenant_id", (n % 29 - 1).alias("ordinal"), F.lit(2).alias("page_start"), (n % 23 + 1).alias("page_end"), F.col("text").alias("content"), F.when(n % 19 > 0, F.sha2("text", 256)).alias("content_sha256"))
    rows = rows.withColumn("fits", rejects.hash_fits()).drop("content", "content_sha256")
    met = rejects.with_facts(rows, docs.select("doc_id", "scope", "tenant_id"), {"document_id": "doc_id"}, "document")
    met = rejects.with_facts(met, rows.select("id", "document_id").where("id % 25 > 0"), {"parent_id": "id"}, "parent")
    bad = rejects.judged(met, rejects.chunk_rules(F.col("fits"))).select(F.explode("problems").alias("problem"))
    return bad.groupBy("problem").agg(F.count("*").alias("n"))


ORACLES["chunk_rejects"] = f"""WITH {KNOWLEDGE},
c AS (SELECT doc_id AS id, CASE WHEN doc_id % 37 = 0 THEN -doc_id - 1 ELSE doc_id END AS document_id, CASE WHEN doc_id % 5 > 0 THEN doc_id - doc_id % 5 END AS parent_id, CASE WHEN doc_id % 31 = 0 THEN 'firm' ELSE scope END AS scope, tenant_id, doc_id AS n FROM k),
x AS (SELECT c.*, d.doc_id IS NOT NULL AS known, d.scope AS ds, d.tenant_id AS dt, p.id IS NOT NULL AS has, p.document_id AS pd FROM c LEFT JOIN k d ON d.doc_id = c.document_id LEFT JOIN c p ON p.id = c.parent_id AND p.id % 25 > 0),
b AS (SELECT unnest([CASE WHEN (scope = 'public') <> (tenant_id IS NULL) THEN 'public if and only if without tenant' END, CASE WHEN n % 29 = 0 THEN 'ordinal below 0' END, CASE WHEN n % 23 + 1 < 2 THEN 'last page before the first' END, CASE WHEN NOT known THEN 'no document' END,
  CASE WHEN known AND scope IS DISTINCT FROM ds THEN 'scope unlike the document''s' END, CASE WHEN known AND tenant_id IS DISTINCT FROM dt THEN 'tenant unlike the document''s' END, CASE WHEN parent_id IS NOT NULL AND NOT has THEN 'no parent' END, CASE WHEN has AND document_id IS DISTINCT FROM pd THEN 'parent of another document' END,
  CASE WHEN n % 19 = 0 THEN 'hash unlike the text' END]) AS problem FROM x)
SELECT problem, count(*) AS n FROM b WHERE problem IS NOT NULL GROUP BY problem"""


# ordered rules

_RULES = (("the", ("definite article", "article")), ("ing", ("gerund",)), ("la", ("article", "la")), ("der", ("article", "der")))


@query
def domain_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that the words of documents call for: with a model's, without its
    failures, and the ranks of the rules. The fixed rules match no document."""
    d = table(spark, sf_dir, "documents")
    said = F.when(F.col("doc_id") % 3 > 0, F.array(F.lit(" gerund "), F.lit(""), F.col("text"), F.col("lang")))
    fixed = rulebook.expanded(F.concat("text", F.when(F.col("doc_id") % 4 == 0, "，付款和质量").otherwise("")))
    return d.select("doc_id", F.array_join(rulebook.matched(F.col("text"), _RULES)["rank"], ",").alias("ranks"), F.array_join(rulebook.combined(F.col("text"), said, _RULES), "|").alias("queries"), F.size(fixed).alias("n_fixed"))


ORACLES["domain_expand"] = """
WITH d AS (SELECT doc_id, lang, list_filter([CASE WHEN contains(text, 'the') THEN 1 END, CASE WHEN contains(text, 'ing') THEN 2 END, CASE WHEN contains(text, 'la') THEN 3 END, CASE WHEN contains(text, 'der') THEN 4 END], lambda x: x IS NOT NULL) AS r FROM documents),
q AS (SELECT doc_id, r, list_concat(CASE WHEN doc_id % 3 > 0 THEN ['gerund', lang] ELSE [] END, flatten(list_transform(r, lambda x: CASE x WHEN 1 THEN ['definite article', 'article'] WHEN 2 THEN ['gerund'] WHEN 3 THEN ['article', 'la'] ELSE ['article', 'der'] END))) AS q FROM d)
SELECT doc_id, array_to_string(r, ',') AS ranks, array_to_string(list_filter(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN list_position(q, q[i]) = i THEN q[i] END), lambda x: x IS NOT NULL)[1:8], '|') AS queries, (CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END)::INTEGER AS n_fixed FROM q"""


@query
def law_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, authority, day and version of documents that begin like laws."""
    n, first = F.col("doc_id") % 7, F.split("text", "\n")[0]
    num = (F.col("doc_id") % 12 + 1).cast("string")
    head = (
        F.when(n == 0, F.concat(F.lit("第一章 总则\n  某市 管理办法 \n国务院令\n自2024年"), num, F.lit("月3日起施行\n")))
        .when(n == 1, F.concat(F.lit("发布机关：测试部门 其他\n一个标题\n施行日期：2023年 "), num, F.lit("月40日\n")))
        .when(n == 2, F.concat(F.lit("（2020年1月2日第十三届全国人民代表大会第三次会议通过）\n"), F.lit("中华规则\n2021年"), num, F.lit("月1日起生效")))
        .when(n == 3, F.lit("12\n某某省人民政府公告\n"))
        .otherwise("")
    )
    name = F.concat(F.lit("in/a.b/"), F.when(n < 5, "file").otherwise("某条例"), F.when(F.col("doc_id") % 2 == 0, "_20240102").otherwise(""), F.lit(".docx"))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("filename"), F.concat(head, first).alias("text"))
    return rulebook.law_metadata(rows).select("doc_id", "title", "issuing_authority", "effective_date", "effective_day", "version", "source_type")


ORACLES["law_metadata"] = """
WITH d AS (SELECT doc_id, doc_id % 7 AS n, doc_id % 12 + 1 AS m, doc_id % 2 = 0 AS dated FROM documents)
SELECT doc_id, CASE n WHEN 0 THEN '某市 管理办法' WHEN 1 THEN '一个标题' WHEN 2 THEN '中华规则' WHEN 3 THEN '某某省人民政府公告' WHEN 4 THEN 'file' ELSE '某条例' END AS title,
  CASE n WHEN 0 THEN '国务院' WHEN 1 THEN '测试部门' WHEN 2 THEN '全国人民代表大会' WHEN 3 THEN '某某省人民政府' END AS issuing_authority,
  CASE n WHEN 0 THEN '2024-' || lpad(m::VARCHAR, 2, '0') || '-03' WHEN 1 THEN '2023-' || lpad(m::VARCHAR, 2, '0') || '-40' WHEN 2 THEN '2021-' || lpad(m::VARCHAR, 2, '0') || '-01' END AS effective_date,
  CASE n WHEN 0 THEN make_date(2024, m, 3) WHEN 2 THEN make_date(2021, m, 1) END AS effective_day,
  CASE WHEN dated THEN '20240102' WHEN n = 0 THEN '2024年' || m || '月3日' WHEN n = 2 THEN '2020年1月2日' END AS version, CASE WHEN n IN (0, 2, 5, 6) THEN 'law' END AS source_type FROM d"""


# pages


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as those of pages of 46 lines, with headers, page
    numbers, chapters, articles and, in each seventh document, a table of contents."""
    n, at = F.length("text"), F.col("idx") % 46
    contents = F.col("doc") % 7 == 0
    text = (
        F.when(at == 45, (F.floor(F.col("idx") / 46) + 1).cast("string"))
        .when(at == 0, F.concat(F.lit("Header of "), (F.col("doc") % 5).cast("string")))
        .when(contents & (F.col("idx") == 4), "目 录")
        .when((contents & (F.col("idx") == 5)) | (n % 10 == 3), F.concat(F.lit("第"), (n % 9 + 1).cast("string"), F.lit("章 总则")))
        .when(n % 10 == 7, F.concat(F.lit("第"), n.cast("string"), F.lit("条 "), F.col("text")))
        .otherwise(F.col("text"))
    )
    top = 50 + 16 * at
    return lines(spark, sf_dir).select(F.col("doc").cast("string").alias("doc"), (F.floor(F.col("idx") / 46) + 1).alias("page"), F.floor(at / 4).alias("block"), F.col("idx").alias("line"), text.alias("text"), F.lit(842.0).alias("page_height"), F.lit(10.0).alias("x0"), top.cast("double").alias("top"), F.lit(500.0).alias("x1"), (top + 12).cast("double").alias("bottom"))


@query
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages with their places and kinds."""
    blocks, _ = pages.page_blocks(_page_lines(spark, sf_dir))
    return blocks.select("doc", "page_start", "paragraph_index", "block_type", "article", "section_title", F.size("bboxes").alias("n_lines"), F.sha2("text", 256).alias("text_sha256"), "block_id")


@query
def page_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over small limits, or of which nothing is left."""
    limits = pages.PageLimits(pages=2, blocks=13, lines=60, characters=2_500)
    return pages.page_blocks(_page_lines(spark, sf_dir), limits)[1]


_PAGES = r"""raw AS (SELECT doc, idx, text AS t, length(text) AS n FROM (SELECT doc_id AS doc, unnest(range(len(p))) AS idx, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))),
l AS (SELECT doc, idx, idx // 46 + 1 AS page, idx % 46 // 4 AS block, idx % 46 <= 4 OR idx % 46 >= 41 AS margin, CASE WHEN idx % 46 = 45 THEN (idx // 46 + 1)::VARCHAR WHEN idx % 46 = 0 THEN 'Header of ' || doc % 5 WHEN doc % 7 = 0 AND idx = 4 THEN '目 录'
  WHEN (doc % 7 = 0 AND idx = 5) OR n % 10 = 3 THEN '第' || (n % 9 + 1) || '章 总则' WHEN n % 10 = 7 THEN '第' || n || '条 ' || t ELSE t END AS text FROM raw),
said AS (SELECT *, regexp_replace(text, '\s', '', 'g') AS norm FROM l WHERE regexp_matches(text, '\S') AND idx % 46 <> 45),
rep AS (SELECT doc, norm FROM said WHERE margin AND length(norm) >= 4 GROUP BY ALL HAVING count(*) >= 2),
body AS (SELECT s.*, regexp_matches(text, '^第[0-9]+章 总则$') AS h, regexp_extract(text, '^(第[0-9]+条) ', 1) AS a FROM said s LEFT JOIN rep USING (doc, norm) WHERE NOT (margin AND rep.doc IS NOT NULL) AND NOT regexp_matches(text, '[.．·•]{3,}|…{3,}')),
started AS (SELECT *, h OR a <> '' OR coalesce(lag(h) OVER (PARTITION BY doc, page, block ORDER BY idx), true) AS st FROM body),
numbered AS (SELECT *, sum(st::INT) OVER (PARTITION BY doc, page, block ORDER BY idx) AS seg FROM started),
segs AS (SELECT doc, page, block, seg, string_agg(text, chr(10) ORDER BY idx) AS text, count(*) AS n_lines, bool_or(h) AS h, nullif(min(a) FILTER (a <> ''), '') AS a, min(idx) AS i FROM numbered GROUP BY ALL),
marked AS (SELECT *, max(CASE WHEN text = '目 录' THEN i END) OVER (PARTITION BY doc) AS m FROM segs),
seen AS (SELECT * FROM marked WHERE m IS NULL OR i < m OR page > 1),
placed AS (SELECT *, last_value(CASE WHEN h THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i ROWS UNBOUNDED PRECEDING) AS section, sum(h::INT) OVER (PARTITION BY doc, page ORDER BY i) AS since FROM seen),
carried AS (SELECT *, last_value(a IGNORE NULLS) OVER (PARTITION BY doc, page, since ORDER BY i ROWS UNBOUNDED PRECEDING) AS article FROM placed),
blocks AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY i) AS paragraph, CASE WHEN h THEN 'heading' WHEN a IS NOT NULL THEN 'article' ELSE 'paragraph' END AS kind FROM carried WHERE m IS NULL OR i > m)"""
ORACLES["page_blocks"] = f"WITH {_PAGES} SELECT doc::VARCHAR AS doc, page AS page_start, paragraph::INTEGER AS paragraph_index, kind AS block_type, article, section AS section_title, n_lines::INTEGER AS n_lines, sha256(text) AS text_sha256, sha256(doc || '|pdf|page:' || page || '|paragraph:' || paragraph || '|type:' || kind) AS block_id FROM blocks"
ORACLES["page_rejects"] = f"""WITH {_PAGES},
z AS (SELECT doc, max(page) AS p, count(DISTINCT (page, block)) AS b, count(*) AS n, sum(length(text)) AS c FROM l GROUP BY doc),
j AS (SELECT doc, CASE WHEN p > 2 THEN 'too many pages' WHEN b > 13 THEN 'too many blocks' WHEN n > 60 THEN 'too many lines' WHEN c > 2500 THEN 'too many characters' END AS reason FROM z)
SELECT doc::VARCHAR AS doc, coalesce(reason, 'no usable text') AS reason FROM j WHERE reason IS NOT NULL OR doc NOT IN (SELECT doc FROM blocks)"""
