"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

_LINES = """lines AS (
  SELECT doc, idx, text, CASE WHEN length(text) < 20 THEN 1 WHEN length(text) < 40 THEN 2 WHEN length(text) < 60 THEN 3 END AS level
  FROM (SELECT doc_id AS doc, unnest(range(len(p))) AS idx, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))"""
_WORD = "[A-Za-z0-9_]+|[\\x{3400}-\\x{9fff}]+"
TERMS = f"regexp_extract_all(lower(text), '{_WORD}')"
_VECTOR = """vector AS (
  SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM (
    SELECT q.vec_id AS query, e.vec_id AS item, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
    FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings e
    WHERE e.vec_id <> q.vec_id AND len(e.embedding) = 64)
  QUALIFY rank <= 20)"""
KEYWORD = f"""keyword AS (
  SELECT query, item, n * 0.1::DOUBLE AS score, row_number() OVER (PARTITION BY query ORDER BY n DESC, item) AS rank FROM (
    SELECT query, item, count(*) AS n
    FROM (SELECT doc_id AS item, unnest({TERMS}) AS token FROM documents)
    JOIN (SELECT DISTINCT item_id AS query, unnest(CASE WHEN len(list_filter({TERMS}, lambda x: length(x) >= 2)) > 0 THEN list_filter({TERMS}, lambda x: length(x) >= 2) ELSE {TERMS} END) AS token FROM benchmark) USING (token)
    GROUP BY query, item)
  QUALIFY rank <= 20)"""
REFERENCE = f"""reference AS (
  SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM (
    SELECT DISTINCT query, item, 1.0::DOUBLE AS score
    FROM (SELECT doc_id AS item, string_split(text, chr(10))[1] AS title FROM documents)
    JOIN (SELECT item_id AS query, unnest(list_filter({TERMS}, lambda x: length(x) >= 2)[1:20]) AS term FROM benchmark) ON lower(title) LIKE '%' || term || '%')
  QUALIFY rank <= 20)"""
_FUSED = f"""WITH {_VECTOR}, {KEYWORD}, {REFERENCE},
wide AS (
  SELECT query, item, max(CASE WHEN c = 'v' THEN rank END) AS vector_rank, max(CASE WHEN c = 'k' THEN rank END) AS keyword_rank, max(CASE WHEN c = 'r' THEN rank END) AS reference_rank, max(CASE WHEN c = 'v' THEN score END) AS vector_score
  FROM (SELECT 'v' AS c, * FROM vector UNION ALL SELECT 'k', * FROM keyword UNION ALL SELECT 'r', * FROM reference) GROUP BY query, item),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INTEGER AS rank FROM (
    SELECT *, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) + coalesce(1.0::DOUBLE / (60 + reference_rank), 0) AS score FROM wide)
  QUALIFY rank <= 60)"""
KNOWLEDGE = """k AS (
  SELECT doc_id, scope, CASE WHEN scope <> 'public' THEN source END AS tenant_id, CASE WHEN n_chars % 7 <> 0 THEN s END AS effective_date, CASE WHEN n_chars % 5 <> 0 THEN s + 90 END AS expiry_date, text
  FROM (SELECT *, CASE lang WHEN 'en' THEN 'public' WHEN 'fr' THEN 'firm' ELSE 'tenant_private' END AS scope, DATE '2024-01-01' + (n_chars % 300)::INTEGER AS s FROM documents))"""
_CHECKPOINTS = """c AS (
  SELECT user_id AS job, event_id AS clause, event_type, CASE WHEN event_type IN ('purchase', 'signup') THEN 'complete' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' THEN 'queued' ELSE 'insufficient' END AS status FROM events)"""
_RUN = "OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING)"


def _grouped(lead: bool) -> str:
    """Clause text of blocks between cuts and starts."""
    return f"SELECT doc, min(idx) AS first, string_agg(trim(text, ' \t\r'), chr(10) ORDER BY idx) AS text FROM (SELECT *, sum((cut OR start)::INTEGER) {_RUN} AS g FROM src) WHERE NOT cut GROUP BY doc, g" + ("" if lead else " HAVING bool_or(start)")


ORACLES: dict[str, str] = {
    "vector_topk": f"WITH {_VECTOR} SELECT query, item, rank::INTEGER AS rank, round(score, 9) AS score FROM vector",
    "keyword_topk": f"WITH {KEYWORD} SELECT query, item, rank::INTEGER AS rank, round(score, 6) AS score FROM keyword",
    "reference_topk": f"WITH {REFERENCE} SELECT query, item, rank::INTEGER AS rank, score FROM reference",
    "rrf_fusion": f"{_FUSED} SELECT query, item, rank, round(score, 9) AS score, vector_rank::INTEGER AS vector_rank, keyword_rank::INTEGER AS keyword_rank, reference_rank::INTEGER AS reference_rank FROM fused",
    "similarity_floor": f"{_FUSED} SELECT query, item, rank FROM fused WHERE vector_score IS NULL OR vector_score >= 0.5",
    "rerank": f"""{_FUSED},
t AS (SELECT item_id AS query, list_distinct(CASE WHEN len(list_filter({TERMS}, lambda x: length(x) >= 2)) > 0 THEN list_filter({TERMS}, lambda x: length(x) >= 2) ELSE {TERMS} END) AS terms FROM benchmark),
s AS (SELECT f.query, f.item, len(list_intersect(t.terms, list_distinct({TERMS}))) / greatest(len(t.terms), 1)::DOUBLE AS score FROM fused f JOIN t USING (query) JOIN documents d ON d.doc_id = f.item)
SELECT query, item, rank::INTEGER AS rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= 5""",
    "multi_query_merge": f"""WITH {KEYWORD}, {REFERENCE},
h AS (SELECT query AS clause, 0 AS query_no, rank, item FROM keyword UNION ALL SELECT query, 1, rank, item FROM reference),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY clause, item ORDER BY query_no, rank) = 1)
SELECT clause, item, query_no, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY clause ORDER BY query_no, rank, item) AS place FROM o) WHERE place <= 20""",
    "visible_chunks": f"WITH {KNOWLEDGE} SELECT doc_id, scope, tenant_id FROM k WHERE scope = 'public' OR (tenant_id = 'src3' AND scope IN ('firm', 'tenant_private'))",
    "valid_asof": f"WITH {KNOWLEDGE} SELECT doc_id, effective_date, expiry_date FROM k WHERE (effective_date IS NULL OR effective_date <= DATE '2024-06-01') AND (expiry_date IS NULL OR expiry_date >= DATE '2024-06-01')",
    "eligible_candidates": f"""WITH {KNOWLEDGE},
eligible AS (SELECT doc_id, text FROM k WHERE length(text) % 11 <> 0 AND (scope = 'public' OR (tenant_id = 'src3' AND scope IN ('firm', 'tenant_private'))) AND (effective_date IS NULL OR effective_date <= DATE '2024-06-01') AND (expiry_date IS NULL OR expiry_date >= DATE '2024-06-01')),
{KEYWORD.replace("FROM documents", "FROM eligible")}
SELECT query, item, rank::INTEGER AS rank, round(score, 6) AS score FROM keyword""",
    "chunk_locators": f"""WITH {_LINES},
a AS (SELECT doc, idx, level, CASE WHEN length(text) BETWEEN 60 AND 89 THEN length(text) END AS n FROM lines)
SELECT doc, idx // 5 AS part, (min(idx // 46) + 1)::BIGINT AS page_start, (max(idx // 46) + 1)::BIGINT AS page_end, '第' || arg_min(n, idx) FILTER (WHERE n IS NOT NULL) || '条' AS article, (min(idx) FILTER (WHERE level IS NULL))::INTEGER AS paragraph
FROM a GROUP BY doc, idx // 5""",
    "jobs_finalized": f"""WITH {_CHECKPOINTS},
f AS (SELECT job, CASE WHEN bool_and(status = 'complete') THEN 'complete' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partial' END AS s FROM c GROUP BY job)
SELECT c_custkey AS job, CASE WHEN c_custkey % 7 = 0 THEN 'failed' ELSE coalesce(s, 'complete') END AS status, CASE WHEN c_custkey % 7 = 0 THEN 'early' WHEN s = 'failed' THEN 'error' END AS failure_reason
FROM customer LEFT JOIN f ON job = c_custkey""",
    "doc_dedupe": "SELECT sha256(text) AS sha256, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "doc_conflicts": "WITH f AS (SELECT text, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) SELECT d.doc_id, sha256(d.text) AS sha256 FROM documents d JOIN f ON f.text = d.text WHERE f.source IS DISTINCT FROM d.source OR f.lang IS DISTINCT FROM d.lang",
    "doc_append": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents WHERE lang <> 'en' AND text NOT IN (SELECT text FROM documents WHERE lang = 'en') GROUP BY text",
    "object_keys": f"WITH {KNOWLEDGE} SELECT doc_id, CASE WHEN scope = 'public' THEN 'public/law/' || sha256(text) ELSE 'tenants/' || tenant_id || '/' || scope || '/' || sha256(text) END AS key, true AS allowed FROM k",
    "section_path": f"""WITH {_LINES},
h AS (SELECT *, {", ".join(f"last_value(CASE WHEN level = {n} THEN idx END IGNORE NULLS) {_RUN} AS i{n}, last_value(CASE WHEN level = {n} THEN text END IGNORE NULLS) {_RUN} AS t{n}" for n in (1, 2, 3))} FROM lines)
SELECT doc, idx::INTEGER AS idx, sha256(concat_ws(' > ', t1, CASE WHEN coalesce(i1, -1) < i2 THEN t2 END, CASE WHEN coalesce(i1, -1) < i3 AND coalesce(i2, -1) < i3 THEN t3 END)) AS path_sha256 FROM h""",
    "article_carry": f"""WITH {_LINES},
a AS (SELECT *, count(level) {_RUN} AS s, CASE WHEN length(text) BETWEEN 60 AND 89 THEN '第' || length(text) || '条' END AS a FROM lines)
SELECT doc, idx::INTEGER AS idx, last_value(a IGNORE NULLS) OVER (PARTITION BY doc, s ORDER BY idx ROWS UNBOUNDED PRECEDING) AS article FROM a""",
    "article_runs": f"""WITH {_LINES},
r AS (SELECT doc, idx, idx - row_number() OVER (PARTITION BY doc ORDER BY idx) AS g FROM lines WHERE length(text) >= 200)
SELECT doc, min(idx)::INTEGER AS first, max(idx)::INTEGER AS last, count(*) AS n FROM r GROUP BY doc, g HAVING count(*) >= 2""",
    "split_clauses": f"""WITH {_LINES},
b AS (SELECT * FROM lines WHERE trim(text, ' \t\r') <> ''),
runs AS (SELECT doc, min(idx) AS f, max(idx) AS l FROM (SELECT doc, idx, n - row_number() OVER (PARTITION BY doc ORDER BY idx) AS g FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS n FROM b) WHERE length(text) BETWEEN 60 AND 89) GROUP BY doc, g HAVING count(*) >= 2),
src AS (SELECT b.doc, idx, text, coalesce(level = 1, false) OR r.doc IS NOT NULL AS cut, length(text) BETWEEN 60 AND 89 AND r.doc IS NULL AS start FROM b LEFT JOIN runs r ON r.doc = b.doc AND b.idx BETWEEN f AND l
  WHERE NOT regexp_matches(trim(text, ' \t\r'), '^[-–—·•.]?\\s*\\d{{1,4}}\\s*[-–—·•.]?$')),
art AS ({_grouped(False)}),
plain AS (SELECT * FROM b WHERE doc NOT IN (SELECT doc FROM art) AND NOT regexp_matches(trim(text, ' \t\r'), '^[-–—·•.]?\\s*\\d{{1,4}}\\s*[-–—·•.]?$')),
num AS (SELECT *, regexp_matches(trim(text, ' \t\r'), '^(\\d+(\\.\\d+)*[、.．]|\\d{{1,3}}(\\.\\d{{1,3}})+(\\s|$)|[（(]\\s*\\d+\\s*[）)])') AS start, coalesce(level = 1, false) AS cut FROM plain),
anyn AS (SELECT *, bool_or(start) OVER (PARTITION BY doc) AS has FROM num),
one AS (SELECT doc, idx AS first, text FROM anyn WHERE NOT has),
byn AS (SELECT doc, min(idx) AS first, string_agg(trim(text, ' \t\r'), chr(10) ORDER BY idx) AS text FROM (SELECT *, sum((cut OR start)::INTEGER) {_RUN} AS g FROM anyn WHERE has) WHERE NOT cut GROUP BY doc, g)
SELECT doc, 'clause-' || row_number() OVER (PARTITION BY doc ORDER BY first) AS clause_id, first::INTEGER AS first, sha256(text) AS text_sha256 FROM (SELECT * FROM art UNION ALL SELECT * FROM one UNION ALL SELECT * FROM byn)""",
    "repeated_lines": f"WITH {_LINES} SELECT sha256(norm) AS norm_sha256, count(*) AS n FROM (SELECT regexp_replace(text, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', '', 'g') AS norm FROM lines) WHERE length(norm) >= 4 GROUP BY norm HAVING count(*) >= 2",
    "margin_removal": f"""WITH {_LINES},
m AS (SELECT *, idx % 46 <= 4 OR idx % 46 >= 41 AS in_margin, regexp_replace(text, '\\s+', '', 'g') AS norm FROM lines),
r AS (SELECT doc, norm FROM m WHERE in_margin AND length(norm) >= 4 GROUP BY doc, norm HAVING count(*) >= 2)
SELECT doc, count(*) AS n FROM m WHERE NOT (in_margin AND (doc, norm) IN (SELECT (doc, norm) FROM r)) GROUP BY doc""",
    "chunk_reconstruct": "SELECT doc_id AS doc, sha256(text) AS text_sha256, true AS fits FROM documents WHERE text <> ''",
    "span_overlap": f"""WITH {_LINES},
p AS (SELECT doc, idx, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM lines),
n AS (SELECT doc_id AS doc, length(text) AS n FROM documents),
c AS (SELECT doc, n, unnest(range(n // 600 + 1)) AS chunk FROM n)
SELECT p.doc, idx::INTEGER AS idx, chunk::BIGINT AS chunk, greatest(s, chunk * 600)::BIGINT AS "from", least(s + length(text), chunk * 600 + 600, c.n)::BIGINT AS "to" FROM p JOIN c ON c.doc = p.doc AND s < least(chunk * 600 + 600, c.n) AND s + length(text) > chunk * 600""",
    "block_ids": f"WITH {_LINES} SELECT doc, idx::INTEGER AS idx, sha256(concat_ws('|', sha256(text), 'pdf', 'page:' || (idx // 46), 'paragraph:' || idx, 'type:paragraph')) AS block_id FROM lines",
    "chunk_ids": """SELECT doc_id, h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(('0x' || h[17:17])::INTEGER & 3) + 1] || h[18:20] || '-' || h[21:32] AS id
FROM (SELECT doc_id, sha256('["document","' || source || '","' || sha256(text) || '"]') AS h FROM documents)""",
    "idempotency_key": """SELECT doc_id, source || ':' || sha256(text) || ':' || sha256('{"lang":"' || lang || '"}')[1:8] AS key FROM documents""",
    "search_terms": f"SELECT doc_id, len(t) AS n_terms, sha256(array_to_string(t, ' ')) AS terms_sha256 FROM (SELECT doc_id, CASE WHEN len(list_filter({TERMS}, lambda x: length(x) >= 2)) > 0 THEN list_filter({TERMS}, lambda x: length(x) >= 2) ELSE {TERMS} END AS t FROM documents)",
    "tokenize": f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({TERMS}) AS token FROM documents) GROUP BY token",
    "article_refs": f"""WITH {_LINES}, l AS (SELECT -(doc * 100000 + idx + 1000) AS id, length(text) AS n FROM lines)
SELECT * FROM (VALUES (0, '第十条', '第十条'), (1, '第12条之一,第十条,第五百零二条', NULL), (2, '', NULL), (3, '', NULL), (4, '', NULL), (5, '', NULL), (6, '', NULL), (7, '', NULL), (8, '', NULL), (9, '', NULL), (10, '', NULL), (11, '', NULL), (12, '', NULL), (13, '', NULL), (14, '', NULL), (15, '', NULL), (16, '', NULL)) v(id, refs, article)
UNION ALL SELECT id, concat_ws(',', CASE WHEN n % 5 = 0 THEN '第' || n || '条之二' END, CASE WHEN n % 3 = 0 THEN '第' || n || '条,第' || (n + 1) || '条之二' END), CASE WHEN n % 5 = 0 THEN '第' || n || '条之二' END FROM l WHERE n % 5 = 0 OR n % 3 = 0""",
    "heading_level": f"""WITH {_LINES}, l AS (SELECT -(doc * 100000 + idx + 1000) AS id, length(text) AS n, text FROM lines)
SELECT * FROM (VALUES (0, NULL), (1, NULL), (2, 2), (3, 1), (4, NULL), (5, 2), (6, 3), (7, NULL), (8, NULL), (9, NULL), (10, NULL), (11, NULL), (12, NULL), (13, 2), (14, NULL), (15, NULL), (16, NULL)) v(id, level)
UNION ALL SELECT id, CASE n % 9 WHEN 1 THEN 3 WHEN 3 THEN 2 ELSE 1 END FROM l WHERE n % 9 IN (1, 3) OR (n % 9 = 2 AND length(trim(substr(text, 1, 50))) <= 40 AND NOT regexp_matches(substr(text, 1, 50), '[。！？；：，,;:!?]')) OR (n % 9 = 5 AND NOT regexp_matches(text, '[。！？；：，,;:!?]') AND regexp_matches(text, '\\S'))""",
    "page_number_filter": f"""WITH {_LINES} SELECT id, text FROM (VALUES (8, '- 12 -'), (9, '第 3 页'), (10, '3 / 10'), (11, 'Page 7')) v(id, text)
UNION ALL SELECT doc * 100000 + idx + 1000, text FROM lines WHERE regexp_matches(trim(text, ' \t\r'), '(?i)^([-–—·•.]?\\s*\\d{{1,4}}\\s*[-–—·•.]?|[-–—·•.]?\\s*\\d{{1,4}}\\s*[-–—]\\s*\\d{{1,4}}\\s*[-–—·•.]?|[-–—·•.]?\\s*\\d{{1,4}}\\s*/\\s*\\d{{1,4}}\\s*[-–—·•.]?|page\\s*\\d{{1,4}})$')""",
    "toc_filter": f"WITH {_LINES} SELECT id FROM (VALUES (12), (13)) v(id) UNION ALL SELECT doc * 100000 + idx + 1000 FROM lines WHERE regexp_matches(text, '[.．·•]{{3,}}|…{{3,}}')",
    "cn_numeral": """WITH d AS (SELECT doc_id, doc_id % 100000 AS n FROM documents),
u AS (SELECT n, list_transform([4, 3, 2, 1, 0], lambda k: CASE WHEN n // (10 ** k)::BIGINT % 10 > 0 THEN '〇一二三四五六七八九'[(n // (10 ** k)::BIGINT % 10 + 1)] || ['', '十', '百', '千', '万'][k + 1] ELSE '' END) AS p FROM d WHERE n > 0)
SELECT * FROM (VALUES ('二〇二四', 2024), ('五百零二', 502), ('十二', 12), ('一万二千三百', 12300), ('三亿', 300000000), ('一百零五万', 1050000), ('两', 2), ('x', NULL)) v(text, value)
UNION SELECT translate(doc_id::VARCHAR, '0123456789', '〇一二三四五六七八九'), doc_id FROM d
UNION SELECT array_to_string(p, ''), n FROM u""",
    "grounding_check": r"""
WITH f AS (SELECT event_id AS n, (event_id % 12 + 1)::VARCHAR AS m, (event_id % 50 + 10)::VARCHAR AS p, event_id || '.5' AS v FROM events),
e AS (SELECT *, '2024年' || m || '月3日，' || CASE WHEN n % 3 > 0 THEN p || '%' ELSE '' END || '，金额' || CASE WHEN n % 4 > 0 THEN '' ELSE '1' END || v || '元，502' AS e FROM f),
x AS (SELECT * FROM (SELECT *, list_filter(list_concat(['2024', m, '3'], CASE WHEN p = m THEN [] ELSE [p] END, [v], CASE WHEN n % 5 = 0 THEN ['502'] ELSE [] END), lambda y: length(y) > 1) AS said FROM e)),
u AS (SELECT *, list_concat(CASE WHEN contains(e, p || '%') THEN [] ELSE [p || '%'] END, list_filter(said, lambda y: NOT regexp_matches(e, '(^|[^0-9])' || replace(y, '.', '\.') || '([^0-9]|$)'))) AS bad FROM x)
SELECT n AS id, len(bad) = 0 AND n % 6 <> 0 AS grounded, array_to_string(bad, ',') AS unsupported, CASE WHEN n % 6 = 0 THEN 'x' ELSE '' END AS unknown FROM u""",
    "grounding_turns": r"""
WITH x AS (SELECT conv_id, turn, (turn + 10)::VARCHAR AS v, d.doc_id IS NOT NULL AS known, replace(coalesce(d.text || ' ' || (n_chars % 8 + 10) || ' 项', ''), ' ', '') AS e FROM conversations c LEFT JOIN documents d ON d.doc_id = conv_id),
y AS (SELECT *, regexp_matches(e, '(^|[^0-9])' || v || '([^0-9]|$)') AS said FROM x)
SELECT conv_id, turn, known AND said AS grounded, CASE WHEN said THEN '' ELSE v END AS unsupported FROM y""",
    "evidence_rounds": f"""
WITH b AS (SELECT item_id AS clause, CASE WHEN len(list_filter(w, lambda x: length(x) >= 2)) > 0 THEN list_filter(w, lambda x: length(x) >= 2) ELSE w END AS w FROM (SELECT item_id, {TERMS} AS w FROM benchmark)),
t AS (SELECT doc_id AS item, unnest({TERMS}) AS token FROM documents),
asked AS (SELECT clause, 1 AS round, unnest(list_distinct(w)) AS token FROM b UNION ALL SELECT clause, 2, unnest(list_distinct(w[1:5])) FROM b),
hits AS (SELECT *, row_number() OVER (PARTITION BY clause, round ORDER BY n DESC, item) AS rank FROM (SELECT clause, round, item, count(*) AS n FROM t JOIN asked USING (token) GROUP BY ALL) QUALIFY rank <= 5),
kept AS (SELECT h.* FROM hits h LEFT JOIN embeddings a ON a.vec_id = clause AND len(a.embedding) = 64 LEFT JOIN embeddings i ON i.vec_id = item AND len(i.embedding) = 64
  WHERE a.vec_id IS NULL OR i.vec_id IS NULL OR list_cosine_similarity(a.embedding::DOUBLE[], i.embedding::DOUBLE[]) >= 0.02),
one AS (SELECT clause, item, 1 AS round, rank FROM kept WHERE round = 1),
two AS (SELECT clause, item, 2 AS round, rank FROM kept k WHERE round = 2 AND clause IN (SELECT clause FROM one) AND NOT EXISTS (SELECT 1 FROM one o WHERE o.clause = k.clause AND o.item = k.item))
SELECT clause, item, round::INTEGER AS round, row_number() OVER (PARTITION BY clause, round ORDER BY rank)::INTEGER AS place FROM (SELECT * FROM one UNION ALL SELECT * FROM two)""",
    "alias_resolve": "SELECT conv_id, coalesce(t[1]::VARCHAR, 'E1') || ',' || coalesce(t[2]::VARCHAR, 'E2') || ',' || coalesce(t[9]::VARCHAR, 'E9') || ',x' AS resolved FROM (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id)",
    "embedding_quality": "SELECT vec_id, coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64, false) AS usable FROM embeddings",
    "job_progress": f"WITH {_CHECKPOINTS} SELECT job, count(*) AS total, count(*) FILTER (status = 'complete') AS completed, count(*) FILTER (status = 'insufficient') AS insufficient, count(*) FILTER (status = 'queued') AS unreviewed FROM c GROUP BY job",
    "job_final_status": f"WITH {_CHECKPOINTS} SELECT job, CASE WHEN bool_and(status = 'complete') THEN 'complete' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partial' END AS status, CASE WHEN bool_and(status = 'failed') THEN 'error' END AS reason FROM c GROUP BY job",
    "pending_clauses": f"WITH {_CHECKPOINTS} SELECT job, clause FROM c WHERE status = 'queued'",
    "stale_jobs": "SELECT user_id AS job, event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-31 23:45:00'",
    "failed_mark": "SELECT CASE WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'failed' END AS status, CASE WHEN o_orderstatus <> 'F' THEN 'retries exhausted' END AS failure_reason, count(*) AS n FROM orders GROUP BY 1, 2",
    "review_history": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100",
    "job_filing": "SELECT o_orderkey, o_orderstatus, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "finding_evidence": "SELECT o_orderkey AS l_orderkey, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey), '') AS parts, count(l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "review_detail": "SELECT o_orderkey, any_value(c_name) AS c_name, any_value(o_orderstatus) AS o_orderstatus, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS findings FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "evidence_snapshot": "SELECT f.conv_id AS finding, f.rank::INTEGER AS rank, d.doc_id AS item, d.source FROM (SELECT conv_id, turn * 3 AS item, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations) f JOIN documents d ON d.doc_id = f.item WHERE d.lang = 'en'",
    "clause_order": "SELECT conv_id, string_agg('clause-' || turn, ',' ORDER BY turn) AS clauses FROM conversations GROUP BY conv_id",
    "report_lines": "SELECT conv_id, n::INTEGER AS line, (n // 46 + 1)::BIGINT AS page, sha256('《' || role || '》' || text) AS text_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)",
    "redact_payload": "SELECT event_id, array_to_string(list_sort(list_transform(json_keys(props), lambda k: k || '=' || CASE WHEN lower(k) IN ('api_key', 'authorization', 'password', 'token', 'k') THEN '[REDACTED]' ELSE json_extract_string(props, '$.\"' || k || '\"') END)), ',') AS payload FROM events",
    "constraint_violations": f"""WITH {KNOWLEDGE}
SELECT 'public documents have no tenant' AS rule, count(*) FILTER ((scope = 'public') <> (tenant_id IS NULL)) AS n FROM k
UNION ALL SELECT 'expiry is not before effect', count(*) FILTER (expiry_date < effective_date) FROM k
UNION ALL SELECT 'a document''s content is there once', count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)
UNION ALL SELECT 'line items have orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders have customers', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'discounts are shares', count(*) FILTER (NOT l_discount BETWEEN 0 AND 1) FROM lineitem
UNION ALL SELECT 'line numbers are there once', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
    "stream_checkpoint_state": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stream_dedupe_ingest": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type",
}
