"""DuckDB SQL for the registered queries that SQL can express.

The rest are tested otherwise: toxicity by held-out labels, near-duplicates and
line dedup against brute force, neighbour search by recall and exact scores,
packing and token files by exact round trips through the tokenizer.
"""

from __future__ import annotations

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
late AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM (SELECT doc_id, unnest(range(p, p + 20)) AS i FROM late) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
flags AS (SELECT doc_id, unnest(g) AS i FROM gone),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN flags USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
patterns AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM s)),
places AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM patterns))),
hits AS (SELECT doc_id, n, p, item_id FROM places JOIN patterns USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_MARKS = ("### System: ", "### User: ", "### Assistant: ", "### Other(", "</turn>")
_CLOSE = "' </turn>' || chr(10)"
_FOUND = " + ".join(f"(length(x) - length(replace(x, {m}, ''))) // {n}" for m, n in [*((f"'{m}'", len(m)) for m in _MARKS), (_CLOSE, 9), ("'\\'", 1)])
OP3 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))),
m AS (SELECT *, length(text) + {_FOUND} - 2 AS escaped FROM (SELECT *, text || {_CLOSE} AS x FROM c))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 13 + length(role) END + escaped + 9)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id"""


# kind, pattern, what confirms the match v; the two kinds of the method's own
# take a neighbour on either side into the match, for want of look-around
_D = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_D}) + 1), lambda j: CASE WHEN (length({_D}) - j) % 2 = 0 THEN {_D}[j]::INTEGER ELSE {_D}[j]::INTEGER * 2 - CASE WHEN {_D}[j]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_A = "regexp_replace(v, '[^A-Z0-9]', '', 'g')"
_MOD97 = f"list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(substr({_A}, 5) || substr({_A}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), ''), ''), lambda c: c::INTEGER), lambda a, b: (a * 10 + b) % 97) = 1"
_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda p: coalesce(try_cast(p AS HUGEINT) <= 255, false))) = 4"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_D}) BETWEEN 12 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_D}) BETWEEN 9 AND 15"),
    ("iban", r"(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?:$|[^A-Za-z0-9])", _MOD97),
    ("ssn", r"(?:^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?:$|[^0-9-])", "NOT regexp_matches(v, '(^|[^0-9])(000|666|9[0-9][0-9])-|-00-|-0000') AND regexp_matches(lower(substr(text, (greatest(a - 40, 0) + 1)::BIGINT, (a - greatest(a - 40, 0))::BIGINT)), 'ssn|social|security|tax')"),
)
_PARTS = " UNION ALL ".join(
    f"""SELECT doc_id, {k} AS no, '{name}' AS kind, a, b FROM (
  SELECT *, z0 + {f"regexp_matches(v, '^[^A-Za-z0-9]')::INTEGER" if k > 3 else "0"} AS a, z0 + length(v) - {f"regexp_matches(v, '[^A-Za-z0-9]$')::INTEGER" if k > 3 else "0"} AS b FROM (
    SELECT doc_id, text, m[i] AS v, list_sum(list_transform(s[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS z0 FROM (
      SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS s FROM t)))) WHERE {test}"""
    for k, (name, p, test) in enumerate(_PII)
)
_LISTED = "string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, no)"
OP7 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), x AS ({_PARTS})
SELECT t.doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in _PII[:4])}, sha256(coalesce({_LISTED} FILTER (no < 4), '')) AS base_sha256, coalesce({_LISTED}, '') AS spans
FROM t LEFT JOIN x USING (doc_id) GROUP BY t.doc_id"""


# leaves are compared as they are where the operator compares their hashes
_GAP, _WORD = r"[\x20\x09\x0B-\x0D]", r"[^\x20\x09-\x0D]"
_PHRASES = rf"list_distinct(regexp_extract_all({{}}, '{_GAP}*(?:{_WORD}*[^\x20\x09-\x0D.!?]{_GAP}+){{{{0,4}}}}{_WORD}+\x0A?|{_GAP}+\x0A?|\x0A'))"
_ROOT = "sha256(array_to_string(list_transform(string_split({}, chr(10) || chr(10)), lambda s: sha256(array_to_string(list_transform(string_split(s, chr(10)), lambda p: sha256(p)), ''))), ''))"
_LENGTH = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"


def _like(a: str, b: str) -> str:
    both = f"({_LENGTH.format(a)} + {_LENGTH.format(b)})"
    return f"CASE WHEN {both} = 0 THEN 1.0::DOUBLE ELSE 2 * {_LENGTH.format(f'list_intersect({a}, {b})')} / {both}::DOUBLE END"


OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next FROM d),
e AS (SELECT *, length(text) // 4 AS k, substr(text, 1, (length(text) - length(text) // 4)::BIGINT) || substr(next, 1, (length(text) // 4)::BIGINT) AS edited FROM n),
p AS (SELECT *, {_PHRASES.format("text")} AS a, {_PHRASES.format("edited")} AS b, {_PHRASES.format("next")} AS c FROM e)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_ROOT.format("text")} AS fingerprint, {_ROOT.format("edited")} AS edited_fingerprint,
  {_like("a", "b")} AS near_edited, {_like("a", "c")} AS near_next, {_LENGTH.format("list_intersect(a, b)")}::BIGINT AS common_chars FROM p"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM x GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM x SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p, 1 + (1000000000::HUGEINT * (kept.c + 1)) // (v.n + v.v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS s FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
  ON z.lang = a.lang AND z.source = a.source AND z.other = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE c > 0 AND p > q),
a AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM a) WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op11_fingerprints": OP11, "op12_divergence": OP12, "op1_substring_dedup": OP1, "op2_decontaminate": OP2, "op3_chat_format": OP3, "op7_pii": OP7}
