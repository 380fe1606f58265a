"""Answers of models as JSON: parsed, cleaned and checked; payloads redacted.

Answers are VARIANT values, which take any JSON once parsed; fields are read by
path, whatever is wrong with an answer is a reason in `problems`, and a row with
reasons has no cleaned values. Nested payloads are redacted in their rows, as
compact JSON, in which a secret key's value is found by its brackets.
"""

from __future__ import annotations

import re
from json import dumps

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import stripped

# fixed values: what is secret, and what stands for it; the reason of a rejection without one; limits
SECRET_KEYS = ("api_key", "authorization", "password", "token")
REDACTED = "[REDACTED]"
NO_REASON = "该证据与本条款审核不直接相关"
MOST_QUERIES, MOST_QUERY_CHARS = 8, 512
RISKS = ("high", "medium", "low")
TRUE, FALSE = ("true", "1", "yes", "on", "t", "y"), ("false", "0", "no", "off", "f", "n")


def parsed(answer: Column) -> Column:
    """An answer as a VARIANT; null for what is not JSON, and for null."""
    return F.try_parse_json(stripped(answer))


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID for null, another type, or null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z_]+", 0)


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _said(item: Column) -> Column:
    """An item of a list as text: null and truth values by their names."""
    text = F.try_variant_get(item, "$", "string")
    return F.when(kind(item) == "VOID", F.lit("None")).when(kind(item) == "BOOLEAN", F.initcap(text)).otherwise(text)


def texts(value: Column) -> Column:
    """A list of texts, stripped and without empty ones: null is none, a text is
    a list of one, and anything but a list is null."""
    empty = F.array().cast("array<string>")
    listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), _said)
    single = F.array(F.try_variant_get(value, "$", "string"))
    found = F.when(value.isNull() | (kind(value) == "VOID"), empty).when(kind(value) == "STRING", single).when(kind(value) == "ARRAY", listed)
    return F.filter(F.transform(found, stripped), lambda x: x != "")


def reasons(value: Column) -> Column:
    """Rejected items with reasons: an object as it is, a list with a standing
    reason for each, null as none; anything else, and reasons that are no texts, null."""
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    given = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    whole = F.forall(given, lambda e: kind(e["value"]) == "STRING")
    as_map = F.when(whole, F.map_from_entries(F.transform(given, lambda e: F.struct(e["key"].alias("key"), stripped(F.try_variant_get(e["value"], "$", "string")).alias("value")))))
    names = F.array_distinct(F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: stripped(_said(x))), lambda x: x != ""))
    return F.when(value.isNull() | (kind(value) == "VOID"), nothing).when(kind(value) == "OBJECT", as_map).when(kind(value) == "ARRAY", F.map_from_arrays(names, F.transform(names, lambda _: F.lit(NO_REASON))))


def truth(value: Column) -> Column:
    """A truth value, also from the words and digits for one; else null."""
    word = F.lower(F.try_variant_get(value, "$", "string"))
    return F.when(kind(value).isin("BOOLEAN", "STRING", "BIGINT"), F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False))


def _told(rows: DataFrame, answer: str, fields: dict[str, Column], problems: list[Column]) -> DataFrame:
    """rows with fields, null where problems has any reason."""
    v = F.col("__v")
    all_ = [F.when(v.isNull(), "not JSON").when(kind(v) != "OBJECT", "not an object"), *problems]
    found = rows.withColumn("__v", parsed(F.col(answer))).withColumns({f"__{k}": c for k, c in fields.items()})
    found = found.withColumn("problems", F.array_compact(F.array(*all_)))
    fine = F.size("problems") == 0
    return found.select(*rows.columns, *[F.when(fine, F.col(f"__{k}")).alias(k) for k in fields], "problems")


def _unknown(answer: str, *known: str) -> Column:
    """A reason if an object has other keys."""
    more = F.array_except(F.json_object_keys(stripped(F.col(answer))), F.array(*[F.lit(k) for k in known]))
    return F.when((kind(F.col("__v")) == "OBJECT") & (F.size(more) > 0), "unknown field")


def decisions(rows: DataFrame, answer: str) -> DataFrame:
    """Judgements of evidence: sufficient, missing_points, follow_up_queries,
    usable_evidence_ids, rejected_evidence (a map). Enough evidence names some,
    and a rejection has a reason."""
    v = F.col("__v")
    lists = ("missing_points", "follow_up_queries", "usable_evidence_ids")
    fields = {"sufficient": truth(field(v, "sufficient")), **{c: texts(field(v, c)) for c in lists}, "rejected_evidence": reasons(field(v, "rejected_evidence"))}
    is_object = kind(v) == "OBJECT"
    problems = [
        _unknown(answer, *fields),
        F.when(is_object & F.col("__sufficient").isNull(), "sufficient is no truth value"),
        *[F.when(is_object & F.col(f"__{c}").isNull(), f"{c} is no list") for c in lists],
        F.when(is_object & F.col("__rejected_evidence").isNull(), "rejected_evidence is no map or list"),
        F.when(F.col("__sufficient") & (F.size("__usable_evidence_ids") == 0), "sufficient evidence needs usable evidence"),
        F.when(F.exists(F.map_values("__rejected_evidence"), lambda r: r == ""), "rejected evidence needs a reason"),
    ]
    return _told(rows, answer, fields, problems)


def expansions(rows: DataFrame, answer: str) -> DataFrame:
    """Expanded queries: distinct, none empty or over 512 characters, eight at most, one at least."""
    v = F.col("__v")
    short = F.filter(texts(field(v, "queries")), lambda q: F.length(q) <= MOST_QUERY_CHARS)
    queries = F.when(kind(field(v, "queries")) == "ARRAY", F.slice(F.array_distinct(short), 1, MOST_QUERIES))
    is_object = kind(v) == "OBJECT"
    given = field(v, "queries").isNotNull()
    return _told(rows, answer, {"queries": queries}, [_unknown(answer, "queries"), F.when(is_object & given & F.col("__queries").isNull(), "queries is no list"), F.when(is_object & (~given | (F.size("__queries") == 0)), "no queries")])


def reviews(rows: DataFrame, answer: str) -> DataFrame:
    """Decisions about drafts: decision (pass, revise, reject), unsupported_fields, evidence_gap, feedback."""
    v = F.col("__v")
    gap, said = field(v, "evidence_gap"), field(v, "feedback")
    fields = {
        "decision": F.when(kind(field(v, "decision")) == "STRING", stripped(F.try_variant_get(v, "$.decision", "string"))),
        "unsupported_fields": F.when(field(v, "unsupported_fields").isNull() | (kind(field(v, "unsupported_fields")) == "ARRAY"), texts(field(v, "unsupported_fields"))),
        "evidence_gap": F.when(gap.isNull(), False).otherwise(truth(gap)),
        "feedback": F.when(said.isNull(), "").when(kind(said) == "STRING", stripped(F.try_variant_get(v, "$.feedback", "string"))),
    }
    is_object = kind(v) == "OBJECT"
    wrong = lambda test, reason: F.when(is_object & test, reason)
    return _told(rows, answer, fields, [_unknown(answer, *fields), wrong(~F.coalesce(F.col("__decision").isin("pass", "revise", "reject"), F.lit(False)), "unknown decision"), wrong(F.col("__unsupported_fields").isNull(), "unsupported_fields is no list"), wrong(F.col("__evidence_gap").isNull(), "evidence_gap is no truth value"), wrong(F.col("__feedback").isNull(), "feedback is no text")])


FINDING = ("title", "risk_level", "problem", "reason", "suggestion", "proposed_clause")


def findings(rows: DataFrame, answer: str) -> DataFrame:
    """Drafts: findings, an array of structs of texts and evidence_ids. Each has
    all its texts, a known risk and one piece of evidence at least."""
    v = F.col("__v")
    given = field(v, "findings")
    one = lambda f: F.struct(*[stripped(F.when(kind(field(f, c)) == "STRING", F.try_variant_get(f, f"$.{c}", "string"))).alias(c) for c in FINDING], F.when(kind(field(f, "evidence_ids")) == "ARRAY", texts(field(f, "evidence_ids"))).alias("evidence_ids"))
    made = F.when(given.isNull(), F.array().cast(f"array<struct<{','.join(f'{c}:string' for c in FINDING)},evidence_ids:array<string>>>")).otherwise(F.transform(F.try_variant_get(given, "$", "array<variant>"), one))
    some = lambda test: F.exists("__findings", test)
    is_object = kind(v) == "OBJECT"
    lacking = lambda f: F.exists(F.array(*[f[c] for c in FINDING]), lambda x: x.isNull())
    return _told(rows, answer, {"findings": made}, [_unknown(answer, "findings"), F.when(is_object & F.col("__findings").isNull(), "findings is no list"), F.when(some(lacking), "a finding lacks a text"), F.when(some(lambda f: ~f["risk_level"].isin(*RISKS)), "unknown risk"), F.when(some(lambda f: F.coalesce(F.size(f["evidence_ids"]), F.lit(0)) < 1), "a finding without evidence")])


_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[][{}]', re.S)
_PLAIN = re.compile(r"[^],}]*")


def _value_end(json: str, at: int) -> int:
    """Where the value ends that begins at `at` of compact JSON."""
    if json[at] not in '"[{':
        return _PLAIN.match(json, at).end()
    depth = 0
    for m in _TOKEN.finditer(json, at):
        depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(m[0], 0)
        if depth == 0:
            return m.end()
    raise ValueError("no JSON")


def _blotted(json: str, named: re.Pattern, keys: set[str]) -> str:
    """Compact JSON with the values of keys blotted out, in one pass. A quote
    after a brace or comma and without a backslash begins a key or a text of a list."""
    out, done, at = [], 0, 0
    while m := named.search(json, at):
        at = m.end()
        if m[1].lower() in keys:
            out += [json[done:at], f'"{REDACTED}"']
            done = at = _value_end(json, at)
    return "".join(out) + json[done:]


def redacted(rows: DataFrame, payload: str, keys: tuple[str, ...] = SECRET_KEYS) -> DataFrame:
    """rows with payload (JSON) in which the values of secret keys, letter case
    aside, are blotted out at any depth, in objects and lists. Keys of objects
    come out in order of their names; null and what is not JSON as null.

    A payload is made compact JSON by way of a VARIANT, which also undoes
    escapes in keys, and only one with a secret key is looked through, in its
    row: nothing is shuffled or written.
    """
    spelt = [dumps(k, ensure_ascii=False)[1:-1] for k in keys]
    named = '[{,]"(' + "|".join(re.escape(k) for k in spelt) + ')":'
    pattern, wanted = re.compile(named, re.I), set(spelt)

    @F.pandas_udf("string")
    def blot(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _blotted(t, pattern, wanted), na_action="ignore")

    plain = F.col("__plain")
    held = rows.withColumn("__plain", F.to_json(F.try_parse_json(payload)))
    return held.withColumn(payload, F.coalesce(blot(F.when(plain.rlike("(?iu)" + named), plain)), plain)).select(*rows.columns)
