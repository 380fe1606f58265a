"""Ordered rules over texts: queries that keywords call for, and what a law says of itself.

A rule set is a small ordered list, carried in the plan as one array; a text is
matched against it in one pass, and what matched keeps its rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import stripped

MOST_QUERIES = 8

# fixed values: a keyword of a clause, and the queries it calls for
DOMAIN_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("联合体", ("联合体 共同投标协议 明确约定各方拟承担的工作和责任 连带责任 政府采购法 第二十四条", "联合体 共同投标协议 明确约定各方拟承担的工作和责任 连带责任 招标投标法 第三十一条")),
    ("生效", ("合同 成立 生效 签字 盖章 按指印 民法典 第四百九十条 第五百零二条",)),
    ("履行期限", ("合同 履行期限 约定不明确 协议补充 交易习惯 民法典 第五百一十条", "合同 履行期限 不明确 随时履行 必要准备时间 民法典 第五百一十一条", "迟延履行 违约责任 继续履行 赔偿损失 民法典 第五百七十七条")),
    ("不可抗力", ("不可抗力 免责 通知义务 合理期限 证明 民法典 第一百八十条 第五百九十条",)),
    ("违约", ("违约责任 违约金 继续履行 采取补救措施 赔偿损失 民法典 第五百七十七条 第五百八十五条",)),
    ("付款", ("价款 报酬 支付 约定不明确 履行地 市场价格 民法典 第五百一十条 第五百一十一条",)),
    ("争议", ("合同纠纷 诉讼 仲裁 管辖 争议解决方式 民事诉讼法 第三十四条",)),
    ("质量", ("质量标准 约定不明确 强制性国家标准 推荐性国家标准 行业标准 民法典 第五百一十一条",)),
)

# fixed values: how laws are named, who issues them, and how they say when they apply
LAW_SUFFIXES = ("法", "条例", "规定", "办法", "规则", "细则", "决定", "解释", "法典", "宪法", "通则", "纲要", "公约", "章程")
_CENTRAL = "全国人民代表大会常务委员会|全国人民代表大会|国务院|最高人民法院|最高人民检察院"
_BODY = "[\\u4e00-\\u9fa5]{2,20}(?:人民法院|人民检察院|人民政府|委员会|大会|政府|办公室|部|厅|局|署|办)"
AUTHORITY_PATTERNS = (
    ("(?U)(?:发布|公布|制定|主管)机关(?:名称)?[:：]\\s*([^\\s，。；、（）()]{2,60})", 1),
    (f"(?U)(?:\\d{{4}}年\\d{{1,2}}月\\d{{1,2}}日\\s*)?((?:第[一二三四五六七八九十百\\d]+届)?(?:{_CENTRAL}|{_BODY}))[^（）]*?(?:会议通过|通过|批准|公布)", 1),
    (f"(?U)({_BODY}|{_CENTRAL})(?:令|公告|批复|通知)", 1),
    (f"({_CENTRAL})", 1),
)
SESSION = "(?U)^第[一二三四五六七八九十百\\d]+届"
EFFECT_PATTERNS = (
    "(?U)自\\s*(\\d{4})年\\s*(\\d{1,2})月\\s*(\\d{1,2})日\\s*起\\s*(?:施行|实施|生效)",
    "(?U)(?:施行|实施|生效)(?:日期|时间)?\\s*[:：]\\s*(\\d{4})年\\s*(\\d{1,2})月\\s*(\\d{1,2})日",
    "(?U)(\\d{4})年\\s*(\\d{1,2})月\\s*(\\d{1,2})日\\s*起\\s*(?:施行|实施|生效)",
    "(?U)(\\d{4})年\\s*(\\d{1,2})月\\s*(\\d{1,2})日\\s*(?:施行|实施)",
)
STRUCTURAL = "^(?:第[\\d一二三四五六七八九十百千]+[编篇章条款节]|附则|目录)"
PAGE_MARK = "(?U)^(?:第\\s*\\d+\\s*页|[-—]?\\s*\\d+\\s*[-—]?|\\d+)$"
DATED = "(?U)(?:\\d{1,4}年\\s*\\d{1,2}月\\s*\\d{1,2}日|通过|发布|公布)"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def matched(text: Column, rules: Sequence[tuple[str, Sequence[str]]] = DOMAIN_RULES) -> Column:
    """The rules whose keyword a text holds: an array of rank (from 1), keyword and queries, in order."""
    if not rules:
        raise ValueError("there are no rules")
    book = F.array(*[F.struct(F.lit(n).alias("rank"), F.lit(k).alias("keyword"), F.array(*[F.lit(q) for q in qs]).alias("queries")) for n, (k, qs) in enumerate(rules, 1)])
    return F.filter(book, lambda r: F.contains(F.coalesce(text, F.lit("")), r["keyword"]))


def expanded(text: Column, rules: Sequence[tuple[str, Sequence[str]]] = DOMAIN_RULES) -> Column:
    """The queries that a text calls for, each once, in the order of the rules."""
    return F.array_distinct(F.flatten(F.transform(matched(text, rules), lambda r: r["queries"])))


def combined(text: Column, model_queries: Column, rules: Sequence[tuple[str, Sequence[str]]] = DOMAIN_RULES, most: int = MOST_QUERIES) -> Column:
    """A model's queries (null where it failed) and then the rules', stripped,
    each once, without empty ones and the text itself, the first `most`."""
    both = F.concat(F.coalesce(model_queries, F.array().cast("array<string>")), expanded(text, rules))
    plain = F.transform(both, lambda q: stripped(q))
    return F.slice(F.array_distinct(F.filter(plain, lambda q: (q != "") & (q != stripped(F.coalesce(text, F.lit("")))))), 1, most)


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def without_space(text: Column) -> Column:
    """Without white space, the ideographic one too."""
    return F.regexp_replace(text, "(?U)[\\s\\u3000]+", "")


def is_structural(line: Column) -> Column:
    return without_space(line).rlike(STRUCTURAL)


def _is_law(text: Column) -> Column:
    return reduce(Column.__or__, [text.endswith(s) for s in LAW_SUFFIXES])


def is_plausible_title(line: Column) -> Column:
    bare = without_space(line)
    return F.length(bare).between(2, 60) & ~is_structural(line) & ~bare.rlike(PAGE_MARK) & bare.rlike("[\\u4e00-\\u9fa5]") & ~line.rlike("^[（(【《]") & ~line.rlike(DATED)


def filename_title(name: Column) -> Column:
    """A file's name without folder, suffix and a date behind an underscore."""
    stem = F.regexp_replace(F.regexp_replace(name, "^.*/", ""), "(?<=.)\\.[^.]*$", "")
    return stripped(F.regexp_replace(stem, "_[0-9]{8}$", ""))


def effective_date(text: Column) -> Column:
    """The day from which a text says it applies, by the first pattern that is
    there, as YYYY-MM-DD; whether there is such a day is left to who reads it as one."""
    padded = lambda p: F.concat_ws("-", F.lpad(F.regexp_extract(text, p, 1), 4, "0"), F.lpad(F.regexp_extract(text, p, 2), 2, "0"), F.lpad(F.regexp_extract(text, p, 3), 2, "0"))
    return F.coalesce(*[F.when(text.rlike(p), padded(p)) for p in EFFECT_PATTERNS])


def issuing_authority(text: Column) -> Column:
    """Who issued a text, by the first pattern that is there."""
    label, enacted, decree, central = AUTHORITY_PATTERNS
    return F.coalesce(stripped(_first(text, *label)), F.when(_first(text, *enacted).isNotNull(), F.regexp_replace(stripped(_first(text, *enacted)), SESSION, "")), stripped(_first(text, *decree)), _first(text, *central))


def law_metadata(rows: DataFrame) -> DataFrame:
    """rows (filename, text): adds title, issuing_authority, effective_date (as
    text), effective_day (null where there is no such day), version and
    source_type, null where nothing says so. The title is the first line that
    ends as laws are named, else the first that can be one, else the file's name."""
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(text, LINE_END, -1), lambda x: stripped(x))
    named = F.filter(lines, lambda x: F.length(without_space(x)).between(2, 60) & ~is_structural(x) & _is_law(without_space(x)))
    plausible = F.filter(lines, is_plausible_title)
    title = F.coalesce(F.get(named, 0), F.get(plausible, 0), F.nullif(filename_title(F.col("filename")), F.lit("")))
    dated = _first(text, "(?U)(\\d{4}年\\d{1,2}月\\d{1,2}日)", 1)
    out = rows.withColumns({"title": title, "issuing_authority": issuing_authority(text), "effective_date": effective_date(text), "version": F.coalesce(_first(F.col("filename"), "_([0-9]{8})", 1), dated)})
    return out.withColumns({"effective_day": F.try_to_date("effective_date", "yyyy-MM-dd"), "source_type": F.when(_is_law(F.col("title")), "law")})
