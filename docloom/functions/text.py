"""Column functions over texts: cleaning, headings, references, terms, numbers.

Patterns see Unicode white space and digits, as texts in CJK scripts need.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: numerals, heading marks and names in the texts
NUMBER = "(?:\\d+|[〇零一二三四五六七八九十百千万两]+)"
ARTICLE = f"第{NUMBER}条(?:之{NUMBER})?"
SECTION_LEVELS = {"编": 1, "篇": 1, "部": 1, "章": 2, "节": 3}
UNNUMBERED_SECTIONS = ("总则", "分则", "附则", "通则", "序言", "前言")
PROSE_MARKS = "[。！？；：，,;:!?]"
PART_PROSE = "说明|规定|约定|包括|是指|如下|正文"
PAGE_NUMBER = "(?iU)^(?:[-–—·•.]?\\s*\\d{1,4}\\s*[-–—·•.]?|[-–—·•.]?\\s*\\d{1,4}\\s*[-–—]\\s*\\d{1,4}\\s*[-–—·•.]?|第\\s*\\d{1,4}\\s*页|第\\s*\\d{1,4}\\s*[-–—]\\s*\\d{1,4}\\s*页|[-–—·•.]?\\s*\\d{1,4}\\s*/\\s*\\d{1,4}\\s*[-–—·•.]?|page\\s*\\d{1,4})$"
TOC_ENTRY = "(?U)(?:[\\.．·•]{3,}|…{3,}|^第[^。\\n]{1,60}(?:部分|章|节|编|篇).{0,80}\\s+\\d{1,4}-\\d{1,4}\\s*$)"
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
SECTION_UNITS = {"万": 10_000, "亿": 100_000_000}
WORD = "[A-Za-z0-9_]+|[\\u3400-\\u9fff]+"


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def squeezed(text: Column) -> Column:
    """Without any Unicode white space."""
    return F.regexp_replace(text, "(?U)\\s+", "")


def article_number(text: Column) -> Column:
    """The article number that a text begins with, else null. Texts
    without the character of articles are not looked at further."""
    return F.when(F.contains(text, F.lit("条")), F.nullif(F.regexp_extract(stripped(text), f"(?U)^({ARTICLE})", 1), F.lit("")))


def article_references(text: Column) -> Column:
    """Article numbers anywhere in a text, white space aside, first seen first."""
    return F.array_distinct(F.regexp_extract_all(squeezed(F.coalesce(text, F.lit(""))), F.lit(f"(?U)({ARTICLE})"), F.lit(1)))


def heading_level(text: Column) -> Column:
    """1 to 3 for part, chapter and section headings, else null."""
    t = stripped(text)
    part = F.regexp_extract(t, f"(?U)^第{NUMBER}部分(.*)$", 1)
    title = stripped(part)
    part_fits = (F.length(part) == 0) | ((F.length(title).between(1, 40)) & ~title.rlike(PROSE_MARKS) & ~title.rlike(PART_PROSE))
    section = f"(?U)^第{NUMBER}(?:分)?([编篇部章节])(.*)$"
    mark, rest = F.regexp_extract(t, section, 1), F.regexp_extract(t, section, 2)
    fits = (F.length(rest) == 0) | (rest.rlike("(?U)^\\s") & (F.length(stripped(rest)) > 0) & ~stripped(rest).rlike(PROSE_MARKS))
    level = F.coalesce(*[F.when(mark == m, n) for m, n in SECTION_LEVELS.items()])
    return F.when(t.rlike(f"(?U)^第{NUMBER}部分"), F.when(part_fits, 1)).when(mark != "", F.when(fits, level)).when(squeezed(t).isin(*UNNUMBERED_SECTIONS), 2)


def may_have_heading(text: Column) -> Column:
    """Whether any line of a text can be a heading: it has a character that headings begin with."""
    return text.rlike("[" + "".join(sorted({"第", *(s[0] for s in UNNUMBERED_SECTIONS)})) + "]")


def is_page_number(text: Column) -> Column:
    return stripped(text).rlike(PAGE_NUMBER)


def is_toc_entry(text: Column) -> Column:
    return stripped(text).rlike(TOC_ENTRY)


def word_tokens(text: Column) -> Column:
    """Lower-cased words; a run of CJK characters also gives each of them. Texts
    without any are not searched for them word by word."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.when(~text.rlike("[\\u3400-\\u9fff]"), words).otherwise(F.flatten(F.transform(words, lambda w: F.when(w.rlike("^[\\u3400-\\u9fff]"), F.concat(F.array(w), F.filter(F.split(w, ""), lambda c: c != ""))).otherwise(F.array(w)))))


def search_terms(text: Column) -> Column:
    """Words of two characters or more; all words if there are none."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    long_ = F.filter(words, lambda w: F.length(w) >= 2)
    return F.when(F.size(long_) > 0, long_).otherwise(words)


def numeral_value(text: Column) -> Column:
    """The number that a CJK numeral means: by place if it has no unit, else by
    units; null for anything else."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    lookup = lambda table, c: F.coalesce(*[F.when(c == k, F.lit(v).cast("long")) for k, v in table.items()])
    digits = F.array_join(F.transform(chars, lambda c: lookup(DIGITS, c).cast("string")), "")

    def step(a: Column, c: Column) -> Column:
        digit, unit, section = lookup(DIGITS, c), lookup(UNITS, c), lookup(SECTION_UNITS, c)
        made = lambda total, part, number: F.struct(total.alias("total"), part.alias("part"), number.alias("number"))
        zero = F.lit(0).cast("long")
        return F.when(digit.isNotNull(), made(a["total"], a["part"], digit)).when(unit.isNotNull(), made(a["total"], a["part"] + F.when(a["number"] == 0, 1).otherwise(a["number"]) * unit, zero)).otherwise(made(a["total"] + (a["part"] + a["number"]) * section, zero, zero))

    zero = F.lit(0).cast("long")
    by_units = F.aggregate(chars, F.struct(zero.alias("total"), zero.alias("part"), zero.alias("number")), step, lambda a: a["total"] + a["part"] + a["number"])
    return F.when(text.rlike("^[零〇一二两三四五六七八九]+$"), digits.cast("long")).when(text.rlike("^[零〇一二两三四五六七八九十百千万亿]+$"), by_units)


# 亿 is a unit, but runs of numerals inside a text do not take it in
NUMERAL_RUN = "[零〇一二三四五六七八九十百千万两]+"


def with_plain_numbers(text: Column) -> Column:
    """A text with its CJK numerals written as digits."""
    runs = F.regexp_extract_all(text, F.lit(NUMERAL_RUN), F.lit(0))
    between = F.split(text, NUMERAL_RUN, -1)
    values = F.transform(runs, lambda r: numeral_value(r).cast("string"))
    return F.array_join(F.zip_with(between, values, lambda b, v: F.concat(b, F.coalesce(v, F.lit("")))), "")


def grounding_values(text: Column) -> Column:
    """Dates, percentages and numbers that a text states, in this order, each
    once; numbers that only mark list items are left out."""
    found = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda v: F.replace(v, F.lit(" "), F.lit("")))
    numbers = "(?U)\\d++(?:\\.\\d+)?+(?![、)\\]）]|\\.(?!\\d))"
    return F.array_distinct(F.concat(found("(?U)\\d{4}\\s*年\\s*\\d{1,2}\\s*月\\s*\\d{1,2}\\s*日"), found("(?U)\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}"), found("(?U)\\d+(?:\\.\\d+)?\\s*%"), found(numbers)))


def is_stated(evidence: Column, value: Column) -> Column:
    """Whether evidence holds a value: numbers only between non-digits."""
    number = F.rlike(evidence, F.concat(F.lit("(?U)(?<!\\d)"), F.replace(value, F.lit("."), F.lit("\\.")), F.lit("(?!\\d)")))
    return F.when(value.rlike("(?U)^\\d+(?:\\.\\d+)?$"), number).otherwise(F.contains(evidence, value))


def deterministic_uuid(*parts: Column) -> Column:
    """A version 8 UUID from the SHA-256 of the parts as a JSON list."""
    return uuid_of_json(F.to_json(F.array(*parts)))


def uuid_of_json(text: Column) -> Column:
    """A version 8 UUID from the SHA-256 of a text."""
    h = F.sha2(text.cast("binary"), 256)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    piece = lambda at, n: F.substring(h, at, n)
    return F.concat(piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-8"), piece(14, 3), F.lit("-"), variant, piece(18, 3), F.lit("-"), piece(21, 12))
