"""Document structure over ordered blocks: section paths, carried articles,
repeated margins, tables of contents, clauses, chunks and spans.

Blocks have doc and idx (their order within a document); windows run within a
document, which is the unit of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import article_number, is_page_number, is_toc_entry, squeezed, stripped

# fixed values: what headings, section titles and closing lines look like
CLAUSE_HEADING = "(?U)^(?:第\\s*[〇零一二三四五六七八九十百千万\\d]+\\s*条|[一二三四五六七八九十百]+、|\\d+(?:\\.\\d+)*[、.．]|\\d{1,3}(?:\\.\\d{1,3})+(?=\\s|$)|[（(]\\s*[一二三四五六七八九十百\\d]+\\s*[）)])"
TITLE_SUFFIX = "(?:基本情况|主要内容|概述|简介|介绍|情况|内容|背景|意义|目的|依据|范围|定义|原则|要求|安排|措施|方式|程序|条件|标准|约定|事项|风险|提示|影响|其他|附则|附件|文件|发售时间|发售方式|发售对象|违约责任|争议解决|对象|认购|申购|赎回|登记|发售|时间|地点|期限|当事人|份额|费用|税收|收益|分配|支付|交付|验收|保密|披露|清算|变更|终止|生效|转让|通知|效力|文本)$"
CLOSING_LINE = "(?U)^(?:特此公告[。．\\.]?|特此通知[。．\\.]?|董\\s*事\\s*会|监\\s*事\\s*会|《[^《》]{1,80}》|[\\u4e00-\\u9fff]{2,20}(?:股份有限公司|有限责任公司|集团有限公司|有限公司)|[〇零一二三四五六七八九十百\\d]+年\\d{1,2}月\\d{1,2}日|[二〇○两〇一二三四五六七八九十百\\d]+年[〇零一二三四五六七八九十百\\d]+月[〇零一二三四五六七八九十百\\d]+日)$"
LEVELS = 3
LEAST_CHARS, LEAST_TIMES = 4, 2  # of a margin line that repeats


def in_order(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)


def section_path(blocks: DataFrame, levels: int = LEVELS) -> DataFrame:
    """blocks with level (null for text) and text; adds path, the titles of the
    headings in force joined by " > ". A heading ends those of its level or deeper."""
    run = in_order("doc")
    last = {n: F.last(F.when(F.col("level") == n, F.struct("idx", "text")), ignorenulls=True).over(run) for n in range(1, levels + 1)}
    rows = blocks.select("*", *[v.alias(f"__h{n}") for n, v in last.items()])
    alive = []
    for n in last:
        h = F.col(f"__h{n}")
        ended = F.lit(False)
        for m in range(1, n):
            ended = ended | F.coalesce(F.col(f"__h{m}.idx") > h["idx"], F.lit(False))
        alive.append(F.when(h.isNotNull() & ~ended, h["text"]))
    return rows.withColumn("path", F.array_join(F.filter(F.array(*alive), lambda t: t.isNotNull()), " > ")).drop(*[f"__h{n}" for n in last])


def carried_article(blocks: DataFrame, keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Adds article: the last article number begun since the last heading.
    keys beyond doc (a page, say) also end it."""
    since = F.count(F.when(F.col("level").isNotNull(), 1)).over(in_order(*keys))
    rows = blocks.withColumn("__s", since).withColumn("__a", article_number(F.col("text")))
    run = Window.partitionBy(*keys, "__s").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("article", F.last("__a", ignorenulls=True).over(run)).drop("__s", "__a")


def runs_of(blocks: DataFrame, flag: Column, least: int = 2) -> DataFrame:
    """Runs of at least `least` consecutive blocks that have the flag: doc,
    first, last, n. Runs of article headings are a table of contents' noise."""
    order = Window.partitionBy("doc").orderBy("idx")
    rows = blocks.select("doc", "idx", F.coalesce(flag, F.lit(False)).alias("f"), F.row_number().over(order).alias("n")).where("f")
    island = F.col("n") - F.row_number().over(order)
    return rows.withColumn("g", island).groupBy("doc", "g").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("g")


def repeated_margins(lines: DataFrame, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES) -> DataFrame:
    """doc and norm (white space aside) of margin lines that repeat in a document."""
    return lines.where("in_margin").select("doc", squeezed(F.col("text")).alias("norm")).where(F.length("norm") >= least_chars).groupBy("doc", "norm").agg(F.count("*").alias("n")).where(F.col("n") >= least_times)


def without_margins(lines: DataFrame) -> DataFrame:
    """lines without the margin lines that repeat."""
    rows = lines.withColumn("__norm", squeezed(F.col("text")))
    gone = repeated_margins(lines).select("doc", F.col("norm").alias("__norm"), F.lit(True).alias("in_margin"))
    return rows.join(gone, ["doc", "__norm", "in_margin"], "left_anti").select(*lines.columns)


def without_contents(blocks: DataFrame, marker: str = "目录") -> DataFrame:
    """blocks (with page) after a table of contents: everything up to its
    marker goes, the rest of the marker's page, and the entries that follow."""
    at = blocks.where(squeezed(F.col("text")) == marker).groupBy("doc").agg(F.max(F.struct("idx", "page")).alias("m"))
    rows = blocks.join(at, "doc", "left").where(F.col("m").isNull() | ((F.col("idx") > F.col("m.idx")) & (F.col("page") != F.col("m.page"))))
    entry = F.col("m").isNotNull() & F.coalesce(is_toc_entry(F.col("text")), F.lit(False))
    begun = F.max(F.when(~entry, 1).otherwise(0)).over(in_order("doc"))
    return rows.withColumn("__b", begun).where("__b = 1").drop("__b", "m")


def is_section_title(text: Column) -> Column:
    """A short numbered heading that names a section and has no clause in it."""
    t = stripped(text)
    body = stripped(F.regexp_replace(t, CLAUSE_HEADING, ""))
    return t.rlike(CLAUSE_HEADING) & ~t.rlike("[：:，,。！？；;（）()]") & F.length(body).between(1, 25) & body.rlike(TITLE_SUFFIX)


def clauses(blocks: DataFrame) -> DataFrame:
    """Clauses of each document from blocks with kind and text: doc, clause_id,
    first (the first block's idx) and text.

    Documents with article headings are grouped by them: headings end a clause,
    and so do runs of article headings, which go; page numbers are passed over,
    and what no article heading precedes since the last end goes.
    Others are grouped by numbered headings, from the first section title on;
    documents with neither give one clause a block.
    """
    rows = blocks.where(F.length(stripped(F.col("text"))) > 0)
    article = (F.col("kind") == "article")
    noise = runs_of(rows, article).select("doc", F.explode(F.sequence("first", "last")).alias("idx"), F.lit(True).alias("__noise"))
    marked = rows.join(noise, ["doc", "idx"], "left").withColumn("__noise", F.coalesce("__noise", F.lit(False))).where(~F.coalesce(is_page_number(F.col("text")), F.lit(False)))
    by_article = _grouped(marked.withColumn("__cut", (F.col("kind") == "heading") | F.col("__noise")).withColumn("__start", article & ~F.col("__noise")), keep_lead=False)
    plain = rows.join(by_article.select("doc").distinct(), "doc", "left_anti").where(~F.coalesce(is_page_number(F.col("text")), F.lit(False)) & ~stripped(F.col("text")).rlike(CLOSING_LINE))
    numbered, title = stripped(F.col("text")).rlike(CLAUSE_HEADING), is_section_title(F.col("text"))
    whole = Window.partitionBy("doc")
    plain = plain.withColumn("__any", F.max(numbered.cast("int")).over(whole)).withColumn("__from", F.coalesce(F.min(F.when(title, F.col("idx"))).over(whole), F.min("idx").over(whole)))
    single = plain.where("__any = 0").select("doc", F.col("idx").alias("first"), "text")
    by_number = _grouped(plain.where("__any = 1 and idx >= __from").withColumn("__cut", (F.col("kind") == "heading") | title).withColumn("__start", numbered), keep_lead=True)
    out = by_article.unionByName(by_number).unionByName(single)
    n = F.row_number().over(Window.partitionBy("doc").orderBy("first"))
    return out.select("doc", F.concat(F.lit("clause-"), n.cast("string")).alias("clause_id"), "first", "text")


def _grouped(rows: DataFrame, keep_lead: bool) -> DataFrame:
    """Blocks between cuts and starts, joined by newlines; cut blocks go."""
    run = in_order("doc")
    numbered = rows.withColumn("__g", F.sum((F.col("__cut") | F.col("__start")).cast("int")).over(run))
    body = numbered.where("not __cut")
    parts = body.groupBy("doc", "__g").agg(F.min("idx").alias("first"), F.max("__start").alias("started"), F.sort_array(F.collect_list(F.struct("idx", stripped(F.col("text")).alias("t")))).alias("parts"))
    return parts.where(F.lit(keep_lead) | F.col("started")).select("doc", "first", F.array_join(F.col("parts.t"), "\n").alias("text"))


def child_parts(text: str, most: int) -> list[str]:
    """Lines packed into parts of at most `most` characters; a longer line is
    cut. Parts give the text again when joined. The packing of a line depends
    on what the lines before it left, hence a loop."""
    parts: list[str] = []
    room = 0
    for line in _newlines(text):
        if room < len(line) and parts and room < most:
            room = 0
        while line:
            if not room:
                parts.append("")
                room = most
            parts[-1] += line[:room]
            line, room = line[room:], max(0, room - len(line))
    return parts


def _newlines(text: str) -> list[str]:
    pieces = text.split("\n")
    return [p + "\n" for p in pieces[:-1]] + ([pieces[-1]] if pieces[-1] else [])


def chunked(blocks: DataFrame, most: int = 600) -> DataFrame:
    """Child chunks of blocks (doc, idx, text): doc, idx, part, start, text;
    start is the part's place in its block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, idx, text in zip(b["doc"], b["idx"], b["text"]):
                at = 0
                for k, part in enumerate(child_parts(text or "", most)):
                    rows.append((doc, idx, k, at, part))
                    at += len(part)
            yield pd.DataFrame(rows, columns=["doc", "idx", "part", "start", "text"])

    return blocks.select("doc", "idx", "text").mapInPandas(run, f"doc {dict(blocks.dtypes)['doc']}, idx {dict(blocks.dtypes)['idx']}, part int, start int, text string")


def placed(lines: DataFrame, gap: int = 1) -> DataFrame:
    """Adds start and end: each line's place when a document's lines are joined
    with gap characters between them."""
    before = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + gap).over(before), F.lit(0))
    return lines.withColumn("start", start).withColumn("end", start + F.length("text"))


def overlapping(spans: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """Spans and chunks of a document that overlap, with the overlap's start and
    end. chunks are width characters wide, so a span finds its own by number
    and the join is an equi-join."""
    own = spans.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / width))))
    c = chunks.select("doc", "chunk", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    return own.join(c, ["doc", "chunk"]).where("start < c_end and end > c_start").withColumn("from", F.greatest("start", "c_start")).withColumn("to", F.least("end", "c_end"))


def merged_locators(blocks: DataFrame, *keys: str) -> DataFrame:
    """One locator for the blocks (idx, page, article, paragraph) of each key: the
    pages from first to last, and the first article and paragraph in order that
    are known. Keys whose blocks know none have nulls."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("idx"))).alias(c)
    return blocks.groupBy(*keys).agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), first("article"), first("paragraph"))
