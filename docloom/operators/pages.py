"""Lines of pages to blocks of documents.

Lines (doc, page, block, line, text, page_height, x0, top, x1, bottom) come from
any reader of pages. Page numbers, entries of tables of contents and margin
lines that repeat go; the rest of a block is cut where headings stand and
articles begin; a table of contents takes all before it and its own entries.
Everything is windows over a document's lines, which the limits bound, so lines
are shuffled once, by their document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import article_number, heading_level, is_page_number, is_toc_entry, squeezed, stripped
from docloom.operators.structure import LEAST_CHARS, LEAST_TIMES, carried_article, section_path

MARGIN = 0.15  # of a page's height, above and below
CONTENTS = "目录"
BOX = ("x0", "top", "x1", "bottom")


@dataclass(frozen=True)
class PageLimits:
    pages: int = 500
    blocks: int = 20_000
    lines: int = 100_000
    characters: int = 5_000_000


def in_margin(top: Column, bottom: Column, height: Column) -> Column:
    """Whether a line lies in the upper or lower band of its page."""
    return (top <= height * MARGIN) | (bottom >= height * (1 - MARGIN))


def _has_text(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?U)\\S")


def body_lines(lines: DataFrame) -> DataFrame:
    """Lines without blank ones, page numbers, entries of contents and repeated margins."""
    said = lines.where(_has_text(F.col("text")) & ~is_page_number(F.col("text")))
    said = said.withColumn("__m", in_margin(F.col("top"), F.col("bottom"), F.col("page_height")))
    # the text of a margin line that may repeat, white space aside; other lines have none
    said = said.withColumn("__norm", F.when(F.col("__m"), squeezed(F.col("text")))).withColumn("__norm", F.when(F.length("__norm") >= LEAST_CHARS, F.col("__norm")))
    times = F.count("__norm").over(Window.partitionBy("doc", "__norm"))
    kept = said.withColumn("__times", times).where((F.col("__times") < LEAST_TIMES) & ~is_toc_entry(F.col("text")))
    return kept.drop("__m", "__norm", "__times")


def segments(lines: DataFrame) -> DataFrame:
    """Lines of a page's block as segments: a heading is one, an article begins
    one, other lines go on. doc, idx (in the document), page, text, bboxes."""
    of_block = Window.partitionBy("doc", "page", "block").orderBy("line")
    heads = heading_level(F.col("text")).isNotNull()
    rows = lines.withColumn("__head", heads)
    starts = F.col("__head") | article_number(F.col("text")).isNotNull() | F.coalesce(F.lag("__head").over(of_block), F.lit(True))
    rows = rows.withColumn("__s", starts).withColumn("seg", F.sum(F.col("__s").cast("int")).over(of_block.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("line", "text", F.struct(*[F.col(c).cast("double").alias(c) for c in BOX]).alias("box"))))
    joined = rows.groupBy("doc", "page", "block", "seg").agg(parts.alias("p"))
    order = Window.partitionBy("doc").orderBy("page", "block", "seg")
    return joined.select("doc", F.row_number().over(order).alias("idx"), "page", F.array_join("p.text", "\n").alias("text"), F.col("p.box").alias("bboxes"))


def with_contents_marked(rows: DataFrame) -> DataFrame:
    """segments with skipped (a table of contents and its entries) and cleared
    (what stands before the last table of contents).

    A marker opens a table, which lasts to the end of its page and over the
    entries that follow; another marker on that page is part of it."""
    run = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    marker = squeezed(F.col("text")) == CONTENTS
    rows = rows.withColumn("__m", F.when(marker, F.struct("idx", "page")))
    rows = rows.withColumn("__last", F.last("__m", ignorenulls=True).over(run))
    outside = F.col("__last").isNotNull() & (F.col("page") != F.col("__last.page")) & ~is_toc_entry(F.col("text"))
    since = Window.partitionBy("doc", "__last.idx").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("skipped", F.col("__last").isNotNull() & ~F.max(F.coalesce(outside, F.lit(False))).over(since))
    whole = Window.partitionBy("doc")
    return rows.withColumn("cleared", F.coalesce(F.col("idx") < F.max("__m.idx").over(whole), F.lit(False))).drop("__m", "__last")


def page_blocks(lines: DataFrame, limits: PageLimits | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks and rejects of lines. Blocks: doc, idx, block_id, text, block_type
    (heading, article or paragraph), level, article (carried to the page's end or
    the next heading), section_title, page_start, page_end, paragraph_index (from
    1 on each page) and bboxes. Rejects: doc and reason; a document over a limit
    or without a block has no blocks. Headings before a table of contents stay in
    force after it, as in its pages."""
    limits = limits or PageLimits()
    sizes = lines.groupBy("doc").agg(F.max("page").alias("p"), F.count_distinct("page", "block").alias("b"), F.count("*").alias("l"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("c"))
    over = F.when(F.col("p") > limits.pages, "too many pages").when(F.col("b") > limits.blocks, "too many blocks").when(F.col("l") > limits.lines, "too many lines").when(F.col("c") > limits.characters, "too many characters")
    judged = sizes.select("doc", over.alias("reason"))
    fine = lines.repartition("doc").join(judged.where("reason is null").select("doc"), "doc", "left_semi")
    seen = with_contents_marked(segments(body_lines(fine))).where("not skipped")
    seen = seen.withColumn("level", heading_level(F.col("text")))
    placed = section_path(carried_article(seen, ("doc", "page"))).where("not cleared")
    number = F.row_number().over(Window.partitionBy("doc", "page").orderBy("idx"))
    kind = F.when(F.col("level").isNotNull(), "heading").when(article_number(F.col("text")).isNotNull(), "article").otherwise("paragraph")
    placed = placed.withColumns({"paragraph_index": number, "block_type": kind})
    block_id = F.sha2(F.concat_ws("|", "doc", F.lit("pdf"), F.concat(F.lit("page:"), F.col("page").cast("string")), F.concat(F.lit("paragraph:"), F.col("paragraph_index").cast("string")), F.concat(F.lit("type:"), "block_type")), 256)
    blocks = placed.select("doc", "idx", block_id.alias("block_id"), "text", "block_type", "level", "article", F.nullif("path", F.lit("")).alias("section_title"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), "paragraph_index", "bboxes")
    without = judged.where("reason is null").join(blocks.select("doc").distinct(), "doc", "left_anti").select("doc", F.lit("no usable text").alias("reason"))
    return blocks, judged.where("reason is not null").unionByName(without)
