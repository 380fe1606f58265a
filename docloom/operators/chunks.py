"""Chunk plans: blocks of documents as parent chunks with child chunks.

Blocks (doc, idx, block_id, text, and the locator columns article, section_title,
page_start, page_end, paragraph_index, bboxes) become groups: a block that is an
article header and nothing else takes the blocks of its article that follow into
one group, any other block is a group of its own. A group is a parent chunk; its
children are cut by packing lines, with the header kept beside the text after
it, and join up to the parent's text exactly.

Groups are windows over a document's blocks; cutting is sequential and runs as a
table function over a group's blocks in order, so a task holds one group. What
breaks a rule leaves as a reject row with its reason, and with it its document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from docloom.functions.text import ARTICLE, article_number, stripped, uuid_of_json

MOST_CHARS = 600
MOST_CHILDREN = 5_000
DIMENSION = 512
MOST_ELEMENTS = 5_120_000
LOCATOR = ("article", "section_title", "page_start", "page_end", "paragraph_index", "bboxes")
_HEADER = re.compile(rf"\s*{ARTICLE}\s*")
_ONLY_HEADER = re.compile(rf"\s*{ARTICLE}\s*\Z")


def is_orphan_header(text: Column) -> Column:
    """Whether a text is an article number and nothing else."""
    return F.coalesce(article_number(text) == stripped(text), F.lit(False))


def groups(blocks: DataFrame) -> DataFrame:
    """blocks with grp (from 0 in each document) and headless, whether the
    block's group begins with a header that no body follows.

    Consecutive blocks of one article are an island; from its first orphan
    header on it is one group, and each block before that is its own."""
    by_doc = Window.partitionBy("doc").orderBy("idx")
    so_far = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    named = blocks.withColumns({"__article": F.coalesce("article", article_number(F.col("text"))), "__orphan": is_orphan_header(F.col("text"))})
    opens = ~F.coalesce(F.col("__article") == F.lag("__article").over(by_doc), F.lit(False))
    islands = named.withColumn("__opens", opens).withColumn("__island", F.sum(F.col("__opens").cast("int")).over(so_far))
    header = F.min(F.when(F.col("__orphan"), F.col("idx"))).over(Window.partitionBy("doc", "__island"))
    starts = F.col("__opens") | header.isNull() | (F.col("idx") <= header)
    numbered = islands.withColumn("__starts", starts).withColumn("grp", F.sum(F.col("__starts").cast("int")).over(so_far).cast("int") - 1)
    headless = F.bool_and("__orphan").over(Window.partitionBy("doc", "grp"))
    return numbered.withColumn("headless", headless).select(*blocks.columns, "grp", "headless")


def line_parts(text: str, most: int) -> Iterator[str]:
    """Lines packed into parts of at most `most` characters; longer ones are cut."""
    held = ""
    for line in re.findall(r"[^\n]*\n|[^\n]+\Z", text):
        if held and len(held) + len(line) > most:
            yield held
            held = ""
        while len(line) > most:
            yield line[:most]
            line = line[most:]
        held += line
    if held:
        yield held


def child_parts(text: str, most: int = MOST_CHARS) -> Iterator[str]:
    """The parts of a parent's text. A header at its beginning, with the white
    space about it, joins the part after it, and so does any part that is a
    header only; such a part may be longer than `most` by the header's length."""
    header = _HEADER.match(text)
    waiting = text[: header.end()] if header else ""
    for part in line_parts(text[len(waiting) :], most):
        if waiting:
            part, waiting = waiting + part, ""
        elif _ONLY_HEADER.match(part):
            waiting = part
            continue
        yield part
    if waiting:
        yield waiting


def _cutter(most: int):
    @F.udtf(returnType="doc string, grp int, child int, start int, end int, text string, spans array<struct<idx:int,from:int,to:int>>")
    class Cut:
        """Parent (child -1) and children of one group, whose blocks come in order."""

        def __init__(self):
            self.blocks: list[tuple[int, str]] = []
            self.at = None

        def eval(self, block: Row):
            self.at = (block["doc"], block["grp"])
            self.blocks.append((block["idx"], block["text"]))

        def terminate(self):
            if self.at is None:
                return
            text = "".join(t for _, t in self.blocks)
            yield (*self.at, -1, 0, len(text), text, [(i, 0, len(t)) for i, t in self.blocks])
            start, first, before = 0, 0, 0  # the first block that a part can touch, and where it starts
            for n, part in enumerate(child_parts(text, most)):
                end = start + len(part)
                while before + len(self.blocks[first][1]) <= start:
                    before += len(self.blocks[first][1])
                    first += 1
                spans, at = [], before
                for i, t in self.blocks[first:]:
                    if at >= end:
                        break
                    spans.append((i, max(start - at, 0), min(end - at, len(t))))
                    at += len(t)
                yield (*self.at, n, start, end, part, spans)
                start = end

    return Cut


def _rejected(grouped: DataFrame) -> DataFrame:
    """Blocks that no plan can take."""
    reason = F.when(F.coalesce(F.col("text"), F.lit("")) == "", "empty block").when(F.col("headless"), "article header without a body")
    return grouped.withColumn("reason", reason).where("reason is not null").select("doc", F.col("idx").cast("int").alias("idx"), "reason")


def plan(blocks: DataFrame, most_chars: int = MOST_CHARS, most_children: int = MOST_CHILDREN, most_elements: int = MOST_ELEMENTS, dimension: int = DIMENSION) -> tuple[DataFrame, DataFrame]:
    """Chunks and rejects of blocks. Chunks: doc (as text), grp, child (-1 for the
    parent), ordinal (from 0 in a document: a parent, its children, the next
    parent), start and end within the parent, text, and spans (block idx, from,
    to). Rejects: doc, idx (null for what concerns the document) and reason; a
    document with a reject has no chunks."""
    if most_chars < 1 or most_children < 1 or most_elements < 1:
        raise ValueError("limits of a chunk plan are positive")
    grouped = groups(blocks.withColumn("doc", F.col("doc").cast("string")))
    bad = _rejected(grouped)
    fine = grouped.join(bad.select("doc").distinct(), "doc", "left_anti").select("doc", "grp", F.col("idx").cast("int").alias("idx"), "text")
    cut = _cutter(most_chars)(fine.asTable().partitionBy("doc", "grp").orderBy("idx"))
    of_doc = Window.partitionBy("doc")
    ordinal = F.row_number().over(of_doc.orderBy("grp", "child")) - 1
    counted = cut.withColumns({"ordinal": ordinal, "__children": F.count_if(F.col("child") >= 0).over(of_doc)})
    over = F.when(F.col("__children") > most_children, "too many children").when(F.col("__children") * dimension > most_elements, "too many embedding elements")
    counted = counted.withColumn("__over", over)
    rejects = bad.unionByName(counted.where("__over is not null and ordinal = 0").select("doc", F.lit(None).cast("int").alias("idx"), F.col("__over").alias("reason")))
    return counted.where("__over is null").drop("__children", "__over"), rejects


def located(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """chunks with the locator of their blocks: the first article, section and
    paragraph there is, the earliest and latest page, and all boxes in order."""
    parts = chunks.select("doc", "ordinal", F.posexplode("spans").alias("__n", "span")).withColumn("idx", F.col("span.idx"))
    own = blocks.select(F.col("doc").cast("string").alias("doc"), F.col("idx").cast("int").alias("idx"), *LOCATOR)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__n"))).alias(c)
    boxes = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__n", F.col("bboxes").alias("b")))), lambda x: F.coalesce(x["b"], F.array().cast(blocks.schema["bboxes"].dataType))))
    merged = parts.join(own, ["doc", "idx"]).groupBy("doc", "ordinal").agg(first("article"), first("section_title"), F.min("page_start").alias("page_start"), F.max(F.coalesce("page_end", "page_start")).alias("page_end"), first("paragraph_index"), boxes.alias("bboxes"))
    return chunks.join(merged, ["doc", "ordinal"], "left")


def identified(chunks: DataFrame, blocks: DataFrame, document_id: Column) -> DataFrame:
    """chunks with content_sha256, id and parent_id: version 8 UUIDs from the
    document's id (a column over doc) and what a chunk is made of."""
    quoted = lambda c: F.to_json(F.array(c))
    inner = lambda c: F.substring(quoted(c), F.lit(2), F.length(quoted(c)) - 2)  # noqa: E731, the string alone
    listed = lambda *parts: F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    hashed = chunks.withColumn("content_sha256", F.sha2("text", 256)).withColumn("__doc", document_id)
    names = blocks.select(F.col("doc").cast("string").alias("doc"), F.col("idx").cast("int").alias("idx"), "block_id")
    of_parent = hashed.where("child < 0").select("doc", "grp", "__doc", "content_sha256", F.posexplode("spans").alias("__n", "span")).withColumn("idx", F.col("span.idx"))
    ids = of_parent.join(names, ["doc", "idx"]).groupBy("doc", "grp", "__doc", "content_sha256").agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "block_id"))), lambda x: x["block_id"]).alias("ids"))
    identity = F.when(F.size("ids") == 1, inner(F.col("ids")[0])).otherwise(F.to_json("ids"))
    parents = ids.select("doc", "grp", uuid_of_json(listed(inner(F.lit("knowledge-parent")), inner(F.col("__doc")), F.col("grp").cast("string"), identity, inner(F.col("content_sha256")))).alias("__parent"))
    own = uuid_of_json(listed(inner(F.lit("knowledge-child")), inner(F.col("__doc")), inner(F.col("__parent")), F.col("child").cast("string"), inner(F.col("content_sha256"))))
    is_parent = F.col("child") < 0
    return hashed.join(parents, ["doc", "grp"]).withColumns({"id": F.when(is_parent, F.col("__parent")).otherwise(own), "parent_id": F.when(~is_parent, F.col("__parent"))}).drop("__doc", "__parent")
