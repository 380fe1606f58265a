"""Reading documents: file scans with hashes, object keys, DOCX blocks, and where
blocks stand in their documents. Bytes are read by Spark, from any store it reads."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import article_number, heading_level
from docloom.operators.structure import carried_article, section_path

SUPPORTED = ("pdf", "docx")
MOST_BYTES = 50 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _listed(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Files with kind (by suffix) and problem; content is read of those that are taken only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    kind = F.when(suffix.isin(*SUPPORTED), suffix)
    problem = F.when(kind.isNull(), "unsupported type").when(F.col("length") > most, "too large")
    return files.select("path", kind.alias("kind"), "length", problem.alias("problem"), "content")


def scan(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """path, kind (by suffix), length, sha256 and content of supported files up to a size."""
    return _listed(spark, path, most).where("problem is null").select("path", "kind", "length", F.sha2("content", 256).alias("sha256"), "content")


def refused(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """path, length and problem of the files that scan leaves out."""
    return _listed(spark, path, most).where("problem is not null").select("path", "length", "problem")


def object_key(tenant: Column, scope: Column, sha: Column) -> Column:
    """Content-addressed key: public law, or a tenant's scope."""
    return F.when(scope == "public", F.concat_ws("/", F.lit("public"), F.lit("law"), sha)).otherwise(F.concat_ws("/", F.lit("tenants"), tenant, scope, sha))


def key_allowed(key: Column) -> Column:
    """A relative path of public or a tenant, without steps up."""
    parts = F.split(key, "/")
    plain = ~key.rlike("(^|/)\\.{0,2}(/|$)")
    return plain & ((parts[0] == "public") | ((parts[0] == "tenants") & (F.size(parts) >= 4)))


def table_text(rows: Column) -> Column:
    """Rows of cells as lines of tabs; empty if no cell has text."""
    text = F.array_join(F.transform(rows, lambda r: F.array_join(r, "\t", "")), "\n")
    return F.when(text.rlike("(?U)\\S"), text).otherwise(F.lit(""))


# limits of a DOCX archive: members, bytes of one and of all, how far one may unpack, blocks and characters
@dataclass(frozen=True)
class DocxLimits:
    members: int = 5_000
    member_bytes: int = 50 << 20
    expanded_bytes: int = 200 << 20
    ratio: float = 100.0
    blocks: int = 20_000
    characters: int = 5_000_000


def check_archive(infos: list[zipfile.ZipInfo], limits: DocxLimits) -> None:
    """Refuse an archive by its directory, before anything is unpacked."""
    if len(infos) > limits.members:
        raise ValueError("too many members")
    if any(i.file_size > limits.member_bytes for i in infos):
        raise ValueError("a member is too large")
    if sum(i.file_size for i in infos) > limits.expanded_bytes:
        raise ValueError("the archive unpacks to too much")
    if any(i.file_size > limits.ratio * max(i.compress_size, 1) for i in infos):
        raise ValueError("a member is compressed too much")


_AS_TEXT = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


def _text(node: ElementTree.Element) -> str:
    """What a paragraph's runs say."""
    return "".join(t.text or "" if t.tag == f"{_W}t" else _AS_TEXT.get(t.tag, "") for t in node.iter())


def _styles(z: zipfile.ZipFile) -> dict[str, str]:
    """Names of styles by their ids."""
    if "word/styles.xml" not in z.namelist():
        return {}
    found = ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style")
    return {s.get(f"{_W}styleId", ""): n.get(f"{_W}val", "") for s in found if (n := s.find(f"{_W}name")) is not None}


def _docx_rows(content: bytes, limits: DocxLimits) -> list[tuple]:
    """number (of the paragraph or table), element, styles, listed, rows of cells, text, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        check_archive(z.infolist(), limits)
        names = _styles(z)
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{_W}body")
    if root.tag != f"{_W}document" or body is None:
        raise ValueError("no document body")
    out, paragraphs, tables, characters = [], 0, 0, 0
    for node in body:
        if node.tag == f"{_W}p":
            paragraphs += 1
            style = node.find(f"{_W}pPr/{_W}pStyle")
            id_ = None if style is None else style.get(f"{_W}val", "")
            row = (paragraphs, "paragraph", [] if id_ is None else [names.get(id_, id_), id_], node.find(f"{_W}pPr/{_W}numPr") is not None, None, _text(node))
            size = len(row[5])
        elif node.tag == f"{_W}tbl":
            tables += 1
            cells = [["\n".join(_text(p) for p in c.findall(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            row = (tables, "table", [], False, cells, None)
            size = sum(len(c) + 1 for r in cells for c in r)
        else:
            continue
        characters += size
        if len(out) >= limits.blocks:
            raise ValueError("too many blocks")
        if characters > limits.characters:
            raise ValueError("too many characters")
        out.append(row)
    return out


def docx_blocks(files: DataFrame, limits: DocxLimits | None = None) -> DataFrame:
    """Paragraphs and tables of DOCX files in order: doc (sha256), idx, kind
    (paragraph or table), number (of its kind, blank ones counted), style and
    styles (name and id), listed, text, problem. Blank ones are left out. A file
    that cannot be read, breaks a limit or has no text is one row with a problem."""
    limits = limits or DocxLimits()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sha, content in zip(b["sha256"], b["content"]):
                try:
                    rows += [(sha, i, *x, None) for i, x in enumerate(_docx_rows(bytes(content), limits))]
                except (ValueError, KeyError, NotImplementedError, RuntimeError, OSError, zipfile.BadZipFile, zlib.error, ElementTree.ParseError) as e:
                    rows.append((sha, 0, None, None, None, None, None, None, str(e) if type(e) is ValueError else f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc", "idx", "number", "kind", "styles", "listed", "cells", "said", "problem"])

    read = files.where("kind = 'docx'").select("sha256", "content").dropDuplicates(["sha256"])
    raw = read.mapInPandas(run, "doc string, idx int, number int, kind string, styles array<string>, listed boolean, cells array<array<string>>, said string, problem string")
    text = F.when(F.col("kind") == "table", table_text(F.col("cells"))).otherwise(F.col("said"))
    rows = raw.select("doc", "idx", "kind", "number", F.get("styles", 0).alias("style"), "styles", "listed", text.alias("text"), "problem")
    told = rows.where("problem is not null or text rlike '(?U)\\\\S'")
    empty = read.join(told.select(F.col("doc").alias("sha256")).distinct(), "sha256", "left_anti")
    none = {"idx": F.lit(0), "kind": F.lit(None).cast("string"), "number": F.lit(None).cast("int"), "style": F.lit(None).cast("string"), "styles": F.lit(None).cast("array<string>"), "listed": F.lit(None).cast("boolean"), "text": F.lit(None).cast("string"), "problem": F.lit("no usable text")}
    return told.unionByName(empty.select(F.col("sha256").alias("doc"), *[v.alias(k) for k, v in none.items()]))


def docx_document(blocks: DataFrame) -> DataFrame:
    """Blocks of docx_blocks that have text, with their place in the document:
    level (by text, else by a style named heading 1 to 9), block_type (heading,
    article, list, table or paragraph), article, section_title, paragraph_index
    and block_id. Tables neither head nor end anything."""
    rows = blocks.where("problem is null")
    by_style = F.filter(F.transform("styles", lambda s: F.regexp_extract(s, "(?i)heading\\s*([1-9])", 1)), lambda x: x != "")
    is_table = F.col("kind") == "table"
    level = F.when(~is_table, F.coalesce(heading_level(F.col("text")), F.get(by_style, 0).cast("int")))
    rows = rows.withColumn("level", level)
    # a table's text does not begin an article
    marked = rows.withColumnRenamed("text", "__text").withColumn("text", F.when(is_table, F.lit(None)).otherwise(F.col("__text")))
    placed = section_path(carried_article(marked), levels=9).drop("text").withColumnRenamed("__text", "text")
    listed = F.col("listed") | F.exists("styles", lambda s: F.contains(F.lower(s), F.lit("list")))
    kind = F.when(is_table, "table").when(F.col("level").isNotNull(), "heading").when(article_number(F.col("text")).isNotNull(), "article").when(listed, "list").otherwise("paragraph")
    placed = placed.withColumn("block_type", kind)
    at = F.concat(F.col("kind"), F.lit(":"), F.col("number").cast("string"))
    block_id = F.sha2(F.concat_ws("|", "doc", F.lit("docx"), at, F.concat(F.lit("type:"), "block_type")), 256)
    return placed.select("doc", "idx", block_id.alias("block_id"), "text", "block_type", "level", "article", F.nullif("path", F.lit("")).alias("section_title"), F.col("number").alias("paragraph_index"))
