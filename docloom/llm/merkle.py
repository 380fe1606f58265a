"""Fingerprints of documents as Merkle trees over sections and paragraphs.

A text is cut at blank lines into sections and at newlines into paragraphs. A
paragraph's hash is the SHA-256 of its text, a section's that of its
paragraphs' hashes, the root's that of its sections' hashes: equal texts have
equal roots, different texts different ones. Branches that differ locate edits.
Below paragraphs stand phrases of at most five words, which end early where a
sentence does; the likeness of two trees is the share of their distinct phrases
that both have, by length: twice the common over the sum.

Only DataFrame functions are used. Null and empty texts are one empty section;
two of them are alike by 1.0, an empty and another text by 0.0. Extra columns do
not matter, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import columns_free_of

_GAP, _WORD = r"[\x20\x09\x0B-\x0D]", r"[^\x20\x09-\x0D]"
PHRASE = rf"{_GAP}*(?:{_WORD}*[^\x20\x09-\x0D.!?]{_GAP}+){{0,4}}{_WORD}+\x0A?|{_GAP}+\x0A?|\x0A"
LENGTH_BITS = 20
MOST_BUCKETS = 100_000


def sections(text: Column) -> Column:
    """Sections as arrays of paragraphs; joined by newlines, and sections by
    blank lines, they are the text again."""
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.split(s, "\n", -1))


def tree(text: Column) -> Column:
    """The hashes of each section and of its paragraphs, with their lengths."""

    def section(paragraphs: Column) -> Column:
        nodes = F.transform(paragraphs, lambda p: F.struct(F.sha2(p, 256).alias("hash"), F.length(p).alias("n")))
        return F.struct(F.sha2(F.array_join(nodes["hash"], ""), 256).alias("hash"), nodes.alias("paragraphs"))

    return F.transform(sections(F.coalesce(text, F.lit(""))), section)


def root(text: Column) -> Column:
    """The hash at the top of a text's tree."""
    hashes = F.transform(sections(text), lambda s: F.sha2(F.array_join(F.transform(s, lambda p: F.sha2(p, 256)), ""), 256))
    return F.sha2(F.array_join(hashes, ""), 256)


def phrase_keys(text: Column) -> Column:
    """The distinct phrases of a text, first seen first: 44 bits of a hash, and
    the length. A phrase of 2^20 code points or more counts as one less than that."""
    key = lambda x: F.shiftleft(F.xxhash64(x), LENGTH_BITS).bitwiseOR(F.least(F.length(x), F.lit((1 << LENGTH_BITS) - 1)).cast("long"))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)), key))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two arrays of phrase keys."""
    zero = F.lit(0).cast("long")
    weight = lambda keys: F.aggregate(keys, zero, lambda s, k: s + k.bitwiseAND((1 << LENGTH_BITS) - 1))
    both = weight(a) + weight(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2 * weight(F.array_intersect(a, b)) / both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, fingerprint (the root) and tree."""
    text = F.coalesce("text", F.lit(""))
    return columns_free_of(docs, "doc_id", "text").select("doc_id", root(text).alias("fingerprint"), tree(text).alias("tree"))


def edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """The paragraphs of either side (doc_id, text) that the other side's
    document of the same id has not got: doc_id, side, start and end (code
    points), hash. Trees are compared from the root: documents with equal roots
    go first, then sections that the other side has. Documents without a partner
    are all edits. Rows that share an id count as one document's versions."""
    sides = [fingerprints(df).withColumn("side", F.lit(s)) for s, df in enumerate((before, after))]
    roots = sides[0].unionByName(sides[1])
    known = roots.select("doc_id", "fingerprint", (1 - F.col("side")).alias("side"))
    differ = roots.alias("a").join(known.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.side") == F.col("b.side")) & (F.col("a.fingerprint") == F.col("b.fingerprint")), "left_anti")
    branches = differ.select("doc_id", "side", "fingerprint", F.posexplode("tree").alias("s", "section")).select("doc_id", "side", "fingerprint", "s", F.col("section.hash").alias("section_hash"), F.posexplode("section.paragraphs").alias("p", "node"))
    order = Window.partitionBy("doc_id", "side", "fingerprint").orderBy("s", "p").rowsBetween(Window.unboundedPreceding, -1)
    # a paragraph is followed by a newline, and the last of a section by another
    before_it = F.coalesce(F.sum(F.col("node.n") + 1).over(order), F.lit(0)) + F.col("s")
    leaves = branches.select("doc_id", "side", "section_hash", "node.hash", before_it.alias("start"), (before_it + F.col("node.n")).alias("end"))
    for level in ("section_hash", "hash"):
        other = branches.select("doc_id", (1 - F.col("side")).alias("side"), (F.col("section_hash") if level == "section_hash" else F.col("node.hash")).alias(level)).distinct()
        leaves = leaves.alias("a").join(other.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.side") == F.col("b.side")) & (F.col(f"a.{level}") == F.col(f"b.{level}")), "left_anti")
    return leaves.select("doc_id", F.when(F.col("side") == 0, "before").otherwise("after").alias("side"), "start", "end", "hash").distinct()


def with_next(docs: DataFrame, bucket_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, text (null as empty) and phrases of each document, with next_text
    and next_phrases, those of the next by ascending id (after the last, the
    first). Null ids come first, rows that share an id in order of a hash of
    their texts and then of their places, so that a hot id is spread too.

    Rows are dealt into ranges whose first rows are found among the ids and
    hashes alone; the first row of a range also stands at the end of the one
    before. One exchange carries the texts. The rows must read the same twice,
    as rows of files do; write others to a table first.
    """
    spark = docs.sparkSession
    rows = columns_free_of(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MOST_BUCKETS, max(3 * parts, size // bucket_bytes + 1))
    firsts = rows.select("key").repartitionByRange(wanted, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("key"))
    found = firsts.agg(F.to_json(F.sort_array(F.collect_list("key"))), F.count("*")).first()
    n = max(1, found[1])
    bounds = F.from_json(F.lit(found[0] or "[]"), f"array<{rows.schema['key'].dataType.simpleString()}>")

    def step(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        right = (at["low"] < at["high"]) & (F.get(bounds, middle) <= F.col("key"))
        return F.struct(F.when(right, middle + 1).otherwise(at["low"]).alias("low"), F.when(right, at["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(n + 1)) + 1))
    bucket = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), step, lambda at: F.greatest(at["low"] - 1, F.lit(0)))
    rows = rows.withColumn("bucket", bucket)
    first = F.get(bounds, F.col("bucket")).eqNullSafe(F.col("key"))
    dealt = rows.select("text", "key", F.posexplode(F.when(first, F.array("bucket", F.pmod(F.col("bucket") - 1, F.lit(n)))).otherwise(F.array("bucket"))).alias("guest", "bucket"))
    dealt = dealt.repartition("bucket").withColumn("phrases", phrase_keys(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", "key")
    led = dealt.select("key", "guest", "text", "phrases", F.lead("text").over(order).alias("next_text"), F.lead("phrases").over(order).alias("next_phrases"))
    return led.where("guest = 0").select("key.doc_id", "text", "phrases", "next_text", "next_phrases")


def quarter_edits(docs: DataFrame) -> DataFrame:
    """Each document, and its text with the last quarter replaced by the
    beginning of the next document's: doc_id, n_chars, edited (the text),
    fingerprint, edited_fingerprint, near_edited, near_next (likenesses), and
    common_chars, the length of the text's phrases that the edit left."""
    n = F.length("text")
    taken = F.floor(n / 4).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - taken), F.substring("next_text", F.lit(1), taken)))
    rows = rows.withColumn("edited_phrases", phrase_keys(F.col("edited")))
    zero = F.lit(0).cast("long")
    left = F.aggregate(F.array_intersect("phrases", "edited_phrases"), zero, lambda s, k: s + k.bitwiseAND((1 << LENGTH_BITS) - 1))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", root(F.col("text")).alias("fingerprint"), root(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("phrases"), F.col("edited_phrases")).alias("near_edited"), likeness(F.col("phrases"), F.col("next_phrases")).alias("near_next"), left.alias("common_chars"))
