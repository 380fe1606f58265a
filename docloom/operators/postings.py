"""A stored keyword index: postings clustered by token, kept up by batches.

Postings (token, item, n) are dealt to buckets by a hash of the token, as
partitions of files, and sorted by token within them; a token with more items
than a file should hold is spread over several. A search reads the buckets of
its terms only, and within them the row groups that can hold them.

A batch is written whole before one row commits it, and readers look at
committed batches only, so a batch that failed half way or runs twice changes
nothing. An item that is there already is passed over, or, when a batch replaces
(a backfill with another tokenizer), supersedes its older postings. `compact`
writes all that is in force as one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import squeezed, word_tokens
from docloom.operators.retrieval import keyword_channel

BUCKETS = 64
FILE_POSTINGS = 1_000_000
ROWS_COUNTED = 1_000  # rows whose tokens are counted at a time
MOST_TERMS = 100_000  # beyond these a search finds its buckets without naming its terms to the scan
COMMITS = "batch string, replaces array<string>, no long"


def search_tokens(content: Column, title: Column, authority: Column, number: Column, section: Column, article: Column) -> Column:
    """Tokens of a chunk's content with the words of its document and section
    before, and its article number without white space as one token behind. Null
    and empty parts are passed over."""
    parts = F.filter(F.array(title, authority, number, section), lambda p: p.isNotNull() & (p != ""))
    raw = F.array_join(F.concat(parts, F.array(F.coalesce(content, F.lit("")))), " ")
    name = F.lower(squeezed(F.coalesce(article, F.lit(""))))
    return F.concat(word_tokens(raw), F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, tokens as item, n_tokens, and counts of each token."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS_COUNTED):
            b = whole.slice(start, ROWS_COUNTED)
            tokens = b.column("tokens")
            flat = pa.table({"row": pc.list_parent_indices(tokens), "token": pc.list_flatten(tokens)})
            found = flat.group_by(["row", "token"]).aggregate([([], "count_all")]).sort_by("row")
            ends = np.searchsorted(found["row"].to_numpy(), np.arange(b.num_rows + 1), "left")
            pairs = pa.StructArray.from_arrays([found["token"].combine_chunks().cast(pa.string()), found["count_all"].combine_chunks()], ["token", "n"])
            lengths = pc.cast(pc.list_value_length(tokens), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("item"), lengths, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["item", "n_tokens", "counts"])


class KeywordIndex:
    """The index under a path of the shared folder; item is a long or a string."""

    def __init__(self, spark: SparkSession, path: str, item: str = "long", buckets: int = BUCKETS, file_postings: int = FILE_POSTINGS):
        self.spark, self.path, self.buckets, self.file_postings = spark, path, buckets, file_postings
        self.schemas = {"postings": f"token string, item {item}, n long, bucket int, batch string", "items": f"item {item}, n_tokens long, batch string", "superseded": f"item {item}, old string, batch string"}
        spark.createDataFrame([], COMMITS).write.mode("append").parquet(f"{path}/commits")

    def _commits(self) -> dict[str, int]:
        """The batches in force, and their order."""
        rows = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").collect()
        gone = {b for r in rows for b in r["replaces"]}
        return {r["batch"]: r["no"] for r in rows if r["batch"] not in gone}

    def _table(self, name: str, live: dict[str, int]) -> DataFrame:
        """A table's rows of the batches in force."""
        if not live:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/batch={b}" for b in sorted(live)])

    def _in_force(self, name: str, live: dict[str, int]) -> DataFrame:
        """Rows of items as their last batch has them. Batches of which nothing is
        superseded are read as they are, and those wholly superseded not at all."""
        old = self._table("superseded", live).select("item", F.col("old").alias("batch"))
        gone = {r["batch"]: r["n"] for r in old.groupBy("batch").agg(F.count_distinct("item").alias("n")).collect()} if live else {}
        had = {r["batch"]: r["n"] for r in self._table("items", {b: live[b] for b in gone if b in live}).groupBy("batch").agg(F.count("*").alias("n")).collect()} if gone else {}
        whole = self._table(name, {b: n for b, n in live.items() if b not in had})
        some = {b: live[b] for b in had if gone[b] < had[b]}
        return whole.unionByName(self._table(name, some).join(old, ["item", "batch"], "left_anti")) if some else whole

    def _write(self, postings: DataFrame, items: DataFrame, superseded: DataFrame, batch: str, replaces: list[str]) -> None:
        kept = postings.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int"))
        items.write.mode("overwrite").parquet(f"{self.path}/items/batch={batch}")
        superseded.write.mode("overwrite").parquet(f"{self.path}/superseded/batch={batch}")
        spread = kept.withColumn("slice", F.lit(0))
        # only with so many items can a token have more of them than a file should hold
        if self.spark.read.parquet(f"{self.path}/items/batch={batch}").count() > self.file_postings:
            hot = kept.groupBy("token").agg(F.count("*").alias("items")).where(F.col("items") > self.file_postings).select("token", F.ceil(F.col("items") / self.file_postings).alias("files"))
            spread = kept.join(F.broadcast(hot), "token", "left").withColumn("slice", F.when(F.col("files").isNull(), 0).otherwise(F.pmod(F.xxhash64("item"), F.col("files"))))
        placed = spread.repartition("bucket", "slice").sortWithinPartitions("bucket", "token", "item").select("token", "item", "n", "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        no = max(self._commits().values(), default=-1) + 1
        self.spark.createDataFrame([(batch, replaces, no)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def ingest(self, chunks: DataFrame, batch: str, replace: bool = False) -> None:
        """Add chunks (item, tokens), each item once (of repeated ones the row
        whose tokens come first). Null items are passed over; null tokens are none.

        Tokens are counted in their row, once, and stand in a folder of the batch
        until it is committed; only repeated items are brought together."""
        live = self._commits()
        if batch in live:
            return
        rows = chunks.where("item is not null").select("item", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
        repeated = rows.groupBy("item").agg(F.count("*").alias("__n")).where("__n > 1").select("item")
        if not repeated.isEmpty():
            least = rows.join(repeated, "item", "left_semi").groupBy("item").agg(F.min("tokens").alias("tokens"))
            rows = rows.join(repeated, "item", "left_anti").unionByName(least)
        known = self._in_force("items", live)
        if not replace and live:
            rows = rows.join(known.select("item"), "item", "left_anti")
        staged = f"{self.path}/staged/batch={batch}"
        rows.mapInArrow(_counted, f"item {dict(rows.dtypes)['item']}, n_tokens long, counts array<struct<token:string,n:long>>").write.mode("overwrite").parquet(staged)
        rows = self.spark.read.parquet(staged)
        superseded = known.join(rows.select("item"), "item", "left_semi").select("item", F.col("batch").alias("old"))
        postings = rows.select("item", F.explode("counts").alias("c")).select("c.token", "item", "c.n")
        self._write(postings, rows.select("item", "n_tokens"), superseded, batch, [])
        self._drop(staged)

    def _drop(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def compact(self, batch: str) -> None:
        """Everything in force as one batch, which replaces the others."""
        live = self._commits()
        if batch in live or not live:
            return
        none = self.spark.createDataFrame([], self.schemas["superseded"]).drop("batch")
        self._write(self._in_force("postings", live).select("token", "item", "n"), self._in_force("items", live).drop("batch"), none, batch, sorted(live))

    def items(self) -> DataFrame:
        return self._in_force("items", self._commits()).select("item", "n_tokens")

    def postings(self, tokens: DataFrame | None = None) -> DataFrame:
        """Postings in force; of the tokens (token) only, read from their buckets."""
        live = self._commits()
        rows = self._in_force("postings", live)
        if tokens is None:
            return rows.select("token", "item", "n")
        tokens = tokens.select("token").distinct()
        names = [r["token"] for r in tokens.limit(MOST_TERMS + 1).collect()]
        if len(names) <= MOST_TERMS:
            mine = [r["b"] for r in tokens.select(F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(mine) & F.col("token").isin(names))
            return rows.select("token", "item", "n")
        return rows.join(tokens, "token", "left_semi").select("token", "item", "n")

    def search(self, queries: DataFrame, limit: int = 20, eligible: DataFrame | None = None, articles: DataFrame | None = None) -> DataFrame:
        """The keyword channel upon the index: queries as there; eligible (item)
        restricts the items, and articles (item, article) lets queries that name
        an article find it without a token."""
        found = self.postings(queries.select(F.explode("terms").alias("token")).where("token is not null"))
        rows = found.groupBy("item").agg(F.collect_list(F.struct("token", "n")).alias("p")).select("item", F.col("p.token").alias("tokens"), F.col("p.n").alias("counts"))
        if articles is not None:
            empty = lambda t: F.array().cast(f"array<{t}>")
            named = articles.where("article is not null").join(self.items().select("item"), "item", "left_semi")
            rows = rows.join(named, "item", "full").select("item", F.coalesce("tokens", empty("string")).alias("tokens"), F.coalesce("counts", empty("long")).alias("counts"), "article")
        if eligible is not None:
            rows = rows.join(eligible.select("item"), "item", "left_semi")
        return keyword_channel(rows, queries, limit)
