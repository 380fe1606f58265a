"""A training-data pipeline over the table documents.

Each stage takes what the one before kept and returns the columns of documents;
the last returns the pieces of packed sequences. Stages are written and read
again between each other by whoever runs them for good; run() chains them.

Null and empty texts pass all stages and are packed as the end id alone. Rows
may repeat and ids may be null; of rows with equal or near texts one stays. An
empty table gives no pieces. Columns beyond those of documents are kept up to
the packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import written
from docloom.llm.decontaminate import drop_contaminated
from docloom.llm.line_dedup import dedup_lines
from docloom.llm.near_dedup import drop_near_duplicates
from docloom.llm.packing import pack_documents
from docloom.llm.toxicity import drop_toxic, fit


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars again what it says, after texts have changed."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that repeat an earlier line, or are within two edits of one (short
    ones within one), and documents of which nothing but blank lines is left.
    Texts without lines of their own stay as they are."""
    out = dedup_lines(docs, classes=False, short_chars=16)
    return _sized(out.where("n_lines = 0 or n_removed < n_lines").select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into sequences."""
    import public_tokenizers

    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # label model, sampling and packing are beyond SQL
