"""Objects written once under the hash of their bytes, and files sent as text.

A store is a folder of batches with one commit each, like the other tables that
grow; objects are rows, dealt by their keys. Putting bytes that are there is no
change, and other bytes under the same key are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.sources.documents import key_allowed

MOST_BYTES = 25 << 20
PARTS = 64
_OBJECTS = "key string, sha256 string, content binary, part int, batch string"


def filing_key(tenant: Column, sha: Column) -> Column:
    """The key of a tenant's own papers."""
    return F.concat_ws("/", F.lit("tenants"), tenant, F.lit("contracts"), sha)


def sent_files(rows: DataFrame, content: str, name: str, kind: str) -> DataFrame:
    """rows whose content is base64: bytes (null if it is not), filename and
    content_type with what stands for none, and problem."""
    fits = F.col(content).rlike("\\A[A-Za-z0-9+/]*={0,2}\\z") & (F.length(content) % 4 == 0)
    data = F.when(fits, F.try_to_binary(F.col(content), F.lit("base64")))
    problem = F.when(F.col(content).isNull(), "no file").when(data.isNull(), "not base64")
    return rows.withColumns({"bytes": data, "filename": F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("document")), "content_type": F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("application/pdf")), "problem": problem})


class ObjectStore:
    """Objects under a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str, most: int = MOST_BYTES):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most
        spark.createDataFrame([], "batch string").write.mode("append").parquet(f"{self.path}/commits")

    def _objects(self) -> DataFrame:
        batches = sorted(r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/commits").collect())
        if not batches:
            return self.spark.createDataFrame([], _OBJECTS)
        return self.spark.read.schema(_OBJECTS).option("basePath", f"{self.path}/objects").parquet(*[f"{self.path}/objects/batch={b}" for b in batches])

    def put(self, objects: DataFrame, batch: str) -> DataFrame:
        """objects (key, content): an answer for each distinct key and content,
        created, exists, or why not. Of new objects with one key and different
        bytes the one with the least hash is created, the others conflict. A
        batch that is put again answers that its objects exist."""
        asked = objects.select("key", F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["key", "sha256"])
        refused = F.when(F.col("key").isNull() | ~F.coalesce(key_allowed(F.col("key")), F.lit(False)), "key not allowed").when(F.col("content").isNull(), "no content").when(F.octet_length("content") > self.most, "too large")
        known = self._objects().select("key", F.col("sha256").alias("__stored"))
        met = asked.withColumn("__refused", refused).join(known, "key", "left")
        first = F.min(F.when(F.col("__refused").isNull(), F.col("sha256"))).over(Window.partitionBy("key"))
        met = met.withColumn("__first", F.coalesce("__stored", first))
        answer = F.coalesce("__refused", F.when(F.col("sha256") != F.col("__first"), "conflict").when(F.col("__stored").isNotNull(), "exists").otherwise("created"))
        told = met.withColumn("answer", answer)
        done = self.spark.read.schema("batch string").parquet(f"{self.path}/commits").where(F.col("batch") == batch)
        if done.isEmpty():
            new = told.where("answer = 'created'").select("key", "sha256", "content", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int").alias("part"))
            told.select("key", "sha256", "answer").write.mode("overwrite").parquet(f"{self.path}/answers/batch={batch}")
            new.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/objects/batch={batch}")
            self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
            return self.spark.read.schema("key string, sha256 string, answer string").parquet(f"{self.path}/answers/batch={batch}")
        return told.select("key", "sha256", "answer")

    def get(self, keys: DataFrame) -> DataFrame:
        """keys (key) with content, null where there is none; only the parts of the keys are read."""
        asked = keys.select("key").distinct().withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
        parts = [r["part"] for r in asked.select("part").distinct().collect()]
        stored = self._objects().where(F.col("part").isin(parts)).select("key", "content")
        return asked.select("key").join(stored, "key", "left")
