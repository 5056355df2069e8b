"""A content-addressed blob store: a Parquet table of (prefix, hash, size_bytes, content), partitioned by the hash's first two digits.

Spark's writers put the bytes down, so that any store which Spark reaches will do and a lost executor's attempt leaves
nothing behind. A blob is written once; reading it checks its hash.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.session import cut

STORE = "prefix string, hash string, size_bytes long, content binary"


def _store(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(STORE).parquet(f"{root}/blobs/sha256")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORE)


def put(blobs: DataFrame, root: str, content: str = "content") -> DataFrame:
    """Stores the contents that are not there yet; (hash, size_bytes) of all of them. An empty one is an error.

    One writer at a time, as for any Parquet table; a repeated put writes nothing.
    """
    spark, c = blobs.sparkSession, F.col(content)
    checked = F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, F.raise_error(F.lit("an empty blob is not stored"))).otherwise(F.sha2(c, 256))
    rows = cut(blobs.select(checked.alias("hash"), F.octet_length(content).cast("long").alias("size_bytes"), c.alias("content")).dropDuplicates(["hash"]))
    new = rows.join(_store(spark, root).select("hash"), "hash", "left_anti").withColumn("prefix", F.substring("hash", 1, 2))
    new.write.partitionBy("prefix").mode("append").parquet(f"{root}/blobs/sha256")
    return rows.select("hash", "size_bytes")


def get(spark: SparkSession, root: str, hashes: DataFrame) -> DataFrame:
    """(hash, content) of the named blobs; a content that does not have its hash is an error, and so is a missing one."""
    wanted = hashes.select("hash").distinct().withColumn("prefix", F.substring("hash", 1, 2))
    found = wanted.join(_store(spark, root), ["prefix", "hash"], "left")
    bad = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("no blob "), "hash"))).when(F.sha2("content", 256) != F.col("hash"), F.raise_error(F.concat(F.lit("checksum mismatch: "), "hash")))
    return found.select("hash", F.coalesce(bad.cast("binary"), "content").alias("content"))


def stored(spark: SparkSession, root: str) -> DataFrame:
    """(hash, size_bytes) of all blobs; the contents are not read."""
    return _store(spark, root).select("hash", "size_bytes")
