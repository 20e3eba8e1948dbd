"""Footage folders."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed, text
from ..operators.tables import content_hash


def discover_files(spark: SparkSession, folder: str, exts=fixed.VIDEO_EXTS) -> DataFrame:
    """One row per file below `folder` with a known extension. Content is not read: the column is pruned from the scan."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    return raw.where(ext.isin(*exts)).select("path", text.basename(F.col("path")).alias("name"), F.col("length").alias("size"),
                                             F.col("modificationTime").alias("modified"), ext.alias("ext"))


def hash_files(spark: SparkSession, folder: str, exts=fixed.VIDEO_EXTS) -> DataFrame:
    """Content hash per file (size, first and last megabyte)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    return raw.where(ext.isin(*exts)).select("path", F.col("length").alias("size"), content_hash(F.col("length"), F.col("content")).alias("content_hash"))
