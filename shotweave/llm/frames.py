"""Small helpers over documents: columns by name, whatever else a table holds."""
import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, work_folder

__all__ = ["cut_lineage", "id_and_text", "schema_with", "partitions", "tokenizer_path", "written", "let_go"]


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns only, so that further columns of any name do no harm."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *more)


def schema_with(docs: DataFrame, rest: str) -> T.StructType:
    """doc_id in its own type, then the columns of a DDL string."""
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(rest).fields])


def partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared work folder."""
    path = work_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def let_go(spark) -> None:
    """Lets Spark delete the shuffle files of steps that a checkpoint has cut off: it does so once the driver has collected the frames nobody refers to any more.

    A driver with little work of its own may not collect for long, while an iterative job piles up files.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
