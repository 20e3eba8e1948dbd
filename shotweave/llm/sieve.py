"""A filter of fixed size over a column's values, for tasks that read whole tables but need few rows."""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import small

BITS = 1 << 26                                  # 8 MB whatever the input: a fuller filter lets more pass, an exact join decides


def bits(values: DataFrame, number: Column) -> np.ndarray:
    """The filter over an integer column, at its remainder modulo BITS; at most BITS / 32768 rows of 4 KB reach the driver."""
    at = F.pmod(number, F.lit(BITS)) + 1        # Spark's bitmap positions count from 1
    maps = values.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for k, part in maps:
        out[(k - 1) * 4096:k * 4096] = np.frombuffer(part, np.uint8)
    return out


def passes(filter_bits: bytes, numbers: np.ndarray) -> np.ndarray:
    """Whether the filter may hold these integers."""
    at = numbers % BITS
    return (np.frombuffer(filter_bits, np.uint8)[at // 8] >> (at % 8).astype(np.uint8) & 1).astype(bool)


def split(docs: DataFrame, number: Column, filter_bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Rows of docs that the filter rules out, and rows it may hold."""
    shared, names = docs.sparkSession.sparkContext.broadcast(filter_bits.tobytes()), docs.columns

    def part(inside):
        def run(batches):
            for batch in small(batches):
                may = passes(shared.value, batch.column(batch.num_columns - 1).to_numpy()) == inside
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=names).filter(pa.array(may))
        return docs.select("*", number.alias("sieve number")).mapInArrow(run, docs.schema)

    return part(False), part(True)
