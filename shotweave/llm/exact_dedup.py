"""Exact deduplication by an exchange of Golomb-coded fingerprints; only suspects' texts are shuffled, and their bytes decide."""
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange, golomb, sieve
from .frames import cut_lineage, id_and_text, partitions, schema_with
from .words import small, text_column

BITS = 48                                       # of a fingerprint: equal ones are only suspects
CHUNK = 1 << 16
WHITE = b" \t\n\v\f\r"


def bare(text: bytes) -> bytes:
    return text.translate(None, WHITE)


def _texts(batch):
    """UTF-8 bytes of a batch's texts without white space, one at a time."""
    return (bare(x.as_buffer().to_pybytes()) if x.is_valid else b"" for x in text_column(batch).cast(pa.large_binary()))


def _print(sha: bytes) -> int:
    return int.from_bytes(sha[:BITS // 8], "big")


def _marks(docs: DataFrame) -> DataFrame:
    """doc_id, chars (code points), sha256 of the bare text, fp, row (a number of its own)."""
    schema = schema_with(docs, "chars long, sha binary, fp long, row long")

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            shas = [hashlib.sha256(x).digest() for x in _texts(batch)]
            chars = pc.utf8_length(text_column(batch)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), chars, pa.array(shas, pa.binary()), pa.array(map(_print, shas), pa.int64()), pa.array(np.arange(row, row + len(shas)))], names=schema.names)
            row += len(shas)

    return docs.mapInArrow(run, schema)


def _requests(marks: DataFrame, owners: int) -> DataFrame:
    """Each task's sorted distinct fingerprints by owner, coded, with a bit for those it holds twice itself."""
    def coded(fps, chunk):
        values, counts = np.unique(fps, return_counts=True)
        return pa.RecordBatch.from_pylist(exchange.requests(values, counts > 1, chunk, owners, BITS), schema=exchange.request_schema())

    def run(batches):
        base, k, held = TaskContext.get().partitionId() << 24, 0, []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= CHUNK:
                yield coded(np.concatenate(held), base + k)
                k, held = k + 1, []
        if sum(map(len, held)):
            yield coded(np.concatenate(held), base + k)

    return marks.select("fp").mapInArrow(run, exchange.REQUEST)


def _suspects(requests: DataFrame, answers: DataFrame, owners: int) -> DataFrame:
    step = -(-(1 << BITS) // owners)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                values = golomb.decode(r["n"], r["width"], r["blob"])
                yield pa.RecordBatch.from_arrays([pa.array(values[exchange.flags(r["bitmap"], r["n"])] + r["owner"] * step)], names=["fp"])

    return requests.join(answers, ["chunk", "owner"]).select("owner", "n", "width", "blob", "bitmap").mapInArrow(run, "fp long").distinct()


def _suspect_texts(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """Each task's suspect texts, once for each few megabytes read: fp, bare bytes, rows."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve.bits(suspects, F.col("fp")).tobytes())

    def run(batches):
        for batch in small(batches):
            rows, texts = {}, list(_texts(batch))
            fps = np.fromiter((_print(hashlib.sha256(x).digest()) for x in texts), np.int64, len(texts))
            for i in np.flatnonzero(sieve.passes(shared.value, fps)).tolist():
                rows.setdefault(texts[i], [int(fps[i]), 0])[1] += 1
            if rows:
                fps, counts = zip(*rows.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(list(rows), pa.binary()), pa.array(counts, pa.int64())], names=["fp", "bare", "rows"])

    return docs.select("doc_id", "text").mapInArrow(run, "fp long, bare binary, rows long").join(suspects, "fp", "left_semi")


def dedupe(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per row of docs.

    Texts are equal when identical without `[\\x20\\x09-\\x0D]`; null counts as empty, so nulls, empty and blank texts are one group. The row with
    the most code points in the original text stays, then the one with the smallest doc_id (null last); of repeated rows, the first read. An empty
    table gives no rows.

    1. Tasks send sorted 48-bit fingerprints, Golomb-coded, to the owners of their ranges. 2. Owners return bitmaps of those seen twice. 3. Only suspects'
    texts, each once per few megabytes, are shuffled and grouped by their bytes. Hot groups are folded before every shuffle; the last join has a hot left
    side that Spark splits.
    """
    marks, groups = _groups(id_and_text(docs))
    joined = marks.join(groups, "sha", "left")
    alone = F.col("group_size").isNull()
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                         (alone | (F.col("row") == F.col("best.row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks of all rows; and of each group of two or more equal texts: sha, best (the row that stays), group_size."""
    marks = cut_lineage(_marks(docs))
    owners = max(partitions(docs), -(-marks.count() // 1_000_000))
    requests = _requests(marks, owners)
    suspects = cut_lineage(_suspects(requests, exchange.answers(requests), owners))
    verified = (_suspect_texts(docs, suspects).groupBy("fp", "bare").agg(F.sum("rows").alias("group_size")).where("group_size > 1")
                .select(F.unhex(F.sha2("bare", 256)).alias("sha"), "group_size"))
    best = F.min(F.struct((-F.col("chars")).alias("few"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "row", "fp"))
    return marks, marks.groupBy("sha").agg(best.alias("best")).join(verified, "sha")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that dedupe() keeps. Rows outside groups pass where they are read; only those in groups are shuffled."""
    _, groups = _groups(id_and_text(docs))
    groups = cut_lineage(groups.select("sha", "best"))
    shared = docs.sparkSession.sparkContext.broadcast(sieve.bits(groups, F.col("best.fp")).tobytes())
    sha = "sha"
    while sha in docs.columns:
        sha += "_"

    names = [*docs.columns, sha]

    def part(inside):
        def run(batches):
            for batch in small(batches):
                shas = [hashlib.sha256(x).digest() for x in _texts(batch)]
                may = pa.array(sieve.passes(shared.value, np.fromiter(map(_print, shas), np.int64, len(shas))) == inside)
                columns = [*batch.columns, pa.array(shas, pa.binary())] if inside else batch.columns
                yield pa.RecordBatch.from_arrays(columns, names=names[:len(columns)]).filter(may)
        return run

    inside = docs.mapInArrow(part(True), T.StructType([*docs.schema.fields, T.StructField(sha, T.BinaryType())]))
    inside = inside.join(groups.select(F.col("sha").alias(sha), "best").alias("g"), sha, "left")
    stays = F.col("g.best").isNull() | (F.col("doc_id").eqNullSafe(F.col("g.best.doc_id")) & (F.char_length(F.coalesce("text", F.lit(""))) == -F.col("g.best.few")))
    once = inside.where(stays).select(*docs.columns, sha).dropDuplicates([sha])          # repeated rows
    return docs.mapInArrow(part(False), docs.schema).union(once.select(docs.columns))
