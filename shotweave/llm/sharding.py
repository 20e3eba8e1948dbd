"""Vector bin packing of documents into shards: bytes, tokens and rows together."""
import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut_lineage, id_and_text

PARCELS = 512                                   # small groups share so many parcels per shard
WHOLE = 0.9                                     # a group above this share of a shard, in any measure, is split


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows: bytes, tokens, rows): largest first, where the dot product with the residual capacity is highest; then the
    byte sums are levelled by moves from the fullest to the emptiest shard."""
    share = items / np.maximum(items.sum(0), 1)
    residual = np.full((shards, items.shape[1]), 1 / shards)
    where = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -share.max(1))):
        fits = (residual >= share[i]).all(1)
        dot = residual @ share[i]
        where[i] = np.argmax(np.where(fits, dot, -np.inf)) if fits.any() else np.argmax(residual[:, 0])
        residual[where[i]] -= share[i]
    load = np.bincount(where, items[:, 0], shards)
    for _ in range(20 * shards):
        high, low = int(np.argmax(load)), int(np.argmin(load))
        gap = load[high] - load[low]
        mine = np.flatnonzero((where == high) & (items[:, 0] < gap))
        if not len(mine):
            break
        best = mine[np.argmin(np.abs(items[mine, 0] - gap / 2))]
        where[best], load[high], load[low] = low, load[high] - items[best, 0], load[low] + items[best, 0]
    return where


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per row of docs, under the law `bytes`.

    size is the text's UTF-8 bytes plus 1 (null: 1). Equal texts form a group, null one with empty. A group stays together unless it alone
    exceeds WHOLE of a shard in bytes, tokens or rows; then its rows are dealt into parts by a hash of doc_id. Groups above 1 / PARCELS of a shard are placed one by
    one, the others as parcels of a hash, so the driver holds at most a few thousand sums per shard whatever the input. slot counts rows within
    the shard by bucket of a hash and doc_id; equal rows take any order. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = cut_lineage(id_and_text(docs).select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("same"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens")))
    groups = cut_lineage(rows.groupBy("same").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")))
    total = groups.agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("r").alias("r")).first()
    limit = [max(1, total[c] or 0) / shards for c in "btr"]
    most = F.greatest(*(F.col(c) / F.lit(float(x)) for c, x in zip("btr", limit, strict=True)))
    large = groups.where(most > 1 / PARCELS).select("same", F.when(most > WHOLE, F.ceil(most * 8)).otherwise(1).cast("int").alias("parts"))
    # at most 3 * shards * PARCELS rows: each has more than 1 / PARCELS of a shard in one of three measures
    item = rows.join(F.broadcast(large), "same", "left").select("doc_id", "size", "text_crc32", "tokens", F.when(
        F.col("parts").isNull(), F.pmod(F.xxhash64("same"), F.lit(shards * PARCELS))).otherwise(
        F.xxhash64("same", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.col("parts")))).alias("item"))
    sums = item.groupBy("item").agg(F.sum("size"), F.sum("tokens"), F.count("*")).orderBy("item").collect()
    where = place(np.array([x[1:] for x in sums], float).reshape(-1, 3), shards)
    placed = spark.createDataFrame([(int(x[0]), int(w)) for x, w in zip(sums, where, strict=True)], "item long, shard int")
    buckets = max(16, -(-(total.r or 0) // (20_000 * shards)))
    out = item.join(F.broadcast(placed), "item").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = out.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (out.withColumn("n", F.row_number().over(within)).join(before, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
