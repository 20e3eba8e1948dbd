"""Continuous ingest, feedback, snapshot refresh and progress."""
from pyspark.sql import DataFrame, functions as F

from ..operators import memory, retrieval, tables


def _append_new(spark, target: str, new: DataFrame, keys, order: str):
    """First-wins append; the target is read again for every batch, so a replayed batch adds nothing."""
    try:
        existing = spark.read.parquet(target)
    except Exception as e:                                # first batch: the table does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = new.limit(0)
    tables.insert_ignore(existing, new, keys, order).write.mode("append").parquet(target)


def ingest_stream(items: DataFrame, target: str, checkpoint: str, keys=("source", "source_id"), ts: str = "ts",
                  delay: str = "1 hour", sim: float | None = None):
    """Append unseen items to `target`. With `sim`, near-duplicates of stored or earlier items are left out (id, emb, ord)."""
    d = items.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))

    def write(batch: DataFrame, _epoch: int):
        spark = batch.sparkSession
        if sim is not None:
            try:
                stored = spark.read.parquet(target).select("id", "emb")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                stored = batch.select("id", "emb").limit(0)
            batch = batch.join(retrieval.ingest_dedupe(batch.select("id", "emb", "ord"), stored, sim), "id", "left_semi")
        _append_new(spark, target, batch, list(keys), ts)
    return d.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback_stream(events: DataFrame, target: str, checkpoint: str):
    """events(project, text, chosen, rejected, ts): append positive and negative pairs not stored yet."""
    def write(batch: DataFrame, _epoch: int):
        pairs = memory.feedback(batch).withColumn("__o", F.lit(0))
        keys = ["project", "text", "shot_id", "label"]
        _append_new(batch.sparkSession, target, pairs, keys, "__o")
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_stream(changes: DataFrame, build, target: str, checkpoint: str):
    """Rebuild the snapshot after every batch of changes; each version is its own folder, readers pick the newest."""
    def write(batch: DataFrame, epoch: int):
        if not batch.isEmpty():
            build(batch.sparkSession).write.mode("overwrite").parquet(f"{target}/version={epoch}")
    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark, target: str) -> DataFrame:
    """Newest complete snapshot; the version is a partition column, so only its files are read."""
    d = spark.read.parquet(target)
    newest = d.select(F.max("version")).first()[0]
    return d.where(F.col("version") == newest)


def progress_counts(events: DataFrame, stage: str = "stage", status: str = "status") -> DataFrame:
    return events.groupBy(stage, status).count()


def progress_stream(events: DataFrame, ts: str = "ts", every: str = "1 minute", delay: str = "10 minutes", kind: str = "event_type") -> DataFrame:
    """Tumbling counts per kind with a watermark. `ts` is cast because event time must be a TIMESTAMP."""
    d = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    return d.groupBy(F.window("__ts", every), kind).count().select(F.col("window.start").alias("start"), kind, F.col("count").alias("n"))
