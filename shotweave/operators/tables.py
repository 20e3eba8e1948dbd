"""Catalogue tables: snapshot, idempotent writes, backfill, caches, libraries."""
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import media


def source_key(file_id: Column, stock_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("f"), file_id.cast("string")), F.concat(F.lit("s"), stock_id.cast("string")))


def shots_dim(shots: DataFrame, stock: DataFrame, files: DataFrame) -> DataFrame:
    """Denormalised snapshot: active shots with an embedding, defaults filled, licence class and library derived."""
    st = stock.select(F.col("id").alias("stock_id"), F.col("source").alias("si_source"), "title", "tags", "author",
                      "page_url", "licence", "licence_url", F.col("library_id").alias("si_lib"))
    fi = files.select(F.col("id").alias("file_id"), "path", F.col("library_id").alias("f_lib"))
    return (shots.where("active AND emb IS NOT NULL")
            .join(st, "stock_id", "left").join(fi, "file_id", "left")
            .select("shot_id", "file_id", "stock_id", source_key(F.col("file_id"), F.col("stock_id")).alias("source_key"),
                    "t_start", "t_end", "emb",
                    *[F.coalesce(c, F.lit("unknown")).alias(c) for c in ("size", "motion", "orientation")],
                    "weather", "weather_conf", F.coalesce("si_source", F.lit("own")).alias("source"),
                    media.licence_class(F.col("licence"), F.col("licence_url"), F.col("si_source")).alias("licence_class"),
                    F.coalesce("f_lib", "si_lib", F.lit(0)).cast("long").alias("lib"),
                    "path", "title", "tags", "author", "page_url", "licence", "licence_url"))


def insert_ignore(target: DataFrame, new: DataFrame, keys, order: str) -> DataFrame:
    """Rows of `new` to append: one per key (first by `order`), none whose key exists."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in new.columns if c not in keys]), order).alias("r"))
    return first.select(*keys, "r.*").join(target.select(*keys).distinct(), keys, "left_anti")


def new_only(items: DataFrame, existing: DataFrame, keys) -> DataFrame:
    return items.join(existing.select(*keys).distinct(), keys, "left_anti")


def upsert(target: DataFrame, new: DataFrame, keys, version: str) -> DataFrame:
    """Last version per key. Pre-aggregates on each side of the shuffle, so a key with many versions costs one row a task."""
    rest = [c for c in target.columns if c not in keys]
    both = target.unionByName(new.select(*target.columns))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def upsert_columns(target: DataFrame, new: DataFrame, keys, cols) -> DataFrame:
    """Partial upsert: new non-null values of `cols` win, other columns stay, unknown keys are added."""
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in cols])
    return target.join(n, keys, "full").select(
        *keys, *[F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in target.columns if c not in keys])


def adopt_stock(shots: DataFrame, provenance: DataFrame, stock: DataFrame, files: DataFrame):
    """A stock clip became a local file: retire its placeholder shot, carry its identity to the file's shots.

    Returns (shots, provenance).
    """
    adopted = files.where("stock_id IS NOT NULL").select(F.col("id").alias("file_id"), F.col("stock_id").alias("adopt_id")).distinct()
    s = shots.join(adopted, "file_id", "left")
    retired = adopted.select(F.col("adopt_id").alias("stock_id")).distinct().withColumn("__gone", F.lit(True))
    s = s.join(retired, "stock_id", "left")
    s = s.select("shot_id", "file_id", F.coalesce("adopt_id", "stock_id").alias("stock_id"),
                 (F.col("active") & ~(F.col("file_id").isNull() & F.coalesce("__gone", F.lit(False)))).alias("active"))
    it = stock.select(F.col("id").alias("stock_id"), "published_at", "date_kind", F.col("gps_lat").alias("__la"),
                      F.col("gps_lon").alias("__lo"), "source")
    who = s.join(adopted, "file_id", "left_semi").select("shot_id", "stock_id").join(it, "stock_id").drop("stock_id")
    p = provenance.join(who, "shot_id", "left").select(
        "shot_id", F.coalesce("published_at", "shot_date").alias("shot_date"),
        F.when(F.col("published_at").isNotNull(), F.coalesce("date_kind", F.lit("unknown"))).otherwise(F.col("date_source")).alias("date_source"),
        F.coalesce("__la", "gps_lat").alias("gps_lat"), F.coalesce("__lo", "gps_lon").alias("gps_lon"),
        F.coalesce("source", "source_kind").alias("source_kind"))
    return s, p


def needs_backfill(rows: DataFrame, done: DataFrame, key: str, stage: str, model_ver: str, force: bool = False) -> DataFrame:
    if force:
        return rows
    d = done.where((F.col("stage") == stage) & (F.col("model_ver") == model_ver)).select(key).distinct()
    return rows.join(d, key, "left_anti")


def fresh(cache: DataFrame, now: Column, ttl_s: float = 24 * 3600) -> DataFrame:
    return cache.where(now.cast("double") - F.col("fetched_at").cast("double") < ttl_s)


def cache_key(url: Column, params: Column, secret: str = "key") -> Column:
    """Hash of url and parameters; the secret parameter and parameter order do not count."""
    kept = F.map_filter(params, lambda k, _: k != secret)
    return F.sha1(F.concat(url, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))))


def content_hash(size: Column, content: Column, part: int = 1 << 20) -> Column:
    """sha1 over size, first and (for large files) last megabyte of a binary column."""
    tail = F.when(size > 2 * part, F.substring(content, -part, part)).otherwise(F.lit(b""))
    return F.sha1(F.concat(size.cast("string").cast("binary"), F.substring(content, 1, part), tail))


def mark_duplicates(files: DataFrame) -> DataFrame:
    """files(id, content_hash, status): later files with the content of an earlier ok file become 'duplicate'."""
    first = (files.where("status = 'ok'").groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
             .where("n > 1").drop("n"))
    j = files.join(first, "content_hash", "left")
    return j.select("id", "content_hash", F.when((F.col("status") == "ok") & (F.col("id") > F.col("first_id")), "duplicate")
                    .otherwise(F.col("status")).alias("status"))


def pending_tasks(tasks: DataFrame, cursors: DataFrame) -> DataFrame:
    return tasks.join(cursors.where("done").select("source", "query", "page"), ["source", "query", "page"], "left_anti")


def library_counts(dim: DataFrame) -> DataFrame:
    return dim.groupBy("lib").agg(F.count("*").alias("shots"), F.countDistinct("source_key").alias("clips"))


def claim_library(items: DataFrame, ids: DataFrame, library_id: int, key: str = "source_id") -> DataFrame:
    """Items that were found again join the library if they have none yet."""
    hit = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    return items.join(hit, key, "left").withColumn(
        "library_id", F.when(F.col("library_id").isNull() & F.col("__hit"), F.lit(library_id).cast("long")).otherwise(F.col("library_id"))
    ).drop("__hit")


def drop_library(df: DataFrame, library_id: int) -> DataFrame:
    return df.withColumn("library_id", F.when(F.col("library_id") != library_id, F.col("library_id")))


def valid_preview(df: DataFrame, min_side: int = 48) -> DataFrame:
    return df.where(F.least("width", "height") >= min_side)


def status_counts(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """outer -> map(inner -> n)."""
    flat = status_counts(df, outer, inner)
    return flat.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "n")))).alias("counts"))


def cards(ids: DataFrame, dim: DataFrame, provenance: DataFrame) -> DataFrame:
    """Display columns for a list of shot ids."""
    p = provenance.select("shot_id", "shot_date", "date_source")
    name = F.coalesce(F.when(F.col("path") != "", F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1)),
                      "title", F.concat(F.lit("stock "), F.col("stock_id").cast("string")))
    return (ids.join(dim, "shot_id").join(p, "shot_id", "left")
            .select(*ids.columns, name.alias("file"), F.bround("t_start", 2).alias("t_start"), F.bround("t_end", 2).alias("t_end"),
                    "size", "motion", "orientation", "weather", "source", "author", "page_url",
                    F.substring(F.coalesce("shot_date", F.lit("")), 1, 10).alias("date"),
                    F.coalesce("date_source", F.lit("unknown")).alias("date_source"), "title",
                    media.licence_card(F.col("licence"), F.col("licence_url"), F.col("source"), F.coalesce("title", "path"),
                                       F.col("author"), F.col("page_url")).alias("licence")))


def facts(ids: DataFrame, dim: DataFrame, provenance: DataFrame) -> DataFrame:
    """Evidence columns for a list of shot ids."""
    p = provenance.select("shot_id", "shot_date", "date_source", "ocr_text", "gps_lat", "gps_lon")
    d = dim.select("shot_id", "weather", "weather_conf", "title", "tags", "source")
    return ids.join(d, "shot_id").join(p, "shot_id", "left")


def clear_memory(pairs: DataFrame) -> DataFrame:
    return pairs.limit(0)
