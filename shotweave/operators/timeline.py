"""Laying clips on a timeline."""
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import media
from .ordered import running


def timeline(plan: DataFrame, beats: DataFrame, files: DataFrame):
    """Script plan to clips end to end. Returns (clips, skipped).

    plan(script_id, beat_i, slot_i, shot_id, file_id, t_start, t_end, trim_in), beats(script_id, i, dur), files(id, path, duration).
    Beats without shots keep their time; shots without a file are skipped with a reason.
    """
    per = plan.groupBy("script_id", "beat_i").agg(F.count("*").alias("n"))
    b = beats.select("script_id", F.col("i").alias("beat_i"), "dur").join(per, ["script_id", "beat_i"], "left")
    f = files.select(F.col("id").alias("file_id"), "path", "duration")
    p = plan.join(f, "file_id", "left").join(b, ["script_id", "beat_i"])
    skipped = p.where("path IS NULL").select("script_id", "beat_i", "shot_id", F.lit("no local video file").alias("reason"))
    per_s = F.col("dur") / F.col("n")
    fd = F.coalesce("duration", F.col("t_end") + per_s)
    src_in = media.source_in(F.coalesce("trim_in", "t_start"), per_s, fd)
    c = p.where("path IS NOT NULL").withColumns({"src_in": src_in, "src_out": F.least(fd, src_in + per_s)})
    c = c.select("script_id", "beat_i", "slot_i", "shot_id", "path", "src_in", "src_out", (F.col("src_out") - F.col("src_in")).alias("len"))
    gap = b.where("n IS NULL").select("script_id", "beat_i", F.lit(-1).cast("long").alias("slot_i"), F.lit(None).cast("long").alias("shot_id"),
                                      F.lit(None).cast("string").alias("path"), F.lit(0.0).alias("src_in"), F.lit(0.0).alias("src_out"), F.col("dur").alias("len"))
    u = running(c.unionByName(gap), "script_id", F.floor(F.col("beat_i") / 4096), ["beat_i", "slot_i"], rec_out=("sum", F.col("len")))
    clips = u.where("shot_id IS NOT NULL").withColumn("rec_in", F.col("rec_out") - F.col("len")).drop("len")
    return clips, skipped


def editor_timeline(slots: DataFrame, files: DataFrame):
    """Editor spots to placed clips. slots(video_id, slot_id, start, end, shot_id, file_id, t_start, t_end, trim_in). Returns (clips, skipped)."""
    s = slots.where("shot_id IS NOT NULL")
    w = W.partitionBy("video_id").orderBy("start", "slot_id")
    s = s.withColumn("spot", F.row_number().over(w)).join(files.select(F.col("id").alias("file_id"), "path", "duration"), "file_id", "left")
    skipped = s.where("path IS NULL").select("video_id", "spot", F.col("start").alias("at"), "shot_id", F.lit("no local video file").alias("reason"))
    dur = F.col("end") - F.col("start")
    fd = F.coalesce("duration", "t_end", dur)
    src_in = media.source_in(F.coalesce("trim_in", "t_start", F.lit(0.0)), dur, fd)
    clips = s.where("path IS NOT NULL").withColumns({"src_in": src_in, "clip_end": F.least(F.col("end"), F.col("start") + (fd - src_in))})
    return clips.select("video_id", "spot", "slot_id", "shot_id", "start", F.col("clip_end").alias("end"), "src_in", "path"), skipped


def frame_columns(clips: DataFrame, fps: int = 25) -> DataFrame:
    """Whole-frame in, out, start, end; the record length equals the source length."""
    f = lambda c: media.to_frames(F.col(c), fps)
    return clips.withColumns({"f_in": f("src_in"), "f_out": f("src_out"), "f_start": f("rec_in"), "f_end": f("rec_in") + f("src_out") - f("src_in")})


def credit_sheet(clips: DataFrame) -> DataFrame:
    """clips(video_id, source_key, start, end, title, author, source, licence_class, licence, licence_url, page_url): one row per source used."""
    from ..functions.fixed import COMMERCIAL_CLASSES
    used = F.concat(F.format_string("%.1f", "start"), F.lit("-"), F.format_string("%.1f", "end"), F.lit("s"))
    facts = ["title", "author", "source", "licence_class", "licence", "licence_url", "page_url"]
    d = clips.withColumn("__u", F.struct("start", used.alias("u"))).groupBy("video_id", "source_key").agg(
        *[F.min_by(c, "start").alias(c) for c in facts], F.array_join(F.transform(F.array_sort(F.collect_list("__u")), lambda x: x["u"]), ", ").alias("used_at"))
    ok = F.col("licence_class").isin(*COMMERCIAL_CLASSES)
    credit = F.when(F.col("licence_class") == "attribution", media.credit_line(*[F.col(c) for c in ("title", "author", "licence", "licence_url", "page_url")]))
    total = d.groupBy("video_id").agg(F.bool_and(ok).alias("all_commercial"))
    return d.withColumns({"commercial": ok, "credit": credit}).join(total, "video_id")
