"""Text sinks: caption tracks, edit lists and credit sheets, one document per script."""
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import media, text
from ..operators.ordered import first_use, rank_in_key
from ..operators.timeline import frame_columns


def srt_rows(clips: DataFrame, by: str = "script_id", start: str = "rec_in", end: str = "rec_out", label: str = "label") -> DataFrame:
    """Numbered caption cues of the clips that carry a label."""
    d = clips.where(F.coalesce(label, F.lit("")) != "").withColumn("__s", F.col(start))
    d = rank_in_key(d, by, F.floor(F.col("__s") / 3600), ["__s", end], "n")
    cue = F.concat_ws("\n", F.col("n").cast("string"), F.concat(media.srt_time(F.col(start)), F.lit(" --> "), media.srt_time(F.col(end))), F.col(label), F.lit(""))
    return d.select(by, "n", cue.alias("cue"))


def caption_rows(captions: DataFrame, by: str = "video_id") -> DataFrame:
    return srt_rows(captions, by, "start", "end", "lines")


def edl_rows(clips: DataFrame, fps: int = 25, by: str = "script_id") -> DataFrame:
    """clips(by, rec_in, rec_out, src_in, src_out, path, name, text): one EDL event per clip, one reel per source file."""
    d = frame_columns(clips, fps).select(by, "rec_in", "rec_out", "f_in", "f_out", "f_start", "f_end", "path", "name", F.substring("text", 1, 80).alias("text"))
    d = first_use(d, by, F.floor(F.col("rec_in") / 3600), ["rec_in", "rec_out"], "path", "n", "reel_no")
    tc = lambda c: media.timecode(F.col(c), fps)
    event = F.concat(media.padded(F.col("n"), 3), F.lit("  "), F.rpad(F.concat(F.lit("AX"), media.padded(F.col("reel_no"), 4)), 8, " "), F.lit(" V     C        "),
                     F.concat_ws(" ", tc("f_in"), tc("f_out"), tc("f_start"), tc("f_end")))
    body = F.concat_ws("\n", event, F.concat(F.lit("* FROM CLIP NAME: "), F.col("name")), F.concat(F.lit("* COMMENT: "), F.col("text")), F.lit(""))
    return d.select(by, "n", body.alias("event"))


def credit_rows(clips: DataFrame, by: str = "script_id") -> DataFrame:
    """One credit line per distinct third-party source file, in order of first use."""
    own = F.coalesce("source", F.lit("own")) == "own"
    d = clips.where(~own).groupBy(by, "path").agg(F.min_by(F.struct("name", "source", "author", "page_url"), "rec_in").alias("r"), F.min("rec_in").alias("at"))
    d = rank_in_key(d, by, F.floor(F.col("at") / 3600), ["at", "path"], "n")
    return d.select(by, "n", F.concat_ws(" · ", "r.name", "r.source", F.concat(F.lit("by "), F.coalesce("r.author", F.lit("unknown"))),
                                         F.coalesce("r.page_url", F.lit(""))).alias("line"))


def write_documents(rows: DataFrame, path: str, by: str, text_col: str, head: str = "") -> None:
    """Write one folder per document, lines in order. Rows are range-sorted, never collected."""
    body = rows.select(F.col(by).cast("string").alias("doc"), "n", F.col(text_col).alias("value"))
    if head:
        body = body.unionByName(rows.select(F.col(by).cast("string").alias("doc")).distinct().select("doc", F.lit(0).cast("long").alias("n"), F.lit(head).alias("value")))
    # one document stays in one task, in order; documents spread over tasks
    body.repartition("doc").sortWithinPartitions("doc", "n").select("doc", "value").write.mode("overwrite").partitionBy("doc").text(path)


SINKS = {"srt": srt_rows, "edl": edl_rows, "credits": credit_rows}
