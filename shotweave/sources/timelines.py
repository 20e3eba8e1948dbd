"""Edit decision lists and xmeml timelines as placements."""
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text
from ..operators.ordered import by_chunks, chunk_bases
from ..session import written

_TC = r"(\d\d+:\d\d:\d\d[:;]\d\d)"
_GAP = r"[^\S\n]"
EVENT = rf"^{_GAP}*(\d+){_GAP}+(\S+){_GAP}+V{_GAP}+C{_GAP}+{_TC}{_GAP}+{_TC}{_GAP}+{_TC}{_GAP}+{_TC}"


def read_edl(spark: SparkSession, path: str, fps: int = 25) -> DataFrame:
    """One row per event of every EDL file under `path`; a file is read whole so that its line order is kept."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("project"), "value")
    lines = raw.select("project", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    return edl_placements(lines, fps)


def edl_placements(lines: DataFrame, fps: int = 25) -> DataFrame:
    """lines(project, n, line): event lines open a placement, clip-name and comment lines belong to the event before them. A row may hold several lines."""
    # a part begins where a line may be an event line, so that only its first one can be
    d = lines.select("project", "n", F.posexplode(F.split(F.replace("line", F.lit("\r\n"), F.lit("\n")), r"\n(?=[\s\d])")).alias("k", "part"))
    d = d.select("project", "n", "k", F.concat(F.lit("\n"), "part").alias("part"),
                 F.split(F.regexp_replace(F.substring_index("part", "\n", 1), EVENT + ".*$", "$2\n$3\n$4\n$5\n$6"), "\n").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    two = lambda i, right: F.substring(at(i), -right, 2).try_cast("int")
    seconds = lambda i: (F.left(at(i), F.length(at(i)) - 9).try_cast("int") * 3600 + two(i, 8) * 60 + two(i, 5)) + two(i, 2) / F.lit(float(fps))
    ev = F.struct(at(0).alias("reel"), *[seconds(i).alias(c) for i, c in enumerate(("src_in", "src_out", "rec_in", "rec_out"), 1)])
    tail = lambda mark: F.when(F.contains("part", F.lit("\n" + mark)), F.trim(F.substring_index(F.substring_index("part", "\n" + mark, -1), "\n", 1)))
    d = d.select("project", F.floor(F.col("n") / 4096).alias("__c"), F.struct("n", "k").alias("n"), F.when(F.size("f") > 1, ev).alias("ev"),
                 tail("* FROM CLIP NAME:").alias("name"), tail("* COMMENT:").alias("note"))
    inside = W.partitionBy("project", "__c").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = written(d.withColumn("event", F.count("ev").over(inside)).where("ev IS NOT NULL OR name IS NOT NULL OR note IS NOT NULL"))
    bases = chunk_bases(d, ["project"], F.max("event"))
    if bases is not None:
        one, more = by_chunks(d, bases, ["project"])
        d = one.unionByName(more.withColumn("event", F.col("event") + F.col("__b")).drop("__b"))
    d = d.where("event > 0")
    if not d.where("ev IS NULL").isEmpty():         # names and comments in parts of their own go to the event before them
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n")))
        d = d.groupBy("project", "event").agg(F.max("ev").alias("ev"), last("name").alias("name"), last("note").alias("note"))
    return d.select("project", "event", "ev.reel", F.coalesce("name", F.lit("")).alias("name"), "ev.src_in", "ev.src_out", "ev.rec_in",
                    "ev.rec_out", F.coalesce("note", F.lit("")).alias("note"))


CLIP = ("name string, start long, `end` long, `in` long, out long, rate struct<timebase:int>, comments struct<mastercomment1:string>, "
        "file struct<_id:string, pathurl:string>")


def read_xmeml(spark: SparkSession, path: str, default_fps: int = 25) -> DataFrame:
    """One row per clip of every xmeml file. A file is declared once with its address and only referenced afterwards."""
    clips = (spark.read.format("xml").option("rowTag", "clipitem").schema(CLIP).load(path)
             .select("*", F.col("_metadata.file_name").alias("project")))
    seq = (spark.read.format("xml").option("rowTag", "sequence").schema("rate struct<timebase:int>").load(path)
           .select(F.col("_metadata.file_name").alias("project"), F.col("rate.timebase").alias("seq_rate")).groupBy("project").agg(F.max("seq_rate").alias("seq_rate")))
    declared = clips.where("file.pathurl IS NOT NULL").groupBy("project", F.col("file._id").alias("fid")).agg(F.min("file.pathurl").alias("url"))
    d = clips.withColumn("fid", F.col("file._id")).join(declared, ["project", "fid"]).join(seq, "project", "left")
    base = F.coalesce("seq_rate", F.lit(default_fps))
    own = F.coalesce("rate.timebase", base)
    z = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(0))
    return d.select("project", text.path_from_url(F.col("url")).alias("path"), F.coalesce("name", F.lit("")).alias("name"),
                    (z("in") / own).alias("src_in"), (z("out") / own).alias("src_out"), (z("start") / base).alias("rec_in"), (z("end") / base).alias("rec_out"),
                    F.coalesce("comments.mastercomment1", F.lit("")).alias("note"))


READERS = {"edl": read_edl, "xml": read_xmeml}
