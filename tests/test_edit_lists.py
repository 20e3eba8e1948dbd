"""Edit lists written and read back: whole long scripts, rows of one or of several lines, and an input that is worked out once."""
from pyspark.sql import functions as F

from shotweave.operators import ordered
from shotweave.sources import sinks, timelines


def clips_of(spark, n=9000):
    """Two scripts and one without a key; the first lasts 125 hours and a third of its clips bring a file of their own."""
    c = spark.range(n + 7).select(F.when(F.col("id") < n, 1).when(F.col("id") < n + 4, 2).alias("script_id"), F.when(F.col("id") < n, F.col("id")).otherwise(F.col("id") - n).alias("i"))
    file = F.when(F.col("i") % 3 == 0, F.col("i")).otherwise(F.col("i") % 5).cast("string")
    return c.select("script_id", (F.col("i") * 50.0).alias("rec_in"), (F.col("i") * 50.0 + 50).alias("rec_out"), (F.col("i") % 7).cast("double").alias("src_in"),
                    (F.col("i") % 7 + 50.0).alias("src_out"), F.concat(F.lit("/m/"), file).alias("path"), file.alias("name"), F.concat(F.lit("line "), F.col("i").cast("string")).alias("text"))


def wanted(clips):
    """Brute force: (script, event) -> (reel, name, src_in, src_out, rec_in, rec_out, note)."""
    out, seen, events = {}, {}, {}
    for r in sorted(clips.collect(), key=lambda r: (r.script_id or 0, r.rec_in)):
        reels = seen.setdefault(r.script_id, {})
        k = events[r.script_id] = events.get(r.script_id, 0) + 1
        out[r.script_id, k] = (f"AX{reels.setdefault(r.path, len(reels) + 1):04d}", r["name"], r.src_in, r.src_out, r.rec_in, r.rec_out, r.text)
    return out


def read_back(placements):
    rows = placements.collect()
    got = {(r.project, r.event): (r.reel, r["name"], r.src_in, r.src_out, r.rec_in, r.rec_out, r.note) for r in rows}
    assert len(got) == len(rows)
    return got


def test_long_scripts_come_back_whole(spark):
    clips = clips_of(spark).cache()
    rows = sinks.edl_rows(clips).select(F.col("script_id").alias("project"), "n", F.col("event").alias("line")).cache()
    want = wanted(clips)
    assert read_back(timelines.edl_placements(rows)) == want
    lines = rows.select("project", "n", F.posexplode(F.split("line", "\n")).alias("k", "line")).select("project", (F.col("n") * 10 + F.col("k")).alias("n"), "line")
    assert read_back(timelines.edl_placements(lines)) == want
    # lines that fall between the events of rows, and chunks that begin with a comment
    cut = rows.select("project", F.split("line", "\n").alias("l"), "n").select("project", F.explode(F.array(
        F.struct((F.col("n") * 2).alias("n"), F.concat(F.lit("\r\n"), F.get("l", F.lit(0)), F.lit("\r\n1 not an event")).alias("line")),
        F.struct((F.col("n") * 2 + 1).alias("n"), F.concat_ws("\r\n", F.slice("l", 2, 9)).alias("line")))).alias("x")).select("project", "x.*")
    assert read_back(timelines.edl_placements(cut)) == want


def test_clips_are_worked_out_once(spark):
    n = spark.sparkContext.accumulator(0)

    def seen(x):
        n.add(1)
        return x

    clips = clips_of(spark, 50).withColumn("rec_in", F.udf(seen, "double")("rec_in"))
    rows = sinks.edl_rows(clips)
    assert timelines.edl_placements(rows.select(F.col("script_id").alias("project"), "n", F.col("event").alias("line"))).count() == n.value == 57


def test_running_total_over_chunks(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 99).when(F.col("id") % 2 == 0, F.col("id") % 7).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    want, sums = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.t):
        want[r.t] = sums[r.k] = sums.get(r.k, 0) + (r.v or 0)
    got = ordered.running_total(df, "k", F.floor(F.col("t") / 100), ["t"], "s", F.coalesce("v", F.lit(0)))
    assert {r.t: r.s for r in got.collect()} == want
