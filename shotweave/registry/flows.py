"""Segmentation, cut features and streaming forms."""
from pyspark.sql import functions as F

from ..functions import vector
from ..operators import aggregates
from ..operators.ordered import rank_in_key
from ..session import work_folder
from ..streaming import jobs, segment
from . import bindings as b
from .base import query


def samples(spark, d):
    """Embeddings of a label in id order, one a second."""
    e = b.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("file_id"), "vec_id", vector.as_double(F.col("embedding")).alias("emb"))
    r = rank_in_key(e, "file_id", F.floor(F.col("vec_id") / 4096), ["vec_id"], "k")
    return r.select("file_id", (F.col("k") - 1).cast("double").alias("t"), "emb", "vec_id")


SAMPLES = """
samples AS (SELECT label::BIGINT AS file_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::DOUBLE AS t, embedding::DOUBLE[] AS emb, vec_id FROM embeddings)"""
SEGMENTS = SAMPLES + """,
lagged AS (SELECT *, lag(emb) OVER (PARTITION BY file_id ORDER BY t) AS prev FROM samples),
cut AS (SELECT file_id, t, emb, CASE WHEN prev IS NULL OR list_inner_product(coalesce(prev, emb), emb) < 0.0 THEN 1 ELSE 0 END AS c FROM lagged),
run AS (SELECT *, sum(c) OVER (PARTITION BY file_id ORDER BY t) AS run FROM cut),
part AS (SELECT *, floor((t - min(t) OVER (PARTITION BY file_id, run)) / 4) AS part FROM run),
shot AS (SELECT file_id, run, part, min(t) AS t_start, max(t) + 1 AS t_end, count(*) AS n FROM part GROUP BY 1, 2, 3),
mean AS (SELECT file_id, run, part, pos, avg(x) AS x FROM (SELECT file_id, run, part, unnest(emb) AS x, unnest(range(len(emb))) AS pos FROM part) GROUP BY 1, 2, 3, 4),
vec AS (SELECT file_id, run, part, arg_min(x, pos) / sqrt(sum(x * x)) AS x1 FROM mean GROUP BY 1, 2, 3)"""


@query("shot_segments", b.with_sql(SEGMENTS) + "SELECT file_id, t_start, t_end, n, round(x1, 4) AS x1 FROM shot JOIN vec USING (file_id, run, part)")
def shot_segments(spark, d):
    return segment.segment_shots(samples(spark, d), 0.0).select("file_id", "t_start", "t_end", "n", F.round(F.get("emb", F.lit(0)), 4).alias("x1"))


@query("irregular_shot_segments", b.with_sql(SEGMENTS) + "SELECT file_id, t_start, t_end, n, round(x1, 4) AS x1 FROM shot JOIN vec USING (file_id, run, part)")
def irregular_shot_segments(spark, d):
    return segment.segment_irregular(samples(spark, d), 0.0).select("file_id", "t_start", "t_end", "n", F.round(F.get("emb", F.lit(0)), 4).alias("x1"))


@query("merged_short_shots", b.with_sql(SAMPLES + """,
s AS (SELECT file_id, t * 4 AS t_start, t * 4 + (vec_id % 5) * 0.6::DOUBLE AS t_end, emb, vec_id % 3 + 1 AS n, lag(t) OVER (PARTITION BY file_id ORDER BY t) IS NULL OR (vec_id % 5) * 0.6 >= 1 AS o FROM samples),
g AS (SELECT *, sum(o::INT) OVER (PARTITION BY file_id ORDER BY t_start) AS g FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id, g.g ORDER BY t_start) AS k FROM g),
fold AS (SELECT file_id, g, k, emb AS e, n::DOUBLE AS m FROM r WHERE k = 1 UNION ALL
  SELECT file_id, g, k, [x / sqrt(list_inner_product(v, v)) FOR x IN v], m FROM
   (SELECT r.file_id, r.g, r.k, [e[i] * m + emb[i] * n FOR i IN range(1, len(e) + 1)] AS v, m + n AS m FROM fold JOIN r ON r.file_id = fold.file_id AND r.g = fold.g AND r.k = fold.k + 1)),
ends AS (SELECT file_id, g, min(t_start) AS t_start, arg_max(t_end, t_start) AS t_end, sum(n) AS n, max(k) AS k FROM r GROUP BY 1, 2)""", recursive=True) + """
SELECT file_id, t_start, round(t_end, 4) AS t_end, n, round(e[1], 4) AS x1, round(list_sum([e[i] * i FOR i IN range(1, len(e) + 1)]), 4) AS all_components FROM ends JOIN fold USING (file_id, g, k)""")
def merged_short_shots(spark, d):
    s = samples(spark, d).select("file_id", (F.col("t") * 4).alias("t_start"), (F.col("t") * 4 + (F.col("vec_id") % 5) * 0.6).alias("t_end"), "emb", (F.col("vec_id") % 3 + 1).alias("n"))
    total = F.aggregate(F.transform("emb", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return segment.merge_short(s).select("file_id", "t_start", F.round("t_end", 4).alias("t_end"), "n", F.round(F.get("emb", F.lit(0)), 4).alias("x1"), F.round(total, 4).alias("all_components"))


@query("picture_cuts", b.with_sql(SAMPLES + """,
h AS (SELECT file_id, t * 0.5::DOUBLE AS t, [abs(x) / list_sum([abs(y) FOR y IN emb]) FOR x IN emb] AS h FROM samples),
l AS (SELECT *, lag(h) OVER (PARTITION BY file_id ORDER BY t) AS p FROM h),
c AS (SELECT file_id, t FROM l WHERE p IS NOT NULL AND sqrt(greatest(1 - list_sum([sqrt(h[i] * coalesce(p, h)[i]) FOR i IN range(1, len(h) + 1)]), 0)) > 0.33),
walk AS (SELECT DISTINCT file_id, 0.0::DOUBLE AS t FROM c UNION ALL SELECT w.file_id, min(c.t) FROM walk w JOIN c ON c.file_id = w.file_id AND c.t - w.t >= 0.8 GROUP BY 1)""", recursive=True) +
       "SELECT file_id AS video_id, t AS cut FROM walk WHERE t > 0")
def picture_cuts(spark, d):
    total = F.aggregate("emb", F.lit(0.0), lambda s, x: s + F.abs(x))
    h = samples(spark, d).withColumn("z", total).select(F.col("file_id").alias("video_id"), (F.col("t") * 0.5).alias("t"), F.transform("emb", lambda x: F.abs(x) / F.col("z")).alias("h"))
    return segment.picture_cuts(h, 0.33)


def event_samples(spark, d):
    """Event values as grey level of a user's shot, a sample per event."""
    e = b.table(spark, d, "events").select(F.col("user_id").alias("shot_id"), "event_id", "value")
    r = rank_in_key(e, "shot_id", F.floor(F.col("event_id") / 4096), ["event_id"], "k")
    return r.select("shot_id", ((F.col("k") - 1) / 2).alias("t"), "value")


EV = """
es AS (SELECT user_id AS shot_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 2.0::DOUBLE AS t, value FROM events),
sh AS (SELECT shot_id, 0.0::DOUBLE AS t_start, max(t) AS t_end FROM es GROUP BY 1)"""


def event_shots(spark, d):
    return event_samples(spark, d).groupBy("shot_id").agg(F.lit(0.0).alias("t_start"), F.max("t").alias("t_end"))


@query("motion_levels", b.with_sql(EV) + """,
x AS (SELECT shot_id, abs(value - lag(value) OVER (PARTITION BY shot_id ORDER BY t)) AS c FROM es), m AS (SELECT shot_id, coalesce(avg(c), 0) AS s FROM x GROUP BY 1)
SELECT shot_id, round(s, 6) AS motion_score, CASE WHEN s < 20 THEN 'still' WHEN s < 25 THEN 'moderate' ELSE 'action' END AS motion FROM m""")
def motion_levels(spark, d):
    return aggregates.motion_level(event_samples(spark, d), "shot_id", "t", "value", 20.0, 25.0).withColumn("motion_score", F.round("motion_score", 6))


@query("motion_peaks", b.with_sql(EV) + """,
x AS (SELECT shot_id, t, lead(t) OVER w AS nt, abs(lead(value) OVER w - value) AS c FROM es WINDOW w AS (PARTITION BY shot_id ORDER BY t)),
p AS (SELECT shot_id, (t + nt) / 2 AS peak FROM x WHERE c > 1 QUALIFY row_number() OVER (PARTITION BY shot_id ORDER BY c DESC, t) = 1)
SELECT shot_id, round(coalesce(peak, (t_start + t_end) / 2), 4) AS peak_t FROM sh LEFT JOIN p USING (shot_id)""")
def motion_peaks(spark, d):
    return aggregates.motion_peak(event_samples(spark, d), event_shots(spark, d)).withColumn("peak_t", F.round("peak_t", 4))


@query("head_tail_features", b.with_sql(EV) + """,
m AS (SELECT shot_id, value, t, t > t_start AND t <= t_start + 1.2 AS h, t > t_end - 1.2 AND t > t_start AS z, abs(t - (t_start + t_end) / 2) AS off FROM es JOIN sh USING (shot_id) WHERE t_end - t_start >= 0.1)
SELECT shot_id, round(arg_min(value / 100, t), 4) AS head_luma, round(arg_min(value / 300, t), 4) AS head_warmth, round(arg_max(value / 100, t), 4) AS tail_luma, round(arg_max(value / 300, t), 4) AS tail_warmth,
 round(coalesce(sum(value % 3) FILTER (h), 0), 4) AS head_dx, round(coalesce(sum(value % 2) FILTER (h), 0), 4) AS head_dy, round(coalesce(sum(value % 3) FILTER (z), 0), 4) AS tail_dx,
 round(coalesce(sum(value % 2) FILTER (z), 0), 4) AS tail_dy, round(first(value % 1 ORDER BY off, t), 4) AS sal_x, round(first(value % 1 ORDER BY off, t) / 2, 4) AS sal_y FROM m GROUP BY 1""")
def head_tail_features(spark, d):
    v = F.col("value")
    fs = event_samples(spark, d).select("shot_id", "t", (v / 100).alias("luma"), (v / 300).alias("warmth"), (v % 3).alias("dx"), (v % 2).alias("dy"), (v % 1).alias("sal_x"), (v % 1 / 2).alias("sal_y"))
    f = aggregates.head_tail_features(fs, event_shots(spark, d), win=1.2)
    return f.select("shot_id", *[F.round(c, 4).alias(c) for c in f.columns if c != "shot_id"])


@query("thumbnail_features", "SELECT p_partkey AS shot_id, round(p_retailprice / 2000, 6) AS head_luma FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def thumbnail_features(spark, d):
    p = b.table(spark, d, "part")
    k = F.col("p_partkey")
    shots = p.select(k.alias("shot_id"), (k % 4 != 0).alias("active"), F.when(k % 3 != 0, k).alias("file_id"))
    thumbs = p.select(k.alias("shot_id"), (F.col("p_retailprice") / 2000).alias("luma"), F.lit(0.1).alias("warmth"), F.lit(0.4).alias("sal_x"), F.lit(0.5).alias("sal_y"))
    have = b.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("shot_id"))
    return aggregates.approx_features(thumbs, shots, have).select("shot_id", F.round("head_luma", 6).alias("head_luma"))


# ------------------------------------------------------------------------------------------ streams
def event_stream(spark, d):
    schema = b.table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("streamed_ingest_keys", "SELECT DISTINCT user_id, event_type FROM events")
def streamed_ingest_keys(spark, d):
    """First-seen items of the event stream, appended idempotently; run twice to show that a replay adds nothing."""
    target = work_folder(spark, "ingest")
    for _ in range(2):
        jobs.ingest_stream(event_stream(spark, d), target, work_folder(spark, "ingest-state"), ("user_id", "event_type"), "ts").awaitTermination()
    return spark.read.parquet(target).select("user_id", "event_type")


@query("streamed_feedback", "SELECT DISTINCT user_id AS project, event_type AS text, event_id % 50 AS shot_id, 1 AS label FROM events UNION SELECT user_id, event_type, (event_id + 1) % 50, 0 FROM events")
def streamed_feedback(spark, d):
    k = F.col("event_id")
    s = event_stream(spark, d).select(F.col("user_id").alias("project"), F.col("event_type").alias("text"), (k % 50).alias("chosen"), F.array((k + 1) % 50).alias("rejected"))
    target = work_folder(spark, "feedback")
    jobs.feedback_stream(s, target, work_folder(spark, "feedback-state")).awaitTermination()
    return spark.read.parquet(target).select("project", "text", "shot_id", "label")


@query("streamed_progress", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_progress(spark, d):
    target = work_folder(spark, "progress")
    counts = jobs.progress_stream(event_stream(spark, d), every="1 day")
    (counts.writeStream.outputMode("update").option("checkpointLocation", work_folder(spark, "progress-state")).trigger(availableNow=True)
     .foreachBatch(lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(target)).start().awaitTermination())
    r = spark.read.parquet(target).groupBy("start", "event_type").agg(F.max_by("n", "epoch").alias("n"))
    return r.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("streamed_snapshot", "SELECT event_type, count(*) AS n, max(event_id) AS newest FROM events GROUP BY 1")
def streamed_snapshot(spark, d):
    target = work_folder(spark, "snapshot")
    build = lambda s: b.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))
    jobs.refresh_stream(event_stream(spark, d), build, target, work_folder(spark, "snapshot-state")).awaitTermination()
    return jobs.latest_version(spark, target).select("event_type", "n", "newest")


@query("progress_counts", "SELECT event_type AS stage, (user_id % 3)::VARCHAR AS status, count(*) AS count FROM events GROUP BY 1, 2")
def progress_counts(spark, d):
    return jobs.progress_counts(b.table(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 3).cast("string").alias("status")))


@query("streamed_shot_segments", b.with_sql(SEGMENTS) + "SELECT file_id, t_start, t_end, n FROM shot")
def streamed_shot_segments(spark, d):
    """Shots of the sample stream; the final sample of a file closes its open shot."""
    folder = work_folder(spark, "samples")
    x = samples(spark, d).select("file_id", "t", "emb")
    end = x.groupBy("file_id").agg(F.max("t").alias("end"))
    x.join(end, "file_id").select("file_id", "t", "emb", (F.col("t") == F.col("end")).alias("last")).write.parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("file_id long, t double, emb array<double>, last boolean").parquet(folder)
    target = work_folder(spark, "segments")
    (segment.segment_stream(stream, 0.0).writeStream.outputMode("append").option("checkpointLocation", work_folder(spark, "segments-state"))
     .trigger(availableNow=True).format("parquet").start(target).awaitTermination())
    return spark.read.parquet(target).select("file_id", "t_start", "t_end", "n")
