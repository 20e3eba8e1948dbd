"""Edit memory over the event log."""
from pyspark.sql import functions as F

from ..functions import vector
from ..operators import memory, similarity, truth
from ..plans import plan as plans
from . import bindings as b
from .base import query


def lesson_pairs(spark, d):
    """Purchases are chosen shots, errors are passed-over ones; the user stands for the line they worked on."""
    n = b.table(spark, d, "embeddings").count()
    return b.table(spark, d, "events").where("event_type IN ('purchase', 'error')").select(
        F.col("user_id").alias("text_id"), F.pmod("event_id", F.lit(n)).alias("shot_id"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"))


def past_lines(spark, d):
    e = b.table(spark, d, "embeddings").select("vec_id", vector.as_double(F.col("embedding")).alias("emb"))
    n = e.count()
    u = b.table(spark, d, "events").select(F.col("user_id").alias("text_id")).distinct().withColumn("vec_id", F.pmod(F.col("text_id") * 3, F.lit(n)))
    return u.join(e, "vec_id").select("text_id", "emb")


LESSONS = """
pairs AS (SELECT user_id AS text_id, event_id % (SELECT count(*) FROM embeddings) AS shot_id, (event_type = 'purchase')::INT AS label FROM events WHERE event_type IN ('purchase', 'error')),
past AS (SELECT DISTINCT user_id AS text_id, embedding::DOUBLE[] AS emb FROM events JOIN embeddings ON vec_id = user_id * 3 % (SELECT count(*) FROM embeddings))"""


@query("memory_boost", b.with_sql(b.SHOTS, b.SCORED, LESSONS) + """,
cands AS (SELECT query_id AS line_id, shot_id FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shot_id) <= 20),
sim AS (SELECT l.shot_id AS line_id, text_id, (list_inner_product(l.emb, p.emb) - 0.3::DOUBLE) / 0.7::DOUBLE AS w FROM shots l, past p WHERE list_inner_product(l.emb, p.emb) >= 0.3),
told AS (SELECT line_id, shot_id, sum(CASE WHEN label = 1 THEN 1 ELSE -0.75 END * w) AS v, sum(label) AS pos FROM sim JOIN pairs USING (text_id) GROUP BY 1, 2),
alike AS (SELECT a.shot_id, z.shot_id AS past_shot FROM shots a JOIN shots z ON a.shot_id <> z.shot_id WHERE list_inner_product(a.emb, z.emb) > 0.35),
x AS (SELECT c.line_id, c.shot_id, v, pos FROM cands c JOIN told t ON t.line_id = c.line_id AND t.shot_id = c.shot_id
  UNION ALL SELECT c.line_id, c.shot_id, v * 0.5, 0 FROM cands c JOIN alike a ON a.shot_id = c.shot_id JOIN told t ON t.line_id = c.line_id AND t.shot_id = a.past_shot)
SELECT line_id, shot_id, round(least(greatest(sum(v), -1), 1) * 0.04, 4) AS bonus, sum(pos) AS hits FROM x GROUP BY 1, 2""")
def memory_boost(spark, d):
    s = b.shots(spark, d)
    c = similarity.dense_topk(b.self_queries(s), s, 20).select(F.col("query_id").alias("line_id"), "shot_id")
    m = memory.memory_boost(s.select(F.col("shot_id").alias("line_id"), "emb"), past_lines(spark, d), lesson_pairs(spark, d), c, s, 0.3, 0.35)
    return m.withColumn("bonus", F.round("bonus", 4))


STYLE = """
style AS (SELECT size, count(*) AS c FROM pairs JOIN shots USING (shot_id) WHERE label = 1 GROUP BY 1)"""


@query("house_style", b.with_sql(b.SHOTS, LESSONS, STYLE) + """SELECT (SELECT sum(c) FROM style) AS n, (SELECT string_agg(size || '=' || round_even(c / (SELECT sum(c) FROM style), 2)::DECIMAL(4, 2), ',' ORDER BY size) FROM style) AS mix,
  (SELECT count(*) FROM pairs WHERE label = 0) AS negatives, (SELECT count(DISTINCT text_id) FROM pairs WHERE label = 1) AS projects, (SELECT sum(c) FROM style) >= 5 AS active""")
def house_style(spark, d):
    s = memory.house_style(lesson_pairs(spark, d).withColumnRenamed("text_id", "project"), b.shots(spark, d))
    mix = F.array_join(F.array_sort(F.transform(F.map_entries("size_mix"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"])))), ",")
    return s.select("n", mix.alias("mix"), "negatives", "projects", "active")


@query("style_bonus", b.with_sql(b.SHOTS, LESSONS, STYLE) + """SELECT shot_id, round(coalesce(0.02 * round_even(c / (SELECT sum(c) FROM style), 2), 0), 4) AS style_bonus FROM shots LEFT JOIN style USING (size)""")
def style_bonus(spark, d):
    s = b.shots(spark, d)
    st = memory.house_style(lesson_pairs(spark, d).withColumnRenamed("text_id", "project"), s)
    return memory.style_bonus(s.select("shot_id", "size"), st).select("shot_id", F.round("style_bonus", 4).alias("style_bonus"))


@query("feedback_pairs", """WITH f AS (SELECT user_id, event_type, event_id AS chosen, [event_id + 1, event_id + 2, event_id + 3] AS rej FROM events)
SELECT DISTINCT user_id AS project, event_type AS text, chosen AS shot_id, 1 AS label FROM f UNION SELECT user_id, event_type, unnest(rej), 0 FROM f""")
def feedback_pairs(spark, d):
    k = F.col("event_id")
    e = b.table(spark, d, "events").select(F.col("user_id").alias("project"), F.col("event_type").alias("text"), k.alias("chosen"), F.array(k + 1, k + 2, k + 3, k + 4).alias("rejected"))
    return memory.feedback(e)


# placements: each event of a user lasts until the next one, in minutes since the start
def placements(spark, d):
    from ..operators.ordered import neighbour
    e = b.table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 6e7 - 1704067200 / 60.0)
    e = neighbour(e, "user_id", F.floor(F.col("t") / 1440), ["t"], {"t_next": F.col("t")}).where("t_next IS NOT NULL")
    return e.select(F.col("event_id").alias("p_id"), F.col("user_id").alias("project"), (F.col("event_id") % 10).alias("file_id"), (F.col("value") % 100).alias("src_in"),
                    (F.col("value") % 100 + F.least(F.col("t_next") - F.col("t"), F.lit(6.0))).alias("src_out"), F.col("t").alias("rec_in"), F.col("t_next").alias("rec_out"))


PLACEMENTS = """
ev AS (SELECT *, epoch_us(ts) / 6e7 - 1704067200 / 60.0::DOUBLE AS t FROM events),
placements AS (SELECT event_id AS p_id, user_id AS project, event_id % 10 AS file_id, value % 100 AS src_in, value % 100 + least(t_next - t, 6.0) AS src_out, t AS rec_in, t_next AS rec_out
  FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t_next FROM ev) WHERE t_next IS NOT NULL)"""
SPANS = """
spans AS (SELECT user_id AS project, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i, day * 1440.0::DOUBLE AS a, (day + 1) * 1440.0::DOUBLE AS b, 'day ' || day AS text
  FROM (SELECT DISTINCT user_id, floor((epoch_us(ts) / 6e7 - 1704067200 / 60.0::DOUBLE) / 1440)::BIGINT AS day FROM events))"""


def spans(spark, d):
    """Narration lines: one per user and active day."""
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 6e7 - 1704067200 / 60.0) / 1440)
    s = b.table(spark, d, "events").select(F.col("user_id").alias("project"), day.alias("day")).distinct()
    from ..operators.ordered import rank_in_key
    r = rank_in_key(s, "project", F.floor(F.col("day") / 64), ["day"], "i")
    return r.select("project", "i", (F.col("day") * 1440.0).alias("a"), ((F.col("day") + 1) * 1440.0).alias("b"), F.concat(F.lit("day "), F.col("day").cast("string")).alias("text"))


OVERLAP = """
ov AS (SELECT p_id, shot_id, least(t_end, src_out) - greatest(t_start, src_in) AS o FROM placements p JOIN shots s ON s.file_id = p.file_id),
best AS (SELECT p_id, shot_id, o AS overlap FROM ov WHERE o > -1 QUALIFY row_number() OVER (PARTITION BY p_id ORDER BY o DESC, shot_id) = 1)"""
COVER = """
cover AS (SELECT p_id, s.i, s.text FROM placements p JOIN spans s ON s.project = p.project AND a <= (rec_in + rec_out) / 2 AND (rec_in + rec_out) / 2 < b
  UNION ALL SELECT p_id, l.i, l.text FROM placements p JOIN (SELECT project, max(b) AS e, arg_max(i, b) AS i, arg_max(text, b) AS text FROM spans GROUP BY 1) l ON l.project = p.project AND (rec_in + rec_out) / 2 >= e)"""


@query("best_overlap_shot", b.with_sql(b.SHOTS, PLACEMENTS, OVERLAP) + "SELECT p_id, shot_id, round(overlap, 3) AS overlap FROM best")
def best_overlap_shot(spark, d):
    return memory.best_overlap_shot(placements(spark, d), b.shots(spark, d)).withColumn("overlap", F.round("overlap", 3))


@query("covering_line", b.with_sql(PLACEMENTS, SPANS, COVER) + "SELECT p_id, i, text FROM cover")
def covering_line(spark, d):
    return memory.covering_line(placements(spark, d), spans(spark, d))


@query("timeline_import_pairs", b.with_sql(b.SHOTS, PLACEMENTS, OVERLAP, SPANS, COVER) + "SELECT DISTINCT project, text, shot_id, 1 AS label FROM placements JOIN best USING (p_id) JOIN cover USING (p_id)")
def timeline_import_pairs(spark, d):
    return memory.import_timeline(placements(spark, d), spans(spark, d), b.shots(spark, d))


@query("timeline_import_report", b.with_sql(b.SHOTS, PLACEMENTS, OVERLAP, SPANS, COVER) + """
SELECT project, count(*) AS placements, count(*) FILTER (hs AND hl) AS matched, count(*) FILTER (NOT (hs AND hl)) AS unmatched, count(*) FILTER (NOT hs) AS no_shot, count(*) FILTER (NOT hl) AS no_line
FROM (SELECT project, p_id IN (SELECT p_id FROM best) AS hs, p_id IN (SELECT p_id FROM cover) AS hl FROM placements) GROUP BY 1""")
def timeline_import_report(spark, d):
    return memory.import_report(placements(spark, d), spans(spark, d), b.shots(spark, d))


@query("timeline_audit", b.with_sql(b.SHOTS, PLACEMENTS, OVERLAP, SPANS, COVER) + """
SELECT p_id, project, i, shot_id, CASE WHEN source <> 'own' THEN CASE WHEN i % 2 = 0 THEN 'warn' ELSE 'unverified' END ELSE 'unverified' END AS status
FROM placements JOIN best USING (p_id) JOIN cover USING (p_id) JOIN (SELECT shot_id, source FROM shots) USING (shot_id)""")
def timeline_audit(spark, d):
    """Even lines claim a place no shot has evidence for: stock under them is flagged, own footage is unverified."""
    claims = spans(spark, d).select("project", "i", F.when(F.col("i") % 2 == 0, F.array(F.struct(F.lit("Nowhere").alias("name"), F.lit("nowhere").alias("alias"), F.lit("city").alias("kind"), F.array(F.lit("Nowhere")).alias("anc"))))
                                    .otherwise(F.array().cast(f"array<{truth.PLACE}>")).alias("places"), F.lit(False).alias("place_inherited"), F.lit(None).cast("string").alias("time_kind"), F.lit(None).cast("int").alias("year"),
                                    F.lit(None).cast("string").alias("time_phrase"), F.lit(None).cast("string").alias("claim_weather"), F.lit(None).cast("string").alias("weather_phrase"))
    s = b.shots(spark, d)
    ev = s.select("shot_id", F.array().cast(f"array<{truth.EVIDENCE}>").alias("evidence"), F.lit(None).cast("string").alias("shot_date"), F.lit("unknown").alias("date_source"), "weather", "weather_conf", "source")
    return plans.audit_timeline(placements(spark, d), spans(spark, d), s, claims, ev, "2024-01-01").select("p_id", "project", "i", "shot_id", "status")


@query("placement_files", """WITH f AS (SELECT s_suppkey AS id, '/Media/Clip_' || s_suppkey || '.mp4' AS path FROM supplier),
p AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN '\\media\\CLIP_' || l_suppkey || '.MP4' ELSE '' END AS path, CASE WHEN l_linenumber % 3 = 1 THEN '_' || l_suppkey || '.mp4' ELSE '' END AS name FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber % 3 < 2 THEN l_suppkey END AS file_id FROM p""")
def placement_files(spark, d):
    """Items name their supplier's file by path, by the end of its name, or not at all."""
    f = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("/Media/Clip_"), F.col("s_suppkey").cast("string"), F.lit(".mp4")).alias("path"))
    n, k = F.col("l_linenumber") % 3, F.col("l_suppkey").cast("string")
    p = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.monotonically_increasing_id().alias("p_id"),
                                             F.when(n == 0, F.concat(F.lit("\\media\\CLIP_"), k, F.lit(".MP4"))).otherwise("").alias("path"),
                                             F.when(n == 1, F.concat(F.lit("_"), k, F.lit(".mp4"))).otherwise("").alias("name"))
    return memory.resolve_file(p, f).select("l_orderkey", "l_linenumber", "l_suppkey", "file_id")


@query("filmable_probe")
def filmable_probe(spark, d):
    """Probability that a labelled document is good, from hashed token features."""
    from pyspark.ml.functions import array_to_vector
    from ..functions import text
    x = b.table(spark, d, "documents").join(b.table(spark, d, "labels"), "doc_id")
    x = x.select("doc_id", F.col("quality").alias("y"), _hashed(text.tokens(F.col("text"))).alias("f")).withColumn("features", array_to_vector("f"))
    return memory.filmable_probability(memory.fit_filmable(x), x).select("doc_id", "y", F.round("visual", 3).alias("visual"))


def _hashed(tokens, dims: int = 32):
    """Share of tokens per hash bucket."""
    from ..functions.arrays import let
    def shares(h):
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(h, lambda x: x == i)) / F.greatest(F.size(h), F.lit(1)))
    return let(F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dims))), shares)


@query("probe_cross_validation")
def probe_cross_validation(spark, d):
    from pyspark.ml.functions import array_to_vector
    from ..functions import text
    from ..session import cut_lineage
    x = b.table(spark, d, "documents").join(b.table(spark, d, "labels"), "doc_id")
    x = cut_lineage(x.select(F.col("doc_id").alias("line_id"), F.col("quality").alias("y"), array_to_vector(_hashed(text.tokens(F.col("text")))).alias("features")))
    return memory.probe_cv(x, 3).withColumn("accuracy", F.round("accuracy", 3))
