"""Gates, ranks, caps, interleaving and merging over the event log and the order tables."""
from pyspark.sql import functions as F

from ..operators import filters, ordered, windows
from ..plans import plan as plans
from ..plans import search as search_plan
from . import bindings as b
from .base import query


def event_cands(spark, d):
    """Events as candidates of their user: score from the value, source from the type."""
    e = b.table(spark, d, "events")
    return e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("shot_id"), (F.col("value") / 100).alias("score"), F.col("event_type").alias("source"),
                    F.concat(F.lit("f"), (F.col("event_id") % 40).cast("string")).alias("source_key"))


EC = "ec AS (SELECT user_id AS query_id, event_id AS shot_id, value / 100 AS score, event_type AS source, 'f' || event_id % 40 AS source_key FROM events)"


@query("relevance_gate", b.with_sql(EC) + "SELECT query_id, shot_id FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM ec) WHERE score >= greatest(0.18, best - 0.4::DOUBLE)")
def relevance_gate(spark, d):
    return filters.gate(event_cands(spark, d), 0.18, 0.4).select("query_id", "shot_id")


@query("source_cap", b.with_sql(EC) + "SELECT query_id, shot_id FROM ec QUALIFY row_number() OVER (PARTITION BY query_id, source_key ORDER BY score DESC, shot_id) <= 2")
def source_cap(spark, d):
    return windows.cap_per_source(event_cands(spark, d), 2).select("query_id", "shot_id")


@query("confidence_floor", b.with_sql(EC) + "SELECT query_id, CASE WHEN score >= 0.31 THEN shot_id END AS shot_id, CASE WHEN score < 0.31 THEN shot_id END AS suggested FROM ec")
def confidence_floor(spark, d):
    return filters.confidence_floor(event_cands(spark, d)).select("query_id", "shot_id", "suggested")


@query("ranked_top_k", b.with_sql(EC) + "SELECT query_id, shot_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shot_id) AS rank FROM ec QUALIFY rank <= 24")
def ranked_top_k(spark, d):
    return windows.topk(event_cands(spark, d), 24, "query_id", [F.desc("score"), "shot_id"]).select("query_id", "shot_id", "rank")


@query("hot_source_rank", b.with_sql(EC) + "SELECT source, shot_id, row_number() OVER (PARTITION BY source ORDER BY score DESC, shot_id) AS rn FROM ec")
def hot_source_rank(spark, d):
    """Rank inside five very large keys, over range partitions of the whole order."""
    return ordered.numbered(event_cands(spark, d), "source", [F.desc("score"), "shot_id"], "rn").select("source", "shot_id", "rn")


@query("interleaved_sources", b.with_sql(EC) + """,
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, shot_id) AS turn, max(score) OVER (PARTITION BY query_id, source) AS best FROM ec)
SELECT query_id, shot_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, best DESC, source) AS place FROM t QUALIFY place <= 24""")
def interleaved_sources(spark, d):
    return windows.interleave_sources(event_cands(spark, d), 24).select("query_id", "shot_id", "place")


@query("best_per_video", b.with_sql(EC) + """,
s AS (SELECT query_id AS line_id, source_key, max(score) AS score, arg_max(shot_id, (score * 1e6)::BIGINT * 1000000 - shot_id) AS shot_id FROM ec GROUP BY 1, 2)
SELECT line_id, source_key, shot_id, row_number() OVER (PARTITION BY line_id ORDER BY score DESC, shot_id) AS rank FROM s QUALIFY rank <= 12""")
def best_per_video(spark, d):
    return windows.best_per_video(event_cands(spark, d).withColumnRenamed("query_id", "line_id"), 12).select("line_id", "source_key", "shot_id", "rank")


@query("round_robin_pick", """
WITH r AS (SELECT event_type AS q, user_id AS source_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events),
n AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS query_i FROM (SELECT DISTINCT event_type AS q FROM events)),
f AS (SELECT source_id, k, query_i, row_number() OVER (PARTITION BY source_id ORDER BY k, query_i) AS rn FROM r JOIN n USING (q))
SELECT source_id, k, query_i FROM f WHERE rn = 1 ORDER BY k, query_i, source_id LIMIT 40""")
def round_robin_pick(spark, d):
    e = b.table(spark, d, "events").withColumn("neg", -F.col("value"))
    r = ordered.rank_in_key(e, "event_type", F.floor(F.col("neg") / 2), ["neg", "event_id"], "k")
    n = e.select("event_type").distinct()
    n = ordered.rank_in_key(n.withColumn("one", F.lit(1)), "one", F.ascii("event_type"), ["event_type"], "n").select("event_type", (F.col("n") - 1).alias("query_i"))
    return windows.round_robin_pick(r.join(n, "event_type").select("query_i", "k", F.col("user_id").alias("source_id")), 40)


@query("ingest_task_order", """
WITH t AS (SELECT l_returnflag AS source, ascii(l_returnflag) AS source_pos, l_suppkey AS query_pos, l_linenumber AS page FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page, query_pos) AS turn FROM t)
SELECT source, query_pos, page, row_number() OVER (ORDER BY turn, source_pos) AS place FROM r""")
def ingest_task_order(spark, d):
    t = b.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("source"), F.ascii("l_returnflag").alias("source_pos"), F.col("l_suppkey").alias("query_pos"), F.col("l_linenumber").alias("page")).distinct()
    return windows.task_order(t).select("source", "query_pos", "page", "place")


@query("per_query_picks", """
WITH i AS (SELECT user_id AS query_i, user_id % 2 = 0 AS is_main, event_id % 700 AS source_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, CASE WHEN value > 60 THEN 0.5 ELSE 0 END AS overlap FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY query_i ORDER BY overlap DESC, pos) AS rk, count(*) FILTER (overlap > 0) OVER (PARTITION BY query_i) AS h FROM i),
k AS (SELECT *, least(h, CASE WHEN is_main THEN 18 ELSE 8 END) AS hits FROM r), kept AS (SELECT * FROM k WHERE rk <= CASE WHEN hits < 5 THEN 5 ELSE hits END)
SELECT query_i, source_id, rk AS rank FROM kept k WHERE query_i = (SELECT min(query_i) FROM kept z WHERE z.source_id = k.source_id)""")
def per_query_picks(spark, d):
    e = b.table(spark, d, "events")
    e = ordered.rank_in_key(e, "user_id", F.floor(F.col("event_id") / 4096), ["event_id"], "pos")
    i = e.select(F.col("user_id").alias("query_i"), (F.col("user_id") % 2 == 0).alias("is_main"), (F.col("event_id") % 700).alias("source_id"), "pos", F.when(F.col("value") > 60, 0.5).otherwise(0.0).alias("overlap"))
    return windows.per_query_pick(i).select("query_i", "source_id", "rank")


@query("ingest_budget", """
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS s FROM events),
k AS (SELECT * FROM r WHERE s <= CASE event_type WHEN 'click' THEN 300 WHEN 'view' THEN 90 ELSE 1000000000 END)
SELECT event_id, row_number() OVER (ORDER BY event_id) AS in_all FROM k QUALIFY in_all <= 700""")
def ingest_budget(spark, d):
    e = b.table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("source"), F.col("event_id"))
    return windows.global_budget(e, 700, {"click": 300, "view": 90}).select("event_id", "in_all")


@query("consecutive_events", """SELECT user_id, event_id, lead(event_id) OVER w AS next_event, round(lead(value) OVER w - value, 4) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY next_event IS NOT NULL""")
def consecutive_events(spark, d):
    c = windows.consecutive(b.table(spark, d, "events"), "user_id", "event_id", ["event_id", "value"])
    return c.select("user_id", "event_id", F.col("b_event_id").alias("next_event"), F.round(F.col("b_value") - F.col("value"), 4).alias("change"))


@query("running_timeline", """SELECT user_id, event_id, round(sum(value) OVER w - value, 2) AS rec_in, round(sum(value) OVER w, 2) AS rec_out FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def running_timeline(spark, d):
    r = windows.running_timeline(b.table(spark, d, "events"), "user_id", "value", "event_id")
    return r.select("user_id", "event_id", F.round("rec_in", 2).alias("rec_in"), F.round("rec_out", 2).alias("rec_out"))


@query("fit_order", b.with_sql(EC) + """SELECT query_id AS line_id, shot_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE shot_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, CASE WHEN shot_id % 3 = 0 THEN shot_id % 17 ELSE 0 END, score DESC, shot_id) AS place FROM ec""")
def fit_order(spark, d):
    m = F.col("shot_id") % 3
    c = event_cands(spark, d).withColumnRenamed("query_id", "line_id").withColumns({"fit": F.when(m == 0, True).when(m == 2, False), "verdict_pos": F.when(m == 0, F.col("shot_id") % 17)})
    return windows.order_by_fit(c).select("line_id", "shot_id", "place")


@query("ordered_distinct_queries", """
WITH q AS (SELECT user_id AS line_id, event_id AS pos, trim(CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type || ' ' END) AS q FROM events),
f AS (SELECT line_id, min(pos) AS pos, arg_min(q, pos) AS q FROM q GROUP BY line_id, lower(q))
SELECT line_id, q, row_number() OVER (PARTITION BY line_id ORDER BY pos) AS place FROM f QUALIFY place <= 4""")
def ordered_distinct_queries(spark, d):
    e = b.table(spark, d, "events").select(F.col("user_id").alias("line_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat("event_type", F.lit(" "))).alias("q"))
    return windows.ordered_distinct(e, 4).select("line_id", "q", "place")


RANKED = """rk AS (SELECT user_id AS slot_id, ascii(event_type) AS list_no, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) - 1 AS rank, 'f' || event_id % 40 AS source_key, event_id AS shot_id FROM events)"""


@query("rank_fusion", b.with_sql(RANKED) + """SELECT slot_id, source_key, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fused, arg_min(shot_id, list_no * 1000000 + rank) AS shot_id FROM rk GROUP BY 1, 2""")
def rank_fusion(spark, d):
    from pyspark.sql import Window as W
    w = W.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    r = b.table(spark, d, "events").select(F.col("user_id").alias("slot_id"), F.ascii("event_type").alias("list_no"), (F.row_number().over(w) - 1).alias("rank"),
                                           F.concat(F.lit("f"), (F.col("event_id") % 40).cast("string")).alias("source_key"), F.col("event_id").alias("shot_id"))
    return windows.rrf(r).withColumn("fused", F.round("fused", 6))


@query("phrasing_fallback", """
WITH r AS (SELECT user_id * 200 + event_id % 200 AS slot_id, event_id AS phrasing, CASE WHEN value > 80 THEN event_id END AS shot_id, CASE WHEN value BETWEEN 20 AND 80 THEN event_id END AS suggested, CASE WHEN value BETWEEN 20 AND 80 THEN value END AS sc FROM events),
g AS (SELECT slot_id, min(phrasing) FILTER (shot_id IS NOT NULL) AS used, first(suggested ORDER BY sc DESC, phrasing) FILTER (sc IS NOT NULL) AS best FROM r GROUP BY 1)
SELECT slot_id, used AS shot_id, used AS used_phrasing, CASE WHEN used IS NULL THEN best END AS suggested FROM g""")
def phrasing_fallback(spark, d):
    v = F.col("value")
    mid = v.between(20, 80)
    r = b.table(spark, d, "events").select((F.col("user_id") * 200 + F.col("event_id") % 200).alias("slot_id"), F.col("event_id").alias("phrasing"), F.when(v > 80, F.col("event_id")).alias("shot_id"),
                                           F.when(mid, F.col("event_id")).alias("suggested"), F.when(mid, v).alias("suggested_score"))
    return windows.phrasing_fallback(r).select("slot_id", "shot_id", "used_phrasing", "suggested")


def review_rows(spark, d):
    e = b.table(spark, d, "events")
    return e.select(F.col("user_id").alias("slot_id"), (F.col("event_id") % 60).alias("shot_id"), b_rank().alias("src_rank"), F.col("event_id").alias("pos"), (F.col("event_id") % 13 == 0).alias("wrong"))


def b_rank():
    return F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)


POOL = """
rows_ AS (SELECT user_id AS slot_id, event_id % 60 AS shot_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS src_rank, event_id AS pos, event_id % 13 = 0 AS wrong FROM events),
pool AS (SELECT slot_id, shot_id, min(src_rank * 1000000000 + pos) AS o FROM rows_ WHERE NOT wrong GROUP BY 1, 2),
shown AS (SELECT slot_id, shot_id, o // 1000000000 AS src_rank, row_number() OVER (PARTITION BY slot_id ORDER BY o, shot_id) AS place FROM pool QUALIFY place <= 8)"""


@query("review_pool", b.with_sql(POOL) + "SELECT slot_id, shot_id, src_rank, place FROM shown")
def review_pool(spark, d):
    return filters.review_pool(review_rows(spark, d), 8)


CONFIRMED = """
plan AS (SELECT slot_id, shot_id, min(src_rank) = 0 AS chosen, min(pos) AS pos FROM rows_ GROUP BY 1, 2),
want AS (SELECT slot_id, greatest(count(*) FILTER (chosen), 1) AS want FROM plan GROUP BY 1),
v AS (SELECT slot_id, shot_id, (shot_id * 7 + slot_id) % 31 AS vp FROM plan WHERE (shot_id + slot_id) % 4 = 0),
j AS (SELECT p.slot_id, p.shot_id, chosen, row_number() OVER (PARTITION BY p.slot_id ORDER BY chosen DESC, CASE WHEN chosen THEN pos ELSE vp END, p.shot_id) AS place, want FROM plan p JOIN v USING (slot_id, shot_id) JOIN want USING (slot_id))"""


def review_plan(spark, d):
    return review_rows(spark, d).groupBy("slot_id", "shot_id").agg((F.min("src_rank") == 0).alias("chosen"), F.min("pos").alias("pos"))


def review_verdicts(p):
    return p.where((F.col("shot_id") + F.col("slot_id")) % 4 == 0).select("slot_id", "shot_id", ((F.col("shot_id") * 7 + F.col("slot_id")) % 31).alias("verdict_pos"))


@query("confirmed_clips", b.with_sql(POOL, CONFIRMED) + "SELECT slot_id, shot_id, place, place <= want AS kept FROM j")
def confirmed_clips(spark, d):
    p = review_plan(spark, d)
    return filters.keep_confirmed(p, review_verdicts(p)).select("slot_id", "shot_id", "place", "kept")


@query("merged_verdicts", b.with_sql(POOL, CONFIRMED) + """,
m AS (SELECT p.slot_id, p.shot_id, vp, pos, row_number() OVER (PARTITION BY p.slot_id ORDER BY pos, p.shot_id) = 1 AS cur FROM plan p LEFT JOIN v USING (slot_id, shot_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY CASE WHEN vp IS NOT NULL THEN 0 WHEN pos % 2 = 0 THEN 1 ELSE 2 END, vp, pos, shot_id) AS place, bool_or(vp IS NOT NULL) OVER (PARTITION BY slot_id) AS g FROM m),
r AS (SELECT slot_id, shot_id, place, CASE WHEN g AND place = 1 THEN 'shot' WHEN NOT g AND cur THEN 'suggested' ELSE 'alt' END AS role FROM o)
SELECT * FROM r WHERE role <> 'alt' OR place <= 13""")
def merged_verdicts(spark, d):
    from pyspark.sql import Window as W
    p = review_plan(spark, d)
    w = W.partitionBy("slot_id").orderBy("pos", "shot_id")
    pool = p.withColumns({"current": F.row_number().over(w) == 1, "shown": F.col("pos") % 2 == 0})
    v = review_verdicts(p).withColumnRenamed("verdict_pos", "good_pos")
    return filters.merge_verdict(pool, v)


def strict_sql(rows: str, verdicts: str, shown: int, to: str) -> str:
    """CTEs of one round of the strict filter: what of rows is confirmed and kept, as `to`."""
    return f"""
{to}_pool AS (SELECT slot_id, shot_id, min(src_rank * 1000000000 + pos) AS o FROM {rows} WHERE NOT wrong GROUP BY 1, 2),
{to}_shown AS (SELECT slot_id, shot_id FROM {to}_pool QUALIFY row_number() OVER (PARTITION BY slot_id ORDER BY o, shot_id) <= {shown}),
{to}_c AS (SELECT p.* FROM (SELECT slot_id, shot_id, bool_or(src_rank = 0) AS chosen, min(pos) AS pos FROM {rows} GROUP BY 1, 2) p JOIN {to}_shown USING (slot_id, shot_id)),
{to}_w AS (SELECT slot_id, greatest(count(*) FILTER (chosen), 1) AS want FROM {to}_c GROUP BY 1),
{to} AS (SELECT slot_id, shot_id, row_number() OVER (PARTITION BY slot_id ORDER BY chosen DESC, CASE WHEN chosen THEN pos ELSE vp END, shot_id) AS place
  FROM {to}_c JOIN {verdicts} USING (slot_id, shot_id) JOIN {to}_w USING (slot_id) QUALIFY place <= any_value(want) OVER (PARTITION BY slot_id))"""


STRICT = (POOL, CONFIRMED, strict_sql("rows_", "v", 8, "one"), """
rows2 AS (SELECT user_id AS slot_id, 60 + event_id * 3 % 50 AS shot_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS src_rank, event_id AS pos, event_id % 11 = 0 AS wrong FROM events
  WHERE user_id NOT IN (SELECT slot_id FROM one)),
v2 AS (SELECT DISTINCT slot_id, shot_id, (shot_id * 5 + slot_id) % 29 AS vp FROM rows2 WHERE (shot_id + slot_id) % 9 = 0)""", strict_sql("rows2", "v2", 12, "two"), """
rounds AS (SELECT *, 1 AS round FROM one UNION ALL SELECT *, 2 FROM two)""")


def strict_rounds(spark, d):
    """Two rounds: the plan's own rows, then for slots that came out empty a second pool with other shots."""
    p = review_rows(spark, d).withColumn("chosen", F.col("src_rank") == 0)
    k = F.col("event_id")
    second = b.table(spark, d, "events").select(F.col("user_id").alias("slot_id"), (60 + k * 3 % 50).alias("shot_id"), b_rank().alias("src_rank"), k.alias("pos"), (k % 11 == 0).alias("wrong"), (b_rank() == 0).alias("chosen"))
    judged = second.where((F.col("shot_id") + F.col("slot_id")) % 9 == 0).select("slot_id", "shot_id", ((F.col("shot_id") * 5 + F.col("slot_id")) % 29).alias("verdict_pos")).distinct()
    return plans.strict_filter(p, review_verdicts(review_plan(spark, d)), second, judged)


@query("strict_plan_filter", b.with_sql(*STRICT) + "SELECT slot_id, shot_id, place, round FROM rounds")
def strict_plan_filter(spark, d):
    return strict_rounds(spark, d)[0]


@query("strict_plan_summary", b.with_sql(*STRICT) + """
SELECT count(*) AS slots, count(*) FILTER (round = 2) AS rescued, count(*) FILTER (round IS NULL) AS unmatched
FROM (SELECT DISTINCT user_id AS slot_id FROM events) LEFT JOIN (SELECT slot_id, max(round) AS round FROM rounds GROUP BY 1) USING (slot_id)""")
def strict_plan_summary(spark, d):
    return strict_rounds(spark, d)[1]


@query("fit_deficits", "SELECT user_id AS line_id, count(*) FILTER (value > 97) AS n_fit FROM events GROUP BY 1 HAVING n_fit < 6")
def fit_deficits(spark, d):
    return filters.fit_deficit(b.table(spark, d, "events").select(F.col("user_id").alias("line_id"), (F.col("value") > 97).alias("fit")))


@query("rescued_slots", """
WITH s AS (SELECT user_id AS video_id, event_id AS slot_id, value AS importance, CASE WHEN value > 200 THEN event_id END AS shot_id FROM events),
e AS (SELECT video_id, arg_max(slot_id, (importance * 100)::BIGINT * 10000000 - slot_id) AS slot_id FROM s GROUP BY 1 HAVING count(shot_id) = 0)
SELECT video_id, slot_id, CASE WHEN slot_id % 2 = 0 THEN slot_id + 3 WHEN slot_id % 3 = 0 THEN slot_id + 2 ELSE slot_id + 1 END AS shot_id, slot_id % 2 <> 0 AS low_confidence FROM e""")
def rescued_slots(spark, d):
    e = b.table(spark, d, "events")
    s = e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("slot_id"), F.col("value").alias("importance"), F.when(F.col("value") > 200, F.col("event_id")).alias("shot_id"))
    k = F.col("event_id")
    c = e.select(k.alias("slot_id"), F.explode(F.array(*[F.struct((k + i).alias("shot_id"), F.lit(i).alias("place"), F.when((k % 2 == 0) & F.lit(i == 3), 0).alias("verdict_pos"), ((k % 3 == 0) & F.lit(i == 1)).alias("wrong")) for i in (1, 2, 3)])).alias("x")).select("slot_id", "x.*")
    return search_plan.rescue(s, c)


@query("suggestions")
def suggestions(spark, d):
    """Suggestions for the strongest line of every video: its grounded queries over all footage but that fetched live, places of the whole video, verdicts for two videos of three."""
    from ..functions import text, vector
    from ..operators import lines, places, truth
    from ..session import cut_lineage
    s = cut_lineage(b.shots(spark, d))
    a = truth.alias_table(b.gazetteer(spark, d))
    video = cut_lineage(places.with_places(b.scripts(spark, d).withColumnRenamed("script_id", "line_id"), {"video_places": F.col("text")}, a))
    named = F.transform("video_places", lambda p: p["name"])
    topic = video.select("line_id", lines.topic_words(named, F.col("text")).alias("topic"))
    line = b.line_scores(spark, d, strongest=True).select(F.col("video_id").alias("line_id"), "text", "query", "alt_queries")
    e = b.table(spark, d, "embeddings").select("vec_id", vector.as_double(F.col("embedding")).alias("qe"))
    n = e.count()

    def encode(queries):
        """The embedding whose id is (hash of the text) % count stands in for a text encoder; it does not find itself."""
        q = queries.select("q", F.pmod(F.xxhash64("q"), F.lit(n)).alias("vec_id"))
        return q.join(e, "vec_id").select("q", F.col("vec_id").alias("query_id"), "qe", F.col("vec_id").alias("skip_id"))

    def judge(cands):
        k = F.col("shot_id") + F.col("line_id")
        return cands.where("line_id % 3 <> 0").withColumn("verdict_pos", F.when(k % 4 == 0, (F.col("shot_id") * 7 + F.col("line_id")) % 31))

    clip = places.with_places(s.select("shot_id", "title", "tags"), {"clip_places": F.concat_ws(" ", "title", "tags")}, a).select("shot_id", "clip_places")
    live = spark.createDataFrame([(i, "live" if i == 3 else "stock") for i in range(4)], "id long, kind string")
    return search_plan.suggest(line.join(topic, "line_id"), encode, s, b.vocab(spark, d), video.select("line_id", "video_places"), clip, 24, judge, delta=0.15, sim=0.20, dist=0.85, live_libraries=live) \
        .select("line_id", "shot_id", F.round("score", 4).alias("score"), "fit", "wrong_place", "shown")
