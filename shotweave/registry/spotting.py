"""Transcript units, spots, captions and range joins over every conversation turn."""
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lines, places, ranges, spots, timeline, truth, windows
from ..plans import plan as plans
from . import bindings as b
from .base import query
from .claims import ALIASES, places_sql
from .language import sql_keyword_cte

TRANSCRIPT = [b.SEGMENTS, b.WORDS_CTE, b.DURATIONS]


def cut_times(spark, d):
    """Picture cuts at 37 % of every third segment."""
    s = b.segments(spark, d).where("seg_id % 3 = 0")
    return s.select("video_id", (F.round((F.col("start") + 0.37 * (F.col("end") - F.col("start"))) * 100) / 100.0).alias("t"))


UNITS = """
cuts AS (SELECT video_id, round((start + 0.37::DOUBLE * ("end" - start)) * 100) / 100.0::DOUBLE AS t FROM segments WHERE seg_id % 3 = 0),
ins AS (SELECT video_id, seg_id, list(DISTINCT t ORDER BY t) AS l FROM segments JOIN cuts USING (video_id) WHERE t > start + 0.4 AND t < "end" - 0.4 GROUP BY 1, 2),
edges AS (SELECT video_id, seg_id, text, l IS NOT NULL AS cut, list_concat([start], coalesce(l, []), ["end"]) AS e FROM segments LEFT JOIN ins USING (video_id, seg_id)),
parts AS (SELECT video_id, seg_id, text, cut, e[k] AS a, e[k + 1] AS z, k FROM (SELECT *, unnest(range(1, len(e))) AS k FROM edges)),
said AS (SELECT video_id, seg_id, k, string_agg(w, ' ' ORDER BY s) AS said FROM (SELECT p.video_id, p.seg_id, p.k, w.w, w.s FROM parts p JOIN words w ON w.video_id = p.video_id AND w.seg_id = p.seg_id
   WHERE cut AND (w.s + w.e) / 2 >= a - 0.01::DOUBLE AND (w.s + w.e) / 2 < z + 0.01::DOUBLE) GROUP BY 1, 2, 3),
speech AS (SELECT video_id, 'speech' AS kind, round_even(a, 2)::DOUBLE AS start, round_even(z, 2)::DOUBLE AS "end", coalesce(nullif(trim(said), ''), text) AS text FROM parts LEFT JOIN said USING (video_id, seg_id, k)),
gaps AS (SELECT video_id, "end" AS a, lead(start) OVER (PARTITION BY video_id ORDER BY start) AS z FROM segments
  UNION ALL SELECT video_id, 0, min(start) FROM segments GROUP BY 1 UNION ALL SELECT s.video_id, max("end"), any_value(duration) FROM segments s JOIN durations USING (video_id) GROUP BY 1),
u AS (SELECT *, 0 AS o FROM speech UNION ALL SELECT video_id, 'pause', round_even(a, 2)::DOUBLE, round_even(z, 2)::DOUBLE, '', 1 FROM gaps WHERE z - a >= 0.4),
units AS (SELECT video_id, kind, start, "end", text, row_number() OVER (PARTITION BY video_id ORDER BY start, o, "end") - 1 AS id FROM u)"""


def units(spark, d):
    return spots.build_units(b.segments(spark, d), b.words(spark, d), cut_times(spark, d), b.durations(spark, d))


@query("transcript_units", b.with_sql(*TRANSCRIPT, UNITS) + 'SELECT video_id, id, kind, start, "end", text FROM units')
def transcript_units(spark, d):
    return units(spark, d)


@query("transcript_pauses", b.with_sql(*TRANSCRIPT, UNITS) + 'SELECT video_id, round(a, 2) AS start, round(z, 2) AS "end" FROM gaps WHERE z - a >= 0.4')
def transcript_pauses(spark, d):
    p = windows.pauses(b.segments(spark, d), b.durations(spark, d))
    return p.select("video_id", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"))


def strip(spark, d):
    """Filmstrip: a frame every two seconds."""
    x = b.durations(spark, d).select("video_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration") / 2).cast("int"))).alias("k"))
    return x.select("video_id", (F.col("k") * 2.0).alias("ft"), F.format_string("f%04d.jpg", "k").alias("frame"))


@query("nearest_frames", b.with_sql(*TRANSCRIPT, UNITS) + """,
strip AS (SELECT video_id, k * 2.0::DOUBLE AS ft, printf('f%04d.jpg', k) AS frame FROM (SELECT video_id, unnest(range(floor(duration / 2)::INT + 1)) AS k FROM durations)),
j AS (SELECT u.video_id, id, frame, abs(ft - (start + "end") / 2) AS gap, ft FROM units u JOIN strip s ON s.video_id = u.video_id AND abs(ft - (start + "end") / 2) <= 3)
SELECT video_id, id, frame FROM j QUALIFY row_number() OVER (PARTITION BY video_id, id ORDER BY gap, ft) = 1""")
def nearest_frames(spark, d):
    """A unit's place in time decides; no text is spoken or carried along."""
    u = spots.build_units(b.segments(spark, d), None, cut_times(spark, d), b.durations(spark, d)).select("video_id", "id", "start", "end")
    return spots.nearest_frame(u, strip(spark, d)).select("video_id", "id", "frame")


def drops(spark, d):
    """One dropped clip per segment, a quarter second after its first third."""
    return b.segments(spark, d).select("video_id", b.packed("video_id", "seg_id").alias("drop_id"), (F.round((F.col("start") + (F.col("end") - F.col("start")) / 3 + 0.27) * 100) / 100.0).alias("t"))


DROPS = """drops AS (SELECT video_id, video_id * 1048576 + seg_id AS drop_id, round((start + ("end" - start) / 3 + 0.27::DOUBLE) * 100) / 100.0::DOUBLE AS t FROM segments)"""


@query("snap_to_word", b.with_sql(*TRANSCRIPT, DROPS) + """,
j AS (SELECT drop_id, s, abs(s - t) AS gap FROM drops d JOIN words w ON w.video_id = d.video_id AND abs(s - t) <= 0.1500001),
n AS (SELECT drop_id, s FROM j QUALIFY row_number() OVER (PARTITION BY drop_id ORDER BY round(gap, 6), s) = 1)
SELECT drop_id, round(coalesce(s, t), 3) AS t, s IS NOT NULL AS snapped FROM drops LEFT JOIN n USING (drop_id)""")
def snap_to_word(spark, d):
    return windows.snap_to_word(drops(spark, d), b.words(spark, d).select("video_id", "s"), 0.1500001).select("drop_id", F.round("t", 3).alias("t"), "snapped")


@query("free_slots", b.with_sql(*TRANSCRIPT, DROPS) + """,
sl AS (SELECT video_id, start AS s0, "end" AS s1 FROM segments WHERE seg_id % 2 = 1 AND "end" > start),
dd AS (SELECT d.video_id, drop_id, greatest(0, least(t, greatest(duration - 0.8, 0))) AS t, duration FROM drops d JOIN durations USING (video_id)),
f AS (SELECT * FROM dd WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.video_id = dd.video_id AND s0 <= t AND t < s1)),
e AS (SELECT *, least(t + 3, duration, coalesce((SELECT min(s0) FROM sl WHERE sl.video_id = f.video_id AND s0 > f.t) - 0.1::DOUBLE, duration)) AS z FROM f)
SELECT video_id, drop_id, round_even(t, 2)::DOUBLE AS start, round_even(z, 2)::DOUBLE AS "end" FROM e WHERE z - t >= 0.8""")
def free_slots(spark, d):
    slots = b.segments(spark, d).where("seg_id % 2 = 1").select("video_id", "start", "end")
    return windows.free_slot(drops(spark, d), slots, b.durations(spark, d))


def lines_with_bounds(spark, d):
    return b.segments(spark, d).select("video_id", F.col("seg_id").alias("id"), F.get(F.filter(F.split("text", r"\s+"), lambda x: x != ""), F.lit(1)).alias("anchor"), (F.col("start") - 0.2).alias("lo"), (F.col("end") - 0.3).alias("hi"))


NORM_WORD = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\p{{M}}'']', '', 'g')"


SECOND_WORD = NORM_WORD.format(r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[2]")


@query("anchor_words", b.with_sql(*TRANSCRIPT) + rf""",
l AS (SELECT video_id, seg_id AS id, {SECOND_WORD} AS n, start - 0.2::DOUBLE AS lo, "end" - 0.3::DOUBLE AS hi FROM segments)
SELECT l.video_id, l.id, min(w.s) AS ws, arg_min(w.w, w.s) AS word FROM l JOIN words w ON w.video_id = l.video_id AND {NORM_WORD.format('w.w')} = n AND n <> '' AND w.s BETWEEN lo AND hi GROUP BY 1, 2""")
def anchor_words(spark, d):
    return spots.anchor_word(lines_with_bounds(spark, d), b.words(spark, d))


@query("face_share_in_ranges", b.with_sql(*TRANSCRIPT) + """,
f AS (SELECT video_id, s AS t, (k % 4) / 4.0::DOUBLE AS v FROM words)
SELECT g.video_id, g.seg_id, round(coalesce(avg(v), 0), 4) AS mean FROM segments g LEFT JOIN f ON f.video_id = g.video_id AND f.t BETWEEN g.start + 0.31::DOUBLE AND g."end" - 0.31::DOUBLE GROUP BY 1, 2""")
def face_share_in_ranges(spark, d):
    f = b.words(spark, d).select("video_id", F.col("s").alias("t"), ((F.col("k") % 4) / 4.0).alias("v"))
    r = b.segments(spark, d).select("video_id", "seg_id", (F.col("start") + 0.31).alias("lo"), (F.col("end") - 0.31).alias("hi"))
    return ranges.mean_in_range(r, f, "video_id").select("video_id", "seg_id", F.round("mean", 4).alias("mean"))


@query("conflict_free_spots", b.with_sql(*TRANSCRIPT) + """SELECT video_id, seg_id FROM segments s WHERE NOT EXISTS (SELECT 1 FROM segments c WHERE c.video_id = s.video_id AND c.seg_id % 4 = 0
  AND s."end" + 0.55 > c.start AND s.start < c."end" + 0.55)""")
def conflict_free_spots(spark, d):
    s = b.segments(spark, d).select("video_id", "seg_id", "start", "end")
    return ranges.conflict_free(s, s.where("seg_id % 4 = 0"), "video_id", 0.55).select("video_id", "seg_id")


@query("repaired_overlaps", b.with_sql(*TRANSCRIPT) + """,
s AS (SELECT video_id, seg_id, start, "end" + (seg_id % 3)::DOUBLE AS z FROM segments WHERE "end" + (seg_id % 3) - start >= 0.5),
n AS (SELECT *, lead(start) OVER (PARTITION BY video_id ORDER BY start, seg_id) AS nx FROM s),
c AS (SELECT video_id, seg_id, start, CASE WHEN nx < z + 0.05::DOUBLE THEN round_even(nx - 0.05::DOUBLE, 2)::DOUBLE ELSE z END AS z FROM n)
SELECT video_id, seg_id AS slot_id, start, round(z, 3) AS "end" FROM c WHERE z - start >= 0.5""")
def repaired_overlaps(spark, d):
    s = b.segments(spark, d).select("video_id", F.col("seg_id").alias("slot_id"), "start", (F.col("end") + F.col("seg_id") % 3).alias("end"))
    return windows.repair_overlaps(s).select("video_id", "slot_id", "start", F.round("end", 3).alias("end"))


@query("script_alignment", b.with_sql(*TRANSCRIPT) + r""",
s AS (SELECT *, greatest(n, 1) AS m FROM segments), r AS (SELECT *, sum(m) OVER (PARTITION BY video_id ORDER BY start, seg_id) AS upto, sum(m) OVER (PARTITION BY video_id) AS tw FROM s),
t AS (SELECT video_id, seg_id, r.text, upto, m, tw, list_filter(regexp_split_to_array(lower(o.text), '\s+'), lambda x: x <> '')[4:] AS sw FROM r JOIN scripts o ON o.script_id = video_id),
i AS (SELECT *, round_even((upto - m) / tw::DOUBLE * len(sw), 0)::INT AS a, round_even(upto / tw::DOUBLE * len(sw), 0)::INT AS z FROM t)
SELECT video_id, seg_id, CASE WHEN len(sw) > 0 THEN coalesce(nullif(array_to_string(sw[a + 1:greatest(z, a + 1)], ' '), ''), text) ELSE text END AS said FROM i""")
def script_alignment(spark, d):
    w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    sc = b.scripts(spark, d).select(F.col("script_id").alias("video_id"), F.array_join(F.slice(w, F.lit(4), F.greatest(F.size(w) - 3, F.lit(0))), " ").alias("script"))
    return spots.align_script(b.segments(spark, d).select("video_id", "seg_id", "start", "text"), sc).select("video_id", "seg_id", F.col("text").alias("said"))


# ------------------------------------------------------------------------------------------ spots
def scored_lines(spark, d):
    s = b.line_scores(spark, d)
    return s.select("video_id", "id", "importance", "visual", "role", "query", "alt_queries", "anchor", "reason")


def segment_units(spark, d):
    return b.segments(spark, d).select("video_id", F.col("seg_id").alias("id"), F.lit("speech").alias("kind"), "start", "end", "text")


@query("selected_spots")
def selected_spots(spark, d):
    """Greedy interval choice per video; compared with a plain restatement in the tests."""
    return spots.select_spots(scored_lines(spark, d), segment_units(spark, d), b.words(spark, d), b.durations(spark, d), "balanced").drop("alt_queries")


@query("replanned_spots")
def replanned_spots(spark, d):
    held = b.segments(spark, d).where("seg_id % 7 = 2").select("video_id", "start", F.least(F.col("end"), F.col("start") + 3.0).alias("end"), F.lit(True).alias("locked"), F.col("seg_id").alias("shot_id"))
    return spots.replan(scored_lines(spark, d), segment_units(spark, d), b.words(spark, d), b.durations(spark, d), held, "rich").drop("alt_queries")


@query("rule_based_spots")
def rule_based_spots(spark, d):
    f = b.words(spark, d).select("video_id", F.col("s").alias("t"), ((F.col("k") % 4) / 4.0).alias("v"))
    return spots.rule_slots(b.segments(spark, d).select("video_id", "seg_id", "start", "end", "text"), f, b.durations(spark, d))


@query("topic_spots", b.with_sql(*TRANSCRIPT) + """,
h AS (SELECT s.*, duration, greatest(start, least(3.0, greatest(0.5, round_even(duration * 0.1::DOUBLE, 2)::DOUBLE))) + 0.1::DOUBLE AS a, CASE WHEN duration < 20 THEN 0.8 ELSE 1.2 END AS mn FROM segments s JOIN durations USING (video_id)),
c AS (SELECT *, least("end" - 0.05::DOUBLE, a + 5, duration) AS z FROM h)
SELECT video_id, seg_id AS id, round_even(a, 2)::DOUBLE AS start, round_even(z, 2)::DOUBLE AS "end" FROM c WHERE z - a >= mn - 1e-9 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(z - a, 6) DESC, seg_id) = 1""")
def topic_spots(spark, d):
    return spots.topic_spot(segment_units(spark, d), b.durations(spark, d)).select("video_id", "id", "start", "end")


@query("caption_chunks")
def caption_chunks(spark, d):
    w = b.words(spark, d).groupBy("video_id", "seg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w", "s", "e"))), lambda x: F.struct(x["w"], x["s"], x["e"])).alias("words"))
    return spots.caption_chunks(b.segments(spark, d).join(w, ["video_id", "seg_id"], "left"))


@query("condensed_scripts", b.with_sql(b.BEATS) + """,
t AS (SELECT script_id, sum(dur)::DOUBLE AS total, count(*) AS n FROM beats GROUP BY 1),
k AS (SELECT *, CASE WHEN total > 19.7137::DOUBLE * 1.05::DOUBLE AND greatest(2, least(n, 7)) < n THEN greatest(2, least(n, 7)) ELSE n END::INT AS k FROM t),
idx AS (SELECT DISTINCT script_id, CASE WHEN k > 1 THEN round_even(j * (n - 1) / (k - 1)::DOUBLE, 0)::BIGINT ELSE 0 END AS i FROM (SELECT *, unnest(range(k)) AS j FROM k)),
s AS (SELECT b.script_id, b.i, b.text, b.dur::DOUBLE AS dur, least(19.7137::DOUBLE / sum(b.dur::DOUBLE) OVER (PARTITION BY b.script_id), 1.6) AS sc FROM beats b JOIN idx USING (script_id, i))
SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY i) - 1 AS i, text, round_even(greatest(1.5, dur * sc), 2)::DOUBLE AS dur FROM s""")
def condensed_scripts(spark, d):
    f = windows.fit_to_target(b.beats(spark, d), 19.7137)
    return f.select("script_id", F.col("i").cast("long").alias("i"), "text", "dur")


@query("in_point_windows", b.with_sql(*TRANSCRIPT) + """,
r AS (SELECT video_id * 1048576 + seg_id AS slot_id, 4.0 + seg_id % 9 - least("end" - start, 5.0) AS room FROM segments),
n AS (SELECT *, greatest(2, least(5, floor(room / 0.8::DOUBLE)::INT + 1)) AS n FROM r WHERE room >= 0.8)
SELECT slot_id, w::INT AS "window", round(w * room / (n - 1), 3) AS t_in FROM (SELECT *, unnest(range(n)) AS w FROM n)""")
def in_point_windows(spark, d):
    s = b.segments(spark, d).select(b.packed("video_id", "seg_id").alias("slot_id"), F.lit(0.0).alias("start"), F.least(F.col("end") - F.col("start"), F.lit(5.0)).alias("end"), (4.0 + F.col("seg_id") % 9).alias("file_duration"))
    return spots.inpoint_windows(s).withColumn("t_in", F.round("t_in", 3))


@query("chosen_in_points", b.with_sql(*TRANSCRIPT) + """,
r AS (SELECT video_id * 1048576 + seg_id AS slot_id, seg_id, 4.0 + seg_id % 9 - least("end" - start, 5.0) AS room FROM segments),
n AS (SELECT *, greatest(2, least(5, floor(room / 0.8::DOUBLE)::INT + 1)) AS n FROM r)
SELECT slot_id, round_even((CASE WHEN room >= 0.8 AND seg_id % 4 < n THEN (seg_id % 4) * room / (n - 1) ELSE 1.5 END)::DOUBLE, 2)::DOUBLE AS trim_in, room >= 0.8 AND seg_id % 4 < n AS fits FROM n""")
def chosen_in_points(spark, d):
    s = b.segments(spark, d).select(b.packed("video_id", "seg_id").alias("slot_id"), "seg_id", F.lit(0.0).alias("start"), F.least(F.col("end") - F.col("start"), F.lit(5.0)).alias("end"), (4.0 + F.col("seg_id") % 9).alias("file_duration"))
    v = s.select("slot_id", F.element_at(F.lit(["a", "B", "c", "D"]), (F.col("seg_id") % 4 + 1).cast("int")).alias("letter"))
    return spots.choose_inpoint(spots.inpoint_windows(s), v, s.select("slot_id", F.lit(1.5).alias("trim_in")))


@query("project_queries", b.with_sql(*TRANSCRIPT) + """,
m AS (SELECT video_id, 0 AS kind, start, 0 AS k, 'main ' || seg_id AS q FROM segments WHERE seg_id % 3 <> 1 UNION ALL SELECT video_id, 1, start, 0, 'alt ' || seg_id FROM segments UNION ALL SELECT video_id, 1, start, 1, 'more ' || seg_id FROM segments)
SELECT video_id, q, kind = 0 AS is_main, row_number() OVER (PARTITION BY video_id ORDER BY kind, start, k, q) AS place FROM m""")
def project_queries(spark, d):
    n = F.col("seg_id").cast("string")
    s = b.segments(spark, d).select("video_id", "start", F.when(F.col("seg_id") % 3 != 1, F.concat(F.lit("main "), n)).otherwise("").alias("query"),
                                    F.array(F.concat(F.lit("alt "), n), F.concat(F.lit("more "), n), F.lit("third")).alias("alt_queries"))
    return lines.project_queries(s).select("video_id", "q", "is_main", "place")


@query("editor_timeline", b.with_sql(*TRANSCRIPT) + """,
s AS (SELECT video_id, seg_id, start, least("end", start + 5.0) AS z, row_number() OVER (PARTITION BY video_id ORDER BY start, seg_id) AS spot FROM segments WHERE seg_id % 5 <> 4),
c AS (SELECT *, 3.0 + seg_id % 7 AS fd, (seg_id % 4)::DOUBLE AS t0, z - start AS dur FROM s WHERE seg_id % 6 <> 5),
i AS (SELECT *, CASE WHEN t0 + dur > fd THEN greatest(0, fd - dur) ELSE t0 END AS src_in FROM c)
SELECT video_id, spot, round(start, 3) AS start, round(least(z, start + (fd - src_in)), 3) AS "end", round(src_in, 3) AS src_in FROM i""")
def editor_timeline(spark, d):
    k = F.col("seg_id")
    s = b.segments(spark, d).select("video_id", k.alias("slot_id"), "start", F.least(F.col("end"), F.col("start") + 5.0).alias("end"), F.when(k % 5 != 4, k).alias("shot_id"),
                                    F.when(k % 6 == 5, F.lit(-1)).otherwise(k % 7).cast("long").alias("file_id"), (k % 4).cast("double").alias("t_start"), F.lit(9.0).alias("t_end"), F.lit(None).cast("double").alias("trim_in"))
    files = b.segments(spark, d).select((k % 7).alias("id")).distinct().select("id", F.lit("/f").alias("path"), (3.0 + F.col("id")).alias("duration"))
    clips, _ = timeline.editor_timeline(s, files)
    return clips.select("video_id", "spot", *[F.round(c, 3).alias(c) for c in ("start", "end", "src_in")])


@query("credit_sheet", b.with_sql(b.SHOTS, *TRANSCRIPT) + """,
c AS (SELECT video_id, source_key, start, least("end", start + 5.0) AS z, s.title, s.licence_class FROM segments g JOIN shots s ON s.shot_id = g.seg_id)
SELECT video_id, source_key, string_agg(printf('%.1f-%.1fs', start, z), ', ' ORDER BY start, z) AS used_at, arg_min(licence_class, start) IN ('own', 'safe', 'attribution') AS commercial FROM c GROUP BY 1, 2""")
def credit_sheet(spark, d):
    g = b.segments(spark, d).select("video_id", F.col("seg_id").alias("shot_id"), "start", F.least(F.col("end"), F.col("start") + 5.0).alias("end"))
    s = b.shots(spark, d).select("shot_id", "source_key", "title", "source", "licence_class", F.lit("maker").alias("author"), F.lit("CC BY").alias("licence"), F.lit("").alias("licence_url"), F.lit("").alias("page_url"))
    return timeline.credit_sheet(g.join(s, "shot_id")).select("video_id", "source_key", "used_at", "commercial")


@query("offline_line_importance", b.with_sql(*TRANSCRIPT, ALIASES, "keyed AS (SELECT video_id * 1048576 + seg_id AS k, text FROM segments)", places_sql("pl", "keyed", "k", "text"), sql_keyword_cte("kw", "keyed", "k", "text", 12)) + r""",
p AS (SELECT k, count(*) AS np FROM pl GROUP BY 1),
x AS (SELECT s.video_id, s.seg_id AS id, s.text, coalesce(np, 0) > 0 AS placed, regexp_matches(lower(s.text), '[0-9]|(?:^|[^\p{L}\p{N}_])(?:one|two|three|four|five|ten|hundred|thousand|million|billion|percent)(?:$|[^\p{L}\p{N}_])') AS num,
   regexp_matches(lower(s.text), '(?:^|[^\p{L}\p{N}_])(?:hi|hello|hey|welcome|subscribe|comment|comments|like this video|thanks for watching|see you|let me know|i think|i guess|you know|so yeah|anyway)(?:$|[^\p{L}\p{N}_])') AS spk,
   CASE WHEN kw.kw IS NULL THEN 0 ELSE len(string_split(kw.kw, ' ')) END AS content,
   max(s.seg_id) OVER (PARTITION BY s.video_id) AS last_id, min(s.seg_id) OVER (PARTITION BY s.video_id) AS first_id
   FROM segments s LEFT JOIN p ON p.k = s.video_id * 1048576 + s.seg_id LEFT JOIN kw ON kw.k = s.video_id * 1048576 + s.seg_id)
SELECT video_id, id, CASE WHEN spk THEN CASE WHEN id >= last_id - 1 THEN 'cta' WHEN id = first_id THEN 'hook' ELSE 'aside' END WHEN placed THEN 'place' WHEN num THEN 'data' ELSE 'key point' END AS role, content FROM x""")
def offline_line_importance(spark, d):
    a = truth.alias_table(b.gazetteer(spark, d))
    u = places.with_places(b.segments(spark, d).select("video_id", F.col("seg_id").alias("id"), "text"), {"places": F.col("text")}, a)
    kw = text.keywords(F.col("text"), 12)
    return lines.offline_importance(u).select("video_id", "id", "role", F.when(kw == "", 0).otherwise(F.size(F.split(kw, " "))).alias("content"))


@query("parsed_line_answers", b.with_sql(*TRANSCRIPT) + """
SELECT video_id, seg_id AS id, least(greatest(seg_id / 4.0, 0), 1)::DECIMAL(6, 2)::DOUBLE AS importance, CASE WHEN seg_id % 2 = 0 THEN 0.9 ELSE 0.1 END::DOUBLE AS visual, CASE WHEN seg_id % 3 = 0 THEN 'data' ELSE 'key point' END AS role,
  CASE WHEN seg_id % 2 = 0 THEN 'web development ' || seg_id ELSE '' END AS query FROM segments""")
def parsed_line_answers(spark, d):
    """Model answers per video: scores over one, an unknown role, a bad id, a repeated id."""
    k = F.col("seg_id")
    s = b.segments(spark, d)
    line = F.struct(k.cast("string").alias("id"), (k / 4.0).cast("string").alias("importance"), F.when(k % 2 == 0, "0.9").otherwise("0.1").alias("visual"), F.when(k % 3 == 0, "Data ").otherwise("boss").alias("role"),
                    F.concat(F.lit("web development screen "), k.cast("string")).alias("query"))
    a = s.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("l")))).alias("l"))
    bad = F.struct(F.lit("x").alias("id"), F.lit("high").alias("importance"), F.lit("1").alias("visual"), F.lit("data").alias("role"), F.lit("q").alias("query"))
    again = F.struct(F.lit("0").alias("id"), F.lit("0.5").alias("importance"), F.lit("1").alias("visual"), F.lit("cta").alias("role"), F.lit("q").alias("query"))
    body = F.to_json(F.struct(F.concat(F.transform("l", lambda x: x["l"]), F.array(bad, again)).alias("lines")))
    return lines.parse_lines(a.select("video_id", body.alias("body")), segment_units(spark, d)).select("video_id", "id", "importance", "visual", "role", "query")


@query("grounded_queries", b.with_sql(*TRANSCRIPT, sql_keyword_cte("kt", "(SELECT video_id * 1048576 + seg_id AS line_id, text FROM segments)", "line_id", "text", 4)) + """,
l AS (SELECT video_id * 1048576 + seg_id AS line_id, text, 'Big Market' AS query, 'big market' AS alt, 'travel jaipur' AS topic FROM segments),
b AS (SELECT line_id, 0 AS p, query AS q, 'market' AS k4, topic FROM l UNION ALL SELECT line_id, 1, alt, 'market', topic FROM l UNION ALL SELECT l.line_id, 2, text, coalesce(kw, text), topic FROM l LEFT JOIN kt ON kt.line_id = l.line_id),
e AS (SELECT line_id, p * 2 AS pos, trim(q) AS q FROM b UNION ALL SELECT line_id, p * 2 + 1, trim(k4 || ' ' || topic) FROM b),
f AS (SELECT line_id, lower(q) AS lq, arg_min(q, pos) AS q, min(pos) AS pos FROM e WHERE q <> '' GROUP BY 1, 2)
SELECT line_id, substr(q, 1, 140) AS q, row_number() OVER (PARTITION BY line_id ORDER BY pos) AS place FROM f QUALIFY place <= 5""")
def grounded_queries(spark, d):
    l = b.segments(spark, d).select(b.packed("video_id", "seg_id").alias("line_id"), "text", F.lit("Big Market").alias("query"), F.array(F.lit("big market")).alias("alt_queries"), F.lit("travel jaipur").alias("topic"))
    return lines.grounded_queries(l).select("line_id", "q", "place")


@query("offline_query_phrases", b.with_sql(*TRANSCRIPT, ALIASES, "keyed AS (SELECT video_id * 1048576 + seg_id AS k, text FROM segments)", places_sql("pl", "keyed", "k", "text"), sql_keyword_cte("kw", "keyed", "k", "text", 4)) + """,
p AS (SELECT k, arg_min(name, at_pos::HUGEINT * 1000000 + ord) AS place FROM pl WHERE kind = 'city' GROUP BY 1),
x AS (SELECT s.video_id, seg_id AS id, seg_id % 4 > 0 AS ok, CASE WHEN place IS NOT NULL THEN place || ' people walking' END AS a, CASE WHEN len(string_split(kw.kw, ' ')) >= 2 THEN kw.kw END AS b, 'busy street' AS c
  FROM segments s LEFT JOIN p ON p.k = s.video_id * 1048576 + seg_id LEFT JOIN kw ON kw.k = s.video_id * 1048576 + seg_id)
SELECT video_id, id, CASE WHEN ok THEN 'people walking' ELSE '' END AS query, CASE WHEN ok THEN array_to_string(list_filter([a, b, c], lambda v: v IS NOT NULL)[:2], '|') ELSE '' END AS alts FROM x""")
def offline_query_phrases(spark, d):
    a = truth.alias_table(b.gazetteer(spark, d))
    l = b.segments(spark, d).select("video_id", F.col("seg_id").alias("id"), "text", F.when(F.col("seg_id") % 4 > 0, 0.9).otherwise(0.3).alias("visual"),
                                    F.lit("people walking").alias("concept1"), F.lit("busy street").alias("concept2"))
    l = places.with_places(l, {"places": F.col("text")}, a)
    return lines.offline_queries(l).select("video_id", "id", "query", F.array_join("alt_queries", "|").alias("alts"))


@query("offline_spot_plan")
def offline_spot_plan(spark, d):
    a = truth.alias_table(b.gazetteer(spark, d))
    u = places.with_places(b.segments(spark, d).select("video_id", F.col("seg_id").alias("id"), "text"), {"places": F.col("text")}, a)
    h = F.pmod(F.col("video_id") * 7 + F.col("id") * 29, F.lit(97)) / 96.0
    scored = lines.offline_importance(u).withColumns({"visual": h, "concept1": F.lit("people walking"), "concept2": F.lit("busy street")})
    placed, topic, _ = plans.offline_plan(segment_units(spark, d), b.words(spark, d), b.durations(spark, d), scored)
    return placed.select("video_id", "id", "start", "end", "query").unionByName(topic.select("video_id", "id", "start", "end", "query"))
