"""Scalar functions over whole text and fact tables."""
from pyspark.sql import functions as F

from ..functions import dates, fixed, media, text, vector
from ..operators import lines, retrieval, windows
from . import bindings as b
from .base import query

STOP = "[" + ", ".join(f"'{w}'" for w in fixed.STOP_WORDS) + "]"
BANNED = "[" + ", ".join(f"'{w}'" for w in fixed.BANNED_QUERY_WORDS) + "]"
TECH = "[" + ", ".join(f"'{w}'" for w in fixed.TECH_SHORT) + "]"
FILLER = "[" + ", ".join(f"'{w}'" for w in fixed.TOPIC_FILLER) + "]"
STEM = "regexp_replace({0}, '^(.{{3,}}?)(?:ing|ed|es|s)$', '\\1')"


def sql_distinct(expr: str) -> str:
    """First occurrences of a list, order kept."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def sql_tokens(c: str) -> str:
    words = f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z]{{3,}}'), lambda x: NOT list_contains({STOP}, x))"
    return f"[{STEM.format('y')} FOR y IN {words}]"


def sql_keyword_cte(name: str, source: str, key: str, column: str, n: int) -> str:
    """The n telling words of source.column per key, as one text."""
    return rf"""
{name}_w AS (SELECT {key}, u.w AS w, u.i AS i FROM (
    SELECT {key}, unnest(list_transform(regexp_extract_all(coalesce({column}, ''), '[A-Za-z][A-Za-z'']*'), lambda x, i: {{'w': x, 'i': i}})) AS u FROM {source})),
{name}_t AS (SELECT {key}, w, i, regexp_replace(regexp_replace(lower(w), '''+$', ''), '''(s|t|re|ve|ll|d|m)$', '') AS t FROM {name}_w),
{name}_s AS (SELECT {key}, t, i, list_contains({TECH}, t) OR (w = upper(w) AND length(w) BETWEEN 2 AND 5) AS short FROM {name}_t),
{name}_k AS (SELECT {key}, t, min(i) AS i, arg_min(short, i) AS short FROM {name}_s
    WHERE t <> '' AND NOT list_contains({STOP}, t) AND (length(t) >= 4 OR short) GROUP BY {key}, t),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY length(t) + CASE WHEN short THEN 4 ELSE 0 END DESC, i) AS rn FROM {name}_k),
{name} AS (SELECT {key}, string_agg(t, ' ' ORDER BY i) AS kw FROM {name}_r WHERE rn <= {n} GROUP BY {key})"""


@query("content_tokens", f"""
WITH t AS (SELECT doc_id, {sql_tokens('text')} AS l FROM documents)
SELECT doc_id, len(list_distinct(l)) AS n_tokens, coalesce(l[1], '') AS first_token,
       md5(array_to_string({sql_distinct('l')}, ' ')) AS token_hash FROM t""")
def content_tokens(spark, d):
    t = text.tokens(F.col("text"))
    return b.table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("first_token"),
                                                 F.md5(F.array_join(t, " ")).alias("token_hash"))


@query("title_word_overlap", f"""
WITH p AS (SELECT p_partkey, list_distinct({sql_tokens("p_name || ' ' || p_type")}) AS hay, list_distinct({sql_tokens("p_name")}) AS want,
                  list_distinct({sql_tokens("'running red gears for economy'")}) AS dom FROM part)
SELECT p_partkey, round(len(list_intersect(want, hay)) / greatest(len(want), 1)::DOUBLE, 6) AS name_share,
       round(len(list_intersect(dom, hay)) / len(dom)::DOUBLE, 6) AS topic_share,
       round(len(list_intersect(want, hay)) / greatest(len(want), 1)::DOUBLE + 0.3::DOUBLE * len(list_intersect(dom, hay)) / len(dom)::DOUBLE, 6) AS domain_score
FROM p""")
def title_word_overlap(spark, d):
    p = b.table(spark, d, "part")
    hay, want = text.tokens(F.concat_ws(" ", "p_name", "p_type")), text.tokens(F.col("p_name"))
    dom = text.tokens(F.lit("running red gears for economy"))
    return p.select("p_partkey", F.round(text.overlap_share(want, hay), 6).alias("name_share"), F.round(text.overlap_share(dom, hay), 6).alias("topic_share"),
                    F.round(text.domain_score(want, dom, hay), 6).alias("domain_score"))


@query("line_keywords", b.with_sql(sql_keyword_cte("k", "documents", "doc_id", "text", 4)) +
       "SELECT d.doc_id, coalesce(kw, '') AS keywords FROM documents d LEFT JOIN k USING (doc_id)")
def line_keywords(spark, d):
    return b.table(spark, d, "documents").select("doc_id", text.keywords(F.col("text"), 4).alias("keywords"))


@query("clean_stock_queries", rf"""
WITH q AS (SELECT p_partkey, list_filter(regexp_split_to_array(p_name || ' screen ' || lower(p_type) || ', intro', '\s+'), lambda x: x <> '') AS w FROM part),
k AS (SELECT *, list_filter(w, lambda x: NOT list_contains({BANNED}, trim(lower(x), ',.'))) AS kept FROM q)
SELECT p_partkey, left(array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE w END, ' '), 80) AS q FROM k""")
def clean_stock_queries(spark, d):
    raw = F.concat(F.col("p_name"), F.lit(" screen "), F.lower("p_type"), F.lit(", intro"))
    return b.table(spark, d, "part").select("p_partkey", text.clean_query(raw).alias("q"))


@query("sentence_split", b.with_sql(b.SENTENCES) + f"SELECT script_id, p::INTEGER AS p, s, round({b.WORDS_IN.format('s')} / 2.5::DOUBLE, 4) AS secs FROM sent")
def sentence_split(spark, d):
    s = b.scripts(spark, d).select("script_id", F.posexplode(text.sentences(F.col("text"))).alias("p", "s"))
    return s.withColumn("secs", F.round(text.speech_seconds(F.col("s")), 4))


@query("beat_split", b.with_sql(b.BEATS) + "SELECT script_id, i, text, dur::DOUBLE AS dur FROM beats")
def beat_split(spark, d):
    return windows.split_beats(b.scripts(spark, d)).withColumn("i", F.col("i").cast("long"))


@query("beat_split_grouped", b.with_sql(b.BEATS) + "SELECT script_id, i, text, dur::DOUBLE AS dur FROM beats")
def beat_split_grouped(spark, d):
    return windows.split_beats_grouped(b.scripts(spark, d)).withColumn("i", F.col("i").cast("long"))


@query("caption_two_lines", b.with_sql(b.SENTENCES) + r""",
w AS (SELECT script_id, p, s, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') AS l FROM sent),
c AS (SELECT script_id, p, s, l, unnest(range(1, greatest(len(l), 2))) AS k FROM w WHERE length(s) > 42 AND len(l) >= 2),
m AS (SELECT script_id, p, k, s, array_to_string(l[:k], ' ') AS a, array_to_string(l[k + 1:], ' ') AS z FROM c),
best AS (SELECT script_id, p, arg_min(a || E'\n' || z, greatest(length(a), length(z)) * 1000000 + k) AS t FROM m GROUP BY 1, 2)
SELECT sent.script_id, sent.p::INTEGER AS p, coalesce(best.t, s) AS lines FROM sent LEFT JOIN best USING (script_id, p)""")
def caption_two_lines(spark, d):
    s = b.scripts(spark, d).select("script_id", F.posexplode(text.sentences(F.col("text"))).alias("p", "s"))
    return s.select("script_id", "p", text.two_lines(F.col("s")).alias("lines"))


@query("visual_line_score", b.with_sql(b.SENTENCES) + rf"""
SELECT script_id, p::INTEGER AS p,
  round(len(list_filter(regexp_extract_all(lower(s), '[a-zऀ-ॿ]+'), lambda x: length(x) >= 6)) / greatest({b.WORDS_IN.format('lower(s)')}, 1)::DOUBLE
   - 0.6::DOUBLE * len(regexp_extract_all(regexp_replace(lower(s), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'),
      '(?:^|[^\p{{L}}\p{{N}}_])({fixed.DIRECT_ADDRESS.replace("'", "''")})(?:$|[^\p{{L}}\p{{N}}_])')) / greatest({b.WORDS_IN.format('lower(s)')}, 1)::DOUBLE, 6) AS score
FROM sent""")
def visual_line_score(spark, d):
    s = b.scripts(spark, d).select("script_id", F.posexplode(text.sentences(F.col("text"))).alias("p", "s"))
    return s.select("script_id", "p", F.round(text.visual_score(F.col("s")), 6).alias("score"))


@query("free_text_dates", """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6
   WHEN 0 THEN strftime(o_orderdate, '%d') || ' ' || strftime(o_orderdate, '%B') || ' ' || strftime(o_orderdate, '%Y') || ' at 1:16 pm'
   WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 15:15:16' WHEN 2 THEN '<b>' || strftime(o_orderdate, '%B %Y') || '</b>'
   WHEN 3 THEN 'c. ' || strftime(o_orderdate, '%Y') WHEN 4 THEN o_orderpriority ELSE strftime(o_orderdate, '%Y') END AS raw,
   o_orderdate AS dt FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(dt, '%Y-%m-%d') WHEN 1 THEN strftime(dt, '%Y-%m-%d') WHEN 2 THEN strftime(dt, '%Y-%m')
   WHEN 3 THEN strftime(dt, '%Y') WHEN 5 THEN strftime(dt, '%Y') END AS iso FROM t""")
def free_text_dates(spark, d):
    o = b.table(spark, d, "orders")
    dt, m = F.col("o_orderdate"), F.col("o_orderkey") % 6
    fmt = lambda p: F.date_format(dt, p)
    raw = (F.when(m == 0, F.concat(fmt("dd"), F.lit(" "), fmt("MMMM"), F.lit(" "), fmt("yyyy"), F.lit(" at 1:16 pm")))
           .when(m == 1, F.concat(fmt("yyyy-MM-dd"), F.lit(" 15:15:16"))).when(m == 2, F.concat(F.lit("<b>"), fmt("MMMM yyyy"), F.lit("</b>")))
           .when(m == 3, F.concat(F.lit("c. "), fmt("yyyy"))).when(m == 4, F.col("o_orderpriority")).otherwise(fmt("yyyy")))
    return o.select("o_orderkey", dates.parse_date(raw).alias("iso"))


@query("partial_date_bounds", """
WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS dt, o_orderkey % 4 AS m FROM orders)
SELECT o_orderkey, CASE m WHEN 0 THEN strftime(dt, '%Y-%m-%d') WHEN 1 THEN strftime(date_trunc('month', dt), '%Y-%m-%d')
                        WHEN 2 THEN strftime(dt, '%Y') || '-01-01' END AS lo,
       CASE m WHEN 0 THEN strftime(dt, '%Y-%m-%d') WHEN 1 THEN strftime(last_day(dt), '%Y-%m-%d') WHEN 2 THEN strftime(dt, '%Y') || '-12-31' END AS hi
FROM t""")
def partial_date_bounds(spark, d):
    o = b.table(spark, d, "orders")
    m, dt = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = (F.when(m == 0, F.date_format(dt, "yyyy-MM-dd'T'HH:mm:ss")).when(m == 1, F.date_format(dt, "yyyy-MM"))
           .when(m == 2, F.date_format(dt, "yyyy")).otherwise(F.concat(F.date_format(dt, "yyyy"), F.lit("-13"))))
    r = dates.partial_date_bounds(raw)
    return o.select("o_orderkey", r["lo"].cast("string").alias("lo"), r["hi"].cast("string").alias("hi"))


LICENCE_SQL = """CASE WHEN coalesce(src, '') IN ('', 'own') THEN 'own' WHEN trim(t) = '' THEN 'unknown'
  WHEN contains(t, '-nc') OR contains(t, 'noncommercial') OR contains(t, 'non-commercial') OR contains(t, '-nd') OR contains(t, 'noderiv') THEN 'restricted'
  WHEN contains(t, 'public domain') OR contains(t, 'publicdomain') OR contains(t, 'cc0') OR contains(t, 'zero/1.0') OR contains(t, 'mark/1.0') OR contains(t, 'pixabay') THEN 'safe'
  WHEN contains(t, '-sa') OR contains(t, 'sharealike') OR contains(t, 'share-alike') THEN 'caution'
  WHEN contains(t, 'cc by') OR contains(t, 'cc-by') OR contains(t, '/licenses/by/') THEN 'attribution' ELSE 'unknown' END"""


@query("document_licence_class", f"""
WITH x AS (SELECT doc_id, source AS src, lower(text || ' ') AS t FROM documents)
SELECT doc_id, {LICENCE_SQL} AS cls FROM x""")
def document_licence_class(spark, d):
    return b.table(spark, d, "documents").select("doc_id", media.licence_class(F.col("text"), F.lit(None).cast("string"), F.col("source")).alias("cls"))


@query("licence_cards", f"""
WITH x AS (SELECT p_partkey, p_name, {b.sql_pick(b.LICENCES, 'p_size')} AS lic, {b.sql_pick(b.SOURCES, 'p_partkey')} AS src FROM part),
y AS (SELECT *, lower(lic || ' ') AS t FROM x), z AS (SELECT *, {LICENCE_SQL} AS cls FROM y)
SELECT p_partkey, cls, CASE cls WHEN 'own' THEN 'Your footage' WHEN 'safe' THEN 'Free to use' WHEN 'attribution' THEN 'Credit required'
         WHEN 'caution' THEN 'Share-alike' WHEN 'restricted' THEN 'Non-commercial' ELSE 'Licence unknown' END AS label,
       cls IN ('own', 'safe', 'attribution') AS commercial,
       CASE WHEN cls IN ('attribution', 'caution') THEN trim('“' || p_name || '” by maker. ' || trim(lic) || '. https://x/' || p_partkey) END AS credit FROM z""")
def licence_cards(spark, d):
    lic, src = b.pick(b.LICENCES, F.col("p_size")), b.pick(b.SOURCES, F.col("p_partkey"))
    c = media.licence_card(lic, F.lit(""), src, F.col("p_name"), F.lit("maker"), F.concat(F.lit("https://x/"), F.col("p_partkey").cast("string")))
    return b.table(spark, d, "part").select("p_partkey", c["class"].alias("cls"), c["label"].alias("label"), c["commercial"].alias("commercial"), c["credit"].alias("credit"))


@query("orientation_and_rate", """
SELECT p_partkey, CASE WHEN p_size * 40 > 1000 * 1.1::DOUBLE THEN '16:9' WHEN 1000 > p_size * 40 * 1.1::DOUBLE THEN '9:16' ELSE '1:1' END AS orientation,
       round_even(p_retailprice / 40, 0)::INTEGER AS timebase, abs(p_retailprice / 40 - round_even(p_retailprice / 40, 0)) > 0.01 AS ntsc FROM part""")
def orientation_and_rate(spark, d):
    r = media.rate(F.col("p_retailprice") / 40)
    return b.table(spark, d, "part").select("p_partkey", media.orientation(F.col("p_size") * 40, F.lit(1000)).alias("orientation"), r["timebase"].alias("timebase"), r["ntsc"].alias("ntsc"))


@query("timecodes", """
WITH f AS (SELECT event_id, event_id * 25 + (event_id % 25) AS fr, event_id * 1.25::DOUBLE AS sec FROM events)
SELECT event_id, printf('%02d:%02d:%02d:%02d', fr // 25 // 3600, (fr // 25 // 60) % 60, (fr // 25) % 60, fr % 25) AS tc,
       printf('%02d:%02d:%02d,%03d', (sec * 1000)::BIGINT // 3600000, (sec * 1000)::BIGINT // 60000 % 60, (sec * 1000)::BIGINT // 1000 % 60, (sec * 1000)::BIGINT % 1000) AS srt,
       round_even(sec * 25, 0)::BIGINT AS frames, round(fr / 25.0::DOUBLE, 6) AS back FROM f""")
def timecodes(spark, d):
    e = b.table(spark, d, "events").withColumns({"fr": F.col("event_id") * 25 + F.col("event_id") % 25, "sec": F.col("event_id") * 1.25})
    e = e.withColumn("tc", media.timecode(F.col("fr")))
    return e.select("event_id", "tc", media.srt_time(F.col("sec")).alias("srt"), media.to_frames(F.col("sec")).alias("frames"),
                    F.round(media.timecode_seconds(F.col("tc")), 6).alias("back"))


@query("page_slugs_and_paths", r"""
SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
       '/' || regexp_replace(replace(url, 'https://', 'https:/'), '^file://(localhost)?/?', '') AS path,
       regexp_replace(url || '&key=abc' || page_id || '&z=1', 'key=[^&\s]+', 'key=<redacted>', 'g') AS redacted FROM pages""")
def page_slugs_and_paths(spark, d):
    p = b.table(spark, d, "pages")
    return p.select("page_id", text.slug(F.col("url")).alias("slug"),
                    text.path_from_url(F.concat(F.lit("file://localhost/"), F.replace("url", F.lit("https://"), F.lit("https:/")))).alias("path"),
                    text.redact(F.concat(F.col("url"), F.lit("&key=abc"), F.col("page_id").cast("string"), F.lit("&z=1"))).alias("redacted"))


@query("vector_norms_and_blend", b.with_sql(b.SHOTS) + """,
hint AS (SELECT label, list(x / n ORDER BY pos) AS h FROM (
   SELECT label, pos, x, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM (
     SELECT label, pos, sum(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2)) GROUP BY 1),
v AS (SELECT shot_id, emb, CASE WHEN file_id % 2 = 0 THEN [emb[i] + 0.3::DOUBLE * h[i] FOR i IN range(1, len(emb) + 1)] END AS m FROM shots JOIN hint ON label = file_id),
w AS (SELECT shot_id, emb, m IS NULL AS plain, coalesce(m, emb) AS m FROM v),
u AS (SELECT shot_id, emb, m, plain, list_sum([x * x FOR x IN m]) AS mm, list_sum([m[i] * emb[i] FOR i IN range(1, len(emb) + 1)]) AS me FROM w)
SELECT shot_id, round(sqrt(list_inner_product(emb, emb)), 4) AS norm, round(CASE WHEN plain THEN m[1] ELSE m[1] / sqrt(mm) END, 4) AS x1, round(me / sqrt(mm), 4) AS cos FROM u""")
def vector_norms_and_blend(spark, d):
    from ..operators.aggregates import mean_embedding
    s = b.shots(spark, d)
    hint = mean_embedding(s.where("file_id % 2 = 0"), "file_id").select("file_id", F.col("emb").alias("h"))
    m = s.join(hint, "file_id", "left").withColumn("m", vector.blend(F.col("emb"), F.col("h")))
    return m.select("shot_id", F.round(vector.norm(F.col("emb")), 4).alias("norm"), F.round(F.get("m", F.lit(0)), 4).alias("x1"),
                    F.round(vector.dot(F.col("m"), F.col("emb")), 4).alias("cos"))


@query("topic_words", b.with_sql(sql_keyword_cte("k", "documents", "doc_id", "text", 8)) + f""",
w AS (SELECT doc_id, unnest(string_split(kw, ' ')) AS w, unnest(range(len(string_split(kw, ' ')))) AS i FROM k),
e AS (SELECT doc_id, lang AS w, -1 AS i FROM documents UNION ALL SELECT doc_id, w, i FROM w WHERE NOT list_contains({FILLER}, w)),
f AS (SELECT doc_id, arg_min(w, i) AS w, min(i) AS i FROM e GROUP BY doc_id, lower(w)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f)
SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS topic FROM r WHERE rn <= 5 GROUP BY 1""")
def topic_words(spark, d):
    return b.table(spark, d, "documents").select("doc_id", lines.topic_words(F.array("lang"), F.col("text")).alias("topic"))


@query("spot_weights", b.with_sql(b.SEGMENTS, b.DURATIONS) + """
SELECT video_id, round_even(least(3.0, greatest(0.5, duration * 0.1::DOUBLE)), 2)::DOUBLE AS hook, CASE WHEN duration < 20 THEN 1.0 ELSE 1.5 END::DOUBLE AS min_slot,
       round((video_id % 101) / 100.0::DOUBLE * (0.4::DOUBLE + 0.6::DOUBLE * ((video_id % 97) / 96.0::DOUBLE)), 9) AS weight FROM durations""")
def spot_weights(spark, d):
    x = b.durations(spark, d)
    return x.select("video_id", media.hook_seconds(F.col("duration")).alias("hook"), media.min_slot_seconds(F.col("duration")).alias("min_slot"),
                    F.round(media.spot_weight((F.col("video_id") % 101) / 100.0, (F.col("video_id") % 97) / 96.0), 9).alias("weight"))
