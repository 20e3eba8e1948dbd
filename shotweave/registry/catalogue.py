"""Catalogue maintenance, counts and readers."""
from pyspark.sql import functions as F

from ..operators import filters, tables, windows
from ..sources import sinks, stock_json, timelines
from . import bindings as b
from .base import query


def raw_shots(spark, d):
    v = F.col("vec_id")
    own = v % 4 == 0
    n = b.table(spark, d, "part").count()
    return b.table(spark, d, "embeddings").select(
        v.alias("shot_id"), F.when(own, F.col("label").cast("long")).alias("file_id"), F.when(~own, F.pmod(v, F.lit(n))).alias("stock_id"),
        ((v % 25) * 4.0).alias("t_start"), ((v % 25) * 4.0 + 4.0).alias("t_end"), F.col("embedding").alias("emb"),
        F.when(v % 11 != 0, b.pick(b.SIZES, v)).alias("size"), b.pick(b.MOTIONS, v).alias("motion"), b.pick(b.ORIENT, v).alias("orientation"),
        b.pick(b.WEATHER, v).alias("weather"), ((v % 50) / 50.0).alias("weather_conf"), (v % 7 != 0).alias("active"))


def stock_items(spark, d):
    k = F.col("p_partkey")
    return b.table(spark, d, "part").select(
        k.alias("id"), b.pick(b.SOURCES[1:], k).alias("source"), k.cast("string").alias("source_id"), F.col("p_name").alias("title"),
        F.lower("p_type").alias("tags"), F.lit("maker").alias("author"), F.concat(F.lit("https://x/"), k.cast("string")).alias("page_url"),
        b.pick(b.LICENCES, F.col("p_size")).alias("licence"), F.lit("").alias("licence_url"), F.when(k % 4 > 0, k % 4).alias("library_id"),
        (k % 60).cast("double").alias("duration"), (F.col("p_size") * 40).alias("width"), F.lit(1000).alias("height"),
        F.when(k % 3 == 0, F.concat((1990 + k % 30).cast("string"), F.lit("-05"))).alias("published_at"), F.lit("recorded").alias("date_kind"),
        F.lit(None).cast("double").alias("gps_lat"), F.lit(None).cast("double").alias("gps_lon"))


def footage_files(spark, d):
    """One file per label."""
    e = b.table(spark, d, "embeddings")
    return e.groupBy(F.col("label").cast("long").alias("id")).agg(F.count("*").alias("n")).select(
        "id", F.concat(F.lit("/footage/Clip_"), F.col("id").cast("string"), F.lit(".mp4")).alias("path"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("library_id"),
        F.lit(120.0).alias("duration"), F.when(F.col("id") % 2 == 1, F.col("id")).alias("stock_id"))


LIC = """CASE WHEN src IS NULL OR src IN ('', 'own') THEN 'own' WHEN lic = '' THEN 'unknown' WHEN contains(lower(lic), '-nc') THEN 'restricted'
  WHEN contains(lower(lic), 'cc0') OR contains(lower(lic), 'pixabay') THEN 'safe' WHEN contains(lower(lic), '-sa') THEN 'caution' WHEN contains(lower(lic), 'cc by') THEN 'attribution'
  ELSE 'unknown' END"""
RAW = f"""
raw_shots AS (SELECT vec_id AS shot_id, CASE WHEN vec_id % 4 = 0 THEN label::BIGINT END AS file_id, CASE WHEN vec_id % 4 <> 0 THEN vec_id % (SELECT count(*) FROM part) END AS stock_id,
   CASE WHEN vec_id % 11 <> 0 THEN {b.sql_pick(b.SIZES, 'vec_id')} END AS size, vec_id % 7 <> 0 AS active, (vec_id % 25) * 4.0::DOUBLE AS t_start FROM embeddings),
stock AS (SELECT p_partkey AS id, {b.sql_pick(b.SOURCES[1:], 'p_partkey')} AS src, {b.sql_pick(b.LICENCES, 'p_size')} AS lic, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 END AS lib,
   p_name AS title, (p_partkey % 60)::DOUBLE AS duration, p_size * 40 AS width, 1000 AS height, CASE WHEN p_partkey % 3 = 0 THEN (1990 + p_partkey % 30) || '-05' END AS published_at FROM part),
files AS (SELECT DISTINCT label::BIGINT AS id, CASE WHEN label % 3 > 0 THEN label % 3 END AS lib, CASE WHEN label % 2 = 1 THEN label::BIGINT END AS stock_id FROM embeddings),
dim AS (SELECT s.shot_id, coalesce('f' || file_id, 's' || s.stock_id) AS source_key, coalesce(size, 'unknown') AS size, coalesce(src, 'own') AS source, {LIC} AS licence_class,
   coalesce(f.lib, st.lib, 0)::BIGINT AS lib, t_start FROM raw_shots s LEFT JOIN stock st ON st.id = s.stock_id LEFT JOIN files f ON f.id = s.file_id WHERE active)"""


@query("catalogue_snapshot", b.with_sql(RAW) + "SELECT * FROM dim")
def catalogue_snapshot(spark, d):
    return tables.shots_dim(raw_shots(spark, d), stock_items(spark, d), footage_files(spark, d)).select(
        "shot_id", "source_key", "size", "source", "licence_class", "lib", "t_start")


@query("library_counts", b.with_sql(RAW) + "SELECT lib, count(*) AS shots, count(DISTINCT source_key) AS clips FROM dim GROUP BY lib")
def library_counts(spark, d):
    return tables.library_counts(tables.shots_dim(raw_shots(spark, d), stock_items(spark, d), footage_files(spark, d)))


@query("library_scope", b.with_sql(RAW) + "SELECT shot_id, lib FROM dim WHERE lib NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey % 2 = 1 AND r_regionkey <> 3)")
def library_scope(spark, d):
    live = b.table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.when(F.col("r_regionkey") % 2 == 1, "live").otherwise("folder").alias("kind"))
    dim = tables.shots_dim(raw_shots(spark, d), stock_items(spark, d), footage_files(spark, d))
    return filters.scope(dim, live, also_lib=3).select("shot_id", "lib")


@query("shot_filters", b.with_sql(b.SHOTS) + """SELECT shot_id FROM shots WHERE size IN ('wide', 'close') AND motion IN ('still', 'action') AND orientation <> '1:1'
   AND orientation = '16:9' AND source IN ('own', 'commons') AND licence_class IN ('own', 'safe', 'attribution') AND t_end - t_start >= 3""")
def shot_filters(spark, d):
    return filters.apply_filters(b.shots(spark, d), size=["wide", "close"], motion=["still", "action"], orientation="16:9", source=["own", "commons"],
                                 licence="commercial", min_len=3.0).select("shot_id")


@query("suitable_clips", b.with_sql(RAW) + "SELECT id FROM stock WHERE width >= height AND duration BETWEEN 4 AND 45")
def suitable_clips(spark, d):
    return filters.suitable(stock_items(spark, d)).select("id")


@query("insert_or_ignore", """WITH n AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2)
SELECT n.user_id, n.event_type, n.event_id FROM n WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = n.user_id AND c.c_mktsegment = 'BUILDING')""")
def insert_or_ignore(spark, d):
    e = b.table(spark, d, "events").select("user_id", "event_type", "event_id")
    stored = e.join(b.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("user_id") == F.col("c_custkey"), "left_semi").select("user_id", "event_type")
    return tables.insert_ignore(stored, e, ["user_id", "event_type"], "event_id")


@query("upsert_latest", """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def upsert_latest(spark, d):
    e = b.table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return tables.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("upsert_text_column", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, coalesce('toxic ' || nullif(toxic, 0), source) AS source
FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id""")
def upsert_text_column(spark, d):
    t = b.table(spark, d, "documents").select("doc_id", "lang", "source")
    new = b.table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") != 0, F.concat(F.lit("toxic "), F.col("toxic").cast("string"))).alias("source"))
    return tables.upsert_columns(t, new, ["doc_id"], ["source"])


@query("adopt_stock_clips", b.with_sql(RAW) + """
SELECT s.shot_id, coalesce(f.stock_id, s.stock_id) AS stock_id, active AND NOT (s.file_id IS NULL AND s.stock_id IN (SELECT stock_id FROM files WHERE stock_id IS NOT NULL)) AS active,
  coalesce(CASE WHEN f.stock_id IS NOT NULL THEN st.published_at END, '2020') AS shot_date,
  CASE WHEN f.stock_id IS NOT NULL AND st.published_at IS NOT NULL THEN 'recorded' ELSE 'mtime' END AS date_source
FROM raw_shots s LEFT JOIN files f ON f.id = s.file_id LEFT JOIN stock st ON st.id = f.stock_id""")
def adopt_stock_clips(spark, d):
    s = raw_shots(spark, d)
    prov = s.select("shot_id", F.lit("2020").alias("shot_date"), F.lit("mtime").alias("date_source"), F.lit(None).cast("double").alias("gps_lat"),
                    F.lit(None).cast("double").alias("gps_lon"), F.lit("own").alias("source_kind"))
    a, p = tables.adopt_stock(s, prov, stock_items(spark, d), footage_files(spark, d))
    return a.select("shot_id", "stock_id", "active").join(p.select("shot_id", "shot_date", "date_source"), "shot_id")


@query("backfill_targets", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def backfill_targets(spark, d):
    done = b.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "tags").otherwise("ocr").alias("stage"), F.lit("v1").alias("model_ver"))
    return tables.needs_backfill(b.table(spark, d, "documents").select("doc_id"), done, "doc_id", "tags", "v1")


@query("fresh_cache_entries", "SELECT event_id FROM events WHERE epoch((SELECT max(ts) FROM events)) - epoch(ts) < 86400")
def fresh_cache_entries(spark, d):
    e = b.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("fetched_at"))
    now = e.select(F.max("fetched_at")).first()[0]
    return tables.fresh(e, F.lit(now).cast("timestamp")).select("event_id")


@query("request_cache_keys", """SELECT event_id, sha1('http://api' || '{"page":"' || event_type || '","q":"' || user_id || '"}') AS key FROM events""")
def request_cache_keys(spark, d):
    params = F.create_map(F.lit("q"), F.col("user_id").cast("string"), F.lit("key"), F.col("event_id").cast("string"), F.lit("page"), F.col("event_type"))
    return b.table(spark, d, "events").select("event_id", tables.cache_key(F.lit("http://api"), params).alias("key"))


@query("duplicate_files", """
WITH f AS (SELECT doc_id AS id, sha1(octet_length(encode(text))::VARCHAR || text) AS h FROM documents)
SELECT id, CASE WHEN id > min(id) OVER (PARTITION BY h) THEN 'duplicate' ELSE 'ok' END AS status FROM f""")
def duplicate_files(spark, d):
    body = F.col("text").cast("binary")
    f = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), tables.content_hash(F.octet_length("text"), body).alias("content_hash"), F.lit("ok").alias("status"))
    return tables.mark_duplicates(f).select("id", "status")


@query("pending_ingest_tasks", """SELECT DISTINCT event_type AS source, user_id::VARCHAR AS query, (event_id % 3)::INTEGER AS page FROM events
EXCEPT SELECT event_type, user_id::VARCHAR, (event_id % 3)::INTEGER FROM events WHERE value > 20""")
def pending_ingest_tasks(spark, d):
    e = b.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("query"), (F.col("event_id") % 3).cast("int").alias("page"), "value")
    return tables.pending_tasks(e.select("source", "query", "page").distinct(), e.where("value > 20").withColumn("done", F.lit(True)))


@query("valid_previews", "SELECT p_partkey FROM part WHERE least(p_size * 3, 100) >= 48")
def valid_previews(spark, d):
    return tables.valid_preview(b.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 3).alias("width"), F.lit(100).alias("height"))).select("p_partkey")


@query("stage_status_counts", """WITH c AS (SELECT event_type, (user_id % 3)::VARCHAR AS s, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, string_agg(s || '=' || n, ',' ORDER BY s) AS counts FROM c GROUP BY 1""")
def stage_status_counts(spark, d):
    e = b.table(spark, d, "events").select("event_type", (F.col("user_id") % 3).cast("string").alias("s"))
    m = tables.nested_counts(e, "event_type", "s")
    pairs = F.transform(F.map_entries("counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return m.select("event_type", F.array_join(F.array_sort(pairs), ",").alias("counts"))


@query("claim_and_drop_library", b.with_sql(RAW) + """SELECT id, nullif(coalesce(lib, CASE WHEN id IN (SELECT ps FROM (SELECT l_partkey AS ps FROM lineitem WHERE l_quantity > 45)) THEN 9 END), 2) AS library_id FROM stock""")
def claim_and_drop_library(spark, d):
    st = stock_items(spark, d).select("id", "source_id", "library_id")
    again = b.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("source_id"))
    return tables.drop_library(tables.claim_library(st, again, 9), 2).select("id", "library_id")


@query("shot_cards", b.with_sql(RAW) + """SELECT d.shot_id, CASE WHEN s.file_id IS NOT NULL THEN 'Clip_' || s.file_id || '.mp4' ELSE st.title END AS file, d.licence_class AS licence,
  coalesce(substr(CASE WHEN d.shot_id % 2 = 0 THEN '2021-05-06T10' END, 1, 10), '') AS date FROM dim d JOIN raw_shots s USING (shot_id) LEFT JOIN stock st ON st.id = s.stock_id""")
def shot_cards(spark, d):
    dim = tables.shots_dim(raw_shots(spark, d), stock_items(spark, d), footage_files(spark, d))
    prov = dim.select("shot_id", F.when(F.col("shot_id") % 2 == 0, "2021-05-06T10").alias("shot_date"), F.lit("meta").alias("date_source"))
    return tables.cards(dim.select("shot_id"), dim, prov).select("shot_id", "file", F.col("licence.class").alias("licence"), "date")


# ------------------------------------------------------------------------------------------ readers
@query("video_hits_normalised", """SELECT p_partkey::VARCHAR AS source_id, p_name AS title, (p_partkey % 60)::DOUBLE AS duration, p_size AS width, 'https://v/' || p_partkey AS url
FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 60 >= 2""")
def video_hits_normalised(spark, d):
    k = F.col("p_partkey")
    tiny = F.struct(F.concat(F.lit("https://v/"), k.cast("string")).alias("url"), F.col("p_size").alias("width"), F.lit(10).alias("height"), F.lit(5).alias("size"), F.lit("t.jpg").alias("thumbnail"))
    hit = F.struct(k.alias("id"), F.col("p_name").alias("tags"), (k % 60).alias("duration"), (k % 5 == 0).alias("isAiGenerated"), (k % 7 == 0).alias("isLowQuality"),
                   F.create_map(F.lit("tiny"), tiny).alias("videos"))
    raw = b.table(spark, d, "part").select(F.to_json(F.struct(F.array(hit).alias("hits"))).alias("body"))
    return stock_json.normalise_hits(raw).select("source_id", "title", "duration", "width", stock_json.rendition_url(F.col("renditions")).alias("url"))


@query("wiki_pages_normalised", """SELECT p_partkey::VARCHAR AS source_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN '2015-04' ELSE '2019-08-10' END AS published_at,
  CASE WHEN p_partkey % 2 = 0 THEN 'recorded' ELSE 'upload' END AS date_kind, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END AS gps_lat, p_type || ', x' AS tags FROM part WHERE p_partkey % 60 >= 2""")
def wiki_pages_normalised(spark, d):
    k = F.col("p_partkey")
    val = lambda c: F.struct(c.alias("value"))
    meta = F.map_filter(F.create_map(F.lit("DateTimeOriginal"), val(F.when(k % 2 == 0, "<b>April 2015</b>")), F.lit("Categories"), val(F.concat(F.lit("<i>"), F.col("p_type"), F.lit("</i>|x"))),
                                     F.lit("Artist"), val(F.col("p_brand"))), lambda _, v: v["value"].isNotNull())
    info = F.struct(F.lit("u").alias("url"), F.lit("t.jpg").alias("thumburl"), F.lit("2019-08-10T12:00:00Z").alias("timestamp"), (k % 60).cast("double").alias("duration"),
                    F.lit(640).alias("width"), F.lit(360).alias("height"), meta.alias("extmetadata"))
    page = F.struct(k.alias("pageid"), F.concat(F.lit("File:"), F.col("p_name"), F.lit(".webm")).alias("title"), F.array(info).alias("imageinfo"),
                    F.when(k % 3 == 0, F.array(F.struct(F.col("p_size").cast("double").alias("lat"), F.lit(1.5).alias("lon")))).alias("coordinates"))
    raw = b.table(spark, d, "part").select(F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("query"))).alias("body"))
    return stock_json.normalise_pages(raw).select("source_id", "title", "published_at", "date_kind", "gps_lat", "tags")


@query("archive_docs_normalised", """SELECT 'id' || p_partkey AS source_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type || ', ' || p_brand ELSE p_type END AS tags,
  CASE WHEN p_partkey % 3 = 0 THEN 'http://cc/by' ELSE 'Public domain (Prelinger / Internet Archive)' END AS licence, '1950' AS published_at FROM part""")
def archive_docs_normalised(spark, d):
    k = F.col("p_partkey")
    p = b.table(spark, d, "part")
    doc = lambda subj: F.to_json(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("id"), k.cast("string")).alias("identifier"), F.col("p_name").alias("title"), F.lit("c. 1950").alias("date"),
                                                                    subj.alias("subject"), F.when(k % 3 == 0, "http://cc/by").alias("licenseurl"))).alias("docs")).alias("response")))
    raw = p.select(F.when(k % 2 == 0, doc(F.array("p_type", "p_brand"))).otherwise(doc(F.col("p_type"))).alias("body"))
    return stock_json.normalise_docs(raw).select("source_id", "title", "tags", "licence", "published_at")


def order_clips(spark, d):
    """Line items as clips of their order: laid end to end, whole seconds."""
    li = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("script_id"), F.col("l_linenumber").cast("long").alias("i"), "l_partkey", F.col("l_quantity").alias("dur"))
    c = windows.running_timeline(li.groupBy("script_id", "i").agg(F.max("l_partkey").alias("l_partkey"), F.max("dur").alias("dur")), "script_id", "dur", once=True)
    return c.select("script_id", "i", "rec_in", "rec_out", (F.col("l_partkey") % 50).cast("double").alias("src_in"), (F.col("l_partkey") % 50 + F.col("dur")).alias("src_out"),
                    F.concat(F.lit("/m/clip"), (F.col("l_partkey") % 9).cast("string"), F.lit(".mp4")).alias("path"),
                    F.concat(F.lit("clip"), (F.col("l_partkey") % 9).cast("string"), F.lit(".mp4")).alias("name"), F.concat(F.lit("line "), F.col("i").cast("string")).alias("text"),
                    F.when(F.col("l_partkey") % 3 == 0, F.lit("FILE · 2019")).alias("label"), b.pick(b.SOURCES, F.col("l_partkey") % 9).alias("source"), F.lit("maker").alias("author"), F.lit("https://x").alias("page_url"))


CLIPS = f"""
li AS (SELECT l_orderkey AS script_id, l_linenumber::BIGINT AS i, max(l_partkey) AS pk, max(l_quantity) AS dur FROM lineitem GROUP BY 1, 2),
clips AS (SELECT *, sum(dur) OVER (PARTITION BY script_id ORDER BY i) - dur AS rec_in, sum(dur) OVER (PARTITION BY script_id ORDER BY i) AS rec_out FROM li)"""


@query("edit_list_round_trip", b.with_sql(CLIPS) + """SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY i) AS event, (pk % 50)::DOUBLE AS src_in, (pk % 50)::DOUBLE + dur AS src_out, rec_in, rec_out,
  'clip' || pk % 9 || '.mp4' AS name, 'line ' || i AS note FROM clips""")
def edit_list_round_trip(spark, d):
    """Clips written as edit-list text and parsed back."""
    rows = sinks.edl_rows(order_clips(spark, d))
    lines = rows.select(F.col("script_id").alias("project"), "n", F.col("event").alias("line"))
    return timelines.edl_placements(lines).select(F.col("project").alias("script_id"), "event", "src_in", "src_out", "rec_in", "rec_out", "name", "note")


@query("label_caption_cues", b.with_sql(CLIPS) + """, l AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY rec_in, rec_out) AS n FROM clips WHERE pk % 3 = 0)
SELECT script_id, n, n || E'\\n' || printf('%02d:%02d:%02d,000', rec_in::BIGINT // 3600, rec_in::BIGINT // 60 % 60, rec_in::BIGINT % 60) || ' --> ' ||
   printf('%02d:%02d:%02d,000', rec_out::BIGINT // 3600, rec_out::BIGINT // 60 % 60, rec_out::BIGINT % 60) || E'\\nFILE · 2019\\n' AS cue FROM l""")
def label_caption_cues(spark, d):
    return sinks.srt_rows(order_clips(spark, d))


@query("credit_lines", b.with_sql(CLIPS) + f""", s AS (SELECT *, {b.sql_pick(b.SOURCES, 'pk % 9')} AS source FROM clips),
u AS (SELECT script_id, pk % 9 AS f, min(source) AS source, min(rec_in) AS t0 FROM s WHERE source <> 'own' GROUP BY 1, 2)
SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY t0, f) AS n, 'clip' || f || '.mp4 · ' || source || ' · by maker · https://x' AS line FROM u""")
def credit_lines(spark, d):
    return sinks.credit_rows(order_clips(spark, d))
