"""Claims, evidence and verdicts over whole text and order tables."""
from pyspark.sql import functions as F

from ..operators import places, truth
from . import bindings as b
from .base import query

TODAY = "1999-01-01"

ALIASES = b.GAZ + """,
alias_rows AS (SELECT name, kind, parent, unnest(aliases) AS alias, unnest(range(len(aliases))) AS pos FROM gaz),
alias_ord AS (SELECT *, regexp_replace(alias, '[^a-z0-9]', '', 'g') AS sq, row_number() OVER (ORDER BY -length(alias), name, pos) - 1 AS ord FROM alias_rows)"""


def places_sql(name: str, source: str, key: str, column: str) -> str:
    """CTEs: one row per (key, place named) with its position, by longest alias."""
    return f"""
{name}_t AS (SELECT {key}, lower(coalesce({column}, '')) AS low, regexp_replace(lower(coalesce({column}, '')), '[^a-z0-9]', '', 'g') AS sqt FROM {source}),
{name}_near AS (SELECT {key}, low, a.*, length(alias) >= 5 AND contains(sqt, sq) AS loose FROM {name}_t JOIN alias_ord a ON contains(low, alias) OR (length(alias) >= 5 AND contains(sqt, sq))),
{name}_hit AS (SELECT *, CASE WHEN regexp_matches(low, '(?:^|[^a-z0-9])' || alias || '(?:[^a-z0-9]|$)')
      THEN length(regexp_extract(low, '(?s)^(|.*?[^a-z0-9])' || alias || '(?:[^a-z0-9]|$)', 1)) WHEN loose THEN 1000000 + ord END AS at_pos FROM {name}_near),
{name} AS (SELECT {key}, name, arg_min(kind, ord) AS kind, arg_min(parent, ord) AS parent, arg_min(at_pos, ord) AS at_pos, min(ord) AS ord FROM {name}_hit WHERE at_pos IS NOT NULL GROUP BY {key}, name)"""


@query("places_in_documents", b.with_sql(ALIASES, places_sql("pl", "documents", "doc_id", "text")) + """
SELECT d.doc_id, coalesce(string_agg(name, ',' ORDER BY at_pos, ord), '') AS places FROM documents d LEFT JOIN pl USING (doc_id) GROUP BY 1""")
def places_in_documents(spark, d):
    named = places.with_places(b.table(spark, d, "documents").select("doc_id", "text"), {"p": F.col("text")}, truth.alias_table(b.gazetteer(spark, d)))
    return named.select("doc_id", F.array_join(F.transform("p", lambda x: x["name"]), ",").alias("places"))


@query("place_closure", b.with_sql(b.GAZ) + "SELECT name, name AS ancestor, 0 AS depth FROM gaz UNION ALL SELECT name, parent, 1 FROM gaz WHERE parent IS NOT NULL")
def place_closure(spark, d):
    return truth.place_closure(b.gazetteer(spark, d))


KM = "2 * 6371.0 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))"


@query("nearest_city", b.with_sql(b.GAZ) + f""",
p AS (SELECT c_custkey AS id, (c_custkey % 140) - 70.0::DOUBLE AS lat1, (c_custkey * 7 % 360) - 180.0::DOUBLE AS lon1 FROM customer),
j AS (SELECT id, name, {KM.replace('lat2', 'g.lat').replace('lon2', 'g.lon')} AS km FROM p, gaz g WHERE kind = 'city')
SELECT id, arg_min(name, k || name) AS city, round(min(km), 3) AS km FROM (SELECT id, lpad(round(km, 6)::DECIMAL(18, 6)::VARCHAR, 18, '0') AS k, name, km FROM j WHERE km <= 1500) GROUP BY id""")
def nearest_city(spark, d):
    p = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 140) - 70.0).alias("lat"), ((F.col("c_custkey") * 7 % 360) - 180.0).alias("lon"))
    cities = truth.with_ancestors(b.gazetteer(spark, d)).where("kind = 'city'")
    return truth.nearest_city(p, cities, 1500.0).select("id", "city", F.round("km", 3).alias("km"))


def turns(spark, d):
    return b.table(spark, d, "conversations").select(F.col("conv_id").alias("script_id"), F.col("turn").alias("i"), "text")


@query("inherited_places", b.with_sql(ALIASES, "turns AS (SELECT conv_id * 1048576 + turn AS k, conv_id, turn, text FROM conversations)", places_sql("pl", "turns", "k", "text")) + """,
g AS (SELECT k, string_agg(name, ',' ORDER BY CASE kind WHEN 'city' THEN 0 WHEN 'region' THEN 1 WHEN 'country' THEN 2 ELSE 3 END, at_pos, ord) AS places FROM pl GROUP BY k),
t AS (SELECT conv_id AS script_id, turn AS i, places, last_value(places IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS carry FROM turns LEFT JOIN g USING (k))
SELECT script_id, i, coalesce(carry, '') AS places, places IS NULL AND carry IS NOT NULL AS inherited FROM t""")
def inherited_places(spark, d):
    a = truth.alias_table(b.gazetteer(spark, d))
    c = truth.inherit_places(truth.extract_claims(turns(spark, d), a))
    return c.select("script_id", "i", F.array_join(F.transform("places", lambda p: p["name"]), ",").alias("places"), F.col("place_inherited").alias("inherited"))


NARRATION = """'In ' || year(o_orderdate) || ' the ' || ['flooded roads', 'sunny beach', 'misty hills', 'snowy peak', 'quiet town', 'brain foggy'][o_orderkey % 6 + 1] ||
   CASE o_orderkey % 3 WHEN 0 THEN ' was seen today' WHEN 1 THEN ' was calm' ELSE ' is in the latest report' END"""


@query("line_claims", rf"""
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN {NARRATION} ELSE substr({NARRATION}, 9) END AS t FROM orders),
x AS (SELECT o_orderkey, t, regexp_extract(t, '(?:^|\s)In ((?:19|20)\d\d)', 1) AS y, regexp_extract(lower(t), '(today|latest)', 1) AS r FROM n)
SELECT o_orderkey, CASE WHEN y <> '' THEN 'year' WHEN r <> '' THEN 'recent' END AS time_kind, CASE WHEN y <> '' THEN y::INTEGER END AS year, coalesce(nullif(y, ''), nullif(r, '')) AS time_phrase,
  CASE o_orderkey % 6 WHEN 0 THEN 'rain' WHEN 1 THEN 'sunny' WHEN 2 THEN 'fog' WHEN 3 THEN 'snow' WHEN 5 THEN 'fog' END AS weather FROM x""")
def line_claims(spark, d):
    o = b.table(spark, d, "orders")
    k = F.col("o_orderkey")
    line = F.concat(F.lit("In "), F.year("o_orderdate").cast("string"), F.lit(" the "), b.pick(["flooded roads", "sunny beach", "misty hills", "snowy peak", "quiet town", "brain foggy"], k),
                    F.when(k % 3 == 0, " was seen today").when(k % 3 == 1, " was calm").otherwise(" is in the latest report"))
    line = F.when(k % 4 == 0, line).otherwise(F.substring(line, 9, 1000))
    a = truth.alias_table(b.gazetteer(spark, d))
    c = truth.extract_claims(o.select("o_orderkey", line.alias("text")), a)
    return c.select("o_orderkey", "time_kind", "year", "time_phrase", F.col("claim_weather").alias("weather"))


# ------------------------------------------------------------------------------------------ verdicts at size
def claim_pairs(spark, d):
    """Line items as (narration line, shot) pairs: the order claims a place, a time and weather, the item is the evidence."""
    t = lambda n: b.table(spark, d, n)
    nat = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    P = lambda name, kind, anc: F.struct(name.alias("name"), F.lit(None).cast("string").alias("alias"), F.lit(kind).alias("kind"), anc.alias("anc"))
    nation, region = P(F.col("n_name"), "city", F.array("n_name", "r_name")), P(F.col("r_name"), "country", F.array("r_name"))
    # only keys and days are shuffled; places, claims and evidence are looked up and made where the joined rows are
    places_of = lambda x: F.broadcast(nat.select(F.col("n_nationkey").alias(f"{x}_nationkey"), nation.alias(f"{x}_nation"), region.alias(f"{x}_region")))
    orders = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_nationkey")
    items = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    d = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(places_of("c"), "c_nationkey").join(places_of("s"), "s_nationkey")
    k = F.col("o_orderkey")
    claim = [
        "o_orderkey", F.when(k % 4 == 3, F.array().cast(f"array<{truth.PLACE}>")).when(k % 3 == 0, F.array("c_region")).otherwise(F.array("c_nation")).alias("places"),
        (k % 7 == 0).alias("place_inherited"), F.when(k % 3 == 1, "year").when(k % 3 == 2, "recent").alias("time_kind"),
        F.when(k % 3 == 1, F.year("o_orderdate")).alias("year"), F.when(k % 3 == 1, F.year("o_orderdate").cast("string")).when(k % 3 == 2, "today").alias("time_phrase"),
        F.when(k % 5 < 4, b.pick(b.WEATHER[:4], k % 5)).alias("claim_weather"), F.when(k % 5 < 4, "heavy weather").alias("weather_phrase")]
    E = lambda p: F.struct(p["name"].alias("name"), F.lit("meta").alias("src"), F.lit("title/tags").alias("text"), p["kind"].alias("kind"), p["anc"].alias("anc"))
    ln, pk = F.col("l_linenumber"), F.col("l_partkey")
    return d.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(ln % 4 == 0, F.array().cast(f"array<{truth.EVIDENCE}>")).when(ln % 4 == 1, F.array(E(F.col("s_region"))))
        .otherwise(F.array(E(F.col("s_nation")))).alias("evidence"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("shot_date"),
        b.pick(["meta", "recorded", "upload", "unknown"], pk).alias("date_source"), b.pick(b.WEATHER, pk).alias("weather"), ((pk % 50) / 50.0).alias("weather_conf"),
        b.pick(["own", "pixabay"], F.col("l_suppkey")).alias("source"), *claim)


PAIRS = f"""
pairs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderkey AS k, cn.n_name AS cnat, cr.r_name AS creg, sn.n_name AS snat, sr.r_name AS sreg,
   year(o_orderdate) AS oy, l_shipdate::DATE AS ship, {b.sql_pick(b.WEATHER, 'l_partkey')} AS seen, (l_partkey % 50) / 50.0::DOUBLE AS conf,
   CASE o_orderkey % 5 WHEN 0 THEN 'rain' WHEN 1 THEN 'sunny' WHEN 2 THEN 'fog' WHEN 3 THEN 'snow' END AS cw, l_partkey % 4 AS ds, l_linenumber % 4 AS ev
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
   JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey),
place AS (SELECT *, CASE WHEN k % 4 = 3 THEN NULL WHEN ev = 0 THEN 'unverified'
    WHEN k % 3 = 0 THEN CASE WHEN sreg = creg THEN 'ok' ELSE 'bad' END
    WHEN ev = 1 THEN CASE WHEN sreg = creg THEN 'unverified' ELSE 'bad' END
    WHEN snat = cnat THEN 'ok' ELSE 'bad' END AS p FROM pairs),
times AS (SELECT *, CASE k % 3 WHEN 1 THEN CASE WHEN ds IN (0, 1) THEN CASE WHEN year(ship) = oy THEN 'ok' ELSE 'bad' END WHEN ds = 2 AND oy > year(ship) THEN 'bad' ELSE 'unverified' END
   WHEN 2 THEN CASE WHEN ds IN (0, 1) THEN CASE WHEN ship < DATE '{TODAY}' - 45 THEN 'warn' ELSE 'ok' END WHEN ds = 2 AND ship < DATE '{TODAY}' - 45 THEN 'warn' ELSE 'unverified' END END AS t FROM place),
weathers AS (SELECT *, CASE WHEN cw IS NULL THEN NULL WHEN seen IN ('night', 'cloudy') THEN 'unverified'
   WHEN (cw || seen) IN ('rainsunny', 'sunnyrain', 'sunnysnow', 'snowsunny', 'fogsunny', 'sunnyfog') THEN CASE WHEN conf >= 0.97 THEN 'bad' WHEN conf >= 0.8 THEN 'warn' ELSE 'unverified' END
   WHEN cw = seen AND conf >= 0.6 THEN 'ok' ELSE 'unverified' END AS w FROM times),
stocks AS (SELECT *, CASE WHEN l_suppkey % 2 = 1 AND k % 7 <> 0 AND p = 'unverified' THEN 'warn' END AS s FROM weathers),
judged AS (SELECT *, CASE WHEN 'bad' IN (coalesce(p, ''), coalesce(t, ''), coalesce(w, '')) THEN 'bad' WHEN 'warn' IN (coalesce(t, ''), coalesce(w, ''), coalesce(s, '')) THEN 'warn'
     WHEN 'ok' IN (coalesce(p, ''), coalesce(t, ''), coalesce(w, '')) THEN 'ok' ELSE 'unverified' END AS status,
   CASE WHEN t = 'warn' THEN 'FILE · ' || year(ship) WHEN s IS NOT NULL THEN 'STOCK · not event footage' END AS label,
   round(least((CASE WHEN p = 'ok' THEN 0.03 ELSE 0 END + CASE WHEN t = 'ok' THEN CASE WHEN k % 3 = 1 THEN 0.03 ELSE 0.01 END ELSE 0 END + CASE WHEN w = 'ok' THEN 0.01 ELSE 0 END)::DOUBLE, 0.05::DOUBLE)
     - 0.01::DOUBLE * ((coalesce(t, '') = 'warn')::INT + (coalesce(w, '') = 'warn')::INT + (s IS NOT NULL)::INT), 4) AS delta FROM stocks)"""


@query("claim_verdicts", b.with_sql(PAIRS) + """SELECT l_orderkey, l_linenumber, l_partkey, status, label, delta,
  concat_ws(',', p, t, w, s) AS checks FROM judged""")
def claim_verdicts(spark, d):
    v = truth.verdict(claim_pairs(spark, d), TODAY)
    return v.select("l_orderkey", "l_linenumber", "l_partkey", "status", "label", F.round("delta", 4).alias("delta"), F.concat_ws(",", *[F.col("found")[n] for n in truth.CHECKS]).alias("checks"))


@query("verdict_evidence", b.with_sql(PAIRS) + """SELECT status, count(*) AS n, count(DISTINCT cnat) AS claims, round(sum(delta), 2) AS delta FROM judged GROUP BY 1""")
def verdict_evidence(spark, d):
    v = truth.verdict(claim_pairs(spark, d), TODAY)
    nat = b.table(spark, d, "orders").join(b.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ok"), "c_nationkey")
    return v.join(nat, F.col("l_orderkey") == F.col("ok")).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("claims"), F.round(F.sum("delta"), 2).alias("delta"))


@query("truth_filtered_candidates", b.with_sql(PAIRS) + "SELECT l_orderkey, l_linenumber, l_partkey, round(0.3 + delta, 4) AS score FROM judged WHERE status <> 'bad'")
def truth_filtered_candidates(spark, d):
    kept, _ = truth.truth_filter(truth.verdict(claim_pairs(spark, d).withColumn("score", F.lit(0.3)), TODAY))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", F.round("score", 4).alias("score"))


@query("contradictions_per_order", b.with_sql(PAIRS) + "SELECT l_orderkey, count(*) AS clips, count(*) FILTER (status = 'bad') AS contradictions FROM judged GROUP BY 1")
def contradictions_per_order(spark, d):
    return truth.contradictions(truth.verdict(claim_pairs(spark, d), TODAY), "l_orderkey")


@query("place_checks", b.with_sql(PAIRS) + "SELECT l_orderkey, l_linenumber, l_partkey, p AS status, CASE WHEN p = 'bad' THEN CASE WHEN ev = 1 THEN sreg ELSE snat END END AS shown FROM place")
def place_checks(spark, d):
    c = truth.check_place()
    return claim_pairs(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", c.status.alias("status"), F.when(c.status == "bad", F.regexp_extract(c.note, r"picture: (.+?), by ", 1)).alias("shown"))


@query("time_checks", b.with_sql(PAIRS) + "SELECT l_orderkey, l_linenumber, l_partkey, t AS status, CASE WHEN t = 'warn' THEN 'FILE · ' || year(ship) END AS label FROM times")
def time_checks(spark, d):
    c = truth.check_time(F.to_date(F.lit(TODAY)))
    return claim_pairs(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", c.status.alias("status"), c.label.alias("label"))


@query("weather_checks", b.with_sql(PAIRS) + "SELECT l_orderkey, l_linenumber, l_partkey, w AS status FROM weathers")
def weather_checks(spark, d):
    return claim_pairs(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", truth.check_weather().status.alias("status"))


@query("stock_as_news_checks", b.with_sql(PAIRS) + "SELECT l_orderkey, l_linenumber, l_partkey, s IS NOT NULL AS flagged FROM stocks")
def stock_as_news_checks(spark, d):
    return claim_pairs(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", truth.check_stock(truth.check_place()).status.isNotNull().alias("flagged"))


def document_facts(spark, d):
    """Documents as shots: source text as title, first part of the text as signboard text, a position on the globe."""
    k = F.col("doc_id")
    return b.table(spark, d, "documents").select(k.alias("shot_id"), ((k % 140) - 70.0).alias("gps_lat"), ((k * 7 % 360) - 180.0).alias("gps_lon"),
                                                 F.col("text").alias("ocr_text"), F.col("source").alias("title"), F.col("lang").alias("tags"))


EVIDENCE_SQL = b.with_sql(ALIASES, "facts AS (SELECT doc_id, text, source || ', ' || lang AS meta, (doc_id % 140) - 70.0::DOUBLE AS lat1, (doc_id * 7 % 360) - 180.0::DOUBLE AS lon1 FROM documents)",
                                    places_sql("ocr", "facts", "doc_id", "text"), places_sql("mt", "facts", "doc_id", "meta")) + f""",
km AS (SELECT doc_id, name, {KM.replace('lat2', 'g.lat').replace('lon2', 'g.lon')} AS km FROM facts, gaz g WHERE kind = 'city'),
gps AS (SELECT doc_id, arg_min(name, lpad(round(km, 6)::DECIMAL(18, 6)::VARCHAR, 18, '0') || name) AS name FROM km WHERE km <= 60 GROUP BY 1),
every AS (SELECT doc_id, 'gps:' || name AS e, 0 AS r, 0 AS at_pos, 0 AS ord FROM gps UNION ALL SELECT doc_id, 'ocr:' || name, 1, at_pos, ord FROM ocr UNION ALL SELECT doc_id, 'meta:' || name, 2, at_pos, ord FROM mt)"""


@query("place_evidence", EVIDENCE_SQL + """
SELECT f.doc_id AS shot_id, coalesce(string_agg(e, ',' ORDER BY r, at_pos, ord), '') AS evidence FROM facts f LEFT JOIN every USING (doc_id) GROUP BY 1""")
def place_evidence(spark, d):
    g = b.gazetteer(spark, d)
    cities = truth.with_ancestors(g).where("kind = 'city'")
    e = truth.place_evidence(document_facts(spark, d), truth.alias_table(g), cities)
    return e.select("shot_id", F.array_join(F.transform("evidence", lambda x: F.concat(x["src"], F.lit(":"), x["name"])), ",").alias("evidence"))


@query("provenance_cards", EVIDENCE_SQL + """
SELECT f.doc_id AS shot_id, coalesce(string_agg(e, ',' ORDER BY r, at_pos, ord), '') AS places, CASE WHEN f.doc_id % 3 > 0 THEN '2019-0' || (1 + f.doc_id % 9) ELSE '' END AS date,
  CASE WHEN f.doc_id % 3 > 0 THEN 'meta' ELSE 'unknown' END AS date_source, d.source FROM facts f JOIN documents d USING (doc_id) LEFT JOIN every USING (doc_id) GROUP BY 1, 3, 4, 5""")
def provenance_cards(spark, d):
    """Documents as shots; every third has no date."""
    g = b.gazetteer(spark, d)
    known = document_facts(spark, d)
    k = F.col("shot_id")
    source = b.table(spark, d, "documents").select(F.col("doc_id").alias("shot_id"), "source")
    dim = known.select("shot_id", "title", "tags").join(source, "shot_id").withColumns({"weather": b.pick(b.WEATHER, k), "weather_conf": (k % 50) / 50.0})
    dated = k % 3 > 0
    prov = known.select("shot_id", "ocr_text", "gps_lat", "gps_lon", F.when(dated, F.concat(F.lit("2019-0"), (1 + k % 9).cast("string"))).alias("shot_date"), F.when(dated, "meta").alias("date_source"))
    cards = truth.provenance_cards(dim.select("shot_id"), dim, prov, truth.alias_table(g), truth.with_ancestors(g).where("kind = 'city'"))
    return cards.select("shot_id", F.array_join(F.transform("places", lambda x: F.concat(x["by"], F.lit(":"), x["place"])), ",").alias("places"), "date", "date_source", "source")


@query("wrong_place_clips", b.with_sql(ALIASES, "turns AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS k, conv_id, turn, text FROM conversations)", places_sql("pl", "turns", "k", "text")) + """,
p AS (SELECT turns.*, name, parent, at_pos, ord FROM pl JOIN turns USING (k)),
v AS (SELECT conv_id, list(DISTINCT name) AS names, list_concat(list(name), list(parent) FILTER (parent IS NOT NULL)) AS near FROM p GROUP BY 1),
c AS (SELECT k, arg_min(name, at_pos::HUGEINT * 100000 + ord) AS first_name, list(name) AS names, list_concat(list(name), list(parent) FILTER (parent IS NOT NULL)) AS near FROM p GROUP BY 1)
SELECT t.conv_id + 1 AS conv_id, t.turn, CASE WHEN v.names IS NOT NULL AND c.names IS NOT NULL AND NOT list_has_any(c.near, v.names) AND NOT list_has_any(v.near, c.names) THEN c.first_name END AS wrong_place
FROM turns t LEFT JOIN v ON v.conv_id = t.conv_id + 1 LEFT JOIN c ON c.k = t.k""")
def wrong_place_clips(spark, d):
    """The turns of one conversation as clips for the next one, against the places of all its turns."""
    a = truth.alias_table(b.gazetteer(spark, d))
    t = b.table(spark, d, "conversations").select("conv_id", "turn", "text")
    clips = places.with_places(t, {"clip_places": F.col("text")}, a).select((F.col("conv_id") + 1).alias("conv_id"), "turn", "clip_places")
    return truth.wrong_place_pairs(clips, truth.video_places(t, a, "conv_id", "turn"), "conv_id").select("conv_id", "turn", "wrong_place")
