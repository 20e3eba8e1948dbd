"""Scoring transcript lines and writing queries for them."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, text
from ..functions.arrays import first_by
from .windows import ordered_distinct, topk

LINES_JSON = ("struct<lines:array<struct<id:string,importance:string,visual:string,role:string,reason:string,query:string,"
              "alt_queries:array<string>,anchor:string>>>")


def offline_importance(units: DataFrame) -> DataFrame:
    """units(video_id, id, text, places array, visual): importance and role from places, numbers, proper nouns and content."""
    u = units.where("trim(text) <> ''")
    c = F.col("text")
    number = c.rlike(rf"(?iU)\d|\b(?:{fixed.NUMBER_WORD})\b")
    speaker = c.rlike(rf"(?iU)\b(?:{fixed.SPEAKER_PHRASE})\b")
    kw = text.keywords(c, 12)
    content = F.when(kw == "", 0).otherwise(F.size(F.split(kw, " ")))
    proper = F.size(F.regexp_extract_all(c, F.lit(r"(?U)(?<!^)(?<![.!?] )\b([A-Z][a-z]{2,})"), F.lit(1)))
    placed = F.size("places") > 0
    imp = (F.lit(0.3) + F.when(placed, 0.25).otherwise(0.0) + F.when(number, 0.12).otherwise(0.0) + 0.08 * F.least(proper, F.lit(2))
           + 0.03 * F.least(content, F.lit(6)) - F.when(speaker, 0.35).otherwise(0.0))
    # position from both ends decides between greeting, call to action and aside
    late = topk(u.select("video_id", "id"), 2, "video_id", [F.desc("id")]).groupBy("video_id").agg(F.min("id").alias("__late"))
    ends = u.groupBy("video_id").agg(F.min("id").alias("__first")).join(late, "video_id")
    d = u.join(ends, "video_id")
    role = (F.when(speaker & (F.col("id") >= F.col("__late")), "cta").when(speaker & (F.col("id") == F.col("__first")), "hook")
            .when(speaker, "aside").when(placed, "place").when(number, "data").otherwise("key point"))
    why = F.create_map(*[F.lit(x) for x in ("place", "names a place", "data", "has a number", "key point", "content line",
                                           "cta", "call to action", "hook", "greeting", "aside", "aside")])
    return d.withColumns({"importance": F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), imp)), 2), "role": role}) \
        .withColumn("reason", why[F.col("role")]).drop("__first", "__late")


def parse_lines(answers: DataFrame, units: DataFrame) -> DataFrame:
    """answers(video_id, body JSON): validated line scores. Unknown or repeated ids go, numbers are clamped, roles checked."""
    x = answers.select("video_id", F.posexplode(F.from_json("body", LINES_JSON)["lines"]).alias("pos", "x"))
    num = lambda c: F.least(F.greatest(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    x = x.withColumn("id", F.col("x.id").try_cast("long")).where("id IS NOT NULL")
    x = x.join(units.where("kind = 'speech'").select("video_id", "id"), ["video_id", "id"], "left_semi")
    x = x.groupBy("video_id", "id").agg(F.min_by("x", "pos").alias("x"))
    vis = num(F.col("x.visual"))
    q = F.when(vis >= fixed.VISUAL_MIN, text.clean_query(F.col("x.query"))).otherwise(F.lit(""))
    alts = F.when(q != "", F.filter(F.transform(F.slice(F.coalesce("x.alt_queries", F.array().cast("array<string>")), 1, 2), text.clean_query),
                                    lambda v: (v != "") & (v != q))).otherwise(F.array().cast("array<string>"))
    role = F.lower(F.trim(F.coalesce("x.role", F.lit(""))))
    return x.select("video_id", "id", F.bround(num(F.col("x.importance")), 2).alias("importance"), F.bround(vis, 2).alias("visual"),
                    F.when(role.isin(*fixed.LINE_ROLES), role).otherwise("key point").alias("role"),
                    F.substring(F.coalesce("x.reason", F.lit("")), 1, 80).alias("reason"), q.alias("query"), alts.alias("alt_queries"),
                    F.substring(F.coalesce("x.anchor", F.lit("")), 1, 40).alias("anchor"))


def offline_queries(lines: DataFrame, floor: float = fixed.FILMABLE_MIN) -> DataFrame:
    """lines(.., text, visual, places, concept1, concept2): main query and at most two alternatives; none for talk."""
    kw = text.keywords(F.col("text"))
    place = F.get(F.filter("places", lambda p: p["kind"].isin("city", "region")), F.lit(0))["name"]
    alts = F.array_distinct(F.array_compact(F.array(
        F.concat_ws(" ", place, F.when(place.isNotNull(), F.col("concept1"))), F.when(F.size(F.split(kw, " ")) >= 2, kw), F.col("concept2"))))
    alts = F.slice(F.filter(alts, lambda q: (q != "") & (q != F.col("concept1"))), 1, 2)
    ok = F.col("visual") >= floor
    return lines.withColumns({"query": F.when(ok, F.col("concept1")).otherwise(F.lit("")),
                              "alt_queries": F.when(ok, alts).otherwise(F.array().cast("array<string>"))})


def topic_words(places: Column, summary: Column, n: int = 5, kw: int = 8) -> Column:
    """Up to three place names and the summary's telling words, case-insensitively distinct, joined by blanks."""
    words = F.filter(F.split(text.keywords(summary, kw), " "), lambda w: (w != "") & ~F.array_contains(F.lit(fixed.TOPIC_FILLER), w))
    every = F.concat(F.slice(F.coalesce(places, F.array().cast("array<string>")), 1, 3), words)
    return F.array_join(F.slice(first_by(every, F.lower), 1, n), " ")


def grounded_queries(lines: DataFrame, n: int = 5) -> DataFrame:
    """lines(line_id, text, query, alt_queries, topic): each query plain and pinned to the topic, distinct, at most n."""
    base = F.filter(F.concat(F.array("query"), F.coalesce("alt_queries", F.array().cast("array<string>")), F.array("text")),
                    lambda q: F.trim(F.coalesce(q, F.lit(""))) != "")
    d = lines.select("line_id", "topic", F.posexplode(base).alias("p", "q"))
    kw = text.keywords(F.col("q"), 4)
    pinned = F.when(F.col("topic") != "", F.concat_ws(" ", F.when(kw != "", kw).otherwise(F.col("q")), "topic"))
    d = d.select("line_id", F.col("p"), F.posexplode(F.array(F.col("q"), pinned)).alias("k", "q")).where("q IS NOT NULL")
    return ordered_distinct(d.select("line_id", (F.col("p") * 2 + F.col("k")).alias("pos"), "q"), n, width=140)


def project_queries(slots: DataFrame) -> DataFrame:
    """slots(video_id, start, query, alt_queries): all main queries first, then up to two alternatives each."""
    main = slots.where("query <> ''").select("video_id", F.lit(0).alias("kind"), "start", F.lit(0).alias("k"), F.col("query").alias("q"))
    alt = slots.select("video_id", F.lit(1).alias("kind"), "start", F.posexplode(F.slice("alt_queries", 1, 2)).alias("k", "q")).where("q <> ''")
    w = W.partitionBy("video_id").orderBy("kind", "start", "k", "q")
    return main.unionByName(alt).withColumn("place", F.row_number().over(w)).withColumn("is_main", F.col("kind") == 0).drop("kind", "k")


def why_lines(plan: DataFrame) -> DataFrame:
    """One short reason per pick: relevance, truth, label, cut, licence, memory."""
    flags = F.col("flags")
    cut = (F.when(flags.isNull(), F.lit(None)).when(F.array_contains(flags, "progress"), "size progression")
           .when(F.size(flags) == 0, "clean cut").otherwise(F.concat(F.lit("cuts: "), F.array_join(flags, ", "))))
    labels = F.create_map(*[x for k, v in fixed.LICENCE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    mem = (F.when(F.col("hits") > 0, F.concat(F.lit("chosen "), F.col("hits").cast("string"), F.lit("x in your past edits")))
           .when(F.col("bonus") > 0, "matches your style").when(F.col("bonus") < 0, "you passed on similar shots"))
    why = F.array_compact(F.array(
        F.concat(F.lit("relevance "), F.format_string("%.2f", "rel")),
        F.when(F.col("status").isin("ok", "warn"), F.get("evidence_lines", F.lit(0))),
        F.when(F.col("label").isNotNull(), F.concat(F.lit("auto label: "), F.col("label"))), cut,
        F.when(F.col("licence_class").isin("attribution", "caution", "restricted", "unknown"),
               F.concat(F.lit("licence: "), labels[F.col("licence_class")])), mem))
    return plan.withColumn("why", why)
