"""Ranking, capping, interleaving and interval repair."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, text
from .ordered import neighbour, numbered, rank_in_key, running, running_total
from .ranges import interval_pairs, nearest


def topk(df: DataFrame, k: int, by, order) -> DataFrame:
    """Top k per key; Catalyst thins each map task to k rows before the shuffle."""
    w = W.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cap_per_source(cands: DataFrame, cap: int) -> DataFrame:
    """At most `cap` rows per query and source, best first. Expects the bounded candidate list of a query."""
    w = W.partitionBy("query_id", "source_key").orderBy(F.desc("score"), "shot_id")
    return cands.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")


def split_beats(scripts: DataFrame, wpm: float = 150, min_s: float = 2.0) -> DataFrame:
    """scripts(script_id, text) -> beats(script_id, i, text, dur): sentences, short ones joined to the beat before.

    One script is one row, so the grouping is done on its sentence array without a shuffle.
    """
    secs = lambda s: text.speech_seconds(s, wpm)

    def step(acc, s):
        d = secs(s)
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1),
                          F.array(F.struct(F.concat(last["text"], F.lit(" "), s).alias("text"), (last["dur"] + d).alias("dur"))))
        return F.when((F.size(acc) > 0) & (d < min_s), joined).otherwise(
            F.concat(acc, F.array(F.struct(s.alias("text"), d.alias("dur")))))

    empty = F.array().cast("array<struct<text:string,dur:double>>")
    return (scripts.select("script_id", F.posexplode(F.aggregate(text.sentences(F.col("text")), empty, step)).alias("i", "b"))
            .select("script_id", "i", F.col("b.text").alias("text"), F.bround(F.greatest("b.dur", F.lit(min_s)), 2).alias("dur")))


def split_beats_grouped(scripts: DataFrame, wpm: float = 150, min_s: float = 2.0) -> DataFrame:
    """The same beats by a running group number over exploded sentences; faster for very long scripts."""
    s = scripts.select("script_id", F.posexplode(text.sentences(F.col("text"))).alias("p", "s"))
    s = s.withColumn("d", text.speech_seconds(F.col("s"), wpm))
    starts = F.when((F.col("d") >= min_s) | (F.col("p") == 0), 1).otherwise(0)
    g = running(s, "script_id", F.floor(F.col("p") / 4096), ["p"], g=("sum", starts))
    b = g.groupBy("script_id", "g").agg(F.array_sort(F.collect_list(F.struct("p", "s"))).alias("x"), F.sum("d").alias("d"))
    return b.select("script_id", (F.col("g") - 1).cast("int").alias("i"), F.array_join(F.transform("x", lambda e: e["s"]), " ").alias("text"),
                    F.bround(F.greatest("d", F.lit(min_s)), 2).alias("dur"))


def fit_to_target(beats: DataFrame, target_s: float, min_s: float = 1.5, per_line: float = 2.5, stretch: float = 1.6) -> DataFrame:
    """Condense each script to about target_s: first, last and evenly spaced lines, then scale durations."""
    tot = beats.groupBy("script_id").agg(F.sum("dur").alias("total"), F.count("*").alias("n"))
    k = F.greatest(F.lit(2), F.least(F.col("n"), F.lit(int(target_s // per_line))))
    tot = tot.withColumn("k", F.when((F.col("total") > target_s * 1.05) & (k < F.col("n")), k).otherwise(F.col("n")).cast("int"))
    idx = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.rint(j * (F.col("n") - 1) / (F.col("k") - 1)).cast("int"))
    keep = tot.select("script_id", F.explode(F.array_distinct(F.when(F.col("k") > 1, idx).otherwise(F.array(F.lit(0))))).alias("i"))
    b = beats.join(keep, ["script_id", "i"])
    base = b.groupBy("script_id").agg(F.sum("dur").alias("base"))
    b = b.join(base, "script_id").withColumn("scale", F.least(F.lit(target_s) / F.col("base"), F.lit(stretch)))
    r = rank_in_key(b, "script_id", F.floor(F.col("i") / 4096), ["i"], "new_i")
    return r.select("script_id", (F.col("new_i") - 1).cast("int").alias("i"), "text",
                    F.bround(F.greatest(F.lit(min_s), F.col("dur") * F.col("scale")), 2).alias("dur"))


def running_timeline(clips: DataFrame, by: str, dur: str, order: str = "i", once: bool = False) -> DataFrame:
    """Record in and out of clips laid end to end. `once`: clips are costly and worked out once, their columns written to the shared folder."""
    chunk = F.floor(F.col(order) / 4096)
    r = running_total(clips, by, chunk, [order], "rec_out", F.col(dur)) if once else running(clips, by, chunk, [order], rec_out=("sum", F.col(dur)))
    return r.withColumn("rec_in", F.col("rec_out") - F.col(dur))


def consecutive(plan: DataFrame, by: str, order: str, cols) -> DataFrame:
    """Each row with the values of the next row as b_<col>; the last row of a key is dropped."""
    d = neighbour(plan, by, F.floor(F.col(order) / 4096), [order], {f"b_{c}": F.col(c) for c in cols})
    return d.where(F.col(f"b_{cols[0]}").isNotNull())


def pauses(segments: DataFrame, durations: DataFrame, min_s: float = 0.4) -> DataFrame:
    """Gaps of at least min_s before, between and after the segments of a video."""
    d = neighbour(segments, "video_id", F.floor(F.col("start") / 3600), ["start"], {"next_start": F.col("start")})
    inner = d.where(F.col("next_start") - F.col("end") >= min_s).select("video_id", F.col("end").alias("start"), F.col("next_start").alias("end"))
    edge = segments.groupBy("video_id").agg(F.min("start").alias("first"), F.max_by("end", "start").alias("last"))
    lead_in = edge.where(F.col("first") >= min_s).select("video_id", F.lit(0.0).alias("start"), F.col("first").alias("end"))
    tail = edge.join(durations, "video_id").where(F.col("duration") - F.col("last") >= min_s).select(
        "video_id", F.col("last").alias("start"), F.col("duration").alias("end"))
    return inner.unionByName(lead_in).unionByName(tail)


def interleave_sources(cands: DataFrame, k: int | None = None, by: str = "query_id") -> DataFrame:
    """Best clip of each source first, sources ordered by their best score; rank over the whole key."""
    r = numbered(cands, [by, "source"], [F.desc("score"), "shot_id"], "turn")
    best = cands.groupBy(by, "source").agg(F.max("score").alias("best"))
    r = r.join(best, [by, "source"])
    if k:
        r = r.where(F.col("turn") <= k)                      # a place within k needs a turn within k
    # places taken: everything with an earlier turn, then better sources of the same turn
    out = numbered(r, by, ["turn", F.desc("best"), "source"], "place")
    return out.where(F.col("place") <= k) if k else out


def round_robin_pick(ranked: DataFrame, n: int) -> DataFrame:
    """ranked(query_i, k, source_id): one clip of each query in turn, an id counts at its first place, n in all."""
    first = ranked.groupBy("source_id").agg(F.min(F.struct("k", "query_i")).alias("o"))
    return first.select("source_id", "o.k", "o.query_i").orderBy("k", "query_i", "source_id").limit(n)


def task_order(tasks: DataFrame) -> DataFrame:
    """tasks(source, source_pos, query_pos, page): page by page within a source, sources interleaved."""
    r = rank_in_key(tasks, "source", F.col("page"), ["page", "query_pos"], "turn")
    return numbered(r, [], ["turn", "source_pos"], "place")


def per_query_pick(items: DataFrame, cap_main: int = 18, cap_alt: int = 8, min_n: int = 5) -> DataFrame:
    """items(query_i, is_main, source_id, pos, overlap): matching clips up to the cap, topped up when too few; first query owns.

    Only the best max(cap, min_n) rows of a query can be picked, so the list is thinned before ranking globally.
    """
    cap = F.when(F.col("is_main"), cap_main).otherwise(cap_alt)
    best = topk(items, max(cap_main, cap_alt, min_n), "query_i", [F.desc("overlap"), "pos"])
    hits = F.least(F.count_if(F.col("overlap") > 0).over(W.partitionBy("query_i")), cap)
    best = best.withColumn("__hits", hits)
    kept = best.where(F.col("rank") <= F.when(F.col("__hits") < min_n, F.lit(min_n)).otherwise(F.col("__hits")))
    owner = kept.groupBy("source_id").agg(F.min("query_i").alias("query_i"))
    return kept.join(owner, ["source_id", "query_i"], "left_semi").drop("__hits")


def repair_overlaps(slots: DataFrame, gap: float = 0.05, min_s: float = 0.5) -> DataFrame:
    """End each slot before the next one starts; drop slivers."""
    s = slots.where(F.col("end") - F.col("start") >= min_s)
    d = neighbour(s, "video_id", F.floor(F.col("start") / 3600), ["start", "slot_id"], {"__next": F.col("start")})
    cut = (F.col("__next") < F.col("end") + gap)
    d = d.withColumn("end", F.when(cut, F.bround(F.col("__next") - gap, 2)).otherwise(F.col("end"))).drop("__next")
    return d.where(~F.coalesce(F.col("end") - F.col("start") < min_s, F.lit(False)))


def global_budget(items: DataFrame, max_items: int, caps: dict) -> DataFrame:
    """items(pos, source, id) in arrival order: at most caps[source] per source, then at most max_items in all."""
    cap = F.lit(None).cast("long")
    for s, n in caps.items():
        cap = F.when(F.col("source") == s, F.lit(n).cast("long")).otherwise(cap)
    r = rank_in_key(items, "source", F.floor(F.col("pos") / 4096), ["pos"], "in_source")
    r = numbered(r.where(cap.isNull() | (F.col("in_source") <= cap)), [], ["pos"], "in_all")
    return r.where(F.col("in_all") <= max_items)


def free_slot(drops: DataFrame, slots: DataFrame, durations: DataFrame, want: float = 3.0, gap: float = 0.1, min_s: float = 0.8) -> DataFrame:
    """drops(video_id, drop_id, t): the free stretch after a drop; none when it lands inside a slot or has no room."""
    d = drops.join(durations, "video_id")
    d = d.withColumn("t", F.greatest(F.lit(0.0), F.least(F.col("t"), F.greatest(F.col("duration") - min_s, F.lit(0.0)))))
    s = slots.select("video_id", F.col("start").alias("s0"), F.col("end").alias("s1")).where("s1 > s0")
    inside = interval_pairs(d, s, "video_id", "t", "t", "s0", "s1", 10.0).where("t < s1").select("video_id", "drop_id").distinct()
    d = d.join(inside, ["video_id", "drop_id"], "left_anti")
    # next slot start after t: fill backward along one time line
    u = d.select("video_id", "t", F.lit(1).alias("side"), F.struct("drop_id", "duration").alias("row"), F.lit(None).cast("double").alias("s0")) \
        .unionByName(s.select("video_id", F.col("s0").alias("t"), F.lit(0).alias("side"),
                              F.lit(None).cast("struct<drop_id:bigint,duration:double>").alias("row"), "s0"))
    u = u.withColumn("nt", -F.col("t"))
    f = running(u, "video_id", F.floor(F.col("nt") / 3600), ["nt", F.col("side").desc()], nxt=("last", F.col("s0"))).where("side = 1")
    end = F.least(F.col("t") + want, F.col("row.duration"), F.coalesce(F.col("nxt") - gap, F.col("row.duration")))
    return f.select("video_id", F.col("row.drop_id").alias("drop_id"), F.bround("t", 2).alias("start"), F.bround(end, 2).alias("end"), (end - F.col("t")).alias("__room")) \
        .where(F.col("__room") >= min_s).drop("__room")


def snap_to_word(drops: DataFrame, words: DataFrame, max_dt: float = 0.35) -> DataFrame:
    """Move a drop to the nearest word start within max_dt."""
    n = nearest(drops, words.select("video_id", F.col("s").alias("ws"), F.col("s").alias("wv")), "video_id", "t", "ws", "wv", max_dt)
    return n.withColumns({"snapped": F.col("near_t").isNotNull(), "t": F.coalesce("near_t", "t")}).drop("near_t", "near_value")


def best_per_video(cands: DataFrame, k: int | None = None, by: str = "line_id") -> DataFrame:
    """Several result lists of one line: best score per shot, then the best shot of each source, best first."""
    best = cands.groupBy(by, "shot_id").agg(F.max_by(F.struct("source_key", "source", "score"), "score").alias("r")).select(by, "shot_id", "r.*")
    one = best.groupBy(by, "source_key").agg(F.max_by(F.struct("shot_id", "source", "score"), F.struct("score", -F.col("shot_id"))).alias("r"))
    out = one.select(by, "source_key", "r.*")
    return topk(out, k, by, [F.desc("score"), "shot_id"]) if k else out


def shortlist(cands: DataFrame, k: int, by: str = "line_id") -> DataFrame:
    """interleave_sources(best_per_video(cands), k) of lists that are short for every key, in one shuffle: place from 1, one shot a video."""
    d = cands.repartition(by).groupBy(by, "shot_id").agg(F.max_by(F.struct("source_key", "source", "score"), "score").alias("r")).select(by, "shot_id", "r.*")
    best_first = [F.desc("score"), "shot_id"]
    d = d.withColumn("__n", F.row_number().over(W.partitionBy(by, "source_key").orderBy(*best_first))).where("__n = 1")
    d = d.withColumns({"turn": F.row_number().over(W.partitionBy(by, "source").orderBy(*best_first)), "best": F.max("score").over(W.partitionBy(by, "source"))}).drop("__n")
    return d.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("turn", F.desc("best"), "source"))).where(F.col("place") <= k)


def order_judged(cands: DataFrame, k: int, by: str = "line_id") -> DataFrame:
    """shown from 1: in keys with a judged row as order_by_fit(), in the others rows of a wrong place last, else by place; the first k. Lists are short for every key."""
    group = F.when(F.col("fit"), 0).when(F.col("fit").isNull(), 1).otherwise(2)
    d = cands.withColumn("__any", F.max("judged").over(W.partitionBy(by)))
    judged = F.col("__any")
    order = [F.when(judged, group).otherwise(F.col("wrong_place").isNotNull().cast("int")), F.when(judged, F.coalesce("verdict_pos", F.lit(0))).otherwise(F.col("place")), F.when(judged, -F.col("score")), F.col("shot_id")]
    return d.withColumn("shown", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("shown") <= k).drop("__any")


def order_by_fit(cands: DataFrame, by: str = "line_id") -> DataFrame:
    """Confirmed clips first in verdict order, then unjudged, then rejected; score breaks ties."""
    grp = F.when(F.col("fit"), 0).when(F.col("fit").isNull(), 1).otherwise(2)
    d = cands.withColumns({"__grp": grp, "__pos": F.coalesce("verdict_pos", F.lit(0))})
    return numbered(d, by, ["__grp", "__pos", F.desc("score"), "shot_id"], "place").drop("__grp", "__pos")


def order_clusters(clusters: DataFrame) -> DataFrame:
    """clusters(query_id, cluster, shot_id, score): clusters by best score, shots by score."""
    best = F.max("score").over(W.partitionBy("query_id", "cluster"))
    w = W.partitionBy("query_id").orderBy(F.desc("__best"), "cluster", F.desc("score"), "shot_id")
    return clusters.withColumn("__best", best).withColumn("place", F.row_number().over(w)).drop("__best")


def ordered_distinct(lists: DataFrame, n: int, by: str = "line_id", width: int | None = None) -> DataFrame:
    """lists(by, pos, q): first spelling of each text (case ignored) in order, at most n."""
    q = lists.withColumn("q", F.trim("q")).where("q <> ''")
    first = q.groupBy(by, F.lower("q").alias("__l")).agg(F.min(F.struct("pos", "q")).alias("r"))
    text_ = F.substring("r.q", 1, width) if width else F.col("r.q")
    w = W.partitionBy(by).orderBy("r.pos")
    return (first.select(by, F.col("r.pos").alias("pos"), text_.alias("q"), F.row_number().over(w).alias("place"))
            .where(F.col("place") <= n))


def alternatives(cands: DataFrame, chosen: DataFrame, n: int = 8, by=("script_id", "beat_i")) -> DataFrame:
    left = cands.join(chosen.select(*by, "shot_id").distinct(), [*by, "shot_id"], "left_anti")
    return topk(left, n, list(by), [F.desc("score"), "shot_id"])


def assert_disjoint(a: DataFrame, b: DataFrame, keys) -> bool:
    return a.select(*keys).intersect(b.select(*keys)).isEmpty()


def rrf(ranked: DataFrame, k: float = 60, by: str = "slot_id") -> DataFrame:
    """ranked(by, list_no, rank from 0, source_key, shot_id): reciprocal-rank fusion, one entry per video, first card wins."""
    return ranked.groupBy(by, "source_key").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("fused"),
        F.min_by("shot_id", F.struct("list_no", "rank")).alias("shot_id"))


def phrasing_fallback(runs: DataFrame) -> DataFrame:
    """runs(slot_id, phrasing 0 = main, shot_id, suggested, suggested_score): first phrasing with a shot; else best suggestion."""
    order = F.struct(F.col("shot_id").isNull().cast("int"), "phrasing")
    return runs.groupBy("slot_id").agg(
        F.min_by("shot_id", order).alias("shot_id"),
        F.min_by(F.when(F.col("shot_id").isNotNull(), F.col("phrasing")), order).alias("used_phrasing"),
        F.max_by("suggested", F.struct("suggested_score", -F.col("phrasing"))).alias("best_suggested")) \
        .withColumn("suggested", F.when(F.col("shot_id").isNull(), F.col("best_suggested"))).drop("best_suggested")
