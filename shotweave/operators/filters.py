"""Filters and verdict merging."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, media


def apply_filters(df: DataFrame, size=None, motion=None, orientation=None, source=None, licence=None, library=None,
                  live_libraries: DataFrame | None = None, also_lib=None, min_len=None) -> DataFrame:
    """Conjunctive shot filters. Constants reach the scan; the live-library exclusion is an anti-join."""
    if size:
        df = df.where(F.col("size").isin(*size))
    if motion:
        df = df.where(F.col("motion").isin(*motion))
    if orientation:
        df = df.where(F.col("orientation") == orientation)
    if source:
        df = df.where(F.col("source").isin(*source))
    if licence == "commercial":
        df = df.where(media.is_commercial(F.col("licence_class")))
    if min_len:
        df = df.where(F.col("t_end") - F.col("t_start") >= min_len)
    return scope(df, live_libraries, library, also_lib)


def scope(df: DataFrame, live_libraries: DataFrame | None = None, library=None, also_lib=None) -> DataFrame:
    """One library, or everything except libraries of kind 'live' (also_lib is let back in)."""
    if library:
        return df.where(F.col("lib") == library)
    if live_libraries is None:
        return df
    hidden = live_libraries.where("kind = 'live'").select(F.col("id").alias("lib")).distinct()
    if also_lib:
        hidden = hidden.where(F.col("lib") != also_lib)
    return df.join(hidden, "lib", "left_anti")


def gate(cands: DataFrame, min_score: float = fixed.MIN_SCORE, delta: float = fixed.GATE_DELTA) -> DataFrame:
    """Rows within `delta` of the query's best score and above the floor."""
    best = F.max("score").over(W.partitionBy("query_id"))
    return cands.withColumn("__best", best).where(F.col("score") >= F.greatest(F.lit(min_score), F.col("__best") - delta)).drop("__best")


def suitable(stock: DataFrame, lo: float = 4, hi: float = 45) -> DataFrame:
    return stock.where((F.coalesce("width", F.lit(0)) >= F.coalesce("height", F.lit(0))) & F.coalesce("duration", F.lit(0.0)).between(lo, hi))


def confidence_floor(plan: DataFrame, floor: float = fixed.CONFIDENCE_FLOOR) -> DataFrame:
    low = F.col("score") < floor
    return plan.withColumns({"suggested": F.when(low, F.col("shot_id")), "shot_id": F.when(low, F.lit(None).cast("long")).otherwise(F.col("shot_id"))})


def wrong_place_name(clip_places: Column, video_places: Column) -> Column:
    """First place a clip names when none of its places is related to any place of the video; else null.

    Both arguments are arrays of structs with `name` and `anc` (the place and everything around it).
    """
    related = F.exists(clip_places, lambda a: F.exists(
        video_places, lambda b: F.array_contains(a["anc"], b["name"]) | F.array_contains(b["anc"], a["name"])))
    return F.when((F.size(clip_places) > 0) & (F.size(video_places) > 0) & ~related, F.get(clip_places, F.lit(0))["name"])


def review_pool(picks: DataFrame, n: int = 8) -> DataFrame:
    """picks(slot_id, shot_id, src_rank 0 chosen | 1 suggested | 2 alternative, pos[, wrong]): first n distinct shots a slot."""
    p = picks.where("NOT wrong") if "wrong" in picks.columns else picks
    first = p.groupBy("slot_id", "shot_id").agg(F.min(F.struct("src_rank", "pos")).alias("o"))
    w = W.partitionBy("slot_id").orderBy("o", "shot_id")
    return (first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
            .select("slot_id", "shot_id", F.col("o.src_rank").alias("src_rank"), "place"))


def keep_confirmed(plan: DataFrame, verdicts: DataFrame) -> DataFrame:
    """plan(slot_id, shot_id, chosen, pos), verdicts(slot_id, shot_id, verdict_pos): confirmed clips only.

    Chosen clips that are confirmed stay; freed places are filled from the pool in verdict order, up to the original number
    (at least one). Slots with verdicts but nothing left keep no row here; see no_match.
    """
    want = plan.groupBy("slot_id").agg(F.greatest(F.count_if("chosen"), F.lit(1)).alias("want"))
    j = plan.join(verdicts, ["slot_id", "shot_id"]).join(want, "slot_id")
    order = [F.desc("chosen"), F.when(F.col("chosen"), F.col("pos")).otherwise(F.col("verdict_pos")), F.col("shot_id")]
    return (j.withColumn("place", F.row_number().over(W.partitionBy("slot_id").orderBy(*order)))
            .withColumn("kept", F.col("place") <= F.col("want")).drop("want"))


def no_match(plan: DataFrame, confirmed: DataFrame) -> DataFrame:
    return plan.select("slot_id").distinct().join(confirmed.where("kept").select("slot_id").distinct(), "slot_id", "left_anti")


def merge_verdict(pool: DataFrame, verdicts: DataFrame, keep: int = 12) -> DataFrame:
    """pool(slot_id, shot_id, current, shown, pos): good-first order; the best good clip becomes the pick.

    verdicts(slot_id, shot_id, good_pos). Adds new_pos (0 = the pick or what is suggested) and role.
    """
    j = pool.join(verdicts, ["slot_id", "shot_id"], "left")
    rank = F.when(F.col("good_pos").isNotNull(), 0).when(F.col("shown"), 1).otherwise(2)
    w = W.partitionBy("slot_id").orderBy(rank, F.col("good_pos"), F.col("pos"), F.col("shot_id"))
    any_good = F.max(F.col("good_pos").isNotNull()).over(W.partitionBy("slot_id"))
    j = j.withColumns({"place": F.row_number().over(w), "any_good": any_good})
    role = (F.when(F.col("any_good") & (F.col("place") == 1), "shot")
            .when(~F.col("any_good") & F.col("current"), "suggested").otherwise("alt"))
    return j.withColumn("role", role).where((F.col("role") != "alt") | (F.col("place") <= keep + 1)).select(
        "slot_id", "shot_id", "role", "place")


def fit_deficit(verdicts: DataFrame, min_fit: int = 6) -> DataFrame:
    return verdicts.groupBy("line_id").agg(F.count_if("fit").alias("n_fit")).where(F.col("n_fit") < min_fit)
