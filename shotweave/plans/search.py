"""Search: every query to labelled clusters of varied shots."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..operators import filters, held, retrieval, similarity, tables
from ..session import cut_lineage

RESULT = ("query_id long, shot_id long, score double, cluster int, label string, place int, n_relevant int, "
          "missing array<string>")


def search(queries: DataFrame, shots: DataFrame, vocab: DataFrame, k: int = fixed.DEFAULT_K, diversity: float = fixed.DEFAULT_DIVERSITY,
           min_score: float = fixed.MIN_SCORE, delta: float = fixed.GATE_DELTA, sim: float = fixed.DEDUPE_SIM,
           window: float = fixed.DEDUPE_WINDOW_S, dist: float = fixed.CLUSTER_DIST, cap: int = fixed.SEARCH_PER_SOURCE,
           held_bytes: int | None = None, **shot_filters) -> DataFrame:
    """Top-k, gate, near-duplicates, source cap, diversity, clusters and labels of all queries at once.

    The steps after the gate run in the task that reads the query, or share one shuffle by query_id where the shots are too many to hold; a group is one query's gated list (at most TOP_POOL rows).
    place orders the page: clusters by best score, shots by score inside.
    """
    pool = filters.apply_filters(shots, **shot_filters)
    words, V = retrieval.vocabulary(vocab)

    def page(query, score, ids, key, t0, E, size):
        kept = retrieval.first_distinct(key, t0, E, sim, window)
        kept = retrieval.cap_positions(kept, key.tolist(), cap)
        have = set(size[kept])
        missing = [s for s in ("wide", "medium", "close") if s not in have] if len(kept) >= 3 else []
        head = kept[:fixed.MMR_POOL]
        pick = head[retrieval.diversify(score[head], E[head], k, diversity)]
        pick = pick[np.lexsort((ids[pick], -score[pick]))]
        group = retrieval.average_linkage(E[pick], dist)
        order = list(dict.fromkeys(group))                       # rows are in score order: clusters by best score
        labels = dict(zip(order, retrieval.unique_labels([pick[group == g] for g in order], E, V, words)))
        page_order = np.concatenate([np.flatnonzero(group == g) for g in order])
        rank = {g: i for i, g in enumerate(order)}
        return pd.DataFrame({"query_id": query, "shot_id": ids[pick][page_order], "score": score[pick][page_order],
                             "cluster": [rank[g] for g in group[page_order]], "label": [labels[g] for g in group[page_order]],
                             "place": np.arange(1, len(pick) + 1), "n_relevant": len(kept), "missing": [missing] * len(pick)})

    columns = ["source_key", "t_start", "size"]
    h = held.hold(pool.select("shot_id", "emb", *columns), columns, held_bytes=held_bytes)
    if h:
        def pages(h, b, r, c, score, rank):
            r, c, score = retrieval._gated(r, c, score, min_score, delta)
            ids, key, t0, size, names = h.column("shot_id"), h.column("source_key"), h.column("t_start"), h.column("size"), h.names["size"]
            out = [page(b["query_id"].iloc[i], score[a:z], ids[c[a:z]], key[c[a:z]], t0[c[a:z]], h.vectors(c[a:z]), np.array([names[x] for x in size[c[a:z]].tolist()], object))
                   for i, a, z in held.edges(r)]
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame()
        return held.each(queries, h, fixed.TOP_POOL, min_score, delta, pages, RESULT)
    gated = filters.gate(similarity.dense_topk(queries, pool, fixed.TOP_POOL, min_score, delta, held_bytes=held_bytes), min_score, delta)
    rows = gated.select("query_id", "shot_id", "score").join(pool.select("shot_id", "source_key", "t_start", "emb", "size"), "shot_id")

    def group(pdf):
        p = pdf.sort_values(["score", "shot_id"], ascending=[False, True])
        return page(p["query_id"].iloc[0], p["score"].to_numpy(), p["shot_id"].to_numpy(), p["source_key"].to_numpy(), p["t_start"].to_numpy(), np.stack(p["emb"].to_numpy()), p["size"].to_numpy())
    return rows.groupBy("query_id").applyInPandas(group, RESULT)


def search_cards(results: DataFrame, shots: DataFrame, provenance: DataFrame) -> DataFrame:
    return tables.cards(results, shots, provenance)


MOST_JUDGED = 30                # candidates of a line that the judge looks at


def suggest(lines: DataFrame, encode, shots: DataFrame, vocab: DataFrame, video_places: DataFrame, clip_places: DataFrame,
            k: int = 24, judge=None, **opts) -> DataFrame:
    """Suggestions for lines, from queries grounded in their video.

    lines(line_id, text, query, alt_queries, topic): a line asks with its queries and its text, each plain and pinned to the topic of its video.
    encode: function from query texts (q) to (q, query_id, qe[, skip_id]); texts with one query_id share a vector and are searched once.
    video_places(line_id, video_places), clip_places(shot_id, clip_places). judge: function from candidates (line_id, shot_id) to
    (line_id, shot_id, verdict_pos), null where the picture does not fit. opts are those of search(), library scope included.
    Best score per shot, one per video, sources interleaved; then fitting clips in the judge's order, those it did not see, those that do not fit
    or name a wrong place. Lines without a verdict keep their order, wrong places last.
    """
    from ..operators import lines as texts, windows
    asked = texts.grounded_queries(lines).select("line_id", "q")
    asked = cut_lineage(asked.join(encode(asked.select("q").distinct()), "q").drop("q").dropDuplicates(["line_id", "query_id"]))
    vectors = asked.dropDuplicates(["query_id"]).drop("line_id")
    found = search(vectors, shots, vocab, k=min(60, max(k, 12)), **opts)
    rows = found.select("query_id", "shot_id", "score").join(asked.select("line_id", "query_id"), "query_id").join(shots.select("shot_id", "source_key", "source"), "shot_id")
    mixed = windows.shortlist(rows, max(k, 12))
    d = (mixed.join(clip_places, "shot_id", "left").join(video_places, "line_id", "left")
         .withColumn("wrong_place", filters.wrong_place_name(F.col("clip_places"), F.col("video_places"))).drop("clip_places", "video_places"))
    if judge:
        d = cut_lineage(d)
        seen = judge(d.where(F.col("place") <= MOST_JUDGED).select("line_id", "shot_id")).select("line_id", "shot_id", "verdict_pos", F.lit(True).alias("judged"))
        d = d.join(seen, ["line_id", "shot_id"], "left").withColumn("judged", F.coalesce("judged", F.lit(False)))
    else:
        d = d.withColumns({"verdict_pos": F.lit(None).cast("long"), "judged": F.lit(False)})
    d = d.withColumn("fit", F.when(F.col("wrong_place").isNotNull(), False).when(F.col("verdict_pos").isNotNull(), True).when(F.col("judged"), False))
    return windows.order_judged(d, k).select("line_id", "shot_id", "source_key", "source", "score", "fit", "wrong_place", "shown")


def rescue(slots: DataFrame, cands: DataFrame) -> DataFrame:
    """Videos whose slots are all empty get one shot on their most important slot.

    slots(video_id, slot_id, importance, shot_id), cands(slot_id, shot_id, place, verdict_pos, wrong): the best confirmed clip,
    else the first that names no wrong place, else the first, flagged low confidence.
    """
    empty = slots.groupBy("video_id").agg(F.bool_or(F.col("shot_id").isNotNull()).alias("any"),
                                          F.max_by("slot_id", F.struct("importance", -F.col("slot_id"))).alias("slot_id")).where("NOT any")
    order = F.struct(F.col("verdict_pos").isNull().cast("int"), F.coalesce("verdict_pos", F.col("wrong").cast("int")), "place")
    best = cands.groupBy("slot_id").agg(F.min_by(F.struct("shot_id", F.col("verdict_pos").isNull().alias("low")), order).alias("r"))
    return empty.join(best, "slot_id").select("video_id", "slot_id", "r.shot_id", F.col("r.low").alias("low_confidence"))
