"""Group functions against brute force, scale paths against plain paths, skewed keys."""
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from shotweave.functions import fixed, media
from shotweave.operators import cuts, ordered, retrieval, similarity, spots


def unit(rng, n, d=8):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def random_slots(seed, n=4, k=3):
    rng = np.random.default_rng(seed)
    rows, sid = [], 1000
    for s in range(n):
        for _ in range(k):
            rows.append(dict(script_id=1, slot_i=s, shot_id=sid, unary=.25 + rng.random() * .1, emb=unit(rng, 1, 3)[0], source_key=f"f{rng.integers(1, 3)}", t_start=float(rng.integers(0, 3) * 4),
                             size=str(rng.choice(["wide", "medium", "close"])), has_feat=True, head_dx=rng.normal() * 3, head_dy=rng.normal() * 3, tail_dx=rng.normal() * 3, tail_dy=rng.normal() * 3,
                             head_luma=rng.random(), tail_luma=rng.random(), head_warmth=rng.normal() * .2, tail_warmth=rng.normal() * .2, sal_x=rng.random()))
            sid += 1
    return pd.DataFrame(rows)


def score(S, costs, path):
    v = sum(s["unary"][j] for s, j in zip(S, path))
    v -= fixed.CUT_WEIGHT * sum(0 if c[1][i, j] else c[0][i, j] for c, i, j in zip(costs, path, path[1:]))
    rows, keys = [s["row"][j] for s, j in zip(S, path)], [s["key"][j] for s, j in zip(S, path)]
    return v - (len(rows) - len(set(rows))) - .03 * (len(keys) - len(set(keys)))


@pytest.mark.parametrize("seed", range(8))
def test_chain_and_refinement_against_every_combination(seed):
    S = cuts._read_slots(random_slots(seed))
    unary, rows, keys = [s["unary"] for s in S], [s["row"] for s in S], [s["key"] for s in S]
    costs = [cuts._cost_matrix(a, b) for a, b in zip(S, S[1:])]
    chain = cuts.best_chain(unary, costs, fixed.CUT_WEIGHT)
    value = lambda p: sum(u[j] for u, j in zip(unary, p)) - .25 * sum(c[0][i, j] for c, i, j in zip(costs, p, p[1:]))
    assert value(chain) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=4)), abs=1e-9)
    better = cuts.improve(chain, unary, costs, rows, keys, fixed.CUT_WEIGHT)
    assert score(S, costs, better) >= score(S, costs, cuts.greedy_path(unary, rows)) - 1e-9
    assert len({r[j] for r, j in zip(rows, better)}) == 4


def test_transition_column_equals_matrix(spark):
    p = random_slots(3)
    p["emb"] = p["emb"].map(list)
    n = spark.createDataFrame(p)
    a = n.select("slot_i", *[F.col(c).alias(f"a_{c}") for c in cuts.NODE])
    z = n.select((F.col("slot_i") - 1).alias("slot_i"), *[F.col(c).alias(f"b_{c}") for c in cuts.NODE])
    got = {(r.a_shot_id, r.b_shot_id): r.cost for r in a.join(z, "slot_i").withColumn("t", cuts.transition()).select("a_shot_id", "b_shot_id", "t.cost").collect()}
    S = cuts._read_slots(random_slots(3))
    for x, y in zip(S, S[1:]):
        T, _ = cuts._cost_matrix(x, y)
        for i, j in itertools.product(range(3), range(3)):
            assert got[(x["row"][i], y["row"][j])] == pytest.approx(T[i, j], abs=1e-9)


def test_funnel_pieces():
    E = np.array([[1, 0, 0], [.98, .2, 0], [0, 1, 0]], float)
    E /= np.linalg.norm(E, axis=1, keepdims=True)
    rel = np.array([.30, .29, .20])
    assert retrieval.diversify(rel, E, 3, 0.0).tolist() == [0, 1, 2] and retrieval.diversify(rel, E, 2, 0.9).tolist() == [0, 2]
    kept = retrieval.keep_distinct(rel, np.arange(3), np.array(["a", "a", "a"]), np.array([0., 4., 5.]), E, .93, 10)
    assert kept.tolist() == [0, 2]
    assert retrieval.keep_distinct(rel, np.arange(3), np.array(["a", "b", "c"]), np.zeros(3), E, .93, 10).tolist() == [0, 1, 2]
    X = np.array([[1, 0, 0], [.99, .1, 0], [0, 1, 0], [.05, 1, 0]], float)
    g = retrieval.average_linkage(X, .35)
    assert g[0] == g[1] != g[2] == g[3]


def test_similarity_paths_agree(spark):
    rng = np.random.default_rng(1)
    X = unit(rng, 300)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "shot_id long, emb array<double>")
    q = df.select(F.col("shot_id").alias("query_id"), F.col("emb").alias("qe"), F.col("shot_id").alias("skip_id"))
    key = lambda d: sorted((r.query_id, r.rank, r.shot_id) for r in d.collect())
    assert key(similarity.dense_topk(q, df, 7)) == key(similarity.dense_topk(q, df, 7, slice_bytes=9000, lead=2))
    ids = df.select(F.col("shot_id").alias("id"), "emb")
    C = X @ X.T
    want = {(i, j) for i in range(300) for j in range(300) if i != j and C[i, j] > .8}
    assert {(r.id, r.other) for r in similarity.similar_pairs(ids, ids, .8, lead=2, block_rows=40).collect()} == want


def test_small_shots_travel_to_many_queries(spark):
    """With fewer shots than queries the shots are the slices; long vectors with few strong directions go by the bound."""
    rng = np.random.default_rng(11)
    X = rng.normal(size=(260, 4)) @ rng.normal(size=(4, 80)) + rng.normal(size=(260, 80)) * .05
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    q = spark.createDataFrame([(i, x.tolist(), i) for i, x in enumerate(X)], "query_id long, qe array<double>, skip_id long").repartition(3)
    s = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X[:90])], "shot_id long, emb array<double>")
    score = X @ X[:90].T
    score[np.arange(90), np.arange(90)] = -9
    want = {(i, int(j), r + 1) for i in range(260) for r, j in enumerate(np.argsort(-score[i], kind="stable")[:6]) if score[i, j] >= max(.1, score[i].max() - .2)}
    for lead in (0, 6):
        got = similarity.dense_topk(q, s, 6, .1, .2, slice_bytes=40 * 80 * 8, lead=lead).collect()
        assert {(r.query_id, r.shot_id, r.rank) for r in got} == want
    ids = q.selectExpr("query_id as id", "qe as emb")
    some = s.selectExpr("shot_id as id", "emb")
    pairs = {(i, j) for i in range(260) for j in range(90) if X[i] @ X[j] > .9}
    for left, right, flip in ((ids, some, False), (some, ids, True)):
        got = {(r.id, r.other) for r in similarity.similar_pairs(left, right, .9, same=False, lead=6, block_rows=33).collect()}
        assert got == ({(j, i) for i, j in pairs} if flip else pairs)
        assert {r.id for r in similarity.has_similar(left, right, .9, same=False, lead=6, block_rows=33).collect()} == {p[0] for p in got}


def test_the_bound_skips_products_and_loses_none():
    rng = np.random.default_rng(12)
    X = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 64)) + rng.normal(size=(400, 64)) * .02
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    basis = np.linalg.svd(X, full_matrices=False)[2][:4].T
    S = similarity.Bounded(X[:150], basis).scores(X[150:], .97)
    full = X[150:] @ X[:150].T
    assert np.isneginf(S).mean() > .5 and ((full <= .97) | np.isfinite(S)).all() and np.allclose(S[np.isfinite(S)], full[np.isfinite(S)])


def test_first_come_with_a_third_of_copies(spark):
    rng = np.random.default_rng(2)
    X = unit(rng, 90)
    X[rng.permutation(90)[:30]] = X[5]                                    # exact copies
    X[60:75] = X[60] + rng.normal(size=(15, 8)) * .01                     # near copies
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    kept = []
    for i in range(90):
        if not any(X[i] @ X[j] > .9 for j in kept):
            kept.append(i)
    df = spark.createDataFrame([(i, x.tolist(), i) for i, x in enumerate(X)], "id long, emb array<double>, ord long")
    assert sorted(r.id for r in similarity.first_come_independent(df, .9, lead=2, block_rows=20).collect()) == kept


def test_running_and_neighbour_on_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(99).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    chunk = F.floor(F.col("t") / 100)
    w = W.partitionBy("k").orderBy("t")
    full = w.rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum("t").over(full), "l": F.last("v", True).over(full), "m": F.max("v").over(full)})
    got = ordered.running(df, "k", chunk, ["t"], s=("sum", F.col("t")), l=("last", F.col("v")), m=("max", F.col("v")))
    assert sorted(map(tuple, got.select("k", "t", "s", "l", "m").na.fill(-1).collect())) == sorted(map(tuple, want.select("k", "t", "s", "l", "m").na.fill(-1).collect()))
    for step, fn in ((1, F.lead), (-1, F.lag)):
        a = ordered.neighbour(df, "k", chunk, ["t"], {"n": F.col("t")}, step).select("k", "t", "n").na.fill(-1)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, df.withColumn("n", fn("t").over(w)).select("k", "t", "n").na.fill(-1).collect()))


def spots_of(spark, rows, seconds, density, kept=None):
    """Spots of one video; rows: (id, importance, visual, role, start, end)."""
    lines = spark.createDataFrame([(7, i, imp, vis, role, "q", ["a"], None, "") for i, imp, vis, role, *_ in rows],
                                  "video_id long, id long, importance double, visual double, role string, query string, alt_queries array<string>, anchor string, reason string")
    units = spark.createDataFrame([(7, i, "speech", float(a), float(b), "words") for i, *_, a, b in rows], "video_id long, id long, kind string, start double, end double, text string")
    length = spark.createDataFrame([(7, float(seconds))], "video_id long, duration double")
    keep = spark.createDataFrame([(7, *k) for k in kept], "video_id long, start double, end double") if kept else None
    return sorted(spots.select_spots(lines, units, None, length, density, keep).collect(), key=lambda r: r.start)


def test_spots(spark):
    bare = spots_of(spark, [(4, .15, .45, "detail", 2.0, 8.5)], 9.0, "light")
    assert [(r.guaranteed, r.reason) for r in bare] == [(True, "a video always gets B-roll: best available line")]
    dull = spots_of(spark, [(i, .05, .5, "detail", i * 11.0, i * 11.0 + 8) for i in range(4)], 44.0, "light")
    assert len(dull) >= 4 and all(r.guaranteed for r in dull)
    busy = spots_of(spark, [(i, .85, .95, "place", i * 5.0, i * 5.0 + 4.2) for i in range(24)], 120.0, "balanced")
    assert all(b.start - a.end >= 1.5 for a, b in zip(busy, busy[1:])) and len(busy) <= 14 and not any(r.guaranteed for r in busy)
    again = spots_of(spark, [(i, .85, .95, "place", i * 5.0, i * 5.0 + 4.2) for i in range(24)], 120.0, "balanced", [(40.0, 60.0)])
    assert again and all(r.end + (0.4 if r.guaranteed else 1.5) <= 40 or r.start >= (60.4 if r.guaranteed else 61.5) for r in again)


def test_offers_keep_their_distance():
    track = spots.Track([(5.0, 7.0), (1.0, 2.0)])
    assert not track.add(7.5, 9.0, 1.0) and not track.add(2.5, 4.5, 0.6) and track.add(8.0, 9.0, 1.0) and track.seconds() == 4.0
    assert spots.accept_offers([(0, 1, 20.0, 24.0, 1.0), (0, 2, 30.0, 31.0, 1.0), (1, 3, 40.0, 41.0, .4)], track, 8.0, 9, 5) == [(1, 20.0, 24.0, False), (3, 40.0, 41.0, True)]


def test_captions(spark):
    def cut(text, seconds=0.3):
        words = [(w, i * seconds, (i + 1) * seconds) for i, w in enumerate(text.split())]
        rows = spark.createDataFrame([(1, 1, 0.0, 9.0, text, words), (1, 2, 9.0, 10.0, " bare line ", None)], "video_id long, seg_id long, start double, end double, text string, words array<struct<w:string,s:double,e:double>>")
        got = sorted(spots.caption_chunks(rows).collect(), key=lambda r: (r.seg_id, r.part))
        assert [(r.text, r.start, r.end) for r in got if r.seg_id == 2] == [("bare line", 9.0, 10.0)]
        return [r for r in got if r.seg_id == 1]
    story = "Slow rivers carve wide valleys where farmers plant barley and rye. Every spring the melting snow brings fresh silt down from distant ridges and the fields turn green. So"
    got = cut(story)
    assert " ".join(r.text for r in got) == story and all(len(r.text) <= 84 for r in got) and len(got[-1].text) >= 20
    assert got[0].text.endswith("rye.") and all(a.end <= b.start + 1e-9 for a, b in zip(got, got[1:]))
    assert all(r.end - r.start <= 6.0 + 1e-9 for r in cut(story, 1.5)[:-2]) and [r.text for r in cut("alone")] == ["alone"]


def test_smart_trim(spark):
    rows = [(10., 14., 12., 3.5, 10.), (10., 30., None, 4., 10.), (10., 30., 20., 5., 18.), (10., 30., 29.5, 5., 25.)]
    df = spark.createDataFrame(rows, "a double, b double, p double, d double, want double")
    assert all(r.got == pytest.approx(r.want) for r in df.withColumn("got", media.smart_trim(*[F.col(c) for c in "abpd"])).collect())


def test_margin_is_the_same_for_every_plan(spark):
    """What a margin leaves must not hang on the number of tasks or on the way taken."""
    vectors = np.random.default_rng(8).normal(size=(300, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "shot_id long, emb array<double>")
    q = s.where("shot_id < 40").select(F.col("shot_id").alias("query_id"), F.col("emb").alias("qe"), F.col("shot_id").alias("skip_id"))
    score = vectors[:40] @ vectors.T
    score[np.arange(40), np.arange(40)] = -9
    want = {(i, j) for i in range(40) for j in np.argsort(-score[i], kind="stable")[:50] if score[i, j] >= max(0.18, score[i].max() - 0.05)}
    for parts, size in ((2, 64 << 20), (13, 64 << 20), (5, 900)):
        got = similarity.dense_topk(q, s.repartition(parts), 50, 0.18, 0.05, slice_bytes=size, lead=3)
        assert {(r.query_id, r.shot_id) for r in got.collect()} == want


def test_numbers_of_piled_up_scores(spark):
    """Nine tenths of the rows share a key, and of these nine tenths a score: numbers are right and every task holds a fair share."""
    n = 20_000
    r = np.random.default_rng(5)
    key = np.where(r.random(n) < .9, "hot", np.where(r.random(n) < .5, "cold", "none"))
    score = np.where(r.random(n) < .9, .5, r.random(n).round(2))
    rows = [(None if k == "none" else k, float(x), i) for i, (k, x) in enumerate(zip(key.tolist(), score.tolist()))]
    df = spark.createDataFrame(rows, "k string, score double, id long").repartition(8)
    want, seen = {}, {}
    for k, x, i in sorted(rows, key=lambda t: (-t[1], t[2])):
        seen[k] = want[i] = seen.get(k, 0) + 1
    assert {t.id: t.n for t in ordered.numbered(df, "k", [F.desc("score"), "id"], "n").collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")        # as if partitions were large
    sizes = [t["count"] for t in ordered.laid_out(df, ["k", F.desc("score"), "id"]).groupBy(F.shiftright("__at", 33)).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * n / 8
    every = {t.id: t.n for t in ordered.numbered(df, [], [F.desc("score"), "id"], "n").collect()}
    assert [i for i, _ in sorted(every.items(), key=lambda t: t[1])] == [i for _, _, i in sorted(rows, key=lambda t: (-t[1], t[2]))]
    sums = {t.id: t.s for t in ordered.running_totals(df.where("id < 500"), ["id"], s=F.col("id")).collect()}
    assert sums == {i: i * (i + 1) // 2 for i in range(500)}
    assert ordered.numbered(df.limit(0), "k", ["id"], "n").count() == ordered.running_totals(df.limit(0), ["id"], s=F.col("id")).count() == 0
