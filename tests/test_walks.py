"""Greedy walks by composed block maps, and ordered folds, against the plain loop."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotweave.operators import aggregates, walks
from shotweave.streaming import segment


def loop(ts, gap, last=-np.inf):
    out = []
    for t in ts:
        if t - last >= gap:
            last = t
        out.append(last)
    return np.array(out)


@pytest.mark.parametrize("seed", range(30))
def test_maps_of_blocks_compose(seed):
    rng = np.random.default_rng(seed)
    ts = np.unique(np.round(np.cumsum(rng.choice([0.1, 0.3, 0.7, 2.5], 300)), 1)) * (1 if seed % 2 else 0.1)
    gap = float(rng.choice([0.3, 0.8, 5.0]))
    parts = np.array_split(ts, int(rng.integers(2, 40)))
    maps = [walks.block_map(p, gap) for p in parts]
    cut = len(maps) // 2
    both = [(parts[i][0], *walks.composed([p[0] for p in parts[i:k]], [m[0] for m in maps[i:k]], [m[1] for m in maps[i:k]], gap)) for i, k in ((0, cut), (cut, len(maps)))]
    lo, at, to = zip(*both)
    whole = walks.composed(lo, at, to, gap)
    for last in [-np.inf, ts[0] - gap, ts[0] - gap / 2, ts[0] - 1e-9]:
        assert float(walks._through(*whole, last, gap)) == loop(ts, gap, last)[-1]
        at_ = last
        for p in parts:
            assert walks.settled(p, at_, gap).tolist() == loop(p, gap, at_).tolist()
            at_ = loop(p, gap, at_)[-1]


@pytest.mark.parametrize("start", [None, 2.0])
def test_walk_on_a_hot_key(spark, monkeypatch, start):
    monkeypatch.setattr(walks, "BLOCK", 16)
    monkeypatch.setattr(walks, "FAN", 4)
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"k": rng.choice([1.0, 1.0, 1.0, 2.0, np.nan], 3000), "s": "a", "t": np.round(rng.random(3000) * 400, 1)})
    rows = [(None if np.isnan(k) else int(k), s, float(t)) for k, s, t in p.itertuples(index=False)] + [(1, "a", None), (1, "a", float("nan")), (7, "a", 1.0)]
    got = walks.greedy_walk(spark.createDataFrame(rows, "k int, s string, t double"), ["k", "s"], "t", 0.8, start).toPandas()
    want = []
    for k in {r[0] for r in rows}:
        ts = np.unique([r[2] for r in rows if r[0] == k and r[2] is not None and r[2] == r[2]])
        want += [(k, t, f) for t, f in zip(ts, loop(ts, 0.8, -np.inf if start is None else start))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((None if pd.isna(k) else int(k), t, f) for k, t, f in got[["k", "t", "kept"]].itertuples(index=False)), key=key) == sorted(want, key=key)


def test_walk_over_a_run_of_a_million(spark):
    d = spark.range(1_000_000).select(F.lit(1).alias("k"), (F.col("id") * 0.25 + (F.col("id") % 7) * 0.01).alias("t"))
    got = walks.greedy_walk(d, "k", "t", 0.8).where("t = kept").agg(F.count("*"), F.sum("t")).first()
    i = np.arange(1_000_000)
    kept = np.unique(loop(i * 0.25 + (i % 7) * 0.01, 0.8))
    assert got[0] == len(kept) and got[1] == pytest.approx(kept.sum())


def test_walk_without_rows(spark):
    assert walks.greedy_walk(spark.createDataFrame([], "k int, t double"), "k", "t", 1.0).collect() == []


def shots_of(p, cut_sim, window_s, step):
    """One pass over a file's samples: (t_start, t_end, n, unit mean)."""
    groups, prev = [], None
    for t, e in p:
        if prev is None or prev @ e < cut_sim or t - groups[-1][0][0] >= window_s:
            groups.append([])
        groups[-1].append((t, e))
        prev = e
    for g in groups:
        m = np.mean([e for _, e in g], axis=0)
        yield g[0][0], g[-1][0] + step, len(g), m / np.linalg.norm(m)


def test_uneven_samples_against_the_loop(spark, monkeypatch):
    monkeypatch.setattr(walks, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(f, float(t), (v := rng.normal(size=4)) / np.linalg.norm(v)) for f, size in ((1, 200), (2, 60)) for t in np.unique(np.round(rng.random(size) * 300, 1))]
    d = spark.createDataFrame([(f, t, e.tolist()) for f, t, e in rows], "file_id long, t double, emb array<double>")
    got = {(r.file_id, round(r.t_start, 6)): r for r in segment.segment_irregular(d, -0.2).collect()}
    want = [(f, *s) for f in (1, 2) for s in shots_of(sorted(((t, e) for g, t, e in rows if g == f), key=lambda r: r[0]), -0.2, 4.0, 1.0)]
    assert len(want) == len(got) > 20
    for f, a, z, n, e in want:
        r = got[f, round(a, 6)]
        assert r.n == n and r.t_end == pytest.approx(z) and np.allclose(r.emb, e)


def test_ordered_fold_streams_a_long_key(spark):
    rng = np.random.default_rng(9)
    rows = [(k, int(i), rng.normal(size=3).tolist(), int(rng.integers(1, 5))) for k, size in ((1, 700), (2, 1), (None, 40), (3, 5)) for i in range(size)]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        d = spark.createDataFrame(rows, "k long, o long, emb array<double>, n int").orderBy(F.rand(1))
        got = {r.k: r for r in aggregates.weighted_mean_embedding(d, "k", "emb", "n", "o").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert set(got) == {1, 2, 3, None}
    for k, r in got.items():
        e, m = None, 0
        for _, _, x, n in (q for q in rows if q[0] == k):
            v = np.array(x) if e is None else e * m + np.array(x) * n
            e, m = (v if e is None else v / np.linalg.norm(v)), m + n
        assert r.n == m and np.allclose(r.emb, e)
    assert aggregates.weighted_mean_embedding(d.limit(0), ["k"], "emb", "n", "o").collect() == []
