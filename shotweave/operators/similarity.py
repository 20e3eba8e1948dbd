"""Exact similarity joins of unit vectors without forming all pairs in Spark, and without shuffling vectors.

One side (the smaller one; in a top k, shots unless queries are far fewer) is sent to the executors in slices of bounded bytes, one after the other, and the other streams past each slice where it
is read; Spark only receives the answers (k best per query, the pairs over a threshold, or one flag per row), never the product. Answers of
several slices are merged between slices, so a query never has more than k rows at a time.

Products come in two steps. The dot product of two vectors is at most that of their leading principal components plus the product of the norms
of what remains, so pairs whose bound is below what they have to beat are never multiplied in full. Where the bound keeps too many, a
task goes over to full matrix products. The directions come from a bounded sample and change speed only.
"""
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .. import session
from . import held as held_shots

SLICE_BYTES = 64 << 20          # of the smaller side sent to every executor at a time
TASK_ENTRIES = 4_000_000        # queries x k a task keeps
PRODUCT_ENTRIES = 8_000_000     # entries of one slice of a matrix product
PAIRS = 65_536                  # pairs multiplied one by one at a time
FEW = 8                         # shots per query from which on the queries are the side that is held
LEAD = 16                       # leading components of the bound
SAMPLE = 2048                   # rows the components are taken from
WORTH = 1 / 8                   # share of pairs above the bound up to which these are multiplied one by one
SLACK = 1e-9                    # of rounding in the bound


def _matrix(col) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 0))


def directions(df: DataFrame, dim: int, lead: int) -> np.ndarray | None:
    """The leading principal directions (dim x lead) of a sample of df(id, emb); None where vectors are too short for a bound to save work."""
    if not lead or dim < 4 * lead:
        return None
    rows = df.select("emb").where("emb is not null").orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
    X = np.array([r[0] for r in rows], np.float64).reshape(-1, dim)
    return np.linalg.svd(X, full_matrices=False)[2][:lead].T if len(X) >= lead else None


class Bounded:
    """A slice of the smaller side that batches of the other side are multiplied with, by bound first as long as that leaves few pairs."""

    def __init__(self, X: np.ndarray, basis: np.ndarray | None):
        self.X, self.basis = X, basis
        self.lead, self.rest = self._parts(X)
        self.turn, self.skip = 0, 0

    def _parts(self, X):
        if self.basis is None or not len(X):
            return None, None
        lead = X @ self.basis
        return lead, np.sqrt(np.maximum((X * X).sum(1) - (lead * lead).sum(1), 0))

    def pieces(self, Y: np.ndarray):
        """Y in parts small enough for one product: (first row, rows)."""
        step = max(1, PRODUCT_ENTRIES // max(len(self.X), 1))
        for i in range(0, len(Y), step):
            yield i, Y[i:i + step]

    def scores(self, Y: np.ndarray, least):
        """Dot products of Y's rows with the slice; -inf where they cannot reach `least` (a number, or one per row of the slice)."""
        if self.basis is None or self.turn < self.skip:
            self.turn += 1
            return Y @ self.X.T
        lead, rest = self._parts(Y)
        may = lead @ self.lead.T + rest[:, None] * self.rest[None, :] >= np.asarray(least) - SLACK
        rows, columns = np.nonzero(may)
        if len(rows) > WORTH * may.size:
            self.turn, self.skip = 0, min(64, 2 * self.skip + 4)      # try the bound again later
            return Y @ self.X.T
        self.turn, self.skip = 0, 0
        out = np.full(may.shape, -np.inf)
        out[rows, columns] = np.einsum("ij,ij->i", Y[rows], self.X[columns])
        return out


def _best(scores, ids, k, floor, margin):
    """Positions of the k best columns of each row, score descending, then id ascending.

    Columns below `floor`, or more than `margin` below the row's best, are left out.
    """
    n = scores.shape[1]
    cut = np.maximum(floor, scores.max(axis=1) - margin) if n else np.zeros(len(scores))
    if n > 4 * k:                                       # everything as good as the k-th value: ties are settled by id
        cut = np.maximum(cut, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
    out = []
    for row, c in zip(scores, cut):
        idx = np.flatnonzero((row >= c) & np.isfinite(row))
        out.append(idx[np.lexsort((ids[idx], -row[idx]))[:k]])
    return out


def _queries_held(qid, Q, skip, basis, k, floor, margin):
    """mapInPandas body over shots: running k best per query of the slice, over the batches of one task."""
    def run(batches):
        held = Bounded(Q, basis)
        best_id, best_sc = [np.zeros(0, np.int64)] * len(qid), [np.zeros(0)] * len(qid)
        least = np.full(len(qid), floor)
        for b in batches:
            ids = b["shot_id"].to_numpy()
            for i, Y in held.pieces(_matrix(b["emb"])):
                some = ids[i:i + len(Y)]
                S = held.scores(Y, least).T
                S[skip[:, None] == some[None, :]] = -np.inf
                hit = np.flatnonzero((S >= least[:, None]).any(axis=1))
                for r, top in zip(hit.tolist(), _best(S[hit], some, k, floor, margin)):
                    x, y = np.concatenate([best_id[r], some[top]]), np.concatenate([best_sc[r], S[r, top]])
                    o = np.lexsort((x, -y))[:k]
                    o = o[y[o] >= y[o[0]] - margin] if len(o) else o
                    best_id[r], best_sc[r] = x[o], y[o]
                    if len(o):                          # what a later shot has to reach
                        least[r] = max(floor, y[o[0]] - margin, y[o[-1]] if len(o) == k else -np.inf)
        n = [len(x) for x in best_id]
        if sum(n):
            yield pd.DataFrame({"query_id": np.repeat(qid, n), "shot_id": np.concatenate(best_id), "score": np.concatenate(best_sc)})
    return run


def _pair_scores(X, Y, rows, columns):
    """Dot products of Y[rows] with X[columns], each worked out the same way wherever it stands: equal vectors get equal scores."""
    out = np.empty(len(rows))
    for i in range(0, len(rows), PAIRS):
        out[i:i + PAIRS] = np.einsum("ij,ij->i", Y[rows[i:i + PAIRS]], X[columns[i:i + PAIRS]])
    return out


def _best_of_all(S, X, Y, k, floor, margin):
    """(row, column, score, rank from 1) of the k best columns of each row, best first, ties by column; S = Y @ X.T, -inf where a pair is left out.

    The k-th largest of the maxima of interleaved columns is at most the k-th largest value, so what lies below it is out.
    """
    n = S.shape[1]
    parts = max(8 * k, 1024)
    cut = np.full(len(S), -np.inf)
    if n > 2 * parts:
        top = S[:, :parts].copy()
        for i in range(parts, n, parts):
            np.maximum(top[:, :n - i], S[:, i:i + parts], out=top[:, :n - i])
        best = top.max(axis=1)
        cut = np.partition(top, parts - k, axis=1)[:, parts - k]
    else:
        best = S.max(axis=1) if n else cut
    cut = np.maximum(np.maximum(floor, best - margin), cut) - SLACK
    rows, columns = np.nonzero(S >= np.maximum(cut, np.finfo(float).min)[:, None])
    score = _pair_scores(X, Y, rows, columns)
    order = np.lexsort((columns, -score, rows))
    rows, columns, score = rows[order], columns[order], score[order]
    first = np.searchsorted(rows, np.arange(len(S)))
    rank = np.arange(len(rows)) - first[rows]
    keep = (rank < k) & (score >= floor) & (score >= score[first[rows]] - margin)
    return rows[keep], columns[keep], score[keep], rank[keep] + 1


def _shots_held(ids, X, basis, k, floor, margin):
    """mapInPandas body over queries: k best shots of the slice for each, with rank."""
    order = np.argsort(ids, kind="stable")              # ties go to the smaller id
    ids, X = ids[order], X[order]

    def run(batches):
        held = Bounded(X, basis)
        for b in batches:
            qid, skip = b["query_id"].to_numpy(), b["skip_id"].to_numpy()
            at = np.minimum(np.searchsorted(ids, skip), len(ids) - 1)
            own = np.flatnonzero(ids[at] == skip)
            for i, Y in held.pieces(_matrix(b["qe"])):
                S = held.scores(Y, floor)
                mine = own[(own >= i) & (own < i + len(Y))]
                S[mine - i, at[mine]] = -np.inf
                r, c, score, rank = _best_of_all(S, X, Y, k, floor, margin)
                if len(r):
                    yield pd.DataFrame({"query_id": qid[i + r], "shot_id": ids[c], "score": score, "rank": rank.astype(np.int32)})
    return run


SCORED = "query_id long, shot_id long, score double"


def _sliced(df: DataFrame, key: str, rows: int, at_most: int):
    """The rows of df, collected at most about `at_most` at a time, in parts by the hash of `key`."""
    many = max(1, math.ceil(rows / at_most))
    for i in range(many):
        part = df if many == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(many)) == i)
        found = part.collect()
        if found:
            yield found


def _spread(df: DataFrame) -> DataFrame:
    """df in enough partitions to keep all cores busy, where it comes in fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _k_best(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; many tasks' rows are thinned out in two steps."""
    part = W.partitionBy("query_id", F.pmod(F.xxhash64("shot_id"), F.lit(64))).orderBy(F.desc("score"), "shot_id")
    thin = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("rank")
    return thin.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "shot_id"))).where(F.col("rank") <= k)


def dense_topk(queries: DataFrame, shots: DataFrame, k: int = 500, floor: float = -np.inf, margin: float = np.inf,
               slice_bytes: int = SLICE_BYTES, lead: int = LEAD, held_bytes: int | None = None) -> DataFrame:
    """k best shots per query by dot product, with rank. queries(query_id, qe[, skip_id]); shots(shot_id, emb).

    Apply shot filters to `shots` before calling: they then reach the scan and shrink the product. A caller that gates the
    result passes the gate's floor and margin (widened by any later bonus): rows that can never pass are then not shuffled.
    Shots are sent in slices of at most `slice_bytes` and queries stream past, or the other way round where queries are few; neither side is shuffled by key.
    Shots of at most `held_bytes` stay in the tasks and give final ranks in the task that reads the query: nothing is shuffled, and the caller cuts the lineage if it reads the result twice.
    More shots are sent one slice after the other, and the answers are merged between slices.
    """
    if "skip_id" not in queries.columns:
        queries = queries.withColumn("skip_id", F.lit(-1).cast("long"))
    q = queries.select(F.col("query_id").cast("long"), "qe", F.coalesce("skip_id", F.lit(-1)).cast("long").alias("skip_id"))
    s = shots.select(F.col("shot_id").cast("long"), "emb")
    spark = s.sparkSession
    n, dim = q.agg(F.count("*"), F.coalesce(F.max(F.size("qe")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], SCORED + ", rank int")
    at_most = max(1, slice_bytes // (8 * max(dim, 1)))
    m = s.count()
    basis = None if n * FEW >= m and held_shots.fits(m, dim, held_bytes) else directions(s.withColumnRenamed("shot_id", "id"), dim, lead)
    best = None
    if n * FEW < m:
        few = n <= min(at_most, TASK_ENTRIES // k)
        stream = _spread(s)
        for rows in _sliced(q, "query_id", n, min(at_most, max(1, TASK_ENTRIES // k))):
            held = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows], np.int64), basis))
            new = _k_best(stream.mapInPandas(lambda it, held=held: _queries_held(*held.value, k, floor, margin)(it), SCORED), k)
            if not few:
                new = session.cut_lineage(new)
                held.destroy()
            best = new if best is None else best.unionByName(new)
    else:
        held = held_shots.hold(s, slice_bytes=slice_bytes, held_bytes=held_bytes)
        if held:
            return held_shots.each(q, held, k, floor, margin, lambda h, b, r, c, score, rank: pd.DataFrame(
                {"query_id": b["query_id"].to_numpy()[r], "shot_id": h.column("shot_id")[c], "score": score, "rank": rank.astype(np.int32)}), SCORED + ", rank int")
        stream = _spread(q)
        one = m <= at_most
        for rows in _sliced(s, "shot_id", m, at_most):
            held = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64), basis))
            new = stream.mapInPandas(lambda it, held=held: _shots_held(*held.value, k, floor, margin)(it), SCORED + ", rank int")
            if one:
                return new
            best = session.cut_lineage(_k_best((new if best is None else new.unionByName(best)).drop("rank"), k))
            held.destroy()
        if best is None:
            return spark.createDataFrame([], SCORED + ", rank int")
    if margin == np.inf:
        return best
    # tasks know their own best only: the margin holds against the query's best of all
    top = F.max("score").over(W.partitionBy("query_id"))
    return best.withColumn("top", top).where(F.col("score") >= F.col("top") - margin).drop("top")


# ---------------------------------------------------------------------------------------------- threshold joins
def _hits(held, held_ord, swapped, sim, mode, before, same, basis):
    """mapInPandas body over the streamed side; `held` is a slice (ids, vectors) of the other one, which is the left side if `swapped`."""
    hid, X = held

    def run(batches):
        side, marked = Bounded(X, basis), np.zeros(len(hid), bool)
        for b in batches:
            mine = b["id"].to_numpy()
            for i, Y in side.pieces(_matrix(b["emb"])):
                some = mine[i:i + len(Y)]
                S = side.scores(Y, sim)
                hit = S > sim
                if same:
                    hit &= some[:, None] != hid[None, :]
                if before:
                    own, other = b["ord"].to_numpy()[i:i + len(Y), None], held_ord[None, :]
                    hit &= own < other if swapped else other < own
                if mode == "pairs":
                    r, c = np.nonzero(hit)
                    left, right = (hid[c], some[r]) if swapped else (some[r], hid[c])
                    yield pd.DataFrame({"id": left, "other": right, "cos": S[r, c]})
                elif swapped:
                    marked |= hit.any(axis=0)
                else:
                    found = some[hit.any(axis=1)]
                    yield pd.DataFrame({"id": found, "other": np.full(len(found), -1, np.int64), "cos": np.zeros(len(found))})
        if marked.any():
            yield pd.DataFrame({"id": hid[marked], "other": np.full(int(marked.sum()), -1, np.int64), "cos": np.zeros(int(marked.sum()))})
    return run


def _threshold(left, right, sim, mode, before=False, same=True, lead=LEAD, block_rows=None):
    """left/right(id, emb[, ord]), unit vectors. Every pair with cosine > sim; slices have at most block_rows rows and SLICE_BYTES."""
    cols = ["id", "emb"] + (["ord"] if before else [])
    left, right = left.select(*cols), right.select(*cols)
    spark = left.sparkSession
    measured = [d.agg(F.count("*"), F.coalesce(F.max(F.size("emb")), F.lit(0))).first() for d in (left, right)]
    swapped = measured[0][0] < measured[1][0]
    small, large = (left, right) if swapped else (right, left)
    n, dim = measured[0] if swapped else measured[1]
    schema = "id long, other long, cos double"
    out = None
    basis = directions(small, dim, lead) if n else None
    at_most = min(block_rows or n or 1, max(1, SLICE_BYTES // (8 * max(dim, 1))))
    stream = _spread(large) if n else large
    for rows in _sliced(small, "id", n, at_most) if n else ():
        held = spark.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), np.array([r["emb"] for r in rows], np.float64), np.array([r["ord"] for r in rows]) if before else None))
        new = stream.mapInPandas(lambda it, held=held: _hits(held.value[:2], held.value[2], swapped, sim, mode, before, same, basis)(it), schema)
        if n > at_most:
            new = session.cut_lineage(new)
            held.destroy()
        out = new if out is None else out.unionByName(new)
    return spark.createDataFrame([], schema) if out is None else out


def similar_pairs(left: DataFrame, right: DataFrame, sim: float, **kw) -> DataFrame:
    """(id, other, cos) for every pair with cosine > sim; same=False when the two sides have separate id spaces.

    Output grows with the number of matches: use where matches per row are few, and has_similar otherwise.
    """
    return _threshold(left, right, sim, "pairs", **kw)


def has_similar(left: DataFrame, right: DataFrame, sim: float, before: bool = False, **kw) -> DataFrame:
    """Ids of left rows with at least one right row over `sim` (earlier in `ord` when before=True). One row per id."""
    return _threshold(left, right, sim, "exists", before, **kw).select("id").distinct()


def first_come_independent(items: DataFrame, sim: float, **kw) -> DataFrame:
    """Rows kept by first-come near-duplicate removal: a row goes when an earlier *kept* row has cosine > sim.

    items(id, emb, ord), ord unique. Works in rounds on flags only: rows without an earlier open neighbour are kept, rows
    with a kept earlier neighbour go. Exact copies are folded into their first row beforehand (they share its fate:
    either that row is kept and covers them, or what removed it removes them too), so a mass of copies costs one row.
    """
    first = items.groupBy("emb").agg(F.min_by("id", "ord").alias("id"), F.min("ord").alias("ord"))
    open_ = session.cut_lineage(first.select("id", "emb", "ord"))
    kept = None
    while True:
        blocked = has_similar(open_, open_, sim, before=True, **kw)
        fresh = session.cut_lineage(open_.join(blocked, "id", "left_anti"))
        kept = fresh if kept is None else kept.unionByName(fresh)
        rest = open_.join(fresh.select("id"), "id", "left_anti")
        covered = has_similar(rest, fresh, sim, before=True, **kw)
        open_ = session.cut_lineage(rest.join(covered, "id", "left_anti"))
        if open_.isEmpty():
            return kept.select("id")
