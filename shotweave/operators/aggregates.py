"""Aggregates: embeddings, motion, cut features, reports, evaluation."""
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import fixed, vector
from .ordered import neighbour, running_totals


def mean_embedding(df: DataFrame, by: str, emb: str = "emb") -> DataFrame:
    """Unit mean vector per key. Each Arrow batch is summed per key first, so a hot key shuffles one row a batch."""
    key_type = df.schema[by].dataType.simpleString()

    def partial(batches):
        for b in batches:
            if len(b):
                code, keys = pd.factorize(b[by], use_na_sentinel=False)
                X = np.stack(b[emb].to_numpy()).astype(np.float64)
                total = np.zeros((len(keys), X.shape[1]))
                np.add.at(total, code, X)
                yield pd.DataFrame({by: keys, "s": list(total), "n": np.bincount(code, minlength=len(keys)).astype("int64")})

    sums = (df.select(by, F.col(emb).alias(emb)).mapInPandas(partial, f"{by} {key_type}, s array<double>, n long")
            .select(by, "n", F.posexplode("s").alias("pos", "x"))
            .groupBy(by, "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n")))
    return (sums.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("x") / F.col("n")).alias("x")))).alias("v"),
                                 F.max("n").alias("n"))
            .select(by, vector.unit(F.transform("v", lambda e: e["x"])).alias("emb"), "n"))


def weighted_mean_embedding(df: DataFrame, by, emb: str, n: str, order: str) -> DataFrame:
    """Fold vectors in order, each weighted by its frame count and normalised again after every step; a key with one row keeps its vector as it is.

    A step depends on the whole result before it, so a key is folded where its rows lie, sorted, as they stream past: one vector and one count are carried from batch
    to batch and no list is gathered. Equal orders are settled by vector and count, a null key is a key like others. Vectors must be of one length.
    """
    by = [by] if isinstance(by, str) else list(by)

    def fold(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            rows = t.num_rows
            new = np.ones(rows, bool)
            new[1:] = False
            for c in range(len(by)):
                a, z = t.column(c)[1:], t.column(c)[:-1]
                new[1:] |= np.asarray(pc.fill_null(pc.not_equal(a, z), False)) | (np.asarray(pc.is_null(a)) != np.asarray(pc.is_null(z)))
            heads = np.flatnonzero(new)
            X, w = t.column(len(by)).flatten().to_numpy(zero_copy_only=False).reshape(rows, -1), t.column(len(by) + 1).to_numpy(zero_copy_only=False)
            E, N, size = X[heads], w[heads], np.diff(np.append(heads, rows))
            for k in range(1, size.max()):                               # the k-th rows of all keys at once
                g = np.flatnonzero(size > k)
                r = heads[g] + k
                v = E[g] * N[g, None] + X[r] * w[r, None]
                E[g], N[g] = v / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None], N[g] + w[r]
            vectors = pa.ListArray.from_arrays(np.arange(len(heads) + 1, dtype="int32") * X.shape[1], E.ravel()).cast(t.schema.field(len(by)).type)
            out = pa.RecordBatch.from_arrays([*[t.column(c).take(pa.array(heads)) for c in range(len(by))], vectors, pa.array(N)], schema=t.schema)
            held = out.slice(len(heads) - 1)
            yield out.slice(0, len(heads) - 1)
        if held is not None:
            yield held

    d = df.select(*by, F.col(emb).cast("array<double>").alias(emb), F.col(n).cast("double").alias(n), F.col(order).alias("__o"))
    d = d.repartition(*by).sortWithinPartitions(*by, "__o", emb, n).drop("__o")
    return d.mapInArrow(fold, d.schema).withColumn(n, F.col(n).cast("long"))


def grey_change(a, b):
    """Mean absolute difference of two grey sample arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def motion_level(samples: DataFrame, by, t: str = "t", value: str = "grey", still: float = 4.0, action: float = 12.0,
                 chunk_s: float = 3600.0) -> DataFrame:
    """Mean change between consecutive samples of a shot, and its level. value is a number or an array of numbers."""
    by = [by] if isinstance(by, str) else list(by)
    d = neighbour(samples, by, F.floor(F.col(t) / chunk_s), [t], {"__prev": F.col(value)}, step=-1)
    arr = samples.schema[value].dataType.typeName() == "array"
    diff = grey_change(F.col(value), F.col("__prev")) if arr else F.abs(F.col(value) - F.col("__prev"))
    out = d.withColumn("__d", diff).groupBy(*by).agg(F.coalesce(F.avg("__d"), F.lit(0.0)).alias("motion_score"))
    return out.withColumn("motion", F.when(F.col("motion_score") < still, "still")
                          .when(F.col("motion_score") < action, "moderate").otherwise("action"))


def motion_peak(samples: DataFrame, shots: DataFrame, min_change: float = 1.0) -> DataFrame:
    """Midpoint of the largest change between consecutive samples above min_change; the middle of the shot otherwise.

    samples(shot_id, t, value), at most ten per shot as sampled; ties go to the earlier pair.
    """
    d = neighbour(samples, "shot_id", F.floor(F.col("t") / 3600), ["t"], {"nt": F.col("t"), "nv": F.col("value")})
    d = d.withColumn("change", F.abs(F.col("nv") - F.col("value"))).where(F.col("change") > min_change)
    peak = d.groupBy("shot_id").agg(F.max_by((F.col("t") + F.col("nt")) / 2, F.struct("change", -F.col("t"))).alias("p"))
    return (shots.select("shot_id", "t_start", "t_end").join(peak, "shot_id", "left")
            .select("shot_id", F.coalesce("p", (F.col("t_start") + F.col("t_end")) / 2).alias("peak_t")))


def head_tail_features(frame_stats: DataFrame, shots: DataFrame, win: float = 0.3, min_len: float = 0.1) -> DataFrame:
    """Luma and warmth of a shot's first and last frame, flow across its first and last `win` seconds, saliency of the frame nearest the middle.

    frame_stats(shot_id, t, luma, warmth, dx, dy, sal_x, sal_y), dx and dy being the shift since the frame before, so the flow between two frames is the sum of the
    shifts after the first up to the second. Shots shorter than min_len, or without frames, have no features.
    """
    s = shots.where(F.col("t_end") - F.col("t_start") >= min_len).select("shot_id", "t_start", "t_end")
    t = F.col("t")
    j = s.join(frame_stats, "shot_id").where(t.between(F.col("t_start"), F.col("t_end")))
    head = (t > F.col("t_start")) & (t <= F.col("t_start") + win)
    tail = (t > F.col("t_end") - win) & (t > F.col("t_start"))
    mid = F.struct(F.abs(t - (F.col("t_start") + F.col("t_end")) / 2), "t")
    return j.groupBy("shot_id").agg(
        *[pick(c, "t").alias(f"{name}_{c}") for name, pick in (("head", F.min_by), ("tail", F.max_by)) for c in ("luma", "warmth")],
        *[F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0.0)).alias(f"{name}_{c}") for name, side in (("head", head), ("tail", tail)) for c in ("dx", "dy")],
        F.min_by("sal_x", mid).alias("sal_x"), F.min_by("sal_y", mid).alias("sal_y"))


def approx_features(thumbs: DataFrame, shots: DataFrame, have: DataFrame) -> DataFrame:
    """Thumbnail features for active shots without a file and without features: head = tail, no flow, approx."""
    todo = shots.where("active AND file_id IS NULL").select("shot_id").join(have.select("shot_id"), "shot_id", "left_anti")
    z = F.lit(0.0)
    return todo.join(thumbs, "shot_id").select(
        "shot_id", z.alias("head_dx"), z.alias("head_dy"), z.alias("tail_dx"), z.alias("tail_dy"),
        F.col("luma").alias("head_luma"), F.col("luma").alias("tail_luma"), F.col("warmth").alias("head_warmth"),
        F.col("warmth").alias("tail_warmth"), "sal_x", "sal_y", F.lit(None).cast("double").alias("peak_t"), F.lit(True).alias("approx"))


def licence_summary(plan: DataFrame, by: str = "script_id") -> DataFrame:
    """Per script: count per licence class, the picks that are not commercially safe, and whether all are."""
    counts = plan.groupBy(by, "licence_class").agg(F.count("*").alias("n"))
    unsafe = ~F.col("licence_class").isin(*fixed.COMMERCIAL_CLASSES)
    a = counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("licence_class", "n")))).alias("counts"))
    b = plan.groupBy(by).agg(F.array_sort(F.collect_list(F.when(unsafe, F.struct("beat_i", "shot_id", "licence_class")))).alias("unsafe"),
                             (F.count_if(unsafe) == 0).alias("commercial_ok"))
    return a.join(b, by)


def missing_variety(cands: DataFrame, sizes=("wide", "medium", "close"), min_rows: int = 3) -> DataFrame:
    """Shot sizes absent among a query's relevant rows, for queries with enough rows."""
    g = cands.groupBy("query_id").agg(F.count("*").alias("n"), F.collect_set("size").alias("have"))
    miss = F.array_except(F.lit(list(sizes)), F.col("have"))
    return g.select("query_id", F.when(F.col("n") >= min_rows, miss).otherwise(F.array().cast("array<string>")).alias("missing"))


def ablation(plans: DataFrame) -> DataFrame:
    """plans(config, script_id, clips, contradictions, problems, same_size, progress, close, mean_rel): per config and overall."""
    sums = [F.sum(c).alias(c) for c in ("clips", "contradictions", "problems", "same_size", "progress")]
    return plans.rollup("config").agg(*sums, F.avg("mean_rel").alias("mean_rel"),
                                      (F.sum("close") / F.greatest(F.sum("clips"), F.lit(1))).alias("close_share")) \
        .withColumn("config", F.coalesce("config", F.lit("all")))


def weight_sweep(plans: DataFrame) -> DataFrame:
    """plans(weight, script_id, g_problems, c_problems, g_rel, c_rel): problem reduction and relevance loss per weight."""
    a = plans.groupBy("weight").agg(F.sum("g_problems").alias("g_problems"), F.sum("c_problems").alias("c_problems"),
                                    F.avg("g_rel").alias("g_rel"), F.avg("c_rel").alias("c_rel"))
    return a.select("weight", "g_problems", "c_problems", "g_rel", "c_rel",
                    F.when(F.col("g_problems") > 0, 1 - F.col("c_problems") / F.col("g_problems")).otherwise(0.0).alias("reduction"),
                    F.when(F.col("g_rel") != 0, (F.col("g_rel") - F.col("c_rel")) / F.col("g_rel")).otherwise(0.0).alias("rel_loss"))


def balanced_accuracy(scores: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Best balanced accuracy over every threshold of every unique score (predict 1 when score >= threshold).

    Equal scores are merged first, then counts are accumulated over range partitions of the scores: no single task sees the whole order.
    """
    per = scores.groupBy(F.col(score).alias("thr")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    cum = running_totals(per, [F.desc("thr")], tp=F.col("p"), pn=F.col("n")).withColumn("neg", -F.col("thr"))
    tot = per.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    P, N = F.col("all_p"), F.col("all_n")
    bal = (F.col("tp") / P + (N - P - (F.col("pn") - F.col("tp"))) / (N - P)) / 2
    # of equal accuracies the lowest threshold is reported
    return cum.join(F.broadcast(tot), F.lit(True)).withColumn("bal", F.round(bal, 12)).agg(
        F.max("bal").alias("accuracy"), F.max_by("thr", F.struct("bal", "neg")).alias("threshold"))


def argmax_label(df: DataFrame, by: str, label: str, score: str) -> DataFrame:
    return df.groupBy(by).agg(F.max_by(label, F.struct(F.col(score), F.col(label))).alias("label"), F.max(score).alias("score"))
