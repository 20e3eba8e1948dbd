"""Shot segmentation from per-second samples: batch by windows, stream by keyed state."""
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import vector
from ..operators.aggregates import weighted_mean_embedding
from ..operators.ordered import neighbour, running
from ..operators.walks import greedy_walk
from ..session import cut_lineage

SHOT = "file_id long, t_start double, t_end double, emb array<double>, n long"


def segment_shots(samples: DataFrame, cut_sim: float = 0.82, window_s: float = 4.0, step: float = 1.0) -> DataFrame:
    """samples(file_id, t, emb) at even spacing -> shots: cut where neighbours differ or the window is full.

    The window restarts at every visual cut, so the shot number is the position inside a run divided by the window's samples.
    """
    hour = F.floor(F.col("t") / 3600)
    d = neighbour(samples, "file_id", hour, ["t"], {"__p": F.col("emb")}, step=-1)
    d = d.withColumn("__cut", (F.col("__p").isNull() | (vector.dot(F.col("__p"), F.col("emb")) < cut_sim)).cast("long"))
    d = running(d.drop("__p"), "file_id", hour, ["t"], run=("sum", F.col("__cut")), pos=("sum", F.lit(1).cast("long")))
    d = running(d, "file_id", hour, ["t"], start_pos=("max", F.when(F.col("__cut") == 1, F.col("pos"))))
    per = max(1, math.ceil(window_s / step - 1e-9))
    d = d.withColumn("part", F.floor((F.col("pos") - F.col("start_pos")) / per))
    # at most `per` samples meet in one group
    g = d.groupBy("file_id", "run", "part").agg(F.min("t").alias("t_start"), (F.max("t") + step).alias("t_end"),
                                                F.collect_list("emb").alias("e"), F.count("*").alias("n"))
    total = F.aggregate(F.slice("e", F.lit(2), F.greatest(F.size("e") - 1, F.lit(0))), F.get("e", F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / F.col("n"))
    return g.select("file_id", "t_start", "t_end", vector.unit(mean).alias("emb"), "n")


def segment_irregular(samples: DataFrame, cut_sim: float = 0.82, window_s: float = 4.0, step: float = 1.0) -> DataFrame:
    """The same for uneven sample times. Inside a run between visual cuts a greedy walk finds where a window is full, so a long run is many tasks."""
    hour = F.floor(F.col("t") / 3600)
    d = neighbour(samples, "file_id", hour, ["t"], {"__p": F.col("emb")}, step=-1)
    d = d.withColumn("__cut", (F.col("__p").isNull() | (vector.dot(F.col("__p"), F.col("emb")) < cut_sim)).cast("long"))
    d = cut_lineage(running(d.drop("__p"), "file_id", hour, ["t"], run=("sum", F.col("__cut"))).select("file_id", "run", "t", "emb"))
    d = d.join(greedy_walk(d, ["file_id", "run"], "t", window_s), ["file_id", "run", "t"])
    spans = d.groupBy("file_id", F.col("kept").alias("t_start"), "run").agg((F.max("t") + step).alias("t_end"), F.count("*").alias("n"))
    # sums by component are added up before the shuffle, so the samples of a window are never gathered
    parts = d.select("file_id", F.col("kept").alias("t_start"), "run", F.posexplode("emb").alias("pos", "x")).groupBy("file_id", "t_start", "run", "pos").agg(F.avg("x").alias("x"))
    mean = parts.groupBy("file_id", "t_start", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    shots = spans.join(mean, ["file_id", "t_start", "run"])
    return shots.select("file_id", "t_start", "t_end", vector.unit(F.transform("v", lambda e: e["x"])).alias("emb"), "n")


def _close(file_id, ts, total, n, step):
    m = total / n
    return {"file_id": file_id, "t_start": ts[0], "t_end": ts[1] + step, "emb": m / max(np.linalg.norm(m), 1e-9), "n": n}


def merge_short(shots: DataFrame, durations: DataFrame | None = None, min_s: float = 1.0) -> DataFrame:
    """Cap shots at the file's end, then fold shots shorter than min_s into the one before (weighted mean vector)."""
    d = shots
    if durations is not None:
        d = d.join(durations, "file_id", "left").withColumn("t_end", F.least("t_end", F.coalesce("duration", "t_end"))).drop("duration")
    hour = F.floor(F.col("t_start") / 3600)
    first = neighbour(d, "file_id", hour, ["t_start"], {"__before": F.col("t_start")}, step=-1)
    opens = F.col("__before").isNull() | (F.col("t_end") - F.col("t_start") >= min_s)
    d = running(first, "file_id", hour, ["t_start"], g=("sum", opens.cast("long")))
    spans = d.groupBy("file_id", "g").agg(F.min("t_start").alias("t_start"), F.max_by("t_end", "t_start").alias("t_end"))
    return spans.join(weighted_mean_embedding(d, ["file_id", "g"], "emb", "n", "t_start"), ["file_id", "g"]).drop("g")


def picture_cuts(hist: DataFrame, thr: float = 0.45, min_shot: float = 0.8) -> DataFrame:
    """hist(video_id, t, h array, sums to 1): times where the histogram changes, at least min_shot after the cut before. The video's start counts as a cut."""
    hour = F.floor(F.col("t") / 3600)
    d = neighbour(hist, "video_id", hour, ["t"], {"__p": F.col("h")}, step=-1)
    bc = F.aggregate(F.zip_with("h", "__p", lambda a, b: F.sqrt(a * b)), F.lit(0.0), lambda s, v: s + v)
    c = d.where(F.col("__p").isNotNull() & (F.sqrt(F.greatest(1 - bc, F.lit(0.0))) > thr)).select("video_id", "t")
    return greedy_walk(c, "video_id", "t", min_shot, start=0.0).where("t = kept").select("video_id", F.round("t", 2).alias("cut"))


def segment_stream(samples: DataFrame, cut_sim: float = 0.82, window_s: float = 4.0, step: float = 1.0) -> DataFrame:
    """Streaming segmentation: the open shot of every file is keyed state; the file's final sample (last = true) closes it.

    samples(file_id, t, emb, last). No timers: in processing-time mode an availableNow run would never end.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class OpenShot(StatefulProcessor):
        def init(self, handle):
            self.state = handle.getValueState("open", "t0 double, t1 double, total array<double>, last array<double>, n long")

        def handleInputRows(self, key, rows, timerValues):
            open_ = self.state.get() if self.state.exists() else None
            cur = None if open_ is None else [open_[0], open_[1], np.array(open_[2]), np.array(open_[3]), open_[4]]
            out = []
            p = pd.concat(list(rows)).sort_values("t")
            for t, e, last in zip(p["t"].to_numpy(), p["emb"].to_numpy(), p["last"].to_numpy()):
                if cur is not None and (float(cur[3] @ e) < cut_sim or t - cur[0] >= window_s):
                    out.append(_close(key[0], (cur[0], cur[1]), cur[2], cur[4], step))
                    cur = None
                cur = [t, t, e.copy(), e, 1] if cur is None else [cur[0], t, cur[2] + e, e, cur[4] + 1]
                if last:
                    out.append(_close(key[0], (cur[0], cur[1]), cur[2], cur[4], step))
                    cur = None
            if cur is None:
                self.state.clear()
            else:
                self.state.update((float(cur[0]), float(cur[1]), cur[2].tolist(), cur[3].tolist(), int(cur[4])))
            yield pd.DataFrame(out, columns=["file_id", "t_start", "t_end", "emb", "n"])

        def close(self):
            pass
    return samples.groupBy("file_id").transformWithStateInPandas(OpenShot(), SHOT, "Append", "None")
