"""Greedy walks along time: keep a time, then the next one that lies at least a gap after it, and so on.

The rule looks sequential, but a block of times only maps the last time kept before it to the last time kept in it. Such maps are short (they
differ only for times within one gap of the block's start), compose associatively, and give a scan: blocks of 4,096 times are mapped
on their own, 256 maps at a time are composed upwards, and the last time kept is handed down again. A key with a third of all rows is therefore as many
tasks as it has blocks, and no task holds more than 256 maps of one key.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..session import cut_lineage
from .ordered import numbered

BLOCK, FAN = 4096, 256


def _first(at, last, gap):
    """Index of the first of the sorted `at` with at - last >= gap, for each of `last`; the difference decides, not the rounded sum."""
    last, n = np.asarray(last, float), len(at)
    j = np.searchsorted(at, last + gap)
    while (early := (j > 0) & (at[np.maximum(j - 1, 0)] - last >= gap)).any():
        j = j - early
    while (late := (j < n) & (at[np.minimum(j, n - 1)] - last < gap)).any():
        j = j + late
    return j


def _through(at, to, last, gap):
    """Last time kept after a block with the map (at, to), when `last` was kept before it."""
    j = _first(at, last, gap)
    return np.where(j < len(at), to[np.minimum(j, len(at) - 1)], last)


def _short(at, to, lo, gap):
    """The same map without what no earlier time reaches (all times before lo enter by the first one a gap after lo), one row per exit."""
    reach = int(_first(at, lo, gap)) + 1
    at, to = at[:reach], to[:reach]
    keep = np.append(to[1:] != to[:-1], True)
    return at[keep], to[keep]


def block_map(ts, gap):
    """Map of one block: time by which it is entered -> last time kept in it, by doubling the pointers to the next kept time."""
    n = len(ts)
    nxt = _first(ts, ts, gap)
    hop = np.where(nxt < n, nxt, np.arange(n))
    while (further := hop[hop]).tolist() != hop.tolist():
        hop = further
    return _short(ts, ts[hop], ts[0], gap)


def composed(los, ats, tos, gap):
    """One map for consecutive blocks."""
    at, to = ats[0], tos[0]
    for a, b in zip(ats[1:], tos[1:]):
        past = _through(a, b, to, gap)
        at, to = _short(np.append(at, a), np.append(past, b), los[0], gap)
    return at, to


def settled(ts, last, gap):
    """For each time of a block the kept time it belongs to, itself where it is kept."""
    nxt, kept, j = _first(ts, ts, gap), [], int(_first(ts, last, gap))
    while j < len(ts):
        kept.append(j)
        j = int(nxt[j])
    at = np.searchsorted(kept, np.arange(len(ts)), side="right")
    return np.append(last, ts[kept])[at]


def _floats(xs):
    return [np.asarray(x, float) for x in xs]


def greedy_walk(df: DataFrame, by, t: str, gap: float, start: float | None = None) -> DataFrame:
    """(by, t, kept) per distinct time of a key: the last time kept up to t, t itself where it is kept.

    The first time is kept, or with `start` the first one a gap after it; times before that have kept = start. Later times are kept when t minus the
    last one kept is at least gap (> 0). Null and NaN times give no row, a null key is a key like others, an empty table gives no rows.
    Memory of a task grows with the distinct times inside one gap.
    """
    if gap <= 0:
        raise ValueError("gap must be positive")
    by = [by] if isinstance(by, str) else list(by)
    edge = "at array<double>, to array<double>"

    @pandas_udf(edge)
    def mapped(ts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([block_map(np.asarray(x, float), gap) for x in ts], columns=["at", "to"])

    @pandas_udf(edge)
    def joined(lo: pd.Series, at: pd.Series, to: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([composed(l, _floats(a), _floats(b), gap) for l, a, b in zip(lo, at, to)], columns=["at", "to"])

    @pandas_udf("array<double>")
    def entered(last: pd.Series, at: pd.Series, to: pd.Series) -> pd.Series:
        out = []
        for l, a, b in zip(last, at, to):
            ls = [l]
            for x, y in zip(_floats(a[:-1]), _floats(b[:-1])):
                ls.append(float(_through(x, y, ls[-1], gap)))
            out.append(np.array(ls))
        return pd.Series(out)

    @pandas_udf("array<double>")
    def kept(ts: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([settled(np.asarray(x, float), l, gap) for x, l in zip(ts, last)])

    times = df.select(F.struct(*by).alias("__k"), F.col(t).cast("double").alias("__t")).where("__t IS NOT NULL AND NOT isnan(__t)").distinct()
    soon = None
    if start is not None:
        soon = times.where(F.col("__t") - F.lit(float(start)) < gap).select("__k.*", F.col("__t").alias(t), F.lit(float(start)).alias("kept"))
        times = times.where(F.col("__t") - F.lit(float(start)) >= gap)
    d = numbered(times, "__k", ["__t"], "__n")
    blocks = cut_lineage(d.groupBy("__k", F.floor((F.col("__n") - 1) / BLOCK).alias("__c")).agg(F.array_sort(F.collect_list("__t")).alias("ts")))
    level = blocks.select("__k", "__c", F.get("ts", F.lit(0)).alias("lo"), mapped("ts").alias("m")).select("__k", "__c", "lo", "m.*")
    top, ups = blocks.agg(F.max("__c")).first()[0] or 0, []
    while top > 0:
        fan = level.groupBy("__k", F.floor(F.col("__c") / FAN).alias("__p")).agg(F.array_sort(F.collect_list(F.struct("__c", "lo", "at", "to"))).alias("m"))
        ups.append(cut_lineage(fan.withColumnRenamed("__p", "__c")))
        level = (ups[-1].select("__k", "__c", F.get("m.lo", F.lit(0)).alias("lo"), joined("m.lo", "m.at", "m.to").alias("j")).select("__k", "__c", "lo", "j.*"))
        top //= FAN
    last = level.select("__k", "__c", F.lit(float("-inf")).alias("last"))
    for up in reversed(ups):
        handed = up.join(last, ["__k", "__c"]).select("__k", F.arrays_zip(F.col("m.__c").alias("c"), entered("last", "m.at", "m.to").alias("l")).alias("z"))
        last = handed.select("__k", F.explode("z").alias("z")).select("__k", F.col("z.c").alias("__c"), F.col("z.l").alias("last"))
    out = blocks.join(last, ["__k", "__c"]).select("__k", F.explode(F.arrays_zip("ts", kept("ts", "last").alias("first"))).alias("z"))
    out = out.select("__k.*", F.col("z.ts").alias(t), F.col("z.first").alias("kept"))
    return out if soon is None else out.unionByName(soon)
