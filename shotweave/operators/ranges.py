"""Range joins as equi-joins on time bins: no pair is formed that does not share a bin."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _bins(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(F.greatest(lo, hi) / width))


def interval_pairs(left: DataFrame, right: DataFrame, on, l_lo: str, l_hi: str, r_lo: str, r_hi: str,
                   width: float, how: str = "inner") -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals meet. Column names of both sides must differ except `on`.

    Both sides are exploded over the bins they touch; a pair is kept in the first bin both touch, so it appears once.
    """
    on = [on] if isinstance(on, str) else list(on)
    lb = left.withColumn("__b", F.explode(_bins(F.col(l_lo), F.col(l_hi), width)))
    rb = right.withColumn("__b", F.explode(_bins(F.col(r_lo), F.col(r_hi), width)))
    first = F.greatest(F.floor(F.col(l_lo) / width), F.floor(F.col(r_lo) / width))
    meet = (F.col(l_lo) <= F.col(r_hi)) & (F.col(r_lo) <= F.col(l_hi))
    return lb.join(rb, [*on, "__b"], how).where(meet & (F.col("__b") == first)).drop("__b")


def nearest(left: DataFrame, right: DataFrame, on, lt: str, rt: str, value: str, max_dt: float | None = None,
            chunk_s: float = 3600.0) -> DataFrame:
    """For each left row the right row nearest in time (both directions, the earlier one on a tie).

    Both sides are put on one time line and filled forward and backward, so no pairs are formed at all.
    Adds `near_t` and `near_value`; null when the key has no right row or none within max_dt.
    """
    on = [on] if isinstance(on, str) else list(on)
    cols = [c for c in left.columns if c not in on]
    a = left.select(*on, F.col(lt).alias("__t"), F.lit(1).alias("__side"), F.struct(*cols).alias("__row"),
                 F.lit(None).cast(f"struct<t:double,v:{right.schema[value].dataType.simpleString()}>").alias("__r"))
    b = right.select(*on, F.col(rt).alias("__t"), F.lit(0).alias("__side"),
                     F.lit(None).cast(a.schema["__row"].dataType).alias("__row"),
                     F.struct(F.col(rt).cast("double").alias("t"), F.col(value).alias("v")).alias("__r"))
    # among right rows with equal time the smallest value wins in both directions
    b = b.groupBy(*on, "__t", "__side").agg(F.min("__row").alias("__row"), F.min("__r").alias("__r"))
    u = a.unionByName(b).withColumn("__c", F.floor(F.col("__t") / chunk_s))
    inside = W.partitionBy(*on, "__c").orderBy("__t", "__side")
    prev = F.last("__r", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    nxt = F.first("__r", ignorenulls=True).over(inside.rowsBetween(W.currentRow, W.unboundedFollowing))
    ends = b.groupBy(*on, F.floor(F.col("__t") / chunk_s).alias("__c")).agg(F.max_by("__r", "__t").alias("__last"), F.min_by("__r", "__t").alias("__first"))
    ends = u.select(*on, "__c").distinct().join(ends, [*on, "__c"], "left")
    across = W.partitionBy(*on).orderBy("__c")
    ends = ends.select(*on, "__c", F.last("__last", ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1)).alias("__pl"),
                       F.first("__first", ignorenulls=True).over(across.rowsBetween(1, W.unboundedFollowing)).alias("__nf"))
    back = (u.withColumns({"prev": prev, "next": nxt}).where("__side = 1").join(ends, [*on, "__c"])
            .withColumns({"prev": F.coalesce("prev", "__pl"), "next": F.coalesce("next", "__nf")}))
    dp, dn = F.col("__t") - F.col("prev.t"), F.col("next.t") - F.col("__t")
    pick = F.when(F.col("prev").isNotNull() & (F.col("next").isNull() | (dp <= dn)), F.col("prev")).otherwise(F.col("next"))
    out = back.withColumn("__p", pick)
    if max_dt is not None:
        out = out.withColumn("__p", F.when(F.abs(F.col("__p.t") - F.col("__t")) <= max_dt, F.col("__p")))
    return out.select(*on, "__row.*", F.col("__p.t").alias("near_t"), F.col("__p.v").alias("near_value"))


def mean_in_range(ranges: DataFrame, samples: DataFrame, on, lo="lo", hi="hi", t="t", v="v", width: float = 10.0) -> DataFrame:
    """Mean of the samples inside each closed range; 0 when there is none."""
    on = [on] if isinstance(on, str) else list(on)
    r = ranges.withColumn("__b", F.explode(_bins(F.col(lo), F.col(hi), width)))
    s = samples.select(*on, F.col(t).alias("__t"), F.col(v).alias("__v"), F.floor(F.col(t) / width).alias("__b"))
    part = (r.join(s, [*on, "__b"], "left")
            .groupBy(*ranges.columns)
            .agg(F.avg(F.when(F.col("__t").between(F.col(lo), F.col(hi)), F.col("__v"))).alias("mean")))
    return part.withColumn("mean", F.coalesce("mean", F.lit(0.0)))


def conflict_free(spots: DataFrame, chosen: DataFrame, on, gap: float, width: float = 10.0) -> DataFrame:
    """Spots that keep at least `gap` seconds to every chosen interval of the same key."""
    on = [on] if isinstance(on, str) else list(on)
    s = spots.withColumn("__b", F.explode(_bins(F.col("start") - gap, F.col("end") + gap, width)))
    c = chosen.select(*on, F.col("start").alias("__cs"), F.col("end").alias("__ce"),
                      F.explode(_bins(F.col("start"), F.col("end"), width)).alias("__b"))
    clash = (F.col("end") + gap > F.col("__cs")) & (F.col("start") < F.col("__ce") + gap)
    bad = s.join(c, [*on, "__b"]).where(clash).select(*spots.columns).distinct()
    return spots.join(bad, spots.columns, "left_anti")
