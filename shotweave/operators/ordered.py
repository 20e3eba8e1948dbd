"""Order-dependent operators that stay parallel inside one key.

A plain window sends every row of a key to one task. Here each key is cut into chunks by a monotone expression of its order
(an hour of time, 4,096 positions, 0.01 of score); the window runs inside a chunk and only one summary row per chunk is
carried across. A key that holds a third of all rows is therefore spread over as many tasks as it has chunks.

Where no such expression cuts evenly (scores that pile up, one order over everything), rows are laid out in range partitions of the whole order instead: Spark samples
the borders, so that partitions are of about equal size whatever the keys and values, ties being parted by the further columns of the order. A row's
number is then its place in its partition and the rows of the partitions before, one count per partition.

Summaries and rows come from one input, which is worked out for each of them. Where such steps follow each other this would double at every step, so
`running_total` and `first_use` write the values inside chunks to the shared folder, and only keys with several chunks go through a join.
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage, written


def _match(df: DataFrame, side: DataFrame, keys):
    """Left join of per-chunk summaries on (keys, __c)."""
    return df.join(side, [*keys, "__c"], "left")


def running(df: DataFrame, by, chunk: Column, order, **aggs) -> DataFrame:
    """Running aggregates up to and including the row. aggs: name=(kind, column), kind in sum | max | last (non-null)."""
    by = [by] if isinstance(by, str) else list(by)
    order = [o if isinstance(o, Column) else F.col(o) for o in order]
    d = df.withColumn("__c", chunk).withColumns({f"__v_{n}": c for n, (_, c) in aggs.items()})
    inside = W.partitionBy(*by, "__c").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*by).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    fn = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    at = F.row_number().over(W.partitionBy(*by, "__c").orderBy(*order))
    local = d.withColumns({"__i": at, **{f"__l_{n}": fn[k](f"__v_{n}").over(inside) for n, (k, _) in aggs.items()}})
    # one row per chunk: the running values at its final row
    totals = local.groupBy(*by, "__c").agg(*[F.max_by(f"__l_{n}", "__i").alias(f"__l_{n}") for n in aggs])
    carried = totals.select(*by, "__c", *[fn[k](f"__l_{n}").over(before).alias(f"__p_{n}") for n, (k, _) in aggs.items()])
    out = _match(local, carried, by)
    merge = {"sum": lambda l, p: F.when(p.isNull(), l).otherwise(F.coalesce(l, F.lit(0)) + p),
             "max": lambda l, p: F.greatest(l, p), "last": lambda l, p: F.coalesce(l, p)}
    out = out.withColumns({n: merge[k](F.col(f"__l_{n}"), F.col(f"__p_{n}")) for n, (k, _) in aggs.items()})
    return out.drop("__c", "__i", *[f"__{x}_{n}" for n in aggs for x in "vlp"])


def neighbour(df: DataFrame, by, chunk: Column, order, cols: dict, step: int = 1) -> DataFrame:
    """Values of the next (step=1) or previous (step=-1) row of the key. cols: new name -> column. Ascending order only."""
    by = [by] if isinstance(by, str) else list(by)
    order = [o if isinstance(o, Column) else F.col(o) for o in order]
    d = df.withColumn("__c", chunk).withColumn("__s", F.struct(*[c.alias(n) for n, c in cols.items()]))
    w = W.partitionBy(*by, "__c").orderBy(*order)
    near = (F.lead if step > 0 else F.lag)("__s").over(w)
    edge = F.min_by if step > 0 else F.max_by
    ends = d.groupBy(*by, "__c").agg(edge("__s", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("__e"))
    wc = W.partitionBy(*by).orderBy("__c")
    ends = ends.select(*by, "__c", (F.lead if step > 0 else F.lag)("__e").over(wc).alias("__n"))
    out = _match(d.withColumn("__x", near), ends, by)
    v = F.coalesce(F.col("__x"), F.col("__n"))
    return out.withColumns({n: v[n] for n in cols}).drop("__c", "__s", "__x", "__n")


def rank_in_key(df: DataFrame, by, chunk: Column, order, name: str = "rn") -> DataFrame:
    """row_number over a key, chunk by chunk. `chunk` must grow along the given order."""
    return running(df, by, chunk, order, **{name: ("sum", F.lit(1).cast("long"))})


def chunk_bases(local: DataFrame, by, last: Column):
    """(by, __c, __b): what the chunks before a chunk add up to, for keys with several chunks only. `last` is an aggregate of one chunk. None where no key has several."""
    c = F.col("__c")
    several = written(local.groupBy(*by).agg(F.min(c).alias("a"), F.max(c).alias("z"), F.count_if(c.isNull()).alias("u")).where("a <> z OR (u > 0 AND a IS NOT NULL)").select(*[F.col(k).alias(f"__by_{k}") for k in by]))
    if several.isEmpty():
        return None
    totals = local.join(several, [F.col(k).eqNullSafe(F.col(f"__by_{k}")) for k in by], "left_semi").groupBy(*by, "__c").agg(last.alias("__t"))
    before = W.partitionBy(*by).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    return written(totals.select(*by, "__c", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__b")))


def by_chunks(local: DataFrame, bases: DataFrame, by):
    """(rows of keys with one chunk, rows of the others with __b). A null is a key like others."""
    side = bases.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__c").alias("__by___c"), "__b")
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in (*by, "__c")]
    return local.join(side, same, "left_anti"), local.join(side, same).drop(*[f"__by_{c}" for c in (*by, "__c")])


def running_total(df: DataFrame, by, chunk: Column, order, name: str, value: Column) -> DataFrame:
    """As running(name=("sum", value)), but df is worked out once."""
    by = [by] if isinstance(by, str) else list(by)
    inside = W.partitionBy(*by, "__c").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = df.withColumn("__c", chunk).withColumn("__v", value)
    local = written(local.withColumns({"__i": F.row_number().over(inside), name: F.sum("__v").over(inside)}).drop("__v"))
    bases = chunk_bases(local, by, F.max_by(name, "__i"))
    if bases is not None:
        one, more = by_chunks(local, bases, by)
        local = one.unionByName(more.withColumn(name, F.coalesce(F.col(name), F.lit(0)) + F.col("__b")).drop("__b"))
    return local.drop("__c", "__i")


def first_use(df: DataFrame, by, chunk: Column, order, value: str, number: str, rank: str) -> DataFrame:
    """Row number in the key, and the rank of the row's value among the key's values in order of their first use; ties go by value. df is worked out once."""
    by = [by] if isinstance(by, str) else list(by)
    inside = W.partitionBy(*by, "__c")
    local = df.withColumn("__c", chunk).withColumn(number, F.row_number().over(inside.orderBy(*order, value)).cast("long"))
    local = local.withColumn("__f", F.min(number).over(W.partitionBy(*by, "__c", value)))
    local = written(local.withColumn(rank, F.dense_rank().over(inside.orderBy("__f")).cast("long")))
    bases = chunk_bases(local, by, F.max(number))
    if bases is not None:
        one, more = by_chunks(local, bases, by)
        more = more.withColumns({number: F.col(number) + F.col("__b"), "__f": F.col("__f") + F.col("__b")}).drop("__b", rank)
        first = written(more.groupBy(*by, value).agg(F.min("__f").alias("__f")))
        first = running_total(first, by, F.floor(F.col("__f") / 4096), ["__f"], rank, F.lit(1).cast("long"))
        first = first.select(*[F.col(c).alias(f"__by_{c}") for c in (*by, value)], rank)
        same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in (*by, value)]
        local = one.unionByName(more.join(first, same).drop(*[f"__by_{c}" for c in (*by, value)]))
    return local.drop("__c", "__f")


PLACE_BITS = 33                 # of a row's place in its partition, below the partition's number


def laid_out(df: DataFrame, order) -> DataFrame:
    """df in range partitions of the whole order, which must be total; __at holds (partition, place in it) and stays fixed from here on."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    return cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))


def _before(d: DataFrame, **sums: Column) -> DataFrame:
    """(__part, base per sum): what all partitions before this one add up to. One row per partition reaches the driver."""
    rows = d.groupBy(F.shiftright("__at", PLACE_BITS).cast("int").alias("__part")).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).collect()
    out, so_far = [], [0] * len(sums)
    for r in sorted(rows):
        out.append((r[0], *so_far))
        so_far = [a + (b or 0) for a, b in zip(so_far, r[1:])]
    kinds = d.select(*[F.sum(c).alias(n) for n, c in sums.items()]).schema
    return d.sparkSession.createDataFrame(out, "__part int, " + ", ".join(f"__base_{f.name} {f.dataType.simpleString()}" for f in kinds))


def numbered(df: DataFrame, by, order, name: str) -> DataFrame:
    """Number from 1 of each row in its key, or in all with by=[]; `order` must be total within a key. A null is a key like others."""
    by = [by] if isinstance(by, str) else list(by)
    d = laid_out(df, [*by, *order])
    d = d.withColumn("__part", F.shiftright("__at", PLACE_BITS).cast("int")).join(F.broadcast(_before(d, n=F.lit(1).cast("long"))), "__part")
    d = d.withColumn(name, F.col("__base_n") + F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1).drop("__part", "__base_n", "__at")
    if not by:
        return d
    first = d.groupBy(*[F.col(c).alias(f"__by_{c}") for c in by]).agg((F.min(name) - 1).alias("__first"))
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    return d.join(first, same).withColumn(name, F.col(name) - F.col("__first")).drop("__first", *[f"__by_{c}" for c in by])


def running_totals(df: DataFrame, order, **sums: Column) -> DataFrame:
    """Running sums over the whole table up to and including the row, in a total order."""
    d = laid_out(df, order)
    base = _before(d, **sums)
    d = d.withColumn("__part", F.shiftright("__at", PLACE_BITS).cast("int"))
    inside = W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(base), "__part")
    return d.withColumns({n: F.col(n) + F.col(f"__base_{n}") for n in sums}).drop("__part", "__at", *[f"__base_{n}" for n in sums])
