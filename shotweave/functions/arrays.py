"""Array helpers. Inside a lambda an outer expression is evaluated once per element; `let` evaluates it once per row."""
from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_by(arr: Column, key) -> Column:
    """First element of each key, original order kept (a sort, not a scan per element)."""
    keyed = F.transform(arr, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return let(F.array_sort(keyed), lambda s: F.transform(F.array_sort(F.transform(
        F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["k"] != e["k"])), lambda e: F.struct(e["i"], e["x"]))), lambda e: e["x"]))
