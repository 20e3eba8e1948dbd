"""Partial dates and free-text dates."""
from pyspark.sql import Column, functions as F

from . import fixed


def parse_date(c: Column) -> Column:
    """'29 April 2020 at 1:16 pm', '2020-04-29', 'April 2020', 'c. 1906' -> ISO, day and month as far as known."""
    s = F.lower(F.trim(F.regexp_replace(c, "<[^>]+>", " ")))
    month = F.create_map(*[x for i, m in enumerate(fixed.MONTHS, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))])
    some = lambda x: F.when(x != "", x)
    iso = some(F.regexp_extract(s, r"(\d{4}-\d{2}-\d{2})", 1))
    dmy = r"(\d{1,2})\s+([a-z]+)\s+(\d{4})"
    m1 = F.try_element_at(month, F.regexp_extract(s, dmy, 2))
    day = F.when(m1.isNotNull(), F.concat_ws("-", F.regexp_extract(s, dmy, 3), m1,
                                             F.lpad(F.regexp_extract(s, dmy, 1).try_cast("int").cast("string"), 2, "0")))
    my = r"([a-z]+)\s+(\d{4})"
    m2 = F.try_element_at(month, F.regexp_extract(s, my, 1))
    mon = F.when(m2.isNotNull(), F.concat_ws("-", F.regexp_extract(s, my, 2), m2))
    return F.coalesce(iso, day, mon, some(F.regexp_extract(s, r"\b((?:19|20)\d{2})\b", 1)))


def partial_date_bounds(c: Column) -> Column:
    """'2020-04' -> struct(lo 2020-04-01, hi 2020-04-30); null when there is no valid date."""
    p = r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?"
    y, m, d = (F.regexp_extract(c, p, k) for k in (1, 2, 3))
    lo = F.try_to_date(F.concat_ws("-", y, F.when(m == "", "01").otherwise(m), F.when(d == "", "01").otherwise(d)),
                       "yyyy-MM-dd")
    hi = F.when(d != "", lo).when(m != "", F.last_day(lo)).otherwise(F.try_to_date(F.concat(y, F.lit("-12-31")), "yyyy-MM-dd"))
    return F.when((y != "") & lo.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))
