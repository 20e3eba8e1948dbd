"""Periodic run detection: texts that repeat a stretch of words over and over, and what is left without the repetitions."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import id_and_text, schema_with
from .periodic import Catchers
from .words import Words, joined, slices, text_column

CHUNK = 1 << 18                                 # words that are appended together


def runs_of(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the runs of consecutive texts; text t has the codes first[t] to first[t + 1]."""
    texts = len(first) - 1
    spread = np.empty(len(codes) + texts, np.int64)         # a code of its own after each text, so that nothing goes on beyond it
    ends = first[1:] + np.arange(texts)
    inner = np.ones(len(spread), bool)
    inner[ends] = False
    spread[inner], spread[ends] = codes, -1 - np.arange(texts)
    catchers = Catchers()
    for i in range(0, len(spread), CHUNK):
        catchers.append(spread[i:i + CHUNK])
    found = catchers.finish()
    if len(found):
        found[:, :2] -= np.searchsorted(ends, found[:, :1], "left")
    return found


def _described(texts: pa.Array):
    """Runs and collapsed text of each text."""
    words = Words(texts)
    first = words.first
    codes, _ = words.distinct()
    start, end, period = runs_of(codes, first).T
    text = np.searchsorted(first, start, "right") - 1
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone)[:-1] == 0
    edge = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts)))))
    runs = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (start - first[text], end - start, period)], ["start", "length", "period"]))
    return runs, joined(words, kept)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period), collapsed (text); one row per row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch of words with smallest period q and at least max(6, 4 q) words that no neighbour extends. The collapsed text has all words, joined by
    one space, but those that any run contains after its first q ones. Null, empty and blank texts have no runs and an empty collapsed text. Repeated rows and rows without an id are treated each
    on its own. An empty table gives no rows. Nothing is shuffled: a task takes texts about 2 MB at a time, a longer one alone, and appends their words to square catchers in chunks.
    """
    docs = id_and_text(docs)
    schema = schema_with(docs, "runs array<struct<start:long,length:long,period:long>>, collapsed string")

    def run(batches):
        for batch in batches:
            texts = text_column(batch)
            for i, j in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *_described(texts.slice(i, j - i))], names=schema.names)

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exact exponent (then smallest start, period; null without runs), and digests of all runs and of the collapsed text, from detect()."""
    more = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.array_join(F.transform(listed, lambda x: F.concat(x, F.lit("\n"))), "")
    best = found.withColumn("best", F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), more))
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth text or so (by crc32 of its id) of n > 0 words is made periodic from word a on: word i becomes word a + (i - a) % p.

    With h the crc32 and g = h div 10, a = g % n and p = 1 + (n - a) div (3 + g % 8). Texts of rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeat(w):
        n, g = F.size(w), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: w[place(i)]), " "))

    text = F.transform(F.array(words), repeat)[0]        # words are split once and then looked up
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))
