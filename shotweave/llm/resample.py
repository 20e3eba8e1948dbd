"""Importance resampling towards a target distribution: bucketed log-ratios as an array, Gumbel noise, and an exact cutoff by weighted median of medians."""
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut_lineage, id_and_text, schema_with
from .words import Words, segment_sum, slices, text_column

OTHER = np.ones(256, bool)                      # bytes between words: ASCII but digits and small letters
OTHER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
SHORT = 32                                      # bytes of a word up to which its checksum is computed for all words at once
TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    TABLE = np.where(TABLE & 1, TABLE >> 1 ^ np.uint32(0xEDB88320), TABLE >> 1)
REFRESH = 8                                     # remaining keys are written anew when so many times fewer than those read


def crc32(raw, start, end, state=None):
    """Unsigned crc32 of the byte ranges, each going on from a checksum in `state`."""
    size = end - start
    out = ~(np.zeros(len(start), np.uint32) if state is None else state.astype(np.uint32))
    at, done = np.flatnonzero((size > 0) & (size <= SHORT)), 0
    while len(at):
        here = out[at]
        out[at] = TABLE[(here ^ raw[start[at] + done]) & 255] ^ here >> 8
        done += 1
        at = at[size[at] > done]
    out = ~out
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(raw[start[i]:end[i]].data, 0 if state is None else int(state[i]))
    return out


def features(texts: pa.Array, longest: int, buckets: int):
    """(bucket of every run of 1 to `longest` words, text of each, number of words of each text); a run's words are joined by one space."""
    words = Words(texts, lower=True, hashed=False, space=OTHER)
    many = np.diff(words.first)
    text = np.repeat(np.arange(len(many)), many)
    state = crc32(words.raw, words.start, words.end)
    found, texts_ = [state], [text]
    space = np.array([32], np.uint8)
    for k in range(1, longest):
        same = text[k:] == text[:-k]
        far = np.flatnonzero(same) + k
        zero = np.zeros(len(far), np.int64)
        state = crc32(space, zero, zero + 1, state[far - k])
        state = crc32(words.raw, words.start[far], words.end[far], state)
        found.append(state)
        texts_.append(text[far])
        full = np.zeros(len(text), np.uint32)    # by the run's first word
        full[far - k] = state
        state = full
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(texts_), many


def bucket_counts(table: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; each task adds up its own, so at most `buckets` rows of each are shuffled, and that many reach the driver."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = text_column(batch)
            for i, j in slices(texts):
                total += np.bincount(features(texts.slice(i, j - i), longest, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    rows = table.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the ratio of smoothed shares) of each bucket."""
    size, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + size) / ((x + 1) * (t + size)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(name: str, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, row (a number of its own)."""
    schema = schema_with(docs, "n_features long, n_words long, weight long, score long, row long")

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, names = text_column(batch), batch.column(2).to_pylist()
            for i, j in slices(texts):
                bucket, text, many = features(texts.slice(i, j - i), longest, len(gain))
                n = np.bincount(text, minlength=j - i)
                total = np.zeros(j - i, np.int64)
                np.add.at(total, text, gain[bucket])
                weight = total // np.maximum(n, 1)
                score = weight + np.array([noise(x, seed) for x in names[i:j]], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, (n, many.astype(np.int64), weight, score, np.arange(row, row + j - i)))], names=schema.names)
                row += j - i

    return docs.withColumn("name", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).mapInArrow(run, schema)


KEY = ["a", "b", "c"]                           # -score, doc_id (last where missing), row: ascending, the best first
LAST = (1 << 63) - 1


def _place(columns, key, side: str) -> int:
    """Where the key would stand in three columns that are sorted together."""
    i, j = 0, len(columns[0])
    for column, x in zip(columns[:-1], key[:-1], strict=True):
        part = column[i:j]
        i, j = i + int(np.searchsorted(part, x, "left")), i + int(np.searchsorted(part, x, "right"))
    return i + int(np.searchsorted(columns[-1][i:j], key[-1], side))


def _medians(keys: DataFrame, low, high, pivot):
    """Per partition of sorted keys between low and high (both excluded): how many stand before, at and behind the pivot, and the medians of both sides."""
    def run(batches):
        held = [[x.to_numpy() for x in batch.columns] for batch in batches]
        columns = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 3
        i = _place(columns, low, "right") if low else 0
        j = _place(columns, high, "left") if high else len(columns[0])
        x, y = (_place(columns, pivot, s) for s in ("left", "right")) if pivot else (j, j)
        middle = lambda p, q: [int(c[(p + q) // 2]) for c in columns] if q > p else None
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (x - i, y - x, j - y)] + [pa.array([middle(*r)], pa.list_(pa.int64())) for r in ((i, x), (y, j))], names=["before", "at", "behind", "lower", "upper"])

    return keys.select(KEY).mapInArrow(run, "before long, at long, behind long, lower array<long>, upper array<long>").collect()


def _weighted_median(pairs):
    """The median that half the keys' partitions, weighted by their keys, don't exceed: at least a quarter of all keys stand on either side of it."""
    pairs = sorted((tuple(m), n) for m, n in pairs if n)
    half, seen = sum(n for _, n in pairs) / 2, 0
    for key, n in pairs:
        seen += n
        if seen >= half:
            return key


def cutoff(keys: DataFrame, rank: int):
    """The key at this rank (from 1) of all, where every partition of keys (a, b, c: longs, no two alike) is sorted; None for rank 0 or beyond the end.

    Each round takes the median of the partitions' medians, weighted by how many keys each still has, and drops the side that the rank isn't on, at least a quarter of what is left.
    One job a round, one row a partition to the driver; what is left is written anew whenever it is an eighth of what is read.
    """
    rows = _medians(keys, None, None, None)
    left = stored = sum(r.before for r in rows)
    if not 0 < rank <= left:
        return None
    low = high = None
    pivot = _weighted_median([(r.lower, r.before) for r in rows])
    while True:
        rows = _medians(keys, low, high, pivot)
        before, at = sum(r.before for r in rows), sum(r.at for r in rows)
        if before < rank <= before + at:
            return pivot
        if rank <= before:
            high, left, pivot = pivot, before, _weighted_median([(r.lower, r.before) for r in rows])
        else:
            low, left, rank, pivot = pivot, left - before - at, rank - before - at, _weighted_median([(r.upper, r.behind) for r in rows])
        if left * REFRESH < stored:
            inside = F.lit(True) if low is None else ~_up_to(low)
            keys, stored = cut_lineage(keys.where(inside & (F.lit(True) if high is None else _up_to(high)))), left


def _up_to(key):
    """Whether a row's key is this one or stands before it."""
    a, b, c = (F.col(x) for x in KEY)
    return (a < key[0]) | ((a == key[0]) & ((b < key[1]) | ((b == key[1]) & (c <= key[2]))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10000, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank; one row per row of docs.

    A-Z are lower-cased; words are runs of digits, a-z and characters beyond ASCII. Features are runs of 1 to `longest` words, hashed to buckets; a bucket's gain is 1000 times the log ratio of its smoothed
    share in `target` and in docs, a weight the floored mean of a text's gains, a score the weight with Gumbel noise from the seed and the id. Of the N rows with at least
    `least_words` words the floor(percent * N / 100) highest scores are drawn and ranked, ties to the smaller doc_id. Null, empty and blank texts have no features and weight 0 and are never drawn
    (unless least_words is 0). Rows without an id come last among ties, repeated rows are drawn each on its own. Empty docs give no rows; an empty target has equal shares.

    Texts are read twice (counts, then scores) and never shuffled; the array of gains has a fixed size. The cutoff is found on sorted partitions by weighted medians of medians; only winners are sorted.
    """
    docs = id_and_text(docs)
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = scored(docs, gain, longest, seed).withColumns({"may": F.col("n_words") >= least_words, "a": -F.col("score"), "b": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "c": F.col("row")})
    rows = cut_lineage(rows.sortWithinPartitions(*KEY))
    keys = rows.where("may").select(KEY)
    last = cutoff(keys, percent * keys.count() // 100)
    out = ["doc_id", "n_features", "weight", "score"]
    drawn = F.lit(False) if last is None else F.col("may") & _up_to(last)
    winners = cut_lineage(rows.where(drawn).orderBy(*KEY).select(*out, F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33).cast("int")
    sizes = sorted(winners.groupBy(part.alias("part")).count().collect())       # one row per partition
    before, base = [], 0
    for p, n in sizes:
        before.append((p, base))
        base += n
    offsets = docs.sparkSession.createDataFrame(before, "part int, base long")
    ranked = winners.withColumn("part", part).join(F.broadcast(offsets), "part").select(*out, (F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"))
    return ranked.union(rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
