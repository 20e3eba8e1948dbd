"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import id_and_text, schema_with
from .words import PLAIN, Words, mix, slices, small, span_hash, text_column

BUCKETS = 1 << 20
PAIR, SKIP = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def features(texts: pa.Array):
    """(text index, bucket) of every word, neighbouring pair and pair with one word between, after A-Z are lower-cased and ASCII punctuation is trimmed."""
    words = Words(texts, lower=True, hashed=False)
    start, end = words.start.copy(), words.end.copy()
    while True:
        left = PLAIN[words.raw[np.minimum(start, len(words.raw) - 1)]] & (start < end) if len(start) else start[:0].astype(bool)
        right = PLAIN[words.raw[end - 1]] & (end > start) & ~left if len(end) else left
        if not (left.any() or right.any()):
            break
        start, end = start + left, end - right
    keep = end > start
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[keep]
    h = span_hash(words.raw, start[keep], end[keep])
    parts, docs = [h], [doc]
    for far, salt in ((1, PAIR), (2, SKIP)):
        same = doc[far:] == doc[:-far]
        parts.append(mix(h[:-far][same] * salt + h[far:][same]))
        docs.append(doc[far:][same])
    return np.concatenate(docs), (np.concatenate(parts) >> np.uint64(44)).astype(np.int64)


def _unique(doc, bucket):
    """Each text's buckets once, ascending, with the places where texts begin."""
    key = np.unique(doc << 20 | bucket)
    return key >> 20, key & (BUCKETS - 1)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; binary features and a bias."""

    def __init__(self, alpha=1.0, beta=1.0, l1=2.0, l2=0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at=slice(None)):
        z, n = self.z[at], self.n[at]
        free = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, free / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at, label):
        at = np.append(at, BUCKETS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, rows: int = 16_384, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) other than zero, the bias last at bucket 2**20; at most 2**20 + 1 numbers.

    Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0: all of them or, beyond `rows`, those whose hashes of doc_id are smallest (the bound on what the one
    learning task reads, `epochs` times in changing order, one row at a time). Null labels and ids are left out, and of a doc_id labelled more than once the highest label counts. Without labelled rows every weight is zero.
    """
    pick = F.xxhash64("doc_id", F.lit(1))
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("pick", pick).orderBy("pick", "doc_id").limit(rows))
    data = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic", "pick")     # `rows` rows of three numbers at most

    def reduce_text(batches):
        for batch in batches:
            texts = text_column(batch)
            for i, j in slices(texts):
                doc, bucket = _unique(*features(texts.slice(i, j - i)))
                edges = np.searchsorted(doc, np.arange(j - i + 1))
                blobs = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i)], names=["at", "toxic", "pick"])

    def fit(batches):
        model = Ftrl()
        for batch in batches:
            for blob, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                model.learn(np.frombuffer(blob.as_buffer(), np.int32), label)
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "w"])

    rounds = data.mapInArrow(reduce_text, "at binary, toxic int, pick long").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    found = (rounds.repartition(1).sortWithinPartitions("epoch", F.xxhash64("pick", "epoch"))
             .select("at", "toxic").mapInArrow(fit, "at long, w double").collect())
    return np.array([r.at for r in found], np.int64), np.array([r.w for r in found])


def _scorer(spark, model):
    """A function from texts to scores, over broadcast weights of at most 8 MB."""
    at, w = model
    shared = spark.sparkContext.broadcast((at.astype(np.int32).tobytes(), w.tobytes()))

    def score(texts: pa.Array):
        at, w = (np.frombuffer(x, k) for x, k in zip(shared.value, (np.int32, np.float64), strict=True))
        dense = np.zeros(BUCKETS + 1)
        dense[at] = w
        out = []
        for i, j in slices(texts):
            doc, bucket = features(texts.slice(i, j - i))
            useful = dense[bucket] != 0
            doc, bucket = _unique(doc[useful], bucket[useful])
            total = dense[BUCKETS] + np.bincount(doc, dense[bucket], j - i)
            out.append(1 / (1 + np.exp(-np.clip(total, -500, 500))))
        return np.concatenate(out) if out else np.zeros(0)

    return score


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of docs. Null and empty texts get the score of no features; a null id is held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True)).alias("held_out")
    docs = id_and_text(docs).select("doc_id", "text", held)
    schema, scorer = schema_with(docs, "held_out boolean, score double, predicted int"), _scorer(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            s = scorer(text_column(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model, cutoff: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the cutoff."""
    scorer = _scorer(docs.sparkSession, model)

    def run(batches):
        for batch in small(batches):
            yield batch.filter(pa.array(scorer(text_column(batch)) < cutoff))

    return docs.mapInArrow(run, docs.schema)
