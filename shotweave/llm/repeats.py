"""Repeated passages of words: Rabin-Karp hashes of all fixed-length windows, counted by Spark, and repeated windows merged into maximal intervals."""
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .frames import cut_lineage, id_and_text, partitions
from .lm import spread, squeeze
from .words import Words, flat, joined, mix, ragged, slices, text_column

BITS = 40                                       # of a window's hash in the first exchange, which only tells suspects
OWNED = 1 << 21                                 # windows an owner of a range of hashes counts
BLOCK_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max                   # stands for a missing doc_id: after all others
PRIME = np.uint64((1 << 61) - 1)
BASES = (np.uint64(0x1B3A94F2C6D80E57), np.uint64(0x0F7C5D1E92AB4683))     # of the two hashes, below PRIME


def _reduced(x):
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a, b):
    """a * b modulo 2**61 - 1, from 31-bit halves."""
    low = np.uint64((1 << 31) - 1)
    au, ad, bu, bd = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    mid = ad * bu + au * bd
    return _reduced(au * bu * np.uint64(2) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << np.uint64(31)) + ad * bd)


def rolled(codes, length: int, base):
    """Rabin-Karp hashes of `length` neighbouring codes from each place on: hashes of 1, 2, 4, ... codes are put together by powers of the base."""
    n, done, at, out = len(codes) - length + 1, 1, 0, None
    part, power = codes, np.array([base])
    while n > 0:
        if length & done:
            out = part[:n] if out is None else _reduced(times(out, power) + part[at:at + n])
            at += done
        if done * 2 > length:
            break
        part, power, done = _reduced(times(part[:-done], power) + part[done:]), times(power, power), done * 2
    return out if out is not None else np.zeros(0, np.uint64)


class Windows:
    """Windows of a block of texts in order: word (index of the first one), text, begin (its number in the text), hash and check (61 bits each)."""

    def __init__(self, words: Words, length: int):
        many = np.maximum(np.diff(words.first) - length + 1, 0)
        self.word = ragged(words.first[:-1], many)
        self.text = np.repeat(np.arange(len(many)), many)
        self.begin = self.word - words.first[:-1][self.text]
        self.codes, self.length = words.hash, length
        self.hash = rolled(_reduced(self.codes), length, BASES[0])[self.word]
        self.mark = (self.hash >> np.uint64(61 - BITS)).astype(np.int64)

    def check(self, which):
        """The second hash of some windows, from other word codes and another base."""
        return rolled(_reduced(mix(self.codes ^ np.uint64(0xA0761D6478BD642F))), self.length, BASES[1])[self.word[which]]


def _blocks(docs: DataFrame) -> DataFrame:
    """block, docs (ids), sizes (bytes), raw (compressed texts): about 4 MB of text a row."""
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = text_column(batch)
            ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            for i, j in slices(texts, BLOCK_BYTES):
                raw, off = flat(texts.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids[i:j].tobytes()], pa.binary()), pa.array([np.diff(off).tobytes()], pa.binary()), pa.array([squeeze(raw, 3)], pa.binary())],
                                                 names=["block", "docs", "sizes", "raw"])
                block += 1

    return docs.mapInArrow(run, "block long, docs binary, sizes binary, raw binary")


def _open(row):
    """Doc ids and words of a block."""
    sizes = np.frombuffer(row["sizes"], np.int64)
    off = np.concatenate(([0], np.cumsum(sizes)))
    raw = spread(row["raw"], int(off[-1]), np.uint8)
    texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(off), pa.py_buffer(raw))
    return np.frombuffer(row["docs"], np.int64), Words(texts)


class Suspects:
    """A block's windows whose hash another window has, folded to different ones: each with its first place in the block, by owner and hash.

    which: windows; kind: index of each one's fold; lead: window that stands for each fold; check: its second hash.
    """

    def __init__(self, ids, windows: Windows, bitmaps, owners: int):
        step = -(-(1 << BITS) // owners)
        marks = np.unique(windows.mark)
        owner = marks // step
        hit = np.zeros(len(marks), bool)
        for r in bitmaps:
            i, j = np.searchsorted(owner, (r["owner"], r["owner"] + 1))
            hit[i:j] = exchange.flags(r["bitmap"], int(j - i))
        self.which = np.flatnonzero(hit[np.searchsorted(marks, windows.mark)]) if len(marks) else np.zeros(0, np.int64)
        self.hash, self.check = windows.hash[self.which], windows.check(self.which)
        self.doc, self.begin = ids[windows.text[self.which]], windows.begin[self.which]
        order = np.lexsort((self.begin, self.doc, self.check, self.hash))
        new = np.ones(len(order), bool)
        new[1:] = (self.hash[order][1:] != self.hash[order][:-1]) | (self.check[order][1:] != self.check[order][:-1])
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        self.lead = order[new]
        self.owner = (self.hash[self.lead] >> np.uint64(61 - BITS)).astype(np.int64) // step


CHUNKS = "owner long, block long, n long, hash binary, check binary, doc binary, begin binary"


def _judged(table: pa.Table) -> pa.Table:
    """For each block's different windows a bit: whether the same window starts earlier in another block."""
    rows = table.to_pylist()
    load = lambda name, kind: np.concatenate([spread(r[name], r["n"], kind) for r in rows])
    value, check, doc, begin = load("hash", np.uint64), load("check", np.uint64), load("doc", np.int64), load("begin", np.int64)
    order = np.lexsort((begin, doc, check, value))
    value, check = value[order], check[order]
    new = np.ones(len(order), bool)
    new[1:] = (value[1:] != value[:-1]) | (check[1:] != check[:-1])
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    late = np.empty(len(order), bool)
    late[order] = (doc[order] != doc[lead]) | (begin[order] != begin[lead])
    bounds = np.cumsum([r["n"] for r in rows])
    bits = [np.packbits(x).tobytes() for x in np.split(late, bounds[:-1])]
    return pa.table({"block": table["block"], "owner": table["owner"], "folds": table["n"], "bits": pa.array(bits, pa.binary())})


def _removed(row, found, owners: int, length: int):
    """Doc ids and words of a block, and which words go."""
    ids, words = _open(row)
    bitmaps = [{"owner": r["owner"], "bitmap": r["bits"]} for r in found if r["folds"] is None]
    masks = sorted((r for r in found if r["folds"] is not None), key=lambda r: r["owner"])
    windows = Windows(words, length)
    held = Suspects(ids, windows, bitmaps, owners)
    gone = np.zeros(len(words) + 1, np.int64)
    if len(held.which):
        late = np.concatenate([exchange.flags(m["bits"], m["folds"]) for m in masks])
        lead = held.lead[held.kind]
        hit = late[held.kind] | (held.doc != held.doc[lead]) | (held.begin != held.begin[lead])
        at = windows.word[held.which[hit]]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + length, -1)
    return ids, words, np.cumsum(gone)[:-1] > 0


def _spans(words: Words, gone) -> pa.Array:
    """Maximal stretches of removed words of each text, as (start, end) word numbers."""
    edge = np.zeros(len(words) + 1, bool)
    edge[words.first] = True                             # stretches end with their text
    begin, finish = gone.copy(), gone.copy()
    begin[1:] &= ~gone[:-1] | edge[1:-1]
    finish[:-1] &= ~gone[1:] | edge[1:-1]
    begin, finish = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    base = words.first[np.searchsorted(words.first, begin, "right") - 1]
    pairs = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(finish - base)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, words.first), pa.int32()), pairs)


def repeated_windows(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, spans (array of start, end: maximal intervals of removed words), kept (the other words, joined by one space); one row per row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if a window of `length` words covers it that also starts earlier: in a document with a smaller doc_id, or in the same one before; windows are
    judged on the texts as given. Null, empty and blank texts have no words. Rows with one doc_id are one document, so equal windows at one place of them all stay; rows without an id count
    as one document after all others. doc_id is an integer. Texts shorter than a window stay whole. An empty table gives no rows.

    1. Blocks of about 4 MB send the sorted Rabin-Karp hashes of all their windows, coded, to owners of hash ranges, which count them and answer with bitmaps. 2. Of the windows that occur again, each
    block sends every different one once with its first place, under 122 bits of hash; owners say which start earlier elsewhere. 3. Blocks merge repeated windows into intervals. A window
    that a third of all documents share reaches its owner once per block.
    """
    blocks = cut_lineage(_blocks(id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))))

    total = blocks.agg(F.sum(F.length("raw"))).first()[0] or 0
    owners = max(partitions(docs), -(-int(total) // OWNED))       # compressed bytes: about as many as windows

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values, counts = np.unique(Windows(_open(row)[1], length).mark, return_counts=True)
                yield pa.RecordBatch.from_pylist(exchange.requests(values, counts > 1, row["block"], owners, BITS), schema=exchange.request_schema())

    maps = cut_lineage(exchange.answers(blocks.mapInArrow(ask, exchange.REQUEST)).withColumnRenamed("chunk", "block"))
    shape = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in CHUNKS.split(", ")])

    def chunks(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            ids, words = _open(row)
            held = Suspects(ids, Windows(words, length), right.to_pylist(), owners)
            edges = np.flatnonzero(np.diff(held.owner, prepend=-1, append=owners))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                mine = held.lead[i:j]
                out.append({"owner": int(held.owner[i]), "block": row["block"], "n": j - i, **{k: squeeze(getattr(held, k)[mine]) for k in ("hash", "check", "doc", "begin")}})
        return pa.Table.from_pylist(out, schema=shape)

    sent = blocks.groupBy("block").cogroup(maps.groupBy("block")).applyInArrow(chunks, CHUNKS)
    judged = sent.groupBy("owner").applyInArrow(_judged, "block long, owner long, folds long, bits binary")
    both = cut_lineage(maps.select("block", "owner", F.lit(None).cast("long").alias("folds"), F.col("bitmap").alias("bits")).union(judged))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            ids, words, gone = _removed(row, right.to_pylist(), owners, length)
            out.append(pa.table({"doc_id": pa.array(ids, mask=ids == LAST), "n_words": pa.array(np.diff(words.first).astype(np.int64)), "spans": _spans(words, gone), "kept": joined(words, ~gone)}))
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_spans, from repeated_windows()."""
    removed = F.reduce("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))
