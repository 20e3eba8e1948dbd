"""Repeated passages across documents by suffix arrays: every byte covered by a long string that also starts in an earlier document goes."""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import exchange
from .frames import cut_lineage, id_and_text, partitions
from .lm import spread, squeeze
from .suffixes import least_equal
from .words import flat, kinds, powers, prefix_hash, ragged, slices, span_hash, text_column

GRAM = 20                                       # bytes of an anchor: the least hash among the GRAM-byte strings of a window
BITS = 48                                       # of an anchor's hash in the exchange
BLOCK_BYTES = 2 << 20
PIECE = 1 << 18
SORT_BYTES = 1 << 19                            # of text whose suffixes are sorted together; equal windows always have equal anchors
LAST = np.iinfo(np.int64).max                   # stands for a missing doc_id: after all others


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, from powers of two."""
    n, at, size, out = len(x) - width + 1, 0, 1, None
    while True:
        if width & size:
            part = x[at:at + n]
            out = part if out is None else np.minimum(out, part)
            at += size
        if size * 2 > width:
            return out
        x, size = np.minimum(x[:-size], x[size:]), size * 2


class Runs:
    """Runs of neighbouring windows (`length`-byte strings) of one text with one anchor; equal windows always have equal anchors.

    start: first window's byte, size: windows, text: index of the text, anchor: hash, content: 64-bit hash of the run's bytes. Works through PIECE bytes
    at a time; a run that reaches beyond a piece is split there.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, length: int):
        self.length = length
        parts = [self._piece(raw, off, a, min(a + PIECE, len(raw) - length + 1)) for a in range(0, max(0, len(raw) - length + 1), PIECE)]
        self.start, self.size, self.text, self.anchor, self.content = map(np.concatenate, zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 5

    def _piece(self, raw, off, low, high):
        length, here = self.length, raw[low:high + self.length - 1]
        n = high - low
        total = prefix_hash(here)
        _, down = powers(len(here) + 1)
        x = (total[GRAM:] - total[:-GRAM]) * down[:len(here) - GRAM + 1]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        least = _sliding_min((x ^ (x >> np.uint64(32))) >> np.uint64(64 - BITS), length - GRAM + 1)
        new = np.ones(n, bool)
        new[1:] = least[1:] != least[:-1]
        bound = off - low
        for edge in (bound, np.maximum(bound[1:] - length + 1, bound[:-1])):     # where texts begin, and where windows would leave them
            new[edge[(edge >= 0) & (edge < n)]] = True
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
        text = np.searchsorted(off, start + low, "right") - 1
        inside = start + length <= bound[text + 1]
        start, size, text = start[inside], size[inside], text[inside]
        content = span_hash(here, start, start + size + length - 1)
        return start + low, size, text, least[start].astype(np.int64), content


def _blocks(docs: DataFrame) -> DataFrame:
    """block, docs (ids for comparison), sizes (bytes), raw (compressed texts), rest (the other columns, as Arrow bytes): about 2 MB of text a row."""
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = text_column(batch)
            ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            others = pa.RecordBatch.from_arrays(batch.columns[2:], names=[f"c{k}" for k in range(2, batch.num_columns)]) if batch.num_columns > 2 else None
            for i, j in slices(texts, BLOCK_BYTES):
                raw, off = flat(texts.slice(i, j - i))
                rest = None if others is None else pa.compress(others.slice(i, j - i).serialize().to_pybytes(), codec="zstd", asbytes=True)
                size = 0 if others is None else others.slice(i, j - i).serialize().size
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids[i:j].tobytes()], pa.binary()), pa.array([np.diff(off).tobytes()], pa.binary()), pa.array([squeeze(raw, 6)], pa.binary()),
                                                  pa.array([rest], pa.binary()), pa.array([size])], names=["block", "docs", "sizes", "raw", "rest", "rest_size"])
                block += 1

    return docs.mapInArrow(run, "block long, docs binary, sizes binary, raw binary, rest binary, rest_size long")


def _open(row):
    """doc ids, offsets and bytes of a block."""
    sizes = np.frombuffer(row["sizes"], np.int64)
    off = np.concatenate(([0], np.cumsum(sizes)))
    return np.frombuffer(row["docs"], np.int64), off, spread(row["raw"], int(off[-1]), np.uint8)


def _anchors(runs: Runs, docs: np.ndarray):
    """Distinct anchors, ascending, and whether each occurs in two documents."""
    doc = docs[runs.text]
    order = np.lexsort((doc, runs.anchor))
    anchor, doc = runs.anchor[order], doc[order]
    edges = np.flatnonzero(np.diff(anchor, prepend=-1))
    ends = np.append(edges[1:], len(anchor)) - 1
    return anchor[edges], doc[edges] != doc[np.maximum(ends, 0)] if len(edges) else np.zeros(0, bool)


def _chosen(row, bitmaps, owners: int, length: int):
    """The runs of a block whose anchors other documents share, one of each content with its least document.

    Returns docs, off, raw, runs, shared (runs), kind (content of each shared run), lead (run that stands for each content).
    """
    docs, off, raw = _open(row)
    runs = Runs(raw, off, length)
    anchors, _ = _anchors(runs, docs)
    step = -(-(1 << BITS) // owners)
    owner = anchors // step
    hit = np.zeros(len(anchors), bool)
    for r in bitmaps:
        i, j = np.searchsorted(owner, (r["owner"], r["owner"] + 1))
        hit[i:j] = exchange.flags(r["bitmap"], int(j - i))
    shared = np.flatnonzero(hit[np.searchsorted(anchors, runs.anchor)]) if len(anchors) else np.zeros(0, np.int64)
    contents, _ = kinds(raw, runs.start[shared], runs.start[shared] + runs.size[shared] + length - 1, runs.content[shared])
    order = np.lexsort((shared, docs[runs.text[shared]], contents, runs.anchor[shared]))
    ordered = contents[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, bool)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return docs, off, raw, runs, shared, kind, shared[order[new]]


CHUNKS = "owner long, block long, n long, anchor binary, doc binary, size binary, raw binary"


def _chunk_rows(row, bitmaps, owners, parts, length):
    """Per owner of a range of anchors: the block's different contents."""
    docs, off, raw, runs, shared, kind, lead = _chosen(row, bitmaps, owners, length)
    owner = (runs.anchor[lead] >> 16) * parts >> (BITS - 16)
    edges = np.flatnonzero(np.diff(owner, prepend=-1, append=parts))
    out = []
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        mine = lead[i:j]
        text = raw[ragged(runs.start[mine], runs.size[mine] + length - 1)]
        out.append({"owner": int(owner[i]), "block": row["block"], "n": j - i, "anchor": squeeze(runs.anchor[mine]), "doc": squeeze(docs[runs.text[mine]]), "size": squeeze(runs.size[mine].astype(np.int32)), "raw": squeeze(text)})
    return out


def _judged(table: pa.Table, length: int) -> pa.Table:
    """For each block's contents a bit per window: whether an earlier document has the window too."""
    rows = table.to_pylist()
    load = lambda name, kind: np.concatenate([spread(r[name], r["n"], kind) for r in rows]).astype(np.int64)
    anchor, doc, size = load("anchor", np.int64), load("doc", np.int64), load("size", np.int32)
    width = size + length - 1
    per_row = np.add.reduceat(width, np.concatenate(([0], np.cumsum([r["n"] for r in rows])[:-1])))
    raw = np.concatenate([spread(r["raw"], int(w), np.uint8) for r, w in zip(rows, per_row, strict=True)])
    begin = np.cumsum(width) - width
    content, _ = kinds(raw, begin, begin + width, span_hash(raw, begin, begin + width))
    order = np.lexsort((doc, content, anchor))
    new = np.concatenate(([True], (content[order][1:] != content[order][:-1])))
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    lead = order[new]                                    # of each content, the row with its least document
    group = np.unique(anchor[lead], return_inverse=True)[1]
    several = np.bincount(group)[group] > 1
    least = np.repeat(doc[lead], size[lead])
    first = np.cumsum(size[lead]) - size[lead]
    open_, place = lead[several], first[several]         # contents that may share windows with others, by anchor
    reach = np.cumsum(width[open_])
    turns = np.flatnonzero(np.diff(anchor[open_], prepend=-1, append=-1)) if len(open_) else np.zeros(1, np.int64)
    i = 0
    while i < len(open_):                                # whole anchors, about SORT_BYTES of text at a time
        j = int(turns[np.searchsorted(turns, i, "right")])
        fits = turns[(turns > j) & (reach[turns - 1] - reach[i] <= SORT_BYTES)]
        j = int(fits[-1]) if len(fits) else j
        part = open_[i:j]
        text = raw[ragged(begin[part], width[part])]
        starts = ragged(np.cumsum(width[part]) - width[part], size[part])
        least[ragged(place[i:j], size[part])] = least_equal(text, starts, np.repeat(doc[part], size[part]), length)
        i = j
    gone = least[ragged(first[kind], size)] < np.repeat(doc, size)
    bounds = np.cumsum(np.add.reduceat(size, np.concatenate(([0], np.cumsum([r["n"] for r in rows])[:-1]))))
    masks = [squeeze(np.packbits(x)) for x in np.split(gone, bounds[:-1])]
    return pa.table({"block": table["block"], "owner": table["owner"], "windows": pa.array(np.diff(bounds, prepend=0)), "gone": pa.array(masks, pa.binary())})


def _removed(row, bitmaps, masks, owners, length):
    """Per text of a block: whether each byte goes."""
    docs, off, raw, runs, shared, kind, lead = _chosen(row, bitmaps, owners, length)
    delta = np.zeros(len(raw) + 1, np.int32)
    if len(lead):
        gone = np.concatenate([np.unpackbits(spread(m["gone"], -(-m["windows"] // 8), np.uint8))[:m["windows"]] for m in sorted(masks, key=lambda m: m["owner"])]).astype(bool)
        first = np.cumsum(runs.size[lead]) - runs.size[lead]
        doc = docs[runs.text[shared]]
        behind = doc > docs[runs.text[lead]][kind]       # the block itself has the content in an earlier document
        windows = ragged(runs.start[shared], runs.size[shared])
        hit = gone[ragged(first[kind], runs.size[shared])] | np.repeat(behind, runs.size[shared])
        np.add.at(delta, windows[hit], 1)
        np.add.at(delta, windows[hit] + length, -1)
    return docs, off, raw, np.cumsum(delta)[:-1] > 0


def _cleaned(docs: DataFrame, length: int, body, schema: str) -> DataFrame:
    """body(block, doc ids, offsets, bytes, removed bytes) -> table, for each block of docs."""
    blocks = cut_lineage(_blocks(docs))
    count = blocks.count()
    owners = max(partitions(docs), count)                # in proportion to the blocks, so an owner's share has a fixed size
    parts = 2 * owners

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, off, raw = _open(row)
                yield pa.RecordBatch.from_pylist(exchange.requests(*_anchors(Runs(raw, off, length), ids), row["block"], owners, BITS), schema=exchange.request_schema())

    maps = cut_lineage(exchange.answers(blocks.drop("rest").mapInArrow(ask, exchange.REQUEST)).withColumnRenamed("chunk", "block"))
    shape = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in CHUNKS.split(", ")])

    def chunks(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [x for row in left.to_pylist() for x in _chunk_rows(row, right.to_pylist(), owners, parts, length)]
        return pa.Table.from_pylist(rows, schema=shape)

    sent = blocks.drop("rest").groupBy("block").cogroup(maps.groupBy("block")).applyInArrow(chunks, CHUNKS)
    judged = sent.groupBy("owner").applyInArrow(lambda t: _judged(t, length), "block long, owner long, windows long, gone binary")
    # bitmaps (windows null) and masks of a block come together
    both = cut_lineage(maps.select("block", "owner", F.lit(None).cast("long").alias("windows"), F.col("bitmap").alias("bits")).union(judged.select("block", "owner", "windows", "gone")))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        found = right.to_pylist()
        bitmaps = [{"owner": r["owner"], "bitmap": r["bits"]} for r in found if r["windows"] is None]
        masks = [{"owner": r["owner"], "windows": r["windows"], "gone": r["bits"]} for r in found if r["windows"] is not None]
        return pa.concat_tables([body(row, *_removed(row, bitmaps, masks, owners, length)) for row in left.to_pylist()])

    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, schema)


def _ids(docs):
    return pa.array(docs, mask=docs == LAST)


def removed_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per row of docs.

    Texts are UTF-8 bytes, null counts as empty. A byte goes if a `length`-byte string covers it that also starts in a document with a smaller doc_id, judged on the texts as
    given; of equal strings the document with the least doc_id keeps them, wherever they repeat in it. Rows with one doc_id never remove each other's bytes; rows
    without one come after all others. Texts shorter than `length` stay whole. doc_id is an integer. An empty table gives no rows.

    Windows whose anchor no other document has cannot repeat, which an exchange of coded hashes tells; the others are cut into runs of one anchor, equal runs are folded, and each
    owner of a range of anchors sorts the suffixes of its runs by the difference-cover method and compares adjacent prefixes.
    """
    def body(row, ids, off, raw, gone):
        edge = gone & ~np.concatenate(([False], gone[:-1])) if len(gone) else gone
        if len(gone):
            edge[off[:-1][off[:-1] < len(gone)]] = gone[off[:-1][off[:-1] < len(gone)]]
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (gone, edge)]
        sha = [hashlib.sha256(raw[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return pa.table({"doc_id": _ids(ids), "n_bytes": pa.array(np.diff(off)), **{k: pa.array((s[off[1:]] - s[off[:-1]]).astype(np.int64)) for k, s in zip(("n_removed", "n_spans"), sums, strict=True)}, "kept_sha256": pa.array(sha, pa.string())})

    docs = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return _cleaned(docs, length, body, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """The rows of docs, all columns, with text cut as removed_passages() says; a column n_chars, if there is one, counts the code points left.

    A character of which only some bytes go is removed whole. Null texts come back empty; a text that is removed whole stays as an empty one.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)

    def body(row, ids, off, raw, gone):
        texts = [raw[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        columns = {"doc_id": _ids(ids), "text": pa.array(texts, pa.string())}
        if others:
            rest = pa.ipc.read_record_batch(pa.decompress(row["rest"], decompressed_size=row["rest_size"], codec="zstd"), shape)
            columns |= {c: rest.column(k) for k, c in enumerate(others)}
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([len(x) for x in texts], columns["n_chars"].type)
        return pa.table(columns)

    shape = pa.schema([(f"c{k}", f.type) for k, f in enumerate(to_arrow_schema(plain.select(others).schema), 2)])
    return _cleaned(plain, length, body, plain.schema).select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns))
