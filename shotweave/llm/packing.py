"""Harmonic packing: pieces fall into classes by the reciprocal of the capacity they fit, and a bin of class k takes k pieces."""
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .frames import id_and_text, schema_with
from .tokens import encoder
from .words import slices, text_column

CLASSES = 64                                    # pieces of at most capacity / CLASSES are filling: they run on from bin to bin


def cut_lengths(n: int, capacity: int, slack: int) -> list[int]:
    """Lengths a document of n ids is cut into: whole where k of its kind fill a bin but for `slack` ids, else a head of exactly capacity // (k + 1)."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k >= CLASSES or capacity - k * rest <= slack:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Packer:
    """Bins of one task. A piece is (row, start, ids); what is open is bounded by CLASSES bins."""

    def __init__(self, capacity: int, task: int):
        self.capacity, self.slack = capacity, capacity // 64
        self.next = task << 40
        self.open = [[] for _ in range(CLASSES + 1)]
        self.filled = 0
        self.rows = []

    def close(self, pieces):
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids):
        start, total = 0, len(ids)
        for n in cut_lengths(total, self.capacity, self.slack):
            piece = (doc, start, ids[start:start + n], total)
            start += n
            k = min(CLASSES, self.capacity // n)
            if k == CLASSES:
                self.fill(piece)
                continue
            self.open[k].append(piece)
            if len(self.open[k]) == k:
                self.close(self.open[k])
                self.open[k] = []

    def fill(self, piece):
        """Adds a piece to the running bin; one that reaches beyond the capacity is cut there."""
        while piece is not None:
            doc, start, ids, total = piece
            room = self.capacity - self.filled
            self.open[CLASSES].append((doc, start, ids[:room], total))
            self.filled += min(room, len(ids))
            piece = (doc, start + room, ids[room:], total) if len(ids) > room else None
            if self.filled == self.capacity:
                self.close(self.open[CLASSES])
                self.open[CLASSES], self.filled = [], 0

    def finish(self):
        """Unfinished bins run on into common ones; the last is split into powers of two, which need no padding."""
        for k in range(1, CLASSES):
            for piece in self.open[k]:
                self.fill(piece)
        rest, self.open[CLASSES] = self.open[CLASSES], []
        while self.filled:
            room, bin_ = 1 << (self.filled.bit_length() - 1), []
            self.filled -= room
            while room:
                doc, start, ids, total = rest.pop(0)
                bin_.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], total))
                room -= len(bin_[-1][2])
            self.close(bin_)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and one end id, so null and empty texts are one id long. Each task packs its rows on its own without a shuffle:
    documents are cut into full bins, pieces of a reciprocal class (k of them fill a bin) and filling. Bins of class k close at k pieces; open
    bins run together at the end, and the last one is split into powers of two. Rows with equal or null ids are packed each on its own.
    """
    docs = id_and_text(docs)
    schema = schema_with(docs, "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

    def run(batches):
        tool, packer, kind = encoder(path), Packer(capacity, TaskContext.get().partitionId()), None

        def out():
            columns = list(zip(*packer.rows, strict=True)) or [()] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=schema.names)

        for batch in batches:
            texts, names, kind = text_column(batch), batch.column(0).to_pylist(), batch.schema.field(0).type
            for i, j in slices(texts):
                ids, first = tool.ids(texts.slice(i, j - i))
                full = np.insert(ids, first[1:], end_id).astype("<u4")
                first = first + np.arange(len(first))
                for k in range(j - i):
                    packer.add(names[i + k], full[first[k]:first[k + 1]].copy())
                if packer.rows:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return docs.mapInArrow(run, schema)
