"""SentencePiece encoding and decoding: best segmentation by piece scores, with giant texts cut into chunks whose max-plus transfer matrices are scanned."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut_lineage, id_and_text, schema_with
from .tokens import Memory
from .words import flat, kinds, ragged, slices, span_hash, text_column

MARK = "▁"                                 # stands for a space
GIANT, CHUNK = 1 << 16, 1 << 14                 # code points above which a text is cut, and of its chunks
LOW = -np.inf


class Pieces:
    """The pieces of a .model file with their scores, read as a unigram model: the segmentation of highest total score, summed in whole numbers.

    Characters that are no piece cost more than any piece and become byte pieces. Of equally good segmentations one is taken.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as wire
        model = wire.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.of = {p.piece: (i, int(p.score)) for i, p in enumerate(model.pieces) if p.type == wire.ModelProto.SentencePiece.NORMAL}
        self.prefixes = {p[:k]: self.of.get(p[:k]) for p in self.of for k in range(1, len(p) + 1)}      # of a mere prefix: None
        self.longest = max(map(len, self.of))
        self.unknown = min(s for _, s in self.of.values()) - 10
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == wire.ModelProto.SentencePiece.BYTE}
        assert not any(MARK in p.lstrip(MARK) for p in self.of), "a piece goes on beyond a space"
        out = [p.piece.replace(MARK, " ").encode() if p.piece in self.of else b"" for p in model.pieces]
        for b, i in self.byte.items():
            out[i] = bytes([b])
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.sizes = np.array([len(x) for x in out], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.memory = Memory()

    def ids(self, c: str) -> list[int]:
        """Byte pieces of a character that is no piece."""
        return [self.byte[b] for b in c.encode()]

    def forward(self, s: str, begin: int, stop: int, end: int):
        """Best scores from begin to each place up to end over pieces that start before stop, and where the last piece of each came from."""
        score, back, prefixes, longest = [None] * (end + 1), [None] * (end + 1), self.prefixes, self.longest
        score[begin] = 0
        for i in range(begin, stop):
            here = score[i]
            if here is None:
                continue
            if s[i] not in self.of and (score[i + 1] is None or here + self.unknown > score[i + 1]):
                score[i + 1], back[i + 1] = here + self.unknown, (i, None)
            for j in range(i + 1, min(end, i + longest) + 1):
                found = prefixes.get(s[i:j], False)
                if found:
                    new = here + found[1]
                    if score[j] is None or new > score[j]:
                        score[j], back[j] = new, (i, found[0])
                elif found is False:
                    break
        return score, back

    def best(self, s: str, begin: int, end: int) -> list[int]:
        """Ids of the best path from begin to end."""
        _, back = self.forward(s, begin, end, end)
        out, j = [], end
        while j > begin:
            i, piece = back[j]
            if piece is None:
                out += reversed(self.ids(s[i]))
            else:
                out.append(piece)
            j = i
        out.reverse()
        return out

    def transfer(self, s: str, n: int) -> np.ndarray:
        """T[a, b]: best score from code point a of a chunk of n to code point n + b, where s goes on beyond the chunk.

        No piece goes on beyond the begin of a run of spaces, so paths from all entries meet at the first one after them and differ by a constant from there.
        """
        size = self.longest
        end = min(len(s), n + size - 1)
        row = lambda score: np.array([LOW if n + b > end or score[n + b] is None else score[n + b] for b in range(size)], float)
        out = np.full((size, size), LOW)
        base, _ = self.forward(s, 0, n, end)
        out[0] = row(base)
        meet = next((i for i in range(size, n) if s[i] == MARK and s[i - 1] != MARK), None)
        for a in range(1, min(size, end + 1)):
            if a >= n:
                out[a, a - n] = 0
            elif meet is None:
                out[a] = row(self.forward(s, a, n, end)[0])
            else:
                out[a] = out[0] + (self.forward(s, a, meet, meet)[0][meet] - base[meet])
        return out

    def unit(self, text: str) -> list[int]:
        """Ids of the mark followed by this text."""
        s = MARK + text.replace(" ", MARK)
        return self.best(s, 0, len(s))

    def encode(self, texts: pa.Array):
        """All ids, and the offset of each text's first id in them (one more at the end): units begin at a run of spaces and are encoded once each."""
        raw, off = flat(texts)
        space = raw == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        heads = off[:-1][np.diff(off) > 0]
        begin[off[(off > 0) & (off < len(raw))]] = True
        begin[heads] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(raw)) if len(start) else start
        first = np.searchsorted(start, off)
        inner = np.ones(len(start), bool)
        inner[np.searchsorted(start, heads)] = False
        start = start + inner                           # a unit's first space is the mark; a text's first unit has its mark before it
        keys = span_hash(raw, start, end)
        codes, lead = kinds(raw, start, end, keys)
        data = raw.tobytes()
        fresh = lambda new: [self.unit(data[a:b].decode("utf-8", "replace")) for a, b in zip(start[lead[new]].tolist(), end[lead[new]].tolist(), strict=True)]
        at = self.memory.places(keys[lead], raw, start[lead], end[lead], fresh)[codes]
        ids, length = self.memory.gather(at)
        return ids.astype(np.int32), np.concatenate(([0], np.cumsum(length)))[first]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of one sequence of ids, without the space that stands before it."""
        out = self.bytes[ragged(self.places[ids], self.sizes[ids])].tobytes() if len(ids) else b""
        return out[1:] if out[:1] == b" " else out


_MODELS = {}


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


DIGEST = "n_bytes long, n_tokens long, ids_crc32 long, restored boolean"


def _ordinary(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, text, ids (32-bit, little endian), where the texts are read; or the digest of round_trip()."""
    schema = schema_with(docs, DIGEST if digest else "text string, ids binary")

    def run(batches):
        model = pieces(path)
        for batch in batches:
            texts = text_column(batch)
            for i, j in slices(texts):
                part = texts.slice(i, j - i)
                ids, first = model.encode(part)
                parts = [ids[x:y] for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                blobs = [x.astype("<i4").tobytes() for x in parts]
                if digest:
                    same = [model.decode(x) == y.as_buffer().to_pybytes() for x, y in zip(parts, part, strict=True)]
                    columns = [pc.binary_length(part).cast(pa.int64()), pa.array(np.diff(first)), pa.array(map(zlib.crc32, blobs), pa.int64()), pa.array(same)]
                else:
                    columns = [part.cast(pa.string()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=schema.names)

    return docs.mapInArrow(run, schema)


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and a number for each row."""
    schema = schema_with(docs, "text string, row long")

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), text_column(batch).cast(pa.string()), pa.array(np.arange(row, row + batch.num_rows))], names=schema.names)
            row += batch.num_rows

    return docs.mapInArrow(run, schema)


def _giants(rows: DataFrame, path: str, chunk: int) -> DataFrame:
    """row, ids of giant texts: chunks give transfer matrices, a scan per text the states between them, and every chunk its part of the path."""
    def cut(batches):
        model = pieces(path)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = MARK + text.replace(" ", MARK)
                for k in range(0, len(s), chunk):
                    yield pa.RecordBatch.from_pydict({"row": [row], "k": [k // chunk], "n": [min(chunk, len(s) - k)], "s": [s[k:k + chunk + model.longest]]})

    parts = cut_lineage(rows.select("row", "text").mapInArrow(cut, "row long, k long, n long, s string"))

    def matrices(batches):
        model = pieces(path)
        for batch in batches:
            out = [model.transfer(s, n).tobytes() for n, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["row", "k", "t"])

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        t = [np.frombuffer(x.as_buffer(), np.float64) for x in table["t"]]
        size = int(len(t[0]) ** 0.5)
        t = [x.reshape(size, size) for x in t]
        ahead = [np.where(np.arange(size) == 0, 0.0, LOW)]
        for m in t[:-1]:
            v = (ahead[-1][:, None] + m).max(0)
            ahead.append(v - v.max())
        state = [0]
        for v, m in zip(reversed(ahead), reversed(t), strict=True):
            state.append(int(np.argmax(v + m[:, state[-1]])))
        state.reverse()
        return pa.table({"row": table["row"], "k": table["k"], "enter": pa.array(state[:-1], pa.int64()), "leave": pa.array(state[1:], pa.int64())})

    spread = lambda df: df.repartition("row", "k")  # noqa: E731  chunks of one text go to many tasks
    states = spread(parts).mapInArrow(matrices, "row long, k long, t binary").groupBy("row").applyInArrow(scan, "row long, k long, enter long, leave long")

    def trace(batches):
        model = pieces(path)
        for batch in batches:
            out = [np.array(model.best(s, a, n + b), "<i4").tobytes() for n, s, a, b in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["row", "k", "ids"])

    traced = spread(parts).join(states, ["row", "k"]).select("row", "k", "n", "s", "enter", "leave").mapInArrow(trace, "row long, k long, ids binary")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: F.hex(x["ids"])), "")
    return traced.groupBy("row").agg(F.unhex(whole).alias("found"))     # of one text, in its order


def encode(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text, ids (binary, 32-bit little endian); one row per row of docs, null text as empty and without ids.

    Texts of up to `giant` code points are encoded where they are read. Longer ones are cut into chunks of `chunk` code points at any place: T[a, b] is the best score from a code points
    into a chunk to b beyond its end, the states between chunks follow from a max-plus scan, and each chunk then finds its own path. Repeated rows and null ids are encoded like others.
    """
    short, found = _parts(docs, path, giant, chunk)
    return _ordinary(short, path).union(found)


def _parts(docs: DataFrame, path: str, giant: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The rows that are encoded where they are read, and doc_id, text, ids of the others."""
    docs = id_and_text(docs)
    long = F.coalesce(F.char_length("text") > giant, F.lit(False))
    giants = cut_lineage(_numbered(docs.where(long)))               # of few rows, the only ones that are written and shuffled
    return docs.where(~long), giants.join(_giants(giants, path, chunk), "row").select("doc_id", "text", F.col("found").alias("ids"))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """The columns of encode() and decoded, the text of the ids."""
    schema = schema_with(rows, "text string, ids binary, decoded string")

    def run(batches):
        model = pieces(path)
        for batch in batches:
            out = [model.decode(np.frombuffer(x.as_buffer(), "<i4")).decode("utf-8", "replace") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return rows.select("doc_id", "text", "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_crc32 (of the ids as unsigned 32-bit little-endian numbers), restored (decoding gives the text back)."""
    short, found = _parts(docs, path, giant, chunk)
    back = decode(found, path).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                                      F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == F.col("text")).alias("restored"))
    return _ordinary(short, path, digest=True).union(back)
