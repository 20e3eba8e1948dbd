"""Words of Arrow text batches as numpy arrays: bounded slices, word bounds and 64-bit word hashes, without one Python object per word."""
import ctypes
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15                       # odd, so that its powers have inverses modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
WINDOW = 1 << 20
try:
    LIBC = ctypes.CDLL("libc.so.6")             # a worker that lives on would hold freed memory
    LIBC.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):
    LIBC = None
SLICE_BYTES = 2 << 20


def _powers(base, n):
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES = {}


def powers(n):
    """BASE**i and BASE**-i modulo 2**64 for i < n, grown on demand."""
    if len(_TABLES.get("up", ())) < n:
        size = max(WINDOW + 4096, 1 << int(n - 1).bit_length())
        _TABLES["up"], _TABLES["down"] = _powers(BASE, size), _powers(INVERSE, size)
    return _TABLES["up"], _TABLES["down"]


def mix(x):
    """Bijective mixing of 64-bit values, so that every output bit depends on every input bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(raw):
    """H with H[j] - H[i] = sum of (byte + 1) * BASE**k over i <= k < j. Linear modulo 2**64, so texts of a regular structure collide: only for filters that bytes confirm."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.multiply(raw.astype(np.uint64) + np.uint64(1), up[:len(raw)], out=out[1:])
    np.cumsum(out, out=out)
    return out


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, last row + 1) ranges of at most `limit` bytes; a longer text is a range of its own. Afterwards free memory goes back to the system."""
    lengths = np.diff(offsets(texts))
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)
    pa.default_memory_pool().release_unused()
    if LIBC is not None:
        LIBC.malloc_trim(0)


def small(batches):
    """The rows of Arrow batches with a column text, about SLICE_BYTES of it at a time, so that what goes back is small too."""
    for batch in batches:
        for i, j in slices(text_column(batch)):
            yield batch.slice(i, j - i)


def offsets(texts: pa.Array):
    """Byte offsets of each text, null as empty (its bounds are equal in Arrow's layout made by fill_null)."""
    wide = pa.types.is_large_string(texts.type)
    return np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)


def flat(texts: pa.Array):
    """All bytes of the texts and the offsets of each in them."""
    off = offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return column.fill_null("")


HEAD = 1024                                     # bytes of a span that are mixed in blocks of eight; longer spans are known by a BLAKE2 digest
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _eights(raw):
    """The eight bytes from each place of raw on as one number, zeros beyond its end."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    return np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))


def span_hash(raw, start, end):
    """64-bit hashes of the byte ranges start[i] to end[i]: blocks of eight bytes enter one after the other, each followed by a bijective mixing.

    Spans of one length up to eight bytes never collide; others do once in 2**64, whatever the structure of the text.
    """
    start, size = np.asarray(start, np.int64), np.asarray(end, np.int64) - start
    out = mix(size.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))
    eights = _eights(raw)
    at = np.flatnonzero((size > 0) & (size <= HEAD))
    done = 0
    while len(at):
        here = eights[start[at] + done] & MASKS[np.minimum(size[at] - done, 8)]
        out[at] = mix(out[at] ^ here)
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > HEAD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i]:start[i] + size[i]].data, digest_size=8).digest(), "little")
    return out


def equal_spans(raw, start, other, begin, size):
    """Whether the size[i] bytes from raw[start[i]] and from other[begin[i]] are the same, compared byte for byte."""
    size = np.asarray(size, np.int64)
    out = np.ones(len(size), bool)
    left, right = _eights(raw), _eights(other)
    at = np.flatnonzero((size > 0) & (size <= HEAD))
    done = 0
    while len(at):
        same = (left[start[at] + done] ^ right[begin[at] + done]) & MASKS[np.minimum(size[at] - done, 8)] == 0
        out[at[~same]] = False
        done += 8
        at = at[same & (size[at] > done)]
    for i in np.flatnonzero(size > HEAD).tolist():
        out[i] = np.array_equal(raw[start[i]:start[i] + size[i]], other[begin[i]:begin[i] + size[i]])
    return out


def kinds(raw, start, end, hashes):
    """Codes of spans by their bytes, and the index of the first span with each code: equal hashes group them, a comparison with the first one decides."""
    codes, found = pd.factorize(hashes)
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    size, lead = end - start, first[codes]
    same = (size == size[lead]) & equal_spans(raw, start, raw, start[lead], np.minimum(size, size[lead]))
    if same.all():
        return codes, first
    known, first = {}, first.tolist()                    # spans that only share a hash get codes of their own
    for i in np.flatnonzero(~same).tolist():
        key = raw[start[i]:end[i]].tobytes()
        if key not in known:
            known[key] = len(first)
            first.append(i)
        codes[i] = known[key]
    return codes, np.array(first, np.int64)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of consecutive texts.

    start, end: byte bounds in raw; first: index of each text's first word, and the number of words at the end, so text t has words first[t] to
    first[t + 1]; hash: 64-bit hash of the (optionally lower-cased) bytes. `space` marks the bytes that part words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, hashed: bool = True, space: np.ndarray = SPACE):
        raw, off = flat(texts)
        self.raw, self.bounds = LOWER[raw] if lower else raw, off
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True                                 # words end with their text
        word = ~space[self.raw]
        begin, finish = word.copy(), word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        finish[:-1] &= ~word[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, off)
        self.hash = span_hash(self.raw, self.start, self.end) if hashed else None

    def __len__(self):
        return len(self.start)

    def distinct(self):
        """codes of every word, and the index of the first word with each code."""
        return kinds(self.raw, self.start, self.end, self.hash)

    def strings(self, index):
        """The words at these indices as Python strings."""
        data = self.raw.tobytes()
        return [data[s:e].decode("utf-8", "replace") for s, e in zip(self.start[index].tolist(), self.end[index].tolist(), strict=True)]


def ragged(starts, lengths):
    """Indices starts[i], ..., starts[i] + lengths[i] - 1 for every i, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    shift = np.repeat(np.asarray(starts, np.int64) - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64), lengths)
    return np.arange(total, dtype=np.int64) + shift


def segment_sum(values, first):
    """Sums of values over first[t] to first[t + 1] for every t; zero for empty ones."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def joined(words: Words, kept: np.ndarray) -> pa.Array:
    """Of each text the kept words, joined by one space."""
    at = np.flatnonzero(kept)
    size = words.end[at] - words.start[at]
    begin = np.cumsum(size + 1) - size - 1
    data = np.full(int(size.sum()) + len(at), 32, np.uint8)
    data[ragged(begin, size)] = words.raw[ragged(words.start[at], size)]
    cut = np.append(begin, len(data))[np.searchsorted(at, words.first)]
    some = np.diff(cut) > 0
    data = np.delete(data, cut[1:][some] - 1)                  # the space behind a text's last word
    off = cut - np.concatenate(([0], np.cumsum(some)))
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
PLAIN = np.zeros(256, bool)                     # ASCII that is neither a letter nor white space
PLAIN[33:127] = True
PLAIN &= ~LETTER
