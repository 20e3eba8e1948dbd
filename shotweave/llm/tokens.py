"""Ids of a tokenizers vocabulary for whole texts: texts are split at safe boundaries and each different piece is encoded once per worker."""
import os

import numpy as np
import pyarrow as pa

from .words import LETTER, LOWER, PLAIN, Words, equal_spans, mix, ragged, span_hash

OTHER = 0x8EBC6AF09C88C6E3                      # leads from a taken key to the next
CACHE = 1_000_000                               # pieces a worker remembers; beyond it, the memory starts anew


class Memory:
    """Ids of pieces of text, as arrays, found by 64-bit hash and confirmed by the piece's bytes; it starts anew beyond CACHE pieces."""

    def __init__(self):
        self.known = np.zeros(0, np.uint64)     # sorted keys, with their place in the pool of ids and in the pool of bytes
        self.place, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.begin, self.size, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def look_up(self, keys):
        at = np.searchsorted(self.known, keys)
        at[at == len(self.known)] = 0
        return at, (self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool))

    def keys(self, hashes, raw, start, size):
        """A key for each piece (all different): its hash, or another one where a different piece has that."""
        keys = hashes.copy()
        while True:
            at, found = self.look_up(keys)
            bad = np.ones(len(keys), bool)
            bad[np.unique(keys, return_index=True)[1]] = False
            here = np.flatnonzero(found)
            held = at[here]
            bad[here] |= (self.size[held] != size[here]) | ~equal_spans(raw, start[here], self.text, self.begin[held], np.minimum(size[here], self.size[held]))
            if not bad.any():
                return keys
            keys[bad] = mix(keys[bad] ^ np.uint64(OTHER))

    def places(self, hashes, raw, start, end, encode):
        """Index of each piece raw[start[i]:end[i]] (all different, with their hashes); encode(which) -> lists of ids gives those not known yet."""
        size = end - start
        keys = self.keys(hashes, raw, start, size)
        at, found = self.look_up(keys)
        if found.all():
            return at
        new = np.flatnonzero(~found)
        if len(self.known) + len(new) > CACHE:
            self.__init__()
            new = np.arange(len(keys))
        lists = encode(new)
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        known = np.concatenate((self.known, keys[new]))
        order = np.argsort(known)
        self.known = known[order]
        for name, more in (("place", len(self.pool) + np.cumsum(length) - length), ("length", length), ("begin", len(self.text) + np.cumsum(size[new]) - size[new]), ("size", size[new])):
            setattr(self, name, np.concatenate((getattr(self, name), more))[order])
        self.pool = np.concatenate((self.pool, np.fromiter((x for y in lists for x in y), np.uint32, int(length.sum()))))
        self.text = np.concatenate((self.text, raw[ragged(start[new], size[new])]))
        return self.look_up(keys)[0]

    def gather(self, at):
        """Ids of the pieces at these indices, one after the other, and their lengths."""
        length = self.length[at]
        return self.pool[ragged(self.place[at], length)] if len(at) else np.zeros(0, np.uint32), length


class Encoder:
    """Encodes Arrow texts with a tokenizer whose normaliser lower-cases and whose pre-tokeniser drops white space and parts letters from others.

    Safe boundaries are white space and, inside a word, the places between an ASCII letter and other ASCII (but not after an apostrophe, which
    may start a contraction). Words with "<|" (special strings) or characters beyond U+00FF (combining marks, context-dependent case) stay whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.memory = Memory()

    def pieces(self, texts: pa.Array) -> Words:
        out = Words(texts, hashed=False)
        raw = out.raw
        strange = np.flatnonzero(raw >= 0xC4)
        marks = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|"))) if len(raw) > 1 else strange[:0]
        whole = np.zeros(len(out) + 1, bool)
        whole[np.searchsorted(out.start, np.concatenate((strange, marks)), "right") - 1] = True
        letter, plain = LETTER[raw], PLAIN[raw]
        cut = np.flatnonzero(letter[:-1] & plain[1:] | plain[:-1] & (raw[:-1] != ord("'")) & letter[1:]) + 1
        owner = np.searchsorted(out.start, cut, "right") - 1
        inside = ~whole[owner] & (cut < out.end[owner]) if len(out) else np.zeros(len(cut), bool)
        cut = cut[inside]
        low = LOWER[raw]
        for k in np.flatnonzero(whole[:-1]).tolist():
            low[out.start[k]:out.end[k]] = raw[out.start[k]:out.end[k]]
        out.raw = low
        out.start, out.end = np.sort(np.concatenate((out.start, cut))), np.sort(np.concatenate((out.end, cut)))
        out.first = np.searchsorted(out.start, out.bounds)
        out.hash = span_hash(low, out.start, out.end)
        return out

    def _encode(self, texts):
        """The pieces, and each one's index in the memory."""
        words = self.pieces(texts)
        codes, index = words.distinct()
        fresh = lambda new: [e.ids for e in self.tokenizer.encode_batch_fast(words.strings(index[new]), add_special_tokens=False)]
        return words, self.memory.places(words.hash[index], words.raw, words.start[index], words.end[index], fresh)[codes]

    def lengths(self, texts: pa.Array):
        """Number of ids of each text."""
        words, at = self._encode(texts)
        total = np.concatenate(([0], np.cumsum(self.memory.length[at])))
        return total[words.first[1:]] - total[words.first[:-1]]

    def ids(self, texts: pa.Array):
        """All ids, and the offset of each text's first id in them (one more at the end)."""
        words, at = self._encode(texts)
        out, length = self.memory.gather(at)
        return out, np.concatenate(([0], np.cumsum(length)))[words.first]


_ENCODERS = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
