"""Sets of distinct word shingles of Arrow texts, as 64-bit hashes."""
import numpy as np
import pyarrow as pa

from .words import Words, mix

STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array, size: int):
    """(values, first): text t has the ascending distinct hashes values[first[t]:first[t + 1]] of its shingles of `size` lower-cased words.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    words = Words(texts, lower=True)
    count = np.diff(words.first)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):                       # position i hashes words i to i + size - 1, as far as the words go
        rolled[:n - k] = rolled[:n - k] * STEP + words.hash[k:]
    rolled = mix(rolled)
    doc = np.repeat(np.arange(len(count)), count)
    inside = np.arange(n) - words.first[:-1][doc] <= (count - size)[doc]
    doc, rolled = doc[inside], rolled[inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = []
        for t in short.tolist():
            h = np.uint64(count[t])
            for x in words.hash[words.first[t]:words.first[t + 1]]:
                h = (np.array([h]) * STEP + x)[0]
            whole.append(h)
        doc, rolled = np.concatenate((doc, short)), np.concatenate((rolled, mix(np.array(whole, np.uint64))))
    order = np.lexsort((rolled, doc))
    doc, rolled = doc[order], rolled[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (rolled[1:] != rolled[:-1])
    return rolled[fresh], np.searchsorted(doc[fresh], np.arange(len(count) + 1))
