"""Periodic runs of words by online dyadic square catching, over numpy arrays of word codes."""
import numpy as np

from .words import mix

LEAST, TIMES = 6, 4                             # a run has at least LEAST words and TIMES periods
MANY = 64                                       # hits of one period from which its matches are compared all at once


class Catchers:
    """Squares and runs of a growing sequence of codes.

    When a block of 2**t words that begins at a multiple of 2**t is complete, it becomes a catcher: while words 2**t to 2**(t + 1) - 1 places behind it are
    appended, the suffix of 2**t words is compared with it by fingerprint, so each appended word costs one comparison per level. A run with a
    period q of 2**t <= q < 2**(t + 1) and at least four periods contains such a block whole together with its copy q words later, so no run escapes. A hit is extended on
    the codes themselves, left and right, to the whole stretch in which words q apart are equal; squares of one stretch merge there. A stretch that reaches the
    end so far stays open and goes on with the next words. Hits within a run of a smaller period tell nothing new and are passed over.

    Kept between appends: the codes, the last 3 * 2**t fingerprints of each level, open stretches and runs.
    """

    def __init__(self):
        self.codes = np.zeros(0, np.int64)
        self.levels = []                        # per level (first place, fingerprints from there on)
        self.found = {}                         # period -> ends of its stretches by their starts
        self.open = set()                       # (period, start) of stretches that reach the end so far
        self.cover = np.zeros((2, 0), np.int64)  # starts of runs, ascending, and how far those up to each reach
        self.runs = []                          # (start, end, period) of runs seen so far, for the cover only

    def append(self, codes: np.ndarray):
        """Adds words; which chunks a text comes in does not change what is found."""
        old = len(self.codes)
        self.codes = np.concatenate((self.codes, np.asarray(codes, np.int64)))
        for q, a in sorted(self.open):
            self._grow(q, a, self._right(old - q, q))
        prints, first, t = mix(self.codes[old:].astype(np.uint64)), old, 0
        while len(prints):
            size = 1 << t
            low, kept = self.levels[t] if t < len(self.levels) else (first, prints[:0])
            every = np.concatenate((kept, prints))
            place = np.arange(first, first + len(prints))
            block = (place >> t << t) - size
            hit = block >= 0
            hit[hit] = every[block[hit] - low] == prints[hit]
            if hit.any():
                self._caught(block[hit], place[hit], size)
            rest = max(0, len(every) - 3 * size)
            level = (low + rest, every[rest:])
            if t < len(self.levels):
                self.levels[t] = level
            else:
                self.levels.append(level)
            # suffixes of twice the length that end in the new words
            first = max(0, old - 2 * size + 1)
            many = len(self.codes) - 2 * size + 1 - first
            if many <= 0:
                break
            at = np.arange(first, first + many) - low
            prints = mix(mix(every[at] ^ np.uint64(t + 1)) + every[at + size])
            t += 1

    def _right(self, i: int, q: int) -> int:
        """First place from i on where the word q later differs or is missing."""
        codes, n, step = self.codes, len(self.codes) - q, 64
        while i < n:
            stop = min(n, i + step)
            differs = codes[i:stop] != codes[i + q:stop + q]
            if differs.any():
                return i + int(differs.argmax())
            i, step = stop, min(2 * step, 1 << 16)
        return max(i, n)

    def _left(self, i: int, q: int) -> int:
        """Least place from which on words up to i equal those q later."""
        codes, step = self.codes, 64
        while i > 0:
            begin = max(0, i - step)
            differs = codes[begin:i] != codes[begin + q:i + q]
            if differs.any():
                return i - int(differs[::-1].argmax())
            i, step = begin, min(2 * step, 1 << 16)
        return 0

    def _grow(self, q: int, a: int, stop: int):
        """Words from a to stop equal those q later."""
        self.found.setdefault(q, {})[a] = stop + q
        (self.open.add if stop + q == len(self.codes) else self.open.discard)((q, a))
        if stop + q - a >= max(LEAST, TIMES * q):
            self.runs.append((a, stop + q, q))

    def _covered(self, begin, end):
        """Whether a run of the cover contains begin to end."""
        starts, reach = self.cover
        at = np.searchsorted(starts, begin, "right") - 1
        return (at >= 0) & (reach[np.maximum(at, 0)] >= end) if len(starts) else np.zeros(np.shape(begin), bool)

    def _recover(self, below: int):
        """The cover from all runs with periods below a bound."""
        ends = np.array(self.runs, np.int64).reshape(-1, 3)
        ends = ends[ends[:, 2] < below]
        ends = ends[np.lexsort((-ends[:, 1], ends[:, 0]))]
        self.cover = np.array([ends[:, 0], np.maximum.accumulate(ends[:, 1]) if len(ends) else ends[:, 1]])

    def _caught(self, block, place, size):
        """Blocks that recur at `place`: stretches of their periods, smallest first."""
        self._recover(size)
        new = ~self._covered(block, place + size)
        block, period = block[new], (place - block)[new]
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        edges = np.flatnonzero(np.diff(period, prepend=0, append=0))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            q, blocks = int(period[i]), block[i:j]
            blocks = blocks[~self._covered(blocks, blocks + q + size)]
            known, seen = self.found.get(q, {}), len(self.runs)
            if len(blocks) > MANY:
                self._all(q, int(blocks[0]), int(blocks[-1]) + size)
            else:
                last = max(known.values(), default=-1) if known else -1
                for m in blocks.tolist():
                    if m + q + size <= last:    # stretches of one period in order: the last one that was found reaches as far as any
                        continue
                    a, stop = self._left(m, q), self._right(m, q)
                    if stop > m and self.found.get(q, {}).get(a) != stop + q:
                        self._grow(q, a, stop)
                    last = max(last, stop + q)
            if len(self.runs) != seen:
                self._recover(q + 1)

    def _all(self, q: int, begin: int, end: int):
        """All stretches of period q that meet begin to end, by one comparison of the whole."""
        begin, end = self._left(begin, q), self._right(end, q)
        same = np.concatenate(([False], self.codes[begin:end] == self.codes[begin + q:end + q], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1]) + begin
        for a, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            self._grow(q, a, stop)

    def finish(self) -> np.ndarray:
        """Rows (start, end, period) of all runs by start and period: stretches long enough whose period no contained smaller one explains."""
        out, self.runs, self.cover = [], [], np.zeros((2, 0), np.int64)
        for q in sorted(self.found):
            long = [(a, e) for a, e in self.found[q].items() if e - a >= max(LEAST, TIMES * q)]
            if not long:
                continue
            a, e = np.array(long, np.int64).T
            own = ~self._covered(a, e)
            out += [(x, y, q) for x, y in zip(a[own].tolist(), e[own].tolist(), strict=True)]
            self.runs = out
            self._recover(q + 1)
        return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)
