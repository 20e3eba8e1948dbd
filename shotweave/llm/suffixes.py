"""Equal fixed-length prefixes of suffixes by a difference-cover suffix sort (modulo 3), over one task's text."""
import numpy as np

PACK = 21                                       # bits of a rank, so that three make one 63-bit key


def ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of 64-bit keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
    return out


def name(a, b, c):
    """Ranks of triples of ranks, in the order of the triples."""
    if len(a) and max(int(a.max()), int(b.max()), int(c.max())) >= 1 << PACK:
        return ranks(ranks(a << 31 | b) << 31 | c)
    return ranks(a << (2 * PACK) | b << PACK | c)


def least_equal(text: np.ndarray, starts: np.ndarray, owners: np.ndarray, length: int = 50) -> np.ndarray:
    """For each start the least owner of any start with the same `length` bytes from there on.

    1. Suffixes at positions 1 and 2 modulo 3 are sorted by triples of bytes, then triples of the names so found, and again: 3, 9, 27 and `length` - 2 bytes,
    as more is never compared. 2. Those at 0 modulo 3 are merged with either class over the shift that takes both to named positions: up to two bytes and a name.
    3. In each sorted order adjacent prefixes are compared, and runs of equal ones take their least owner. `length` is 50 to 56.
    """
    assert 48 + 2 <= length <= 56
    padded = np.concatenate((text, np.zeros(length + 64, np.uint8)))
    shade = np.zeros(256, np.int32)
    shade[np.unique(padded)] = 1
    shade = np.cumsum(shade, dtype=np.int32) - 1
    n = len(text) + 64
    byte = shade[padded]
    symbols = int(byte.max()) + 1
    three = (byte[:-2] * symbols + byte[1:-1]) * symbols + byte[2:]
    small = three if symbols ** 3 < 1 << PACK else ranks(three).astype(np.int32)
    needed = np.zeros(n, bool)                           # sampled positions whose long names are compared
    for shift in range(3):
        needed[starts[(starts + shift) % 3 != 0] + shift] = True
    at = np.flatnonzero(needed)
    wide = np.zeros(n, bool)
    for shift in (0, 9, 18, 27, 36):
        wide[at[at + shift < n] + shift] = True
    mid = np.flatnonzero(wide)
    nine = np.zeros(n, np.int32)
    get = lambda a, x: a[np.minimum(x, len(a) - 1)].astype(np.int64)
    nine[mid] = name(get(small, mid), get(small, mid + 3), get(small, mid + 6))
    long = np.zeros(n, np.int64)
    first = name(get(nine, at), get(nine, at + 9), get(nine, at + 18))
    second = name(first, get(nine, at + 27), get(nine, at + 36))
    del nine, wide, mid, first
    long[at] = ranks(second << 24 | get(three, at + 45))                 # 48 bytes
    del three, small, second, at, needed
    tail = length - 48

    best = owners.copy()
    for shift, classes in ((0, (1, 2)), (1, (0, 1)), (2, (0, 2))):
        mine = np.flatnonzero(np.isin(starts % 3, classes))
        if not len(mine):
            continue
        s = starts[mine]
        key = long[s + shift]
        for k in (*range(shift), *range(shift + 48, 48 + tail)):
            key = key << 8 | byte[s + k]
            if k >= shift + 48 or shift:
                key = ranks(key) if int(key.max()) >= 1 << 54 else key
        order = np.argsort(key)
        ordered = key[order]
        edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        least = np.minimum.reduceat(owners[mine][order], edges)
        best[mine[order]] = np.minimum(best[mine[order]], np.repeat(least, np.diff(np.append(edges, len(order)))))
    return best
