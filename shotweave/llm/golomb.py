"""Golomb-Rice coding of sorted distinct integers, vectorised."""
import numpy as np


def encode(values: np.ndarray) -> tuple[int, bytes]:
    """(bits of a remainder, coded gaps) of ascending distinct values below 2**62."""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(-1)) - 1
    width = max(0, int(np.log2(max(1.0, float(gaps.mean()) * 0.69)))) if len(gaps) else 0
    ones = np.cumsum((gaps >> width) + 1) - 1            # a gap's quotient in unary: zeros, then a one
    unary = np.zeros(int(ones[-1]) + 1 if len(ones) else 0, np.uint8)
    unary[ones] = 1
    low = ((gaps[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    return width, np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def decode(n: int, width: int, blob: bytes) -> np.ndarray:
    """The n values that encode() was given."""
    tail = -(-n * width // 8)
    raw = np.frombuffer(blob, np.uint8)
    ones = np.flatnonzero(np.unpackbits(raw[:len(raw) - tail]))[:n]
    high = np.diff(ones, prepend=-1) - 1
    low = np.unpackbits(raw[len(raw) - tail:])[:n * width].reshape(n, width).astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))
    return np.cumsum((high.astype(np.int64) << width) + low + 1) - 1
