"""Vectorised hashing of words and windows over Arrow text columns.

Everything works on one flat byte buffer per Arrow batch, so no Python object
is made per word.  Hashes are 64 bits wide: a polynomial over bytes (prefix
sums, wrapping modulo 2**64) put through a bit mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2 ** 64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_KEY = mix(np.arange(256, dtype=np.uint64), seed=7)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts back to back, and where each text starts (n + 1).

    A null text counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_large_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset:]
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[starts[0]:starts[-1]]
    return raw, starts - starts[0]


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        step = np.uint64(base)
        while done < n:
            take = min(done, n - done)
            out[done:done + take] = out[:take] * step
            step = step * step if done * 2 < n else step
            done += take
    return out[:max(n, 0)]


INVERSE = np.uint64(pow(int(BASE), -1, 2 ** 64))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """sums[i] = sum over j < i of key(raw[j]) * BASE**j, wrapping."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_KEY[raw] * powers(len(raw), BASE), out=sums[1:])
    return sums


def word_spans(raw: np.ndarray, starts: np.ndarray,
               space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every run of non-space bytes, and the text it lies in.

    Words never run across two texts.
    """
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~space[raw]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    end = np.zeros(len(raw) + 1, dtype=bool)
    end[1:-1] = solid[:-1] & ~solid[1:]
    end[-1] = solid[-1]
    edge = starts[1:-1]
    edge = np.unique(edge[(edge > 0) & (edge < len(raw))])
    joined = edge[solid[edge] & solid[edge - 1]]
    begin[joined] = True
    end[joined] = True
    b, e = np.flatnonzero(begin), np.flatnonzero(end)
    owner = np.searchsorted(starts, b, side="right") - 1
    return b, e, owner


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal bytes give equal hashes."""
    sums = prefix_sums(raw)
    with np.errstate(over="ignore"):
        value = (sums[end] - sums[begin]) * powers(len(raw) + 1, INVERSE)[begin]
        return mix(value + mix((end - begin).astype(np.uint64), seed=3), seed=1)


def window_hashes(raw: np.ndarray, width: int, sums: np.ndarray | None = None,
                  back: np.ndarray | None = None) -> np.ndarray:
    """Hash of raw[i:i + width] for every i that leaves room."""
    n = len(raw) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(raw) if sums is None else sums
    back = powers(len(raw) + 1, INVERSE) if back is None else back
    with np.errstate(over="ignore"):
        return mix((sums[width:width + n] - sums[:n]) * back[:n], seed=2)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width] for every i that leaves room, by doubling."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out
