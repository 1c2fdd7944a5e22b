"""Content-defined chunking of byte strings, vectorised over a whole Arrow batch."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (the public splitmix64 one)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


#: One random word per byte value, made by rule.
GEAR = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
WINDOW = 16
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def chunk(texts: list[bytes], least: int = 16, bits: int = 3, most: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, hash) of each chunk of each text, in order.

    A boundary follows a byte where `bits` bits of the rolling hash of the WINDOW bytes up to it in the text are 0, unless
    another such place is fewer than `least` bytes before it or an end of the text is that near. Stretches of more
    than `most` bytes are cut every `most` bytes, with no rest under `least`. All of it depends on near content only,
    so an insertion changes the chunks around it and no others. Empty texts have no chunks.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    words = GEAR[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    row = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(total) - starts[row]
    rolling = words.copy()
    with np.errstate(over="ignore"):
        for j in range(1, WINDOW):
            rolling[j:] += np.where(offset[j:] >= j, words[:-j] << _U(j), _U(0))
        raw = np.flatnonzero((((rolling >> _U(WINDOW)) & _U((1 << bits) - 1)) == 0) & (offset + 1 >= least) & (sizes[row] - offset - 1 >= least))
    if len(raw):
        near = (np.diff(raw, prepend=-least) < least) & (np.diff(row[raw], prepend=-1) == 0)
        raw = raw[~near]
    begin = np.union1d(starts[sizes > 0], raw + 1)
    length = np.diff(begin, append=total)
    pieces = np.maximum(1, length // most)
    pieces -= (pieces > 1) & (length - (pieces - 1) * most < least)
    pieces += length - pieces * most >= least
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(begin, pieces) + nth * most
    length = np.diff(begin, append=total)
    with np.errstate(over="ignore"):
        sums = np.zeros(total + 1, dtype=np.uint64)
        np.cumsum(words * _powers(_BASE, total - 1), dtype=np.uint64, out=sums[1:])
        value = (sums[begin + length] - sums[begin]) * _powers(_UNBASE, total - 1)[begin]
        value = mix64(value + length.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return row[begin], length, value.view(np.int64)
