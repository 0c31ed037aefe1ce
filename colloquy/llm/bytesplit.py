"""Words of many texts at once as numpy arrays: boundaries and 64-bit hashes.

Texts come as UTF-8 bytes. A batch is cut into pieces of about PIECE bytes (a longer
text is a piece of its own), which bounds the memory of the arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = seeds(256, 11)
_BYTE[_GAP] = 0
_PLACE = seeds(4096, 12) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = seeds(1 << int(n - 1).bit_length(), 12) | np.uint64(1)
    return _PLACE


def pieces(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The UTF-8 bytes of a string column, null as empty, in runs of about PIECE bytes: (first row, texts).

    Only one run at a time is held as Python objects.
    """
    column = column.cast(pa.binary())
    first, size = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if size and size + n > PIECE:
            yield first, [x or b"" for x in column.slice(first, k - first).to_pylist()]
            first, size = k, 0
        size += n + 1
    if first < len(column):
        yield first, [x or b"" for x in column.slice(first).to_pylist()]


def trim() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and so would their peaks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def split(texts: list[bytes], lower: bool = True, spans: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all words in order, and where each text's words start: one more entry than texts.

    A word's hash is the sum over its bytes of a random number for the byte times one
    for its place, then mixed; equal words have equal hashes whatever stands around them.
    With ``spans`` also the bytes of all texts and where in them words start and end.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = _GAP[buf]
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(lens + 1)))
    bounds = np.searchsorted(starts, at)
    more = (buf, starts, np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))) if spans else ()
    if not len(starts):
        return np.zeros(0, np.uint64), bounds, *more
    widths = np.diff(np.append(starts, len(buf)))
    place = np.arange(len(buf) - starts[0]) - np.repeat(starts - starts[0], widths)
    g = _BYTE[_LOWER[buf[starts[0] :]] if lower else buf[starts[0] :]]
    g *= _places(int(widths.max()))[place]
    return mix(np.add.reduceat(g, starts - starts[0])), bounds, *more


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; the whole sequence as one where it is shorter."""
    n = len(words)
    mult = seeds(width, 13) | np.uint64(1)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h[: n - k] += words[k:] * mult[k] if n > k else 0
    h = mix(h)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            short = (mix(words[a:b]) * mult[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short ^ mult[b - a : b - a + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
