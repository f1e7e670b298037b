"""Vectorised cutting and hashing of whole texts, one Arrow batch at a time (numpy, inside tasks).

Texts arrive as UTF-8 bytes. A run is a stretch of neighbouring rows of bounded size
(or one longer text); words are cut and hashed for a whole run at once. Hashes are
64 bits of a polynomial over random byte codes, taken in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN = 4 << 20
BLOCK = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True

_rng = np.random.Generator(np.random.PCG64(20240817))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("up", ())) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _pow[name] = np.multiply.accumulate(p)
    return _pow["up"], _pow["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets and null flags of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets, np.asarray(column.is_null().to_numpy(zero_copy_only=False), dtype=bool)


def runs(column: pa.Array, most: int = RUN) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of stretches of rows with at most `most` bytes, or one row."""
    raw, offs, _ = buffers(column)
    n, first = len(offs) - 1, 0
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of a run; a word never crosses rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edge = offs[:-1]
    edge = edge[edge < n]
    begin[edge] = solid[edge]
    stop = np.zeros(n + 1, dtype=bool)
    stop[1:] = solid
    stop[1:n] &= ~solid[1:]
    inner = edge[edge > 0]
    stop[inner] = solid[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that tile the rows of a run: the white space before a word, and the word."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    blank = SPACE[data]
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    edge = offs[:-1]
    begin[edge[edge < n]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the \\n-separated lines that hold a word."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    breaks = np.flatnonzero(data == 10)
    edge = offs[:-1]
    starts = np.union1d(edge[edge < n], breaks[breaks + 1 < n] + 1)
    row = np.searchsorted(offs, starts, side="right") - 1
    stop = np.append(starts[1:], n)
    ends = np.where(data[stop - 1] == 10, stop - 1, stop)
    seen = np.concatenate(([0], np.cumsum(~SPACE[data])))
    full = seen[ends] > seen[starts]
    return starts[full], ends[full], row[full]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every (sorted, disjoint) stretch; memory is bounded by blocks."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        upto = max(int(np.searchsorted(starts, lo + BLOCK, side="left")), at + 1)
        hi = int(ends[upto - 1])
        up, down = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_CODE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[at:upto] - lo, ends[at:upto] - lo
        out[at:upto] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = upto
    return out


def repeats(keys: np.ndarray) -> np.ndarray:
    """Marks the elements whose key occurs at least twice."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    marked = np.zeros(len(keys), dtype=bool)
    marked[order[1:][same]] = True
    marked[order[:-1][same]] = True
    return marked


def per_row(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of a byte-wise flag or number over each row of a run."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]
