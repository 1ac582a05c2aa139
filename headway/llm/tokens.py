"""Words of whole Arrow text columns as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = (32, 9, 10, 11, 12, 13)
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def classes(*, symbols: bool) -> np.ndarray:
    """Class of each byte: 0 separates; with ``symbols`` signs (2) and letters or digits (1) part."""
    kind = np.ones(256, np.uint8)
    if symbols:
        kind[:128] = 2
        for low, high in ((48, 58), (65, 91), (97, 123)):
            kind[low:high] = 1
    kind[list(SPACE)] = 0
    return kind


WORDS = classes(symbols=False)
RUNS = classes(symbols=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(size, base, U)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def pieces(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about ``limit`` bytes each (one row at least), with their first row."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(size) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield a, texts.slice(a, b - a)


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column.cast(pa.large_string()), "")


def hashes(texts: pa.Array, kind: np.ndarray = WORDS, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a text array without nulls, and the first word of each row (n + 1 bounds)."""
    found, _, bounds = stem_hashes(texts, 0, kind, lower)
    return found, bounds


def stem_hashes(texts: pa.Array, stem: int, kind: np.ndarray = WORDS, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``hashes``, and between both the hash of each word's first ``stem`` characters (0: none)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    n = int(offsets[-1] - offsets[0]) if len(texts) else 0
    if not n:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    what = kind[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(what[1:], what[:-1], out=edge[1:n])
    edge[at] = True
    inside = what != 0
    starts = np.flatnonzero(edge[:n] & inside)
    ends = np.flatnonzero(edge[1:] & inside) + 1
    up, down = _power(n)
    total = np.zeros(n + 1, U)
    np.cumsum((_LOWER if lower else _BYTE)[data] * up, out=total[1:])
    found = mix((total[ends] - total[starts]) * down[starts])
    begun = np.zeros(0, U)
    if stem:
        heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), np.full(stem, n))
        cut = np.minimum(heads[np.searchsorted(heads, starts) + stem], ends)
        begun = mix((total[cut] - total[starts]) * down[starts])
    return found, begun, np.searchsorted(starts, at).astype(np.int64)


def owners(bounds: np.ndarray) -> np.ndarray:
    """Row number of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; rows without values give 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
