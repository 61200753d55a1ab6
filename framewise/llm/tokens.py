"""Vectorised tokenising and hashing of Arrow text columns.

Texts are UTF-8 bytes.  Word classes that are unions of ASCII characters and
"everything from 0x80 up" are exact on bytes, so a 256-entry table decides
word membership.  Work proceeds in slices of about a megabyte, so memory is
bounded by the slice or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

SPACE_SEPARATED = np.ones(256, bool)          # [^\x20\x09-\x0D]+
SPACE_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False

ALNUM = np.zeros(256, bool)                   # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("p", _BASE), ("q", inverse)):
            a = np.full(size, base, U)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=U)
    return _POWERS["p"], _POWERS["q"]


@dataclass
class Slice:
    """Consecutive rows of a batch: their bytes end to end and offsets."""
    first: int
    last: int
    data: np.ndarray        # uint8
    offsets: np.ndarray     # int64, last - first + 1 entries from 0

    def lowered(self) -> np.ndarray:
        return LOWER[self.data]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string (or binary) column into slices of whole rows, each about
    ``limit`` bytes; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) \
        else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Slice(i, j, raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        i = j


@dataclass
class Words:
    starts: np.ndarray      # byte positions in the slice
    ends: np.ndarray
    bounds: np.ndarray      # words of row r: bounds[r] .. bounds[r + 1]

    def row_end(self) -> np.ndarray:
        """For each word, the index one past the last word of its row."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds))

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    begin = inside[1:] & ~inside[:-1]           # entry i: a word starts at byte i
    stop = inside[:-1] & ~inside[1:]            # entry i: a word ends before byte i
    cut = offsets[(offsets > 0) & (offsets < n)]
    begin[cut] = inside[cut + 1]
    stop[cut] = inside[cut]
    starts, ends = np.flatnonzero(begin[:n]), np.flatnonzero(stop)
    return Words(starts, ends, np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """64-bit hash of each word's bytes (position independent)."""
    p, q = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[:len(data)], dtype=U, out=sums[1:])
    h = (sums[w.ends] - sums[w.starts]) * q[w.starts]
    return mix(h + (w.ends - w.starts).astype(U) * U(0xD6E8FEB86659FD93))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``h[i : i + k]`` for every start i (the last k - 1 starts are
    meaningless and come back as 0)."""
    out = np.zeros(len(h), U)
    m = len(h) - k + 1
    if m <= 0:
        return out
    acc = np.zeros(m, U)
    for j in range(k):
        acc = acc * U(0xC2B2AE3D27D4EB4F) + h[j:j + m]
    out[:m] = mix(acc + U(k))
    return out
