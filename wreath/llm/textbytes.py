"""Vectorised words and word hashes over the UTF-8 bytes of Arrow string columns.

Everything here runs inside Arrow UDF tasks on one batch; a batch is walked in
row slices of bounded size, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wreath import session

BASE = np.uint64(0x9E3779B97F4A7C15)   # odd, so it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lookup_table(separators) -> np.ndarray:
    """Byte table: A-Z lower-cased, separator bytes to 0."""
    lut = _LOWER.copy()
    lut[list(separators)] = 0
    return lut


#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = lookup_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z (a NUL byte counts as byte 1)
SPACED = lookup_table([0x20, *range(0x09, 0x0E)])
SPACED[0] = 1

_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) <= n:
        size = max(2 * n, 1 << 16)
        with np.errstate(over="ignore"):
            for k, base in (("up", BASE), ("down", BASE_INVERSE)):
                p = np.full(size + 1, base, np.uint64)
                p[0] = 1
                _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def give_back() -> None:
    """Return freed memory of this worker to the system, the table of powers too, which is soon made again."""
    _POWERS.update({k: v[:1].copy() for k, v in _POWERS.items()})
    session.give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0])
    return raw[first: int(offsets[-1])], offsets.astype(np.int64) - first


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray):
    """(mapped bytes, word starts, word ends, row of each word)."""
    mapped = lut[data]
    inside = mapped != 0
    if not len(data):
        z = np.zeros(0, np.int64)
        return mapped, z, z, z
    edges = offsets[:-1]
    edges = edges[edges < len(data)]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets[1:], starts, side="right")
    return mapped, starts, ends, rows


def span_hashes(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = SLICE_BYTES) -> np.ndarray:
    """64-bit polynomial hash of each span, from prefix sums modulo 2**64."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + piece, side="right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            up, down = _powers(hi - lo)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(mapped[lo:hi].astype(np.uint64) * up[: hi - lo], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * down[s]
            i = j
    return mix(out)


def words(column, lut: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per row slice: (first row, last row + 1, word hashes, row of each word
    counted from the first)."""
    data, offsets = utf8(column)
    for i, j in row_slices(offsets, limit):
        off = offsets[i: j + 1]
        mapped, s, e, rows = word_spans(data[off[0]: off[-1]], off - off[0], lut)
        yield i, j, span_hashes(mapped, s, e), rows


def grams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Ordered hash of every k consecutive entries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = np.full(n, np.uint64(salt * 2 + 1), np.uint64)
        for j in range(k):
            acc = mix(acc * BASE + hashes[j: j + n])
    return acc


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
