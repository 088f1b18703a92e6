"""Names of byte strings by prefix doubling, and the runs of windows that one anchor stands for.

A window is a string of ``size`` bytes at any position. Names of 8 bytes are paired into names
of 16, then 25, 50 and 100 bytes at growing offsets; the name of a longer string is the pair of
the names of its overlapping halves. Each window is represented by the leftmost least ``GRAM``-byte
name inside it, so windows of equal content choose the same inner position, wherever they stand.
Neighbouring windows that choose the same position form a *run*: one row instead of many.
"""

from __future__ import annotations

import numpy as np

from .common import U64, chunks, mix
from .repeats import RUN_FIELDS, gathered

GRAM = 100
_POS_BITS = 22
_TILE = 1 << 17


def gram_names(data: np.ndarray) -> np.ndarray:
    """Names of all ``GRAM``-byte strings of ``data``: lengths 8, 16, 25, 50, 100."""
    n = len(data) - 7
    if n < GRAM - 7:
        return np.zeros(0, U64)
    raw = np.ascontiguousarray(data)
    h = np.ndarray((n,), "<u8", raw, strides=(1,)).astype(U64)
    for shift in (8, 9, 25, 50):
        h = mix(h[:-shift], h[shift:], shift)
    return h


def window_name(grams: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Names of the ``size``-byte strings at ``at``, by doubling from ``GRAM`` bytes."""

    def name(at: np.ndarray, length: int) -> np.ndarray:
        if length == GRAM:
            return grams[at]
        half = max(GRAM, (length + 1) // 2)
        return mix(name(at, half), name(at + (length - half), half), length)

    return name(at, size)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[:-rest], out[rest:])
    return out


def _tiles(offsets: np.ndarray, size: int):
    """(first document, end document, from byte, to byte): short documents together, long ones cut.

    A cut document's tiles overlap by ``size - 1`` bytes, so each window is in exactly one tile.
    """
    for first, last in chunks(offsets, _TILE):
        lo, hi = int(offsets[first]), int(offsets[last])
        if last - first > 1 or hi - lo <= 2 * _TILE:
            yield first, last, lo, hi
            continue
        while hi - lo >= size:
            yield first, last, lo, min(hi, lo + _TILE + size - 1)
            lo += _TILE


def byte_runs(data: np.ndarray, offsets: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Runs of all windows: document index, anchor name, run name, first and last window start."""
    parts: dict[str, list] = {k: [] for k in RUN_FIELDS}
    for first, last, lo, hi in _tiles(offsets, size):
        grams = gram_names(data[lo:hi])
        if hi - lo < size or not len(grams):
            continue
        packed = (grams >> U64(_POS_BITS)) << U64(_POS_BITS)
        packed |= np.arange(len(grams), dtype=U64)
        inner = size - GRAM + 1
        anchor = (_least(packed, inner) & U64((1 << _POS_BITS) - 1)).astype(np.int64)
        starts = offsets[first:last] - lo
        ends = offsets[first + 1 : last + 1] - lo
        ok = np.zeros(len(anchor) + 1, np.int8)
        good = (ends - np.maximum(starts, 0) >= size) & (starts < len(anchor))
        np.add.at(ok, np.maximum(starts[good], 0), 1)
        np.add.at(ok, np.minimum(ends[good] - size + 1, len(anchor)), -1)
        valid = np.cumsum(ok[:-1]) > 0
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
        if last - first > 1:
            new[starts[good]] = True
        l = np.flatnonzero(new)
        r = np.append(l[1:] - 1, len(anchor) - 1)
        keep = valid[l]
        l, r = l[keep], r[keep]
        a = anchor[l]
        doc = np.searchsorted(offsets, l + lo, side="right") - 1
        shape = ((a - l).astype(U64) << U64(32)) | (r - l).astype(U64)
        rk = mix(mix(window_name(grams, l, size), window_name(grams, r, size), 1), shape, 2)
        base = offsets[doc] - lo
        for k, v in (("doc", doc), ("sym", grams[a]), ("rk", rk), ("l", l - base), ("r", r - base), ("a", a - base)):
            parts[k].append(v)
    return gathered(parts)


class ByteUnit:
    """Bytes of a text as the units of ``repeats``: windows of ``size`` bytes."""

    bytes_each = 1

    def __init__(self, size: int):
        if size < 2 * GRAM:
            raise ValueError(f"windows have {2 * GRAM} bytes at least")
        self.size = size

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        return byte_runs(data, offsets, self.size)

    def slices(self, text: np.ndarray, l: np.ndarray, r: np.ndarray) -> list[bytes]:
        raw = text.tobytes()
        return [raw[x : y + self.size] for x, y in zip(l.tolist(), r.tolist(), strict=True)]

    def namer(self, blob: bytes):
        """name(at, length) for strings inside slices that stand one after another in ``blob``."""
        grams = gram_names(np.frombuffer(blob, np.uint8))
        return lambda at, length: window_name(grams, at, length)
