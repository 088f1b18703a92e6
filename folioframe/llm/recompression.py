"""Words of texts as globally named symbols, by rounds of recompression.

Each round first replaces maximal runs of one symbol by a symbol for (symbol, count), then pairs
(left, right), where a bit of each symbol's name says on which side of a pair it may stand. Names are
hashes of what they stand for, so a symbol means the same words in every document and no dictionary
has to be shared. Whether a symbol arises depends on a bounded neighbourhood, tracked with it: symbols
whose neighbourhood lies inside a window are *interior*, and equal windows have equal interior symbols.
A window is represented by the least-named interior symbol of the highest round that has one.
"""

from __future__ import annotations

import numpy as np

from .common import U64, chunks, mix
from .repeats import RUN_FIELDS, gathered

ROUNDS = 3
_STEP = U64(0x9E3779B97F4A7C15)
_TILE = 1 << 17
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BACK = U64(pow(int(_STEP), -1, 1 << 64))
_BYTE = mix(np.arange(256, dtype=U64) + U64(1), np.full(256, 77, U64), 9)
_CACHE: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, kept for the next call."""
    if len(_CACHE.get("up", ())) < n:
        _CACHE["up"] = _powers(n)
        down = np.full(n, _BACK, U64)
        down[:1] = 1
        _CACHE["down"] = np.multiply.accumulate(down)
    return _CACHE["up"], _CACHE["down"]


class RangeNames:
    """Names of any ranges of a sequence in constant time, from prefix sums."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = _tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start], (end - start).astype(U64), 11)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word. White space is ASCII, so UTF-8 needs no decoding."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_GAP[data]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return RangeNames(_BYTE[data])(start, end)


def _rounds(names: np.ndarray, fixed: np.ndarray, rounds: int):
    """Symbols after each round: name, first word, and the words [low, high) that decide it.

    ``fixed`` marks separators, which never merge and so end every neighbourhood.
    """
    n = len(names)
    start, low, high = np.arange(n), np.arange(n), np.arange(1, n + 1)
    yield names, start, low, high, fixed

    def widen(low, high):
        return np.append(low[:1], low[:-1]), np.append(high[1:], high[-1:])

    for k in range(rounds):
        first = np.ones(len(names), bool)
        first[1:] = (names[1:] != names[:-1]) | fixed[1:] | fixed[:-1]
        at = np.flatnonzero(first)
        end = np.append(at[1:], len(names))
        count = end - at
        low, high = widen(low, high)  # the next symbols must be known to differ
        low, high = low[at], high[end - 1]
        name = names[at]
        names = np.where(count > 1, mix(name, count.astype(U64), 20), name)
        start, fixed = start[at], fixed[at]

        left = ((mix(names, np.full(len(names), k, U64), 21) & U64(1)) == 0) & ~fixed
        right = ~left & ~fixed
        join = np.zeros(len(names), bool)
        join[:-1] = left[:-1] & right[1:]
        head = np.ones(len(names), bool)
        head[1:] = ~join[:-1]
        at = np.flatnonzero(head)
        two = join[at]
        other = np.minimum(at + two, len(names) - 1)
        merged = mix(names[at], names[other], 22)
        wide_low, wide_high = widen(low, high)
        # A symbol that stayed alone was decided by the neighbour on the side where it might have merged.
        lo = np.where(two | left[at], low[at], wide_low[at])
        hi = np.where(two, high[other], np.where(left[at], wide_high[at], high[at]))
        names, start, low, high, fixed = np.where(two, merged, names[at]), start[at], lo, hi, fixed[at]
        yield names, start, low, high, fixed


def _range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the leftmost least value in each [lo, hi); hi > lo."""
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    if len(values) > 1:  # equal values share a rank, told apart by place
        same = np.append(0, np.cumsum(values[order][1:] != values[order][:-1]))
        rank[order] = same
    packed = rank * len(values) + np.arange(len(values))
    levels, step = [packed], 1
    most = int((hi - lo).max()) if len(lo) else 0
    while step * 2 <= most:
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        step *= 2
    width = hi - lo
    power = np.frexp(width.astype(float))[1] - 1
    out = np.empty(len(lo), np.int64)
    for p in range(len(levels)):
        at = np.flatnonzero(power == p)
        if len(at):
            out[at] = np.minimum(levels[p][lo[at]], levels[p][hi[at] - (1 << p)])
    return out % len(values)


def word_runs(data: np.ndarray, offsets: np.ndarray, size: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Runs of all windows of ``size`` words; places are word numbers within the document."""
    parts: dict[str, list] = {k: [] for k in RUN_FIELDS}
    for first, last in chunks(offsets, _TILE):
        lo, hi = int(offsets[first]), int(offsets[last])
        part = data[lo:hi]
        if not len(part):
            continue
        begin, end = words(part)
        # Words do not cross documents: cut those that touch a border.
        border = offsets[first + 1 : last] - lo
        inside = np.searchsorted(begin, border, side="left") - 1
        cut = border[(inside >= 0) & (border > begin[np.maximum(inside, 0)]) & (border < end[np.maximum(inside, 0)])]
        cut = np.unique(cut)
        begin, end = np.sort(np.append(begin, cut)), np.sort(np.append(end, cut))
        doc = np.searchsorted(offsets, begin + lo, side="right") - 1
        n_docs = last - first
        counts = np.bincount(doc - first, minlength=n_docs)
        if counts.max(initial=0) < size:
            continue
        # One separator before each document and one at the end, with names that no word shares by place.
        base = np.cumsum(counts) - counts + np.arange(1, n_docs + 1)
        total = len(begin) + n_docs + 1
        values = np.zeros(total, U64)
        fixed = np.ones(total, bool)
        place = np.arange(len(begin)) + (doc - first) + 1
        values[place] = word_names(part, begin, end)
        fixed[place] = False
        long = np.flatnonzero(counts >= size)
        p = np.concatenate([np.arange(base[i], base[i] + counts[i] - size + 1) for i in long])
        anchor = np.full(len(p), -1)
        sym = np.zeros(len(p), U64)
        spans = RangeNames(values)
        open_ = np.arange(len(p))
        for level, (names, start, low, high, fix) in reversed(list(enumerate(_rounds(values, fixed, rounds)))):
            ps = p[open_]
            a, b = np.searchsorted(low, ps, "left"), np.searchsorted(high, ps + size, "right")
            some = b > a
            got = open_[some]
            if len(got):
                context = mix(spans(low, high), mix(names, (start - low).astype(U64), 23), 24 + level)
                pick = _range_least(context, a[some], b[some])
                anchor[got] = start[pick]
                sym[got] = context[pick]
            open_ = open_[~some]
            if not len(open_):
                break
        new = np.ones(len(p), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (sym[1:] != sym[:-1]) | (p[1:] != p[:-1] + 1)
        at = np.flatnonzero(new)
        l, r = p[at], p[np.append(at[1:], len(p)) - 1]
        a = anchor[at]
        shape = ((a - l).astype(U64) << U64(32)) | (r - l).astype(U64)
        rk = mix(spans(l, r + size), shape, 2)
        d = np.searchsorted(base, l, side="right") - 1
        for k, v in (("doc", d + first), ("sym", sym[at]), ("rk", rk), ("l", l - base[d]), ("r", r - base[d]), ("a", a - base[d])):
            parts[k].append(v)
    return gathered(parts)


class WordUnit:
    """Words of a text as the units of ``repeats``: windows of ``size`` words."""

    bytes_each = 8

    def __init__(self, size: int, rounds: int = ROUNDS):
        self.size, self.rounds = size, rounds

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        return word_runs(data, offsets, self.size, self.rounds)

    def slices(self, text: np.ndarray, l: np.ndarray, r: np.ndarray) -> list[bytes]:
        raw = word_names(text, *words(text)).tobytes()
        return [raw[8 * x : 8 * (y + self.size)] for x, y in zip(l.tolist(), r.tolist(), strict=True)]

    def namer(self, blob: bytes):
        name = RangeNames(np.frombuffer(blob, U64))
        return lambda at, length: name(at, at + length)
