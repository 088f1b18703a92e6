"""Content streams: tokens to operations, and the fold that turns operations into runs of glyphs."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

from ..functions.geometry import Matrix
from .pdf_fonts import Font
from .pdf_objects import Lexer, Name, Op

_INLINE_END = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)")
#: The tokens that most streams consist of: whole and decimal numbers, operators, strings without escapes, names, hexadecimal strings.
_END = rb"(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$)"
_PLAIN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:([+-]?\d+)" + _END + rb"|([+-]?\d*\.\d+)" + _END + rb"|((?!(?:true|false|null)" + _END + rb")[A-Za-z'\"][A-Za-z0-9'\"*]*)" + _END + rb"|\(([^()\\]*)\)|/([A-Za-z0-9_+.-]*)" + _END + rb"|<((?:[0-9A-Fa-f]{2})*)>)")


def _item(m: re.Match):
    """The object of a plain token that is no operator."""
    kind, raw = m.lastindex, m[m.lastindex]
    if kind == 1:
        return int(raw)
    if kind == 2:
        return float(raw)
    if kind == 4:
        return raw
    if kind == 5:
        return Name(raw.decode("latin-1"))
    return bytes.fromhex(raw.decode())


def _array(data: bytes, at: int) -> tuple[list, int] | None:
    """Items and end of the array that starts before ``at``, if it holds plain tokens only."""
    items = []
    while m := _PLAIN.match(data, at):
        if m.lastindex == 3:
            return None
        items.append(_item(m))
        at = m.end()
    while data[at : at + 1] in (b" ", b"\n", b"\r", b"\t"):
        at += 1
    return (items, at + 1) if data[at : at + 1] == b"]" else None


def operations(data: bytes) -> list[tuple[str, list]]:
    """(operator, operands); the payload of an inline image is skipped and reported as BI."""
    lex, operands, out = Lexer(data), [], []
    match = _PLAIN.match
    try:
        while True:
            m = match(data, lex.at)
            if m:
                lex.at = m.end()
                if m.lastindex != 3:
                    operands.append(_item(m))
                    continue
                item = m[3].decode("latin-1")
            else:
                if not lex.skip():
                    return out
                if data[lex.at : lex.at + 1] == b"[" and (found := _array(data, lex.at + 1)):
                    operands.append(found[0])
                    lex.at = found[1]
                    continue
                item = lex.next(False)
                if not isinstance(item, Op):
                    operands.append(item)
                    continue
            if item == "ID":
                end = _INLINE_END.search(data, lex.at)
                lex.at = end.end() if end else len(data)
                operands = []
                continue
            out.append((str(item), operands))
            operands = []
    except EOFError:
        return out


def is_scanned(ops: list[tuple[str, list]]) -> bool:
    """No text operator and at least one image or form."""
    image = False
    for op, _ in ops:
        if op in ("BT", "Tj", "TJ", "'", '"'):
            return False
        image = image or op in ("Do", "BI")
    return image


Six = tuple[float, float, float, float, float, float]
_ONE: Six = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _then(m: Six, n: Six) -> Six:
    """First the map ``m``, then ``n``."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def _moved(m: Six, x: float, y: float) -> Six:
    """The map that first moves by (x, y)."""
    a, b, c, d, e, f = m
    return (a, b, c, d, x * a + y * c + e, x * b + y * d + f)


class State:
    """What q saves; ``shown`` is the map to the displayed page."""

    __slots__ = ("ctm", "shown", "font", "size", "char_space", "word_space", "h_scale", "leading", "rise")

    def __init__(self, page_map: Six):
        self.ctm, self.shown = _ONE, page_map
        self.font: str | None = None
        self.size = self.h_scale = 1.0
        self.char_space = self.word_space = self.leading = self.rise = 0.0

    def copy(self) -> State:
        new = State.__new__(State)
        for k in State.__slots__:
            setattr(new, k, getattr(self, k))
        return new


def _num(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _first(operands: list, default: float = 0.0) -> float:
    return float(operands[0]) if operands and _num(operands[0]) else default


def _matrix(operands: list) -> Six | None:
    return tuple(map(float, operands)) if len(operands) == 6 and all(map(_num, operands)) else None


class TextMachine:
    """State of the walk; ``runs`` gets a tuple for each shown string that has glyphs:
    texts, widths (em), starts (advance before the glyph), matrix, font, size, horizontal scale, rise."""

    def __init__(self, fonts: dict[str, Font], page_map: Matrix):
        self.fonts = fonts
        self.page_map: Six = (page_map.a, page_map.b, page_map.c, page_map.d, page_map.e, page_map.f)
        self.stack = [State(self.page_map)]
        self.s = self.stack[0]
        self.tm = self.tlm = _ONE
        self.runs: list[tuple] = []
        self.plain = Font()
        self.steps = {
            "q": self._save, "Q": self._restore, "cm": self._concat, "BT": self._begin, "Tf": self._font, "Tc": self._char_space, "Tw": self._word_space, "Tz": self._h_scale, "TL": self._leading, "Ts": self._rise,
            "Tm": self._place, "Td": self._offset, "TD": self._offset_leading, "T*": self._next_line, "Tj": self._one, "'": self._line_one, '"': self._spaced_one, "TJ": self._many,
        }

    def step(self, op: str, args: list) -> None:
        found = self.steps.get(op)
        if found:
            found(args)

    def _save(self, args: list) -> None:
        self.s = self.s.copy()
        self.stack.append(self.s)

    def _restore(self, args: list) -> None:
        self.stack.pop()
        if not self.stack:
            self.stack.append(State(self.page_map))
        self.s = self.stack[-1]

    def _concat(self, args: list) -> None:
        m = _matrix(args)
        if m:
            self.s.ctm = _then(m, self.s.ctm)
            self.s.shown = _then(self.s.ctm, self.page_map)

    def _begin(self, args: list) -> None:
        self.tm = self.tlm = _ONE

    def _font(self, args: list) -> None:
        if len(args) > 1 and isinstance(args[0], Name) and _num(args[1]):
            self.s.font, self.s.size = str(args[0]), float(args[1])

    def _char_space(self, args: list) -> None:
        self.s.char_space = _first(args)

    def _word_space(self, args: list) -> None:
        self.s.word_space = _first(args)

    def _h_scale(self, args: list) -> None:
        self.s.h_scale = _first(args, 100.0) / 100

    def _leading(self, args: list) -> None:
        self.s.leading = _first(args)

    def _rise(self, args: list) -> None:
        self.s.rise = _first(args)

    def _place(self, args: list) -> None:
        m = _matrix(args)
        if m:
            self.tm = self.tlm = m

    def _offset(self, args: list) -> None:
        if len(args) > 1 and _num(args[0]) and _num(args[1]):
            self.tm = self.tlm = _moved(self.tlm, float(args[0]), float(args[1]))

    def _offset_leading(self, args: list) -> None:
        if len(args) > 1 and _num(args[0]) and _num(args[1]):
            self.s.leading = -float(args[1])
            self._offset(args)

    def _next_line(self, args: list) -> None:
        self.tm = self.tlm = _moved(self.tlm, 0.0, -self.s.leading)

    def _one(self, args: list) -> None:
        self._show(args[0] if args else None)

    def _line_one(self, args: list) -> None:
        self._next_line(args)
        self._show(args[0] if args else None)

    def _spaced_one(self, args: list) -> None:
        if len(args) == 3:
            self.s.word_space, self.s.char_space = _first(args), _first(args[1:])
        self._next_line(args)
        self._show(args[-1] if args else None)

    def _many(self, args: list) -> None:
        for item in args[0] if args and isinstance(args[0], list) else ():
            if _num(item):
                self.tm = _moved(self.tm, -(float(item) / 1000) * self.s.size * self.s.h_scale, 0.0)
            else:
                self._show(item)

    def _show(self, shown) -> None:
        if not isinstance(shown, bytes):
            return
        s = self.s
        font = self.fonts.get(s.font) or self.plain
        texts, widths, spaces, seen = font.decoded(shown)
        size, scale, gap = s.size, s.h_scale, s.char_space
        word = s.word_space if spaces else 0.0
        at, starts = 0.0, []
        if word:
            for k, w in enumerate(widths):
                starts.append(at)
                at += (w * size + gap + (word if k in spaces else 0.0)) * scale
        else:
            for w in widths:
                starts.append(at)
                at += (w * size + gap) * scale
        if seen is not None:  # some codes have no text: they move on, but are no glyphs
            texts, widths, starts = [texts[k] for k in seen], [widths[k] for k in seen], [starts[k] for k in seen]
        if texts:
            self.runs.append((texts, widths, starts, _then(self.tm, s.shown), s.font or "", size, scale, s.rise))
        self.tm = _moved(self.tm, at, 0.0)


_NUM, _TEXT, _FONT = rb"([+-]?\d+(?:\.\d+)?)", rb"\(([^()\\]*)\)", rb"/([A-Za-z0-9_+.-]+) "
#: What many makers write: strings with a place of their own (Tm, or cm in a saved state), fonts, ends of text. Else one character.
_SIMPLE = re.compile(rb"1 0 0 1 " + _NUM + b" " + _NUM + rb" Tm " + _TEXT + rb" Tj" + _END + rb"|q 1 0 0 1 " + _NUM + b" " + _NUM + rb" cm BT " + _FONT + _NUM + rb" Tf \[" + _TEXT + b" " + _NUM + b" " + _TEXT + rb"\] TJ ET Q" + _END + b"|" + _FONT + _NUM + rb" Tf" + _END + rb"|[BE]T" + _END + rb"|(\S)")


def simple_runs(data: bytes, fonts: dict[str, Font], page_map: Matrix) -> list[tuple] | None:
    """Runs of a content stream that holds only such strings, as ``TextMachine`` gives them; None for any other stream."""
    found = _SIMPLE.findall(data)
    shown, name, size = (page_map.a, page_map.b, page_map.c, page_map.d, page_map.e, page_map.f), "", 1.0
    if shown[:4] != (1.0, 0.0, 0.0, 1.0) or any(f[-1] for f in found):
        return None
    dx, dy = shown[4:]
    plain, runs = Font(), []
    font = plain
    for x, y, text, bx, by, bfont, bsize, one, shift, two, new, newsize, _ in found:
        if y:
            got = font.simple(text, size)
            if got is None:
                return None
            if text:
                runs.append((got[0], got[1], got[2], (1.0, 0.0, 0.0, 1.0, float(x) + dx, float(y) + dy), name, size, 1.0, 0.0))
        elif by:
            own, bname, bsize = fonts.get(bfont.decode()) or plain, bfont.decode(), float(bsize)
            a, b = own.simple(one, bsize), own.simple(two, bsize)
            if a is None or b is None:
                return None
            ex, ey = float(bx) + dx, float(by) + dy
            if one:
                runs.append((a[0], a[1], a[2], (1.0, 0.0, 0.0, 1.0, ex, ey), bname, bsize, 1.0, 0.0))
            if two:
                runs.append((b[0], b[1], b[2], (1.0, 0.0, 0.0, 1.0, a[3] - float(shift) / 1000 * bsize + ex, ey), bname, bsize, 1.0, 0.0))
        elif newsize:
            name, size = new.decode(), float(newsize)
            font = fonts.get(name) or plain
    return runs


_DIGITS, _PRINTED, _USE = r"-?[0-9]+(?:\.[0-9]+)?", r"[ -'*-\[\]-~]*", r"/[A-Za-z0-9_+.-]+ -?[0-9]+(?:\.[0-9]+)?"
#: Whole lines of the kinds that ``_SIMPLE`` knows, for Arrow; few groups in each, which keeps its matcher fast.
_PLACED = rf"^1 0 0 1 (?P<x>{_DIGITS}) (?P<y>{_DIGITS}) Tm \((?P<t>{_PRINTED})\) Tj\n$"
_SAVED = rf"^ET q 1 0 0 1 (?P<x>{_DIGITS}) (?P<y>{_DIGITS}) cm BT (?P<f>{_USE}) Tf \["
_SPLIT = rf"^ET q [0-9. -]+ cm BT {_USE} Tf \[\((?P<a>{_PRINTED})\) (?P<d>{_DIGITS}) \((?P<b>{_PRINTED})\)\] TJ ET Q BT (?P<g>{_USE}) Tf\n$"
_OTHER = re.compile(rf"(?:BT|ET|(?:BT )?({_USE}) Tf)?\n")


class LineRuns(NamedTuple):
    """Shown strings by columns: their page, text (Arrow), place, font with its size, and for the second part of a split
    string the run before it and what is between them."""

    page: np.ndarray
    text: object
    x: np.ndarray
    y: np.ndarray
    use: np.ndarray
    uses: list[str]
    after: np.ndarray
    shift: np.ndarray


def line_runs(contents: list[bytes]) -> tuple[np.ndarray, LineRuns | None]:
    """Whether each content stream consists of lines of those kinds, and the strings that such streams show, in order.

    ``use`` is a place in ``uses`` (font and size as written; -1: none yet); numbers are not added up yet."""
    import pyarrow as pa
    import pyarrow.compute as pc

    good = np.array([c.isascii() and len(c) < 100_000_000 for c in contents], bool)
    which = np.flatnonzero(good)
    raw = np.frombuffer(b"".join(contents[i] + b"\n" for i in which), np.uint8)
    if not len(raw):
        return good, None
    ends = np.flatnonzero(raw == 10) + 1
    lines = pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(raw))
    own = np.repeat(which, [contents[i].count(b"\n") + 1 for i in which])
    of = lambda found: found.is_valid().to_numpy(zero_copy_only=False)
    placed = pc.extract_regex(lines, _PLACED)
    one = of(placed)
    at = np.flatnonzero(~one)
    rest = lines.take(pa.array(at))
    saved, split = pc.extract_regex(rest, _SAVED), pc.extract_regex(rest, _SPLIT)
    two = of(saved) & of(split)
    other = rest.filter(pa.array(~two)).dictionary_encode()
    kinds = [_OTHER.fullmatch(t) for t in other.dictionary.to_pylist()]
    codes = other.indices.to_numpy()
    good[own[at[~two]][np.array([m is None for m in kinds], bool)[codes]]] = False
    # Fonts: where each is set, and the last one set before a line of its page.
    uses: dict[str, int] = {}
    number = lambda t: uses.setdefault(t, len(uses)) if t is not None else -1
    set_to = np.full(len(ends), -1)
    if len(codes):
        set_to[at[~two]] = np.array([number(m[1]) if m else -1 for m in kinds])[codes]
    both = np.flatnonzero(two)
    lines_two = at[both]

    def numbered(column) -> np.ndarray:
        got = column.take(pa.array(both)).dictionary_encode()
        return np.array([number(t) for t in got.dictionary.to_pylist()], np.int64)[got.indices.to_numpy()]

    saved, split = saved.flatten(), split.flatten()
    if len(both):
        inner = numbered(saved[2])
        set_to[lines_two] = numbered(split[3])
    else:
        inner = np.zeros(0, np.int64)
    last = np.maximum.accumulate(np.where(set_to >= 0, np.arange(len(ends)), -1))
    last = np.where((last >= 0) & (own[last] == own), last, -1)
    lines_one = np.flatnonzero(one & good[own])
    kept = good[own[lines_two]]
    both, lines_two, inner = both[kept], lines_two[kept], inner[kept]
    placed, ones, twos = placed.flatten(), pa.array(lines_one), pa.array(both)
    number_of = lambda column, rows: column.take(rows).cast(pa.float64()).to_numpy()
    x2, y2 = number_of(saved[0], twos), number_of(saved[1], twos)
    none = lambda n: np.full(n, -1)
    text = pa.concat_arrays([placed[2].take(ones), split[0].take(twos), split[2].take(twos)])
    order = np.argsort(np.concatenate([2 * lines_one, 2 * lines_two, 2 * lines_two + 1]), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    before = place[len(lines_one) : len(lines_one) + len(both)]
    join = lambda a, b, c: np.concatenate([a, b, c])[order]
    set_before = np.where(last[lines_one] >= 0, set_to[last[lines_one]], -1)
    return good, LineRuns(
        join(own[lines_one], own[lines_two], own[lines_two]),
        text.take(pa.array(order)),
        join(number_of(placed[0], ones), x2, x2),
        join(number_of(placed[1], ones), y2, y2),
        join(set_before, inner, inner),
        list(uses),
        join(none(len(lines_one)), none(len(both)), before),
        join(np.zeros(len(lines_one)), np.zeros(len(both)), number_of(split[1], twos)),
    )
