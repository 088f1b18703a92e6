"""Options of word and layout extraction."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class WordOptions:
    """How glyphs become words. ``x_tolerance_ratio`` replaces ``x_tolerance`` for gaps by a share of the glyph size."""

    x_tolerance: float = 3.0
    y_tolerance: float = 3.0
    x_tolerance_ratio: float | None = None
    keep_blank_chars: bool = False
    use_text_flow: bool = False
    expand_ligatures: bool = False


@dataclass(frozen=True)
class TextOptions(WordOptions):
    """Word options, and the points that one column and one row of the layout grid stand for."""

    x_density: float = 7.25
    y_density: float = 13.0

    @classmethod
    def pdfplumber_defaults(cls) -> TextOptions:
        return cls()

    @classmethod
    def builder(cls) -> TextOptionsBuilder:
        return TextOptionsBuilder()

    def word_options(self) -> WordOptions:
        names = WordOptions.__dataclass_fields__
        return WordOptions(**{n: getattr(self, n) for n in names})


class TextOptionsBuilder:
    """Fluent builder: one setter for each field, then ``build``."""

    def __init__(self) -> None:
        self._made = TextOptions()

    def build(self) -> TextOptions:
        return self._made


def _setter(name: str):
    def put(self: TextOptionsBuilder, value) -> TextOptionsBuilder:
        self._made = replace(self._made, **{name: value})
        return self

    put.__name__ = name
    return put


for _name in TextOptions.__dataclass_fields__:
    setattr(TextOptionsBuilder, _name, _setter(_name))


def sane_density(value: float, fallback: float) -> float:
    """``value`` if it is a positive finite number, else ``fallback``."""
    return value if math.isfinite(value) and value > 0 else fallback
