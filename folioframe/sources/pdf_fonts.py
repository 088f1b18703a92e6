"""Fonts: how codes of shown strings become text and widths."""

from __future__ import annotations

import re

from .pdf_objects import File, Lexer, Name, Op, Stream

# Glyph names and their text.
GLYPH_NAMES = {
    "exclam": "!", "quotedbl": "\"", "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quoteright": "'", "parenleft": "(",
    "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "-", "period": ".", "slash": "/", "zero": "0", "one": "1",
    "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";",
    "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]",
    "asciicircum": "^", "underscore": "_", "quoteleft": "`", "braceleft": "{", "braceright": "}", "asciitilde": "~", "endash": "–", "emdash": "—",
    "quotedblleft": "“", "quotedblright": "”", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›",
    "Euro": "€", "trademark": "™", "copyright": "©", "registered": "®", "paragraph": "¶", "section": "§", "yen": "¥", "sterling": "£", "cent": "¢",
    "florin": "ƒ", "degree": "°", "plusminus": "±", "multiply": "×", "divide": "÷", "dagger": "†", "daggerdbl": "‡", "Agrave": "À", "Aacute": "Á",
    "Acircumflex": "Â", "Atilde": "Ã", "Adieresis": "Ä", "Aring": "Å", "AE": "Æ", "Ccedilla": "Ç", "Egrave": "È", "Eacute": "É", "Ecircumflex": "Ê",
    "Edieresis": "Ë", "Igrave": "Ì", "Iacute": "Í", "Icircumflex": "Î", "Idieresis": "Ï", "Eth": "Ð", "Ntilde": "Ñ", "Ograve": "Ò", "Oacute": "Ó",
    "Ocircumflex": "Ô", "Otilde": "Õ", "Odieresis": "Ö", "Oslash": "Ø", "OE": "Œ", "Ugrave": "Ù", "Uacute": "Ú", "Ucircumflex": "Û", "Udieresis": "Ü",
    "Yacute": "Ý", "Ydieresis": "Ÿ", "Thorn": "Þ", "germandbls": "ß", "agrave": "à", "aacute": "á", "acircumflex": "â", "atilde": "ã",
    "adieresis": "ä", "aring": "å", "ae": "æ", "ccedilla": "ç", "egrave": "è", "eacute": "é", "ecircumflex": "ê", "edieresis": "ë", "igrave": "ì",
    "iacute": "í", "icircumflex": "î", "idieresis": "ï", "eth": "ð", "ntilde": "ñ", "ograve": "ò", "oacute": "ó", "ocircumflex": "ô", "otilde": "õ",
    "odieresis": "ö", "oslash": "ø", "oe": "œ", "ugrave": "ù", "uacute": "ú", "ucircumflex": "û", "udieresis": "ü", "yacute": "ý", "ydieresis": "ÿ",
    "thorn": "þ", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "exclamdown": "¡", "questiondown": "¿", "guillemotleft": "«",
    "guillemotright": "»", "space": " ", "bar": "|", "nbspace": " ",
}


def glyph_text(name: str) -> str | None:
    """Text of a glyph name: the table, else uniXXXX, else uXXXX to uXXXXXX; None for others and surrogates."""
    name = name.removeprefix("/")
    if name in GLYPH_NAMES:
        return GLYPH_NAMES[name]
    m = re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name)
    if not m:
        return None
    point = int(m[1] or m[2], 16)
    return chr(point) if point < 0xD800 or 0xDFFF < point <= 0x10FFFF else None


def _codec(name: str) -> dict[int, str]:
    out = {}
    for c in range(32, 256):
        try:
            out[c] = bytes([c]).decode(name)
        except UnicodeDecodeError:
            pass
    return out


def _standard() -> dict[int, str]:
    """Adobe's standard encoding: ASCII with two quotes of its own, and its upper half."""
    out = {c: chr(c) for c in range(32, 127)} | {39: "’", 96: "‘"}
    # Text from code 0xA1 on, and the single codes after that.
    out |= dict(enumerate("¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ", 0xA1))
    out |= {0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿"}
    out |= {0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜", 0xC5: "¯", 0xC6: "˘", 0xC7: "˙", 0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—"}
    return out | {0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß"}


def _pdfdoc() -> dict[int, str]:
    out = {c: chr(c) for c in (*range(32, 127), *range(161, 256))}
    # Codes 0x18 to 0x1F and 0x80 to 0xA0.
    return out | dict(enumerate("˘ˇˆ˙˝˛˚˜", 0x18)) | dict(enumerate("•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž", 0x80)) | {0xA0: "€"}


ENCODINGS = {
    "WinAnsiEncoding": _codec("cp1252") | {0xA0: " ", 0xAD: "-", 0x7F: "•", 0x81: "•", 0x8D: "•", 0x8F: "•", 0x90: "•", 0x9D: "•"},
    "MacRomanEncoding": _codec("mac_roman") | {0xCA: " "},
    "StandardEncoding": _standard(),
    "PDFDocEncoding": _pdfdoc(),
    # The expert set has digits and marks of other sizes; those that are plain text are kept.
    "MacExpertEncoding": {0x20: " ", 0x2C: ",", 0x2D: "-", 0x2E: ".", 0x2F: "⁄", 0x3A: ":", 0x3B: ";", 0x47: "¼", 0x48: "½", 0x49: "¾", 0x4A: "⅛", 0x4B: "⅜", 0x4C: "⅝", 0x4D: "⅞", 0x4E: "⅓", 0x4F: "⅔", 0x56: "ﬀ", 0x57: "ﬁ", 0x58: "ﬂ", 0x59: "ﬃ", 0x5A: "ﬄ"}
    | dict(enumerate("0123456789", 0x30)),
}


def differences(array) -> dict[int, str]:
    """Codes 0 to 255 that an array of numbers and names redefines; unknown names only use up their code."""
    out: dict[int, str] = {}
    code = 0
    for item in array if isinstance(array, list) else ():
        if isinstance(item, int) and not isinstance(item, bool):
            code = item
        elif isinstance(item, Name):
            text = glyph_text(item)
            if text is not None and 0 <= code <= 255:
                out[code] = text
            code += 1
    return out


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def cid_widths(array) -> dict[int, float]:
    """Widths (em) of ``c [w ...]`` and ``c1 c2 w``; bad ranges are left out, a cut-off end ends it."""
    out: dict[int, float] = {}
    items, i = array if isinstance(array, list) else [], 0
    while i < len(items):
        if not isinstance(items[i], int):
            i += 1
        elif i + 1 < len(items) and isinstance(items[i + 1], list):
            for j, w in enumerate(items[i + 1]):
                if _number(w):
                    out[items[i] + j] = w / 1000
            i += 2
        elif i + 2 < len(items):
            first, last, w = items[i : i + 3]
            if isinstance(last, int) and _number(w):
                if 0 <= first <= last <= 0xFFFF:
                    out.update(dict.fromkeys(range(first, last + 1), w / 1000))
                i += 3
            else:
                i += 1
        else:
            break
    return out


def to_unicode(data: bytes) -> dict[int, str]:
    """Code to text of a ToUnicode map: bfchar and bfrange."""

    def text(raw) -> str:
        return raw.decode("utf-16-be", "replace") if isinstance(raw, bytes) else ""

    out: dict[int, str] = {}
    lex, stack = Lexer(data), []
    try:
        while True:
            item = lex.next(False)
            if not isinstance(item, Op):
                stack.append(item)
                continue
            if item == "endbfchar":
                for a, b in zip(stack[::2], stack[1::2], strict=False):
                    if isinstance(a, bytes):
                        out[int.from_bytes(a, "big")] = text(b)
            elif item == "endbfrange":
                for a, b, c in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        low, high = int.from_bytes(a, "big"), min(int.from_bytes(b, "big"), int.from_bytes(a, "big") + 0xFFFF)
                        for k in range(low, high + 1):
                            if isinstance(c, list):
                                out[k] = text(c[k - low]) if k - low < len(c) else ""
                            elif isinstance(c, bytes) and c:
                                n = int.from_bytes(c[-2:], "big") + k - low
                                out[k] = text(c[:-2] + (n & 0xFFFF).to_bytes(2, "big"))
            stack = []
    except EOFError:
        return out


DEFAULT_WIDTH = 0.5
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")


class Font:
    """Decoder and widths of a font dictionary; without one, each byte is Latin-1 and half an em."""

    KEPT = 5_000

    def __init__(self, file: File | None = None, info: dict | None = None):
        self.known: dict[bytes, tuple] = {}
        self.ascii: bool | None = None
        self.composite, self.widths, self.default = False, {}, DEFAULT_WIDTH
        self.differences: dict[int, str] = {}
        self.table: dict[int, str] | None = None
        if info is None:
            return
        self.composite = info.get("Subtype") == "Type0"
        encoding = file.deref(info.get("Encoding"))
        mapped = file.deref(info.get("ToUnicode"))
        if isinstance(encoding, dict):
            self.differences = {} if self.composite else differences(file.deref(encoding.get("Differences")))
            encoding = file.deref(encoding.get("BaseEncoding")) or "StandardEncoding"
        if isinstance(mapped, Stream):
            self.table = to_unicode(file.decoded(mapped))
        elif isinstance(encoding, str) and encoding in ENCODINGS:
            self.table = ENCODINGS[encoding]
        elif not self.composite:
            self.table = ENCODINGS["StandardEncoding"]
        if self.composite:
            heirs = file.deref(info.get("DescendantFonts"))
            heir = file.deref(heirs[0]) if isinstance(heirs, list) and heirs else None
            self.widths = cid_widths(heir.get("W")) if isinstance(heir, dict) else {}
            return
        first, widths = info.get("FirstChar"), info.get("Widths")
        if isinstance(first, int) and 0 <= first <= 255 and isinstance(widths, list):
            self.widths = {first + i: w / 1000 for i, w in enumerate(widths) if _number(w)}
            missing = info.get("MissingWidth")
            self.default = missing / 1000 if _number(missing) else DEFAULT_WIDTH

    def codes(self, shown: bytes) -> list[tuple[int, str, float]]:
        """(code, text, width in em) of each code of a shown string."""
        step = 2 if self.composite else 1
        out = []
        for i in range(0, len(shown), step):
            code = int.from_bytes(shown[i : i + step], "big")
            if code in self.differences:
                text = self.differences[code]
            elif self.table is not None:
                text = self.table.get(code, "")
            else:
                text = chr(code) if code < 0xD800 or code > 0xDFFF else ""
            out.append((code, text, self.widths.get(code, self.default)))
        return out

    def decoded(self, shown: bytes) -> tuple[list[str], list[float], frozenset[int], list[int] | None]:
        """Texts without control characters, widths, places of word spaces, and places of the codes that have a
        text (None: all). Kept for up to ``KEPT`` strings."""
        got = self.known.get(shown)
        if got is None:
            codes = self.codes(shown)
            texts = [t if t.isprintable() else _CONTROL.sub("", t) for _, t, _ in codes]
            spaces = frozenset() if self.composite else frozenset(k for k, (c, _, _) in enumerate(codes) if c == 32)
            seen = None if all(texts) else [k for k, t in enumerate(texts) if t]
            got = texts, [w for _, _, w in codes], spaces, seen
            if len(self.known) >= self.KEPT:
                self.known.clear()
            self.known[shown] = got
        return got

    def plain(self) -> bool:
        """Whether printable ASCII stands for itself and all widths are the default."""
        if self.ascii is None:
            kept = self.differences.keys() | self.widths.keys()
            self.ascii = not self.composite and not kept and (self.table is None or _reads_ascii(self.table))
        return self.ascii

    def simple(self, shown: bytes, size: float) -> tuple[str, list[float], list[float], float] | None:
        """Text, widths, starts and whole advance of a string of printable ASCII in a font where that stands for itself
        and all widths are the default; None for others."""
        if not self.plain() or not shown.isascii():
            return None
        text = shown.decode("ascii")
        if not text.isprintable():
            return None
        steps = _steps.get((len(text), self.default, size))
        if steps is None:
            at, starts = 0.0, []
            for _ in text:
                starts.append(at)
                at += self.default * size
            if len(_steps) >= self.KEPT:
                _steps.clear()
            steps = _steps[(len(text), self.default, size)] = [self.default] * len(text), starts, at
        return text, *steps


_steps: dict[tuple, tuple] = {}
_ascii_tables: dict[int, bool] = {}


def _reads_ascii(table: dict[int, str]) -> bool:
    """Whether printable ASCII stands for itself; found once for each of the fixed encodings."""
    known = _ascii_tables.get(id(table))
    if known is None:
        known = all(table.get(c) == chr(c) for c in range(32, 127))
        if any(table is t for t in ENCODINGS.values()):
            _ascii_tables[id(table)] = known
    return known
