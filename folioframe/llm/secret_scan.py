"""Operator 10, secret scans: fixed patterns, and a linear-chain conditional random field beside them.

The field tags each word begin (B), inside (I) or outside (O) of a secret. Its features are the word's
shape, length, alphabet and key words, the classes of neighbouring words, and how much the file looks
like code. It is trained here, on the driver, from about ``TRAIN_DOCS`` documents (those of the lowest
hashes among those of up to ``TRAIN_CHARS`` characters, tagged by the patterns) and from generated lines with
secrets of many formats; these bounds make the only sample, and training costs the same whatever the corpus. Decoding is exact Viterbi: a word whose outside score exceeds the others by more than any two
transitions can give back is outside on every best path, so paths are searched between such words only.

Whole texts are scanned, however long; offsets are code points. A span of the field that lies inside a span
of a pattern is left out, any other is added, also where it goes beyond one. Null is an empty text; rows without
a match have empty lists. Repeated rows get equal results. Only id (of any type, null too) and text are read, so
other columns cannot clash. No table, an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, binary_parts, chunks, lowest_share, sliced, table

KINDS = ("assign", "access", "hex", "crf")
TRAIN_DOCS, TRAIN_CHARS = 60, 20_000
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as matching runs and dropping short ones
_WORD = re.compile(WORD_PATTERN)
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_KEY_BYTES = tuple(k.encode() for k in _KEYS)
_MORE_KEYS = re.compile(r"pass|pwd|secret|token|key|auth|bearer|cred|private", re.I)
_CAMEL = re.compile(r"[^A-Z][A-Z]")
_EDGE = "\"'`,;:.()[]{}<>=!?"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, ordered by start, then kind as listed."""
    found = []
    low = text.lower()  # only tells whether a key word can occur
    if any(k in low for k in _KEYS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], x[2]))
    return [(a, b, KINDS[k]) for a, b, k in found]


# ---- features -------------------------------------------------------------------------------


def _shape(word: str) -> str:
    out = []
    for c in word[:64]:
        s = "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if c.isdigit() else "u" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out[:7])


def word_class(word: str) -> int:
    """Class of a neighbouring word, 0 to 7."""
    if _MORE_KEYS.search(word):
        return 1 if word[-1] in ":=" else 2
    core = word.strip(_EDGE)
    if not core:
        return 3 if "=" in word or ":" in word else 4
    if core.isalpha():
        return 5 if word[-1] in ":=" else 0
    return 6 if any(c.isdigit() for c in core) and len(core) >= 12 else 7


def word_features(word: str) -> list[str]:
    core = word.strip(_EDGE)
    n = len(core)
    size = f"n{min(n, 6) if n < 8 else 8 if n < 12 else 12 if n < 16 else 16 if n < 24 else 24 if n < 40 else 40}"
    if core.isalpha() and not _CAMEL.search(core):
        found = ["word", "w" + size]
        if _MORE_KEYS.search(core):
            found.append("key")
        return found
    digits = sum(c.isdigit() for c in core)
    upper = sum("A" <= c <= "Z" for c in core)
    lower = sum("a" <= c <= "z" for c in core)
    other = n - digits - upper - lower
    found = ["s:" + _shape(core), size, f"d{min(4, digits)}", f"kinds{(digits > 0) + (upper > 0) + (lower > 0)}" + size, f"other{min(3, other)}"]
    found.append(f"alphabet{len(set(core)) * 4 // max(1, min(n, 32))}" + size)
    if n >= 16 and re.fullmatch(r"[0-9a-f]+", core):
        found.append("hex")
    if n >= 16 and re.fullmatch(r"[A-Za-z0-9+/_=-]+", core) and digits and upper and lower:
        found.append("base64")
    if "@" in core or "://" in core:
        found.append("address")
    if re.fullmatch(r"[\d().+-]+", core):
        found.append("number")
    if _MORE_KEYS.search(core):
        found.append("key")
        if re.search(r"[:=]\W*[^\W_]{6,}", word):
            found.append("key=value")
    if word != core and word[:1] in "\"'":
        found.append("quoted")
    return found


def file_class(text: str, n_words: int) -> int:
    """How much the text looks like code or configuration, 0 to 2."""
    return _file_class(sum(text.count(c) for c in "={};_"), n_words)


def _file_class(marks: int, n_words: int) -> int:
    return 0 if marks * 200 < n_words else 1 if marks * 20 < n_words else 2


# ---- training -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    own: dict[str, tuple[float, float, float]]
    near: np.ndarray  # offset -2, -1, +1 by class by tag
    file: np.ndarray
    bias: np.ndarray
    trans: np.ndarray


def _generated(seed: int, n: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines of prose, numbers and configuration with secrets of many formats, and their spans."""
    rng = random.Random(seed)
    wide = "abcdefghilmnoprstuéèñóüäßç"
    low, alnum = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def some(chars: str, k: int) -> str:
        return "".join(rng.choice(chars) for _ in range(k))

    def secret() -> str:
        return rng.choice(
            [
                lambda: some("0123456789abcdef", rng.choice((24, 32, 40, 64))),
                lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
                lambda: "ghp_" + some(alnum, 36),
                lambda: "sk_live_" + some(alnum, 24),
                lambda: "xoxb-" + some("0123456789", 11) + "-" + some(alnum, 24),
                lambda: some(alnum + "+/", 40),
                lambda: "eyJ" + some(alnum, 30) + "." + some(alnum, 40) + "." + some(alnum + "_-", 43),
                lambda: some(alnum + "!#$%", rng.randint(12, 20)) + some("0123456789", 2),
            ]
        )()

    def plain() -> str:
        return rng.choice(
            [
                lambda: some(low, rng.randint(1, 12)),
                lambda: some(low, rng.randint(2, 9)),
                lambda: some(low, rng.randint(2, 9)).capitalize() + rng.choice([".", ",", ""]),
                lambda: some(low, rng.randint(1, 12)).upper() + "!!" * rng.randint(0, 1),
                lambda: str(rng.randint(0, 10**9)),
                lambda: f"{some(low, 6)}.{rng.randint(0, 99)}@{some(low, 5)}.example.com",
                lambda: f"https://{some(low, 7)}.org/{some(low, 5)}/{rng.randint(1, 9999)}",
                lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
                lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
                lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
                lambda: some("0123456789", 16),
                lambda: some(wide, rng.randint(2, 18)) + rng.choice(["", ".", ","]),
                lambda: some(wide, rng.randint(2, 18)) + rng.choice(["", ".", ","]) + rng.choice("#*$%&|") * 3 + rng.choice(["", wide[:3]]),
                lambda: some(low, 5) + "_" + some(low, 6) + rng.choice(["(", "()", "=1", ";"]),
            ]
        )()

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(3, 14)):
            text += plain() + " "
        if rng.random() < 0.6:
            key = rng.choice(["password", "secret", "token", "api_key", "auth", "AWS_KEY", "client_secret", "bearer", "pwd"])
            text += rng.choice([key + "=", key + " = ", key + ": ", key + '="', key + " = '", "", "", ""])
            own = secret()
            spans.append((len(text), len(text) + len(own)))
            text += own + rng.choice(["", '"', "'", ",", "."]) + " "
        else:
            text += rng.choice(["token ", "the password is ", "secret "]) if rng.random() < 0.2 else ""
        for _ in range(rng.randint(0, 8)):
            text += plain() + " "
        out.append((text, spans))
    return out


_TAGS = {"O": 0, "B": 1, "I": 2}


def _tagged(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    words, tags, last = [], [], None
    for m in _WORD.finditer(text):
        hit = next((s for s in spans if s[0] < m.end() and m.start() < s[1]), None)
        words.append(m[0])
        tags.append(0 if hit is None else 2 if hit == last else 1)
        last = hit
    return words, tags


def train(samples: list[tuple[list[str], list[int], int]], rounds: int = 70) -> Field:
    """Maximum likelihood with a small L2 penalty, by Adam over padded sequences."""
    names: dict[str, int] = {}
    cut = []
    for words, tags, kind in samples:
        for at in range(0, len(words), 40):
            cut.append((words[at : at + 40], tags[at : at + 40], kind))
    wide, n = 40, len(cut)
    y, mask = np.zeros((n, wide), np.int64), np.zeros((n, wide), bool)
    place, feature = [], []
    shift = 8 * 3 + 3 + 1
    for i, (words, tags, kind) in enumerate(cut):
        y[i, : len(tags)], mask[i, : len(tags)] = tags, True
        classes = [word_class(w) for w in words]
        for j, w in enumerate(words):
            own = [names.setdefault(f, shift + len(names)) for f in word_features(w)]
            own += [k * 8 + classes[j + o] for k, o in enumerate((-2, -1, 1)) if 0 <= j + o < len(words)]
            own += [24 + kind, 27]
            place += [i * wide + j] * len(own)
            feature += own
    place, feature, size = np.array(place), np.array(feature), shift + len(names)
    w, t = np.zeros((size, 3)), np.zeros((3, 3))
    m, v = np.zeros(size * 3 + 9), np.zeros(size * 3 + 9)
    gold = np.zeros((n * wide, 3))
    gold[np.arange(n * wide), y.ravel()] = mask.ravel()
    pair = mask[:, 1:] & mask[:, :-1]
    gold_t = np.bincount((y[:, :-1] * 3 + y[:, 1:])[pair], minlength=9).reshape(3, 3)
    lengths = mask.sum(1)
    for step in range(1, rounds + 1):
        e = np.stack([np.bincount(place, w[feature, k], n * wide) for k in range(3)], 1).reshape(n, wide, 3)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]

        def lse(x, axis):
            top = x.max(axis, keepdims=True)
            return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)

        for j in range(1, wide):
            a[:, j] = np.where(mask[:, j, None], lse(a[:, j - 1, :, None] + t, 1) + e[:, j], a[:, j - 1])
        for j in range(wide - 2, -1, -1):
            b[:, j] = np.where(mask[:, j + 1, None], lse(t + (e[:, j + 1] + b[:, j + 1])[:, None, :], 2), 0.0)
        z = lse(a[np.arange(n), np.maximum(lengths - 1, 0)], 1)
        p = np.exp(np.minimum(a + b - z[:, None, None], 0)) * mask[:, :, None]
        both = np.exp(np.minimum(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None], 0)) * pair[:, :, None, None]
        diff = (gold - p.reshape(-1, 3))[place]
        g = np.stack([np.bincount(feature, diff[:, k], size) for k in range(3)], 1) - 0.05 * w
        grad = np.concatenate([g.ravel(), (gold_t - both.sum((0, 1))).ravel() - 0.05 * t.ravel()])
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        move = 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w += move[:-9].reshape(w.shape)
        t += move[-9:].reshape(3, 3)
    own = {k: tuple(float(x) for x in w[i]) for k, i in names.items()}
    return Field(own, w[:24].reshape(3, 8, 3), w[24:27], w[27], t)


def viterbi(e: np.ndarray, t: np.ndarray, before: int | None = None, after: int | None = None) -> list[int]:
    """Best tags of a chain of emissions between two known tags."""
    score, back = (e[0] + t[before] if before is not None else e[0]), []
    for x in e[1:]:
        step = score[:, None] + t
        back.append(step.argmax(0))
        score = step.max(0) + x
    at = int((score + t[:, after]).argmax() if after is not None else score.argmax())
    tags = [at]
    for p in reversed(back):
        at = int(p[at])
        tags.append(at)
    return tags[::-1]


#: Bits of bytes: digit 1, lower 2, upper 4, beyond ASCII 8, mark that stands at word ends 16, other mark 32.
_BITS = np.full(256, 32, np.uint8)
_BITS[48:58], _BITS[97:123], _BITS[65:91], _BITS[128:] = 1, 2, 4, 8
_BITS[[ord(c) for c in _EDGE]] = 16
_BITS[[ord("="), ord(":")]] = 32
_BITS[[32, 9, 10, 11, 12, 13]] = 0
_KEY_PARTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"bearer", b"cred", b"private")


class Tagger:
    """Applies a field to texts.

    A *plain* word is letters only, of one case but for the first, with marks at its ends only and
    without a key word. Plain words have few feature sets; where all of them, among plain neighbours,
    are outside on every best path, only the other words and their neighbours are scored, else all are.
    """

    LIMIT = 200_000

    def __init__(self, field: Field):
        self.f, t = field, field.trans
        gain = [0.0]
        for k in (1, 2):
            gain += [t[a, k] - t[a, 0] for a in range(3)] + [t[k, b] - t[0, b] for b in range(3)]
            gain += [t[a, k] + t[k, b] - t[a, 0] - t[0, b] for a in range(3) for b in range(3)]
        self.slack = max(gain)
        self.known: dict[str, tuple[np.ndarray, int]] = {}
        near = lambda k: sum(max(0.0, n[0, k] - n[0, 0]) for n in field.near)
        self.skips_plain = all(
            self._own(w)[0][0] + f[0] - self._own(w)[0][k] - f[k] - near(k) > self.slack for w in ["b" * n for n in (*range(1, 9), 12, 16, 24, 40)] for f in field.file for k in (1, 2)
        )

    def _own(self, word: str) -> tuple[np.ndarray, int]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > self.LIMIT:
                self.known.clear()
            parts = [self.f.own[x] for x in word_features(word) if x in self.f.own]
            got = self.known[word] = (self.f.bias + (np.sum(parts, 0) if parts else 0.0), word_class(word))
        return got

    def emission(self, words, i: int, n: int, kind: int) -> np.ndarray:
        e = self._own(words(i))[0] + self.f.file[kind]
        for k, o in enumerate((-2, -1, 1)):
            if 0 <= i + o < n:
                e = e + self.f.near[k][self._own(words(i + o))[1]]
        return e

    def tags(self, words, n: int, kind: int, only: list[int] | None = None) -> dict[int, int]:
        """Word number to tag, for the words that are not outside; words(i) is the i-th of n words."""
        open_, scores = [], {}
        for i in range(n) if only is None else only:
            e = self.emission(words, i, n, kind)
            if e[0] - max(e[1], e[2]) <= self.slack:
                open_.append(i)
                scores[i] = e
        found = {}
        for run in np.split(np.array(open_, int), np.flatnonzero(np.diff(open_) > 1) + 1) if open_ else ():
            a, b = int(run[0]), int(run[-1])
            best = viterbi(np.array([scores[i] for i in range(a, b + 1)]), self.f.trans, 0 if a else None, 0 if b + 1 < n else None)
            found |= {a + i: k for i, k in enumerate(best) if k}
        return found

    def spans(self, raw: bytes, begin: np.ndarray, end: np.ndarray, plain: np.ndarray) -> list[tuple[int, int]]:
        """Byte spans of tagged words, without marks at their ends."""
        words = lambda i: raw[begin[i] : end[i]].decode()
        only = None
        if self.skips_plain:
            low = raw.lower()
            odd = ~plain
            for part in _KEY_PARTS:
                at = low.find(part)
                while at >= 0:
                    odd[np.searchsorted(begin, at, "right") - 1] = True
                    at = low.find(part, at + 1)
            if not odd.any():
                return []
            near = odd.copy()
            near[1:] |= odd[:-1]
            near[2:] |= odd[:-2]
            near[:-1] |= odd[1:]
            only = np.flatnonzero(near).tolist()
        marks = sum(raw.count(c) for c in (b"=", b"{", b"}", b";", b"_"))
        tags = self.tags(words, len(begin), _file_class(marks, len(begin)), only)
        found: list[list[int]] = []
        for i in sorted(tags):
            word = words(i)
            head, tail = len(word) - len(word.lstrip(_EDGE)), len(word) - len(word.rstrip(_EDGE))
            if head == len(word):
                continue
            a, b = int(begin[i]) + head, int(end[i]) - tail
            if tags[i] == 2 and found and found[-1][2] == i - 1:
                found[-1][1:] = [b, i]
            else:
                found.append([a, b, i])
        return [(a, b) for a, b, _ in found]


def scan(data: np.ndarray, offsets: np.ndarray, tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """All spans of each text of a batch, in code points; each text ends with a line break that is not its own."""
    out: list[list[tuple[int, int, str]]] = []
    for first, last in chunks(offsets, 1 << 18):
        part = data[offsets[first] : offsets[last]]
        bits = _BITS[part]
        solid = np.zeros(len(part) + 2, np.int8)
        solid[1:-1] = bits != 0
        edge = np.diff(solid)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        marks = bits.copy()
        inner = (bits[1:-1] == 16) & (bits[:-2] & 47 != 0) & (bits[2:] & 47 != 0)
        marks[1:-1][inner] = 32
        marks[1:][(bits[1:] == 4) & (bits[:-1] & 10 != 0)] = 32
        every = np.bitwise_or.reduceat(marks, begin) if len(begin) else np.zeros(0, np.uint8)
        plain = (every & 33 == 0) & (every & 14 != 0)
        at = np.searchsorted(begin, offsets[first : last + 1] - offsets[first])
        for i in range(last - first):
            lo = int(offsets[first + i] - offsets[first])
            hi = int(offsets[first + i + 1] - offsets[first]) - 1
            b, e = begin[at[i] : at[i + 1]], end[at[i] : at[i + 1]]
            raw = part[lo:hi].tobytes()
            low = raw.lower()
            text = None
            fixed: list[tuple[int, int, str]] = []
            if b"AKIA" in raw or any(k in low for k in _KEY_BYTES) or (len(b) and int((e - b).max()) >= 24):
                text = raw.decode()
                fixed = base_spans(text)
            found = tagger.spans(raw, b - lo, e - lo, plain[at[i] : at[i + 1]])
            if found:
                # Code points before each byte, once for the text; and for spans by start, the farthest end so far.
                before = np.append(0, np.cumsum((part[lo:hi] & 0xC0) != 0x80))
                starts = [x for x, _, _ in fixed]
                reach = list(accumulate((y for _, y, _ in fixed), max))
                points = [(int(before[x]), int(before[y]), "crf") for x, y in found]
                added = [p for p in points if not (k := bisect_right(starts, p[0])) or reach[k - 1] < p[1]]
                fixed = sorted(fixed + added, key=lambda x: (x[0], KINDS.index(x[2])))
            out.append(fixed)
    return out


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Field from generated lines and about ``train_docs`` texts of up to ``train_chars`` characters: those whose
    hash is in the lowest share."""
    rows = docs.where(F.length(text_col) <= train_chars).select(F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("h"))
    share = min(1.0, train_docs / max(1, rows.count()))
    few = rows.where(lowest_share(F.col("h"), share)).orderBy("h", "t").limit(4 * train_docs)
    texts = sorted(r["t"] for r in few.collect())
    samples = []
    for t in texts:
        samples.append((*_tagged(t, [(a, b) for a, b, _ in base_spans(t)]), file_class(t, len(_WORD.findall(t)))))
    samples += [(*_tagged(t, s), i % 3) for i, (t, s) in enumerate(_generated(7, 1500))]
    return train(samples)


def find_secrets(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col`` and secrets, all spans (start, end, kind) ordered by start, then kind as listed."""
    import pyarrow as pa

    plain = (field.own, field.near, field.file, field.bias, field.trans)
    shared = docs.sparkSession.sparkContext.broadcast(plain)  # of a size the training bound fixes
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    of = docs.schema[id_col].dataType.simpleString()

    def emit(batches: Iterator) -> Iterator:
        tagger = Tagger(Field(*shared.value))
        for batch in sliced(batches):
            out = [[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in scan(*binary_parts(batch.column("_t")), tagger)]
            yield pa.RecordBatch.from_arrays([batch.column("_d"), pa.array(out, kind)], names=[id_col, "secrets"])

    rows = docs.select(F.col(id_col).alias("_d"), F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")).cast("binary").alias("_t"))
    return rows.mapInArrow(emit, f"`{id_col}` {of}, secrets array<struct<start:long,end:long,kind:string>>")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and digests of the secrets of every document."""
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, fit(docs))
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), count("crf"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans")
    )


def brute_force_sha(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
