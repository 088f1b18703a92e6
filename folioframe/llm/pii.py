"""Operator 8, PII: replace detected entities by keyed surrogates of the same type and format.

Entities are e-mail and IP addresses (both versions), telephone, card, account and social security numbers,
IBANs, and names of persons: after a title, or a common given name before a capitalised word; later mentions
of the same words included. Telephone numbers are those with a country code, those of the shapes (ddd) ddd-dddd
and ddd-ddd-dddd, and those that begin with 0 and have 9 to 13 digits in groups. Names without either sign,
and in scripts but Latin and Cyrillic, are not found.

Numbers and addresses pass through a keyed permutation of the strings with the same format: digits stay
digits of their range, letters keep case, separators stay, check digits stay valid (or invalid) and the domain
of an address is replaced alike in all addresses. The permutation is one cycle (a Feistel permutation carries
the step from each number to the next), so it has no fixed point, and strings of a part of the format, such as
numbers with a wrong check digit, can be reached by stepping on. So these surrogates cannot collide.
Names are built from syllables of their script, with endings for the gender that the title or the given name
tells, and keep their case. E-mail addresses are the same entity in either case.

One entity has one surrogate everywhere (coreference). Spark checks all different names for collisions: of
names that got one surrogate, or that got themselves, all but the least try again with more syllables, twice
as many more each round, until none is left; the last rounds draw from more strings than there can be names.
Only these exceptions are kept; they are broadcast if they are at most ``MAX_BROADCAST``, else joined to the
texts that need them; both ways give the same texts.

Null texts stay null, empty texts and texts without entities stay as they are, rows that repeat get equal
texts. A very long text is searched as a whole by the one worker that holds it. Only id (of any type, null
too) and text are read, so other columns cannot clash. No table, an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, sliced, table

KEY = b"replace this key"
MAX_BROADCAST = 50_000
NAMES = ("given_f", "given_m", "given_u", "surname")
TYPES = ("email", "iban", "ip", "ipv6", "ssn", "card", "account", "phone", *NAMES)

_EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NUMBER = re.compile(
    rf"(?P<ip>(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])[3-6]\d{3}([ -]?)\d{4}\4\d{4}\4\d{1,7}(?![\d-]))"
    r"|(?P<phone>(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))"
    r"|(?P<local>(?<![\d.,+(/-])0\d{1,4}[ /]\d{2,4}(?:[ -]?\d{2,4}){1,4}(?![\d-]))",
    re.A,
)
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Z0-9])", re.A)
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:.])")
_FEMALE = "Mrs|Ms|Miss|Madam|Frau|Mme|Mlle|Madame|Sra|Srta|Señora|Doña|г-жа|госпожа"
_MALE = "Mr|Sir|Herr|Monsieur|Sr|Señor|Don|г-н|господин"
_CAPITAL = r"(?:[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]+|[А-ЯЁ][А-Яа-яёЁ-]+)"
_NAME = re.compile(rf"(?<!\w)(?:(?P<f>{_FEMALE})|(?P<m>{_MALE})|(?P<u>Dr|Prof))\.?[ \xa0]({_CAPITAL})(?:[ \xa0]({_CAPITAL}))?(?:[ \xa0]({_CAPITAL}))?")
_PAIR = re.compile(rf"(?<!\w)({_CAPITAL})(?=[ \xa0]({_CAPITAL}))")
#: Common given names that are no words of their languages.
_GIVEN = {
    "f": "Anna Maria Elena Laura Julia Sarah Emily Jessica Jennifer Elizabeth Susan Linda Barbara Margaret Michelle Emma Olivia Sophia Isabella Charlotte Marie Camille Léa Chloé Manon Sophie Isabelle Nathalie Katharina Sabine Ursula Claudia Petra Monika Carmen Lucía Carmela Ana Cristina Olga Natalia Tatiana Irina Анна Мария Елена Ольга Наталья Татьяна Ирина Екатерина",
    "m": "John James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Andrew Peter Paul George Edward Pierre Jean Jacques Philippe Nicolas François Michel Hans Klaus Jürgen Wolfgang Stefan Andreas Dieter José Carlos Luis Miguel Antonio Javier Francisco Ivan Dmitri Sergei Иван Дмитрий Сергей Александр Алексей Николай Андрей Михаил",
}
_GENDER = {name.casefold(): gender for gender, names in _GIVEN.items() for name in names.split()}
_TITLES = tuple(f"{t}" for t in (_FEMALE + "|" + _MALE + "|Dr|Prof").split("|"))


def luhn(digits: str) -> int:
    """Check digit that makes ``digits`` and it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _ibans(text: str) -> Iterator[tuple[int, int, str, str]]:
    """IBANs with right check digits; groups behind that are no part of them are left."""
    for m in _IBAN.finditer(text):
        end = m.end()
        while end > m.start():
            compact = text[m.start() : end].replace(" ", "")
            if 15 <= len(compact) <= 34 and int(compact[2:4]) == _iban_check(compact[:2], compact[4:]):
                yield m.start(), end, "iban", compact
                break
            end = text.rfind(" ", m.start(), end)


def find_names(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of names of persons, which may overlap."""
    found, words = [], {}
    if any(t in text for t in _TITLES):
        for m in _NAME.finditer(text):
            gender = "f" if m["f"] else "m" if m["m"] else "u"
            parts = [g for g in (4, 5, 6) if m[g]]
            for g in parts:
                kind = "surname" if g == parts[-1] else f"given_{gender}"
                found.append((m.start(g), m.end(g), kind, m[g].casefold()))
                words.setdefault(m[g], kind)
    for m in _PAIR.finditer(text):
        if gender := _GENDER.get(m[1].casefold()):
            found.append((m.start(1), m.end(1), f"given_{gender}", m[1].casefold()))
            words.setdefault(m[1], f"given_{gender}")
            if m[2].casefold() not in _GENDER:
                found.append((m.start(2), m.end(2), "surname", m[2].casefold()))
                words.setdefault(m[2], "surname")
    if words:
        every = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r")(?!\w)")
        found += [(m.start(), m.end(), words[m[0]], m[0].casefold()) for m in every.finditer(text)]
    return found


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of entities, ordered and without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            kind = m.lastgroup
            canon = m[0] if kind == "ip" else re.sub(r"\D", "", m[0])
            if kind == "card":
                kind = "card" if luhn(canon[:-1]) == int(canon[-1]) else "account"
            elif kind == "phone" and m[0][0] == "+":  # the country code stays; without a separator, its first digit
                code = re.match(r"\+(\d{1,3})[ .(-]", m[0])
                n = len(code[1]) if code else 1
                canon = f"+{canon[:n]}|{canon[n:]}"
            elif kind == "local":
                if not 9 <= len(canon) <= 13:
                    continue
                kind, canon = "phone", f"0|{canon[1:]}"
            found.append((m.start(), m.end(), kind, canon))
        found += _ibans(text)
    if "::" in text or text.count(":") >= 7:
        for m in _IPV6.finditer(text):
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            if len(m[0].replace(":", "")) >= 4:
                found.append((m.start(), m.end(), "ipv6", m[0].lower()))
    found += find_names(text)
    found.sort(key=lambda x: (x[0], -x[1], TYPES.index(x[2])))
    out: list[tuple[int, int, str, str]] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


_DIGIT = re.compile(r"[0-9]")


def _draw(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permute(value: list[int], radix: list[int], key: bytes, tweak: str) -> list[int]:
    """The next of ``value`` in a keyed cycle of all mixed-radix numbers: no number is its own next one.

    Eight Feistel rounds over the two halves, one step on, and the rounds back.
    """
    half = (len(value) + 1) // 2
    sizes, parts = [], []
    for at in (slice(0, half), slice(half, None)):
        size, n = 1, 0
        for v, r in zip(value[at], radix[at], strict=True):
            n, size = n * r + v, size * r
        sizes.append(size)
        parts.append(n)
    for k in range(8):
        i = k % 2
        parts[i] = (parts[i] + _draw(key, tweak, k, parts[1 - i])) % sizes[i]
    carry, parts[1] = divmod(parts[1] + 1, sizes[1])
    parts[0] = (parts[0] + carry) % sizes[0]
    for k in reversed(range(8)):
        i = k % 2
        parts[i] = (parts[i] - _draw(key, tweak, k, parts[1 - i])) % sizes[i]
    out: list[int] = []
    for n, at in zip(parts, (slice(0, half), slice(half, None)), strict=True):
        digits = []
        for r in reversed(radix[at]):
            digits.append(n % r)
            n //= r
        out += reversed(digits)
    return out


#: Classes of characters that stay classes: (first code point, number).
def _class(c: str) -> tuple[int, int]:
    return (ord("0"), 10) if "0" <= c <= "9" else (ord("a"), 26) if "a" <= c <= "z" else (ord("A"), 26) if "A" <= c <= "Z" else (ord(c), 0)


def _phone_class(c: str) -> tuple[int, int]:
    return (ord("0"), 2) if c in "01" else (ord("2"), 8)


def _like(text: str, key: bytes, tweak: str, of: Callable[[str], tuple[int, int]] = _class) -> str:
    """Permute digits and letters of ``text`` among strings of the same format."""
    base = [of(c) for c in text]
    value = [ord(c) - b for c, (b, r) in zip(text, base, strict=True) if r]
    if not value:
        return text
    got = iter(permute(value, [r for _, r in base if r], key, tweak + "|" + "".join(f"{b}/{r}," for b, r in base)))
    return "".join(chr(b + next(got)) if r else c for c, (b, r) in zip(text, base, strict=True))


_SYLLABLES = {
    "latin": ["ba", "be", "bri", "ca", "co", "da", "de", "di", "do", "el", "fa", "fe", "ga", "ha", "he", "jo", "ka", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "ra", "re", "ri", "ro", "sa", "se", "so", "ta", "te", "ti", "to", "va", "vi"],
    "cyrillic": ["ба", "ве", "га", "да", "ди", "жа", "за", "ка", "ки", "ла", "ли", "ма", "ми", "на", "ни", "па", "ра", "ро", "са", "се", "та", "ти", "фе", "ха"],
}
_ENDINGS = {
    "latin": {"given_f": ["na", "lia", "ra"], "given_m": ["n", "rd", "los"], "given_u": ["le", "x", "ry"], "surname": ["son", "mann", "well", "ez"]},
    "cyrillic": {"given_f": ["на", "лия", "ра"], "given_m": ["н", "слав", "тор"], "given_u": ["ша", "ня"], "surname": ["енко", "ский", "ян"]},
}


def surrogate(kind: str, canon: str, key: bytes = KEY, attempt: int = 0) -> str:
    """Surrogate of an entity in canonical form; other attempts give other names."""
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        head, _, top = domain.rpartition(".")
        return f"{_like(local, key, kind + domain)}@{_like(head, key, kind)}.{top}"
    if kind == "ip":
        parts = canon.split(".")
        base = [(0, 10) if len(p) == 1 else (10, 90) if len(p) == 2 else (100, 156) for p in parts]
        got = permute([int(p) - b for p, (b, _) in zip(parts, base, strict=True)], [r for _, r in base], key, kind + str(base))
        return ".".join(str(v + b) for v, (b, _) in zip(got, base, strict=True))
    if kind == "ipv6":
        at = [i for i, c in enumerate(canon) if c != ":"]
        out = list(canon)
        for i, v in zip(at, permute([int(canon[i], 16) for i in at], [16] * len(at), key, kind + re.sub(r"\w", "h", canon)), strict=True):
            out[i] = f"{v:x}"
        return "".join(out)
    if kind == "iban":
        rest = _like(canon[4:], key, kind + canon[:2])
        return f"{canon[:2]}{_iban_check(canon[:2], rest):02d}{rest}"
    if kind == "card":
        body = canon[0] + _like(canon[1:-1], key, kind)
        return body + str(luhn(body))
    if kind == "account":  # cards have a right check digit, these have none
        while True:
            canon = canon[0] + _like(canon[1:], key, kind)
            if luhn(canon[:-1]) != int(canon[-1]):
                return canon
    if kind == "phone":
        code, _, rest = canon.rpartition("|")
        return code + _like(rest, key, kind + code, _phone_class)
    if kind == "ssn":
        return _like(canon, key, kind)
    script = "cyrillic" if any("а" <= c <= "я" or c == "ё" for c in canon) else "latin"
    n, parts = _draw(key, f"{kind}#{attempt}", canon), []
    syllables, endings = _SYLLABLES[script], _ENDINGS[script][kind]
    for _ in range(2 + attempt // 2 + (kind == "surname")):
        n, at = divmod(n, len(syllables))
        parts.append(syllables[at])
    return "".join(parts) + endings[n % len(endings)]


def _dressed(original: str, kind: str, new: str) -> str:
    """The surrogate with the separators or the case of the original."""
    if kind == "ip":
        return new
    if kind in ("email", "ipv6"):
        return "".join(c.upper() if o.isupper() else c for o, c in zip(original, new, strict=True))
    if kind == "iban":
        got = iter(new)
        return "".join(c if c == " " else next(got) for c in original)
    if kind in ("ssn", "card", "account", "phone"):
        got = iter(new.lstrip("+"))
        return "".join(next(got) if "0" <= c <= "9" else c for c in original)
    return new.upper() if original.isupper() and len(original) > 1 else new.capitalize()


def replace_entities(text: str, key: bytes = KEY, exceptions: dict | None = None) -> tuple[str, list[str]]:
    """The text with surrogates, and the types of what was replaced."""
    out, last, kinds = [], 0, []
    for a, b, kind, canon in find_entities(text):
        new = (exceptions or {}).get((kind, canon)) or surrogate(kind, canon, key)
        out += [text[last:a], _dressed(text[a:b], kind, new)]
        last = b
        kinds.append(kind)
    return "".join(out) + text[last:], kinds


def _names_of(text: str | None) -> list[tuple[str, str]]:
    """Different names of a text: kind and canonical form."""
    if not text or not find_names(text):
        return []
    return sorted({e[2:] for e in find_entities(text) if e[2] in NAMES})


def name_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All different names: kind, canon."""
    import pyarrow as pa

    def emit(batches: Iterator) -> Iterator:
        for batch in sliced(batches):
            found = sorted({e for t in batch.column("_t").to_pylist() for e in _names_of(t)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], names=["kind", "canon"])

    return docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("_t")).mapInArrow(emit, "kind string, canon string").distinct()


def resolve(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, canon, new and attempt for all entities (kind, canon), with no surrogate used twice within a kind and none
    equal to its entity. Attempts double, and names of attempt 16 have 10 syllables or more, so a handful of rounds ends it."""
    make = F.udf(lambda kind, canon, attempt: surrogate(kind, canon, key, attempt), "string", useArrow=True)
    left = materialize(entities, "entities")
    done: list[DataFrame] = []
    attempt = 0
    while True:
        told = materialize(left.withColumn("new", make("kind", "canon", F.lit(attempt))), "surrogates")
        free = told
        for d in done:
            taken = d.select(F.col("kind").alias("k2"), F.col("new").alias("n2")).hint("merge")
            free = free.join(taken, (F.col("kind") == F.col("k2")) & (F.col("new") == F.col("n2")), "left_anti")
        won = free.where("new <> canon").groupBy("kind", "new").agg(F.min("canon").alias("canon")).select("kind", "canon", "new", F.lit(attempt).alias("attempt"))
        done.append(materialize(won, "resolved"))
        left = materialize(told.select("kind", "canon").join(done[-1].select("kind", "canon").hint("merge"), ["kind", "canon"], "left_anti"), "open")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        if attempt >= 64:
            raise ValueError("entities of one format leave no free surrogate")
        attempt = max(1, 2 * attempt)


def replace_pii(docs: DataFrame, key: bytes = KEY, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per row: ``id_col``, ``text_col`` with surrogates and kinds, the types of the replaced entities in order."""
    import pyarrow as pa

    spark = docs.sparkSession
    late = resolve(name_table(docs, text_col), key).where("attempt > 0").select("kind", "canon", "new")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{text_col}` string, kinds array<string>"
    small = late.limit(max_broadcast + 1).count() <= max_broadcast
    shared = spark.sparkContext.broadcast({(r["kind"], r["canon"]): r["new"] for r in late.collect()} if small else {})

    def emit(batches: Iterator) -> Iterator:
        for batch in sliced(batches):
            texts, kinds = [], []
            own = batch.column("_x").to_pylist() if "_x" in batch.schema.names else [None] * batch.num_rows
            for t, x in zip(batch.column("_t").to_pylist(), own, strict=True):
                known = {(e["kind"], e["canon"]): e["new"] for e in x} if x else shared.value
                new, found = (None, []) if t is None else replace_entities(t, key, known)
                texts.append(new)
                kinds.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("_d"), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=[id_col, text_col, "kinds"])

    rows = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t"))
    if not small:
        rows = _with_exceptions(rows, late)
    return rows.mapInArrow(emit, schema)


def _with_exceptions(rows: DataFrame, late: DataFrame) -> DataFrame:
    """Add to each text the exceptions among its names, by joins on the names."""
    import pyarrow as pa

    def emit(batches: Iterator) -> Iterator:
        for batch in sliced(batches):
            found = [(i, *e) for i, t in enumerate(batch.column("_t").to_pylist()) for e in _names_of(t)]
            at = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_d").take(at), batch.column("_h").take(at), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())], names=["_d", "_h", "kind", "canon"]
            )

    kind = rows.schema["_d"].dataType.simpleString()
    own = rows.where("_t is not null").withColumn("_h", F.xxhash64("_t")).select("_d", "_h", "_t").mapInArrow(emit, f"_d {kind}, _h long, kind string, canon string")
    lists = own.join(late, ["kind", "canon"]).groupBy("_d", "_h").agg(F.collect_set(F.struct("kind", "canon", "new")).alias("_x"))  # one text's
    lists = lists.withColumnsRenamed({"_d": "_d2", "_h": "_h2"})
    return rows.join(lists.hint("merge"), F.col("_d").eqNullSafe(F.col("_d2")) & (F.xxhash64("_t") == F.col("_h2")), "left").select("_d", "_t", "_x")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's text with surrogates, and numbers of what was replaced."""
    out = replace_pii(table(spark, sf_dir, "documents"))
    count = lambda name, *kinds: F.size(F.filter("kinds", lambda k: k.isin(*kinds))).cast("long").alias(name)
    return out.select(
        "doc_id", "text", F.size("kinds").cast("long").alias("n_entities"), count("n_email", "email"), count("n_ip", "ip", "ipv6"), count("n_phone", "phone"), count("n_number", "iban", "ssn", "card", "account"), count("n_name", *NAMES)
    )
