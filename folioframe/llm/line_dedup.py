"""Operator 9, line dedup: delete from later documents the blocks that align with earlier ones.

A document is paired with all earlier holders of each of its lines that has ``RARE`` holders at most. Of a
more common line, it is paired with the earliest of the holders that have it once or more often and as many
common lines; one that has no other common line aligns with every later document that has the line once. So no
group is paired within itself. Lines under ``MIN_LINE`` characters count as windows of them. Each pair
is aligned by patience diff; aligned blocks of ``MIN_BLOCK`` characters or more go from the later one. Exact
copies go whole, whatever their length. Earlier means a smaller id, then a smaller text hash; null ids come last.

Lines are cut at line breaks and compared whole, by 64-bit hashes. Rows equal in id and text are one document
and stay alike. Null texts have no lines, so they and texts without repeated lines stay as they are. Ids may
have any type that Spark orders, null too. A very long text is aligned as a list of hashes, with each partner
in turn; one pair is held at a time. No table, an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, keyed, materialize, packed, sliced, table
from .recompression import RangeNames

MIN_LINE, RARE, MIN_BLOCK = 20, 32, 20


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Longest increasing sequence of the lines that are unique in both."""
    once_a, once_b = Counter(a), Counter(b)
    place = {x: j for j, x in enumerate(b) if once_b[x] == 1}
    both = [(i, place[x]) for i, x in enumerate(a) if once_a[x] == 1 and x in place]
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(both):
        p = bisect_left(tops, j)
        back.append(ends[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[p], ends[p] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(both[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned equal lines (i in a, j in b) of the patience diff, in order."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            found.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            found.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        cut = [(i0 + i, j0 + j) for i, j in _anchors(a[i0:i1], b[j0:j1])]
        for (x, y), (u, v) in zip([(i0 - 1, j0 - 1), *cut], [*cut, (i1, j1)], strict=True) if cut else ():
            if u < i1:
                found.append((u, v))
            todo.append((x + 1, u, y + 1, v))
    return sorted(found)


def blocks(a: list, b: list, sizes: list[int], least: int) -> list[int]:
    """Lines of ``a`` in aligned blocks (consecutive in both) of ``least`` characters or more."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in block) >= least:
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


def windows(hashes: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, name, whether it is there once) of what names partners, for documents of lines [at[i], at[i + 1]).

    These are lines of ``MIN_LINE`` characters, and in runs of shorter lines the least windows of ``MIN_BLOCK``:
    a block that may go has one of them, whatever its lines.
    """
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    long = sizes >= MIN_LINE
    total = np.append(0, np.cumsum(sizes))
    start = np.flatnonzero(~long & (sizes > 0))
    end = np.searchsorted(total, total[start] + MIN_BLOCK)
    stops = np.union1d(np.flatnonzero(long), at[1:])
    whole = end <= stops[np.searchsorted(stops, start, "right")]
    start, end = start[whole], end[whole]
    doc = np.concatenate([doc[long], doc[start]])
    name = np.concatenate([hashes[long], RangeNames(hashes)(start, end)])
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    new = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (name[1:] != name[:-1]))[: len(doc)])
    return doc[new], name[new], np.diff(np.append(new, len(doc))) == 1


def repeated_lines(rows: DataFrame) -> DataFrame:
    """For rows of ``keyed``: _d, _h and gone (numbers of the lines to delete), where there are any."""
    import pyarrow as pa

    lines = F.split("_t", "\n")
    key = F.struct(F.col("_d").isNull().alias("z"), "_d", "_h")
    texts = rows.where("_t <> ''").select(key.alias("k"), "_h", F.hash("_t").alias("_g"), "_t")
    own = texts.select("k", "_h", "_g", F.transform(lines, lambda x: F.xxhash64(x)).alias("hash"), F.transform(lines, F.length).alias("size"))
    own = own.groupBy("_h", "_g").agg(F.min("k").alias("k"), F.first("hash").alias("hash"), F.first("size").alias("size"))
    own = materialize(own, "lines")
    # Copies go whole; as they hold what their first does, only that one is aligned with others.
    copies = texts.drop("_t").join(own.select("_h", "_g", F.col("k").alias("first"), F.size("size").alias("n")), ["_h", "_g"]).where(F.col("k") != F.col("first"))
    copies = copies.select(F.col("k._d").alias("_d"), F.col("k._h").alias("_h"), F.sequence(F.lit(0), F.col("n") - 1).alias("gone"))

    def name(batches: Iterator) -> Iterator:
        for batch in sliced(batches):
            hashes, sizes = batch.column("hash"), batch.column("size")
            at = hashes.offsets.to_numpy().astype(np.int64)
            found = windows(hashes.flatten().to_numpy().view(U64), sizes.flatten().to_numpy().astype(np.int64), at - at[0])
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(found[0])), pa.array(found[1].view(np.int64)), pa.array(found[2])], names=["k", "hash", "once"])

    each = own.select("k", "hash", "size").mapInArrow(name, f"k {own.schema['k'].dataType.simpleString()}, hash long, once boolean")
    held = each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    held = materialize(held, "holders")  # as a stored side, so that Spark can split a hot line's rows
    shared = materialize(each.join(held, "hash"), "shared-lines")
    few = shared.where(F.col("n") <= RARE).groupBy("hash").agg(F.sort_array(F.collect_list("k")).alias("all"))
    few = few.select(F.explode(F.transform("all", lambda k, i: F.struct(k.alias("k"), F.slice("all", F.lit(1), i).alias("before")))).alias("x")).select("x.k", F.explode("x.before").alias("first"))
    hot = shared.where(F.col("n") > RARE)
    crowd = hot.groupBy("k").agg(F.collect_list(F.struct("hash", "once")).alias("all")).select("k", F.size("all").alias("c"), F.explode("all").alias("x"))
    marks = crowd.groupBy("x.hash", "x.once", "c").agg(F.min("k").alias("first")).groupBy("hash").agg(F.array_distinct(F.collect_list("first")).alias("firsts"))
    marks = materialize(marks, "marks")  # stored for the same reason
    many = hot.select("k", "hash").join(marks, "hash").select("k", F.explode("firsts").alias("first")).where(F.col("first") < F.col("k"))
    pairs = few.union(many).distinct()
    side = lambda p: own.select(F.col("k").alias(p), F.col("hash").alias(f"{p}_hash"), F.col("size").alias(f"{p}_size"))
    # Structs are compared with their null ids as equal, so these are plain equi-joins.
    both = pairs.join(side("k"), "k").join(side("first").drop("first_size"), "first")
    kind = rows.schema["_d"].dataType.simpleString()

    def emit(batches: Iterator) -> Iterator:
        for batch in sliced(batches, 64):  # lists of lines become Python objects here
            a, b, size = (batch.column(c).to_pylist() for c in ("k_hash", "first_hash", "k_size"))
            gone = [blocks(x, y, s, MIN_BLOCK) for x, y, s in zip(a, b, size, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_h"), pa.array(gone, pa.list_(pa.int32()))], names=["_d", "_h", "gone"])

    found = both.select(F.col("k._d").alias("_d"), F.col("k._h").alias("_h"), "k_hash", "first_hash", "k_size").mapInArrow(emit, f"_d {kind}, _h long, gone array<int>")
    return found.where(F.size("gone") > 0).union(copies).select("_d", "_h", F.explode("gone").alias("line")).groupBy("_d", "_h").agg(F.collect_set("line").alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """All rows and columns of ``docs``, whatever their names; repeated blocks are gone from ``text_col``.

    drop_emptied: rows that had a text of which nothing is left are gone too.
    """
    cut = _cut(docs, id_col, text_col)
    if drop_emptied:
        had = F.coalesce(F.col("_row").getField(text_col), F.lit("")) != ""
        cut = cut.where(~had | (F.coalesce("_text", F.lit("")) != ""))
    return cut.select(*((F.col("_text") if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns))


def _cut(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row (all columns of a row), _d, _text (what is left), _n_lines and _n_gone."""
    gone = repeated_lines(keyed(docs, id_col, text_col)).withColumnsRenamed({"_d": "_d2", "_h": "_h2"})
    both = packed(docs, id_col, text_col).join(gone.hint("merge"), F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")), "left")
    whole = F.col("_row").getField(text_col)
    text = F.coalesce(whole, F.lit(""))
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    n_lines = F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")))

    def kept(lines):
        left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    short = F.transform(F.array(F.split(text, "\n")), kept)[0]
    left = F.when(F.col("gone").isNull(), whole).otherwise(short)
    return both.select("_row", "_d", left.alias("_text"), n_lines.cast("long").alias("_n_lines"), n_gone.cast("long").alias("_n_gone"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: numbers of lines and the digest of the kept text of every document."""
    out = _cut(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select(F.col("_d").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_gone").alias("n_gone"), F.sha2(F.coalesce("_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
