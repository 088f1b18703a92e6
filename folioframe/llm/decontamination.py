"""Operator 4, benchmark decontamination: SimHash of item-sized windows, then exact similarity.

A window of as many words as an item can only resemble it if they share a shingle, so windows are laid
where a text holds a shingle of the benchmark, aligned as in the item. Each window gets a 64-bit SimHash
of its shingles. The index cuts fingerprints into ``BLOCKS`` blocks: two fingerprints within ``RADIUS``
bits agree in some block but for ``RADIUS // BLOCKS`` bits (pigeonhole), so the union of the blocks'
buckets holds every item within the radius; about a twenty-fifth of unlike items come with them. Those
items are verified by the weighted Jaccard similarity of whole shingle multisets; a shingle of the item
weighs 1 / (1 + ln(number of items of the whole benchmark that hold it)), any other weighs 1.

Words are lower-case runs of letters and digits. Items under ``MIN_WORDS`` words have too few shingles to
resemble anything, so a text holds them if it holds exactly their words in a row; items without words
(null, empty) are not searched. The benchmark is taken in slices of ``SLICE`` items, one pass over the
texts each; only one slice is collected and broadcast at a time, and the results do not depend on the
slices. Null and empty texts hold nothing; repeated rows get equal results, repeated items are reported
each. A very long text is scanned as a whole, its windows in lots of 4096. Ids may have any type; rows
travel as one column, so names of other columns cannot clash. Empty tables give no leaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, binary_parts, chunks, keyed, materialize, packed, sliced, table
from .recompression import RangeNames, word_names, words

N, THRESHOLD, RADIUS, BLOCKS, MIN_WORDS, SLICE = 5, 0.8, 15, 4, 8, 4096
_GATE = 20
_WIDTH = 64 // BLOCKS
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[i for i in range(128) if not chr(i).isalnum()]] = 32


def _word_names(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and start bytes of the words of texts."""
    part = _SPACE[part]
    begin, end = words(part)
    return word_names(part, begin, end), begin


def _runs(names: np.ndarray, n: int) -> np.ndarray:
    """Names of all runs of ``n`` words."""
    if len(names) < n:
        return names[:0]
    return RangeNames(names)(np.arange(len(names) - n + 1), np.arange(n, len(names) + 1))


def simhash(names: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingles (windows by shingles)."""
    out = np.zeros(len(names), U64)
    for bit in range(64):
        ones = ((names >> U64(bit)) & U64(1)).sum(1, dtype=np.int64)
        out |= (2 * ones > names.shape[1]).astype(U64) << U64(bit)
    return out


def similarity(window: np.ndarray, item: np.ndarray, weight: np.ndarray) -> float:
    """Weighted Jaccard similarity of the multisets of shingles of a window and an item, whose shingles weigh ``weight``."""
    y, at, m = np.unique(item, return_index=True, return_counts=True)
    x, n = np.unique(window, return_counts=True)
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[place] == x
    held = np.zeros(len(y))
    held[place[same]] = n[same]
    w = weight[at]
    return float((np.minimum(held, m) * w).sum() / ((np.maximum(held, m) * w).sum() + n[~same].sum()))


def near_values(bits: int) -> np.ndarray:
    """All block values with up to ``bits`` bits set."""
    value = np.arange(1 << _WIDTH)
    return value[np.bitwise_count(value) <= bits]


class Index:
    """A slice of the benchmark: rows of (item, word names, holders of its shingles), searched by fingerprint or by short runs."""

    def __init__(self, items: list[tuple]):
        self.ids, self.shingles, self.weights = [], [], []
        self.short: dict[int, dict[int, list]] = {}  # number of words: name of the run: items
        for i, names, holders in items:
            if len(names) < MIN_WORDS:
                self.short.setdefault(len(names), {}).setdefault(int(_runs(names, len(names))[0]), []).append(i)
            else:
                self.ids.append(i)
                self.shingles.append(_runs(names, N))
                self.weights.append(1 / (1 + np.log(holders)))
        self.sizes = np.array([len(s) for s in self.shingles], np.int64)
        self.seeds: dict[int, set] = {}
        for s in self.shingles:
            for o, x in enumerate(s.tolist()):
                self.seeds.setdefault(x, set()).add((o, len(s)))
        self.gate = np.zeros(1 << _GATE, bool)
        self.gate[(np.array(list(self.seeds), U64) >> U64(64 - _GATE)).astype(np.int64)] = True
        self.prints = np.array([simhash(s[None, :])[0] for s in self.shingles], U64)
        # Of the differing bits that a block may have, one is allowed for by the index, the others by the query.
        slack = RADIUS // BLOCKS
        self.asked = near_values(slack - 1) if slack else near_values(0)
        near = near_values(min(1, slack))
        self.buckets = []
        for b in range(BLOCKS):
            value = (self._block(self.prints, b)[:, None] ^ near[None, :]).ravel()
            order = np.argsort(value, kind="stable")
            start = np.searchsorted(value[order], np.arange((1 << _WIDTH) + 1))
            self.buckets.append((start, (order // len(near)).astype(np.int32)))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> U64(b * _WIDTH)) & U64((1 << _WIDTH) - 1)).astype(np.int64)

    def fetched(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all buckets that a window looks into."""
        found = []
        for b, (start, item) in enumerate(self.buckets):
            value = (self._block(prints, b)[:, None] ^ self.asked[None, :]).ravel()
            some = np.flatnonzero(start[value + 1] > start[value])
            low, count = start[value[some]], start[value[some] + 1] - start[value[some]]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            found.append(np.repeat(some // len(self.asked), count) * max(1, len(self.prints)) + item[at])
        pair = np.unique(np.concatenate(found))
        return np.divmod(pair, max(1, len(self.prints)))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) within the radius."""
        row, item = self.fetched(prints)
        close = np.bitwise_count(prints[row] ^ self.prints[item]) <= RADIUS
        return row[close], item[close]

    def search(self, names: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, end word, similarity) of the best window of each leaked item of MIN_WORDS words or more."""
        at = np.flatnonzero(self.gate[(names >> U64(64 - _GATE)).astype(np.int64)])
        windows = {(p - o, k) for p in at.tolist() for o, k in self.seeds.get(int(names[p]), ())}
        best: dict[int, tuple] = {}
        by_size: dict[int, list[int]] = {}
        for start, k in sorted(windows):
            by_size.setdefault(min(k, len(names)), []).append(min(max(start, 0), max(0, len(names) - k)))
        for k, starts in by_size.items():
            first = np.unique(starts)
            for low in range(0, len(first), 4096):
                some = first[low : low + 4096]
                shingles = names[some[:, None] + np.arange(k)]
                row, item = self.candidates(simhash(shingles))
                fits = np.minimum(self.sizes[item], len(names)) == k  # the window is as long as the item
                row, item = row[fits], item[fits]
                for r, t in zip(row.tolist(), item.tolist(), strict=True):
                    s = similarity(shingles[r], self.shingles[t], self.weights[t])
                    if s >= THRESHOLD and s > best.get(t, (0,))[-1]:
                        best[t] = (t, int(some[r]), int(some[r]) + k + N - 1, s)
        return sorted(best.values())

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        """Leaks of each text of a batch; every text ends with a line break."""
        out: list[list[dict]] = []
        for first, last in chunks(offsets, 1 << 18):
            own, begin = _word_names(data[offsets[first] : offsets[last]])
            at = np.searchsorted(begin, offsets[first : last + 1] - offsets[first])
            names = _runs(own, N)
            hit = np.cumsum(np.append(0, self.gate[(names >> U64(64 - _GATE)).astype(np.int64)]))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                end = max(a, b - N + 1)
                found = self.search(names[a:end]) if end > a and hit[end] > hit[a] else ()
                out.append([{"item": self.ids[t], "first": x, "end": y, "similarity": s} for t, x, y, s in found])
            for n, known in self.short.items():
                runs = _runs(own, n)
                for p in np.flatnonzero(np.isin(runs, np.array(list(known), U64))).tolist():
                    d = int(np.searchsorted(at, p, "right")) - 1
                    if p + n <= at[d + 1]:
                        mine, seen = out[first + d], {x["item"] for x in out[first + d]}
                        mine += [{"item": i, "first": p - int(at[d]), "end": p - int(at[d]) + n, "similarity": 1.0} for i in known[int(runs[p])] if i not in seen]
        return out


def _text(text_col: str):
    return F.concat(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("\n")).cast("binary")


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """i, names (of its words) and holders (of its shingles, over the whole benchmark) of every item with words."""
    import pyarrow as pa

    kind = benchmark.schema[item_col].dataType.simpleString()

    def emit(batches: Iterator) -> Iterator:
        for batch in sliced(batches):
            data, offsets = binary_parts(batch.column("t"))
            names = [_word_names(data[a:b])[0] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            runs = [_runs(x, N).view(np.int64) if len(x) >= MIN_WORDS else [] for x in names]
            long_list = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("u"), pa.array([x.view(np.int64) for x in names], long_list), pa.array(runs, long_list)], names=["i", "u", "names", "runs"])

    rows = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("i"), F.monotonically_increasing_id().alias("u"), _text(item_text).alias("t"))
    rows = materialize(rows.mapInArrow(emit, f"i {kind}, u long, names array<long>, runs array<long>").where(F.size("names") > 0), "items")
    held = materialize(rows.select(F.explode(F.array_distinct("runs")).alias("r")).groupBy("r").agg(F.count("*").cast("int").alias("n")), "shingles")
    each = rows.select("u", F.posexplode("runs").alias("p", "r")).join(held, "r")
    lists = each.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("x")).select("u", F.col("x.n").alias("holders"))  # one item's
    return materialize(rows.drop("runs").join(lists, "u", "left").select("i", "u", "names", F.coalesce("holders", F.array().cast("array<int>")).alias("holders")), "benchmark")


def _searched(rows: DataFrame, shared, kind: str) -> DataFrame:
    """``rows`` of _k and _t with leaks instead of _t, for one slice of the benchmark."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    import pyarrow as pa

    schema = f"array<struct<item:{kind},first:int,end:int,similarity:double>>"
    arrow = to_arrow_type(_parse_datatype_string(schema))

    def emit(batches: Iterator) -> Iterator:
        index = Index([(i, np.frombuffer(n, U64), np.frombuffer(h, np.int32)) for i, n, h in shared.value])
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(index.leaks(*binary_parts(batch.column("_t"))), arrow)], names=["_k", "leaks"])

    return rows.mapInArrow(emit, f"_k {rows.schema['_k'].dataType.simpleString()}, leaks {schema}")


def _with_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, slice_items: int) -> DataFrame:
    """_row (all columns of a row), _d and leaks."""
    spark = docs.sparkSession
    items = _items(benchmark, item_col, item_text)
    slices = max(1, -(-items.count() // slice_items))
    kind = benchmark.schema[item_col].dataType.simpleString()
    text = _text(text_col).alias("_t")

    def searched(rows: DataFrame, k: int):
        part = items.where(F.pmod(F.xxhash64("u"), F.lit(slices)) == k).orderBy("i", "u")
        got = [(r["i"], np.array(r["names"], np.int64).tobytes(), np.array(r["holders"], np.int32).tobytes()) for r in part.collect()]  # about one slice
        shared = spark.sparkContext.broadcast(got)
        return _searched(rows, shared, kind), shared

    if slices == 1:
        rows = docs.select(F.struct(F.struct("*").alias("row"), F.col(id_col).alias("d")).alias("_k"), text)
        return searched(rows, 0)[0].select(F.col("_k.row").alias("_row"), F.col("_k.d").alias("_d"), "leaks")
    key = keyed(docs, id_col, text_col).select(F.struct("_d", "_h").alias("_k"), F.concat(F.lower("_t"), F.lit("\n")).cast("binary").alias("_t"))
    found = None
    for k in range(slices):
        hits, shared = searched(key, k)
        hits = materialize(hits.where(F.size("leaks") > 0).dropDuplicates(["_k"]), "leaks")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("_k").agg(F.flatten(F.collect_list("leaks")).alias("leaks")).select(F.col("_k._d").alias("_d2"), F.col("_k._h").alias("_h2"), "leaks")
    both = packed(docs, id_col, text_col).join(found.hint("merge"), F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")), "left")
    return both.select("_row", "_d", F.coalesce("leaks", F.array().cast(found.schema["leaks"].dataType)).alias("leaks"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_items: int = SLICE) -> DataFrame:
    """Per row: ``id_col`` and leaks, a list of (item, first word, end word, similarity) in order of items."""
    out = _with_leaks(docs, benchmark, id_col, text_col, item_col, item_text, slice_items)
    return out.select(F.col("_d").alias(id_col), F.array_sort("leaks").alias("leaks"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_items: int = SLICE) -> DataFrame:
    """The rows of ``docs`` without a leaked item, with all their columns."""
    return _with_leaks(docs, benchmark, id_col, text_col, item_col, item_text, slice_items).where(F.size("leaks") == 0).select("_row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the benchmark items that each document holds."""
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.size("leaks").cast("long").alias("n_leaks"), F.col("leaks.item").alias("items"), (F.size("leaks") > 0).alias("contaminated"))
