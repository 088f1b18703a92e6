"""Operator 7, best-fit packing: variable-capacity best-fit decreasing over the histogram of lengths.

Token counts are exact for the byte-level vocabulary named by ``vocabulary`` (a parameter; one of the
public files). Texts longer than the largest permitted sequence are cut into pieces of that length and
a rest, so no token is lost. How pieces go into bins depends on lengths only, so the plan is made on
the driver from the histogram of piece lengths, which has at most ``max(CAPACITIES)`` rows whatever the
corpus: longest first, each piece into the open bin with the least room that still holds it, all pieces
of one length at a time. A piece that fits nowhere opens a bin, of the size that costs least per token
under a look-ahead: every rule "open sizes of at least c" is simulated and the cheapest plan wins.
Finally each bin shrinks to the smallest permitted size that holds its contents. The plan maps ranges
of piece numbers to ranges of bins; pieces are numbered within each length by sums over partitions.

Null and empty texts have no tokens and get no piece. Repeated rows are packed each; ties go by number.
A bin costs its size plus ``OVERHEAD``. The plan's ranges are broadcast: a few for each pair of lengths
that meet in a bin, bounded by the permitted sizes and not by the corpus; their number is checked.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, sliced, table

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_RANGES = 2_000_000


def load_encoding(vocabulary: str = VOCABULARY):
    """Encoder of a public vocabulary file: a name among them, or a path."""
    import base64

    import public_tokenizers as public
    import tiktoken

    path = vocabulary if "/" in vocabulary else public.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenCounter:
    """Number of tokens of texts. Parts between single spaces or line breaks are encoded alone, which the
    pattern allows, and their counts are kept for up to ``LIMIT`` different parts."""

    LIMIT = 300_000

    def __init__(self, vocabulary: str = VOCABULARY):
        self.encode = load_encoding(vocabulary).encode_ordinary
        self.known: dict[str, int] = {}

    def _line(self, line: str) -> int:
        parts = line.split(" ")
        get, total = self.known.get, 0
        for i, p in enumerate(parts):
            key = " " + p if i else p
            n = get(key)
            if n is None:
                if len(self.known) > self.LIMIT:
                    self.known.clear()
                n = self.known[key] = len(self.encode(key))
            total += n
        return total

    def __call__(self, text: str) -> int:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or not text.isprintable() and any(c.isspace() and c not in " \n" for c in text) or text[-1:].isspace() or text[:1].isspace():
            return len(self.encode(text))
        lines = text.split("\n")
        return sum(self._line(x) for x in lines) + len(lines) - 1


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col`` and n_tokens."""
    import pyarrow as pa

    def emit(batches: Iterator) -> Iterator:
        count = TokenCounter(vocabulary)
        for batch in sliced(batches):
            n = [count(t) if t else 0 for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_d"), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t")).mapInArrow(emit, f"`{id_col}` {kind}, n_tokens long")


def plan_bins(histogram: dict[int, int], capacities: tuple[int, ...], least: int) -> tuple[list[tuple], list[tuple]]:
    """Best-fit decreasing over a histogram, opening sizes of at least ``least`` where a piece fits nowhere.

    Returns ranges (length, first piece, number, first bin) and bins (first bin, number, contents).
    """
    sizes = sorted(capacities)
    open_: dict[int, list[tuple[int, int, int]]] = {}  # room: (first bin, number, contents)
    rooms: list[int] = []
    ranges, made = [], 0

    def put(room: int, entry: tuple[int, int, int]) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append(entry)

    for length in sorted(histogram, reverse=True):
        done, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                size = next(c for c in sizes if c >= max(length, least) or c == sizes[-1])
                each = size // length
                full, rest = divmod(left, each)
                for n, copies in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        for c in range(copies):  # piece c of each of the n new bins
                            ranges.append((length, done + c * n, n, made))
                        done += n * copies
                        put(size - length * copies, (made, n, length * copies))
                        made += n
                left = 0
                break
            room = rooms[at]
            first, n, held = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            take = min(n, left)
            if take < n:
                put(room, (first + take, n - take, held))
            ranges.append((length, done, take, first))
            put(room - length, (first, take, held + length))
            done, left = done + take, left - take
    return ranges, [e for v in open_.values() for e in v]


def cheapest_plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD):
    """The plan of least cost over all opening rules, and its bins with their final sizes."""
    best = None
    for least in sorted(capacities):
        ranges, bins = plan_bins(histogram, capacities, least)
        sized = [(first, n, held, next(c for c in sorted(capacities) if c >= held)) for first, n, held in bins]
        cost = sum(n * (c + overhead) for _, n, _, c in sized)
        if best is None or cost < best[0]:
            best = (cost, ranges, sized)
    return best


def numbered(pieces: DataFrame, key: str) -> DataFrame:
    """Number the rows of each ``key`` from 0, without gathering a key's rows: counts by partition, then offsets.

    ``pieces`` must be stored rows, so that partitions hold the same rows each time.
    """
    import pyarrow as pa

    names = pieces.columns
    placed = pieces.withColumn("_p", F.spark_partition_id())
    counts = placed.groupBy(key, "_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(key).alias("_k"), F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_o"))

    def emit(batches: Iterator) -> Iterator:
        seen: dict[int, int] = {}
        for batch in batches:
            ranks = []
            for k in batch.column(key).to_pylist():
                ranks.append(seen.get(k, 0))
                seen[k] = ranks[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64())], names=[*batch.schema.names, "_r"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    local = placed.mapInArrow(emit, kinds + ", _r long")
    return local.join(offsets, (F.col(key) == F.col("_k")) & (F.col("_p") == F.col("_q"))).select(*names, (F.col("_r") + F.col("_o")).alias("number"))


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, id_col: str = "doc_id") -> DataFrame:
    """Rows of (id, n_tokens) as pieces: id, piece, n_tokens, first_token, bin, bin_size and bin_tokens."""
    import pyarrow as pa

    top = max(capacities)
    pieces = lengths.where("n_tokens > 0").select(
        F.col(id_col), F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {top}")), lambda i: F.least(F.lit(top).cast("long"), F.col("n_tokens") - i * top))).alias("piece", "length")
    )
    pieces = materialize(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``top`` rows
    _, ranges, bins = cheapest_plan(histogram, capacities, overhead) if histogram else (0, [], [])
    if len(ranges) > MAX_RANGES:
        raise ValueError(f"{len(ranges)} ranges in the plan; permit fewer or smaller sequence lengths")
    ranges.sort()
    bins.sort()
    shared = lengths.sparkSession.sparkContext.broadcast((np.array(ranges, np.int64).reshape(-1, 4), np.array(bins, np.int64).reshape(-1, 4)))
    kind = lengths.schema[id_col].dataType.simpleString()

    def emit(batches: Iterator) -> Iterator:
        ranges, bins = shared.value
        first = ranges[:, 0] * (1 << 44) + ranges[:, 1]
        for batch in batches:
            length, number = np.asarray(batch.column("length")).astype(np.int64), np.asarray(batch.column("number"))
            at = np.searchsorted(first, length * (1 << 44) + number, "right") - 1
            own = ranges[at, 3] + number - ranges[at, 1]
            b = np.searchsorted(bins[:, 0], own, "right") - 1
            piece = np.asarray(batch.column("piece")).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *map(pa.array, (piece, length, piece * top, own, bins[b, 3], bins[b, 2]))], names=[id_col, "piece", "n_tokens", "first_token", "bin", "bin_size", "bin_tokens"])

    return numbered(pieces, "length").select(id_col, "piece", "length", "number").mapInArrow(emit, f"`{id_col}` {kind}, piece long, n_tokens long, first_token long, bin long, bin_size long, bin_tokens long")


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    return pack(materialize(token_counts(docs, vocabulary), "tokens"), capacities)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the bin of every piece of every document."""
    return pack_documents(table(spark, sf_dir, "documents"))
