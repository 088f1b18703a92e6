"""Exact search for repeated windows, by names that are ranked again at finer steps.

The unit (bytes or words) turns every window into a *run* row: windows that choose the same inner
anchor. A run has a *core*, content that each of its windows holds, and a *hull*, the content of all
of them. Over all runs Spark counts cores and compares hulls:

- a core met once: none of its windows is repeated; the row ends here (its rank is unique);
- a core whose hulls are all equal: all its windows are repeated together;
- else one run for each different hull goes on, cut into blocks of windows, then single windows,
  where the same rule applies. A single window's core is its hull, so the last step decides all.

Counting is by partial aggregation, so copies and hot passages shrink before they are shuffled, and
no group of rows is ever gathered. Names have 64 bits and are compared within equal 64-bit cores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import U64, binary_parts, materialize, mix, sliced

RUN_FIELDS = ("doc", "sym", "rk", "l", "r", "a")
#: Windows in a block of the middle step.
BLOCK = 16


def gathered(parts: dict[str, list]) -> dict[str, np.ndarray]:
    return {k: np.concatenate(v) if v else np.zeros(0, U64 if k in ("sym", "rk") else np.int64) for k, v in parts.items()}


def _rows(docs: DataFrame, unit) -> DataFrame:
    """One row for each run: _d, _h, sym, rk, lr (first and last window start), off (anchor - first)."""
    import pyarrow as pa

    def emit(batches: Iterator) -> Iterator:
        for batch in sliced(batches):
            data, offsets = binary_parts(batch.column("_t"))
            found = unit.runs(data, offsets)
            at = pa.array(found["doc"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_d").take(at),
                    batch.column("_h").take(at),
                    pa.array(found["sym"].view(np.int64)),
                    pa.array(found["rk"].view(np.int64)),
                    pa.array((found["l"] << 32) | found["r"]),
                    pa.array((found["a"] - found["l"]).astype(np.int32)),
                ],
                names=["_d", "_h", "sym", "rk", "lr", "off"],
            )

    kind = docs.schema["_d"].dataType.simpleString()
    return docs.select("_d", "_h", F.col("_t").cast("binary").alias("_t")).mapInArrow(
        emit, f"_d {kind}, _h long, sym long, rk long, lr long, off int"
    )


def _slices(docs: DataFrame, reps: DataFrame, unit) -> DataFrame:
    """Add to each representative run the content of its hull."""
    import pyarrow as pa

    kind = docs.schema["_d"].dataType.simpleString()
    lists = reps.groupBy("_d", "_h").agg(F.collect_list(F.struct("sym", "rk", "lr", "off")).alias("runs"))
    both = docs.select("_d", "_h", F.col("_t").cast("binary").alias("_t"))
    both = both.join(lists.withColumnsRenamed({"_d": "_d2", "_h": "_h2"}).hint("merge"), F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")))

    def emit(batches: Iterator) -> Iterator:
        for batch in sliced(batches):
            data, offsets = binary_parts(batch.column("_t"))
            runs = batch.column("runs")
            flat, sizes = runs.flatten(), np.diff(np.asarray(runs.offsets))
            field = {k: np.asarray(flat.field(k)) for k in ("sym", "rk", "lr", "off")}
            cuts, out = np.append(0, np.cumsum(sizes)), []
            for i in range(len(sizes)):
                lr = field["lr"][cuts[i] : cuts[i + 1]]
                out += unit.slices(data[offsets[i] : offsets[i + 1]], lr >> 32, lr & 0xFFFFFFFF)
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            wide = (field["lr"] & 0xFFFFFFFF) - (field["lr"] >> 32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_d").take(at), *(pa.array(field[k]) for k in ("sym", "rk", "off")), pa.array(wide.astype(np.int32)), pa.array(out, pa.binary())],
                names=["_d", "sym", "rk", "off", "wide", "slice"],
            )

    return both.select("_d", "_t", "runs").mapInArrow(emit, f"_d {kind}, sym long, rk long, off int, wide int, slice binary").dropDuplicates(["sym", "rk"])


def _blocks(reps: DataFrame, unit, block: int) -> DataFrame:
    """Core and hull names of blocks of ``block`` windows, aligned by their distance to the anchor.

    ``todo`` of a row lists [low, high] distances to cut; a null list means all of the run.
    """
    import pyarrow as pa

    size = unit.size

    def emit(batches: Iterator) -> Iterator:
        for batch in batches:
            step = 4096
            for at in range(0, batch.num_rows, step):
                yield cut(batch.slice(at, step))

    def cut(batch):
        data, offsets = binary_parts(batch.column("slice"))
        name = unit.namer(data.tobytes())
        starts = offsets // unit.bytes_each
        off, wide = np.asarray(batch.column("off")).astype(np.int64), np.asarray(batch.column("wide")).astype(np.int64)
        if "todo" in batch.schema.names:
            todo = batch.column("todo")
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(todo.offsets)))
            low = np.asarray(todo.flatten().field("lo")).astype(np.int64)
            high = np.asarray(todo.flatten().field("hi")).astype(np.int64)
        else:
            row, low, high = np.arange(batch.num_rows), off - wide, off
        count = high // block - low // block + 1
        item = np.repeat(np.arange(len(row)), count)
        number = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low // block, count)
        lo, hi = np.maximum(number * block, low[item]), np.minimum(number * block + block - 1, high[item])
        at = row[item]
        anchor = starts[at] + off[at]
        # Windows at distances lo..hi start at anchor-hi..anchor-lo; the core is in any window of the whole block.
        core = name(anchor - number * block, size - block + 1)
        key = mix(core, number.astype(U64), 3)
        hull = key if block == 1 else mix(mix(name(anchor - hi, size), name(anchor - lo, size), 4), ((lo << 32) | hi).astype(U64), 5)
        pick = pa.array(at)
        return pa.RecordBatch.from_arrays(
            [batch.column("_d").take(pick), batch.column("sym").take(pick), batch.column("rk").take(pick), pa.array(key.view(np.int64)), pa.array(hull.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
            names=["_d", "sym", "rk", "key", "hull", "lo", "hi"],
        )

    kind = reps.schema["_d"].dataType.simpleString()
    return reps.mapInArrow(emit, f"_d {kind}, sym long, rk long, key long, hull long, lo int, hi int")


def repeated_windows(docs: DataFrame, unit, across: bool) -> DataFrame:
    """Starts of repeated windows of each text: _d, _h and ``spans``, a list of first start << 32 | last start - first start.

    ``docs`` comes from ``keyed``. across=False: a window counts if its content also starts anywhere
    else. across=True: if it also starts in a text with a smaller ``_d``; null ids come last, and texts
    under one id do not match each other. Ids may have any type that Spark orders.
    """
    if not across:
        order = F.lit(0)
    elif isinstance(docs.schema["_d"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        order = F.coalesce(F.col("_d").cast("long"), F.lit(2**63 - 1))
    else:
        order = F.struct(F.col("_d").isNull().alias("z"), F.col("_d").alias("d"))
    rows = materialize(_rows(docs, unit), "runs")

    def counted(df: DataFrame, keys: list[str], hull: str) -> DataFrame:
        got = [F.count("*").alias("n"), F.min(hull).alias("h0"), F.max(hull).alias("h1")]
        if across:
            got += [F.min(order).alias("d0"), F.max(order).alias("d1")]
        out = df.groupBy(*keys).agg(*got)
        return out.where("d0 < d1" if across else "n > 1")

    def whole(own: Column) -> Column:
        """Whether a row is repeated, given that all hulls of its core are equal."""
        return own > F.col("d0") if across else F.lit(True)

    # Stored first: a join side that is an aggregate itself would keep Spark from splitting a hot anchor's rows.
    first = materialize(counted(rows, ["sym"], "rk").drop("n"), "anchors")
    met = materialize(rows.join(first, "sym").withColumn("own", order), "met")
    plain = met.where((F.col("h0") == F.col("h1")) & whole(F.col("own"))).select("_d", "_h", "lr")
    mixed = met.where("h0 <> h1").select("_d", "_h", "sym", "rk", "lr", "off", "own")
    by_hull = mixed.groupBy("sym", "rk").agg(
        F.count("*").alias("copies"), F.min("own").alias("least"), F.min(F.struct("own", "_d", "_h", "lr", "off")).alias("rep")
    )
    by_hull = materialize(by_hull, "hulls")
    reps = materialize(_slices(docs, by_hull.select("rep._d", "rep._h", "sym", "rk", "rep.lr", "rep.off"), unit), "slices")

    blocks = materialize(_blocks(reps, unit, BLOCK), "blocks").withColumn("own", order)
    told = blocks.join(materialize(counted(blocks, ["sym", "key"], "hull"), "cores"), ["sym", "key"])
    told = materialize(told.where((F.col("h0") != F.col("h1")) | whole(F.col("own"))).select("sym", "rk", "lo", "hi", (F.col("h0") != F.col("h1")).alias("open")), "told")
    todo = told.where("open").groupBy("sym", "rk").agg(F.collect_list(F.struct("lo", "hi")).alias("todo"))
    single = materialize(_blocks(reps.join(todo, ["sym", "rk"]), unit, 1), "single").withColumn("own", order)
    sure = single.join(materialize(counted(single, ["sym", "key"], "hull").drop("n"), "windows"), ["sym", "key"]).where(whole(F.col("own"))).select("sym", "rk", "lo", "hi")
    verdict = told.where("not open").select("sym", "rk", "lo", "hi").unionByName(sure)
    verdict = materialize(verdict.groupBy("sym", "rk").agg(F.collect_list(F.struct("lo", "hi")).alias("parts")), "verdicts")

    # Of the runs with one hull, those that repeat as a whole are gone; the rest take their hull's verdict. All that is
    # known of a hull is stored as one side, so that one join follows, of which Spark can split a hot hull's rows.
    hulls = by_hull.select("sym", "rk", "copies", "least").join(verdict, ["sym", "rk"], "left")
    members = mixed.join(materialize(hulls, "hull-verdicts"), ["sym", "rk"])
    again = F.col("own") > F.col("least") if across else F.col("copies") > 1
    anchor = F.shiftright("lr", 32) + F.col("off")
    cut = F.transform("parts", lambda p: F.shiftleft(anchor - p["hi"], 32) + (anchor - p["lo"]))
    found = plain.unionByName(members.select("_d", "_h", F.explode(F.when(again, F.array("lr")).otherwise(cut)).alias("lr")))
    # As start and width: the set's hash of (l, l) would be 0 for every l, and a text of one repeated character is a million of these.
    return found.groupBy("_d", "_h").agg(F.collect_set(F.col("lr") - F.shiftright("lr", 32)).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All rows of ``docs`` with their spans (null: none); both grow with the corpus, so it is a shuffle at every size."""
    other = spans.withColumnsRenamed({"_d": "_d2", "_h": "_h2"})
    return docs.join(other.hint("merge"), docs["_d"].eqNullSafe(other["_d2"]) & (docs["_h"] == other["_h2"]), "left").drop("_d2", "_h2")


def covered(length: int, spans: np.ndarray, size: int) -> np.ndarray:
    """Mask of the units that windows of ``size`` at these packed starts cover."""
    edge, first = np.zeros(length + 1, np.int64), spans >> 32
    np.add.at(edge, first, 1)
    np.add.at(edge, first + (spans & 0xFFFFFFFF) + size, -1)
    return np.cumsum(edge[:-1]) > 0

