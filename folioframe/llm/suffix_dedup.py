"""Operator 1, suffix-array dedup: remove every byte that a repeated string of ``size`` bytes covers.

Distributed prefix doubling: names of strings are paired at growing offsets (8 to 100 bytes within a
worker, then the window length), and Spark ranks the pairs again until a rank is unique or the string
is past the threshold; see ``suffix_names`` and ``repeats``. Only positions that represent a run of
windows are shuffled. The result is exact but for collisions of names: windows of one run are told apart
by two 64-bit names, blocks and single windows by one 64-bit name within an equal 64-bit anchor name.

Very long texts are cut into overlapping tiles. Only id (of any type, null too) and text are read, so
other columns cannot clash. Nulls are empty texts; texts shorter than ``size`` bytes keep all. Rows that repeat as a whole are
strings that start elsewhere too, so all their long strings go. No table, an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_parts, keyed, sliced, table
from .repeats import covered, repeated_windows, with_spans
from .suffix_names import ByteUnit

SIZE = 400


def suffix_dedup(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_bytes, kept (binary: the remaining bytes) and removed, the maximal removed byte runs."""
    import pyarrow as pa

    rows = keyed(docs, id_col, text_col)
    spans = repeated_windows(rows, ByteUnit(size), across=False)
    both = with_spans(rows, spans).select("_d", F.col("_t").cast("binary").alias("_t"), "spans")

    def emit(batches: Iterator) -> Iterator:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in sliced(batches):
            data, offsets = binary_parts(batch.column("_t"))
            kept, removed = [], []
            for i, own in enumerate(batch.column("spans")):
                text = data[offsets[i] : offsets[i + 1]]
                if not own.is_valid:
                    kept.append(text.tobytes())
                    removed.append([])
                    continue
                gone = covered(len(text), np.asarray(own.values), size)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).tolist()
                kept.append(text[~gone].tobytes())
                removed.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_d"), pa.array(np.diff(offsets)), pa.array(kept, pa.binary()), pa.array(removed, kind)],
                names=[id_col, "n_bytes", "kept", "removed"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return both.mapInArrow(emit, f"`{id_col}` {kind}, n_bytes long, kept binary, removed array<struct<start:long,end:long>>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: digests of ``suffix_dedup`` over all documents."""
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(texts: list[bytes], size: int) -> list[tuple[int, int, str]]:
    """n_removed, n_spans and kept_sha256 of each text, by a table of all strings."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - size + 1):
            seen[t[p : p + size]] = seen.get(t[p : p + size], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(t, gone, strict=True) if not x)).hexdigest()))
    return out
