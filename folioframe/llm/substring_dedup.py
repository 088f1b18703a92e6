"""Operator 3, substring dedup: remove every word that a repeated window of ``size`` words covers.

Recompression names word runs and pairs alike in all documents (``recompression``); windows that share
their highest interior symbol are compared as runs, blocks and single windows (``repeats``), which
verifies the repeat and finds its exact ends. A window goes if it also starts in a document with a
smaller id. The result is exact but for collisions of names: windows of one run are told apart by two
64-bit names, blocks and single windows by one 64-bit name within an equal 64-bit symbol.

Nulls have no words; texts under ``size`` words stay whole. Rows with one id do not match each other,
so rows that repeat as a whole, id included, both stay. Null ids come after all others; text ids are
ordered as texts. Very long texts are cut into overlapping tiles, so memory does not grow with them but
for one text itself. Only id and text are read, so other columns cannot clash. No table, an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_parts, keyed, sliced, table
from .recompression import ROUNDS, WordUnit, words
from .repeats import covered, repeated_windows, with_spans

SIZE = 50


def substring_dedup(docs: DataFrame, size: int = SIZE, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_words, n_removed and kept (the kept words joined by one space)."""
    import pyarrow as pa

    rows = keyed(docs, id_col, text_col)
    spans = repeated_windows(rows, WordUnit(size, rounds), across=True)
    both = with_spans(rows, spans).select("_d", F.col("_t").cast("binary").alias("_t"), "spans")

    def emit(batches: Iterator) -> Iterator:
        for batch in sliced(batches):
            data, offsets = binary_parts(batch.column("_t"))
            kept, total, removed = [], [], []
            for i, own in enumerate(batch.column("spans")):
                text = data[offsets[i] : offsets[i + 1]]
                # str.split would also cut at other white space; bytes.split cuts at the six ASCII ones.
                parts = text.tobytes().split()
                gone = 0
                if own.is_valid:
                    mask = covered(len(parts), np.asarray(own.values), size)
                    gone = int(mask.sum())
                    parts = [w for w, x in zip(parts, mask.tolist(), strict=True) if not x]
                kept.append(b" ".join(parts))
                total.append(len(parts) + gone)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_d"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[id_col, "n_words", "n_removed", "kept"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return both.mapInArrow(emit, f"`{id_col}` {kind}, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: digests of ``substring_dedup`` over all documents."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str]], size: int) -> list[tuple[int, int, int, str]]:
    """doc_id, n_words, n_removed and kept text, by a table of all windows."""
    import re

    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least: dict[tuple, int] = {}
    for d, w in split:
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if least[tuple(w[p : p + size])] < d:
                gone[p : p + size] = [True] * size
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out
