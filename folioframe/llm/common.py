"""Helpers that several operators share: table access, materialisation, batches of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of code points outside space and \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and driver and executors are one process (tests, one machine), a
    temporary folder is made and set; a cluster must name a folder that all its machines share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folioframe-shared-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and later readers of the
    same rows do not compute them again.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/folioframe/{spark.sparkContext.applicationId}"


def clear_intermediate(spark: SparkSession) -> None:
    """Delete all that ``materialize`` wrote for this application; call it when the results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row`` (all columns as one, so that no name of theirs can clash), ``_d`` and ``_h`` as in ``keyed``."""
    return docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_d`` (id), ``_h`` (hash of the text) and ``_t`` (text, null as empty) of each row.

    Ids may repeat or be null, so a row is addressed by id and text hash together; rows equal
    in both get the same result. Other columns of ``docs`` are left out, so their names cannot clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_d"), F.xxhash64(text).alias("_h"), text.alias("_t"))


def same_row(left: DataFrame, right: DataFrame):
    """Null-safe condition on ``_d`` and ``_h``."""
    return left["_d"].eqNullSafe(right["_d"]) & (left["_h"] == right["_h"])


def binary_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary or string array, without copies."""
    import pyarrow as pa

    if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def sliced(batches: Iterator, rows: int = 1024) -> Iterator:
    """Parts of at most ``rows`` rows of Arrow batches, so that what a worker makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit name for the pair (a, b); equal pairs get equal names everywhere."""
    x = a * U64(0x9E3779B97F4A7C15 ^ (salt * 2 & 0xFFFF))
    x += b * U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    return x


def chunks(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Cut documents into consecutive groups of at most ``limit`` units, one document at least."""
    found, first = [], 0
    n = len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        found.append((first, last))
        first = last
    return found


def lowest_share(hashes, share: float):
    """Condition for rows whose 64-bit hash is in the lowest ``share`` of all hashes: a sample without a sort."""
    return hashes <= F.lit(min(2**63 - 1, int((2 * share - 1) * 2**63)))
