"""A small PDF writer for tables of placed words; used to make files from tables and in tests."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build_pdf(objects: dict[int, bytes], root: int = 1) -> bytes:
    """A file from object bodies by number, with a classic cross-reference table."""
    parts, at, length = [b"%PDF-1.7\n"], {}, 9
    for n in sorted(objects):
        at[n] = length
        parts.append(b"%d 0 obj\n%b\nendobj\n" % (n, objects[n]))
        length += len(parts[-1])
    size, start = max(objects) + 1, length
    parts.append(b"xref\n0 %d\n" % size)
    parts += [b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(size)]
    return b"".join([*parts, b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (size, root, start)])


def stream(data: bytes, flate: bool = False, extra: bytes = b"") -> bytes:
    data = zlib.compress(data, 1) if flate else data
    return b"<< /Length %d %s%s>>\nstream\n" % (len(data), b"/Filter /FlateDecode " if flate else b"", extra) + data + b"\nendstream"


_SPECIAL = re.compile(r"[\\()]")


def _literal(text: str) -> bytes:
    if text.isascii() and not _SPECIAL.search(text):
        return b"(%b)" % text.encode()
    raw = text.encode("cp1252", "replace")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def pages_pdf(pages: list[bytes], width: float = 612, height: float = 792, font: bytes | None = None, page_extra: bytes = b"", flate: bool = False) -> bytes:
    """A file with one content stream for each page and the font F1 (glyphs of half an em unless told otherwise)."""
    font = font or b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: font}
    kids = []
    for i, content in enumerate(pages):
        page, body = 4 + 2 * i, 5 + 2 * i
        kids.append(b"%d 0 R" % page)
        objects[page] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> %s >>" % (body, page_extra)
        objects[body] = stream(content, flate)
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 %g %g] >>" % (b" ".join(kids), len(kids), width, height)
    return build_pdf(objects)


def words_pdf(pages: list[list[tuple[str, float, float]]], size: float = 12.0, flate: bool = True) -> bytes:
    """A file that shows words (text, x, top) at their places; each second page uses saved states and TJ."""
    streams = []
    for k, words in enumerate(pages):
        out = [b"BT /F1 %g Tf" % size]
        for text, x, top in words:
            y = 792 - top - size
            if k % 2:
                half = len(text) // 2
                out.append(b"ET q 1 0 0 1 %g %g cm BT /F1 %g Tf [%s 0 %s] TJ ET Q BT /F1 %g Tf" % (x, y, size, _literal(text[:half]), _literal(text[half:]), size))
            else:
                out.append(b"1 0 0 1 %g %g Tm %s Tj" % (x, y, _literal(text)))
        streams.append(b"\n".join([*out, b"ET"]))
    return pages_pdf(streams, flate=flate)


def words_streams(text, x: np.ndarray, top: np.ndarray, page: np.ndarray, cuts: np.ndarray, odd: np.ndarray, size: float = 12.0) -> list[bytes] | None:
    """The content streams that ``words_pdf`` makes, for pages by columns: texts (Arrow strings), places (page is the page of
    each word, its words lie between ``cuts``) and whether a page is a second one. None if a text needs an escape."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset :][: len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if text.null_count or (raw >= 0x80).any() or np.isin(raw, np.frombuffer(b"\\()", np.uint8)).any():
        return None
    ends = ends - ends[0]

    def numbers(values: np.ndarray):
        kinds, which = np.unique(values, return_inverse=True)
        return pa.array([f"{v:g}" for v in kinds.tolist()], pa.string()).take(pa.array(which))

    x, y = numbers(x.astype(np.float64)), numbers(792 - top.astype(np.float64) - size)
    second = odd[page]
    one, two = np.flatnonzero(~second), np.flatnonzero(second)
    ones, twos = pa.array(one), pa.array(two)
    # Both halves of each text: every second place is in the middle of it.
    places = np.empty(2 * len(text) + 1, np.int32)
    places[::2], places[1::2] = ends, ends[:-1] + np.diff(ends) // 2
    halves = pa.StringArray.from_buffers(2 * len(text), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(raw)))
    font, join = f"/F1 {size:g} Tf", pc.binary_join_element_wise
    lines = pa.concat_arrays([
        join("1 0 0 1 ", x.take(ones), " ", y.take(ones), " Tm (", text.take(ones), ") Tj\n", ""),
        join("ET q 1 0 0 1 ", x.take(twos), " ", y.take(twos), f" cm BT {font} [(", halves.take(pa.array(2 * two)), ") 0 (", halves.take(pa.array(2 * two + 1)), f")] TJ ET Q BT {font}\n", ""),
    ])
    order = np.empty(len(text), np.int64)
    order[np.concatenate([one, two])] = np.arange(len(text))
    lines = lines.take(pa.array(order))
    at = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset :][: len(lines) + 1][cuts].tolist()
    data, head = bytes(lines.buffers()[2] or b""), f"BT {font}\n".encode()
    return [head + data[i:j] + b"ET" for i, j in zip(at[:-1], at[1:], strict=True)]


def spread(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """Rows dealt by document (or another column) into as many partitions as shuffles have. Files are small but cost much work, so the
    number must not be lowered by their size."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(n, by)


def write_documents(words: DataFrame) -> DataFrame:
    """doc_id and content (a PDF file) from a table of words (doc_id, page_index, text, x, top)."""
    import pyarrow as pa

    pages = spread(words).groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("top", "x", "text"))).alias("w"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "w"))).alias("pages"))

    def emit(batches: Iterator) -> Iterator:
        for batch in batches:
            made = []
            for pages in batch.column("pages").to_pylist():
                made.append(words_pdf([[(w["text"], w["x"], w["top"]) for w in p["w"]] for p in pages]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "content"])

    return docs.mapInArrow(emit, "doc_id string, content binary")


def page_objects(pages: DataFrame, font: Column | str, more: DataFrame | None = None) -> DataFrame:
    """Objects (doc_id, number, body) of files from their pages (doc_id, page_index, streams, extra).

    streams are up to 19 content streams of a page, extra goes into its dictionary; font is the body of the
    font F1, a text or a column of ``pages``. ``more`` adds objects, numbers 4 to 9.
    """
    font = F.lit(font) if isinstance(font, str) else font
    at = lambda j: 10 + 20 * F.col("page_index") + j
    refs = F.array_join(F.transform("streams", lambda s, j: F.format_string("%d 0 R", at(j + 1))), " ")
    page = F.concat(F.lit("<< /Type /Page /Parent 2 0 R /Contents ["), refs, F.lit("] /Resources << /Font << /F1 3 0 R >> >> "), F.col("extra"), F.lit(" >>"))
    bodies = F.transform("streams", lambda s, j: F.struct(at(j + 1).alias("number"), F.concat(F.lit("<< >>\nstream\n"), s, F.lit("\nendstream")).alias("body")))
    objects = pages.select("doc_id", F.explode(F.concat(F.array(F.struct(at(0).alias("number"), page.alias("body"))), bodies)).alias("o")).select("doc_id", "o.number", "o.body")
    heads = pages.select("doc_id", "page_index", font.alias("font")).groupBy("doc_id").agg(F.array_sort(F.collect_list("page_index")).alias("pages"), F.max("font").alias("font"))
    kids = F.array_join(F.transform("pages", lambda i: F.format_string("%d 0 R", 10 + 20 * i)), " ")
    head = F.array(
        F.struct(F.lit(1).alias("number"), F.lit("<< /Type /Catalog /Pages 2 0 R >>").alias("body")),
        F.struct(F.lit(2).alias("number"), F.concat(F.lit("<< /Type /Pages /MediaBox [0 0 612 792] /Kids ["), kids, F.lit("] >>")).alias("body")),
        F.struct(F.lit(3).alias("number"), F.col("font").alias("body")),
    )
    out = objects.unionByName(heads.select("doc_id", F.explode(head).alias("o")).select("doc_id", "o.number", "o.body"))
    return out if more is None else out.unionByName(more)


def write_objects(objects: DataFrame) -> DataFrame:
    """doc_id and content (a PDF file) from the objects of each file (doc_id, number, body)."""
    import pyarrow as pa

    docs = spread(objects).groupBy("doc_id").agg(F.collect_list(F.struct("number", "body")).alias("objects"))  # one file's

    def emit(batches: Iterator) -> Iterator:
        for batch in batches:
            made = [build_pdf({o["number"]: o["body"].encode("latin-1", "replace") for o in own}) for own in batch.column("objects").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "content"])

    return docs.mapInArrow(emit, "doc_id string, content binary")
