"""PDF files as tables: parsing in Arrow workers, one row for each page; everything after it in Catalyst."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContentStream, LayoutError, Pdf
from ..functions import geometry as G
from ..functions.numbers import f32
from ..operators import paged
from ..schemas import PAGE
from .pdf_content import TextMachine, is_scanned, line_runs, operations, simple_runs
from .pdf_fonts import Font
from .pdf_objects import File, Ref, Stream

#: A shown string: its glyphs with their widths (em) and starts (text space), the number of the first glyph on the page, and its state.
_RUN = "struct<texts:array<string>,widths:array<float>,starts:array<double>,first:int,m:struct<a:double,b:double,c:double,d:double,e:double,f:double>,font:string,size:double,th:double,rise:double>"
PARSED = f"doc_id string, page_index int, width float, height float, rotation smallint, doctop_offset float, is_scanned boolean, error struct<kind:string,page:int,reason:string>, n_pages int, ms double, runs array<{_RUN}>"
#: Glyphs and runs that a worker holds before it hands them on.
BATCH = 200_000
#: Bytes of content streams that a worker reads at a time by columns (a page is never cut).
CONTENT = 1_000_000
LETTER = (612.0, 792.0)


def normalize_rotation(value) -> int:
    """0, 90, 180 or 270; anything else is 0."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return 0
    turn = int(value) % 360
    return turn if turn % 90 == 0 else 0


def page_metrics(file: File, page: dict) -> tuple[float, float, float, float, int]:
    """Media width and height, origin, rotation; all of the default if any part of the box is bad."""
    try:
        box = file.inherited(page, "MediaBox")
        box = [file.deref(v) for v in box] if isinstance(box, list) else None
        if box is None or len(box) != 4 or not all(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) for v in box):
            raise Pdf("bad media box")
        w, h = abs(box[2] - box[0]), abs(box[3] - box[1])
        if w == 0 or h == 0:
            raise Pdf("empty media box")
        return w, h, min(box[0], box[2]), min(box[1], box[3]), normalize_rotation(file.inherited(page, "Rotate"))
    except LayoutError:
        return (*LETTER, 0.0, 0.0, 0)


def _content(file: File, page: dict) -> bytes:
    found = file.deref(page.get("Contents"))
    parts = found if isinstance(found, list) else [found]
    return b"\n".join(file.decoded(s) for s in map(file.deref, parts) if isinstance(s, Stream))


def _fonts(file: File, page: dict, known: dict[int, Font]) -> dict[str, Font]:
    """Fonts of a page by name; each font object of a file is read once."""
    resources = file.inherited(page, "Resources")
    fonts = file.deref(resources.get("Font")) if isinstance(resources, dict) else None
    out = {}
    for name, info in (fonts if isinstance(fonts, dict) else {}).items():
        info = file.deref(info)
        if isinstance(info, dict):
            if id(info) not in known:
                known[id(info)] = Font(file, info)
            out[name] = known[id(info)]
    return out


_BAD = (LayoutError, RecursionError, ValueError, TypeError, KeyError, IndexError, OverflowError)


def _walk(row: dict) -> None:
    """Runs of a page from its content stream, which goes."""
    content, fonts, page_map = row.pop("content"), row.pop("fonts"), G.page_transform(*row.pop("box"))
    if (runs := simple_runs(content, fonts, page_map)) is not None:
        row["is_scanned"], row["runs"] = False, runs
        return
    ops = operations(content)
    row["is_scanned"] = is_scanned(ops)
    machine = TextMachine(fonts, page_map)
    for op, args in ops:
        machine.step(op, args)
    row["runs"] = machine.runs


def _rows(data: bytes, pages: list[int] | None, need: str) -> Iterator[dict]:
    """Rows of the pages; ``need`` "content" keeps the content streams with their fonts and boxes for ``_walk``."""
    blank = dict.fromkeys(("page_index", "width", "height", "rotation", "doctop_offset", "is_scanned", "error", "n_pages", "ms"))
    began = time.perf_counter()
    try:
        file = File(data)
        tree = file.pages()
    except LayoutError as e:
        yield blank | {"error": e.struct(), "n_pages": 0, "runs": [], "ms": (time.perf_counter() - began) * 1000}
        return
    except (RecursionError, ValueError, TypeError, KeyError, IndexError) as e:
        yield blank | {"error": Pdf(repr(e)).struct(), "n_pages": 0, "runs": [], "ms": (time.perf_counter() - began) * 1000}
        return
    offset, known, metrics = 0.0, {}, {}
    for i, page in enumerate(tree):
        parent = page.get("Parent")
        if isinstance(parent, Ref) and "MediaBox" not in page and "Rotate" not in page:  # those of the node above
            if parent.number not in metrics:
                metrics[parent.number] = page_metrics(file, page)
            w, h, ox, oy, turn = metrics[parent.number]
        else:
            w, h, ox, oy, turn = page_metrics(file, page)
        shown = (h, w) if turn in (90, 270) else (w, h)
        row = blank | {"page_index": i, "width": shown[0], "height": shown[1], "rotation": turn, "doctop_offset": offset, "n_pages": len(tree), "runs": []}
        offset += shown[1]
        if pages is not None and i not in pages:
            continue
        try:
            content = _content(file, page)
            if need == "pages":
                row["is_scanned"] = is_scanned(operations(content))
            else:
                row["content"], row["fonts"], row["box"] = content, _fonts(file, page, known), (w, h, ox, oy, turn)
                if need == "chars":
                    _walk(row)
        except _BAD as e:
            row["error"] = ContentStream(i, f"decode content: {e}").struct()
        row["ms"] = (time.perf_counter() - began) * 1000
        yield row
        began = time.perf_counter()
    if not tree:
        yield blank | {"n_pages": 0, "runs": [], "ms": (time.perf_counter() - began) * 1000}


def parse(data: bytes, pages: list[int] | None = None, need: str = "chars") -> list[dict]:
    """Rows of the pages of a file; a file that cannot be read is one row with an error.

    ``pages`` limits the work to some page numbers; ``need`` "pages" leaves out the glyph runs. ``ms`` is the
    time spent on the row, that of reading the file's objects included in the first.
    """
    return list(_rows(data, pages, need))


def _batch(ids: list, rows: list[dict], schema):
    """Rows of pages as an Arrow batch, column by column."""
    import pyarrow as pa

    runs = [x for r in rows for x in r["runs"]]
    first = []
    for r in rows:
        n = 0
        for x in r["runs"]:
            first.append(n)
            n += len(x[0])
    run_type = schema.field("runs").type
    kinds = {f.name: f.type for f in run_type.value_type}
    ends = pa.array(np.append(0, np.cumsum([len(x[0]) for x in runs])).astype(np.int32))

    def lists(k: int, name: str):
        return pa.ListArray.from_arrays(ends, pa.array(chain.from_iterable(x[k] for x in runs), kinds[name].value_type), type=kinds[name])

    m = np.array([x[3] for x in runs], np.float64).reshape(-1, 6)
    matrix = pa.StructArray.from_arrays([pa.array(m[:, k]) for k in range(6)], fields=list(kinds["m"]))
    parts = [lists(0, "texts"), lists(1, "widths"), lists(2, "starts"), pa.array(first, pa.int32()), matrix, pa.array([x[4] for x in runs], pa.string()), *(pa.array([x[k] for x in runs], pa.float64()) for k in (5, 6, 7))]
    flat = pa.StructArray.from_arrays(parts, fields=list(run_type.value_type))
    own = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r["runs"]) for r in rows])).astype(np.int32)), flat, type=run_type)
    names = schema.names[1:-1]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *(pa.array([r[n] for r in rows], schema.field(n).type) for n in names), own], schema=schema)


def parse_column(docs: DataFrame, content: str = "content", doc_id: str = "doc_id", pages: list[int] | None = None, need: str = "chars") -> DataFrame:
    """One row for each page of the files in a binary column (schema PARSED)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def emit(batches: Iterator) -> Iterator:
        ids, rows, held = [], [], 0
        for batch in batches:
            for doc, data in zip(batch.column("_d").to_pylist(), batch.column("_c"), strict=True):
                for row in _rows(data.as_py() or b"", pages, need):
                    ids.append(doc)
                    rows.append(row)
                    held += 50 + sum(len(x[0]) for x in row["runs"])
                    if held > BATCH:
                        yield _batch(ids, rows, schema)
                        ids, rows, held = [], [], 0
        if rows:
            yield _batch(ids, rows, schema)

    return docs.select(F.col(doc_id).cast("string").alias("_d"), F.col(content).alias("_c")).mapInArrow(emit, PARSED)


def glyph_columns(rows: list[dict], ids: list) -> tuple[paged.Glyphs, np.ndarray, np.ndarray, np.ndarray]:
    """Glyphs of the rows of pages, with their runs, the runs' font names and sizes: ``glyph_table`` by columns."""
    runs = [x for r in rows for x in r["runs"]]
    counts = np.array([len(x[0]) for x in runs], np.int64)
    total = int(counts.sum())
    texts = [x[0] if isinstance(x[0], str) else "".join(x[0]) for x in runs]
    text = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    n = None if len(text) == total and all(len(t) == c for t, c in zip(texts, counts.tolist(), strict=True)) else np.array([len(t) for x in runs for t in x[0]], np.int64)
    m = np.array([x[3] for x in runs], np.float64).reshape(-1, 6)
    size, th, rise = (np.array([x[k] for x in runs], np.float64) for k in (5, 6, 7))
    widths = np.fromiter(chain.from_iterable(x[1] for x in runs), np.float32, total).astype(np.float64)
    starts = np.fromiter(chain.from_iterable(x[2] for x in runs), np.float64, total)
    own = np.repeat(np.arange(len(rows)), [len(r["runs"]) for r in rows])
    run = np.repeat(np.arange(len(runs)), counts)
    f = lambda v: v.astype(np.float32)
    a, b, c, d, e, g = m.T
    with np.errstate(all="ignore"):
        sx, sy = f(np.sqrt(a * a + b * b)), f(np.sqrt(c * c + d * d))
        ox = f(a[run] * starts + (c * rise)[run] + e[run])
        oy = f(b[run] * starts + (d * rise)[run] + g[run])
        uy = f(b[run] * starts + (d * (rise + size))[run] + g[run])
        right = f(ox + widths * size[run] * th[run] * sx[run])
        height = np.array([r["height"] for r in rows], np.float32)[own][run]
        one, two = height - uy, height - oy
        most = np.maximum(sx, sy)
        known = np.isfinite(most) & (most > np.float32(1e-6)) & (d != 0)
        safe = np.where(known, most, np.float32(1))
        upright = known & (f(np.abs(b) / safe) < np.float32(0.01)) & (f(np.abs(c) / safe) < np.float32(0.01)) & (a > 0)
        size = f(size * most)
    page = own[run]
    heads = np.flatnonzero(paged._firsts(page))
    idx = np.arange(len(page)) - np.repeat(heads, np.diff(np.append(heads, len(page))))
    index = np.array([r["page_index"] if r["page_index"] is not None else -1 for r in rows])
    glyphs = paged.Glyphs(ids, index, page, idx, text, n, np.fmin(ox, right), np.maximum(ox, right), np.fmin(one, two), np.maximum(one, two), size[run], upright[run])
    return glyphs, run, np.array([x[4] for x in runs], object), size


def line_columns(rows: list[dict], ids: list) -> tuple[list[int], tuple | None]:
    """``glyph_columns`` of those rows (with content, fonts and box) whose streams consist of lines of the usual kinds and
    whose fonts are plain, all pages together by columns; and the numbers of the other rows."""
    shown = [i for i, r in enumerate(rows) if "content" in r]
    good, runs = line_runs([rows[i]["content"] for i in shown])
    maps = {}
    for j, i in enumerate(shown):
        box = rows[i]["box"]
        if box not in maps:
            p = G.page_transform(*box)
            maps[box] = (p.e, p.f) if (p.a, p.b, p.c, p.d) == (1.0, 0.0, 0.0, 1.0) else None
        good[j] &= maps[box] is not None
    if runs is None or not len(runs.page) or not good.any():
        return shown, None
    # The fonts of each page by name.
    names, sizes = zip(*((u[1:].rpartition(" ")[0], float(u.rpartition(" ")[2])) for u in [*runs.uses, "/ 1"]), strict=True)
    plain = Font()
    pairs, pair = np.unique(runs.page * len(names) + runs.use % len(names), return_inverse=True)
    defaults = np.zeros(len(pairs))
    for k, (j, u) in enumerate(zip(*(v.tolist() for v in np.divmod(pairs, len(names))), strict=True)):
        font = (names[u] and rows[shown[j]]["fonts"].get(names[u])) or plain
        if font.plain():
            defaults[k] = font.default
        else:
            good[j] = False
    others = [i for i, ok in zip(shown, good.tolist(), strict=True) if not ok]
    use, default = runs.use % len(names), defaults[pair]
    size = np.array(sizes)[use]
    counts = np.diff(np.frombuffer(runs.text.buffers()[1], np.int32)[runs.text.offset :][: len(runs.text) + 1]).astype(np.int64)
    # Starts of glyphs are sums in turn, as the walk makes them: a row of sums for each width and size.
    steps, step = np.unique(default + 1j * size, return_inverse=True)
    longest = np.zeros(len(steps), np.int64)
    np.maximum.at(longest, step, counts)
    sums = [np.append(0.0, np.cumsum(np.full(n, s.real * s.imag))) for s, n in zip(steps, longest.tolist(), strict=True)]
    base = np.cumsum(longest + 1) - (longest + 1)
    sums = np.concatenate(sums) if sums else np.zeros(0)
    dx, dy = (np.array([maps[rows[i]["box"]][k] if maps[rows[i]["box"]] else 0.0 for i in shown])[runs.page] for k in (0, 1))
    second = np.flatnonzero(runs.after >= 0)
    x = runs.x + dx
    first = runs.after[second]
    x[second] = sums[base[step[first]] + counts[first]] - runs.shift[second] / 1000 * size[second] + x[second]
    y = runs.y + dy
    if not (np.isfinite(sums).all() and np.isfinite(x).all() and np.isfinite(y).all()):
        return shown, None
    keep = np.flatnonzero(good[runs.page] & (counts > 0))
    text = np.frombuffer(runs.text.buffers()[2] or b"", np.uint8)
    if len(keep) < len(counts):
        text = text[paged._ranges((np.cumsum(counts) - counts)[keep], counts[keep])]
    n, x, y, size, own = counts[keep], x[keep], y[keep], size[keep], np.array(shown)[runs.page[keep]]
    text = text[: n.sum()].astype(np.uint32)
    at = np.cumsum(n) - n
    starts = sums[np.arange(len(text)) + np.repeat(base[step[keep]] - at, n)]
    # ``glyph_columns`` where the matrix is (1, 0, 0, 1, x, y), without horizontal scale and rise.
    f = lambda v: v.astype(np.float32)
    ox = f(starts + np.repeat(x, n))
    right = f(ox + np.repeat(default[keep].astype(np.float32).astype(np.float64) * size, n))
    height = np.array([rows[i]["height"] for i in shown], np.float32)[runs.page[keep]]
    one, two = height - f(size + y), height - f(y)
    heads = np.flatnonzero(paged._firsts(own))
    idx = np.arange(len(text)) - np.repeat(at[heads], np.add.reduceat(n, heads) if len(heads) else 0)
    index = np.array([-1 if r["page_index"] is None else r["page_index"] for r in rows])
    size = f(size)
    spread = lambda v: np.repeat(v, n)
    glyphs = paged.Glyphs(ids, index, spread(own), idx, text, None, np.fmin(ox, right), np.maximum(ox, right), spread(np.fmin(one, two)), spread(np.maximum(one, two)), spread(size), np.ones(len(text), bool))
    return others, (glyphs, spread(np.arange(len(keep))), np.array(names, object)[use[keep]], size)


def _page_columns(batches: Iterator) -> Iterator[tuple]:
    """``glyph_columns`` of the pages of files (doc_id, content), up to CONTENT bytes of content streams at a time."""

    def columns(rows: list[dict], ids: list) -> Iterator[tuple]:
        others, got = line_columns(rows, ids)
        if got is not None:
            yield got
        rest, rest_ids, held = [], [], 0
        for i in others:
            try:
                _walk(rows[i])
            except _BAD as e:
                rows[i]["error"] = ContentStream(rows[i]["page_index"], f"decode content: {e}").struct()
                continue
            rest.append(rows[i])
            rest_ids.append(ids[i])
            held += 50 + sum(len(x[0]) for x in rows[i]["runs"])
            if held > BATCH:
                yield glyph_columns(rest, rest_ids)
                rest, rest_ids, held = [], [], 0
        if rest:
            yield glyph_columns(rest, rest_ids)

    ids, rows, held = [], [], 0
    for batch in batches:
        for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for row in _rows(data.as_py() or b"", None, "content"):
                ids.append(doc)
                rows.append(row)
                held += 50 + len(row.get("content", b""))
                if held > CONTENT:
                    yield from columns(rows, ids)
                    ids, rows, held = [], [], 0
    if rows:
        yield from columns(rows, ids)


def file_glyphs(batches: Iterator) -> Iterator[paged.Glyphs]:
    """Glyphs by whole pages, a source of ``paged_words`` and ``paged_layout``, from rows of files (doc_id, content)."""
    for columns in _page_columns(batches):
        yield columns[0]


def parse_glyphs(docs: DataFrame) -> DataFrame:
    """``glyph_table(parse_column(docs))`` without idx, x1, bottom and doctop, made in the worker."""
    import pyarrow as pa

    def emit(batches: Iterator) -> Iterator:
        for g, run, fonts, _ in _page_columns(batches):
            n = np.ones(len(g.page), np.int64) if g.n is None else g.n
            text = paged._strings(*paged._utf8(g.text, n))
            columns = [pa.array(g.doc_ids, pa.string()).take(pa.array(g.page)), pa.array(g.page_indexes[g.page].astype(np.int32)), text, pa.array(g.x0), pa.array(g.top), pa.array(g.size), pa.array(fonts, pa.string()).take(pa.array(run)), pa.array(g.upright)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "page_index", "text", "x0", "top", "size", "fontname", "upright"])

    return docs.select("doc_id", "content").mapInArrow(emit, "doc_id string, page_index int, text string, x0 float, top float, size float, fontname string, upright boolean")


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """doc_id (path), content and length of the PDF files at a path or in a folder."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]")
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(path).select(F.col("path").alias("doc_id"), "content", "length")


def read_pdfs(spark: SparkSession, path: str, recursive: bool = False, pages: list[int] | None = None, need: str = "chars") -> DataFrame:
    return parse_column(read_files(spark, path, recursive), pages=pages, need=need)


def pages_table(parsed: DataFrame) -> DataFrame:
    return parsed.where("page_index is not null").select(*PAGE, "width", "height", "rotation", "doctop_offset", "is_scanned", "error")


def raise_errors(parsed: DataFrame) -> DataFrame:
    """Strict mode: fail the job at the first row with an error."""
    told = F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("error.reason")).isNull())
    return parsed.where(told)


def glyph_table(parsed: DataFrame) -> DataFrame:
    """Glyphs from runs: boxes by affine columns, row by row, without a shuffle."""
    runs = parsed.select(*PAGE, "height", "doctop_offset", F.explode("runs").alias("r"))
    codes = runs.select(*PAGE, "height", "doctop_offset", "r", F.posexplode(F.arrays_zip("r.texts", "r.widths", "r.starts")).alias("_k", "z"))
    r, z, m = F.col("r"), F.col("z"), F.col("r.m")
    a = z["starts"]
    ox = f32(m["a"] * a + m["c"] * r["rise"] + m["e"])
    oy = f32(m["b"] * a + m["d"] * r["rise"] + m["f"])
    uy = f32(m["b"] * a + m["d"] * (r["rise"] + r["size"]) + m["f"])
    sx, sy = G.x_scale(m), G.y_scale(m)
    right = f32(ox + z["widths"] * r["size"] * r["th"] * sx)
    one, two = f32(F.col("height") - uy), f32(F.col("height") - oy)
    glyphs = codes.select(
        *PAGE,
        (r["first"] + F.col("_k")).alias("idx"),
        z["texts"].alias("text"),
        F.least(ox, right).alias("x0"),
        F.greatest(ox, right).alias("x1"),
        F.least(one, two).alias("top"),
        F.greatest(one, two).alias("bottom"),
        f32(r["size"] * F.greatest(sy, sx)).alias("size"),
        r["font"].alias("fontname"),
        G.is_upright(m).alias("upright"),
        "doctop_offset",
    )
    return glyphs.select(*PAGE, "idx", "text", "x0", "x1", "top", "bottom", f32(F.col("top") + F.col("doctop_offset")).alias("doctop"), "size", "fontname", "upright")


def udtf_pdf_pages():
    """A table function for SQL: ``spark.udtf.register("pdf_pages", udtf_pdf_pages())``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="page_index int, width float, height float, rotation int, is_scanned boolean, n_runs int, error string")
    class PdfPages:
        def eval(self, content: bytes):
            for r in parse(content or b""):
                yield r["page_index"], r["width"], r["height"], r["rotation"], r["is_scanned"], len(r["runs"]), (r["error"] or {}).get("reason")

    return PdfPages
