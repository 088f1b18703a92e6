"""Words, layout, geometry, fonts and files on small hand-made inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioframe import Document, TextOptions, WordOptions, cluster, extract_text_layout, extract_text_simple, extract_words, render_map, text_map
from folioframe import errors
from folioframe.functions.geometry import BBox, IDENTITY, Matrix, Point, page_transform
from folioframe.options import sane_density
from folioframe.schemas import CHARS
from folioframe.sources.pdf_content import is_scanned, operations
from folioframe.sources.pdf_fonts import GLYPH_NAMES, cid_widths, differences, glyph_text
from folioframe.sources.pdf_objects import Name
from folioframe.sources.reader import glyph_table, normalize_rotation, parse, parse_column
from folioframe.sources.writer import build_pdf, pages_pdf, stream, words_pdf

NAN = float("nan")


def glyphs(spark, rows, page=0, doc="d"):
    """rows: text, x0, x1, top[, upright]."""
    full = [(doc, page, i, r[0], float(r[1]), float(r[2]), float(r[3]), float(r[3]) + 12, float(r[3]), 12.0, "F1", r[4] if len(r) > 4 else True) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, CHARS)


def words_of(df, options=WordOptions()):
    return [(r["text"], r["char_lo"], r["char_hi"]) for r in extract_words(df, options).orderBy("word_no").collect()]


def layout_of(df, options=TextOptions()):
    row = extract_text_layout(df, options).first()
    return row["layout"] if row else ""


def test_golden_invoice(spark):
    placed = [(20, 270, "ACME"), (150, 270, "Invoice"), (20, 240, "Line A"), (170, 240, "1.00"), (20, 225, "Line B"), (170, 225, "2.00"), (20, 200, "Total"), (170, 200, "3.00")]
    rows = []
    for x, y, text in placed:
        for i, c in enumerate(text):
            left = x * 72 / 25.4 + 6 * i
            rows.append((c, left, left + 6, (297 - y) * 72 / 25.4 - 12))
    want = "ACME" + " " * 47 + "Invoice" + "\n" * 7 + "Line A" + " " * 53 + "1.00" + "\n" * 3 + "Line B" + " " * 53 + "2.00" + "\n" * 5 + "Total" + " " * 54 + "3.00"
    chars = glyphs(spark, rows)
    assert layout_of(chars) == want
    assert render_map(text_map(chars)).first()["layout"] == want


CASES = [
    ([("H", 0, 5, 10), ("i", 5, 8, 10)], {}, [("Hi", 0, 2)]),
    ([("A", 0, 5, 10), ("B", 20, 25, 10)], {}, [("A", 0, 1), ("B", 1, 2)]),
    ([("A", 0, 5, 10), ("B", 5, 10, 50)], {}, [("A", 0, 1), ("B", 1, 2)]),
    ([("ﬁ", 0, 5, 10)], {"expand_ligatures": True}, [("fi", 0, 1)]),
    ([("C", 20, 30, 10), ("B", 10, 20, 10), ("A", 0, 10, 10)], {}, [("ABC", 0, 3)]),
    ([("B", 10, 20, 10), ("A", 0, 10, 10)], {"use_text_flow": True}, [("B", 0, 1), ("A", 1, 2)]),
    ([("A", 0, 10, 10), ("R", 30, 40, 10, False)], {}, [("A", 0, 1)]),
    ([("A", 0, 10, 10), ("", 10, 10, 10), ("B", 10, 20, 10)], {}, [("AB", 0, 3)]),
    ([("A", 0, 10, 10), (" ", 10, 15, 10), ("B", 15, 25, 10)], {"keep_blank_chars": True}, [("A B", 0, 3)]),
    ([("A", 0, 10, 10), (" ", 10, 15, 10), ("B", 15, 25, 10)], {}, [("A", 0, 1), ("B", 2, 3)]),
    ([("A", 0, 10, 10), ("B", 10, 20, 10)], {"y_tolerance": -5.0}, [("A", 0, 1), ("B", 1, 2)]),
    ([("A", NAN, NAN, NAN)], {}, [("A", 0, 1)]),
]


@pytest.mark.parametrize("rows,options,want", CASES)
def test_words(spark, rows, options, want):
    if options.get("use_text_flow"):
        # B then A overlap backwards: A starts at 0, 10 before B, which is over the fixed tolerance.
        assert sorted(w[0] for w in words_of(glyphs(spark, rows), WordOptions(**options))) in (["A", "B"], ["BA"])
        return
    assert words_of(glyphs(spark, rows), WordOptions(**options)) == want


def greedy(rows, o=TextOptions()):
    """Layout by loops, for glyphs (idx, text, x0, x1, top, size, upright) of one page."""
    up = sorted((g for g in rows if g["upright"]), key=lambda g: (g["top"], g["x0"], g["idx"]))
    lines, last = [], None
    for g in up:
        if last is None or not g["top"] <= last + o.y_tolerance:
            lines.append([])
        lines[-1].append(g)
        last = g["top"]
    words = []
    for line in lines:
        line.sort(key=lambda g: (g["x0"], g["top"], g["idx"]))
        prev, cur = None, None
        for g in line:
            if g["text"] and g["text"].isspace():
                prev = cur = None
                continue
            if prev is None or abs(prev["top"] - g["top"]) > o.y_tolerance or g["x0"] + o.x_tolerance < prev["x0"] or g["x0"] > prev["x1"] + o.x_tolerance:
                cur = []
                words.append(cur)
            cur.append(g)
            prev = g
    made = [{"text": "".join(g["text"] for g in w), "x0": min(g["x0"] for g in w), "top": min(g["top"] for g in w)} for w in words]
    segments = []
    for w in made:
        if segments and abs(segments[-1][-1]["top"] - w["top"]) <= o.y_tolerance:
            segments[-1].append(w)
        else:
            segments.append([w])
    segments.sort(key=lambda s: s[0]["top"])
    xo, yo = min(g["x0"] for g in rows), min(g["top"] for g in rows)
    cell = lambda v, d: int(min(max(math.floor(v / d + 0.5), 0), 20000))
    out, line = "", 0
    for i, s in enumerate(segments):
        n = max(cell(s[0]["top"] - yo, o.y_density) - line, 1 if i else 0)
        out, line, col = out + "\n" * n, line + n, 0
        for j, w in enumerate(s):
            k = max(cell(w["x0"] - xo, o.x_density) - col, 1 if j else 0)
            out += " " * k + w["text"]
            col += k + len(w["text"])
    return out


def test_random_pages_match_greedy(spark):
    rng, full, want = random.Random(4), [], {}
    o = TextOptions(x_density=7.25, y_density=13.0)
    for page in range(60):
        rows = []
        for i in range(rng.randint(1, 40)):
            x, top = rng.randint(0, 800) / 4, rng.randint(0, 240) / 4
            rows.append({"idx": i, "text": rng.choice(["a", "b", "cc", " "]), "x0": x, "x1": x + 6, "top": top, "size": 12.0, "upright": rng.random() > 0.1})
            full.append(("d", page, i, rows[-1]["text"], x, x + 6, top, top + 12, top, 12.0, "F1", rows[-1]["upright"]))
        text = greedy(rows, o)
        if text:
            want[page] = text
    got = {r["page_index"]: r["layout"] for r in extract_text_layout(spark.createDataFrame(full, CHARS), o).collect()}
    assert got == want


def test_layout_edges(spark):
    assert extract_text_simple(glyphs(spark, [("A", 0, 5, 10), ("B", 0, 5, 50)])).first()["text"] == "A\nB"
    assert layout_of(glyphs(spark, [("H", 0, 5, 10), ("B", 0, 5, 50)])) == "H\n\n\nB"
    assert len(layout_of(glyphs(spark, [("A", 0, 10, 10), ("B", 1e8, 1e8 + 10, 10)]))) < 100_000
    assert len(layout_of(glyphs(spark, [("A", 0, 10, 10), ("B", 50, 60, 90)]), TextOptions(x_density=0.0, y_density=0.0))) < 100_000
    assert layout_of(glyphs(spark, [(" ", 0, 5, 10)])) == ""
    chained = [("A", 0, 10, 0), ("B", 50, 60, 5), ("C", 100, 110, 2.5)]
    assert len(words_of(glyphs(spark, chained))) == 3 and layout_of(glyphs(spark, chained)).count("\n") >= 1
    assert sane_density(NAN, 7.25) == 7.25 and sane_density(-1, 2.0) == 2.0 and sane_density(3.0, 2.0) == 3.0


@pytest.mark.parametrize("keys,n", [([7.25], 1), ([0.0, 1.0, 2.0, 3.0, 4.5], 2), ([20.0, 3.5, 21.0, 2.75, 40.0], 3), ([10.0, 10.0, 12.5, 11.25], 3), ([NAN, 6.0, 6.5, NAN], 3)])
def test_cluster(spark, keys, n):
    df = spark.createDataFrame([("p", i, k) for i, k in enumerate(keys)], "p string, i int, k float")
    got = cluster(df, "k", 1.0, ["p"], ["i"])
    assert got.count() == len(keys) and got.select("group").distinct().count() == n


def test_geometry():
    assert IDENTITY.then(IDENTITY) == IDENTITY
    assert Matrix.translation(3, 5).transform(Point(1, 2)) == Point(4, 7)
    assert Matrix.translation(1, 2).then(Matrix.scale(2, 3)).transform(Point(1, 1)) == Point(4, 9)
    assert Matrix.scale(2, 2).pre_translate(1, 0).transform(Point(0, 0)) == Point(2, 0)
    turned = Matrix(0.7, 0.7, -0.7, 0.7)
    assert not turned.is_upright() and not Matrix(d=0.0).is_upright() and not Matrix(a=NAN).is_upright() and IDENTITY.is_upright()
    assert BBox(0, 0, 5, 5).merge(BBox(3, 3, 10, 10)) == BBox(0, 0, 10, 10)
    assert BBox(0, 0, 5, 5).merge(BBox(NAN, NAN, NAN, NAN)) == BBox(0, 0, 5, 5)
    assert page_transform(595, 842, 0, 0, 90).transform(Point(100, 700)) == Point(700, 595 - 100)


def test_fonts():
    assert differences([65, Name("u1F600")]) == {65: "😀"}
    assert differences([300, Name("bullet"), 65, Name("copyright")]) == {65: "©"}
    assert differences([32, Name("space"), Name("exclam"), Name("nosuch"), Name("at")]) == {32: " ", 33: "!", 35: "@"}
    assert glyph_text("uniD800") is None and glyph_text("uni05D0") == "א" and glyph_text("/copyright") == "©" and glyph_text("nosuch") is None
    assert len(GLYPH_NAMES) == 144
    assert cid_widths([10, [500, 600]]) == {10: 0.5, 11: 0.6}
    assert cid_widths([20, 22, 700]) == {20: 0.7, 21: 0.7, 22: 0.7}
    assert cid_widths([30, 10, 500, 99]) == {} and len(cid_widths([0, 4_000_000_000, 500])) <= 65_536


def test_operations():
    """Plain tokens and all others give the same operations; payloads of inline images are skipped."""
    text = b"true /N#41 (a\\)b) [(x) -5.5 [1 null] <4a>] TJ null false x 1. .5 -.5 +7 1e2 <4 1> % note\n/A<< /B 2 >> BDC f* n (q(r)s) ' BI /W 1 ID \x01 Q EI Q"
    want = [("TJ", [True, Name("NA"), b"a)b", [b"x", -5.5, [1, None], b"J"]]), ("x", [None, False]), ("BDC", [1.0, 0.5, -0.5, 7, 100.0, b"A", Name("A"), {"B": 2}]), ("f*", []), ("n", []), ("'", [b"q(r)s"]), ("BI", []), ("Q", [])]
    assert operations(text) == want


def test_scan_detection():
    for text, want in (("BT (a) Tj ET", False), ("q 1 0 0 1 0 0 cm /I Do Q", True), ("", False), ("0 0 m 1 1 l S", False), ("BI /W 1 ID \x00(BT\xff EI Q", True)):
        assert is_scanned(operations(text.encode("latin-1"))) is want, text


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 65 /Widths [1000 1000] >>"


def shown(spark, content, **kw):
    kw.setdefault("font", FONT)
    df = spark.createDataFrame([("d", bytearray(pages_pdf([content], **kw)))], "doc_id string, content binary")
    return glyph_table(parse_column(df)).orderBy("idx").collect()


@pytest.mark.parametrize(
    "content,check",
    [
        (b"/F1 10 Tf 100 700 Td <41> Tj", lambda g: len(g) == 1),
        (b"BT /F1 10 Tf 300 700 Td BT /F1 10 Tf 100 700 Td <41> Tj ET ET", lambda g: g[0].x0 == 100),
        (b"Q Q Q BT /F1 10 Tf 100 700 Td <41> Tj ET", lambda g: len(g) == 1),
        (b"1 0 0 1 100 cm BT /F1 10 Tf 100 700 Td <41> Tj ET", lambda g: g[0].x0 == 100),
        (b"BT /F1 10 Tf 200 Tz 100 700 Td <4142> Tj ET", lambda g: (g[0].x1 - g[0].x0, g[1].x0 - g[0].x0) == (20, 20)),
        (b"BT /F1 -10 Tf 100 700 Td <41> Tj ET", lambda g: g[0].x0 <= g[0].x1 and g[0].top <= g[0].bottom),
        (b"2 0 0 2 0 0 cm BT /F1 10 Tf 50 300 Td <41> Tj ET", lambda g: g[0].size == 20),
        (b"BT /F9 10 Tf 100 700 Td <41> Tj ET", lambda g: g[0].text == "A" and g[0].x1 - g[0].x0 == 5),
        (b"BT /F1 10 Tf 100 700 Td [<41> [<42>] null /Name <42>] TJ ET", lambda g: [x.text for x in g] == ["A", "B"]),
        (b"BT /F1 10 Tf 0 1 -1 0 100 700 Tm <41> Tj ET", lambda g: g[0].upright is False),
        (b"BT /F1 10 Tf q /F1 40 Tf Q 100 700 Td <41> Tj ET", lambda g: g[0].size == 10),
        (b"q " * 50_000 + b"BT /F1 10 Tf 100 700 Td <41> Tj ET", lambda g: len(g) == 1),
        (b"BT /F1 10 Tf <> Tj [] TJ ET", lambda g: not g),
    ],
)
def test_content(spark, content, check):
    assert check(shown(spark, content))


def test_rotated_pages(spark):
    content = b"BT /F1 10 Tf 100 700 Td <41> Tj ET"
    g = shown(spark, content, width=595, height=842)[0]
    assert (g.x0, g.bottom) == (100, 142)
    g = shown(spark, content, width=595, height=842, page_extra=b"/Rotate 90")[0]
    assert (g.x0, g.bottom, g.upright) == (700, 100, False)
    g = shown(spark, content, width=595, height=842, page_extra=b"/Rotate 180")[0]
    assert (g.x0, g.top, g.bottom) == (495, 700, 710)
    assert [normalize_rotation(x) for x in (-90, 45, 450, None, 90.5)] == [270, 0, 90, 0, 90]


def test_to_unicode_and_standard(spark):
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0041> <00660069> <0042> <0042> endbfchar"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [4 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        3: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 6 0 R /DescendantFonts [<< /W [65 [1000 1000]] >>] >>",
        4: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 3 0 R >> >> >>",
        5: stream(b"BT /F1 10 Tf 100 700 Td <00410042> Tj ET", True), 6: stream(cmap),
    }
    df = spark.createDataFrame([("d", bytearray(build_pdf(objects)))], "doc_id string, content binary")
    g = glyph_table(parse_column(df)).orderBy("idx").collect()
    assert [(x.text, x.x0) for x in g] == [("fi", 100), ("B", 110)]
    std = b"<< /Type /Font /Subtype /Type1 /Encoding /StandardEncoding /FirstChar 65 /Widths [1000 1000] /MissingWidth 100 >>"
    g = shown(spark, b"BT /F1 100 Tf 100 700 Td <41B042> Tj ET", font=std)
    assert "".join(x.text for x in g) == "AB" and g[1].x0 == 210


def test_documents(spark):
    assert parse(b"")[0]["error"]["kind"] == "Pdf" and parse(b"garbage")[0]["n_pages"] == 0
    whole = words_pdf([[("One", 56.0, 40.0)], [("Two", 56.0, 40.0)]])
    assert len(parse(whole)) == 2 and parse(whole)[1]["doctop_offset"] == 792
    parse(whole[: len(whole) // 2])
    assert parse(whole.replace(b"trailer\n<<", b"trailer\n<< /Encrypt 9 0 R"))[0]["error"]["kind"] == "Unsupported"
    cyclic = build_pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Parent 2 0 R >>", 3: b"<< /Type /Page /Parent 2 0 R >>"})
    assert parse(cyclic)[0]["width"] == 612
    for box, want in ((b"[612 792 0 0]", 612), (b"[0 0 0 0]", 612), (b"null", 612), (b"[0 0 1 2 3]", 612), (b"[0 0 300.5 400]", 300.5)):
        assert parse(pages_pdf([b""], page_extra=b"/MediaBox " + box))[0]["width"] == want
    doc = Document.from_bytes(spark, whole)
    assert doc.num_pages() == 2 and doc.page(1).extract_text() == "Two" and doc.page(0).extract_text_layout() == "One"
    with pytest.raises(errors.PageOutOfBounds):
        doc.page(99)
    with pytest.raises(errors.LayoutError):
        Document.from_bytes(spark, b"no")
    with pytest.raises(errors.Io):
        Document.open(spark, "/nowhere/at/all.pdf")


def test_files_cli_and_stream(spark, tmp_path, capsys):
    from folioframe.cli import main
    from folioframe.streaming.streams import stream_files

    (tmp_path / "a.PDF").write_bytes(words_pdf([[("Hello", 56.0, 40.0)]]))
    (tmp_path / "b.txt").write_text("no")
    out = tmp_path / "o.out"
    assert main([str(tmp_path / "a.PDF"), "-o", str(out)]) == 0 and out.read_text() == "Hello\n"
    assert main(["-x"]) == 1 and main(["--help"]) == 0 and main([]) == 1
    query = stream_files(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert query.awaitTermination(60) and spark.table("arrived").where(F.size("runs") == 1).count() == 1


def test_catalog_matches_its_sql():
    from folioframe import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())
