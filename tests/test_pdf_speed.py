"""Quick reading of plain content streams and dictionaries against the general walk."""

import inspect
import random

import pytest

from folioframe.functions.geometry import page_transform
from folioframe.plans import document_queries
from folioframe.sources import pdf_content, pdf_objects, reader
from folioframe.sources.pdf_fonts import Font
from folioframe.sources.pdf_objects import Lexer, Name
from folioframe.sources.reader import file_glyphs, glyph_columns, glyph_table, parse, parse_column
from folioframe.sources.writer import pages_pdf, words_pdf, words_streams

WINANSI = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


class _NoFile:
    deref = staticmethod(lambda v: v)


def walked(data, fonts, page_map):
    machine = pdf_content.TextMachine(fonts, page_map)
    for op, args in pdf_content.operations(data):
        machine.step(op, args)
    return [("".join(r[0]), *r[1:]) for r in machine.runs]


def test_simple_runs_equal_walk():
    rng = random.Random(3)
    fonts = {"F1": Font(_NoFile, {"Subtype": "Type1", "Encoding": "WinAnsiEncoding"})}
    for page_map in (page_transform(612, 792, 0, 0, 0), page_transform(612, 792, 7.25, -3.5, 0)):
        for _ in range(40):
            out = [b"BT", b"/F1 %g Tf" % rng.choice([12, 7.3])] if rng.random() < 0.8 else [b"BT"]
            for _ in range(rng.randrange(6)):
                x, y, t = rng.random() * 600, rng.random() * 700, b"ab1 .'"[: rng.randrange(7)]
                out.append(rng.choice([b"1 0 0 1 %g %g Tm (%b) Tj" % (x, y, t), b"ET q 1 0 0 1 %g %g cm BT /F1 9.5 Tf [(%b) %g (xy)] TJ ET Q BT /F2 12 Tf" % (x, y, t, rng.choice([0, -120.5, 33]))]))
            data = b"\n".join([*out, b"ET"])
            got = pdf_content.simple_runs(data, fonts, page_map)
            assert got is not None
            assert [tuple(map(str, r)) for r in got] == [tuple(map(str, (*r[:4], *r[4:]))) for r in walked(data, fonts, page_map)]


@pytest.mark.parametrize("data", [b"51 0 0 1 5 5 Tm (a) Tj", b"1 0 0 1 5 5 Tm (a\\)) Tj", b"1 0 0 1 5 5 Tm (a) Tjx", b"2 Tc 1 0 0 1 5 5 Tm (a) Tj", b"1 0 0 1 5 5 Tm (\xe9) Tj", b"/Im1 Do", b"1 0 0 1 5 5 cm", b"% 1 0 0 1 5 5 Tm (a) Tj", b"BI ID x EI"])
def test_other_streams_are_walked(data):
    fonts = {"F1": Font(_NoFile, {"Subtype": "Type1", "Encoding": "WinAnsiEncoding"})}
    assert pdf_content.simple_runs(data, fonts, page_transform(612, 792, 0, 0, 0)) is None


def test_plain_dictionaries_are_those_of_the_lexer():
    for raw in (b"<< /A [1 0 R 2.5 /N] /B << /C << /D null >> >> >>", b"<<>>", b"<< /K true /L -3 >>"):
        for _ in range(2):
            assert pdf_objects._plain_dict(b" " + raw + b" endobj", 0) == (Lexer(raw).next(), len(raw) + 1)
    for raw in (b"<< /A (s) >>", b"<< /A <00> >>", b"<< /A 1 % >>\n >>", b"<< /A", b"<< endobj >>", b"[1]"):
        assert pdf_objects._plain_dict(raw, 0) is None
    assert isinstance(pdf_objects._plain_dict(b"<< /A /N >>", 0)[0]["A"], Name)


def test_glyph_columns_equal_glyph_table(spark):
    """Turned and scaled text, ligatures of several letters, codes without text, broken files."""
    odd = b"BT /F1 12 Tf 0.5 0.2 -0.3 2 50 60 Tm (ab\\(c) Tj 3 Ts 50 Tz (up) Tj 1 0 0 1 9 9 Tm [(x) -300 (\x01y\x80)] TJ ET"
    cmap = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /Differences [97 /ffi /nope] >> >>"
    files = [("a", words_pdf([[("one", 10, 20), ("two", 50, 20)]] * 3)), ("b", pages_pdf([odd, b""], font=cmap, page_extra=b"/Rotate 90")), ("c", b"junk"), ("d", pages_pdf([odd], font=WINANSI))]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in files], "doc_id string, content binary")
    want = {(r.doc_id, r.page_index, r.idx): r for r in glyph_table(parse_column(df)).collect()}
    seen = 0
    for name, content in files:
        rows = parse(content)
        g, run, fonts, _ = glyph_columns(rows, [name] * len(rows))
        at = 0
        for i in range(len(g.page)):
            r = want[name, g.page_indexes[g.page[i]], g.idx[i]]
            n = 1 if g.n is None else g.n[i]
            assert "".join(map(chr, g.text[at : at + n])) == r.text
            at += n
            assert [float(v[i]) for v in (g.x0, g.x1, g.top, g.bottom, g.size)] == [r.x0, r.x1, r.top, r.bottom, r.size]
            assert (bool(g.upright[i]), fonts[run[i]]) == (r.upright, r.fontname)
            seen += 1
    assert seen == len(want) > 20


def test_roundtrips_keep_glyphs_in_workers(spark, tmp_path):
    """One exchange by document after the join; no glyph is shuffled or exploded in the JVM."""
    spark.sql("select 1L o_orderkey, 2L o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select 1L l_orderkey, 3L l_partkey, 4L l_suppkey, 1 l_linenumber, 5D l_quantity, 6.5D l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    for query in (document_queries.pdf_roundtrip_chars, document_queries.pdf_roundtrip_layout):
        df = query(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan and df.count() > 0
    assert inspect.isgeneratorfunction(file_glyphs)


def _glyph_rows(columns):
    """Glyphs of ``glyph_columns`` as tuples, by page."""
    out = []
    for g, run, fonts, size in columns:
        n = [1] * len(g.page) if g.n is None else g.n.tolist()
        at = 0
        for i, k in enumerate(n):
            out.append((g.doc_ids[g.page[i]], int(g.page_indexes[g.page[i]]), int(g.idx[i]), g.text[at : at + k].tolist(), *(float(v[i]) for v in (g.x0, g.x1, g.top, g.bottom, g.size)), bool(g.upright[i]), fonts[run[i]], float(size[run[i]])))
            at += k
    return sorted(out)


@pytest.mark.parametrize("limit", [200, 1_000_000])
def test_lines_of_many_pages_equal_pages_alone(limit, monkeypatch):
    """Streams of usual lines, streams with one other line, fonts with widths, unset fonts, boxes off the origin, broken files."""
    import pyarrow as pa

    rng = random.Random(9)

    def line():
        x, y, t = (rng.choice([b"%d", b"-%.2f", b"%.3f"]) % rng.randrange(600) for _ in range(3))
        t = rng.choice([t, b"", b"a b!", b"~[x]'"])
        return rng.choice([b"1 0 0 1 %b %b Tm (%b) Tj" % (x, y, t), b"ET q 1 0 0 1 %b %b cm BT /F1 9.7 Tf [(%b) %b (xy)] TJ ET Q BT /F2 12 Tf" % (x, y, t, rng.choice([b"0", b"-120.5", b"33"])), b"BT", b"ET", b"/F1 7.3 Tf", b"BT /F3 8 Tf", b""])

    odd = [b"2 Tc", b"1 0 0 1 +5 5 Tm (p) Tj", b"1 0 0 1 5 5 Tm (\\() Tj", b"1 0 0 1 5 5 Tm (\xe9) Tj", b"1 0 0 1 5 5  Tm (w) Tj", b"1 0 0 1 9%b 5 Tm (far) Tj" % (b"9" * 400), b"% x", b"/Im1 Do", b"1 0 0 1 5 5 Tm (a\nb) Tj"]
    files = []
    for i in range(60):
        pages = [b"\n".join([line() for _ in range(rng.randrange(12))] + ([rng.choice(odd)] if rng.random() < 0.3 else []) + [line()]) for _ in range(rng.randrange(1, 5))]
        font = b"<< /Type /Font /Subtype /Type1 /FirstChar 97 /Widths [700 300] >>" if i % 5 == 0 else WINANSI if i % 2 else None
        files.append((f"d{i}", pages_pdf(pages, font=font, page_extra=[b"", b"/Rotate 90", b"/MediaBox [10 -20 300 500]"][i % 3], flate=i % 2 == 0)))
    files += [("words", words_pdf([[("one", 10, 20), ("two", 50.5, 20)]] * 3)), ("junk", b"junk"), ("null", None), ("bare", pages_pdf([b"", b"BT\nET"]))]
    want = _glyph_rows(glyph_columns(rows, [name] * len(rows)) for name, content in files for rows in [parse(content or b"")])
    monkeypatch.setattr(reader, "CONTENT", limit)
    batch = pa.RecordBatch.from_arrays([pa.array([n for n, _ in files]), pa.array([c for _, c in files], pa.binary())], names=["doc_id", "content"])
    assert _glyph_rows(reader._page_columns(iter([batch.slice(0, 7), batch.slice(7)]))) == want
    assert len(want) > 1000


def test_usual_lines_are_not_walked(monkeypatch):
    """pages of the round trip are read together, not one by one."""
    import pyarrow as pa

    monkeypatch.setattr(reader, "_walk", None)
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([words_pdf([[("one", 10, 20), ("two", 50.5, 20)]] * 4)], pa.binary())], names=["doc_id", "content"])
    assert sum(len(g.page) for g in file_glyphs(iter([batch]))) == 24


def test_streams_by_columns_are_those_of_the_writer():
    import numpy as np
    import pyarrow as pa

    pages = [[("INV7", 56, 40), ("", 3.5, 3), ("a", 1 / 3, 1e6)], [], [("P19", 56, 100), ("12.50", 510, 100)], [("Total", 56, 128), ("x", -4, 128.25)]]
    words = [(*w, i) for i, own in enumerate(pages) for w in own]
    f = lambda k: np.array([w[k] for w in words], np.float32)
    page = np.array([w[3] for w in words])
    cuts, odd = np.searchsorted(page, np.arange(5)), np.array([False, True, False, True])
    pages = [[(t, float(np.float32(x)), float(np.float32(y))) for t, x, y in own] for own in pages]
    got = words_streams(pa.array(["skip", *(w[0] for w in words)]).slice(1), f(1), f(2), page, cuts, odd)
    assert pages_pdf(got, flate=True) == words_pdf(pages)
    for text in ("(", "\\", "\u00e9"):
        assert words_streams(pa.array([text]), f(1)[:1], f(2)[:1], page[:1], np.array([0, 1]), odd[:1]) is None
