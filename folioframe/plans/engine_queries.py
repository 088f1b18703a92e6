"""Queries that write PDF files from tables and read them with the engine: pages, trees, content operators, fonts.

Each query builds the files of its rows as object bodies (Catalyst string functions), ``write_objects``
joins them to files, and ``parse_column`` and ``glyph_table`` read them back. The SQL of each query states
what the rules of the file format give, by formulas over the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import f32
from ..operators.text import extract_text_layout
from ..schemas import PAGE
from ..sinks import render_pages, samples, skipped_pages, to_json
from ..sources.reader import glyph_table, pages_table, parse_column
from ..sources.writer import page_objects, write_objects
from .inputs import table

PLAIN_FONT = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


def _glyphs(pages: DataFrame, font: Column | str = PLAIN_FONT, more: DataFrame | None = None) -> DataFrame:
    """Glyphs of files made of pages (doc_id, page_index, streams, extra)."""
    return glyph_table(parse_column(write_objects(page_objects(pages, font, more))))


def _milli(name: str) -> Column:
    return F.round(F.col(name).cast("double") * 1000).cast("long").alias(name)


# ---- pages: boxes, rotation, offsets, scanned pages --------------------------------------------


def _paged(spark: SparkSession, d: str) -> DataFrame:
    """A page for each order, parsed: box corners, rotation and an image or a letter from the order's key."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    x0, y0 = F.pmod(key, F.lit(5)) * 10, F.pmod(key, F.lit(3)) * 100
    x1, y1 = x0 + 612 - F.pmod(key, F.lit(11)) * 100, y0 + F.when(F.pmod(key, F.lit(13)) == 0, 0).otherwise(792)
    extra = F.format_string("/MediaBox [%d %d %d %d] /Rotate %d", x0, y0, x1, y1, (F.pmod(key, F.lit(17)) - 8) * 45)
    shown = F.when(F.pmod(key, F.lit(4)) == 0, F.lit("q 9 0 0 9 0 0 cm /I Do Q")).otherwise(F.lit("BT /F1 8 Tf 100 700 Td (A) Tj ET"))
    return parse_column(write_objects(page_objects(o.select(F.col("o_custkey").cast("string").alias("doc_id"), n.cast("int").alias("page_index"), F.array(shown).alias("streams"), extra.alias("extra")), PLAIN_FONT)))


_PG = """pg as (select cast(o_custkey as varchar) doc_id, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int page_index, o_orderkey % 5 * 10 bx0, o_orderkey % 3 * 100 by0,
 o_orderkey % 5 * 10 + 612 - o_orderkey % 11 * 100 bx1, o_orderkey % 3 * 100 + case when o_orderkey % 13 = 0 then 0 else 792 end by1, (o_orderkey % 17 - 8) * 45 rotate, o_orderkey % 4 = 0 is_scanned from orders),
ok as (select *, ((rotate % 360) + 360) % 360 t, abs(bx1 - bx0) > 0 and abs(by1 - by0) > 0 good from pg),
mt as (select doc_id, page_index, is_scanned, case when good then least(bx0, bx1) else 0 end ox, case when good then least(by0, by1) else 0 end oy, case when good then abs(bx1 - bx0) else 612 end w, case when good then abs(by1 - by0) else 792 end h,
 (case when good and t % 90 = 0 then t else 0 end)::int rotation from ok),
mx as (select *, (case when rotation in (90, 270) then h else w end)::float width, (case when rotation in (90, 270) then w else h end)::float height from mt),
tx as (select doc_id, page_index, case when is_scanned then '(scanned — no text layer)' when rotation = 0 then 'A' else '' end body, is_scanned from mx)"""


def page_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M3 to M6, M9: size and rotation of pages with turned, empty and missing boxes."""
    return pages_table(_paged(spark, d)).select(*PAGE, "width", "height", F.col("rotation").cast("int").alias("rotation"))


def rotation_normalize(spark: SparkSession, d: str) -> DataFrame:
    """M4: rotations that are no quarter turns are none."""
    return _paged(spark, d).groupBy(F.col("rotation").cast("int").alias("rotation")).agg(F.count("*").alias("n_pages"))


def doctop_offsets(spark: SparkSession, d: str) -> DataFrame:
    """M8: heights of the pages before, summed."""
    return _paged(spark, d).select(*PAGE, "doctop_offset")


def page_transform(spark: SparkSession, d: str) -> DataFrame:
    """Where a letter at (100, 700) lands on pages with an origin and a rotation."""
    return glyph_table(_paged(spark, d)).select(*PAGE, "text", _milli("x0"), _milli("x1"), _milli("top"), _milli("bottom"), _milli("doctop"), "upright")


def skipped_pages_report(spark: SparkSession, d: str) -> DataFrame:
    """K3, T15."""
    return skipped_pages(_paged(spark, d))


def recipe_route_scanned(spark: SparkSession, d: str) -> DataFrame:
    """Where each page goes."""
    return _paged(spark, d).select(*PAGE, F.when(F.col("is_scanned"), "ocr").otherwise("text").alias("route"))


def _with_layouts(spark: SparkSession, d: str) -> DataFrame:
    parsed = _paged(spark, d)
    return pages_table(parsed).select(*PAGE, "is_scanned").join(extract_text_layout(glyph_table(parsed)), PAGE, "left")


def cli_text(spark: SparkSession, d: str) -> DataFrame:
    """K1: the text of each document, scanned pages left out."""
    return render_pages(_with_layouts(spark, d))


def cli_marked(spark: SparkSession, d: str) -> DataFrame:
    """K6: the text of each document, scanned pages marked."""
    return render_pages(_with_layouts(spark, d), mark_scanned=True)


def json_pages(spark: SparkSession, d: str) -> DataFrame:
    """K8: pages as JSON."""
    return to_json(_paged(spark, d).select(*PAGE, F.col("rotation").cast("int").alias("rotation"), "is_scanned"))


# ---- the page tree -----------------------------------------------------------------------------


def inheritable_attr(spark: SparkSession, d: str) -> DataFrame:
    """Width of each page from the nearest box up its tree, through references.

    A hundred parts are a file; part i of it is a tree node with a page of its own, its parent is i div 2.
    """
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr("p_partkey div 100").cast("string").alias("doc_id"), (F.pmod("p_partkey", F.lit(100)) + 1).cast("int").alias("i"), F.col("p_size").alias("size"))
    i = F.col("i")
    kids = p.select("doc_id", F.expr("i div 2").alias("up"), i.alias("kid")).where("up > 0").groupBy("doc_id", "up").agg(F.array_sort(F.collect_list("kid")).alias("kids"))  # two at most
    p = p.join(kids.withColumnRenamed("doc_id", "d2"), (F.col("doc_id") == F.col("d2")) & (i == F.col("up")), "left")
    known = F.array_join(F.transform(F.coalesce("kids", F.array().cast("array<int>")), lambda x: F.format_string("%d 0 R", 1000 + x)), " ")
    box = F.when(F.pmod("k", F.lit(7)) == 0, F.format_string("/MediaBox %d 0 R", 3000 + i)).otherwise("")
    up = F.when(i > 1, F.format_string("/Parent %d 0 R", 1000 + F.expr("i div 2"))).otherwise("")
    text = F.format_string("BT /F1 8 Tf 10 10 Td (%d) Tj ET", F.col("k"))
    bodies = F.array(
        F.struct((1000 + i).alias("number"), F.format_string("<< /Type /Pages /Kids [%d 0 R %s] %s %s >>", 2000 + i, known, up, box).alias("body")),
        F.struct((2000 + i).alias("number"), F.format_string("<< /Type /Page /Parent %d 0 R /Contents %d 0 R >>", 1000 + i, 5000 + i).alias("body")),
        F.struct((3000 + i).alias("number"), F.format_string("%d 0 R", 4000 + i).alias("body")),
        F.struct((4000 + i).alias("number"), F.format_string("[0 0 %d 0 R 500]", 6000 + i).alias("body")),
        F.struct((5000 + i).alias("number"), F.concat(F.lit("<< >>\nstream\n"), text, F.lit("\nendstream")).alias("body")),
        F.struct((6000 + i).alias("number"), (F.col("size") + 100).cast("string").alias("body")),
    )
    objects = p.select("doc_id", F.explode(bodies).alias("o")).select("doc_id", "o.number", "o.body")
    top = p.select("doc_id").distinct().select("doc_id", F.lit(1).alias("number"), F.lit("<< /Type /Catalog /Pages 1001 0 R >>").alias("body"))
    parsed = parse_column(write_objects(objects.unionByName(top)))
    node = glyph_table(parsed).groupBy(*PAGE).agg(F.expr("listagg(text, '') within group (order by idx)").cast("long").alias("node"))
    return node.join(parsed.select(*PAGE, "width", "height"), PAGE).select("node", "width", "height")


# ---- content operators -------------------------------------------------------------------------


def _part_pages(spark: SparkSession, d: str, *streams: Column, extra: Column | None = None) -> DataFrame:
    """A page for each part, fifty a file."""
    k = F.col("p_partkey")
    extra = F.lit("") if extra is None else extra
    return table(spark, d, "part").select(F.expr("p_partkey div 50").cast("string").alias("doc_id"), F.pmod(k, F.lit(50)).cast("int").alias("page_index"), F.array(*streams).alias("streams"), extra.alias("extra"))


def _keyed_pages(glyphs: DataFrame, lowest: DataFrame) -> DataFrame:
    """Add p_partkey: a file's pages are its parts in order."""
    return glyphs.join(lowest, "doc_id").withColumn("p_partkey", F.col("first") + F.col("page_index"))


def _first_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.expr("p_partkey div 50").cast("string").alias("doc_id")).agg(F.min("p_partkey").alias("first"))


def text_state(spark: SparkSession, d: str) -> DataFrame:
    """All text operators, in three content streams; spacing, scale, rise and leading from the part's key."""
    k = F.col("p_partkey")
    m = lambda n: F.pmod(k, F.lit(n))
    one = F.format_string("BT /F1 %d Tf %.1f Tc %d Tw %d Tz", 6 + m(5), m(5) / F.lit(2.0), m(3), 50 + 50 * m(4))
    two = F.format_string("%d TL %d Ts 2 Tr 50 700 Td (A b) Tj T* (c) Tj (d) ' 1 2 (e f) \"", 10 + m(6), m(7) - 3)
    three = F.lit("10 -20 TD (g) Tj T* (h) Tj [(i) -500 (j)] TJ ET")
    g = _glyphs(_part_pages(spark, d, one, two, three))
    return _keyed_pages(g, _first_keys(spark, d)).select("p_partkey", "idx", "text", _milli("x0"), _milli("x1"), _milli("top"), _milli("bottom"), _milli("size"))


def state_fold_depth(spark: SparkSession, d: str) -> DataFrame:
    """Each q moves a user's page by a point, each Q takes that back; a letter after each event shows the depth."""
    step = F.when(F.pmod("event_id", F.lit(3)) == 0, "q 1 0 0 1 1 0 cm").otherwise(F.when(F.pmod("event_id", F.lit(3)) == 1, "Q").otherwise(""))
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("doc_id"), "event_id", F.concat(step, F.lit(" /F1 2 Tf BT (A) Tj ET")).alias("s"))
    pages = e.groupBy("doc_id").agg(F.expr("listagg(s, '\n') within group (order by event_id)").alias("s"))
    g = _glyphs(pages.select("doc_id", F.lit(0).alias("page_index"), F.array("s").alias("streams"), F.lit("").alias("extra")))
    return g.select(F.col("doc_id").alias("user"), "idx", F.round("x0").cast("long").alias("depth"))


def scan_detect(spark: SparkSession, d: str) -> DataFrame:
    """Pages with an image and no text operator; an operator for each order line, a page for each order."""
    ops = ["/I Do", "q", "0 0 1 1 re", "BI /W 1 /H 1 ID (BT EI", "(a) Tj"]
    op = F.element_at(F.array(*map(F.lit, ops)), (F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(5)) + 1).cast("int"))
    lines = table(spark, d, "lineitem").select("l_orderkey", op.alias("op"))
    pages = lines.groupBy("l_orderkey").agg(F.expr("listagg(op, '\n') within group (order by op)").alias("s"))
    pages = pages.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), F.array("s").alias("streams"), F.lit("").alias("extra"))
    got = parse_column(write_objects(page_objects(pages, PLAIN_FONT)), need="pages")
    return got.select(F.col("doc_id").cast("long").alias("l_orderkey"), "is_scanned")


# ---- fonts -------------------------------------------------------------------------------------


def _literal(text: str) -> Column:
    return F.concat(F.lit("("), F.regexp_replace(text, r"([\\()])", r"\\$1"), F.lit(")"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Part names shown at size 8 with spacing, by a font whose widths follow from the codes."""
    widths = " ".join(f"{250 + c % 8 * 62.5:g}" for c in range(256))
    font = f"<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding /WinAnsiEncoding /FirstChar 0 /Widths [{widths}] >>"
    shown = F.concat(F.lit("BT /F1 8 Tf 0.5 Tc 2 Tw 100 700 Td "), _literal("p_name"), F.lit(" Tj ET"))
    return _keyed_pages(_glyphs(_part_pages(spark, d, shown), font), _first_keys(spark, d))


_RUNS = "rn as (select p_partkey, k::int k, ascii(p_name[k + 1]) code, (250 + ascii(p_name[k + 1]) % 8 * 62.5) / 1000 w from part, unnest(range(0, length(p_name))) r(k))"
_ADV = "av as (select *, coalesce(sum(w * 8 + 0.5 + case when code = 32 then 2 else 0 end) over (partition by p_partkey order by k rows between unbounded preceding and 1 preceding), 0) start from rn)"


def glyph_advance(spark: SparkSession, d: str) -> DataFrame:
    """Where each glyph of a run starts, with character and word spacing."""
    return _named(spark, d).select("p_partkey", F.col("idx").alias("k"), F.ascii("text").alias("code"), (_milli("x0") - 100_000).alias("start"))


def glyph_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes, size and place in the document of the glyphs of a run at (100, 700)."""
    return _named(spark, d).select("p_partkey", F.col("idx").alias("k"), _milli("x0"), _milli("x1"), _milli("top"), _milli("bottom"), _milli("doctop"), _milli("size"), "fontname", "upright")


def font_width_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Widths by code with the missing width for codes that the table lacks."""
    font = f"<< /Type /Font /Subtype /TrueType /BaseFont /X /Encoding /WinAnsiEncoding /FirstChar 65 /Widths [{' '.join(str(c * 8) for c in range(65, 115))}] /MissingWidth 300 >>"
    g = _glyphs(_part_pages(spark, d, F.concat(F.lit("BT /F1 10 Tf "), _literal("p_name"), F.lit(" Tj ET"))), font)
    return g.groupBy(F.ascii("text").alias("code")).agg(F.count("*").alias("n"), F.min(F.round((F.col("x1") - F.col("x0")).cast("double") * 100)).cast("long").alias("low"), F.max(F.round((F.col("x1") - F.col("x0")).cast("double") * 100)).cast("long").alias("high"))


def cid_range_expand(spark: SparkSession, d: str) -> DataFrame:
    """A composite font a file; ranges and lists of widths, two-byte codes, ToUnicode ranges.

    A hundred parts are a file. Part j has the codes from 50 j: even parts a range of p_size codes, odd ones a list of
    three. All these codes are shown, and one that has no width.
    """
    p = table(spark, d, "part").select(F.expr("p_partkey div 100").cast("string").alias("doc_id"), F.pmod("p_partkey", F.lit(100)).cast("int").alias("j"), F.col("p_size").alias("size"))
    first, w, even = F.col("j") * 50, F.col("size") * 10, F.pmod("j", F.lit(2)) == 0
    last = first + F.when(even, F.col("size") - 1).otherwise(2)
    item = F.when(even, F.format_string("%d %d %d", first, last, w)).otherwise(F.format_string("%d [%d %d %d]", first, w, w + 1, w + 2))
    codes = F.array_join(F.transform(F.sequence(first, last), lambda c: F.format_string("%04X", c)), "")
    p = p.select("doc_id", "j", item.alias("item"), codes.alias("codes"))
    p = p.groupBy("doc_id").agg(F.expr("listagg(item, ' ') within group (order by j)").alias("w"), F.expr("listagg(codes, '') within group (order by j)").alias("codes"))  # a hundred rows
    cmap = "1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <1FFF> <4E00> endbfrange"
    font = F.concat(F.lit("<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode 4 0 R /DescendantFonts [<< /Type /Font /Subtype /CIDFontType2 /W ["), F.col("w"), F.lit("] >>] >>"))
    pages = p.select("doc_id", F.lit(0).alias("page_index"), F.array(F.concat(F.lit("BT /F1 10 Tf 10 700 Td <"), F.col("codes"), F.lit("1800> Tj ET"))).alias("streams"), F.lit("").alias("extra"), font.alias("font"))
    more = p.select("doc_id", F.lit(4).alias("number"), F.lit(f"<< >>\nstream\n{cmap}\nendstream").alias("body"))
    g = _glyphs(pages, F.col("font"), more)
    return g.select("doc_id", (F.ascii("text") - 0x4E00).cast("long").alias("cid"), F.round((F.col("x1") - F.col("x0")).cast("double") * 100).cast("long").alias("em"))


def differences_fill(spark: SparkSession, d: str) -> DataFrame:
    """a number sets the code, each name takes the next one; order lines are the items, every third a number.

    A file for each order shows all codes; the place of a glyph tells its code.
    """
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(w).alias("n"))
    item = F.when(F.pmod("n", F.lit(3)) == 1, F.pmod("l_partkey", F.lit(250)).cast("string")).otherwise(F.format_string("/uni%04X", 0x4E00 + F.col("n")))
    files = items.select("l_orderkey", "n", item.alias("item")).groupBy("l_orderkey").agg(F.expr("listagg(item, ' ') within group (order by n)").alias("x"))
    font = F.concat(F.lit("<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /BaseEncoding /WinAnsiEncoding /Differences ["), F.col("x"), F.lit("] >> >>"))
    every = "".join(f"{c:02X}" for c in range(256))
    pages = files.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), F.array(F.lit(f"BT /F1 2 Tf <{every}> Tj ET")).alias("streams"), F.lit("").alias("extra"), font.alias("font"))
    g = _glyphs(pages, F.col("font")).withColumn("point", F.ascii("text")).where("point > 19968 and point < 20992")
    return g.select(F.col("doc_id").cast("long").alias("l_orderkey"), F.round("x0").cast("long").alias("code"), (F.col("point") - 0x4E00).cast("long").alias("n"))


def glyph_name_join(spark: SparkSession, d: str) -> DataFrame:
    """glyph names of part names, by the table or by their hexadecimal code, give the names back.

    The font names the codes from 100 on by the printable characters of ASCII.
    """
    special = {32: "space", 45: "hyphen", 44: "comma", 46: "period", 48: "zero", 49: "one", 50: "two", 35: "numbersign"}
    names = " ".join("/" + special.get(c, f"uni{c:04X}") for c in range(32, 127))
    font = f"<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /Differences [100 {names}] >> >>"
    shifted = F.array_join(F.transform(F.filter(F.split("p_name", ""), lambda c: c != ""), lambda c: F.format_string("%02X", F.ascii(c) + 68)), "")
    g = _glyphs(_part_pages(spark, d, F.concat(F.lit("BT /F1 10 Tf <"), shifted, F.lit("> Tj ET"))), font)
    whole = g.groupBy(*PAGE).agg(F.expr("listagg(text, '') within group (order by idx)").alias("name"))
    return _keyed_pages(whole, _first_keys(spark, d)).select("p_partkey", "name")


_MAC = "ÄÅÇÉÑÖÜáàâäãåçéèêëíìîïñóòôöõúùûü"


def font_encodings(spark: SparkSession, d: str) -> DataFrame:
    """Codes by the encodings of Windows, Macintosh and Adobe's standard, and by a font that a page lacks.

    A file for each nation; the place of a glyph tells its code.
    """
    kind = F.pmod("n_nationkey", F.lit(4)).cast("int")
    font = F.concat(F.lit("<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding /"), F.element_at(F.array(*map(F.lit, ["WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding", "WinAnsiEncoding"])), kind + 1), F.lit(" >>"))
    ranges = {0: [*range(32, 127), *range(161, 256)], 1: range(32, 160), 2: range(32, 127), 3: [*range(32, 127), *range(160, 256)]}
    shown = F.element_at(F.array(*(F.lit("".join(f"{c:02X}" if c in own else "00" for c in range(256))) for own in ranges.values())), kind + 1)
    stream = F.concat(F.lit("BT /F"), F.when(kind == 3, "9").otherwise("1"), F.lit(" 2 Tf <"), shown, F.lit("> Tj ET"))
    pages = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), F.array(stream).alias("streams"), F.lit("").alias("extra"), font.alias("font"))
    g = _glyphs(pages, F.col("font"))
    return g.select(F.col("doc_id").cast("int").alias("n_nationkey"), F.round("x0").cast("long").alias("code"), "text", "fontname")


def bench_samples(spark: SparkSession, d: str) -> DataFrame:
    """B1: a sample of each file: those of the orders, and one for each supplier that is no PDF file."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), "o_orderkey")
    n = (F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey")) - 1).cast("int")
    shown = F.when(F.pmod("o_orderkey", F.lit(4)) == 0, F.lit("/I Do")).otherwise(F.concat(F.lit("BT /F1 8 Tf ("), F.col("o_orderkey").cast("string"), F.lit(") Tj ET")))
    files = write_objects(page_objects(o.select("doc_id", n.alias("page_index"), F.array(shown).alias("streams"), F.lit("").alias("extra")), PLAIN_FONT))
    bad = table(spark, d, "supplier").select(F.concat(F.lit("folder/"), F.col("s_suppkey"), F.lit(".pdf")).alias("doc_id"), F.col("s_name").cast("binary").alias("content"))
    files = files.unionByName(bad)
    got = samples(parse_column(files), files.select("doc_id", F.length("content").cast("long").alias("length")))
    return got.select("name", "pages", "chars", "scanned_pages", (F.col("duration_ms") > 0).alias("timed"), "error")


# ---- errors ------------------------------------------------------------------------------------


def pdf_errors(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as files that cannot be read: no header, no catalog, encrypted, a broken content stream."""
    text, kind = F.coalesce("text", F.lit("")), F.pmod("doc_id", F.lit(4))
    tree = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj 3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj "
    broken = F.concat(F.lit(tree + "4 0 obj << /Filter /FlateDecode >> stream\nxx"), text, F.lit("\nendstream endobj trailer << /Root 1 0 R >>"))
    locked = F.concat(F.lit(tree + "trailer << /Root 1 0 R /Encrypt 9 0 R >>\n%"), F.regexp_replace(text, r"[\r\n]", " "))
    content = F.when(kind == 0, text).when(kind == 1, F.concat(F.lit("%PDF-1.4\n"), text)).when(kind == 2, locked).otherwise(broken)
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), content.cast("binary").alias("content"))
    return parse_column(docs).groupBy(F.col("error.kind").alias("kind"), F.col("error.page").alias("page")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        page_metrics, rotation_normalize, doctop_offsets, page_transform, skipped_pages_report, recipe_route_scanned, cli_text, cli_marked, json_pages, inheritable_attr, text_state, state_fold_depth, scan_detect,
        glyph_advance, glyph_boxes, font_width_lookup, cid_range_expand, differences_fill, glyph_name_join, font_encodings, bench_samples, pdf_errors,
    )
}

_P = f"with {_PG}"
_STATE = """st as (select p_partkey, 6 + p_partkey % 5 s, p_partkey % 5 / 2.0 tc, p_partkey % 3 tw, (50 + 50 * (p_partkey % 4)) / 100.0 th, 10 + p_partkey % 6 tl, p_partkey % 7 - 3 ts from part),
ad as (select *, (0.5 * s + tc) * th a1, (0.5 * s + tc + tw) * th a2, (0.5 * s + 2) * th b1, (0.5 * s + 3) * th b2 from st),
gl as (select *, unnest([{'i': 0, 't': 'A', 'x': 50, 'y': 700}, {'i': 1, 't': ' ', 'x': 50 + a1, 'y': 700}, {'i': 2, 't': 'b', 'x': 50 + a1 + a2, 'y': 700}, {'i': 3, 't': 'c', 'x': 50, 'y': 700 - tl}, {'i': 4, 't': 'd', 'x': 50, 'y': 700 - 2 * tl},
 {'i': 5, 't': 'e', 'x': 50, 'y': 700 - 3 * tl}, {'i': 6, 't': ' ', 'x': 50 + b1, 'y': 700 - 3 * tl}, {'i': 7, 't': 'f', 'x': 50 + b1 + b2, 'y': 700 - 3 * tl}, {'i': 8, 't': 'g', 'x': 60, 'y': 680 - 3 * tl}, {'i': 9, 't': 'h', 'x': 60, 'y': 660 - 3 * tl},
 {'i': 10, 't': 'i', 'x': 60 + b1, 'y': 660 - 3 * tl}, {'i': 11, 't': 'j', 'x': 60 + 2 * b1 + 0.5 * s * th, 'y': 660 - 3 * tl}]::struct(i int, t varchar, x double, y double)[]) g from ad)"""
ORACLES = {
    "page_metrics": f"{_P} select doc_id, page_index, width, height, rotation from mx",
    "rotation_normalize": f"{_P} select rotation, count(*) n_pages from mx group by all",
    "doctop_offsets": f"{_P} select doc_id, page_index, coalesce(sum(height) over (partition by doc_id order by page_index rows between unbounded preceding and 1 preceding), 0)::float doctop_offset from mx",
    "page_transform": f"""{_P}, o as (select *, coalesce(sum(height) over (partition by doc_id order by page_index rows between unbounded preceding and 1 preceding), 0) before, 100 - ox x, 700 - oy y from mx),
 b as (select doc_id, page_index, is_scanned, rotation, before, case rotation when 90 then y when 180 then w - x when 270 then h - y else x end x0, case rotation when 90 then x when 180 then y when 270 then w - x else h - y - 8 end top, case rotation when 90 then x when 180 then y + 8 when 270 then w - x else h - y end bottom from o)
 select doc_id, page_index, 'A' as text, (x0 * 1000)::bigint x0, (x0 * 1000 + 4000)::bigint x1, (top * 1000)::bigint top, (bottom * 1000)::bigint bottom, ((top + before) * 1000)::bigint doctop, rotation = 0 upright from b where not is_scanned""",
    "skipped_pages_report": f"{_P} select doc_id, count(*) n_skipped, string_agg(page_index::varchar, ', ' order by page_index) skipped from pg where is_scanned group by all",
    "recipe_route_scanned": f"{_P} select doc_id, page_index, case when is_scanned then 'ocr' else 'text' end route from pg",
    "cli_text": f"{_P} select doc_id, string_agg(body || chr(10), '' order by page_index) output from tx where not is_scanned group by all",
    "cli_marked": f"{_P} select doc_id, string_agg('--- page ' || page_index || ' ---' || chr(10) || body || chr(10), '' order by page_index) output from tx group by all",
    "json_pages": f"""{_P} select '{{"doc_id":"' || doc_id || '","page_index":' || page_index || ',"rotation":' || rotation || ',"is_scanned":' || is_scanned || '}}' json from mx""",
    "inheritable_attr": """with recursive t as (select p_partkey k, p_partkey // 100 f, p_partkey % 100 + 1 i, case when p_partkey % 7 = 0 then p_size + 100 end own from part),
 up as (select k, f, i, own from t union all select u.k, u.f, t.i, t.own from up u join t on t.f = u.f and t.i = u.i // 2 where u.own is null),
 r as (select k, max(own) own, min(i) last from up group by k) select k node, coalesce(own, 612)::float width, (case when own is null then 792 else 500 end)::float height from r where exists (select 1 from t where t.f = k // 100 and t.i = 1)""",
    "text_state": f"with {_STATE} select p_partkey, g.i idx, g.t as text, round(g.x * 1000)::bigint x0, round((g.x + 0.5 * s * th) * 1000)::bigint x1, ((792 - g.y - ts - s) * 1000)::bigint top, ((792 - g.y - ts) * 1000)::bigint bottom, (s * 1000)::bigint size from gl",
    "state_fold_depth": "with e as (select user_id, event_id, case event_id % 3 when 0 then 1 when 1 then -1 else 0 end s from events), f as (select *, sum(s) over (partition by user_id order by event_id rows unbounded preceding) t from e) select user_id::varchar as \"user\", (row_number() over (partition by user_id order by event_id) - 1)::int idx, (t - least(0, min(t) over (partition by user_id order by event_id rows unbounded preceding)))::bigint depth from f",
    "scan_detect": "with o as (select l_orderkey, ['Do', 'q', 're', 'BI', 'Tj'][((l_partkey + l_suppkey) % 5 + 1)::int] op from lineitem) select l_orderkey, not bool_or(op = 'Tj') and bool_or(op in ('Do', 'BI')) is_scanned from o group by all",
    "glyph_advance": f"with {_RUNS}, {_ADV} select p_partkey, k, code, round(start * 1000)::bigint start from av",
    "glyph_boxes": f"with {_RUNS}, {_ADV}, f as (select p_partkey // 50 d, min(p_partkey) lo from part group by all) select p_partkey, k, round((start + 100) * 1000)::bigint x0, round((start + 100 + w * 8) * 1000)::bigint x1, 84000::bigint top, 92000::bigint bottom, (84000 + 792000 * (p_partkey - lo))::bigint doctop, 8000::bigint size, 'F1' fontname, true upright from av join f on d = p_partkey // 50",
    "font_width_lookup": f"with {_RUNS}, c as (select code, count(*) n from rn group by all) select code, n, (case when code between 65 and 114 then code * 8 else 300 end)::bigint low, low high from c",
    "cid_range_expand": "with p as (select p_partkey // 100 f, p_partkey % 100 j, p_size s from part), c as (select f, j * 50 + u.o cid, case when j % 2 = 0 then s * 10 else s * 10 + u.o end em from p, unnest(range(0, case when j % 2 = 0 then s else 3 end)) u(o)) select f::varchar doc_id, cid::bigint cid, em::bigint em from c union all select distinct f::varchar, 6144, 500 from p",
    "differences_fill": "with i as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) n from lineitem), s as (select * from i where n % 3 = 1), c as (select i.l_orderkey, i.n, (s.l_partkey % 250 + i.n - s.n - 1) code from i asof join s on i.l_orderkey = s.l_orderkey and i.n >= s.n where i.n % 3 <> 1) select l_orderkey, code::bigint code, max(n)::bigint n from c where code <= 255 group by all",
    "glyph_name_join": "select p_partkey, p_name \"name\" from part",
    "font_encodings": f"""with c as (select n_nationkey, n_nationkey % 4 k, u.c from nation, unnest(range(32, 256)) u(c)) select n_nationkey, c::bigint code, case when k = 0 and c = 173 then '-' when k = 1 and c >= 128 then '{_MAC}'[(c - 127)::int] when k = 2 and c = 39 then '’' when k = 2 and c = 96 then '‘' else chr(c::int) end as text, case when k = 3 then 'F9' else 'F1' end fontname
 from c where c < 127 or k in (0, 3) and c >= 161 or k = 3 and c = 160 or k = 1 and c between 128 and 159""",
    "bench_samples": "select o_custkey::varchar \"name\", count(*) pages, (sum(case when o_orderkey % 4 = 0 then 0 else length(o_orderkey::varchar) end))::bigint chars, count(*) filter (o_orderkey % 4 = 0) scanned_pages, true timed, null::varchar error from orders group by all union all select s_suppkey || '.pdf', 0, 0, 0, true, 'PDF parse error: no header' from supplier",
    "pdf_errors": "select case doc_id % 4 when 2 then 'Unsupported' when 3 then 'ContentStream' else 'Pdf' end kind, case when doc_id % 4 = 3 then 0 end::int page, count(*) n from documents group by all",
}
