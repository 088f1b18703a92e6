"""Command line: ``python -m folioframe.cli input.pdf [-o output.txt]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.text import extract_text_layout
from .schemas import PAGE
from .sinks import render_pages, skipped_pages
from .sources.reader import glyph_table, pages_table, raise_errors, read_pdfs


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioframe", description="Layout text of a PDF file; scanned pages are skipped and reported.")
    parser.add_argument("input")
    parser.add_argument("-o", "--output", help="write here, not to standard output")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        parsed = raise_errors(read_pdfs(spark, args.input)).persist()
        pages = pages_table(parsed)
        layouts = pages.select(*PAGE, "is_scanned").join(extract_text_layout(glyph_table(parsed)), PAGE, "left")
        rendered, skipped = render_pages(layouts).orderBy("doc_id").toLocalIterator(), skipped_pages(pages).collect()
        if args.output:
            with open(args.output, "w", encoding="utf-8") as out:
                out.writelines(r["output"] for r in rendered)
        else:
            try:
                for r in rendered:
                    sys.stdout.write(r["output"])
                sys.stdout.flush()
            except BrokenPipeError:
                return 0
        for r in skipped:
            print(f"skipped {r['n_skipped']} scanned page(s): {r['skipped']}", file=sys.stderr)
    except Exception as e:
        print(f"error: {str(e).splitlines()[0] if str(e) else e!r}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
