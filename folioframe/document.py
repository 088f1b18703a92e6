"""Facade over one document: pages, glyphs, words and text, in strict mode."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors
from .operators.text import extract_text_layout, extract_text_simple
from .operators.words import extract_words
from .options import TextOptions, WordOptions
from .sources.reader import glyph_table, pages_table, parse_column, read_files


class Document:
    """A document whose pages are parsed once, on first use; ``from_bytes`` and ``open`` raise on unreadable files."""

    def __init__(self, files: DataFrame):
        self._files = files
        self._head = parse_column(files, need="pages").select("page_index", "error", "n_pages", "width", "height", "rotation", "is_scanned").orderBy("page_index").collect()
        for r in self._head:
            if r["page_index"] is None and r["error"]:
                made = errors.LayoutError(r["error"]["reason"])
                made.__class__ = getattr(errors, r["error"]["kind"])
                raise made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Document:
        try:
            files = read_files(spark, path)
            if files.isEmpty():
                raise errors.Io(f"{path}: no PDF file")
        except errors.Io:
            raise
        except Exception as e:
            raise errors.Io(str(e).splitlines()[0]) from e
        return cls(files.limit(1))

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes, doc_id: str = "doc") -> Document:
        return cls(spark.createDataFrame([(doc_id, bytearray(data))], "doc_id string, content binary"))

    def num_pages(self) -> int:
        return self._head[0]["n_pages"] if self._head else 0

    @cached_property
    def parsed(self) -> DataFrame:
        return parse_column(self._files).persist()

    @cached_property
    def chars(self) -> DataFrame:
        return glyph_table(self.parsed)

    def pages_df(self) -> DataFrame:
        return pages_table(self.parsed)

    def page(self, index: int) -> Page:
        if not 0 <= index < self.num_pages():
            raise errors.PageOutOfBounds(index)
        return Page(self, index)

    def pages(self):
        return (self.page(i) for i in range(self.num_pages()))


class Page:
    def __init__(self, document: Document, index: int):
        self.document, self.index = document, index
        self._row = document._head[index]

    @property
    def width(self) -> float:
        return self._row["width"]

    @property
    def height(self) -> float:
        return self._row["height"]

    @property
    def rotation(self) -> int:
        return self._row["rotation"]

    def is_scanned(self) -> bool:
        return self._row["is_scanned"]

    def chars(self) -> DataFrame:
        row = self.document.parsed.where(F.col("page_index") == self.index).select("error").first()
        if row and row["error"]:
            raise errors.ContentStream(self.index, row["error"]["reason"])
        return self.document.chars.where(F.col("page_index") == self.index)

    def words(self, options: WordOptions = WordOptions()) -> DataFrame:
        return extract_words(self.chars(), options)

    def extract_text(self) -> str:
        row = extract_text_simple(self.chars()).first()
        return row["text"] if row else ""

    def extract_text_layout(self, options: TextOptions = TextOptions()) -> str:
        row = extract_text_layout(self.chars(), options).first()
        return row["layout"] if row else ""
