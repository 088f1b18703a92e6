"""folioframe: document-layout analytics on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions travel to Python workers by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from .document import Document, Page  # noqa: E402
from .errors import LayoutError  # noqa: E402
from .operators.cluster import cluster  # noqa: E402
from .operators.text import extract_text_layout, extract_text_simple, render_map, text_map  # noqa: E402
from .operators.words import extract_words  # noqa: E402
from .options import TextOptions, TextOptionsBuilder, WordOptions  # noqa: E402
from .sources.reader import read_pdfs  # noqa: E402

__all__ = ["Document", "LayoutError", "Page", "TextOptions", "TextOptionsBuilder", "WordOptions", "cluster", "extract_text_layout", "extract_text_simple", "extract_words", "read_pdfs", "render_map", "text_map"]
