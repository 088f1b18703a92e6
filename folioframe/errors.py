"""Errors of reading documents; as exceptions in strict mode, as a struct column otherwise."""

from __future__ import annotations

ERROR_TYPE = "struct<kind:string,page:int,reason:string>"


class LayoutError(Exception):
    kind = "Pdf"
    page: int | None = None

    def struct(self) -> dict:
        return {"kind": self.kind, "page": self.page, "reason": str(self)}


class Io(LayoutError):
    kind = "Io"

    def __init__(self, reason: str):
        super().__init__(f"I/O error: {reason}")


class Pdf(LayoutError):
    kind = "Pdf"

    def __init__(self, reason: str):
        super().__init__(f"PDF parse error: {reason}")


class ContentStream(LayoutError):
    kind = "ContentStream"

    def __init__(self, page: int, reason: str):
        super().__init__(f"invalid content stream on page {page}: {reason}")
        self.page = page


class Unsupported(LayoutError):
    kind = "Unsupported"

    def __init__(self, what: str):
        super().__init__(f"unsupported feature: {what}")


class Font(LayoutError):
    kind = "Font"

    def __init__(self, reason: str):
        super().__init__(f"font decoding failed: {reason}")


class PageOutOfBounds(LayoutError):
    kind = "PageOutOfBounds"

    def __init__(self, page: int):
        super().__init__(f"page index {page} out of bounds")
        self.page = page
