"""Schemas of the public tables."""

CHARS = "doc_id string, page_index int, idx int, text string, x0 float, x1 float, top float, bottom float, doctop float, size float, fontname string, upright boolean"
WORDS = "doc_id string, page_index int, word_no int, text string, x0 float, x1 float, top float, bottom float, char_lo int, char_hi int"
PAGES = "doc_id string, page_index int, width float, height float, rotation smallint, doctop_offset float, is_scanned boolean, error struct<kind:string,page:int,reason:string>"
PAGE = ["doc_id", "page_index"]
