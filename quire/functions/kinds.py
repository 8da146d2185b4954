"""Closed lists of kinds and the predicates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of blocks, of documents, and languages.
LAYOUT_KINDS = (
    "text", "title", "table", "equation", "formula_number", "code", "algorithm", "aside_text", "ref_text", "index", "phonetic", "list_item", "table_caption",
    "image_caption", "code_caption", "table_footnote", "image_footnote", "header", "footer", "page_number", "page_footnote", "image", "chart", "list", "image_block", "equation_block",
)
CHROME = ("header", "footer", "page_number", "aside_text", "page_footnote")
PARATEXT = (*CHROME, "unknown")
BODIES = ("image_body", "image_block_body", "table_body", "chart_body", "code_body")
OOXML = ("docx", "pptx", "xlsx")
LEGACY = ("doc", "ppt", "xls", "odt", "rtf", "epub", "ods", "odp", "csv")
DOCUMENTS = ("pdf", "png", "jpeg", "jpg", "jp2", "webp", "gif", "bmp", "tiff", *OOXML, *LEGACY)
TO_CHINESE = ("en", "japan", "chinese_cht", "latin")
LANGUAGES = ("ch", "ch_server", "korean", "ta", "te", "ka", "th", "el", "arabic", "east_slavic", "cyrillic", "devanagari")


def is_known(kind: Column) -> Column:
    return kind.isin(*LAYOUT_KINDS, "unknown")


def is_chrome(kind: Column) -> Column:
    return kind.isin(*CHROME)


def is_paratext(kind: Column) -> Column:
    return kind.isin(*PARATEXT)


def is_visual_body(kind: Column) -> Column:
    return kind.isin(*BODIES)


def document_kind(suffix: Column) -> Column:
    """The kind of a file suffix in any case; null for others."""
    low = F.lower(suffix)
    return F.when(low.isin(*DOCUMENTS), low)


def is_office(kind: Column) -> Column:
    return kind.isin(*OOXML)


def is_legacy_office(kind: Column) -> Column:
    return kind.isin(*LEGACY)


def supports_page_range(kind: Column) -> Column:
    return kind == "pdf"


def remote_language(value: Column) -> Column:
    """The recogniser's language; null if there is none."""
    return F.when(value.isin(*TO_CHINESE), "ch").when(value.isin(*LANGUAGES), value)


def rotation(word: Column) -> Column:
    return F.when(word == "up", 0).when(word == "right", 90).when(word == "down", 180).when(word == "left", 270).cast("int")


def builder_kind(kind: Column) -> Column:
    """Source kind to builder kind; null where there is none."""
    same = ("text", "title", "ref_text", "phonetic", "header", "footer", "page_number", "aside_text", "page_footnote", "list", "equation_block")
    out = F.when(kind.isin(*same), kind).when(kind.isin("formula_number", "index", "list_item"), "text")
    out = out.when((kind == "caption") | kind.endswith("_caption"), "caption").when((kind == "footnote") | kind.endswith("_footnote"), "footnote")
    for a, b in (("table", "table_body"), ("image", "image_body"), ("image_block", "image_block_body"), ("chart", "chart_body"), ("equation", "interline_equation"), ("code", "code_body"), ("algorithm", "code_body")):
        out = out.when(kind == a, b)
    return out


def span_type(kind: Column) -> Column:
    """The type of a block's first span; null without spans."""
    return (
        F.when(kind == "table", "table").when(kind.isin("image", "image_block"), "image").when(kind == "chart", "chart").when(kind == "equation", "interline_equation")
        .when(kind.isin("list", "equation_block"), F.lit(None)).when(builder_kind(kind).isNotNull(), "text")
    )
