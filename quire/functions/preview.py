"""Outlines of blocks for a preview: where they stand on a turned page, and their colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Red, green, blue by kind.
COLOURS = {
    ("header", "footer", "page_number", "aside_text", "page_footnote"): "158,158,158",
    ("code", "algorithm"): "102,0,204",
    ("code_caption",): "204,153,255",
    ("table",): "204,204,0",
    ("table_caption",): "255,255,102",
    ("table_footnote",): "229,255,204",
    ("image", "image_block", "chart"): "153,255,51",
    ("image_caption",): "102,178,255",
    ("image_footnote",): "255,178,102",
    ("title",): "102,102,255",
    ("equation", "equation_block"): "0,255,0",
    ("list", "list_item", "index"): "40,169,92",
}
OTHER = "153,0,76"


def colour(kind: Column) -> Column:
    out = F.lit(OTHER)
    for names, rgb in COLOURS.items():
        out = F.when(kind.isin(*names), rgb).otherwise(out)
    return out


def on_page(x: Column, y: Column, page: tuple[float, float, float, float], turn: Column) -> tuple[Column, Column]:
    """A point of the upright unit square on a page (left, bottom, right, top) turned by 0, 90, 180 or 270 degrees."""
    left, bottom, right, top = page
    w, h = right - left, top - bottom
    px = F.when(turn == 0, left + x * w).when(turn == 90, left + y * w).when(turn == 180, right - x * w).otherwise(left + (1 - y) * w)
    py = F.when(turn == 0, top - y * h).when(turn == 90, bottom + x * h).when(turn == 180, bottom + y * h).otherwise(bottom + (1 - x) * h)
    return px, py
