"""Boxes as four columns: left, top, right, bottom. Every function returns a Column and stays inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", names: tuple[str, ...] = ("x0", "y0", "x1", "y1")) -> Box:
    return tuple(F.col(prefix + n) for n in names)


def f32(c: Column) -> Column:
    return c.cast("float")


def is_valid(b: Box) -> Column:
    """Finite, inside the unit square, not empty."""
    inside = F.lit(True)
    for c in b:
        inside = inside & c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)
    return inside & (b[0] < b[2]) & (b[1] < b[3])


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0)
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)


def overlap_ratio(inner: Box, outer: Box) -> Column:
    """The share of the inner box that the outer one covers; 0 for an empty inner box."""
    return F.when(area(inner) == 0, 0.0).otherwise(intersection(inner, outer).cast("double") / area(inner).cast("double"))


def covered_by(inner: Box, outer: Box) -> Column:
    """At least nine tenths of the inner box, for boxes in whole per-mille."""
    return (area(inner) > 0) & (intersection(inner, outer) * 10 >= area(inner) * 9)


def covers(outer: Box, inner: Box) -> Column:
    """More than nine tenths of the inner box."""
    return (area(inner) > 0) & (intersection(inner, outer) * 10 > area(inner) * 9)


def overlaps(a: Box, b: Box) -> Column:
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def gap(a: Box, b: Box) -> tuple[Column, Column]:
    return tuple(F.when(a[i + 2] < b[i], b[i] - a[i + 2]).when(b[i + 2] < a[i], a[i] - b[i + 2]).otherwise(0).cast("double") for i in (0, 1))


def distance(a: Box, b: Box) -> Column:
    x, y = gap(a, b)
    return F.sqrt(x * x + y * y)


def center_distance(a: Box, b: Box) -> Column:
    """Between centres, doubled."""
    x, y = ((a[i] + a[i + 2] - b[i] - b[i + 2]).cast("double") for i in (0, 1))
    return F.sqrt(x * x + y * y)


def points(b: Box, width: Column, height: Column) -> Box:
    """Unit box to whole points, cut towards zero, corners in order; 32-bit arithmetic."""
    x0, y0, x1, y1 = (f32(c * f32(s)).cast("int") for c, s in zip(b, (width, height, width, height), strict=True))
    return F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)


def per_mille(b: Box, width: Column, height: Column) -> Box:
    return tuple(f32(f32(c * 1000) / f32(s)).cast("int") for c, s in zip(b, (width, height, width, height), strict=True))


def crop(b: Box, width: Column, height: Column) -> Box:
    """(x, y, width, height) in pixels of a unit box: outward, inside the image, one pixel at least."""
    x = F.greatest(F.least(F.floor(f32(b[0] * width)), width - 1), F.lit(0)).cast("int")
    y = F.greatest(F.least(F.floor(f32(b[1] * height)), height - 1), F.lit(0)).cast("int")
    right = F.least(F.greatest(F.ceil(f32(b[2] * width)), x + 1), width).cast("int")
    bottom = F.least(F.greatest(F.ceil(f32(b[3] * height)), y + 1), height).cast("int")
    return x, y, right - x, bottom - y


def asset_rect(b: Box, width: Column, height: Column, scale: float) -> Box:
    """Point box to pixels at a scale, outward, inside the image."""
    return (
        F.greatest(F.floor(b[0] * scale), F.lit(0)).cast("int"),
        F.greatest(F.floor(b[1] * scale), F.lit(0)).cast("int"),
        F.least(F.ceil(b[2] * scale), width).cast("int"),
        F.least(F.ceil(b[3] * scale), height).cast("int"),
    )


def asset_path(tag: Column, page_md5: Column, page: Column, rect: Box) -> Column:
    name = F.concat(tag, F.lit("/"), F.upper(page_md5), F.lit("_"), F.concat_ws("_", page.cast("string"), *[c.cast("string") for c in rect]))
    return F.concat(F.lit("images/"), F.sha2(name, 256), F.lit(".jpg"))


def padded(width: Column, height: Column, ratio: int = 50, edge: int = 28) -> tuple[Column, Column]:
    """An image's size after padding to the greatest edge ratio and enlarging to the least edge."""
    long, short = F.greatest(width, height), F.least(width, height)
    wide = long > short * ratio
    w = F.when(wide & (width < height), F.ceil(height / ratio)).otherwise(width).cast("int")
    h = F.when(wide & (width >= height), F.ceil(width / ratio)).otherwise(height).cast("int")
    least = F.greatest(F.least(w, h), F.lit(1))
    grow = least < edge
    up = lambda c: F.when(grow, F.ceil(f32(f32(c) * f32(f32(F.lit(edge)) / f32(least))))).otherwise(c).cast("int")
    return up(w), up(h)


def raster(width: Column, height: Column, max_pixels: int = 100_000_000, max_bytes: int = 64 << 20) -> tuple[Column, Column, Column]:
    """(width, height, bytes) of a page of so many points at 200 dpi, less where a cap needs it."""
    w, h = f32(width), f32(height)
    page = f32(w * h)
    cap = lambda n: f32(F.sqrt(f32(f32(F.lit(n)) / page)))
    by_bytes = f32(F.sqrt(f32(f32(f32(F.lit(max_bytes)) / F.lit(3.0).cast("float")) / page)))
    scale = F.least(F.lit(200 / 72).cast("float"), cap(max_pixels), by_bytes)
    rw, rh = (F.ceil(f32(c * scale)).cast("long") for c in (w, h))
    return rw, rh, rw * rh * 3


def on_table(image: Box, table: Box, width: Column, height: Column) -> Box:
    """An absorbed image's box in pixels of its table's crop."""
    tw, th = table[2] - table[0], table[3] - table[1]
    return (
        F.floor((image[0] - table[0]) * width / tw).cast("int"),
        F.floor((image[1] - table[1]) * height / th).cast("int"),
        F.ceil((image[2] - table[0]) * width / tw).cast("int"),
        F.ceil((image[3] - table[1]) * height / th).cast("int"),
    )
