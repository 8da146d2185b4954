"""Layout text of a page to typed blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import kinds

# The tokens of layout text.
HEADER = r"<\|box_start\|>[0-9]+\s+[0-9]+\s+[0-9]+\s+[0-9]+<\|box_end\|><\|ref_start\|>[A-Za-z0-9_]+<\|ref_end\|>(?:<\|rotate_(?:up|right|down|left)\|>)?"
MARKS = r"(?:<\||\|>|\s)+"
CONTINUES = "txt_contd_tgt"
MAX_BLOCKS = 256


def keep_unknown(layout):
    """Unknown blocks as images, for callers that want them parsed."""
    return F.replace(layout, F.lit("<|ref_start|>unknown<|ref_end|>"), F.lit("<|ref_start|>image<|ref_end|>"))


def headers(pages: DataFrame, layout: str = "layout") -> DataFrame:
    """All headers in the text with their numbers, kind, rotation and whether the text after it continues; bad ones too."""
    tail = F.split(F.col(layout), HEADER, -1)
    found = F.arrays_zip(F.regexp_extract_all(layout, F.lit(HEADER), F.lit(0)).alias("token"), F.slice(tail, 2, 1 << 30).alias("after"))
    # The text is scanned twice per page, not per block, and a token is cut once: at its marks, into
    # nothing, box_start, four numbers, box_end, ref_start, the kind, ref_end and maybe a rotation.
    cut = F.transform(found, lambda h: F.struct(F.split(h["token"], MARKS).alias("p"), F.coalesce(F.contains(h["after"], F.lit(CONTINUES)), F.lit(False)).alias("continues")))
    one = pages.select("*", F.posexplode(cut).alias("pos", "h"))
    rest = [c for c in pages.columns if c != layout]
    part = lambda i: F.col("h.p")[i]
    angle = kinds.rotation(F.substring_index(F.nullif(F.get("h.p", F.lit(10)), F.lit("")), "_", -1))
    return one.select(*rest, "pos", *[part(k + 1).cast("double").alias(f"c{k}") for k in (1, 2, 3, 4)], part(8).alias("kind"), angle.alias("angle"), "h.continues")


def parse(pages: DataFrame, layout: str = "layout") -> DataFrame:
    """Blocks of every page: kind, unit box, angle, merge_prev, in reading order.

    Swapped corners are put in order; empty boxes, boxes off the page, and kinds that are not laid out are dropped."""
    h = headers(pages, layout)
    left, right, top, bottom = F.least("c1", "c3"), F.greatest("c1", "c3"), F.least("c2", "c4"), F.greatest("c2", "c4")
    unit = [(c / 1000).cast("float").alias(n) for c, n in ((left, "left"), (top, "top"), (right, "right"), (bottom, "bottom"))]
    keys = [c for c in pages.columns if c != layout]
    out = h.select(*keys, "pos", "kind", *unit, "angle", "continues")
    out = out.filter(F.col("kind").isin(*kinds.LAYOUT_KINDS) & g.is_valid(g.box(names=("left", "top", "right", "bottom"))))
    return out.select(*keys, "pos", "kind", "left", "top", "right", "bottom", "angle", ((F.col("kind") == "text") & F.col("continues")).alias("merge_prev"))


def over_cap(blocks: DataFrame, keys: list[str], most: int = MAX_BLOCKS) -> DataFrame:
    """(keys, n_blocks, over) per page."""
    return blocks.groupBy(*keys).agg(F.count("*").alias("n_blocks")).withColumn("over", F.col("n_blocks") > most)
