"""Joins of the blocks of a page by their boxes.

All join on (doc_id, page_idx), so Spark deals them out by page and the boxes are a residual condition; a page has
few hundred blocks, so no key is large.  Blocks: doc_id, page_idx, block_idx, kind, x0, y0, x1, y1 in whole units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g

PAGE = ["doc_id", "page_idx"]
TEXTUAL = ("text", "equation", "equation_block")
PICTURES = ("image", "chart", "image_block")


def _side(blocks: DataFrame, prefix: str, kinds: tuple[str, ...]) -> DataFrame:
    names = {c: f"{prefix}{c}" for c in ("block_idx", "kind", "x0", "y0", "x1", "y1")}
    return blocks.filter(F.col("kind").isin(*kinds)).select(*PAGE, *[F.col(a).alias(b) for a, b in names.items()])


def _within(prefix: str = "o_") -> Column:
    return g.covered_by(g.box(), g.box(prefix))


def _joined(blocks: DataFrame, outer: DataFrame, on: Column, how: str) -> DataFrame:
    o = outer.select(F.col("doc_id").alias("o_doc"), F.col("page_idx").alias("o_page"), *[c for c in outer.columns if c not in PAGE])
    return blocks.join(o, (F.col("doc_id") == F.col("o_doc")) & (F.col("page_idx") == F.col("o_page")) & on, how)


def drop_text_in_tables(blocks: DataFrame) -> DataFrame:
    inside = _within() & F.col("kind").isin(*TEXTUAL)
    return _joined(blocks, _side(blocks, "o_", ("table",)), inside, "left_anti")


def captions_in_images(blocks: DataFrame) -> DataFrame:
    captions = blocks.filter("kind = 'image_caption'")
    return _joined(captions, _side(blocks, "o_", PICTURES), _within(), "left_semi")


def absorbed_images(blocks: DataFrame) -> DataFrame:
    """Images that tables cover: the tables' list, and the last table as the one that absorbs it."""
    pairs = _joined(blocks.filter("kind = 'image'"), _side(blocks, "o_", ("table",)), _within(), "inner")
    return pairs.groupBy(*PAGE, "block_idx").agg(F.max("o_block_idx").alias("absorbed_by"), F.count("*").cast("int").alias("n_tables"))


def images_of_tables(blocks: DataFrame) -> DataFrame:
    pairs = _joined(blocks.filter("kind = 'image'"), _side(blocks, "o_", ("table",)), _within(), "inner")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("block_idx")), lambda x: x.cast("string")), ",")
    return pairs.groupBy(*PAGE, F.col("o_block_idx").alias("table_idx")).agg(ids.alias("images"))


def loose_images(blocks: DataFrame) -> DataFrame:
    """Images and charts outside every image block."""
    pictures = blocks.filter(F.col("kind").isin("image", "chart"))
    return _joined(pictures, _side(blocks, "o_", ("image_block",)), _within(), "left_anti")


def semantic_candidates(blocks: DataFrame, most: int = 128, analyse_images: bool = True, suppressed: tuple[str, ...] = ()) -> DataFrame:
    """The blocks of each page that a recogniser is asked about, the first ``most`` in reading order."""
    left = _joined(blocks, _side(blocks, "o_", PICTURES), _within() & (F.col("kind") == "image_caption"), "left_anti")
    if "table" not in suppressed:
        left = _joined(left, _side(blocks, "o_", ("table",)), _within() & (F.col("kind") == "image"), "left_anti")
    left = left.filter(~F.col("kind").isin("list", "image_block", "equation_block", *suppressed))
    picture = F.col("kind").isin("image", "chart")
    if not analyse_images:
        left = left.filter(~picture)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    left = left.filter(~picture | ((w > 100) & (h > 100)) | (w * h > 10_000))
    left = _joined(left, _side(blocks, "o_", ("image_block",)), _within() & picture, "left_anti")
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_idx"))
    return left.withColumn("rank", rank).filter(F.col("rank") <= most)


def containers(blocks: DataFrame) -> DataFrame:
    """(container, kind, n_children) of equation blocks, image blocks and lists with the blocks that they cover, one level."""
    kinds = F.expr("(o_kind = 'equation_block' and kind = 'equation') or (o_kind = 'image_block' and kind in ('image', 'chart', 'table')) or (o_kind = 'list' and kind in ('text', 'ref_text', 'list_item'))")
    inside = g.covers(g.box("o_"), g.box()) & (F.col("block_idx") != F.col("o_block_idx")) & kinds
    pairs = _joined(blocks, _side(blocks, "o_", ("equation_block", "image_block", "list")), inside, "inner")
    return pairs.groupBy(*PAGE, F.col("o_block_idx").alias("container_idx"), F.col("o_kind").alias("container_kind")).agg(F.count("*").cast("int").alias("n_children"))


def list_members(blocks: DataFrame) -> DataFrame:
    """(block_idx, list_idx) of items that a list covers by four fifths; the first list claims an item."""
    share = g.intersection(g.box(), g.box("o_")) * 10 >= g.area(g.box()) * 8
    pairs = _joined(blocks.filter(F.col("kind").isin("text", "ref_text")), _side(blocks, "o_", ("list",)), share & (g.area(g.box()) > 0), "inner")
    return pairs.groupBy(*PAGE, "block_idx", "kind").agg(F.min("o_block_idx").alias("list_idx"))


def list_kind(members: DataFrame) -> DataFrame:
    """(list_idx, sub_type): the most frequent kind of a list's items, the last by name among equals."""
    n = members.groupBy(*PAGE, "list_idx", "kind").agg(F.count("*").alias("n"))
    return n.groupBy(*PAGE, "list_idx").agg(F.max_by("kind", F.struct("n", "kind")).alias("sub_type"))


def sub_images(blocks: DataFrame) -> DataFrame:
    """The image block that each image or chart belongs to: the greatest overlap, then the least area, then the first."""
    ratio = g.overlap_ratio(g.box(), g.box("o_"))
    pairs = _joined(blocks.filter(F.col("kind").isin("image", "chart")), _side(blocks, "o_", ("image_block",)), _within(), "inner")
    best = Window.partitionBy(*PAGE, "block_idx").orderBy(F.desc("ratio"), "o_area", "o_block_idx")
    pairs = pairs.withColumn("ratio", ratio).withColumn("o_area", g.area(g.box("o_"))).withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    rel = lambda a, low, high: F.round((F.col(a) - F.col(low)) / (F.col(high) - F.col(low)).cast("double"), 3)
    return pairs.select(*PAGE, "block_idx", F.col("o_block_idx").alias("container_idx"), rel("x0", "o_x0", "o_x1").alias("left"), rel("y0", "o_y0", "o_y1").alias("top"))


def visual_parents(blocks: DataFrame) -> DataFrame:
    """The nearest body of each caption and footnote by reading order, then by distance, then by position.

    A candidate is near if nothing but captions (and footnotes) stands between, apart from blocks beyond the gap."""
    child = blocks.filter(F.col("kind").isin("image_caption", "table_caption", "image_footnote"))
    child = child.withColumn("role", F.when(F.col("kind").endswith("_caption"), "caption").otherwise("footnote"))
    pairs = _joined(child, _side(blocks, "o_", ("table", "image", "chart", "code")), ~((F.col("role") == "footnote") & (F.col("block_idx") < F.col("o_block_idx"))), "inner")
    between = blocks.select(F.col("doc_id").alias("b_doc"), F.col("page_idx").alias("b_page"), F.col("block_idx").alias("b_idx"), F.col("kind").alias("b_kind"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    low, high = F.least("block_idx", "o_block_idx"), F.greatest("block_idx", "o_block_idx")
    c, p, b = g.box(), g.box("o_"), g.box("b_")
    apart = ~g.overlaps(b, c) & ~g.overlaps(b, p)
    beyond = ((c[3] <= p[1]) & ((b[1] >= p[1]) | (b[3] <= c[3])) | ~(c[3] <= p[1]) & (p[3] <= c[1]) & ((b[1] >= c[1]) | (b[3] <= p[3]))) & apart
    allowed = F.col("b_kind").endswith("_caption") | ((F.col("role") == "footnote") & F.col("b_kind").endswith("_footnote"))
    same_page = (F.col("doc_id") == F.col("b_doc")) & (F.col("page_idx") == F.col("b_page")) & (F.col("b_idx") > low) & (F.col("b_idx") < high)
    near = pairs.join(between, same_page & ~allowed & ~beyond, "left_anti")
    role_of = F.when(F.col("kind").endswith("_caption"), "caption").when(F.col("kind").endswith("_footnote"), "footnote")
    # Children of the same role before each block, so that the count between two is a difference.
    run = Window.partitionBy(*PAGE).orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    seen = blocks.withColumn("r", role_of).select(F.col("doc_id").alias("s_doc"), F.col("page_idx").alias("s_page"), F.col("block_idx").alias("s_idx"), F.sum((F.coalesce(F.col("r") == "caption", F.lit(False))).cast("int")).over(run).alias("captions"), F.sum((F.coalesce(F.col("r") == "footnote", F.lit(False))).cast("int")).over(run).alias("footnotes"))
    upto = lambda side, at: near.join(seen, (F.col("doc_id") == F.col("s_doc")) & (F.col("page_idx") == F.col("s_page")) & (F.col("s_idx") == at), "left") if side else None
    d = upto(True, high - 1).withColumn("upto_high", F.when(F.col("role") == "caption", F.col("captions")).otherwise(F.col("footnotes"))).drop("s_doc", "s_page", "s_idx", "captions", "footnotes")
    near = d
    d = near.join(seen, (F.col("doc_id") == F.col("s_doc")) & (F.col("page_idx") == F.col("s_page")) & (F.col("s_idx") == low), "left").withColumn("upto_low", F.when(F.col("role") == "caption", F.col("captions")).otherwise(F.col("footnotes")))
    d = d.withColumn("steps", high - low - F.greatest(F.col("upto_high") - F.col("upto_low"), F.lit(0))).withColumn("far", g.distance(c, p)).withColumn("centre", g.center_distance(c, p))
    one = Window.partitionBy(*PAGE, "block_idx")
    d = d.withColumn("least", F.min("steps").over(one)).filter("steps = least").withColumn("spread", F.max("far").over(one) - F.min("far").over(one)).withColumn("tables", F.min(F.col("o_kind") == "table").over(one))
    key = F.when(F.col("spread") > 2, F.struct("far", F.col("o_block_idx").cast("double"))).when((F.col("role") == "caption") & F.col("tables"), F.struct(F.lit(0.0).alias("far"), (-F.col("o_block_idx")).cast("double")))
    key = key.when(F.col("role") == "footnote", F.struct(F.lit(0.0).alias("far"), F.col("o_block_idx").cast("double"))).otherwise(F.struct(F.col("centre").alias("far"), F.col("o_block_idx").cast("double")))
    d = d.withColumn("key", key).withColumn("rank", F.row_number().over(one.orderBy("key"))).filter("rank = 1")
    return d.select(*PAGE, "block_idx", F.col("o_block_idx").alias("parent_idx"))
