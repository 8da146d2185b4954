"""Ordered operators: reading order, merges of neighbours, folds of pages into documents, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_idx"]
VISUAL = ("table", "image", "image_block", "chart", "code")
TERMINAL = ".!?。！？)）\"”:：;；"


def by_page() -> Window:
    return Window.partitionBy(*PAGE).orderBy("block_idx")


def with_next(blocks: DataFrame) -> DataFrame:
    """Each block but the last of its page with the box of the next one as n_*."""
    cols = {f"n_{c}": F.lead(c).over(by_page()) for c in ("x0", "y0", "x1", "y1")}
    return blocks.withColumns(cols).filter("n_x0 is not null")


def reading_order(blocks: DataFrame, *order: str) -> DataFrame:
    return blocks.withColumn("index", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)) - 1)


def mergeable_texts(blocks: DataFrame) -> DataFrame:
    """Continued texts with the text that they join: the one before, with only visuals between.

    That one must not end a sentence; the text must not begin with a digit or capital, must be about as wide, and must
    start above the other's end."""
    seen = blocks.filter(~F.col("kind").isin(*VISUAL))
    prev = {f"p_{c}": F.lag(c).over(by_page()) for c in ("block_idx", "kind", "x0", "y0", "x1", "y1", "content")}
    width, p_width = F.col("x1") - F.col("x0"), F.col("p_x1") - F.col("p_x0")
    fits = (F.abs(width - p_width) < F.least(width, p_width)) & (width > 0) & (p_width > 0) & (F.col("y0") < F.col("p_y1"))
    words = (F.col("content") != "") & (F.col("p_content") != "") & ~F.col("content").rlike(r"^[0-9\p{Lu}]") & ~F.substring("p_content", -1, 1).isin(*TERMINAL)
    return seen.withColumns(prev).filter(F.col("merge_prev") & (F.col("kind") == "text") & (F.col("p_kind") == "text") & fits & words)


def merged_texts(blocks: DataFrame) -> DataFrame:
    """Paragraphs of each page after merging: (doc_id, page_idx, block_idx, content), lines joined by a space; chains cascade."""
    texts = blocks.filter("kind = 'text'").select(*PAGE, "block_idx", "content")
    joins = mergeable_texts(blocks).select(*PAGE, "block_idx", F.lit(1).alias("joins"))
    t = texts.join(joins, [*PAGE, "block_idx"], "left").withColumn("starts", F.when(F.col("joins").isNull(), 1).otherwise(0))
    t = t.withColumn("island", F.sum("starts").over(by_page()))
    parts = F.sort_array(F.collect_list(F.struct("block_idx", "content")))
    return t.groupBy(*PAGE, "island").agg(F.min("block_idx").alias("block_idx"), F.array_join(F.transform(parts, lambda x: x["content"]), " ").alias("content")).drop("island")


def reference_runs(blocks: DataFrame) -> DataFrame:
    """(doc_id, run, first, n): runs of neighbouring ref_text blocks of a document, over pages."""
    w = Window.partitionBy("doc_id").orderBy("page_idx", "block_idx")
    r = blocks.withColumn("before", F.lag("kind").over(w))
    r = r.withColumn("run", F.sum(F.when((F.col("kind") == "ref_text") & F.coalesce(F.col("before") == "ref_text", F.lit(False)), 0).otherwise(1)).over(w))
    return r.filter("kind = 'ref_text'").groupBy("doc_id", "run").agg(F.min(F.struct("page_idx", "block_idx")).alias("first"), F.count("*").alias("n"))


def last_surviving(blocks: DataFrame, empty: Column) -> DataFrame:
    """For each page the last block on earlier pages that is not empty."""
    last = blocks.filter(~empty).groupBy(*PAGE).agg(F.max("block_idx").alias("block_idx"))
    pages = blocks.select(*PAGE).distinct().join(last, PAGE, "left")
    w = Window.partitionBy("doc_id").orderBy("page_idx").rowsBetween(Window.unboundedPreceding, -1)
    return pages.select(*PAGE, F.last(F.when(F.col("block_idx").isNotNull(), F.col("page_idx")), True).over(w).alias("last_page"), F.last("block_idx", True).over(w).alias("last_block"))


def page_pairs(blocks: DataFrame, kind: str = "table") -> DataFrame:
    """(doc_id, page_idx): pages whose first block continues the last one of the page before, both of a kind."""
    ends = blocks.groupBy(*PAGE).agg(F.min_by("kind", "block_idx").alias("first"), F.max_by("kind", "block_idx").alias("last"))
    w = Window.partitionBy("doc_id").orderBy("page_idx")
    ends = ends.withColumn("p_last", F.lag("last").over(w)).withColumn("p_page", F.lag("page_idx").over(w))
    return ends.filter((F.col("first") == kind) & (F.col("p_last") == kind) & (F.col("p_page") == F.col("page_idx") - 1)).select(*PAGE)


def markdown(blocks: DataFrame, rendered: Column) -> DataFrame:
    """(doc_id, markdown): blocks that are not blank, joined by an empty line in order of pages and blocks."""
    parts = F.sort_array(F.collect_list(F.when(F.trim(rendered) != "", F.struct("page_idx", "block_idx", rendered.alias("md")))))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["md"]), "\n\n").alias("markdown"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in an order, from 0: sorted by ranges, counted within them, with the counts of the ranges before.

    Only one row a range goes through a window without keys."""
    at = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())  # the range in the upper bits, the place in the lower 33
    ranges = at.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_range", before.alias("_before"))
    out = at.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(ranges), "_range")  # as many rows as partitions
    return out.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))


def with_placeholders(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """The pages (doc_id, page_idx, ...) with a row of nulls for each that is missing; expected: (doc_id, n_pages)."""
    spine = expected.filter("n_pages > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1)).alias("page_idx"))
    return spine.join(pages, ["doc_id", "page_idx"], "left")


def overridden(rows: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """rows with a value: that of the overrides (key, value) if they name the row's key, else the key itself; keys name one at most."""
    return rows.join(overrides.select(key, value), key, "left").withColumn(value, F.coalesce(value, key))


def budget(rows: DataFrame, keys: list[str], order: list[str], size: str, cap: int) -> DataFrame:
    """rows with the running total of a size and whether it is over a cap."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum(size).over(w)).withColumn("over", F.col("upto") > cap)


def capped_messages(rows: DataFrame, keys: list[str], order: list[str], message: str, most: int) -> DataFrame:
    """The first messages of each key, joined by '; ', with '; ...' if there are more."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    some = rows.withColumn("rank", rank).filter(F.col("rank") <= most + 1)  # one more tells that there are more
    all_ = F.sort_array(F.collect_list(F.struct("rank", message)))
    text = F.array_join(F.transform(F.slice(all_, 1, most), lambda x: x[message]), "; ")
    return some.groupBy(*keys).agg(F.concat(text, F.when(F.count("*") > most, "; ...").otherwise("")).alias("messages"))


def fold_equations(blocks: DataFrame) -> DataFrame:
    """The equations of each page as one array."""
    parts = F.sort_array(F.collect_list(F.struct("block_idx", "content")))
    body = F.array_join(F.transform(parts, lambda x: x["content"]), " \\\\ ")
    return blocks.filter("kind = 'equation'").groupBy(*PAGE).agg(F.concat(F.lit("\\begin{array}{l} "), body, F.lit(" \\end{array}")).alias("latex"))
