"""Page composition with the rules that depend on what earlier ones did, and documents from layout to Markdown.

A page has a few hundred blocks, so a page is one group; groups are dealt out by document and page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import kinds

PAGE = ["doc_id", "page_idx"]
# What says that a table continues, and what a container holds.
CONTINUES = ("continued", "continuation", "续表")
PARENTS = {"equation_block": {"equation"}, "image_block": {"image", "chart", "table"}, "list": {"text", "ref_text", "list_item"}}


def _near_above(box: str, below: str) -> Column:
    """Whether a box ends closely above another, within its sides; arguments: prefixes of their columns x0, y0, x1, y1."""
    c = lambda p, n: F.col(p + n)
    wide, high = F.greatest(c(below, "x1") - c(below, "x0"), F.lit(1)), F.greatest(c(box, "y1") - c(box, "y0"), F.lit(1))
    side, gap = F.greatest(F.floor(wide * 3 / 100), F.lit(12)), c(below, "y0") - c(box, "y1")
    return gap.between(0, F.greatest(F.floor(high * 3 / 2), F.lit(12))) & (c(box, "x1") + side >= c(below, "x0")) & (c(box, "x0") - side <= c(below, "x1"))


def with_captions(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_idx, block_idx, kind) in builder kinds, after three rules by which text becomes a caption.

    1. Text beside a caption, right above a visual body.  2. One line of text or a footnote, above a caption of a table, while
    everything down to the table is closely above it.  3. The first block of a page that is not chrome, if it says that the
    table below continues.  None of them depends on what the others change, so each is a test over windows of the page;
    blocks meet only the tables below them on their page."""
    order = Window.partitionBy(*PAGE).orderBy("block_idx")
    cols = ["kind", "x0", "y0", "x1", "y1"]
    b = blocks.select(*PAGE, "block_idx", *cols, F.coalesce("content", F.lit("")).alias("content"))
    for side, step in (("p_", F.lag), ("n_", F.lead)):
        b = b.withColumns({side + c: step(c).over(order) for c in cols})
    beside = (F.col("p_kind") == "caption") & (F.col("p_y0") < F.col("y1")) & (F.col("p_y1") > F.col("y0"))
    b = b.withColumn("kind", F.when((F.col("kind") == "text") & beside & kinds.is_visual_body(F.col("n_kind")) & _near_above("", "n_"), "caption").otherwise(F.col("kind")))
    top = F.min(F.when(~kinds.is_chrome(F.col("kind")), F.col("block_idx"))).over(Window.partitionBy(*PAGE))
    b = b.select(*PAGE, "block_idx", *cols, "content", (F.col("block_idx") == top).alias("top"))
    tables = b.filter("kind = 'table_body'").select(*PAGE, F.col("block_idx").alias("t_idx"), *[F.col(c).alias(f"t_{c}") for c in cols[1:]])
    pairs = b.join(tables, PAGE).filter("block_idx < t_idx").withColumn("near", _near_above("", "t_"))
    up = Window.partitionBy(*PAGE, "t_idx").orderBy(F.desc("block_idx"))
    down_to = F.min("near").over(up.rowsBetween(Window.unboundedPreceding, 0))
    captioned = F.max(F.col("kind") == "caption").over(up.rowsBetween(Window.unboundedPreceding, -1))
    pairs = pairs.withColumns({"down_to": down_to, "captioned": F.coalesce(captioned, F.lit(False))})
    line = F.col("down_to") & F.col("captioned") & F.col("kind").isin("text", "footnote") & ~F.contains("content", F.lit("\n"))
    says = F.exists(F.array(*[F.lit(w) for w in CONTINUES]), lambda w: F.contains(F.lower("content"), w))
    again = F.col("top") & F.col("near") & (F.col("kind") == "text") & says
    found = pairs.filter(line | again).select(*PAGE, "block_idx", F.lit(True).alias("found")).distinct()
    out = b.join(found, [*PAGE, "block_idx"], "left")
    return out.select(*PAGE, "block_idx", F.when(F.coalesce("found", F.lit(False)), "caption").otherwise(F.col("kind")).alias("kind"))


def containers_resolved(names: list[str], boxes: list[tuple], texts: list[str | None]) -> tuple[list[bool], list[str | None]]:
    """(which blocks go, contents): a container with several equations takes their contents as an array, one with a
    single equation goes, image blocks and lists go if something of theirs says the same; done in reading order."""
    gone, texts = [False] * len(names), list(texts)

    def inside(i: int, o: int) -> bool:
        a, b = boxes[i], boxes[o]
        size = (a[2] - a[0]) * (a[3] - a[1])
        both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return i != o and size > 0 and both * 10 > size * 9

    for o, kind in enumerate(names):
        if kind not in PARENTS:
            continue
        children = [i for i, k in enumerate(names) if k in PARENTS[kind] and not gone[i] and inside(i, o)]
        if kind == "equation_block":
            if len(children) > 1:
                texts[o] = "\\begin{array}{l} " + " \\\\ ".join(texts[i] or "" for i in children) + " \\end{array}"
                for i in children:
                    gone[i] = True
            elif children:
                gone[o] = True
        elif any(texts[i] for i in children):
            gone[o] = True
    return gone, texts


def _by_page(blocks: DataFrame, one, extra: str) -> DataFrame:
    cols = [*PAGE, "block_idx", "kind", "x0", "y0", "x1", "y1", "content"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_idx")
        return one(pdf, list(zip(pdf.x0.tolist(), pdf.y0.tolist(), pdf.x1.tolist(), pdf.y1.tolist(), strict=True)))

    return blocks.select(*cols).groupBy(*PAGE).applyInPandas(run, f"doc_id long, page_idx int, block_idx int, {extra}")


def without_containers(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_idx, block_idx, kind, content) of the blocks that stay when containers are resolved in order."""

    def one(pdf: pd.DataFrame, boxes: list[tuple]) -> pd.DataFrame:
        gone, texts = containers_resolved(pdf.kind.tolist(), boxes, [None if pd.isna(t) else t for t in pdf.content])
        out = pdf[[*PAGE, "block_idx", "kind"]].assign(content=texts)
        return out[[not g for g in gone]]

    return _by_page(blocks, one, "kind string, content string")


def consistent(pages: DataFrame, group: str, index: str, width: str, rendered: str, scale: int, least: int) -> DataFrame:
    """pages with ``fine``: wider than ``least``, in strictly rising order of their indices within the group as they came, and rendered
    to as many pixels as the scale asks for."""
    before = F.lag(index).over(Window.partitionBy(group).orderBy(index))
    rising = before.isNull() | (F.col(index) > before)
    return pages.withColumn("fine", (F.col(width) > least) & rising & (F.ceil(F.col(width) * scale) == F.col(rendered)))


def document_markdown(pages: DataFrame) -> DataFrame:
    """Layout text of pages to one Markdown a document: parse, drop what tables cover, render, join in order."""
    from quire.operators import layout, ordered, spatial

    b = layout.parse(pages).withColumnRenamed("pos", "block_idx")
    whole = b.select(*PAGE, "block_idx", "kind", *[F.round(F.col(c) * 1000).cast("int").alias(n) for c, n in (("left", "x0"), ("top", "y0"), ("right", "x1"), ("bottom", "y1"))])
    kept = spatial.drop_text_in_tables(whole)
    return ordered.markdown(kept, F.when(F.col("kind") == "title", F.concat(F.lit("# block "), F.col("block_idx").cast("string"))).otherwise(F.concat(F.col("kind"), F.lit(" "), F.col("block_idx").cast("string"))))
