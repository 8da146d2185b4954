"""Blocks to spans, rows of content lists, and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text


def spans(content: Column) -> Column:
    r"""array<struct<type, content>>: text and inline equations in order; balanced ``\[x\]`` in text is ``[x]``."""
    n = lambda c, p: F.regexp_count(c, F.lit(p))
    plain = F.when((n(content, r"\\\[") == n(content, r"\\\]")) & content.contains("\\["), F.regexp_replace(content, r"\\\[(.*?)\\\]", "[$1]")).otherwise(content)

    def split(c: Column) -> Column:
        one = F.array(F.struct(F.lit("text").alias("type"), c.alias("content")))
        found = F.regexp_extract_all(c, F.lit(r"\\\((.+?)\\\)"), F.lit(1))
        between = F.split(c, r"\\\(.+?\\\)", -1)
        texts = F.transform(between, lambda x: F.struct(F.lit("text").alias("type"), x.alias("content")))
        maths = F.transform(found, lambda x: F.struct(F.lit("inline_equation").alias("type"), F.trim(x).alias("content")))
        mixed = F.flatten(F.zip_with(texts, maths, lambda a, b: F.array(a, b)))
        kept = F.filter(mixed, lambda s: s.isNotNull() & ((s["type"] != "text") | (F.trim(s["content"]) != "")))
        whole = (n(c, r"\\\(") != n(c, r"\\\)")) | ~c.contains("\\(") | (F.size(kept) == 0)
        return F.when(whole, one).otherwise(kept)

    return F.transform(F.array(plain), split)[0]


def equation_content(c: Column) -> Column:
    t = text.trimmed(c)
    return F.rtrim(F.when(t.rlike(r"(?s)^\\\[.*\\\]$"), F.regexp_replace(t, r"(?s)^\\\[(.*)\\\]$", "$1")).otherwise(t))


def code_content(c: Column) -> Column:
    """A code block without its fence."""
    return text.trimmed(F.regexp_replace(F.regexp_replace(c, r"^```[^\n]*(\n|$)", ""), r"(\n|^)\s*```\s*$", ""))


def paragraph(spans_: Column) -> Column:
    """The text of a paragraph of one line: escaped text and $maths$, joined by spaces."""
    parts = F.transform(spans_, lambda s: F.when(s["type"] == "inline_equation", F.concat(F.lit("$"), s["content"], F.lit("$"))).otherwise(F.trim(text.escape_markdown(s["content"]))))
    return text.escape_marker(F.array_join(F.filter(parts, lambda x: x != ""), " "))


# Marks that can end a line inside a word.
HYPHENS = "-\u00ad\u2010\u2011\u2043"


def paragraph_text(lines: Column, kind: Column, list_item: Column, formulas: bool = True, image: Column | None = None) -> Column:
    """The text of a paragraph of several lines: array<array<struct<type, content>>> to one string.

    Spans are joined by a space if text or an inline formula follows; in a paragraph with CJK letters only inside a line and
    after a formula.  A line that ends in a word and a hyphen is joined to the next one directly, without the hyphen if that
    starts with a small letter.  Code is not escaped, and items of lists keep a leading marker as it is."""
    folded = lambda s: F.when(s["type"] == "text", text.fold_alnum(s["content"])).otherwise(s["content"])

    def shown(s: Column, c: Column) -> Column:
        display = F.concat(F.lit("$$\n"), c, F.lit("\n$$")) if formulas else F.coalesce(F.concat(F.lit("![](images/"), image, F.lit(")")), F.lit("")) if image is not None else F.lit("")
        out = F.when(s["type"] == "text", F.when(kind == "code_body", c).otherwise(text.escape_markdown(c))).when(s["type"] == "inline_equation", F.concat(F.lit("$"), c, F.lit("$")))
        return text.trimmed(out.when(s["type"] == "interline_equation", display).otherwise(""))

    def line(spans_: Column, i: Column) -> Column:
        ahead = F.get(F.get(lines, i + 1), F.lit(0))
        small = F.coalesce((ahead["type"] == "text") & folded(ahead).rlike("^[a-z]"), F.lit(False))
        return F.transform(spans_, lambda s, k: F.struct(
            s["type"].alias("type"), shown(s, folded(s)).alias("value"), (k + 1 == F.size(spans_)).alias("last"), small.alias("small"),
            (s["type"].isin("text", "inline_equation") & (text.trimmed(folded(s)) != "")).alias("joins"),
        ))

    def joined(parts: Column) -> Column:
        cjk = F.exists(parts, lambda x: (x["type"] == "text") & text.has_cjk(x["value"]))
        final = F.array_max(F.transform(parts, lambda x, i: F.when(x["joins"], i)))  # the last one that others join
        broken = lambda x: (x["type"] == "text") & x["last"] & x["value"].rlike(rf"(^|\s)[A-Za-z]+[{HYPHENS}]$")

        def piece(x: Column, i: Column) -> Column:
            space = F.when(F.coalesce(i < final, F.lit(False)), " ").otherwise("")
            inner = F.when(~x["last"] | (x["type"] == "inline_equation"), space).otherwise("")
            hyphen = F.when(x["small"], F.regexp_replace(x["value"], rf"[{HYPHENS}]$", "")).otherwise(x["value"])
            return F.when(x["value"] == "", "").when(cjk, F.concat(x["value"], inner)).when(broken(x), hyphen).otherwise(F.concat(x["value"], space))

        return F.array_join(F.transform(parts, piece), "")

    out = F.transform(F.array(F.flatten(F.transform(lines, line))), joined)[0]
    return F.when(list_item, out).otherwise(text.escape_marker(out))


def v2_spans(spans_: Column, kind: Column) -> Column:
    """array<struct<type, content>> of a block in the second content list: blank spans go, neighbouring texts are one."""
    usable = F.filter(spans_, lambda s: s["type"].isin("text", "inline_equation") & (text.trimmed(s["content"]) != ""))
    spaced = F.transform(usable, lambda s, i: F.struct(
        F.when(s["type"] != "text", "equation_inline").when(kind == "phonetic", "phonetic").otherwise("text").alias("type"),
        F.when((s["type"] == "text") & (i + 1 < F.size(usable)), F.concat(s["content"], F.lit(" "))).otherwise(s["content"]).alias("content"),
    ))
    none = F.array().cast("array<struct<type:string,content:string>>")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["type"].alias("type"), F.concat(last["content"], s["content"]).alias("content"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["type"] == "text") & (s["type"] == "text"), grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spaced, none, add)


def v2_rows(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_idx, block_idx, row): the second content list, one nested JSON object a block by its type.

    Formulas carry their LaTeX, tables their HTML, its nesting level and whether it is complex (spans or a table inside)."""
    k, own = F.col("kind"), v2_spans(spans(F.col("content")), F.col("kind"))
    bbox = F.array("x0", "y0", "x1", "y1").alias("bbox")
    none = F.array().cast("array<struct<type:string,content:string>>")
    no_image = F.struct(F.lit("").alias("path")).alias("image_source")
    made = lambda name, *fields: F.to_json(F.struct(F.lit(name).alias("type"), F.struct(*fields).alias("content"), bbox))
    html = text.output_html(F.coalesce("content", F.lit("")))
    nest = F.when(F.regexp_count(html, F.lit("<table")) > 1, 2).otherwise(1)
    complex_ = html.contains("colspan") | html.contains("rowspan") | (nest > 1)
    item = F.array(F.struct(F.lit("text").alias("item_type"), own.alias("item_content")))
    row = F.when(k == "title", made("title", own.alias("title_content"), F.lit(1).alias("level")))
    row = row.when(k == "equation", made("equation_interline", equation_content(F.col("content")).alias("math_content"), F.lit("latex").alias("math_type"), no_image))
    row = row.when(k == "ref_text", made("list", F.lit("reference_list").alias("list_type"), item.alias("list_items")))
    row = row.when(k == "list", made("list", F.lit("text_list").alias("list_type"), F.array().cast("array<string>").alias("list_items")))
    for name, shown in (("header", "page_header"), ("footer", "page_footer"), ("aside_text", "page_aside_text"), ("page_number", "page_number"), ("page_footnote", "page_footnote")):
        row = row.when(k == name, made(shown, own.alias(f"{shown}_content")))
    row = row.when(k == "table", made(
        "table", no_image, none.alias("table_caption"), none.alias("table_footnote"), html.alias("html"), F.when(complex_, "complex_table").otherwise("simple_table").alias("table_type"), nest.alias("table_nest_level"),
    ))
    for name in ("image", "chart"):
        row = row.when(k == name, made(name, no_image, F.coalesce("content", F.lit("")).alias("content"), none.alias(f"{name}_caption"), none.alias(f"{name}_footnote")))
    row = row.when(k == "code", made("code", none.alias("code_caption"), own.alias("code_content"), F.lit("txt").alias("code_language")))
    row = row.when(k == "algorithm", made("algorithm", none.alias("algorithm_caption"), own.alias("algorithm_content")))
    return blocks.select("doc_id", "page_idx", "block_idx", row.otherwise(made("paragraph", own.alias("paragraph_content"))).alias("row"))


def markdown_block(kind: Column, content: Column) -> Column:
    """The Markdown of a single block; blank for kinds that have none of their own."""
    body = paragraph(spans(content))
    return (
        F.when(kind == "title", F.concat(F.lit("# "), body)).when(kind.isin("text", "ref_text", "phonetic"), body)
        .when(kind == "equation", F.concat(F.lit("$$\n"), equation_content(content), F.lit("\n$$"))).when(kind == "table", text.output_html(content))
        .when(kind == "code", F.concat(F.lit("```txt\n"), code_content(content), F.lit("\n```"))).otherwise("")
    )


def flat_row() -> Column:
    """A block's object of the content list, by type, with its box in per-mille."""
    k, body = F.col("kind"), paragraph(spans(F.col("content")))
    bbox = F.array("x0", "y0", "x1", "y1").alias("bbox")
    page = F.col("page_idx")
    texted = lambda kind, *more: F.to_json(F.struct(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), body.alias("text"), *more, bbox, page))
    return (
        F.when(k == "title", texted("text", F.lit(1).alias("text_level"))).when(k == "equation", texted("equation", F.lit("latex").alias("text_format")))
        .when(k == "table", F.to_json(F.struct(k.alias("type"), F.lit("").alias("img_path"), F.array().cast("array<string>").alias("table_caption"), F.array().cast("array<string>").alias("table_footnote"), F.col("content").alias("table_body"), bbox, page)))
        .otherwise(texted(k))
    )


def flat_rows(blocks: DataFrame) -> DataFrame:
    """The content list of each document's pages: one JSON object a block."""
    return blocks.select("doc_id", "page_idx", "block_idx", flat_row().alias("row"))


def documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, content_list, markdown): rows in order of pages and blocks as one JSON array, and the Markdown."""
    rows = blocks.select("doc_id", "page_idx", "block_idx", flat_row().alias("row"), markdown_block(F.col("kind"), F.col("content")).alias("md"))
    parts = F.sort_array(F.collect_list(F.struct("page_idx", "block_idx", "row", "md")))
    listed = F.concat(F.lit("["), F.array_join(F.transform(parts, lambda x: x["row"]), ","), F.lit("]"))
    shown = F.array_join(F.filter(F.transform(parts, lambda x: x["md"]), lambda x: F.trim(x) != ""), "\n\n")
    return rows.groupBy("doc_id").agg(listed.alias("content_list"), shown.alias("markdown"))


def middle(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_idx, para_blocks, discarded_blocks): the block tree of a page as JSON arrays, chrome apart."""
    chrome = F.col("kind").isin("header", "footer", "page_number", "aside_text", "page_footnote")
    block = F.struct("block_idx", F.to_json(F.struct(F.col("kind").alias("type"), F.array("x0", "y0", "x1", "y1").alias("bbox"), F.col("block_idx").alias("index"), F.array(F.struct(spans(F.col("content")).alias("spans"))).alias("lines"))).alias("json"))
    joined = lambda keep: F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, block))), lambda x: x["json"]), ","), F.lit("]"))
    return blocks.groupBy("doc_id", "page_idx").agg(joined(~chrome).alias("para_blocks"), joined(chrome).alias("discarded_blocks"))


def published(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown, content_list, content_list_v2, middle): what a document's files hold, from one pass over its blocks."""
    keys = ["doc_id", "page_idx", "block_idx"]
    second = v2_rows(blocks).select(*keys, F.col("row").alias("v2"))
    listed = second.groupBy("doc_id", "page_idx").agg(F.sort_array(F.collect_list(F.struct("block_idx", "v2"))).alias("x"))
    page = F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["v2"]), ","), F.lit("]"))
    pages = listed.select("doc_id", "page_idx", page.alias("v2"))
    tree = F.concat(F.lit('{"page_idx":'), F.col("page_idx").cast("string"), F.lit(',"para_blocks":'), "para_blocks", F.lit(',"discarded_blocks":'), "discarded_blocks", F.lit("}"))
    both = pages.join(middle(blocks).select("doc_id", "page_idx", tree.alias("tree")), ["doc_id", "page_idx"])
    rows = F.sort_array(F.collect_list(F.struct("page_idx", "v2", "tree")))
    one = lambda name: F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r[name]), ","), F.lit("]"))
    whole = both.groupBy("doc_id").agg(one("v2").alias("content_list_v2"), F.concat(F.lit('{"pdf_info":'), one("tree"), F.lit("}")).alias("middle"))
    return documents(blocks).join(whole, "doc_id")
