"""Queries over tables and formulas as text, spans, and rendered documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import formulas, tables, text
from quire.operators import render
from quire.plans.registry import query
from quire.plans.texts import _STRIP

_CELL = "concat('<td>', CAST(CAST(l_quantity AS int) AS string), '</td><td>', CASE WHEN l_linenumber = 3 THEN '' ELSE concat(l_returnflag, ' &amp; &quot;', CAST(l_partkey AS string), '&quot;') END, '</td><td>', l_linestatus, '</td>')"
_ROWS = f"string_agg(concat('<tr>', {_CELL}, '</tr>'), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus)"
_ORDER = ("n", "p", "q", "row_text")


def _otsl(t):
    rows = F.sort_array(F.collect_list(F.struct(*_ORDER)))
    return t.otsl_rows.groupBy("order_key").agg(F.array_join(F.transform(rows, lambda x: x["row_text"]), "").alias("otsl"))


def _oracle_rows(where: str = "TRUE") -> str:
    return f"SELECT l_orderkey AS order_key, string_agg(concat('<tr>', {_CELL}, '</tr>'), '' ORDER BY l_linenumber, l_partkey, l_suppkey, concat('<fcel>', CAST(l_quantity AS int))) AS trs, count(*) AS n FROM lineitem WHERE {where} GROUP BY l_orderkey"


@query("f1_otsl_simple", sql=f"SELECT order_key, concat('<table>', trs, '</table>') AS html FROM ({_oracle_rows()})")
def f1(t):
    return _otsl(t).select("order_key", tables.otsl_html_udf("otsl").alias("html"))


_HEAD = "<tr><td>qty</td><td>part</td><td>status</td></tr>"


def _halves(t):
    """(order_key, previous, current): the tables of the first three lines and of the others, each under the header."""
    half = lambda keep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct(*_ORDER)))), lambda x: x["row_text"]), "")
    both = t.otsl_rows.groupBy("order_key").agg(half(F.col("n") <= 3).alias("a"), half(F.col("n") > 3).alias("b")).filter("a <> '' and b <> ''")
    headed = lambda c: tables.otsl_html_udf(F.concat(F.lit("<fcel>qty<fcel>part<fcel>status<nl>"), F.col(c)))
    return both.select("order_key", headed("a").alias("previous"), headed("b").alias("current"))


_BOTH = f"({_oracle_rows('l_linenumber <= 3')}) a JOIN ({_oracle_rows('l_linenumber > 3')}) b USING (order_key)"
# Data rows that repeat, too, count as header rows, up to five.
_LEADING = f"""(SELECT order_key, a_trs, br, coalesce(list_position(list_transform(range(1, m + 1), lambda i: ar[i] = br[i]), false) - 1, m) AS k FROM (SELECT *, least(len(ar), len(br), 4) AS m FROM (
  SELECT order_key, a.trs AS a_trs, regexp_extract_all(a.trs, '<tr>.*?</tr>') AS ar, regexp_extract_all(b.trs, '<tr>.*?</tr>') AS br FROM {_BOTH})))"""


@query("f40_table_merge_flat", sql=f"SELECT order_key, concat('<table>{_HEAD}', a_trs, array_to_string(br[k + 1:], ''), '</table>') AS html FROM {_LEADING}")
def f40(t):
    return _halves(t).select("order_key", tables.merge_udf("previous", "current", F.lit(400), F.lit(410)).alias("html"))


@query("f39_header_detection_flat", sql=f"SELECT order_key, (k + 1)::INTEGER AS headers FROM {_LEADING}")
def f39(t):
    return _halves(t).select("order_key", tables.header_rows_udf("previous", "current").alias("headers"))


@query("e10_table_shape_flat", sql=f'SELECT order_key, n::INTEGER AS "rows", 3 AS "columns", 3 AS "last", 0 AS tail FROM ({_oracle_rows()})')
def e10(t):
    return _otsl(t).select("order_key", tables.shape_udf(tables.otsl_html_udf("otsl")).alias("s")).select("order_key", "s.*")


@query("f36_table_cells_flat", sql=f"SELECT order_key, unnest(regexp_extract_all(trs, '<td>(.*?)</td>', 1)) AS cell FROM ({_oracle_rows()})")
def f36(t):
    html = _otsl(t).select("order_key", tables.otsl_html_udf("otsl").alias("html"))
    return html.select("order_key", F.explode(F.regexp_extract_all("html", F.lit("<td>(.*?)</td>"), F.lit(1))).alias("cell"))


@query("f37_span_attributes", "marked", sql="""SELECT doc_id, coalesce(nullif(regexp_extract(s, 'colspan="([1-9][0-9]*)"', 1), '')::INTEGER, 1) AS colspan, contains(s, '<table') AS is_table FROM marked""")
def f37(t):
    return t.marked.select("doc_id", text.span_attribute(F.col("s"), "colspan").alias("colspan"), F.contains("s", F.lit("<table")).alias("is_table"))


@query("f31_entity_decode")
def f31(t):
    return t.pages.select("page_id", tables.unescape_udf("html").alias("html"))


@query("f7_left_right_balance", "marked", sql=r"SELECT doc_id, concat(s, '\left( x \right) \left.\right]') AS s FROM marked")  # no text has sides of its own
def f7(t):
    return t.marked.select("doc_id", formulas.balance_sides_udf(F.concat("s", F.lit("\\left( x \\right) \\right]"))).alias("s"))


@query("f8_unmatched_braces", "marked", sql=r"SELECT doc_id, concat('{a \{ b}  ', s) AS s FROM marked")  # no text has braces of its own
def f8(t):
    return t.marked.select("doc_id", formulas.drop_unmatched_braces_udf(F.concat(F.lit("{a \\{ b} } "), "s")).alias("s"))


@query("f6_equation_normaliser", "marked", sql=f"SELECT doc_id, {_STRIP} AS s FROM marked")  # no text has sides or braces of its own
def f6(t):
    return t.marked.select("doc_id", formulas.normalise_udf("s").alias("s"))


@query("f11_blank_underscores", "marked", sql=r"SELECT doc_id, concat(s, ' \(a\) ___ \(b\)') AS s FROM marked")  # no text has blanks of its own
def f11(t):
    return t.marked.select("doc_id", formulas.move_blanks_udf(F.concat("s", F.lit(" \\(a ___ b\\)"))).alias("s"))


@query("f42_whole_text_period", "marked")
def f42(t):
    return t.marked.select("doc_id", formulas.period_udf("s").alias("periodic"))


@query("f17_span_splitter", "marked", sql=r"""SELECT doc_id, CASE WHEN len(regexp_extract_all(p, '\\\(')) = len(regexp_extract_all(p, '\\\)')) AND contains(p, '\(') THEN concat('text:', regexp_extract(p, '^(.*?)\\\(', 1, 's'), '|inline_equation:', trim(regexp_extract(p, '\\\((.+?)\\\)', 1)), '|text:', regexp_extract(p, '\\\)(.*)$', 1, 's')) ELSE concat('text:', p) END AS spans
  FROM (SELECT doc_id, CASE WHEN len(regexp_extract_all(s, '\\\[')) = len(regexp_extract_all(s, '\\\]')) THEN regexp_replace(s, '\\\[(.*?)\\\]', '[\1]', 'g') ELSE s END AS p FROM marked)""")
def f17(t):
    parts = F.transform(render.spans(F.col("s")), lambda x: F.concat(x["type"], F.lit(":"), x["content"]))
    return t.marked.select("doc_id", F.array_join(parts, "|").alias("spans"))


@query("f18_equation_and_code_trims", "marked", sql=r"""SELECT doc_id, rtrim(CASE WHEN regexp_matches(x, '^\\\[.*\\\]$', 's') THEN regexp_replace(x, '^\\\[(.*)\\\]$', '\1', 's') ELSE x END) AS equation, concat('a', chr(10), doc_id) AS code FROM (SELECT doc_id, trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM marked)""")
def f18(t):
    fenced = F.concat(F.lit("```py\na\n"), F.col("doc_id").cast("string"), F.lit("\n```\n"))
    return t.marked.select("doc_id", render.equation_content(F.col("s")).alias("equation"), render.code_content(fenced).alias("code"))


_T = "CASE WHEN kind = 'title' THEN concat('# ', content) WHEN kind IN ('text', 'ref_text') THEN content WHEN kind = 'equation' THEN concat('$$', chr(10), content, chr(10), '$$') WHEN kind = 'table' THEN content WHEN kind = 'code' THEN concat('```txt', chr(10), content, chr(10), '```') ELSE '' END"


@query("f30_block_markdown", "blocks", sql=f"SELECT doc_id, page_idx, block_idx, {_T} AS markdown FROM blocks")
def f30(t):
    return t.blocks.select("doc_id", "page_idx", "block_idx", render.markdown_block(F.col("kind"), F.col("content")).alias("markdown"))


_BOX = "concat('\"bbox\":[', x0, ',', y0, ',', x1, ',', y1, '],\"page_idx\":', page_idx, '}')"
_FLAT = f"""CASE WHEN kind = 'title' THEN concat('{{"type":"text","text":"', content, '","text_level":1,', {_BOX}) WHEN kind = 'equation' THEN concat('{{"type":"equation","text":"', content, '","text_format":"latex",', {_BOX})
  WHEN kind = 'table' THEN concat('{{"type":"table","img_path":"","table_caption":[],"table_footnote":[],"table_body":"', content, '",', {_BOX}) ELSE concat('{{"type":"', kind, '","text":"', content, '",', {_BOX}) END"""


@query("f27_flat_content_list", "blocks", sql=f'SELECT doc_id, page_idx, block_idx, {_FLAT} AS "row" FROM blocks')
def f27(t):
    return render.flat_rows(t.blocks)


@query("b3_final_documents", "blocks", sql=f"SELECT doc_id, concat('[', string_agg({_FLAT}, ',' ORDER BY page_idx, block_idx), ']') AS content_list, string_agg(CASE WHEN trim({_T}) <> '' THEN {_T} END, chr(10) || chr(10) ORDER BY page_idx, block_idx) AS markdown FROM blocks GROUP BY doc_id")
def b3(t):
    return render.documents(t.blocks)


_MID = """concat('{"type":"', kind, '","bbox":[', x0, ',', y0, ',', x1, ',', y1, '],"index":', block_idx, ',"lines":[{"spans":[{"type":"text","content":"', content, '"}]}]}')"""
_CH = "kind IN ('header', 'footer', 'page_number', 'aside_text', 'page_footnote')"


@query("f29_middle_pages", "blocks", sql=f"SELECT doc_id, page_idx, concat('[', coalesce(string_agg(CASE WHEN NOT {_CH} THEN {_MID} END, ',' ORDER BY block_idx), ''), ']') AS para_blocks, concat('[', coalesce(string_agg(CASE WHEN {_CH} THEN {_MID} END, ',' ORDER BY block_idx), ''), ']') AS discarded_blocks FROM blocks GROUP BY ALL")
def f29(t):
    return render.middle(t.blocks)
