"""Queries over the assembly of blocks: paragraphs of several lines, the second content list, cleaned blocks, merged cells."""

from __future__ import annotations

from pyspark.sql import functions as F


from quire.functions import tables, text
from quire.operators import cleaning, render
from quire.plans import tables as table_plans
from quire.plans.registry import query
from quire.plans.texts import _ALL_FROM, _ALL_TO, _MARKS, _NARROW_FROM, _NARROW_TO, _WS  # noqa: F401

_CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]"
_F = f"translate(x, '{_NARROW_FROM}', '{_NARROW_TO}')"
_BROKEN = rf"regexp_matches(v, '(^|\s)[A-Za-z]+[{render.HYPHENS}]$')"


@query("f22_paragraph_text", sql=rf"""WITH l AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
  v AS (SELECT doc_id, i, {_F} AS f, trim({_MARKS.format(_MARKS.format(_F))}, {_WS}) AS v FROM l),
  n AS (SELECT *, lead(f) OVER (PARTITION BY doc_id ORDER BY i) AS ahead, max(CASE WHEN trim(f, {_WS}) <> '' THEN i END) OVER (PARTITION BY doc_id) AS final, bool_or(regexp_matches(v, '{_CJK}')) OVER (PARTITION BY doc_id) AS cjk FROM v),
  q AS (SELECT doc_id, string_agg(CASE WHEN v = '' THEN '' WHEN cjk THEN v WHEN {_BROKEN} THEN CASE WHEN coalesce(regexp_matches(ahead, '^[a-z]'), false) THEN left(v, length(v) - 1) ELSE v END ELSE concat(v, CASE WHEN i < final THEN ' ' ELSE '' END) END, '' ORDER BY i) AS s FROM n GROUP BY doc_id)
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN s ELSE regexp_replace(s, '^([ 	]{{0,3}})([+-]|#{{1,6}})([ 	])', '\1\\\2\3') END AS out FROM q""")
def f22(t):
    d = t.documents.filter("text is not null")
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.array(F.struct(F.lit("text").alias("type"), x.alias("content"))))
    # Even ids are items of lists.
    return d.select("doc_id", render.paragraph_text(lines, F.lit("text"), F.col("doc_id") % 2 == 0).alias("out"))


_OWN = """concat('[{"type":"text","content":"', content, '"}]')"""
_BOX = "concat(',\"bbox\":[', x0, ',', y0, ',', x1, ',', y1, ']}')"
_PAGE = "\n  ".join(f"""WHEN kind = '{a}' THEN concat('{{"type":"{b}","content":{{"{b}_content":', {_OWN}, '}}')""" for a, b in (("header", "page_header"), ("footer", "page_footer"), ("page_number", "page_number")))
_VISUAL = "\n  ".join(f"""WHEN kind = '{a}' THEN concat('{{"type":"{a}","content":{{"image_source":{{"path":""}},"content":"', content, '","{a}_caption":[],"{a}_footnote":[]}}')""" for a in ("image", "chart"))


@query("f28_v2_content_list", "blocks", sql=f"""SELECT doc_id, page_idx, block_idx, concat(CASE WHEN kind = 'title' THEN concat('{{"type":"title","content":{{"title_content":', {_OWN}, ',"level":1}}')
  WHEN kind = 'equation' THEN concat('{{"type":"equation_interline","content":{{"math_content":"', content, '","math_type":"latex","image_source":{{"path":""}}}}')
  WHEN kind = 'ref_text' THEN concat('{{"type":"list","content":{{"list_type":"reference_list","list_items":[{{"item_type":"text","item_content":', {_OWN}, '}}]}}')
  WHEN kind = 'list' THEN '{{"type":"list","content":{{"list_type":"text_list","list_items":[]}}'
  {_PAGE}
  WHEN kind = 'table' THEN concat('{{"type":"table","content":{{"image_source":{{"path":""}},"table_caption":[],"table_footnote":[],"html":"', content, '","table_type":"simple_table","table_nest_level":1}}')
  {_VISUAL}
  WHEN kind = 'code' THEN concat('{{"type":"code","content":{{"code_caption":[],"code_content":', {_OWN}, ',"code_language":"txt"}}')
  ELSE concat('{{"type":"paragraph","content":{{"paragraph_content":', {_OWN}, '}}') END, {_BOX}) AS "row" FROM blocks""")
def f28(t):
    return render.v2_rows(t.blocks)


# Pictures and equations of the marked texts: a third each an image, an image block and an equation block.
_MK = "split_part('image,image_block,equation_block,chart,list_item', ',', CAST(doc_id % 5 + 1 AS int))"
_T = f"trim(s, {_WS})"
_PURE = rf"regexp_matches({_T}, '^(?:\$\$.*\$\$|\\\[.*\\\]|\\\(.*\\\))$', 's')"
_TABLE = f"(starts_with(lower({_T}), '<table') AND ends_with(lower({_T}), '</table>'))"


@query("f12_block_kinds", "marked", sql=f"""SELECT doc_id, CASE WHEN k IN ('image', 'image_block', 'chart') AND {_TABLE} THEN 'table' WHEN k <> 'list_item' AND {_PURE} THEN 'equation' WHEN k = 'image_block' AND {_T} <> '' THEN 'image' WHEN k = 'list_item' THEN 'text' ELSE k END AS kind
  FROM (SELECT doc_id, s, {_MK} AS k FROM marked WHERE NOT regexp_matches(s, '(?i)class'))""")
def f12(t):
    m = t.marked.filter("not s rlike '(?i)class'").select("doc_id", F.expr(_MK).alias("kind"), F.col("s").alias("reply"))
    return cleaning.cleaned(m).select("doc_id", "kind")


@query("f12_picture_content", "marked", sql=f"SELECT doc_id, CASE WHEN {_T} NOT IN ('', '[Non-Text]') THEN {_T} END AS content FROM marked WHERE NOT regexp_matches(s, '(?i)class') AND NOT {_TABLE} AND NOT {_PURE}")
def f12b(t):
    m = t.marked.filter("not s rlike '(?i)class'").select("doc_id", F.lit("image").alias("kind"), F.col("s").alias("reply"))
    return cleaning.cleaned(m).filter("kind = 'image'").select("doc_id", "content")


@query("f12_block_cleaner", "marked")
def f12c(t):
    kind = F.split_part(F.lit("text,table,equation,image,list_item,code"), F.lit(","), (F.col("doc_id") % 6 + 1).cast("int"))
    return cleaning.cleaned(t.marked.select("doc_id", kind.alias("kind"), F.concat("s", F.lit("<|im_end|>")).alias("reply")))


_ROWS = "SELECT order_key, a_trs, br, k FROM " + table_plans._LEADING
_CELLS = "regexp_extract_all({}, '<td>(.*?)</td>', 1)"


@query("d14_cell_merge", sql=f"""SELECT order_key, concat('<table>{table_plans._HEAD}', CASE WHEN k >= len(br) THEN a_trs WHEN order_key % 2 = 0 THEN concat(up, '<tr><td>', l[1], f[1], '</td><td>', l[2], '</td><td>', l[3], f[3], '</td></tr><tr><td></td><td>', f[2], '</td><td></td></tr>', array_to_string(br[k + 2:], ''))
   ELSE concat(up, '<tr><td>', l[1], f[1], '</td><td>', l[2], f[2], '</td><td>', l[3], f[3], '</td></tr>', array_to_string(br[k + 2:], '')) END, '</table>') AS html
  FROM (SELECT *, {_CELLS.format("ar[len(ar)]")} AS l, {_CELLS.format("br[k + 1]")} AS f, array_to_string(ar[:len(ar) - 1], '') AS up FROM (SELECT *, regexp_extract_all(a_trs, '<tr>.*?</tr>') AS ar FROM ({_ROWS})))""")
def d14(t):
    """Even keys go on in the outer columns, odd ones in all, so that the lower row goes."""
    flags = F.when(F.col("order_key") % 2 == 0, F.array(F.lit(1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(1), F.lit(1)))
    return table_plans._halves(t).select("order_key", tables.merge_cells_udf("previous", "current", F.lit(400), F.lit(410), flags).alias("html"))


@query("d13_column_sources", sql="SELECT l_orderkey AS order_key, count(*) * 3 AS places, (sum(3 * n))::BIGINT AS columns, sum(3 * n)::BIGINT AS cells FROM (SELECT l_orderkey, 1 AS n FROM lineitem) GROUP BY 1")
def d13(t):
    c = tables.column_sources(table_plans._otsl(t).select("order_key", tables.otsl_html_udf("otsl").alias("html")), ["order_key"], "html")
    return c.groupBy("order_key").agg(F.count("*").alias("places"), F.sum("column").alias("columns"), F.sum("cell").alias("cells"))


@query("b9_bundle_faults", sql="""SELECT doc_id AS bundle, list_min(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'assets/a.jpg: unknown entry' END, CASE doc_id % 5 WHEN 0 THEN 'middle_json.json: schema or backend' WHEN 1 THEN 'middle_json.json: empty pages' WHEN 2 THEN 'middle_json.json: invalid JSON' END,
  CASE WHEN doc_id % 13 = 0 THEN 'missing content_list.json' END, CASE WHEN doc_id % 7 = 0 THEN 'notes.txt: unknown entry' WHEN doc_id % 3 = 0 THEN 'model_output.json: empty pages' END], lambda x: x IS NOT NULL)) AS fault FROM documents
  WHERE doc_id % 11 = 0 OR doc_id % 5 < 3 OR doc_id % 13 = 0 OR doc_id % 7 = 0 OR doc_id % 3 = 0""")
def b9(t):
    from quire.sources import bundles

    i = F.col("doc_id")
    middle = (
        F.when(i % 5 == 0, '{"schema_version":"0.9","_backend":"hybrid","pages":[{}]}').when(i % 5 == 1, '{"schema_version":"1.0","_backend":"hybrid","pages":[]}').when(i % 5 == 2, '{"pages"')
        .otherwise('{"schema_version":"1.0","_backend":"hybrid","pages":[{"a":1}]}')
    )
    entry = lambda path, content: F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), content.cast("string").alias("content"))
    entries = [
        entry("markdown.md", F.col("text")), entry("middle_json.json", middle), entry(F.when(i % 13 != 0, "content_list.json"), F.lit("[]")), entry("structured_content.json", F.lit('{"pages":[1]}')),
        entry(F.when(i % 7 == 0, "notes.txt").otherwise("model_output.json"), F.when(i % 3 == 0, "[]").otherwise("[1]")), entry(F.when(i % 11 == 0, "assets/a.jpg").otherwise("images/a.jpg"), F.lit(None)),
    ]
    files = t.documents.select(i.alias("bundle"), F.explode(F.array(*entries)).alias("e")).filter("e.path is not null")
    return bundles.bundle_faults(files.select("bundle", "e.path", F.coalesce(F.octet_length("e.content"), F.lit(0)).alias("bytes"), "e.content"), 1 << 40)
