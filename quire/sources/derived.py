"""Tables of this domain derived from plain tables by expression; the same SQL text runs in Spark and in the oracle.

blocks(doc_id, page_idx, block_idx, kind, x0, y0, x1, y1, angle, merge_prev, content): boxes in whole per-mille.
marked(doc_id, s): made-up texts with formulas, tags, marks and secrets, and the start of one document of sixteen; WHOLE has all texts.  names(id, name): file names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KINDS = "text,title,table,image,image_caption,table_caption,list,ref_text,equation,image_block,header,footer,chart,code,image_footnote,page_number"

BLOCKS = f"""
SELECT doc_id, page_idx, CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY k, n, l_partkey, l_suppkey, l_extendedprice, l_tax, l_discount, l_quantity) - 1 AS int) AS block_idx,
  kind, x0, y0, CAST(least(1000, x0 + w) AS int) AS x1, CAST(least(1000, y0 + h) AS int) AS y1,
  CASE l_partkey % 5 WHEN 0 THEN 90 WHEN 1 THEN 180 WHEN 2 THEN 270 WHEN 3 THEN 0 END AS angle, l_suppkey % 3 = 0 AS merge_prev,
  concat(CASE l_partkey % 4 WHEN 0 THEN 'item ' WHEN 1 THEN 'Item ' WHEN 2 THEN 'the continued ' ELSE '12 ' END, CAST(l_partkey AS string), CASE l_suppkey % 3 WHEN 0 THEN '.' WHEN 1 THEN ' and' ELSE ' (continued)' END) AS content
FROM (
  SELECT *, CAST(floor(l_orderkey / 40) AS bigint) AS doc_id, CAST(floor(l_orderkey / 10) % 4 AS int) AS page_idx, l_orderkey AS k, l_linenumber AS n,
    split_part('{KINDS}', ',', CAST((l_partkey + l_linenumber) % 16 + 1 AS int)) AS kind,
    CAST((l_partkey * 37) % 700 AS int) AS x0, CAST((l_partkey * 91 + l_linenumber * 53) % 700 AS int) AS y0,
    (50 + (l_suppkey * 13) % 200) * (CASE WHEN (l_partkey + l_linenumber) % 16 IN (2, 3, 6, 9) THEN 3 ELSE 1 END) AS w,
    (30 + (l_suppkey * 29) % 150) * (CASE WHEN (l_partkey + l_linenumber) % 16 IN (2, 3, 6, 9) THEN 3 ELSE 1 END) AS h
  FROM lineitem) raw_blocks"""

_B = "chr(92)"  # a backslash, which the engines' literals do not agree on
MARKED = f"""
SELECT doc_id, CASE CAST(doc_id % 16 AS int)
  WHEN 0 THEN concat('see ', {_B}, '[ a + ', CAST(doc_id AS string), ' ', {_B}, '] here')
  WHEN 1 THEN concat('x ', {_B}, '( b', {_B}, 'timesX + ', {_B}, 'top ', {_B}, ') y * z_1 ~ `q` $')
  WHEN 2 THEN concat('$$', {_B}, '[ c = ', CAST(doc_id AS string), ' ', {_B}, ']$$')
  WHEN 3 THEN concat('<table><tr><td>', CAST(doc_id AS string), ' &amp; more</td><td colspan="2"><eq>q</eq></td></tr><tr><td><img src="a.png"/></td><td>"r"</td></tr></table>')
  WHEN 4 THEN concat('Authorization: Bearer abc', CAST(doc_id AS string), ' and api_key = "k', CAST(doc_id AS string), '"; https://example.org/', CAST(doc_id AS string))
  WHEN 5 THEN concat('Table ', CAST(doc_id AS string), ' (continued)')
  WHEN 6 THEN concat('discontinued ', CAST(doc_id AS string), ' continued')
  WHEN 7 THEN concat('  # heading ', CAST(doc_id AS string))
  WHEN 8 THEN concat('- item * ', CAST(doc_id AS string), ' & < >')
  WHEN 9 THEN repeat(concat('repeated', CAST(doc_id AS string), ' '), CAST(doc_id % 9 AS int))
  WHEN 10 THEN repeat(concat('line of text ', CAST(doc_id AS string), chr(10)), CAST(doc_id % 7 AS int))
  WHEN 11 THEN concat('{chr(0xFF11)}{chr(0xFF21)}{chr(0xFF01)} ', CAST(doc_id AS string), ' {chr(0x7D9A)}{chr(0x8868)}')
  WHEN 12 THEN concat('<|class_start|> Pure Table <|class_end|><content>t', CAST(doc_id AS string), '</content>')
  WHEN 13 THEN concat('class: chart', chr(10), 'sub_class: bar', chr(10), 'caption = c', CAST(doc_id AS string), chr(10), '- content: ok')
  WHEN 14 THEN '' ELSE substr(text, 1, 300) END AS s
FROM documents"""

NAMES = """
SELECT page_id AS id, concat(CASE CAST(page_id % 6 AS int) WHEN 0 THEN 'con' WHEN 1 THEN 'a:b|c' WHEN 2 THEN 'Report. ' WHEN 3 THEN '..' WHEN 4 THEN './x/./y' ELSE url END,
  CASE CAST(page_id % 4 AS int) WHEN 0 THEN '' WHEN 1 THEN CAST(page_id AS string) WHEN 2 THEN '?' ELSE '.' END) AS name,
  split_part('PDF,png,Jpeg,tif,docx,xls,csv,htm,epub,webp,odt', ',', CAST(page_id % 11 + 1 AS int)) AS suffix
FROM pages"""

RESPONSES = """
SELECT doc_id, CASE CAST(doc_id % 7 AS int) WHEN 0 THEN 'stop' WHEN 1 THEN 'length' WHEN 2 THEN 'content_filter' WHEN 3 THEN NULL ELSE 'stop' END AS finish,
  doc_id % 11 = 0 AS failed, doc_id % 13 = 0 AS no_choice, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat(substr(text, 1, 40), CASE WHEN doc_id % 2 = 0 THEN '<|im_end|>' ELSE '' END) END AS content, CAST(doc_id % 97 AS int) AS tokens
FROM documents"""

PAGES = """
SELECT doc_id, CAST(ceil(n_chars / 500.0) AS int) AS n_pages, CAST(doc_id % 5 AS int) AS first_page, CASE CAST(doc_id % 4 AS int) WHEN 0 THEN NULL WHEN 1 THEN 99999 ELSE CAST(doc_id % 9 AS int) END AS last_page,
  CAST(200 + doc_id * 7 % 1800 AS int) AS width, CAST(300 + doc_id * 13 % 2600 AS int) AS height, CAST(length(text) * 10 AS bigint) AS bytes
FROM documents"""

TASKS = """
SELECT user_id AS task_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state FROM events"""

OTSL = """
SELECT l_orderkey AS order_key, concat('<fcel>', CAST(CAST(l_quantity AS int) AS string), CASE WHEN l_linenumber = 3 THEN '<ecel>' ELSE concat('<fcel>', l_returnflag, ' & "', CAST(l_partkey AS string), '"') END, '<fcel>', l_linestatus, '<nl>') AS row_text,
  l_linenumber AS n, l_partkey AS p, l_suppkey AS q FROM lineitem"""

#: Tables of the same names and columns that carry the whole text of every document, for the queries NAME_whole.
WHOLE = {"marked": ("SELECT doc_id, text AS s FROM documents", "documents"), "responses": (RESPONSES.replace("substr(text, 1, 40)", "text"), "documents")}
TABLES = {"blocks": (BLOCKS, "lineitem"), "marked": (MARKED, "documents"), "names": (NAMES, "pages"), "responses": (RESPONSES, "documents"), "plan_docs": (PAGES, "documents"), "task_events": (TASKS, "events"), "otsl_rows": (OTSL, "lineitem")}


def load(spark: SparkSession, sf_dir: str, name: str, whole: bool = False) -> DataFrame:
    """A derived table, or a plain one. whole: that of WHOLE if there is one."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, base = WHOLE[name] if whole and name in WHOLE else TABLES[name]
    return spark.sql(sql.replace(f"FROM {base}", "FROM {base}"), base=spark.read.parquet(f"{sf_dir}/{base}.parquet"))


def oracle(sql: str, *names: str, whole: bool = False) -> str:
    """sql over derived tables, for the oracle's engine."""
    made = TABLES | WHOLE if whole else TABLES
    return "WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({made[n][0]})" for n in names) + ("" if sql.lstrip().startswith(",") else " ") + sql
