"""Queries over requests, archives, service state, assets and previews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire import sinks
from quire.functions import formulas, service, text
from quire.operators import ordered, pages
from quire.plans.registry import query
from quire.plans.texts import _INLINE, _SPACED

col, when, lit = F.col, F.when, F.lit  # short names: the rules below are mostly made of them


@query("a18_native_reasons", "plan_docs", sql="""SELECT doc_id, array_to_string(list_filter([CASE WHEN n_pages = 0 THEN 'empty_pdf' END, CASE WHEN n_pages > 20 THEN 'page_limit' END, CASE WHEN width % 7 = 0 THEN 'images_present' END, CASE WHEN width % 7 = 0 OR height % 5 = 0 THEN 'mixed_pdf' END,
  CASE WHEN height % 3 = 0 THEN 'ocr_required' END, CASE WHEN bytes < 9000 THEN 'low_confidence' END], lambda x: x IS NOT NULL), ',') AS reasons FROM plan_docs""")
def a18(t):
    c = service.native_reasons(col("n_pages"), 20, col("width") % 7 == 0, col("height") % 5 == 0, col("height") % 3 == 0, col("bytes"), 9000)
    return t.plan_docs.select("doc_id", F.array_join(c, ",").alias("reasons"))


@query("a22_chat_requests", "responses", sql="""SELECT doc_id, concat('{"model":"m","temperature":', CASE WHEN doc_id % 2 = 0 THEN '0.5' ELSE '0.0' END, CASE WHEN doc_id % 3 = 0 THEN ',"top_k":1' ELSE '' END, ',"messages":[{"role":"system","content":"You are a helpful assistant."},{"role":"user","content":"', 'page ', doc_id, '"}]}') AS body FROM responses""")
def a22(t):
    asked = {"temperature": when(col("doc_id") % 2 == 0, 0.5), "top_k": when(col("doc_id") % 3 == 0, 1)}
    body = service.chat_body("m", F.concat(lit("page "), col("doc_id").cast("string")), asked, {"temperature": 0.0, "top_k": None})
    return t.responses.select("doc_id", body.alias("body"))


_MAGIC = "CASE CAST(doc_id % 6 AS int) WHEN 0 THEN '89504E470D0A1A0A0000' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '4749463839' WHEN 3 THEN '424D0000' WHEN 4 THEN '524946460000000057454250' ELSE '00010203' END"


@query("a27_image_admission", sql=f"SELECT doc_id, CASE CAST(doc_id % 6 AS int) WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/bmp' WHEN 4 THEN 'image/webp' END AS media, octet_length(unhex({_MAGIC})) <= 10 AS fits FROM documents")
def a27(t):
    url = F.concat(lit("data:image/png;base64,"), F.base64(F.unhex(F.expr(_MAGIC))))
    data = F.unbase64(F.regexp_extract(url, "^data:([^,;]+);base64,(.*)$", 2))
    return t.documents.select("doc_id", text.image_media(data).alias("media"), (F.octet_length(data) <= 10).alias("fits"))


@query("a30_archive_paths", "names", sql=r"""SELECT id, name <> '' AND NOT contains(name, '\') AND NOT regexp_matches(name, '[\x00-\x1f\x7f]') AND len(list_filter(string_split(CASE WHEN length(name) > 1 AND ends_with(name, '/') AND NOT ends_with(name, '//') THEN left(name, length(name) - 1) ELSE name END, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS safe FROM names""")
def a30(t):
    return t.names.select("id", text.archive_path_is_safe(col("name")).alias("safe"))


@query("a32_middle_reader", "blocks", sql="SELECT doc_id, page_idx, block_idx, kind FROM blocks")
def a32(t):
    from quire.sources import results

    block = F.struct(col("kind").alias("type"), col("block_idx").alias("index"))
    chrome = col("kind").isin("header", "footer", "page_number")
    page = t.blocks.groupBy("doc_id", "page_idx").agg(F.collect_list(when(~chrome, block)).alias("preproc_blocks"), F.collect_list(when(chrome, block)).alias("discarded_blocks"))
    files = page.groupBy("doc_id").agg(F.to_json(F.struct(F.collect_list(F.struct("page_idx", "preproc_blocks", "discarded_blocks")).alias("pdf_info"))).alias("json"))
    return results.middle_blocks(files, "doc_id", "json")


@query("a33_submit_form", "plan_docs", sql="""SELECT doc_id, concat('backend=vlm-http-client&start_page_id=', first_page, '&end_page_id=', coalesce(last_page, 99999), '&return_md=', CASE WHEN doc_id % 2 = 0 THEN 'false' ELSE 'true' END, CASE WHEN doc_id % 3 = 0 THEN '&server_url=u' ELSE '' END) AS form FROM plan_docs""")
def a33(t):
    form = service.submit_form(col("first_page"), col("last_page"), when(col("doc_id") % 3 == 0, "u").otherwise(""), col("doc_id") % 2 == 0)
    return t.plan_docs.select("doc_id", form.alias("form"))


@query("a34_health", "plan_docs", sql="SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND n_pages > 1 AS healthy, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND n_pages > 1 THEN greatest(first_page, 1) END AS \"window\" FROM plan_docs")
def a34(t):
    sent = F.to_json(F.struct(when(col("doc_id") % 3 != 0, "healthy").otherwise("busy").alias("status"), when(col("doc_id") % 4 != 0, 2).otherwise(1).alias("protocol_version"), (col("n_pages") - 1).alias("max_concurrent_requests"), col("first_page").alias("processing_window_size")))
    return t.plan_docs.select("doc_id", service.health(sent).alias("h")).select("doc_id", "h.healthy", "h.window")


@query("a35_operator_pins", "plan_docs", sql="SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 ELSE true END AS formula, CASE WHEN doc_id % 5 = 0 THEN false ELSE doc_id % 7 = 0 END AS \"table\" FROM plan_docs")
def a35(t):
    formula = service.resolved(when(col("doc_id") % 3 == 0, col("doc_id") % 2 == 0), lit(True))
    table = service.resolved(when(col("doc_id") % 5 == 0, lit(False)), col("doc_id") % 7 == 0)
    return t.plan_docs.select("doc_id", formula.alias("formula"), table.alias("table"))


@query("a38_inherited_attributes", sql="WITH RECURSIVE up AS (SELECT doc_id, doc_id AS node, 0 AS step FROM documents UNION ALL SELECT doc_id, node // 2 AS node, step + 1 AS step FROM up WHERE node > 0 AND node % 7 <> 3 AND step < 32) SELECT doc_id, arg_max(node, step) FILTER (WHERE node % 7 = 3) AS unit FROM up GROUP BY doc_id")
def a38(t):
    # The chain of parents is cut at a fixed depth, which also ends cycles; a tree of that depth holds any document.
    chain = F.array(*[F.floor(col("doc_id") / 2**k).cast("long") for k in range(33)])
    return t.documents.select("doc_id", service.inherited(chain, lambda x: x % 7 == 3).alias("unit"))


@query("a39_limit_resolution", "plan_docs", sql="SELECT doc_id, coalesce(last_page, CASE WHEN doc_id % 3 = 0 THEN 7 END, 64) AS most_pages FROM plan_docs")
def a39(t):
    return t.plan_docs.select("doc_id", service.resolved(col("last_page"), when(col("doc_id") % 3 == 0, 7), lit(64)).alias("most_pages"))


_ASSETS = """SELECT doc_id, concat(CASE WHEN l_linenumber = 7 THEN 'img/' ELSE 'images/' END, l_partkey % 20, CASE WHEN l_linenumber = 6 THEN '.' ELSE '.jpg' END) AS path, l_suppkey % 2 AS version, CAST(l_suppkey * 10 AS bigint) AS bytes FROM (SELECT *, CAST(floor(l_orderkey / 40) AS bigint) AS doc_id FROM lineitem) x"""


@query("b4_asset_faults", sql=f"SELECT doc_id, path, CASE WHEN NOT starts_with(path, 'images/') OR ends_with(path, '.') THEN 'not portable' ELSE 'two contents' END AS fault FROM ({_ASSETS}) GROUP BY doc_id, path HAVING NOT starts_with(path, 'images/') OR ends_with(path, '.') OR count(DISTINCT version) > 1")
def b4(t):
    assets = t.spark.sql(_ASSETS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t.lineitem)
    return sinks.asset_faults(assets.withColumn("sha256", col("version").cast("string")))


@query("b4_asset_budget", sql=f"SELECT doc_id, path, (sum(bytes) OVER (PARTITION BY doc_id ORDER BY path))::BIGINT AS upto, sum(bytes) OVER (PARTITION BY doc_id ORDER BY path) > 20000 AS over FROM (SELECT doc_id, path, max(bytes) AS bytes FROM ({_ASSETS}) GROUP BY ALL)")
def b4b(t):
    assets = t.spark.sql(_ASSETS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t.lineitem).groupBy("doc_id", "path").agg(F.max("bytes").alias("bytes"))
    return sinks.unique_assets(assets, 20_000).select("doc_id", "path", "upto", "over")


@query("b6_preview_rectangles", "blocks", sql="""SELECT doc_id, page_idx, block_idx, round(CASE r WHEN 0 THEN 50 + ux * 500 WHEN 90 THEN 50 + uy * 500 WHEN 180 THEN 550 - ux * 500 ELSE 50 + (1 - uy) * 500 END, 6)::DOUBLE AS px, round(CASE r WHEN 0 THEN 720 - uy * 700 WHEN 90 THEN 20 + ux * 700 WHEN 180 THEN 20 + uy * 700 ELSE 20 + (1 - ux) * 700 END, 6)::DOUBLE AS py,
  CASE WHEN kind IN ('header', 'footer', 'page_number') THEN '158,158,158' WHEN kind = 'code' THEN '102,0,204' WHEN kind = 'table' THEN '204,204,0' WHEN kind = 'table_caption' THEN '255,255,102' WHEN kind IN ('image', 'image_block', 'chart') THEN '153,255,51' WHEN kind = 'image_caption' THEN '102,178,255'
  WHEN kind = 'image_footnote' THEN '255,178,102' WHEN kind = 'title' THEN '102,102,255' WHEN kind = 'equation' THEN '0,255,0' WHEN kind = 'list' THEN '40,169,92' ELSE '153,0,76' END AS colour FROM (SELECT *, x0 / 1000.0::DOUBLE AS ux, y0 / 1000.0::DOUBLE AS uy, coalesce(angle, 0) AS r FROM blocks)""")
def b6(t):
    from quire.functions import preview

    px, py = preview.on_page(col("x0") / 1000, col("y0") / 1000, (50, 20, 550, 720), F.coalesce("angle", lit(0)))
    return t.blocks.select("doc_id", "page_idx", "block_idx", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"), preview.colour(col("kind")).alias("colour"))


@query("b7_result_members", "plan_docs", sql="SELECT doc_id, kind FROM plan_docs, (VALUES ('md'), ('middle_json'), ('model'), ('content_list'), ('images')) m(kind) WHERE CASE kind WHEN 'md' THEN doc_id % 2 = 0 WHEN 'images' THEN doc_id % 3 = 0 WHEN 'content_list' THEN doc_id % 5 = 0 ELSE true END")
def b7(t):
    wanted = {"md": col("doc_id") % 2 == 0, "images": col("doc_id") % 3 == 0, "content_list": col("doc_id") % 5 == 0}
    return t.plan_docs.select("doc_id", F.explode(service.result_members(wanted)).alias("kind"))


@query("b8_json_results", "plan_docs", sql="""SELECT doc_id, concat('{"backend":"vlm","version":"1","results":{"d', doc_id, '":{"md_content":"# ', n_pages, '"', CASE WHEN doc_id % 2 = 0 THEN ',"images":{"a.jpg":"data:image/jpeg;base64,eA=="}' ELSE '' END, '}}}') AS json FROM plan_docs""")
def b8(t):
    images = when(col("doc_id") % 2 == 0, F.create_map(lit("a.jpg"), lit("x").cast("binary")))
    json = service.json_result(F.concat(lit("d"), col("doc_id").cast("string")), F.concat(lit("# "), col("n_pages").cast("string")), images, "vlm", "1")
    return t.plan_docs.select("doc_id", json.alias("json"))


@query("c22_page_checks", "plan_docs", sql="SELECT doc_id, width > 300 AND (prev IS NULL OR doc_id > prev) AND ceil(width * 2)::INTEGER = width * 2 - CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS fine FROM (SELECT *, lag(doc_id) OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) AS prev FROM plan_docs)")
def c22(t):
    rendered = col("width") * 2 - when(col("doc_id") % 9 == 0, 1).otherwise(0)
    p = t.plan_docs.select((col("doc_id") % 10).alias("batch"), "doc_id", "width", rendered.alias("rendered"))
    return pages.consistent(p, "batch", "doc_id", "width", "rendered", 2, 300).select("doc_id", "fine")


@query("c23_empty_nodes", "blocks", sql="SELECT doc_id, page_idx, block_idx, kind NOT IN ('table', 'image', 'chart', 'code', 'image_block') AND (kind = 'list' OR content LIKE '%and') AS empty FROM blocks")
def c23(t):
    spans = when((col("kind") == "list") | col("content").endswith("and"), F.array().cast("array<string>")).otherwise(F.array("content"))
    return t.blocks.select("doc_id", "page_idx", "block_idx", (~col("kind").isin(*ordered.VISUAL) & (F.size(spans) == 0)).alias("empty"))


_IN = "greatest(least(i.x1, o.x1) - greatest(i.x0, o.x0), 0) * greatest(least(i.y1, o.y1) - greatest(i.y0, o.y0), 0) * 10 > (i.x1 - i.x0) * (i.y1 - i.y0) * 9"


@query("c26_container_demotion", "blocks", sql=f"SELECT doc_id, page_idx, block_idx, CASE WHEN kind = 'image_block' AND NOT EXISTS (SELECT 1 FROM blocks i WHERE i.doc_id = o.doc_id AND i.page_idx = o.page_idx AND i.block_idx <> o.block_idx AND i.kind IN ('image', 'chart', 'table') AND {_IN}) THEN 'image' ELSE kind END AS kind FROM blocks o")
def c26(t):
    from quire.operators import spatial

    held = spatial.containers(t.blocks).filter("container_kind = 'image_block'").select("doc_id", "page_idx", col("container_idx").alias("block_idx"), lit(1).alias("held"))
    kind = when((col("kind") == "image_block") & col("held").isNull(), "image").otherwise(col("kind"))
    return t.blocks.join(held, ["doc_id", "page_idx", "block_idx"], "left").select("doc_id", "page_idx", "block_idx", kind.alias("kind"))


@query("c18_resolved_containers", "blocks")
def c18(t):
    return pages.without_containers(t.blocks)


@query("d8_visual_parents", "blocks")
def d8(t):
    from quire.operators import spatial

    return spatial.visual_parents(t.blocks)


def _near_above_sql(box: str, below: str) -> str:
    gap = f"({below}y0 - {box}y1)"
    side = f"greatest(greatest({below}x1 - {below}x0, 1) * 3 // 100, 12)"
    return f"({gap} >= 0 AND {gap} <= greatest(greatest({box}y1 - {box}y0, 1) * 3 // 2, 12) AND {box}x1 + {side} >= {below}x0 AND {box}x0 - {side} <= {below}x1)"


_CHROME = "('header', 'footer', 'page_number', 'aside_text', 'page_footnote')"
_BODY = "('image_body', 'image_block_body', 'table_body', 'chart_body', 'code_body')"


@query("w3_caption_fallbacks", "blocks", sql=f""", k AS (SELECT * REPLACE (CASE WHEN kind IN ('image_caption', 'table_caption', 'code_caption') THEN 'caption' WHEN kind IN ('image_footnote', 'table_footnote') THEN 'footnote'
    WHEN kind IN ('table', 'image', 'chart', 'code', 'image_block') THEN concat(kind, '_body') WHEN kind = 'equation' THEN 'interline_equation' WHEN kind IN ('formula_number', 'index', 'list_item') THEN 'text' ELSE kind END AS kind) FROM blocks),
  r1 AS (SELECT * REPLACE (CASE WHEN kind = 'text' AND p.kind = 'caption' AND p.y0 < y1 AND p.y1 > y0 AND n.kind IN {_BODY} AND {_near_above_sql("", "n.")} THEN 'caption' ELSE kind END AS kind)
    FROM (SELECT *, lag(row(kind, y0, y1)::STRUCT(kind VARCHAR, y0 INT, y1 INT)) OVER w AS p, lead(row(kind, x0, y0, x1, y1)::STRUCT(kind VARCHAR, x0 INT, y0 INT, x1 INT, y1 INT)) OVER w AS n FROM k WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY block_idx))),
  m AS MATERIALIZED (SELECT *, coalesce(min(block_idx) FILTER (WHERE kind NOT IN {_CHROME}) OVER (PARTITION BY doc_id, page_idx) = block_idx, false) AS first FROM r1),
  near AS MATERIALIZED (SELECT b.doc_id, b.page_idx, b.block_idx, t.block_idx AS t_idx, b.kind, b.content, b.first, {_near_above_sql("b.", "t.")} AS near FROM m b JOIN m t ON b.doc_id = t.doc_id AND b.page_idx = t.page_idx AND b.block_idx < t.block_idx AND t.kind = 'table_body'),
  hit AS (SELECT DISTINCT a.doc_id, a.page_idx, a.block_idx FROM near a WHERE a.first AND a.near AND a.kind = 'text' AND regexp_matches(lower(a.content), 'continued|continuation|续表')
    OR a.kind IN ('text', 'footnote') AND NOT contains(a.content, chr(10)) AND a.near
      AND NOT EXISTS (SELECT 1 FROM near c WHERE c.doc_id = a.doc_id AND c.page_idx = a.page_idx AND c.t_idx = a.t_idx AND c.block_idx > a.block_idx AND NOT c.near)
      AND EXISTS (SELECT 1 FROM near c WHERE c.doc_id = a.doc_id AND c.page_idx = a.page_idx AND c.t_idx = a.t_idx AND c.block_idx > a.block_idx AND c.kind = 'caption'))
  SELECT doc_id, page_idx, block_idx, CASE WHEN hit.block_idx IS NOT NULL THEN 'caption' ELSE m.kind END AS kind FROM m LEFT JOIN hit USING (doc_id, page_idx, block_idx)""")
def w3(t):
    from quire.functions import kinds

    return pages.with_captions(t.blocks.withColumn("kind", F.coalesce(kinds.builder_kind(col("kind")), col("kind"))))


@query("d11_relationship_overrides", "names", sql="SELECT n.id, coalesce(o.kind, n.suffix) AS kind FROM names n LEFT JOIN (SELECT suffix, min(upper(suffix)) AS kind FROM names WHERE id % 3 = 0 GROUP BY suffix) o USING (suffix)")
def d11(t):
    overrides = t.names.filter("id % 3 = 0").groupBy("suffix").agg(F.min(F.upper("suffix")).alias("kind"))
    return ordered.overridden(t.names.select("id", "suffix"), overrides, "suffix", "kind").select("id", "kind")


@query("e1_page_folds", "blocks", sql="SELECT doc_id, page_idx, count(*) AS n_blocks, count(DISTINCT kind) AS n_kinds, string_agg(kind, ',' ORDER BY block_idx) AS kinds FROM blocks GROUP BY ALL")
def e1(t):
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "kind"))), lambda x: x["kind"])
    return t.blocks.groupBy("doc_id", "page_idx").agg(F.count("*").alias("n_blocks"), F.count_distinct("kind").alias("n_kinds"), F.array_join(kinds, ",").alias("kinds"))


@query("w7_line_join_lookahead", "blocks", sql="SELECT doc_id, page_idx, block_idx, CASE WHEN content LIKE '%and' AND regexp_matches(nxt, '^[a-z]') THEN left(content, length(content) - 3) || nxt ELSE content END AS joined FROM (SELECT *, lead(content) OVER (PARTITION BY doc_id, page_idx ORDER BY block_idx) AS nxt FROM blocks)")
def w7(t):
    b = t.blocks.withColumn("next", F.lead("content").over(ordered.by_page()))
    joined = when(col("content").endswith("and") & col("next").rlike("^[a-z]"), F.concat(F.expr("left(content, length(content) - 3)"), col("next"))).otherwise(col("content"))
    return b.select("doc_id", "page_idx", "block_idx", joined.alias("joined"))


@query("s1_stable_input_order", "names", sql="SELECT id, (row_number() OVER (ORDER BY name, id) - 1)::INTEGER AS place FROM names")
def s1(t):
    return ordered.numbered(t.names.select("id", "name"), ["name", "id"], "place").select("id", F.col("place").cast("int").alias("place"))


@query("s2_node_order", "blocks", sql="SELECT doc_id, page_idx, string_agg(block_idx::VARCHAR, ',' ORDER BY y0, x0, block_idx) AS nodes FROM blocks GROUP BY ALL")
def s2(t):
    nodes = F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "block_idx"))), lambda x: x["block_idx"].cast("string"))
    return t.blocks.groupBy("doc_id", "page_idx").agg(F.array_join(nodes, ",").alias("nodes"))


@query("s3_children_order", "blocks", sql="SELECT doc_id, page_idx, string_agg(block_idx::VARCHAR, ',' ORDER BY block_idx) AS children FROM blocks WHERE kind IN ('table', 'table_caption', 'image_footnote') GROUP BY ALL")
def s3(t):
    part = lambda kind: F.collect_list(when(col("kind") == kind, col("block_idx")))
    g = t.blocks.filter("kind in ('table', 'table_caption', 'image_footnote')").groupBy("doc_id", "page_idx").agg(part("table").alias("a"), part("table_caption").alias("b"), part("image_footnote").alias("c"))
    return g.select("doc_id", "page_idx", F.array_join(F.transform(F.array_sort(F.concat("a", "b", "c")), lambda x: x.cast("string")), ",").alias("children"))


@query("s4_batch_order", "responses", sql="SELECT doc_id % 10 AS batch, string_agg(finish, ',' ORDER BY doc_id) AS replies FROM responses GROUP BY ALL")
def s4(t):
    r = t.responses.repartition("tokens").groupBy((col("doc_id") % 10).alias("batch")).agg(F.sort_array(F.collect_list(when(col("finish").isNotNull(), F.struct("doc_id", "finish")))).alias("r"))
    return r.select("batch", F.array_join(F.transform("r", lambda x: x["finish"]), ",").alias("replies"))


@query("u2_children_union", "blocks", sql="SELECT doc_id, page_idx, block_idx, 'body' AS part FROM blocks WHERE kind = 'table' UNION ALL SELECT doc_id, page_idx, block_idx, 'caption' FROM blocks WHERE kind = 'table_caption' UNION ALL SELECT doc_id, page_idx, block_idx, 'footnote' FROM blocks WHERE kind = 'image_footnote'")
def u2(t):
    part = lambda kind, name: t.blocks.filter(col("kind") == kind).select("doc_id", "page_idx", "block_idx", lit(name).alias("part"))
    return part("table", "body").unionByName(part("table_caption", "caption")).unionByName(part("image_footnote", "footnote"))


_AB = "'ACDGHKTWXYZ2345678'"


@query("f4_image_tokens", sql="SELECT doc_id, concat('[', " + ", ".join(f"substr({_AB}, ((doc_id * 37) // {18**p} % 18 + 1)::INTEGER, 1)" for p in (3, 2, 1, 0)) + ", ']') AS token FROM documents")
def f4(t):
    return t.documents.select("doc_id", text.image_token(col("doc_id") * 37).alias("token"))


@query("f19_code_sub_types", "marked", sql=r"SELECT doc_id, CASE WHEN contains(s, '\(') THEN 'algorithm' ELSE 'code' END AS sub_type FROM marked")
def f19(t):
    from quire.operators import render

    maths = F.exists(render.spans(col("s")), lambda x: x["type"] == "inline_equation")
    return t.marked.select("doc_id", when(maths, "algorithm").otherwise("code").alias("sub_type"))


@query("f34_inline_images", "marked", sql="""SELECT doc_id, concat('images/', sha256(concat('data:image/png;base64,', to_base64(encode(doc_id::VARCHAR)))), '.png') AS path FROM marked""")
def f34(t):
    html = F.concat(lit('<img src="data:image/png;base64,'), F.base64(col("doc_id").cast("string").cast("binary")), lit('"/>'))
    return t.marked.select("doc_id", F.concat(lit("images/"), text.inline_images(html)[0]["name"]).alias("path"))


@query("f48_option_enums", "names", sql="SELECT id, CASE b WHEN 'pipeline' THEN b WHEN 'vlm-auto-engine' THEN 'vlm-engine' WHEN 'hybrid-engine' THEN b END AS backend FROM (SELECT id, split_part('pipeline,vlm-auto-engine,hybrid-engine,other', ',', CAST(id % 4 + 1 AS int)) AS b FROM names)")
def f48(t):
    b = F.split_part(lit("pipeline,vlm-auto-engine,hybrid-engine,other"), lit(","), (col("id") % 4 + 1).cast("int"))
    return t.names.select("id", service.backend(b).alias("backend"))


@query("f49_json_truthiness", sql="SELECT doc_id, v, v IN ('1', '\"a\"', '[0]', 'true', '{\"a\":0}') AS truthy FROM (SELECT doc_id, split_part('0|1|\"\"|\"a\"|[]|[0]|true|false|null|{}|{\"a\":0}|0.0', '|', CAST(doc_id % 12 + 1 AS int)) AS v FROM documents) x")
def f49(t):
    v = F.split_part(lit('0|1|""|"a"|[]|[0]|true|false|null|{}|{"a":0}|0.0'), lit("|"), (col("doc_id") % 12 + 1).cast("int"))
    return t.documents.select("doc_id", v.alias("v"), service.truthy(v).alias("truthy"))


@query("f50_form_values", "names", sql="SELECT id, CASE v WHEN 'true' THEN true WHEN 'false' THEN false END AS flag, CASE WHEN regexp_matches(v, '^(0|[1-9][0-9]*)$') THEN v::BIGINT END AS page, CASE WHEN regexp_matches(trim(v), '^[0-9]+(_[0-9]+)*$') AND replace(trim(v), '_', '')::BIGINT > 0 THEN replace(trim(v), '_', '')::BIGINT END AS bytes FROM (SELECT id, split_part('true|false|True|0|007|12|1_000|_1|1__2| 5 |x', '|', CAST(id % 11 + 1 AS int)) AS v FROM names) y")
def f50(t):
    v = F.split_part(lit("true|false|True|0|007|12|1_000|_1|1__2| 5 |x"), lit("|"), (col("id") % 11 + 1).cast("int"))
    return t.names.select("id", text.parsed_boolean(v).alias("flag"), text.parsed_page(v).alias("page"), text.parsed_bytes(v).alias("bytes"))


@query("f54_continuation_captions", "blocks", sql="SELECT doc_id, page_idx, count(*) FILTER (WHERE kind = 'image_footnote') <= 1 AND bool_or(kind = 'table_caption' AND content LIKE '%(continued)%') AS merges FROM blocks GROUP BY ALL")
def f54(t):
    captions = F.collect_list(when(col("kind") == "table_caption", col("content")))
    notes = F.count(when(col("kind") == "image_footnote", 1))
    p = t.blocks.groupBy("doc_id", "page_idx").agg(captions.alias("captions"), notes.alias("notes"))
    return p.select("doc_id", "page_idx", ((col("notes") <= 1) & F.exists("captions", text.is_continued)).alias("merges"))


@query("f55_text_cleaner", "marked", sql=f"SELECT doc_id, {_SPACED} AS s FROM (SELECT doc_id, {_INLINE} AS s FROM marked)")  # no text has blanks of its own
def f55(t):
    return t.marked.select("doc_id", formulas.move_blanks_udf(text.clean_text(col("s"))).alias("s"))


@query("h8_state_counts", "task_events", sql="SELECT state, count(*) AS n FROM (SELECT task_id, coalesce(arg_min(state, row(ts, seq)) FILTER (WHERE state IN ('completed', 'failed')), arg_max(state, row(ts, seq))) AS state FROM task_events GROUP BY task_id) GROUP BY state")
def h8(t):
    from quire.streaming import tasks

    return tasks.current(t.task_events).groupBy("state").agg(F.count("*").alias("n"))
