"""Queries over blocks: layout, kinds, boxes, and the joins of a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import kinds
from quire.operators import layout, spatial
from quire.plans.registry import query

_IN = lambda items: "(" + ", ".join(f"'{x}'" for x in items) + ")"

# Layout text of a page from its blocks: some corners swapped, some boxes empty or off the page, some kinds unknown.
_TOKEN = """concat('<|box_start|>', CAST(CASE WHEN block_idx % 5 = 0 THEN x1 ELSE x0 END AS string), ' ', CAST(y0 AS string), ' ', CAST(CASE block_idx % 5 WHEN 0 THEN x0 WHEN 3 THEN x1 + 400 ELSE x1 END AS string), '  ',
  CAST(CASE WHEN block_idx % 11 = 0 THEN y0 ELSE y1 END AS string), '<|box_end|><|ref_start|>', CASE block_idx % 13 WHEN 4 THEN 'unknown' WHEN 5 THEN 'inline_formula' WHEN 6 THEN 'future_kind' ELSE kind END, '<|ref_end|>',
  CASE angle WHEN 0 THEN '<|rotate_up|>' WHEN 90 THEN '<|rotate_right|>' WHEN 180 THEN '<|rotate_down|>' WHEN 270 THEN '<|rotate_left|>' ELSE '' END, CASE WHEN merge_prev THEN ' <|txt_contd_tgt|>' ELSE ' ' END)"""
_LAYOUT = f", layout_raw AS (SELECT doc_id, page_idx, string_agg({_TOKEN}, '' ORDER BY block_idx) AS layout FROM blocks GROUP BY doc_id, page_idx)"
_RE = "<\\|box_start\\|>([0-9]+)\\s+([0-9]+)\\s+([0-9]+)\\s+([0-9]+)<\\|box_end\\|><\\|ref_start\\|>([A-Za-z0-9_]+)<\\|ref_end\\|>(?:<\\|rotate_(up|right|down|left)\\|>)?"


def _heads(layout_expr: str = "layout") -> str:
    return f"""{_LAYOUT}, hs AS (SELECT doc_id, page_idx, unnest(regexp_extract_all(lx, '{_RE}')) AS tok, unnest(regexp_split_to_array(lx, '{_RE.replace("([0-9]+)", "[0-9]+").replace("([A", "[A").replace("+)<", "+<").replace("(up", "(?:up")}')[2:]) AS tail,
      unnest(range(0, len(regexp_extract_all(lx, '{_RE}')))) AS pos FROM (SELECT doc_id, page_idx, {layout_expr} AS lx FROM layout_raw)),
    hp AS (SELECT doc_id, page_idx, pos::INTEGER AS pos, tail, regexp_extract(tok, '{_RE}', ['a', 'b', 'c', 'd', 'kind', 'rot']) AS p FROM hs),
    hb AS (SELECT doc_id, page_idx, pos, p.kind AS kind, p.rot AS rot, contains(tail, 'txt_contd_tgt') AS continues, least(p.a::DOUBLE, p.c::DOUBLE) AS l, greatest(p.a::DOUBLE, p.c::DOUBLE) AS r, least(p.b::DOUBLE, p.d::DOUBLE) AS t, greatest(p.b::DOUBLE, p.d::DOUBLE) AS b FROM hp),
    parsed AS (SELECT * FROM hb WHERE kind IN {_IN(kinds.LAYOUT_KINDS)} AND l < r AND t < b AND r <= 1000 AND b <= 1000)"""


def _raw(t):
    tokens = F.sort_array(F.collect_list(F.struct("block_idx", F.expr(_TOKEN).alias("token"))))
    return t.blocks.groupBy("doc_id", "page_idx").agg(F.array_join(F.transform(tokens, lambda x: x["token"]), "").alias("layout"))


@query("c1_parse_layout", "blocks", sql=_heads() + " SELECT doc_id, page_idx, pos, kind, (l / 1000)::FLOAT::DOUBLE AS \"left\", (t / 1000)::FLOAT::DOUBLE AS top, (r / 1000)::FLOAT::DOUBLE AS \"right\", (b / 1000)::FLOAT::DOUBLE AS bottom FROM parsed")
def c1(t):
    return layout.parse(_raw(t)).select("doc_id", "page_idx", "pos", "kind", *[F.col(c).cast("double").alias(c) for c in ("left", "top", "right", "bottom")])


@query("c2_continuation_flag", "blocks", sql=_heads() + " SELECT doc_id, page_idx, pos, kind = 'text' AND continues AS merge_prev FROM parsed")
def c2(t):
    return layout.parse(_raw(t)).select("doc_id", "page_idx", "pos", "merge_prev")


@query("c3_rotation_decode", "blocks", sql=_heads() + " SELECT doc_id, page_idx, pos, (CASE rot WHEN 'up' THEN 0 WHEN 'right' THEN 90 WHEN 'down' THEN 180 WHEN 'left' THEN 270 END)::INTEGER AS angle, coalesce((CASE rot WHEN 'up' THEN 0 WHEN 'right' THEN 90 WHEN 'down' THEN 180 WHEN 'left' THEN 270 END), 0)::INTEGER AS snapshot_angle FROM parsed")
def c3(t):
    return layout.parse(_raw(t)).select("doc_id", "page_idx", "pos", "angle", F.coalesce("angle", F.lit(0)).alias("snapshot_angle"))


@query("c4_unknown_to_image", "blocks", sql=_heads("replace(layout, '<|ref_start|>unknown<|ref_end|>', '<|ref_start|>image<|ref_end|>')") + " SELECT kind, count(*) AS n FROM parsed GROUP BY kind")
def c4(t):
    raw = _raw(t).withColumn("layout", layout.keep_unknown(F.col("layout")))
    return layout.parse(raw).groupBy("kind").agg(F.count("*").alias("n"))


@query("s6_blocks_per_page_cap", "blocks", sql=_heads() + " SELECT doc_id, page_idx, count(*) AS n_blocks, count(*) > 16 AS over FROM parsed GROUP BY ALL")
def s6(t):
    return layout.over_cap(layout.parse(_raw(t)), ["doc_id", "page_idx"], 16)


def _unit():
    return tuple((F.col(c) / 1000).cast("float") for c in ("x0", "y0", "x1", "y1"))


@query("c5_bbox_validation", "blocks", sql="SELECT doc_id, page_idx, block_idx, x0 - 100 >= 0 AND x0 - 100 < x1 - 100 AND x1 + 50 <= 1000 AND x0 - 100 < x1 + 50 AND y0 < y1 AS valid FROM blocks")
def c5(t):
    b = ((F.col("x0") - 100) / 1000.0, F.col("y0") / 1000.0, (F.col("x1") + 50) / 1000.0, F.col("y1") / 1000.0)
    return t.blocks.select("doc_id", "page_idx", "block_idx", g.is_valid(b).alias("valid"))


@query("c6_point_projection", "blocks", sql="SELECT doc_id, page_idx, block_idx, " + ", ".join(f"trunc(({c}::DOUBLE / 1000)::FLOAT * {s}::FLOAT)::INTEGER AS p{c}" for c, s in (("x0", 595.28), ("y0", 841.89), ("x1", 595.28), ("y1", 841.89))) + " FROM blocks")
def c6(t):
    p = g.points(_unit(), F.lit(595.28), F.lit(841.89))
    return t.blocks.select("doc_id", "page_idx", "block_idx", *[c.alias(n) for c, n in zip(p, ("px0", "py0", "px1", "py1"), strict=True)])


@query("c7_per_mille_projection", "blocks", sql="SELECT doc_id, page_idx, block_idx, " + ", ".join(f"trunc(({c} * 1000)::FLOAT / {s}::FLOAT)::INTEGER AS p{c}" for c, s in (("x0", 1224), ("y0", 1584), ("x1", 1224), ("y1", 1584))) + " FROM blocks")
def c7(t):
    p = g.per_mille(tuple(F.col(c).cast("float") for c in ("x0", "y0", "x1", "y1")), F.lit(1224), F.lit(1584))
    return t.blocks.select("doc_id", "page_idx", "block_idx", *[c.alias(n) for c, n in zip(p, ("px0", "py0", "px1", "py1"), strict=True)])


@query("c8_asset_crop", "blocks", sql="""SELECT doc_id, page_idx, block_idx, concat('images/', sha256(concat(kind, '/', upper(md5(doc_id::VARCHAR)), '_', page_idx, '_', greatest(floor(x0 * 2.5), 0)::INTEGER, '_', greatest(floor(y0 * 2.5), 0)::INTEGER, '_',
  least(ceil(x1 * 2.5), 2000)::INTEGER, '_', least(ceil(y1 * 2.5), 2400)::INTEGER)), '.jpg') AS path FROM blocks WHERE kind IN ('table', 'image', 'chart', 'equation')""")
def c8(t):
    rect = g.asset_rect(g.box(), F.lit(2000), F.lit(2400), 2.5)
    path = g.asset_path(F.col("kind"), F.md5(F.col("doc_id").cast("string")), F.col("page_idx"), rect)
    return t.blocks.filter(F.col("kind").isin("table", "image", "chart", "equation")).select("doc_id", "page_idx", "block_idx", path.alias("path"))


@query("c9_semantic_crop", "blocks", sql="""SELECT doc_id, page_idx, block_idx, x AS cx, y AS cy, rr - x AS cw, bb - y AS ch FROM (SELECT *, least(greatest(ceil((x1::DOUBLE / 1000)::FLOAT * 1036::FLOAT), x + 1), 1036)::INTEGER AS rr, least(greatest(ceil((y1::DOUBLE / 1000)::FLOAT * 777::FLOAT), y + 1), 777)::INTEGER AS bb
  FROM (SELECT *, greatest(least(floor((x0::DOUBLE / 1000)::FLOAT * 1036::FLOAT), 1035), 0)::INTEGER AS x, greatest(least(floor((y0::DOUBLE / 1000)::FLOAT * 777::FLOAT), 776), 0)::INTEGER AS y FROM blocks))""")
def c9(t):
    r = g.crop(_unit(), F.lit(1036), F.lit(777))
    return t.blocks.select("doc_id", "page_idx", "block_idx", *[c.alias(n) for c, n in zip(r, ("cx", "cy", "cw", "ch"), strict=True)])


@query("c10_resize_policy", "blocks", sql="""SELECT doc_id, page_idx, block_idx, (CASE WHEN e < 28 THEN ceil(w::FLOAT * (28::FLOAT / e::FLOAT)::FLOAT) ELSE w END)::INTEGER AS out_w, (CASE WHEN e < 28 THEN ceil(h::FLOAT * (28::FLOAT / e::FLOAT)::FLOAT) ELSE h END)::INTEGER AS out_h FROM (
  SELECT *, greatest(least(w, h), 1) AS e FROM (SELECT doc_id, page_idx, block_idx, CASE WHEN greatest(ow, oh) > least(ow, oh) * 50 AND ow < oh THEN ceil(oh / 50.0) ELSE ow END::INTEGER AS w, CASE WHEN greatest(ow, oh) > least(ow, oh) * 50 AND ow >= oh THEN ceil(ow / 50.0) ELSE oh END::INTEGER AS h
    FROM (SELECT *, x1 - x0 AS ow, (y1 - y0) // 16 + 1 AS oh FROM blocks)))""")
def c10(t):
    w, h = g.padded(F.col("x1") - F.col("x0"), (F.floor((F.col("y1") - F.col("y0")) / 16) + 1).cast("int"))
    return t.blocks.select("doc_id", "page_idx", "block_idx", w.alias("out_w"), h.alias("out_h"))


@query("c12_prompt_lookup", "blocks", sql="""SELECT kind, count(*) AS n, CASE kind WHEN 'table' THEN concat(chr(10), 'Table Recognition:') WHEN 'equation' THEN concat(chr(10), 'Formula Recognition:') WHEN 'image' THEN concat(chr(10), 'Image Analysis:')
  WHEN 'chart' THEN concat(chr(10), 'Image Analysis:') ELSE concat(chr(10), 'Text Recognition:') END AS prompt, CASE kind WHEN 'table' THEN 0.005 ELSE 0.05 END::DOUBLE AS frequency_penalty FROM blocks GROUP BY kind""")
def c12(t):
    from quire.functions.requests import frequency_penalty, prompt_for

    return t.blocks.groupBy("kind").agg(F.count("*").alias("n")).select("kind", "n", prompt_for(F.col("kind")).alias("prompt"), frequency_penalty(F.col("kind")).alias("frequency_penalty"))


@query("c14_model_rows", "blocks", sql="SELECT doc_id, page_idx, block_idx, kind, coalesce(angle, 0)::INTEGER AS angle, kind = 'text' AND merge_prev AS merge_prev, content FROM blocks")
def c14(t):
    return t.blocks.select("doc_id", "page_idx", "block_idx", "kind", F.coalesce("angle", F.lit(0)).cast("int").alias("angle"), ((F.col("kind") == "text") & F.col("merge_prev")).alias("merge_prev"), "content")


@query("c15_builder_kinds", "blocks", sql="""SELECT kind, (CASE WHEN kind LIKE '%\\_caption' ESCAPE '\\' THEN 'caption' WHEN kind = 'image_footnote' THEN 'footnote' WHEN kind IN ('table', 'image', 'image_block', 'chart') THEN kind || '_body' WHEN kind = 'code' THEN 'code_body' WHEN kind = 'equation' THEN 'interline_equation' ELSE kind END) AS builder_kind,
  (CASE WHEN kind = 'list' THEN NULL WHEN kind IN ('table', 'chart') THEN kind WHEN kind IN ('image', 'image_block') THEN 'image' WHEN kind = 'equation' THEN 'interline_equation' ELSE 'text' END) AS span_type, count(*) AS n FROM blocks GROUP BY kind""")
def c15(t):
    k = F.col("kind")
    return t.blocks.groupBy("kind").agg(F.count("*").alias("n")).select("kind", kinds.builder_kind(k).alias("builder_kind"), kinds.span_type(k).alias("span_type"), "n")


@query("c16_chrome_filter", "blocks", sql=f"SELECT doc_id, page_idx, block_idx, kind FROM blocks WHERE kind IN {_IN(kinds.CHROME)}")
def c16(t):
    return t.blocks.filter(kinds.is_chrome(F.col("kind"))).select("doc_id", "page_idx", "block_idx", "kind")


@query("c17_visual_bodies", "blocks", sql="SELECT doc_id, page_idx, block_idx, kind IN ('table', 'image', 'image_block', 'chart', 'code') AS is_body FROM blocks")
def c17(t):
    return t.blocks.select("doc_id", "page_idx", "block_idx", F.coalesce(kinds.is_visual_body(kinds.builder_kind(F.col("kind"))), F.lit(False)).alias("is_body"))


@query("c19_paratext_filter", "blocks", sql=f"SELECT doc_id, page_idx, block_idx, kind FROM blocks WHERE kind NOT IN {_IN(kinds.PARATEXT)}")
def c19(t):
    return t.blocks.filter(~kinds.is_paratext(F.col("kind"))).select("doc_id", "page_idx", "block_idx", "kind")


@query("c21_known_kinds", "blocks", sql=f"SELECT DISTINCT concat(kind, CASE WHEN block_idx % 2 = 0 THEN '' ELSE 'x' END) AS k, concat(kind, CASE WHEN block_idx % 2 = 0 THEN '' ELSE 'x' END) IN {_IN((*kinds.LAYOUT_KINDS, 'unknown'))} AS known FROM blocks")
def c21(t):
    k = F.concat("kind", F.when(F.col("block_idx") % 2 == 0, "").otherwise("x"))
    return t.blocks.select(k.alias("k"), kinds.is_known(k).alias("known")).distinct()


@query("c24_table_image_mask", "blocks", sql="""SELECT i.doc_id, i.page_idx, i.block_idx, t.block_idx AS table_idx, floor((i.x0 - t.x0) * 640 / (t.x1 - t.x0))::INTEGER AS mx0, floor((i.y0 - t.y0) * 480 / (t.y1 - t.y0))::INTEGER AS my0, ceil((i.x1 - t.x0) * 640 / (t.x1 - t.x0))::INTEGER AS mx1, ceil((i.y1 - t.y0) * 480 / (t.y1 - t.y0))::INTEGER AS my1
  FROM blocks i JOIN blocks t ON i.doc_id = t.doc_id AND i.page_idx = t.page_idx AND i.kind = 'image' AND t.kind = 'table' AND greatest(least(i.x1, t.x1) - greatest(i.x0, t.x0), 0) * greatest(least(i.y1, t.y1) - greatest(i.y0, t.y0), 0) * 10 >= (i.x1 - i.x0) * (i.y1 - i.y0) * 9""")
def c24(t):
    b = t.blocks
    pairs = spatial._joined(b.filter("kind = 'image'"), spatial._side(b, "o_", ("table",)), spatial._within(), "inner")
    m = g.on_table(g.box(), g.box("o_"), F.lit(640), F.lit(480))
    return pairs.select("doc_id", "page_idx", "block_idx", F.col("o_block_idx").alias("table_idx"), *[c.alias(n) for c, n in zip(m, ("mx0", "my0", "mx1", "my1"), strict=True)])


_I = "greatest(least(i.x1, o.x1) - greatest(i.x0, o.x0), 0) * greatest(least(i.y1, o.y1) - greatest(i.y0, o.y0), 0)"
_A = "((i.x1 - i.x0) * (i.y1 - i.y0))"
_PAGE = "i.doc_id = o.doc_id AND i.page_idx = o.page_idx"
_COVERED = f"{_A} > 0 AND {_I} * 10 >= {_A} * 9"


def _exists(kinds_: str, not_: str = "NOT") -> str:
    return f"{not_} EXISTS (SELECT 1 FROM blocks o WHERE {_PAGE} AND o.kind IN {kinds_} AND {_COVERED})"


_KEYS = ("doc_id", "page_idx", "block_idx")


@query("d1_text_in_table_anti_join", "blocks", sql=f"SELECT doc_id, page_idx, block_idx, kind FROM blocks i WHERE kind NOT IN ('text', 'equation', 'equation_block') OR {_exists(_IN(['table']))}")
def d1(t):
    return spatial.drop_text_in_tables(t.blocks).select(*_KEYS, "kind")


@query("d2_caption_in_image_semi_join", "blocks", sql=f"SELECT doc_id, page_idx, block_idx FROM blocks i WHERE kind = 'image_caption' AND {_exists(_IN(spatial.PICTURES), '')}")
def d2(t):
    return spatial.captions_in_images(t.blocks).select(*_KEYS)


@query("d3_image_in_table_absorb", "blocks", sql=f"SELECT i.doc_id, i.page_idx, i.block_idx, max(o.block_idx) AS absorbed_by, count(*)::INTEGER AS n_tables FROM blocks i JOIN blocks o ON {_PAGE} AND i.kind = 'image' AND o.kind = 'table' AND {_COVERED} GROUP BY ALL")
def d3(t):
    return spatial.absorbed_images(t.blocks)


@query("d3_images_of_tables", "blocks", sql=f"SELECT i.doc_id, i.page_idx, o.block_idx AS table_idx, string_agg(i.block_idx::VARCHAR, ',' ORDER BY i.block_idx) AS images FROM blocks i JOIN blocks o ON {_PAGE} AND i.kind = 'image' AND o.kind = 'table' AND {_COVERED} GROUP BY ALL")
def d3b(t):
    return spatial.images_of_tables(t.blocks)


@query("d4_image_in_image_block_anti_join", "blocks", sql=f"SELECT doc_id, page_idx, block_idx, kind FROM blocks i WHERE kind IN ('image', 'chart') AND {_exists(_IN(['image_block']))}")
def d4(t):
    return spatial.loose_images(t.blocks).select(*_KEYS, "kind")


_CANDIDATES = f"""SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY block_idx)::INTEGER AS rank FROM blocks i WHERE kind NOT IN ('list', 'image_block', 'equation_block') AND (kind <> 'image_caption' OR {_exists(_IN(spatial.PICTURES))})
  AND (kind <> 'image' OR {_exists(_IN(['table']))}) AND (kind NOT IN ('image', 'chart') OR ({_exists(_IN(['image_block']))} AND ((x1 - x0 > 100 AND y1 - y0 > 100) OR (x1 - x0) * (y1 - y0) > 10000)))"""


@query("c13_semantic_candidates", "blocks", sql=f"SELECT doc_id, page_idx, block_idx, kind, rank FROM ({_CANDIDATES}) WHERE rank <= 128")
def c13(t):
    return spatial.semantic_candidates(t.blocks).select(*_KEYS, "kind", "rank")


@query("s7_semantic_request_cap", "blocks", sql=f"SELECT doc_id, page_idx, count(*) FILTER (WHERE rank <= 8) AS asked, max(rank) > 8 AS truncated FROM ({_CANDIDATES}) GROUP BY ALL")
def s7(t):
    ranked = spatial.semantic_candidates(t.blocks, 9)
    return ranked.groupBy("doc_id", "page_idx").agg(F.sum((F.col("rank") <= 8).cast("long")).alias("asked"), (F.max("rank") > 8).alias("truncated"))


@query("d5_containers_one_level", "blocks", sql=f"""SELECT o.doc_id, o.page_idx, o.block_idx AS container_idx, o.kind AS container_kind, count(*)::INTEGER AS n_children FROM blocks i JOIN blocks o ON {_PAGE} AND i.block_idx <> o.block_idx AND {_A} > 0 AND {_I} * 10 > {_A} * 9
  AND ((o.kind = 'equation_block' AND i.kind = 'equation') OR (o.kind = 'image_block' AND i.kind IN ('image', 'chart', 'table')) OR (o.kind = 'list' AND i.kind IN ('text', 'ref_text', 'list_item'))) GROUP BY ALL""")
def d5(t):
    return spatial.containers(t.blocks)


_MEMBERS = f"SELECT i.doc_id, i.page_idx, i.block_idx, i.kind, min(o.block_idx) AS list_idx FROM blocks i JOIN blocks o ON {_PAGE} AND i.kind IN ('text', 'ref_text') AND o.kind = 'list' AND {_A} > 0 AND {_I} * 10 >= {_A} * 8 GROUP BY ALL"


@query("d6_list_membership", "blocks", sql=_MEMBERS)
def d6(t):
    return spatial.list_members(t.blocks)


@query("e3_list_sub_type", "blocks", sql=f"SELECT doc_id, page_idx, list_idx, arg_max(kind, row(n, kind)) AS sub_type FROM (SELECT doc_id, page_idx, list_idx, kind, count(*) AS n FROM ({_MEMBERS}) GROUP BY ALL) GROUP BY ALL")
def e3(t):
    return spatial.list_kind(spatial.list_members(t.blocks))


@query("d7_sub_image_best_match", "blocks", sql=f"""SELECT doc_id, page_idx, block_idx, container_idx, round((x0 - ox0) / (ox1 - ox0)::DOUBLE, 3) AS "left", round((y0 - oy0) / (oy1 - oy0)::DOUBLE, 3) AS top FROM (
  SELECT i.*, o.block_idx AS container_idx, o.x0 AS ox0, o.x1 AS ox1, o.y0 AS oy0, o.y1 AS oy1, row_number() OVER (PARTITION BY i.doc_id, i.page_idx, i.block_idx ORDER BY {_I}::DOUBLE / {_A}::DOUBLE DESC, (o.x1 - o.x0) * (o.y1 - o.y0), o.block_idx) AS rank
  FROM blocks i JOIN blocks o ON {_PAGE} AND i.kind IN ('image', 'chart') AND o.kind = 'image_block' AND {_COVERED}) WHERE rank = 1""")
def d7(t):
    return spatial.sub_images(t.blocks)


@query("f41_geometry", "blocks", sql=f"""SELECT i.doc_id, i.page_idx, i.block_idx, round({_I}::DOUBLE / {_A}::DOUBLE, 9) AS ratio, i.x0 < o.x1 AND i.x1 > o.x0 AND i.y0 < o.y1 AND i.y1 > o.y0 AS overlaps,
  round(sqrt(power(greatest(o.x0 - i.x1, i.x0 - o.x1, 0), 2) + power(greatest(o.y0 - i.y1, i.y0 - o.y1, 0), 2)), 6) AS distance, round(sqrt(power(i.x0 + i.x1 - o.x0 - o.x1, 2) + power(i.y0 + i.y1 - o.y0 - o.y1, 2)), 6) AS centre FROM blocks i JOIN blocks o ON {_PAGE} AND o.block_idx = i.block_idx + 1""")
def f41(t):
    from quire.operators.ordered import with_next

    b, o = g.box(), g.box("n_")
    return with_next(t.blocks).select(*_KEYS, F.round(g.overlap_ratio(b, o), 9).alias("ratio"), g.overlaps(b, o).alias("overlaps"), F.round(g.distance(b, o), 6).alias("distance"), F.round(g.center_distance(b, o), 6).alias("centre"))
