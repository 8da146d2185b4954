"""Queries over ordered rows: merges, folds, windows, limits, plans, replies and tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import geometry as g, service
from quire.functions import requests
from quire.operators import ordered, planning
from quire.plans.registry import query
from quire.streaming import tasks

_VIS = "('table', 'image', 'image_block', 'chart', 'code')"
_END = "right(p_content, 1) NOT IN ('.', '!', '?', '。', '！', '？', ')', '）', '\"', '”', ':', '：', ';', '；')"
_MERGE = f""", seen AS (SELECT *, lag(block_idx) OVER w AS p_idx, lag(kind) OVER w AS p_kind, lag(x0) OVER w AS p_x0, lag(x1) OVER w AS p_x1, lag(y1) OVER w AS p_y1, lag(content) OVER w AS p_content FROM blocks WHERE kind NOT IN {_VIS} WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY block_idx)),
 joins AS (SELECT * FROM seen WHERE merge_prev AND kind = 'text' AND p_kind = 'text' AND abs((x1 - x0) - (p_x1 - p_x0)) < least(x1 - x0, p_x1 - p_x0) AND y0 < p_y1 AND content <> '' AND p_content <> '' AND NOT regexp_matches(content, '^[0-9\\p{{Lu}}]') AND {_END})"""


@query("w1_reading_order", "blocks", sql="SELECT doc_id, page_idx, block_idx, (row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY y0, x0, block_idx) - 1)::INTEGER AS \"index\" FROM blocks")
def w1(t):
    return ordered.reading_order(t.blocks, "y0", "x0", "block_idx").select("doc_id", "page_idx", "block_idx", "index")


@query("w2_paragraph_merge_pairs", "blocks", sql=_MERGE + " SELECT doc_id, page_idx, block_idx, p_idx AS previous_idx FROM joins")
def w2(t):
    return ordered.mergeable_texts(t.blocks).select("doc_id", "page_idx", "block_idx", F.col("p_block_idx").alias("previous_idx"))


@query("w2_paragraph_merge", "blocks", sql=_MERGE + """, isl AS (SELECT b.*, sum(CASE WHEN j.block_idx IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY b.doc_id, b.page_idx ORDER BY b.block_idx) AS g FROM blocks b LEFT JOIN joins j USING (doc_id, page_idx, block_idx) WHERE b.kind = 'text')
 SELECT doc_id, page_idx, min(block_idx) AS block_idx, string_agg(content, ' ' ORDER BY block_idx) AS content FROM isl GROUP BY doc_id, page_idx, g""")
def w2b(t):
    return ordered.merged_texts(t.blocks)


@query("w4_last_surviving_node", "blocks", sql="""SELECT p.doc_id, p.page_idx, arg_max(l.page_idx, l.page_idx) AS last_page, arg_max(l.block_idx, l.page_idx) AS last_block FROM (SELECT DISTINCT doc_id, page_idx FROM blocks) p LEFT JOIN (SELECT doc_id, page_idx, max(block_idx) AS block_idx FROM blocks WHERE content NOT LIKE '%3.' GROUP BY ALL) l ON l.doc_id = p.doc_id AND l.page_idx < p.page_idx GROUP BY ALL""")
def w4(t):
    return ordered.last_surviving(t.blocks, F.col("content").endswith("3."))


@query("d10_reference_list_runs", "blocks", sql="""SELECT doc_id, min(row(page_idx, block_idx)).page_idx AS first_page, min(row(page_idx, block_idx)).block_idx AS first_block, count(*) AS n FROM (SELECT *, sum(CASE WHEN kind = 'ref_text' AND b IS NOT DISTINCT FROM 'ref_text' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_idx, block_idx) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY page_idx, block_idx) AS b FROM blocks)) WHERE kind = 'ref_text' GROUP BY doc_id, run""".replace("min(row(page_idx, block_idx)).page_idx", "min(page_idx)").replace("min(row(page_idx, block_idx)).block_idx", "arg_min(block_idx, page_idx * 100000 + block_idx)"))
def d10(t):
    r = ordered.reference_runs(t.blocks)
    return r.select("doc_id", F.col("first.page_idx").alias("first_page"), F.col("first.block_idx").alias("first_block"), "n")


@query("d9_table_continuation_pairs", "blocks", sql="""SELECT doc_id, page_idx FROM (SELECT doc_id, page_idx, arg_min(kind, block_idx) AS f, lag(arg_max(kind, block_idx)) OVER (PARTITION BY doc_id ORDER BY page_idx) AS pl, lag(page_idx) OVER (PARTITION BY doc_id ORDER BY page_idx) AS pp FROM blocks GROUP BY doc_id, page_idx) WHERE f = 'table' AND pl = 'table' AND pp = page_idx - 1""")
def d9(t):
    return ordered.page_pairs(t.blocks, "table")


@query("e2_markdown_join", "blocks", sql="SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY page_idx, block_idx) AS markdown FROM (SELECT *, CASE kind WHEN 'title' THEN concat('# ', content) WHEN 'list' THEN ' ' ELSE content END AS md FROM blocks) WHERE trim(md) <> '' GROUP BY doc_id")
def e2(t):
    k = F.col("kind")
    return ordered.markdown(t.blocks, F.when(k == "title", F.concat(F.lit("# "), F.col("content"))).when(k == "list", " ").otherwise(F.col("content")))


@query("e4_equation_arrays", "blocks", sql="SELECT doc_id, page_idx, concat('\\begin{array}{l} ', string_agg(content, ' \\\\ ' ORDER BY block_idx), ' \\end{array}') AS latex FROM blocks WHERE kind = 'equation' GROUP BY ALL")
def e4(t):
    return ordered.fold_equations(t.blocks)


@query("e5_byte_budget", "blocks", sql="SELECT doc_id, page_idx, block_idx, (sum(strlen(content)) OVER (PARTITION BY doc_id ORDER BY page_idx, block_idx))::BIGINT AS upto, sum(strlen(content)) OVER (PARTITION BY doc_id ORDER BY page_idx, block_idx) > 1000 AS over FROM blocks")
def e5(t):
    b = t.blocks.withColumn("size", F.octet_length("content"))
    return ordered.budget(b, ["doc_id"], ["page_idx", "block_idx"], "size", 1000).select("doc_id", "page_idx", "block_idx", "upto", "over")


@query("e6_text_size", "blocks", sql="SELECT doc_id, sum(strlen(kind) + strlen(content))::BIGINT AS bytes FROM blocks GROUP BY doc_id")
def e6(t):
    return t.blocks.groupBy("doc_id").agg(F.sum(F.octet_length("kind") + F.octet_length("content")).alias("bytes"))


@query("e7_warning_caps", "blocks", sql="""SELECT doc_id, concat(string_agg(content, '; ' ORDER BY rank) FILTER (WHERE rank <= 16), CASE WHEN max(rank) > 16 THEN '; ...' ELSE '' END) AS messages FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, block_idx) AS rank FROM blocks) GROUP BY doc_id""")
def e7(t):
    return ordered.capped_messages(t.blocks, ["doc_id"], ["page_idx", "block_idx"], "content", 16)


@query("e8_queued_ahead", "task_events", sql="SELECT task_id, seq, coalesce(sum(CASE WHEN state = 'pending' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS queued_ahead FROM task_events")
def e8(t):
    return tasks.queued_ahead(t.task_events, ["task_id"]).select("task_id", "seq", "queued_ahead")


@query("e11_document_limits", "plan_docs", sql="SELECT doc_id, bytes + 1048576 AS body, q AS staged_text, z AS archive, ((z + 1073741823) // 1073741824) * 1073741824 AS download, ((z + 1073741823) // 1073741824) * 2147483648 AS expanded FROM (SELECT *, (bytes * 900000) // 4 AS q, bytes + bytes * 900000 + (bytes * 900000) // 4 + 1048576 AS z FROM plan_docs)")
def e11(t):
    d = planning.derived_limits(F.col("bytes"), F.col("bytes") * 900_000)
    return t.plan_docs.select("doc_id", *[d[k].alias(k) for k in ("body", "staged_text", "archive", "download", "expanded")])


@query("a6_page_ranges", "plan_docs", sql="SELECT doc_id, CASE WHEN n_pages > 0 AND first_page <= least(coalesce(last_page, n_pages - 1), n_pages - 1) THEN least(coalesce(last_page, n_pages - 1), n_pages - 1) - first_page + 1 END AS pages FROM plan_docs")
def a6(t):
    return t.plan_docs.select("doc_id", planning.selected_pages(F.col("n_pages"), F.col("first_page"), F.col("last_page")).alias("pages"))


@query("a7_api_page_end", "plan_docs", sql="SELECT doc_id, CASE WHEN last_page = 99999 THEN n_pages - 1 ELSE least(last_page, n_pages - 1) END AS last FROM plan_docs WHERE last_page IS NOT NULL")
def a7(t):
    return t.plan_docs.filter("last_page is not null").select("doc_id", planning.api_end(F.col("last_page"), F.col("n_pages") - 1).alias("last"))


@query("a8_strict_page_ranges", "plan_docs", sql="SELECT doc_id, first_page < n_pages AND coalesce(last_page, n_pages - 1) < n_pages AND first_page <= coalesce(last_page, n_pages - 1) AS valid FROM plan_docs")
def a8(t):
    return t.plan_docs.select("doc_id", planning.strict_range(F.col("n_pages"), F.col("first_page"), F.col("last_page")).alias("valid"))


@query("a9_page_raster", "plan_docs", sql="SELECT doc_id, w, h, w * h * 3 AS bytes FROM (SELECT doc_id, ceil(width::FLOAT * sc)::BIGINT AS w, ceil(height::FLOAT * sc)::BIGINT AS h FROM (SELECT *, least((200.0 / 72)::DOUBLE::FLOAT, sqrt(100000000::FLOAT / (width::FLOAT * height::FLOAT))::FLOAT, sqrt(67108864::FLOAT / 3::FLOAT / (width::FLOAT * height::FLOAT))::FLOAT) AS sc FROM plan_docs))")
def a9(t):
    w, h, n = g.raster(F.col("width"), F.col("height"))
    return t.plan_docs.select("doc_id", w.alias("w"), h.alias("h"), n.alias("bytes"))


@query("a12_image_admission", "plan_docs", sql="SELECT doc_id, width * 9 <= 65535 AND height * 9 <= 65535 AND width::BIGINT * 9 * height * 9 <= 100000000 AND width::BIGINT * 9 * height * 9 * 3 <= 67108864 AS admitted FROM plan_docs")
def a12(t):
    return t.plan_docs.select("doc_id", planning.admits(F.col("width") * 9, F.col("height") * 9).alias("admitted"))


@query("a4_size_capped_read", sql="SELECT page_id, strlen(html) AS bytes FROM pages WHERE strlen(html) <= 6000")
def a4(t):
    return t.pages.select("page_id", F.octet_length("html").cast("long").alias("bytes")).filter("bytes <= 6000")


@query("a17_markdown_pages", sql=r"""WITH l AS (SELECT conv_id * 100 + turn AS k, unnest(string_split(regexp_replace(text, '[^\x00-\x7f]', '?', 'g'), chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations),
  c AS (SELECT k, i, unnest(range(greatest(ceil(length(s) / 96.0), 1)::BIGINT)) AS j, s FROM l), n AS (SELECT k, substr(s, j * 96 + 1, 96) AS content, row_number() OVER (PARTITION BY k ORDER BY i, j) - 1 AS n FROM c)
  SELECT k, (n // 5)::INTEGER AS page, (n % 5)::INTEGER AS line, content FROM n""")
def a17(t):
    return planning.markdown_lines(t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), "text"), "k", "text", 96, 5)


@query("a23_completion_reader", "responses", sql="""SELECT doc_id, CASE WHEN failed OR no_choice THEN '' ELSE coalesce(CASE WHEN ends_with(content, '<|im_end|>') THEN left(content, length(content) - 10) ELSE content END, '') END AS text,
  CASE WHEN failed THEN 'error object' WHEN no_choice THEN 'missing choices' WHEN content IS NULL THEN concat('empty content (generated ', tokens, ' tokens)') WHEN finish IS NULL THEN concat('missing finish reason (generated ', tokens, ' tokens)')
  WHEN finish <> 'stop' AND finish <> 'length' THEN concat('unexpected finish reason: ', finish, ' (generated ', tokens, ' tokens)') END AS warning FROM responses""")
def a23(t):
    c = requests.completion(*[F.col(x) for x in ("finish", "content", "failed", "no_choice", "tokens")], truncated_ok=True)
    return t.responses.select("doc_id", c.alias("c")).select("doc_id", "c.text", "c.warning")


@query("a26_retry_backoff", "responses", sql="SELECT doc_id, tokens + 400 IN (408, 429) OR tokens + 400 BETWEEN 500 AND 599 AS retries, round(0.5 * power(2.0, doc_id % 5) * (0.5 + (doc_id % 10) / 20.0), 9)::DOUBLE AS seconds FROM responses")
def a26(t):
    wait = requests.backoff(F.lit(0.5), F.col("doc_id") % 5, 0.5 + (F.col("doc_id") % 10) / 20)
    return t.responses.select("doc_id", requests.retries_status(F.col("tokens") + 400).alias("retries"), F.round(wait, 9).alias("seconds"))


@query("f43_retry_temperature", "responses", sql="SELECT doc_id, round(CASE WHEN base < 1 AND used < 5 AND least(base + used * 0.2, 1.0) < 1 THEN least(base + (used + 1) * 0.2, 1.0) END, 6)::DOUBLE AS next FROM (SELECT doc_id, (doc_id % 13)::DOUBLE / 10 AS base, doc_id % 7 AS used FROM responses)")
def f43(t):
    b = t.responses.select("doc_id", ((F.col("doc_id") % 13).cast("double") / 10).alias("base"), (F.col("doc_id") % 7).alias("used"))
    return b.select("doc_id", F.round(requests.retry_temperature(F.col("base"), F.col("used")), 6).alias("next"))


@query("w5_page_windows", "blocks", sql="SELECT doc_id, page_idx, block_idx, ((row_number() OVER (PARTITION BY doc_id ORDER BY page_idx * 100000 + block_idx) - 1) // 64)::INTEGER AS \"window\" FROM blocks")
def w5(t):
    b = t.blocks.withColumn("p", F.col("page_idx") * 100_000 + F.col("block_idx"))
    return planning.windows(b, ["doc_id"], "p").select("doc_id", "page_idx", "block_idx", "window")


@query("w5_byte_windows", "plan_docs", sql=""", RECURSIVE_p AS (SELECT doc_id % 50 AS batch, doc_id::INTEGER AS page, bytes AS b, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS i FROM plan_docs WHERE bytes <= 100000),
  run AS (SELECT batch, page, i, 0 AS "window", 1 AS n, b AS total FROM RECURSIVE_p WHERE i = 1
    UNION ALL SELECT p.batch, p.page, p.i, r."window" + (r.n >= 4 OR r.total + p.b > 40000)::INTEGER, CASE WHEN r.n >= 4 OR r.total + p.b > 40000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 4 OR r.total + p.b > 40000 THEN p.b ELSE r.total + p.b END
    FROM run r JOIN RECURSIVE_p p ON p.batch = r.batch AND p.i = r.i + 1)
  SELECT batch, page, "window" FROM run""".replace("RECURSIVE_p", "fits"))
def w5b(t):
    p = t.plan_docs.select((F.col("doc_id") % 50).alias("batch"), F.col("doc_id").cast("int").alias("page"), "bytes")
    return planning.byte_windows(p, ["batch"], "page", "bytes", 4, 40_000, 100_000)


@query("w8_running_progress", "blocks", sql="SELECT doc_id, page_idx, block_idx, count(*) OVER (PARTITION BY doc_id ORDER BY page_idx, block_idx) AS completed, count(*) OVER (PARTITION BY doc_id) AS total FROM blocks")
def w8(t):
    run = Window.partitionBy("doc_id").orderBy("page_idx", "block_idx").rowsBetween(Window.unboundedPreceding, 0)
    return t.blocks.select("doc_id", "page_idx", "block_idx", F.count("*").over(run).alias("completed"), F.count("*").over(Window.partitionBy("doc_id")).alias("total"))


@query("s5_bin_packing", "plan_docs")
def s5(t):
    p = t.plan_docs.select((F.col("doc_id") % 20).alias("batch"), "doc_id", "n_pages")
    return planning.planned_bins(p, "batch", "doc_id", "n_pages", 16)


@query("s10_unique_names", "names", sql=""", s AS (SELECT id % 10 AS batch, id, suffix AS stem, row_number() OVER (PARTITION BY id % 10, lower(suffix) ORDER BY id) AS nth FROM names)
  SELECT batch, id, CASE WHEN nth = 1 THEN stem ELSE concat(stem, '_', nth) END AS stem FROM s""")
def s10(t):
    return planning.unique_names(t.names.select((F.col("id") % 10).alias("batch"), "id", F.col("suffix").alias("stem")), "batch", "id", "stem")


@query("s9_effective_concurrency", "plan_docs", sql="SELECT doc_id, least(64, greatest(first_page, 1), greatest(n_pages, 1)) AS n FROM plan_docs")
def s9(t):
    return t.plan_docs.select("doc_id", service.concurrency(64, F.col("first_page"), F.col("n_pages")).alias("n"))


@query("s11_priorities", "blocks", sql="SELECT doc_id, page_idx, block_idx, (row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY block_idx) - 1)::INTEGER AS priority FROM blocks")
def s11(t):
    return t.blocks.select("doc_id", "page_idx", "block_idx", (F.row_number().over(ordered.by_page()) - 1).alias("priority"))


@query("s12_over_cap_degradation", "blocks", sql="SELECT doc_id, page_idx, block_idx, CASE WHEN strlen(content) > 18 THEN '' ELSE content END AS content, CASE WHEN strlen(content) > 18 THEN concat('content of ', strlen(content), ' bytes is over the cap of 18') END AS warning FROM blocks")
def s12(t):
    return t.blocks.select("doc_id", "page_idx", "block_idx", service.capped(F.col("content"), 18).alias("c")).select("doc_id", "page_idx", "block_idx", "c.content", "c.warning")


@query("d12_reply_scatter", "blocks", sql="SELECT b.doc_id, b.page_idx, b.block_idx, r.reply FROM blocks b LEFT JOIN (SELECT doc_id, page_idx, block_idx, upper(content) AS reply FROM blocks WHERE kind IN ('text', 'table') AND block_idx % 2 = 0) r USING (doc_id, page_idx, block_idx)")
def d12(t):
    r = t.blocks.filter("kind in ('text', 'table') and block_idx % 2 = 0").select("doc_id", "page_idx", "block_idx", F.upper("content").alias("reply"))
    return t.blocks.join(r, ["doc_id", "page_idx", "block_idx"], "left").select("doc_id", "page_idx", "block_idx", "reply")


@query("d15_task_waves", "plan_docs", sql="SELECT doc_id, ((row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) - 1) // 8)::INTEGER AS wave FROM plan_docs")
def d15(t):
    return planning.waves(t.plan_docs.withColumn("batch", F.col("doc_id") % 20), "doc_id", 8, ["batch"]).select("doc_id", "wave")


@query("u1_chrome_append", "blocks", sql="SELECT doc_id, page_idx, block_idx, kind, (row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY kind IN ('header', 'footer', 'page_number'), block_idx) - 1)::INTEGER AS place FROM blocks")
def u1(t):
    chrome = F.col("kind").isin("header", "footer", "page_number")
    both = t.blocks.filter(~chrome).withColumn("part", F.lit(0)).unionByName(t.blocks.filter(chrome).withColumn("part", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("doc_id", "page_idx").orderBy("part", "block_idx")) - 1
    return both.select("doc_id", "page_idx", "block_idx", "kind", place.alias("place"))


@query("u3_distinct_reasons", "responses", sql="SELECT doc_id, array_to_string(list_filter([CASE WHEN failed THEN 'scanned' END, CASE WHEN no_choice THEN 'mixed_pdf' END, CASE WHEN finish IS NULL THEN 'ocr_required' END, CASE WHEN no_choice AND finish IS NULL THEN 'complex_layout' END], lambda x: x IS NOT NULL), ',') AS reasons FROM responses")
def u3(t):
    r = F.array(F.when(F.col("failed"), "scanned"), F.when(F.col("no_choice"), "mixed_pdf"), F.when(F.col("finish").isNull(), "ocr_required"), F.when(F.col("no_choice"), "mixed_pdf"), F.when(F.col("no_choice") & F.col("finish").isNull(), "complex_layout"))
    return t.responses.select("doc_id", F.array_join(F.array_distinct(F.filter(r, lambda x: x.isNotNull())), ",").alias("reasons"))


@query("u4_consumed_difference", "blocks", sql="SELECT doc_id, page_idx, block_idx FROM blocks WHERE kind NOT IN ('header', 'footer', 'page_number') EXCEPT SELECT doc_id, page_idx, block_idx FROM blocks WHERE kind IN ('table', 'image') AND block_idx % 2 = 0")
def u4(t):
    used = t.blocks.filter("kind in ('table', 'image') and block_idx % 2 = 0").select("doc_id", "page_idx", "block_idx")
    return t.blocks.filter(~F.col("kind").isin("header", "footer", "page_number")).select("doc_id", "page_idx", "block_idx").join(used, ["doc_id", "page_idx", "block_idx"], "left_anti")


@query("u5_placeholder_pages", "blocks", sql="SELECT d.doc_id, p.page_idx::INTEGER AS page_idx, coalesce(n, 0) AS n_blocks FROM (SELECT DISTINCT doc_id FROM blocks) d, range(6) p(page_idx) LEFT JOIN (SELECT doc_id, page_idx, count(*) AS n FROM blocks GROUP BY ALL) b ON b.doc_id = d.doc_id AND b.page_idx = p.page_idx")
def u5(t):
    n = t.blocks.groupBy("doc_id", "page_idx").agg(F.count("*").alias("n_blocks"))
    return ordered.with_placeholders(n, t.blocks.select("doc_id", F.lit(6).alias("n_pages")).distinct()).select("doc_id", "page_idx", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


@query("u6_artifact_sets", "blocks", sql="SELECT doc_id, count(DISTINCT page_idx) = count(DISTINCT page_idx) FILTER (WHERE kind = 'text') AS complete FROM blocks GROUP BY doc_id")
def u6(t):
    pages, shown = t.blocks.select("doc_id", "page_idx").distinct(), t.blocks.filter("kind = 'text'").select("doc_id", "page_idx").distinct()
    missing = pages.join(shown, ["doc_id", "page_idx"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))
    return pages.select("doc_id").distinct().join(missing, "doc_id", "left").select("doc_id", F.col("n").isNull().alias("complete"))


_STATES = """, st AS (SELECT task_id, coalesce(arg_min(state, row(ts, seq)) FILTER (WHERE state IN ('completed', 'failed')), arg_max(state, row(ts, seq))) AS state, coalesce(min(ts) FILTER (WHERE state IN ('completed', 'failed')), max(ts)) AS since FROM task_events GROUP BY task_id)"""


@query("g1_task_states", "task_events", sql=_STATES + " SELECT task_id, state, since FROM st")
def g1(t):
    return tasks.current(t.task_events)


@query("g2_retention", "task_events", sql=_STATES + " SELECT task_id FROM st WHERE state IN ('completed', 'failed') AND since < TIMESTAMP '2024-01-02 06:00:00' - INTERVAL 24 HOUR")
def g2(t):
    return tasks.expired(tasks.current(t.task_events), F.lit("2024-01-02 06:00:00").cast("timestamp")).select("task_id")


@query("g3_capacity_eviction", "task_events", sql=_STATES + " SELECT task_id, state FROM (SELECT *, row_number() OVER (ORDER BY since DESC, task_id DESC) AS r FROM st WHERE state IN ('completed', 'failed')) WHERE r > 32")
def g3(t):
    return tasks.evicted(tasks.current(t.task_events)).select("task_id", "state")


@query("s8_oldest_terminal", "task_events", sql=_STATES + " SELECT arg_min(task_id, row(since, task_id)) AS task_id FROM st WHERE state IN ('completed', 'failed')")
def s8(t):
    return tasks.current(t.task_events).filter(F.col("state").isin(*tasks.TERMINAL)).agg(F.min_by("task_id", F.struct("since", "task_id")).alias("task_id"))


@query("g6_ordered_emission", "task_events", sql="SELECT task_id, seq, (row_number() OVER (PARTITION BY task_id ORDER BY seq) - 1)::INTEGER AS place FROM task_events")
def g6(t):
    return t.task_events.repartition("seq").select("task_id", "seq", (F.row_number().over(Window.partitionBy("task_id").orderBy("seq")) - 1).alias("place"))


@query("f52_iso_timestamps", sql="SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def f52(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
