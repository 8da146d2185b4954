"""Queries over texts: cleaning, escaping, formulas, runs, names, tables as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import kinds, text
from quire.plans.registry import query

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TRIM = f"trim(s, {_WS})"
_DEC = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


def S():
    return F.col("s")



def scalar(name: str, f, sql: str, out: str = "out"):
    """A query that applies one function to every marked text."""

    @query(name, "marked", sql=f"SELECT doc_id, {sql} AS {out} FROM marked")
    def run(t):
        return t.marked.select("doc_id", f(S()).alias(out))

    return run


_NARROW_FROM, _NARROW_TO = text.FULL_WIDTH, text._narrow(text.FULL_WIDTH)
_ALL_FROM, _ALL_TO = (text.FULL_WIDTH_ALL + "　").replace("'", "''"), (text._narrow(text.FULL_WIDTH_ALL) + " ").replace("'", "''")
_FOLD = f"translate(s, '{_NARROW_FROM}', '{_NARROW_TO}')"
_FOLD_ALL = f"lower(translate({_TRIM}, '{_ALL_FROM}', '{_ALL_TO}'))"
_ENDS = " OR ".join(f"(ends_with(f, '{m}')" + (r" AND NOT regexp_matches(f, '\p{L}continued$'))" if m == "continued" else ")") for m in text.CONTINUED)

scalar("f2_attribute_escape", text.escape_attribute, "replace(replace(replace(s, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;')")
scalar("f3_table_formula_wrap", text.wrap_formulas, r"regexp_replace(regexp_replace(s, '\\\(\s*(.*?)\s*\\\)', '<eq>\1</eq>', 'gs'), '\\\[\s*(.*?)\s*\\\]', '<eq>\1</eq>', 'gs')")
scalar("f5_eq_unwrap", text.unwrap_eq, r"replace(replace(s, '<eq>', '\('), '</eq>', '\)')")
_STRIP = _TRIM
for _ in range(4):
    _STRIP = f"trim(regexp_replace({_STRIP}, '^(?:\\$\\$(.*)\\$\\$|\\\\\\[(.*)\\\\\\]|\\\\\\((.*)\\\\\\))$', '\\1\\2\\3', 's'), {_WS})"
scalar("f6_equation_delimiters", text.strip_delimiters, _STRIP)
_OPEN, _CLOSE = r"len(regexp_extract_all(s, '\\\['))", r"len(regexp_extract_all(s, '\\\]'))"
_INNER = rf"trim(regexp_extract(s, '\\\[(.*)\\\]', 1, 's'), {_WS})"
_INLINE = (
    rf"CASE WHEN {_OPEN} <> 1 OR {_CLOSE} <> 1 OR NOT regexp_matches(s, '\\\[.*\\\]', 's') OR {_INNER} = '' OR regexp_matches({_INNER}, '^[0-9\s,.\-]+$') OR regexp_matches({_INNER}, '[\n\r&$]') OR contains({_INNER}, '\\') OR regexp_matches({_INNER}, '\\(begin|end|tag|label)') THEN s"
    rf" ELSE concat(regexp_extract(s, '^(.*?)\\\[', 1, 's'), '\(', {_INNER}, '\)', regexp_extract(s, '\\\](.*)$', 1, 's')) END"
)
_SPACED = r"""CASE WHEN regexp_matches(s, '\\\(.*?\\\)', 's') THEN concat(regexp_extract(s, '^(.*?)\\\(', 1, 's'), '\(', regexp_replace(regexp_extract(s, '\\\((.*?)\\\)', 1, 's'), '\\(cong|times|subset)([A-Za-z])([^A-Za-z]|$)', '\\\1 \2\3', 'g'), '\)', regexp_extract(s, '\\\)(.*)$', 1, 's')) ELSE s END"""
scalar("f9_display_to_inline", text.display_to_inline, _INLINE)
scalar("f10_macro_spacing", text.fix_macro_spacing, _SPACED)
scalar("f15_pure_table_or_formula", lambda c: F.concat(text.is_pure_table(c).cast("string"), F.lit("/"), text.is_pure_formula(c).cast("string")), rf"concat(starts_with(lower({_TRIM}), '<table') AND ends_with(lower({_TRIM}), '</table>'), '/', regexp_matches({_TRIM}, '^(?:\$\$.*\$\$|\\\[.*\\\]|\\\(.*\\\))$', 's'))")
scalar("f16_whitespace_compaction", text.compact, r"trim(regexp_replace(s, '\s+', ' ', 'g'))")
_MARKS = "regexp_replace({}, '((?:^|[^\\\\])(?:\\\\\\\\)*)([*_`~$])', '\\1\\\\\\2', 'g')"  # twice: a match takes the mark before
scalar("f20_markdown_escape", text.escape_markdown, _MARKS.format(_MARKS.format(_FOLD)))
scalar("f21_leading_marker_escape", text.escape_marker, r"regexp_replace(s, '^([ \t]{0,3})([+-]|#{1,6})([ \t])', '\1\\\2\3')")
scalar("f23_cjk_test", text.has_cjk, r"regexp_matches(s, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]')")
scalar("f24_full_width_folding", lambda c: F.concat_ws("|", text.fold_alnum(c), F.lower(text.fold_all(text.trimmed(c)))), f"concat_ws('|', {_FOLD}, {_FOLD_ALL})")


@query("f25_continuation_marker", "marked", sql=f"SELECT doc_id, contains(f, '(continued)') OR {_ENDS} AS out FROM (SELECT doc_id, {_FOLD_ALL} AS f FROM marked)")
def f25(t):
    return t.marked.select("doc_id", text.is_continued(S()).alias("out"))


scalar("f26_title_whitespace", text.compact, r"trim(regexp_replace(s, '\s+', ' ', 'g'))")
scalar("f32_html_escape", text.escape_html, "replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")
scalar("f33_output_html", text.output_html, r"""regexp_replace(regexp_replace(regexp_replace(s, '<eq>(.*?)</eq>', ' $\1$ ', 'gs'), 'src="([^"]*)"', 'src="images/\1"', 'g'), 'src="images/data:', 'src="data:', 'g')""")
scalar("f38_cell_text", text.cell_text, "trim(" + _DEC.format("regexp_replace(s, '<[^>]*>', '', 'g')") + ")")
scalar("f31_entity_decode_five", lambda c: text.cell_text(F.regexp_replace(c, "[<>]", "")), "trim(" + _DEC.format("regexp_replace(s, '[<>]', '', 'g')") + ")")
scalar("f28_complex_table", text.is_complex_table, r"regexp_matches(s, '(?i)\b(colspan|rowspan)\s*=') OR len(regexp_extract_all(lower(s), '<table')) > 1")
_NAMES = "authorization|cookie|x-api-key|api[-_]?key|access_token|refresh_token|client_secret|token|secret|password|credential"
scalar(
    "f44_secret_redaction", text.redact,
    rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?i)\bdata:[^\s,]+,[^\s]*', '[REDACTED_DATA_URL]', 'g'), '(?i)\bauthorization\s*[:=]\s*(?:bearer\s+)?[^\s,;]+', 'Authorization: [REDACTED]', 'g'), '(?i)\bbearer\s+[^\s,;]+', 'Bearer [REDACTED]', 'g'),
    '(?i)((?:"|'')?(?:[a-z0-9_-]*)({_NAMES})(?:"|'')?)(\s*[=:]\s*)(?:"[^"]*"|''[^'']*''|[^\s,;}}&]+)', '\1\3[REDACTED]', 'g'), '(?i)\bhttps?://[^\s"''<>]+', '[REDACTED_URL]', 'g')""",
)
scalar("f46_utf8_truncation", lambda c: text.truncate_bytes(c, 20), "array_to_string([c FOR c IN string_split(s, '')][1:(SELECT coalesce(max(k), 0) FROM (SELECT unnest(range(1, 22)) AS k) WHERE k <= length(s) AND strlen(left(s, k::INTEGER)) <= 20)], '')")
scalar("f51_digests", lambda c: F.concat(F.sha2(c, 256), F.lit("/"), F.upper(F.md5(c))), "concat(sha256(s), '/', upper(md5(s)))")
scalar("f12_list_item_bullets", text.list_item, "ltrim(regexp_replace(s, '^[-*• ]+', ''))")
scalar("a19_markdown_quality", lambda c: text.markdown_reason(c, 250), rf"CASE WHEN {_TRIM} = '' THEN 'empty_markdown' WHEN strlen(s) > 250 THEN 'output_limit' WHEN contains(s, chr(65533)) OR regexp_matches(s, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]') THEN 'garbled_markdown' WHEN len(regexp_extract_all({_TRIM}, '[\p{{L}}\p{{N}}]')) < 4 THEN 'low_quality' END")

#: The bytes of a document that the reference's workers accept (command/service.rs:331).
_OUTPUT = 64 << 20


@query("a19_document_quality", sql=rf"SELECT doc_id, CASE WHEN {_TRIM} = '' THEN 'empty_markdown' WHEN strlen(s) > {_OUTPUT} THEN 'output_limit' WHEN contains(s, chr(65533)) OR regexp_matches(s, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]') THEN 'garbled_markdown' WHEN len(regexp_extract_all({_TRIM}, '[\p{{L}}\p{{N}}]')) < 4 THEN 'low_quality' END AS out FROM (SELECT doc_id, text AS s FROM documents) d")
def a19(t):
    return t.documents.select("doc_id", text.markdown_reason(F.col("text"), _OUTPUT).alias("out"))



def _fields(name: str, sql_name: str) -> str:
    return rf"""coalesce(nullif(trim(regexp_extract(s, '(?is)<\|\s*{sql_name}\s*_(?:start|begin)\s*\|>(.*?)<\|\s*{sql_name}\s*_(?:end|stop)\s*\|>', 1), {_WS}), ''), nullif(regexp_extract(s, '(?is)<\s*{sql_name}\s*>\s*(.*?)\s*</\s*{sql_name}\s*>', 1), ''),
      nullif(trim(regexp_extract(s, '(?im)^[ \t]*(?:[-*][ \t]+)?{sql_name}[ \t]*(?::|=)[ \t]*(.+?)[ \t]*$', 1)), '')) AS {name}"""


@query("f13_class_output_fields", "marked", sql="SELECT doc_id, " + ", ".join(_fields(n, r"sub[\s_-]*class" if n == "sub_class" else n) for n in ("class", "sub_class", "caption", "content")) + " FROM marked")
def f13(t):
    return t.marked.select("doc_id", *[text.field(S(), n).alias(n) for n in ("class", "sub_class", "caption", "content")])


@query("f14_class_application", "marked", sql=f"""SELECT doc_id, CASE WHEN c IN ('pure_table', 'table') THEN 'table' WHEN c IN ('pure_formula', 'formula', 'equation') THEN 'equation' WHEN c = 'chart' THEN 'chart' ELSE 'image' END AS kind
  FROM (SELECT doc_id, translate(lower(trim(regexp_replace(class, '\\s+', ' ', 'g'))), ' -', '__') AS c FROM (SELECT doc_id, {_fields('class', 'class')} FROM marked)) WHERE c IS NOT NULL""")
def f14(t):
    c = t.marked.select("doc_id", text.field(S(), "class").alias("c")).filter("c is not null")
    return c.select("doc_id", text.applied_kind(F.col("c")).alias("kind"))


_RUNS = r"""SELECT doc_id, coalesce(max(n), 0) >= {most} AS {out} FROM marked LEFT JOIN (SELECT doc_id AS d, grp, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM (
  SELECT *, CASE WHEN x IS NOT DISTINCT FROM lag(x) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM ({items}))) WHERE length(x) >= 8 GROUP BY ALL) ON d = doc_id GROUP BY doc_id"""
_LINES = f"SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS x FROM (SELECT doc_id, list_transform(regexp_split_to_array(s, '\r?\n'), lambda y: trim(y, {_WS})) AS p FROM marked)"
_TOKENS = r"SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS x FROM (SELECT doc_id, string_split(trim(regexp_replace(s, '\s+', ' ', 'g')), ' ') AS p FROM marked)"


@query("w6_repeated_lines", "marked", sql=_RUNS.format(most=4, out="repeated", items=_LINES))
def w6(t):
    return t.marked.select("doc_id", text.repeated_lines(S()).alias("repeated"))


@query("w6_repeated_tokens", "marked", sql=_RUNS.format(most=6, out="repeated", items=_TOKENS))
def w6b(t):
    return t.marked.select("doc_id", text.repeated_tokens(S()).alias("repeated"))


@query("f42_quality_failure", "marked", sql=rf"""SELECT m.doc_id, CASE WHEN {_TRIM} = '' THEN 'blank' WHEN contains(s, chr(65533)) THEN 'replacement-character' WHEN regexp_matches(s, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]') THEN 'control-character' WHEN l.r OR k.r THEN 'repetition' END AS failure
  FROM marked m JOIN ({_RUNS.format(most=4, out='r', items=_LINES)}) l USING (doc_id) JOIN ({_RUNS.format(most=6, out='r', items=_TOKENS)}) k USING (doc_id)""")
def f42(t):
    return t.marked.select("doc_id", text.quality_failure(S()).alias("failure"))




def N():
    return F.col("name")


_SAFE = r"""regexp_replace(name, '[\x00-\x1f\x7f-\x{9f}/\\<>:"|?*]', '_', 'g')"""
_DEVICE = "(lower(string_split({0}, '.')[1]) IN ('con', 'prn', 'aux', 'nul') OR regexp_matches(lower(string_split({0}, '.')[1]), '^(com|lpt)[1-9]$'))"


@query("f45_stem_sanitiser", "names", sql=f"SELECT id, safe, CASE WHEN {_DEVICE.format('stem')} THEN NULL ELSE stem END AS canonical FROM (SELECT id, {_SAFE} AS safe, coalesce(nullif(regexp_replace({_SAFE}, '[. ]+$', ''), ''), 'document') AS stem FROM names)")
def f45(t):
    return t.names.select("id", text.safe_stem(N()).alias("safe"), text.canonical_stem(N()).alias("canonical"))


@query("c20_portable_names", "names", sql=f"SELECT id, name <> '' AND NOT regexp_matches(name, '[. ]$') AND {_SAFE} = name AND NOT {_DEVICE.format('name')} AS portable FROM names")
def c20(t):
    return t.names.select("id", text.is_portable(N()).alias("portable"))


@query("f58_relative_path", "names", sql="SELECT id, array_to_string(list_filter(string_split(name, '/'), lambda x: x <> '.'), '/') AS path FROM names")
def f58(t):
    return t.names.select("id", text.relative_path(N()).alias("path"))


@query("f57_model_candidates", "names", sql="SELECT suffix, array_to_string(list_sort(list_distinct(list_filter(list(trim(name)), lambda x: x <> ''))), ',') AS names FROM names GROUP BY suffix")
def f57(t):
    n = F.array_sort(F.array_distinct(F.filter(F.collect_list(F.trim("name")), lambda x: x != "")))
    return t.names.groupBy("suffix").agg(F.array_join(n, ",").alias("names"))


_DOCS = "(" + ", ".join(f"'{k}'" for k in kinds.DOCUMENTS) + ")"


@query("a2_document_kinds", "names", sql=f"SELECT id, CASE WHEN lower(suffix) IN {_DOCS} THEN lower(suffix) END AS kind FROM names")
def a2(t):
    return t.names.select("id", kinds.document_kind(F.col("suffix")).alias("kind"))


@query("a3_kind_predicates", "names", sql="SELECT id, lower(suffix) IN ('docx', 'pptx', 'xlsx') AS office, lower(suffix) IN ('doc', 'ppt', 'xls', 'odt', 'rtf', 'epub', 'ods', 'odp', 'csv') AS legacy, lower(suffix) = 'pdf' AS ranged FROM names")
def a3(t):
    k = F.lower("suffix")
    return t.names.select("id", kinds.is_office(k).alias("office"), kinds.is_legacy_office(k).alias("legacy"), kinds.supports_page_range(k).alias("ranged"))


@query("f47_remote_language", sql="SELECT doc_id, CASE WHEN lang = 'en' THEN 'ch' WHEN lang IN ('ta', 'te', 'ka', 'th', 'el', 'korean', 'ch') THEN lang END AS out FROM documents")
def f47(t):
    return t.documents.select("doc_id", kinds.remote_language(F.col("lang")).alias("out"))


@query("s10_unique_names_by_case", "names", sql="SELECT id, CASE WHEN n = 1 THEN suffix ELSE concat(suffix, '_', n) END AS stem FROM (SELECT id, suffix, row_number() OVER (PARTITION BY lower(suffix) ORDER BY id) AS n FROM names)")
def s10(t):
    from quire.operators.planning import numbered_stems

    return numbered_stems(t.names, "id", "suffix").select("id", "stem")
