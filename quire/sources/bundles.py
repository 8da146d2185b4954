"""Bundles of result files from another worker: what keeps one from being published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The files of a bundle, its version and its limits.
NEEDED = ("markdown.md", "middle_json.json", "content_list.json", "structured_content.json")
OPTIONAL = ("model_output.json",)
VERSION, BACKEND = "1.0", "hybrid"
MOST_ENTRIES, MOST_DEPTH, MOST_PART, MOST_PATH, MOST_NAMES, MOST_FILE = 8192, 32, 255, 4096, 32 << 20, 64 << 20


def _is_json(content: Column) -> Column:
    return F.try_parse_json(content).isNotNull()


def _no_pages(pages: Column) -> Column:
    """Whether a JSON value is not an array, is empty, or holds a null."""
    items = F.from_json(pages, "array<string>")
    return ~F.coalesce(pages.startswith("["), F.lit(False)) | (F.size(items) <= 0) | F.exists(items, lambda x: x.isNull())


def file_faults(files: DataFrame) -> DataFrame:
    """(bundle, path, fault) of the entries (bundle, path, bytes, content) that are wrong by themselves; content: null for assets."""
    parts = F.split("path", "/", -1)
    name, top, content = F.col("path"), parts[0], F.col("content")
    get = lambda at: F.get_json_object(content, at)
    bad_name = F.exists(parts, lambda x: x.isin("", ".", "..") | (F.octet_length(x) > MOST_PART)) | (F.octet_length(name) > MOST_PATH) | (F.size(parts) > MOST_DEPTH)
    unknown = F.when(F.size(parts) == 1, ~name.isin(*NEEDED, *OPTIONAL)).otherwise(top != "images")
    json = name.isin(*[n for n in (*NEEDED, *OPTIONAL) if n.endswith(".json")])
    fault = (
        F.when(bad_name, "bad name").when(unknown, "unknown entry").when((F.size(parts) == 1) & (F.col("bytes") > MOST_FILE), "too large to validate")
        .when(json & ~F.coalesce(_is_json(content), F.lit(False)), "invalid JSON")
        .when((name == "middle_json.json") & ~F.coalesce((get("$.schema_version") == VERSION) & (get("$._backend") == BACKEND), F.lit(False)), "schema or backend")
        .when((name == "middle_json.json") & F.coalesce(_no_pages(get("$.pages")), F.lit(True)), "empty pages")
        .when((name == "model_output.json") & (F.regexp_replace(content, r"\s", "") == "[]"), "empty pages")
        .when((name == "structured_content.json") & ((F.regexp_replace(content, r"\s", "") == "[]") | (F.regexp_replace(get("$.pages"), r"\s", "") == "[]")), "empty pages")
    )
    return files.select("bundle", "path", fault.alias("fault")).filter("fault is not null")


def bundle_faults(files: DataFrame, most_bytes: int) -> DataFrame:
    """(bundle, fault): each bundle that cannot be published and the first of what is wrong, by its name; others do not appear."""
    has = lambda n: F.max(F.when(F.col("path") == n, 1).otherwise(0)) == 0
    whole = files.groupBy("bundle").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("path")).alias("names"), F.sum("bytes").alias("total"), F.count_distinct(F.lower("path")).alias("distinct"),
        F.concat_ws(",", *[F.when(has(n), n) for n in NEEDED]).alias("missing"),
    )
    fault = (
        F.when((F.col("n") > MOST_ENTRIES) | (F.col("names") > MOST_NAMES), "too many entries").when(F.col("distinct") < F.col("n"), "duplicate names")
        .when(F.col("total") > most_bytes, "too many bytes").when(F.col("missing") != "", F.concat(F.lit("missing "), "missing"))
    )
    every = file_faults(files).select("bundle", F.concat_ws(": ", "path", "fault").alias("fault")).unionByName(whole.select("bundle", fault.alias("fault")).filter("fault is not null"))
    return every.groupBy("bundle").agg(F.min("fault").alias("fault"))
