"""Rules of the service around documents: what it refuses, asks for, answers, and how its options come together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reasons by what they stand for, members of a result, engines, and a worker's protocol.
REASONS = ("empty_pdf", "page_limit", "images_present", "mixed_pdf", "ocr_required", "low_confidence")
MEMBERS = ("md", "middle_json", "model", "content_list", "images")
BACKENDS = ("pipeline", "vlm-engine", "vlm-http-client", "hybrid-engine", "hybrid-http-client")
SYSTEM, PROTOCOL, LAST_PAGE, CLIENT = "You are a helpful assistant.", 2, 99_999, "vlm-http-client"
FALSE_JSON = ("null", "false", '""', "[]", "{}")


def native_reasons(n_pages: Column, most_pages: int, has_images: Column, mixed: Column, needs_ocr: Column, n_bytes: Column, least_bytes: int) -> Column:
    """Why a document's own text is not good enough, in the order of REASONS; empty if it is. Pages with images are mixed, too."""
    found = (n_pages == 0, n_pages > most_pages, has_images, has_images | mixed, needs_ocr, n_bytes < least_bytes)
    return F.filter(F.array(*[F.when(on, name) for name, on in zip(REASONS, found, strict=True)]), lambda x: x.isNotNull())


def chat_body(model: str, user: Column, asked: dict[str, Column], configured: dict[str, float | None], system: str = SYSTEM) -> Column:
    """The JSON body of a chat request: sampling values that the request has go before the configured ones, others are left out."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    sampling = [F.coalesce(asked.get(k, F.lit(None)), F.lit(configured.get(k))).alias(k) for k in {**configured, **asked}]
    return F.to_json(F.struct(F.lit(model).alias("model"), *sampling, F.array(message("system", F.lit(system)), message("user", user)).alias("messages")))


def submit_form(first: Column, last: Column, server: Column, from_client: Column) -> Column:
    """The fields of a task's form, in order: pages without an end go to the last one there can be, Markdown is returned unless the
    client renders it, and a blank server is left out."""
    fields = (("backend", F.lit(CLIENT)), ("start_page_id", first), ("end_page_id", F.coalesce(last, F.lit(LAST_PAGE))), ("return_md", ~from_client), ("server_url", F.nullif(server, F.lit(""))))
    return F.array_join(F.array(*[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in fields]), "&")


def health(reply: Column) -> Column:
    """struct(healthy, window) of a worker's JSON: it says so, speaks the protocol, and takes requests; a window holds a page at least."""
    h = F.from_json(reply, "status string, protocol_version int, max_concurrent_requests int, processing_window_size int")
    fine = F.coalesce((h["status"] == "healthy") & (h["protocol_version"] == PROTOCOL) & (h["max_concurrent_requests"] > 0), F.lit(False))
    return F.struct(fine.alias("healthy"), F.when(fine, F.greatest(h["processing_window_size"], F.lit(1))).alias("window"))


def resolved(*sources: Column) -> Column:
    """An option's value: the first source that sets it, as the operator's pin, the request, the configuration and the default."""
    return F.coalesce(*sources)


def result_members(wanted: dict[str, Column]) -> Column:
    """The members of a result archive, in the order of MEMBERS; those that nobody may leave out are always there."""
    return F.filter(F.array(*[F.when(wanted.get(m, F.lit(True)), m) for m in MEMBERS]), lambda x: x.isNotNull())


def json_result(name: Column, markdown: Column, images: Column, backend: str, version: str) -> Column:
    """The JSON answer for a document; images: map of names to bytes, left out if null."""
    shown = F.transform_values(images, lambda _, v: F.concat(F.lit("data:image/jpeg;base64,"), F.base64(v)))
    one = F.struct(markdown.alias("md_content"), shown.alias("images"))
    return F.to_json(F.struct(F.lit(backend).alias("backend"), F.lit(version).alias("version"), F.map_from_entries(F.array(F.struct(name, one))).alias("results")))


def backend(name: Column) -> Column:
    """An engine by one of its names; null for others."""
    plain = F.regexp_replace(name, "^(vlm|hybrid)-auto-engine$", "$1-engine")
    return F.when(plain.isin(*BACKENDS), plain)


def truthy(value: Column) -> Column:
    """Whether a JSON value counts as true: not null, false, zero, or empty."""
    return ~F.coalesce(value.isin(*FALSE_JSON) | (value.try_cast("double") == 0), F.lit(False))


def concurrency(most: int, configured: Column, pages: Column) -> Column:
    """How many requests go out at once: at least one, no more than there are pages, and never above a limit."""
    return F.least(F.lit(most), F.greatest(configured, F.lit(1)), F.greatest(pages, F.lit(1)))


def capped(content: Column, most_bytes: int) -> Column:
    """struct(content, warning): content above a limit is left out, with a warning that says so."""
    n = F.octet_length(content)
    warning = F.when(n > most_bytes, F.concat(F.lit("content of "), n.cast("string"), F.lit(f" bytes is over the cap of {most_bytes}")))
    return F.struct(F.when(n > most_bytes, "").otherwise(content).alias("content"), warning.alias("warning"))


def inherited(chain: Column, holds) -> Column:
    """The first of a node's ancestors, itself included, that has an attribute; chain: they in order, as deep as a tree may be."""
    return F.get(F.filter(chain, holds), F.lit(0))
