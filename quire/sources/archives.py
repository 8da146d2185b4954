"""Archives, office packages, XML, CSV and event streams: small readers of bytes, applied to Arrow batches.

A bad input is a null or a reason in its row, never an exception.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_ENTRIES, MOST_RATIO, MOST_EXPANDED = 8192, 1000, 1 << 30
MOST_DEPTH, MOST_EVENTS, MOST_ATTRIBUTES, MOST_XML = 256, 1_000_000, 64, 16 << 20
# Office document relationships and the kinds of main parts.
RELATION = "/officeDocument"
MAIN_PARTS = {"wordprocessingml.document.main+xml": "docx", "presentationml.presentation.main+xml": "pptx", "spreadsheetml.sheet.main+xml": "xlsx"}


def listing(data: bytes) -> tuple[list[tuple[str, int, int]], str | None]:
    """(entries, fault): names with expanded and packed sizes, and the first reason not to open the archive."""
    try:
        infos = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except (zipfile.BadZipFile, ValueError, OSError):
        return [], "not an archive"
    rows = [(i.filename, i.file_size, i.compress_size) for i in infos]
    parts = lambda n: n.rstrip("/").split("/")
    if len(rows) > MOST_ENTRIES:
        return rows, "too many entries"
    if len({n.lower() for n, *_ in rows}) < len(rows):
        return rows, "duplicate names"
    if any(not n or "\\" in n or any(p in ("", ".", "..") for p in parts(n)) or min(map(ord, n)) < 32 for n, *_ in rows):
        return rows, "unsafe path"
    if any((i.external_attr >> 16) & 0o170000 == 0o120000 for i in infos):
        return rows, "symbolic link"
    if any(size > packed * MOST_RATIO for _, size, packed in rows):
        return rows, "expands too much"
    if sum(size for _, size, _ in rows) > MOST_EXPANDED:
        return rows, "too large"
    return rows, None


def events(data: bytes) -> list[tuple[str, dict[str, str]]] | None:
    """The elements of an XML document with their attributes; null if it is not well-formed, has a DTD, or is over a cap."""
    if len(data) > MOST_XML:
        return None
    found: list[tuple[str, dict[str, str]]] = []
    depth = count = 0

    class Refused(Exception):
        pass

    def refuse(*_):
        raise Refused

    def start(name, attributes):
        nonlocal depth, count
        depth, count = depth + 1, count + 1
        if depth > MOST_DEPTH or count > MOST_EVENTS or len(attributes) > MOST_ATTRIBUTES:
            raise Refused
        found.append((name, attributes))

    def end(_):
        nonlocal depth
        depth -= 1

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = parser.ExternalEntityRefHandler = refuse
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, Refused):
        return None
    return found


def office_kind(data: bytes) -> str | None:
    """docx, pptx or xlsx by the main part that a package relates to and the type that overrides name for it."""
    if listing(data)[1] is not None:
        return None
    package = zipfile.ZipFile(io.BytesIO(data))
    try:
        relations, types = (events(package.read(n)) for n in ("_rels/.rels", "[Content_Types].xml"))
    except (KeyError, zipfile.BadZipFile, RuntimeError, NotImplementedError):
        return None
    target = next((a.get("Target", "") for n, a in relations or [] if n.endswith(" Relationship") and a.get("Type", "").endswith(RELATION)), None)
    if target is None:
        return None
    override = next((a.get("ContentType", "") for n, a in types or [] if n.endswith(" Override") and a.get("PartName", "").lstrip("/") == target.lstrip("/")), "")
    return next((kind for suffix, kind in MAIN_PARTS.items() if override.endswith(suffix)), None)


def csv_markdown(data: bytes) -> str | None:
    """A CSV file as a Markdown table; null if it has no row or is not UTF-8."""
    try:
        rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig"))) if r]
    except (UnicodeDecodeError, csv.Error):
        return None
    if not rows:
        return None
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join([c.replace("|", "\\|").replace("\n", " ") for c in r] + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def streamed_text(stream: str) -> str | None:
    """The text of a streamed completion; null unless it ends in [DONE]."""
    sent = [x[5:].strip() for x in stream.replace("\r\n", "\n").split("\n") if x.startswith("data:")]
    if not sent or sent[-1] != "[DONE]":
        return None
    try:
        return "".join((json.loads(x)["choices"][0].get("delta") or {}).get("content") or "" for x in sent[:-1])
    except (ValueError, KeyError, IndexError, TypeError):
        return None


def _udf(f, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return run


office_kind_udf = _udf(office_kind, T.StringType())
csv_markdown_udf = _udf(csv_markdown, T.StringType())
streamed_text_udf = _udf(streamed_text, T.StringType())
xml_is_safe_udf = _udf(lambda data: events(data) is not None, T.BooleanType())


def entries(files: DataFrame) -> DataFrame:
    """(path, name, size, packed, fault): a row for each entry of the archives (path, content); a fault has a row of its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                rows, fault = listing(r.content)
                out = [(r.path, *x, None) for x in rows] if fault is None else [(r.path, None, None, None, fault)]
                yield pd.DataFrame(out, columns=["path", "name", "size", "packed", "fault"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, size long, packed long, fault string")
