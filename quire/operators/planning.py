"""Planning: page ranges, windows, bins of work, limits, names."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text

MIB, GIB = 1 << 20, 1 << 30
LAST = 99_999


def selected_pages(count: Column, start: Column, end: Column) -> Column:
    """How many pages a range selects: the end is cut to the last page; null for an empty document or range."""
    last = F.least(F.coalesce(end, count - 1), count - 1)
    return F.when((count > 0) & (start <= last), last - start + 1)


def api_end(end: Column, last: Column) -> Column:
    return F.when(end == LAST, last).otherwise(F.least(end, last))


def strict_range(count: Column, start: Column, end: Column) -> Column:
    """Whether a range lies within the document; nothing is cut."""
    return (start < count) & (F.coalesce(end, count - 1) < count) & (start <= F.coalesce(end, count - 1))


def admits(width: Column, height: Column, pixels: int = 100_000_000, rendered: int = 64 * MIB, in_flight: int = 512 * MIB) -> Column:
    w, h = width.cast("long"), height.cast("long")
    return (w <= 65_535) & (h <= 65_535) & (w * h <= pixels) & (w * h * 3 <= min(rendered, in_flight))


@dataclass(frozen=True)
class Limits:
    """Totals of a document and what follows from them."""

    max_input_bytes: int = 4_293_918_719
    max_encoded_bytes: int = 8 * GIB
    max_output_bytes: int = 8 * GIB

    def __post_init__(self):
        for value, least in ((self.max_input_bytes, 1), (self.max_encoded_bytes, 1), (self.max_output_bytes, 4)):
            if value < least:
                raise ValueError(f"a limit must be at least {least}")


def derived_limits(input_bytes: Column, output_bytes: Column) -> dict[str, Column]:
    quarter = F.floor(output_bytes / 4).cast("long")
    archive = input_bytes + output_bytes + quarter + MIB
    rounded = (F.floor((archive + GIB - 1) / GIB) * GIB).cast("long")
    return {"body": input_bytes + MIB, "staged_text": quarter, "raw_output": quarter, "archive": archive, "download": rounded, "expanded": rounded * 2}


def windows(pages: DataFrame, keys: list[str], page: str, size: int = 64) -> DataFrame:
    """Pages with the number of their window of so many pages."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(page))
    return pages.withColumn("window", F.floor((rank - 1) / size).cast("int"))


def byte_windows(pages: DataFrame, keys: list[str], page: str, size: str, most_pages: int, slot: int, full: int) -> DataFrame:
    """Greedy windows of neighbouring pages within a slot's bytes; a page above the slot stands alone, one above ``full`` is left out.

    One pass over the pages of a document, as a fold over their sorted array."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(page).cast("int").alias("p"), F.col(size).cast("long").alias("b"))))
    zero = F.expr("named_struct('w', 0, 'n', 0, 'bytes', 0L, 'out', cast(array() as array<struct<p:int,w:int>>))")

    def step(a: Column, x: Column) -> Column:
        fresh = (a["n"] > 0) & ((a["n"] >= most_pages) | (a["bytes"] + x["b"] > slot))
        w = a["w"] + fresh.cast("int")
        out = F.concat(a["out"], F.array(F.struct(x["p"].alias("p"), w.alias("w"))))
        taken = F.struct(w.alias("w"), F.when(fresh, 1).otherwise(a["n"] + 1).alias("n"), F.when(fresh, x["b"]).otherwise(a["bytes"] + x["b"]).alias("bytes"), out.alias("out"))
        return F.when(x["b"] > full, a).otherwise(taken)

    folded = pages.groupBy(*keys).agg(F.aggregate(rows, zero, step, lambda a: a["out"]).alias("o"))
    return folded.select(*keys, F.explode("o").alias("o")).select(*keys, F.col("o.p").alias(page), F.col("o.w").alias("window"))


def waves(tasks: DataFrame, order: str, concurrency: int, keys: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return tasks.withColumn("wave", F.floor((rank - 1) / concurrency).cast("int"))


def numbered_stems(rows: DataFrame, order: str, stem: str) -> DataFrame:
    """The common case of unique names: later equals (in any case) get _n."""
    n = F.row_number().over(Window.partitionBy(F.lower(stem)).orderBy(order))
    return rows.withColumn("stem", F.when(n == 1, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("_"), n.cast("string"))))


#: Bytes of a name at most, and of one that a number can follow without cutting it.
NAME_BYTES, FREE_BYTES = 200, 194


def unique_names(rows: DataFrame, batch: str, order: str, stem: str) -> DataFrame:
    """(batch, order, stem): names that differ in any case, within each batch of inputs, which is planned together.

    The first of equal names keeps its name; the next ones get, in order, the numbers from 2 on that make no name that was
    given.  Names of more than FREE_BYTES bytes that start alike share their numbers, for cutting them could make them equal."""
    name = F.when(text.truncate_bytes(F.col(stem), NAME_BYTES) != "", text.truncate_bytes(F.col(stem), NAME_BYTES)).otherwise(F.col(stem))
    given = rows.select(batch, order, stem).withColumn("_name", name).withColumn("_low", F.lower("_name"))
    given = given.withColumn("_head", F.lower(text.truncate_bytes(F.col("_name"), FREE_BYTES)))
    nth = F.row_number().over(Window.partitionBy(batch, "_low").orderBy(order))
    given = given.withColumn("_nth", nth)
    repeats = given.filter("_nth > 1").withColumn("_rank", F.row_number().over(Window.partitionBy(batch, "_head").orderBy(order)))
    # Numbers that a name of the batch may hold already: at most as many as names that start like it and end in one.
    numbered = given.select(batch, F.regexp_extract("_low", "^(.*)_[0-9]+$", 1).alias("_head")).filter("_head <> ''")
    numbered = numbered.withColumn("_head", text.truncate_bytes(F.col("_head"), FREE_BYTES)).groupBy(batch, "_head").agg(F.count("*").alias("_taken"))
    groups = repeats.groupBy(batch, "_head").agg(F.max("_rank").alias("_most")).join(numbered, [batch, "_head"], "left").fillna(0, ["_taken"])
    tries = groups.select(batch, "_head", F.explode(F.sequence(F.lit(2), (F.col("_most") + F.col("_taken") + 1).cast("int"))).alias("_n"))
    names = repeats.select(batch, "_head", "_low").distinct()
    made = tries.join(names, [batch, "_head"]).withColumn("_low", F.lower(_numbered(F.col("_low"), F.col("_n"))))
    clash = made.join(given.select(batch, "_low").distinct(), [batch, "_low"], "left_semi").select(batch, "_head", "_n").distinct()
    free = tries.join(clash, [batch, "_head", "_n"], "left_anti").withColumn("_rank", F.row_number().over(Window.partitionBy(batch, "_head").orderBy("_n")))
    dealt = repeats.join(free, [batch, "_head", "_rank"]).select(batch, order, _numbered(F.col("_name"), F.col("_n")).alias(stem))
    return given.filter("_nth = 1").select(batch, order, F.col("_name").alias(stem)).unionByName(dealt)


def _numbered(name: Column, n: Column) -> Column:
    """A name with a number behind it, cut so that both fit."""
    end = F.concat(F.lit("_"), n.cast("string"))
    whole = F.octet_length(name) + F.length(end) <= NAME_BYTES
    return F.when(whole, F.concat(name, end)).otherwise(F.concat(text.truncate_bytes(name, NAME_BYTES - F.length(end)), end))


def pack_bins(pages: list[int], window: int) -> list[int]:
    """The bin of each document: the longest first, one above the window alone, else the least loaded bin that it fits."""
    loads: list[int] = []
    out = [0] * len(pages)
    for i in sorted(range(len(pages)), key=lambda i: (-pages[i], i)):
        fits = [b for b, load in enumerate(loads) if load + pages[i] <= window] if pages[i] <= window else []
        if fits:
            b = min(fits, key=lambda b: (loads[b], b))
            loads[b] += pages[i]
        else:
            b = len(loads)
            loads.append(pages[i])
        out[i] = b
    return out


def planned_bins(docs: DataFrame, batch: str, order: str, pages: str, window: int) -> DataFrame:
    """(batch, order, pages, bin) within each batch of submitted documents."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(bin=pack_bins(pdf[pages].tolist(), window))

    kept = docs.select(F.col(batch), F.col(order), F.col(pages).cast("int").alias(pages))
    return kept.groupBy(batch).applyInPandas(one, f"{batch} {kept.schema[batch].dataType.simpleString()}, {order} {kept.schema[order].dataType.simpleString()}, {pages} int, bin int")


def markdown_lines(rows: DataFrame, key: str, text: str, width: int = 96, per_page: int = 50) -> DataFrame:
    """(key, page, line, content): lines cut at so many characters, non-ASCII as '?', so many lines to a page."""
    ascii_ = F.regexp_replace(F.col(text), r"[^\x00-\x7f]", "?")
    lines = rows.select(key, F.posexplode(F.split(ascii_, "\n", -1)).alias("i", "s"))
    pieces = F.greatest(F.ceil(F.length("s") / width), F.lit(1)).cast("int")
    cut = lines.select(key, "i", "s", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("j"))
    cut = cut.select(key, "i", "j", F.substring("s", F.col("j") * width + 1, F.lit(width)).alias("content"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("i", "j")) - 1
    return cut.select(key, F.floor(n / per_page).cast("int").alias("page"), (n % per_page).cast("int").alias("line"), "content")


