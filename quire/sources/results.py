"""Reading what another run has written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = "array<struct<type:string,index:int>>"
MIDDLE = f"pdf_info array<struct<page_idx:int,preproc_blocks:{_BLOCK},discarded_blocks:{_BLOCK}>>"


def middle_blocks(files: DataFrame, key: str, json: str) -> DataFrame:
    """(key, page_idx, block_idx, kind) of the block trees in JSON files: blocks and discarded ones; a file that is not such a tree has none."""
    pages = files.select(key, F.explode(F.from_json(json, MIDDLE)["pdf_info"]).alias("p"))
    none = F.array().cast(_BLOCK)
    blocks = F.concat(F.coalesce("p.preproc_blocks", none), F.coalesce("p.discarded_blocks", none))
    return pages.select(key, "p.page_idx", F.explode(blocks).alias("b")).select(key, "page_idx", F.col("b.index").alias("block_idx"), F.col("b.type").alias("kind"))
