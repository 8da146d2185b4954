"""From raw documents to packed training sequences.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All stages but the last return the columns of documents, with the
extra columns that docs has, whatever their names.

Null and empty texts have no words and go in the first stage; later stages given such texts keep them as they are, as
they keep rows without an id.  Texts of any length are taken whole.  Rows that repeat an id and a text are one document
after near-dedup; texts that share an id are documents of their own.  Of near duplicates the least id stays.  Empty
tables give empty tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import mixing, near_dedup, packing, quality_rules, substring_dedup
from quire.llm.names import fresh
from quire.llm.queries import TOKENIZER
from quire.llm.scratch import Scratch, owned


#: The tables of the last stage that was called for a folder; its result has been written when the next one is called.
_TABLES: dict[str, list[Scratch]] = {}


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """f, which first releases what the stage before it left: docs is that one's written result."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for tables in _TABLES.pop(sf_dir, []):
            tables.release()
        with owned() as made:
            out = f(spark, docs, sf_dir)
        _TABLES[sf_dir] = made
        return out

    return run


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    (name,) = fresh(docs, "judgement")
    judged = quality_rules.judge(docs, only_kept=True, name=name)
    return _measured(judged.withColumn("text", F.col(name)["cleaned"]).select(*docs.columns))


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicated(docs)


@_stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that repeat."""
    return _measured(substring_dedup.without_repeats(docs))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    return packing.packed(docs, packing.tokenizer_path(TOKENIZER)).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality rules", quality), ("near-dedup", near), ("substring dedup", substrings), ("mixing", mixed), ("packing", packed)]
#: SQL cannot express the packing; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
        docs = done
    return docs
