"""Sharding by extendible hashing [native].

A directory is indexed by the first bits of a hash of the document id.  A bucket above the byte limit splits on its
next bit, and only such buckets do, until every shard fits.  Sizes are summed for STEP bits at a time over the cells
of oversized buckets; what is aggregated after the first pass is a table of ids' hashes and sizes, not texts.

Ids that repeat share a hash and stay together; so do rows without an id.  A shard with one single hash cannot be
split; if that is above the limit it is returned as ``oversized``, as is a single text above it (texts are never cut).
Null and empty texts have no bytes.  There are no ties: a hash has one shard.  Other columns have no part, whatever
their names.  An empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.mixing import BITS, id_hash
from quire.llm.scratch import Scratch

STEP = 10


def _bits(h: Column, depth: Column) -> Column:
    """The first bits of a hash as text."""
    return F.substring(F.lpad(F.bin(h), BITS, "0"), F.lit(1), depth)


def directory(sized: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """The leaves of the directory for rows (h, n_bytes): (prefix, depth, shard_bytes, oversized); prefix: the first
    ``depth`` bits of the hash as a number."""
    total = sized.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    leaf = "prefix long, depth int, shard_bytes long, oversized boolean"
    if total <= limit:
        return sized.sparkSession.createDataFrame([(0, 0, total, False)], leaf)
    found, open_, depth = None, None, 0
    while depth < BITS:
        # Bytes of the cells ``STEP`` bits below the buckets that are open, then of every prefix on the way down.
        step = min(STEP, BITS - depth)
        rows = sized
        if open_ is not None:
            rows = sized.join(open_, F.shiftright("h", BITS - depth) == F.col("open"), "left_semi")
        cells = rows.groupBy(F.shiftright("h", BITS - depth - step).alias("cell")).agg(F.sum("n_bytes").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        down = cells.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(step))))
        sizes = down.groupBy("d", F.expr(f"shiftright(cell, {step} - d)").alias("p")).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        sizes = scratch.table(sizes.withColumn("fits", (F.col("n") <= limit) | (F.col("low") == F.col("high"))), f"depth{depth}")
        # A prefix is a leaf if it fits and its parent does not; the parents of d = 1 are open buckets.
        parents = sizes.filter("not fits").select((F.col("d") + 1).alias("d"), F.explode(F.array(F.col("p") * 2, F.col("p") * 2 + 1)).alias("p"))
        fitting = sizes.filter("fits")
        leaves = fitting.filter("d = 1").unionByName(fitting.filter("d > 1").join(parents, ["d", "p"], "left_semi"))
        leaves = leaves.select(F.col("p").alias("prefix"), (F.col("d") + depth).cast("int").alias("depth"), F.col("n").alias("shard_bytes"), (F.col("n") > limit).alias("oversized"))
        found = leaves if found is None else found.unionByName(leaves)
        open_ = sizes.filter((F.col("d") == step) & ~F.col("fits")).select(F.col("p").alias("open"))
        depth += step
        if open_.isEmpty():
            break
    return scratch.table(found, "directory")


def shard(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard_id, depth, shard_bytes, oversized) per document; shard_id: the shard's hash bits as text.

    limit: bytes of UTF-8 text in a shard at most."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), id_hash(F.col(doc_id), "shard:").alias("h"))
    sized = scratch.table(sized, "sized")
    leaves = directory(sized, limit, scratch)
    # The directory proper: a document finds its leaf by each depth that occurs (a few), as an equi-join.
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # at most BITS + 1
    tried = sized.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]))) if depths else sized.withColumn("depth", F.lit(0))
    tried = tried.withColumn("prefix", F.expr(f"shiftright(h, {BITS} - depth)"))
    return tried.join(leaves, ["depth", "prefix"]).select("doc_id", "n_bytes", _bits(F.col("h"), F.col("depth")).alias("shard_id"), "depth", "shard_bytes", "oversized")
