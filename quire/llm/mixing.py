"""Mixing sources to target weights by hash-threshold histograms [native].

Each source gets a budget of words.  A document has a 60-bit hash; a source takes its documents below a threshold.
The threshold is found without sorting: words are summed by source and 12-bit hash bucket, the bucket in which the
budget ends is found in the running sums, and only that bucket is split on the next 12 bits, until what is left in it
shares one hash.  Budgets above the source's own size take every document once (twice, three times) and find the
threshold for the rest, so thresholds of growing budgets are nested.

Null texts have size 0; a null source is a source of its own, the last; documents without an id hash as one id (they
are taken together), as are repeated ids; an empty table gives no rows.  Texts of any length are counted whole.
Documents that tie at a threshold (one hash) come in together or not at all.  Other columns, whatever their names, are
carried along unchanged by mixed_documents.  The shares of sources are found by windows over one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.names import fresh
from quire.llm.scratch import Scratch

BITS, STEP = 60, 12
SPACES = " \t\n\x0b\f\r"
WEIGHTS = (5, 2, 1)
MOST = 3


def word_count(text: str | Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    text = F.col(text) if isinstance(text, str) else text
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def id_hash(doc_id: Column, salt: str) -> Column:
    """A hash of 60 bits that any SQL engine with md5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with target added: weights 5, 2, 1, repeating in order of code points, null last, share all
    words; a target stops at MOST times its source's size, and the excess is shared again by weight.  One row per source."""
    # The sources that stop are those with the least cap for their weight, so running sums find them at once.
    named = sources.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("nth") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    named = named.withColumn("cap", MOST * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    every = Window.partitionBy()
    named = (
        named.withColumn("total", F.sum("source_size").over(every))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("stops", (F.col("total") - F.col("caps_before")) * F.col("weight") > F.col("cap") * F.col("weights_left"))
        .withColumn("free", F.col("total") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0)).over(every))
        .withColumn("free_weight", F.sum(F.when(~F.col("stops"), F.col("weight")).otherwise(0)).over(every))
    )
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("free").cast("double") * F.col("weight") / F.col("free_weight"))
    return named.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, budget) with ``below``: the hash below which documents are taken so that their words come nearest to the budget.

    sized: source, size, h."""
    state = budgets.withColumn("before", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long"))
    done = None
    for level in range(1, BITS // STEP + 1):
        shift, above = BITS - STEP * level, BITS - STEP * (level - 1)
        s = state.select(F.col("source").alias("s"), "budget", "before", "prefix")
        inside = sized.join(s, sized["source"].eqNullSafe(s["s"]) & (F.shiftright("h", above) == s["prefix"]) if level > 1 else sized["source"].eqNullSafe(s["s"]))
        cells = (
            inside.withColumn("cell", F.shiftright("h", shift))
            .groupBy("source", "budget", "before", "cell")
            .agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
        )
        run = Window.partitionBy("source").orderBy("cell")
        cells = cells.withColumn("upto", F.col("before") + F.sum("words").over(run))
        # The first cell that goes over the budget; none: everything is taken.
        cross = cells.filter(F.col("upto") > F.col("budget")).groupBy("source", "budget").agg(F.min(F.struct("cell", F.col("upto") - F.col("words"), "words", "low", "high")).alias("c"))
        cross = cross.select("source", "budget", F.col("c.cell").alias("prefix"), F.col("c.col2").alias("before"), F.col("c.words").alias("words"), F.col("c.low").alias("low"), F.col("c.high").alias("high"))
        cross = scratch.table(cross, f"level{level}")
        # One hash left: its documents come in if that is nearer to the budget.
        last = cross.filter(F.col("low") == F.col("high")).select(
            "source", "budget", F.when(2 * (F.col("budget") - F.col("before")) >= F.col("words"), F.col("low") + 1).otherwise(F.col("low")).alias("below")
        )
        done = last if done is None else done.unionByName(last)
        state = cross.filter(F.col("low") < F.col("high")).select("source", "budget", "before", "prefix")
        if state.isEmpty():
            break
    b, d = budgets.alias("b"), done.alias("d")
    return b.join(d, F.col("b.source").eqNullSafe(F.col("d.source")), "left").select("b.source", "b.budget", F.coalesce("d.below", F.lit(1 << BITS)).alias("below"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Return (row columns of docs..., size, source_size, target, copies, taken): how often the mix takes each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = scratch.table(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), id_hash(F.col(doc_id), "mix:").alias("h")), "sized"
    )
    goal = scratch.table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("budget", F.when(F.col("whole") >= MOST, 0.0).otherwise(F.col("target") - F.col("whole") * F.col("source_size")))
    part = goal.filter(F.col("budget") > 0).select("source", "budget")
    limit = thresholds(sized, part, scratch).select(F.col("source").alias("t_source"), "below")
    goal = goal.join(limit, F.col("source").eqNullSafe(F.col("t_source")), "left")
    goal = goal.select(F.col("source").alias("g_source"), "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below"))
    goal = scratch.table(goal, "goal")  # one row a source: its size as a file decides whether it is broadcast
    out = sized.join(goal, F.col("source").eqNullSafe(F.col("g_source")))
    copies = F.col("whole") + (F.col("h") < F.col("below")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with the columns of docs."""
    id_, of, copies = fresh(docs, "id", "source", "copies")
    chosen = mix(docs, doc_id, text, source).filter("copies > 0").groupBy(F.col("doc_id").alias(id_), F.col("source").alias(of)).agg(F.max("copies").alias(copies))
    # One row an id and source, in a table of its own, so that rows that repeat an id can be split in the join.
    chosen = Scratch(docs.sparkSession, "mixed").table(chosen, "chosen")
    out = docs.join(chosen, F.col(doc_id).eqNullSafe(F.col(id_)) & F.col(source).eqNullSafe(F.col(of)))
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
