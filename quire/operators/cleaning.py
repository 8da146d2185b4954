"""A recogniser's reply to the content of its block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import formulas, requests, tables, text

PICTURES = ("image", "chart", "image_block")
NOTHING = "[Non-Text]"


def settled(kind: Column, reply: Column) -> Column:
    """struct(kind, sub_type, content): what a reply makes of a block, before its content is normalised.

    A picture's reply may name its class, which settles the kind and leaves the caption and the content; a picture that is
    nothing but a table or a formula becomes one, and an image block with any content an image."""
    plain = F.replace(reply, F.lit(requests.END), F.lit(""))
    named = F.when(kind.isin(*PICTURES), text.field(plain, "class"))
    body = F.when(named.isNotNull(), F.coalesce(text.field(plain, "content"), text.field(plain, "caption"), F.lit(""))).otherwise(plain)
    first = F.when(named.isNotNull(), text.applied_kind(named)).otherwise(kind)
    picture = first.isin(*PICTURES)
    out = (
        F.when(picture & text.is_pure_table(body), "table").when((picture | (first == "equation_block")) & text.is_pure_formula(body), "equation")
        .when((first == "image_block") & (text.trimmed(body) != ""), "image").otherwise(first)
    )
    return F.struct(out.alias("kind"), F.when(named.isNotNull(), text.field(plain, "sub_class")).alias("sub_type"), body.alias("content"))


def cleaned(blocks: DataFrame, kind: str = "kind", reply: str = "reply") -> DataFrame:
    """blocks with kind and content after their replies, and sub_type; null where nothing is left.

    Tables are OTSL or HTML with formulas wrapped, equations without delimiters and with balanced braces, items of lists
    texts without bullets, and texts have their formulas set in line and blanks moved out of them."""
    keys = [c for c in blocks.columns if c not in (kind, reply)]
    b = blocks.withColumn("s", settled(F.col(kind), F.coalesce(F.col(reply), F.lit("")))).select(*keys, "s.*")
    item = F.col("kind") == "list_item"
    b = b.select(*keys, F.when(item, "text").otherwise(F.col("kind")).alias("kind"), "sub_type", F.when(item, text.list_item(text.trimmed(F.col("content")))).otherwise(F.col("content")).alias("content"))
    # Only tables, equations and texts with blanks go through a parser or a stack; others stay in the engine.
    otsl = F.when(F.col("kind") == "table", F.col("content"))
    table = text.wrap_formulas(F.when(otsl.rlike("(?i)<(nl|fcel|ecel|lcel|ucel|xcel)>"), tables.otsl_html_udf(otsl)).otherwise(otsl))
    equation = formulas.normalise_udf(F.when(F.col("kind") == "equation", F.col("content")))
    plain = text.clean_text(text.trimmed(F.col("content")))
    blank = plain.contains("___")
    moved = F.when(blank, formulas.move_blanks_udf(F.when(blank & (F.col("kind") == "text"), plain))).otherwise(plain)
    out = F.when(F.col("kind") == "table", table).when(F.col("kind") == "equation", equation).when(F.col("kind") == "text", moved).otherwise(F.col("content"))
    out = text.trimmed(out)
    return b.select(*keys, "kind", "sub_type", F.when(~out.isin("", NOTHING), out).alias("content"))
