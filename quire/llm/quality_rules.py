"""Quality rules, line first [native].

Every line is judged alone by rules on punctuation, navigation and boilerplate; lines that fail are removed, and a
document that loses more than MAX_LOST of its characters with them is rejected.  A few measures of the whole text
reject documents before that (too short, mostly repeated three-word windows).

Null and empty texts have no words and are rejected; texts of any length are judged whole.  Each row is judged by
itself, so ties, repeated rows, null ids and further columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words
MAX_LOST = 0.5
#: A line fails if more of its characters than this are symbols, or capitals, or marks of exclamation.
MAX_SYMBOLS, MAX_CAPITALS, MAX_SHOUTS = 0.06, 0.5, 0.04
MAX_SEPARATORS = 3
SHORT_LINE = 40  # characters
SYMBOLS = "#*$%&|<>"
UPPER, ENDS, SEPARATORS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".!?:;,\"')”»…", "|»›·•>"
NAVIGATION = ("home", "about", "about us", "contact", "contact us", "login", "log in", "sign in", "sign up", "register", "menu", "search", "next", "previous", "back to top", "read more", "skip to content", "share", "subscribe")
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies", "this site uses cookies", "click here", "enable javascript", "lorem ipsum", "powered by")
SPACES = " \t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _held(text: Column, chars: str) -> Column:
    """How many characters of a text are among some; most texts have none, and one search tells."""
    one = "[" + "".join("\\" + c if c in "[]\\^-&" else c for c in chars) + "]"
    return F.when(text.rlike(one), F.length(text) - F.length(F.regexp_replace(text, one + "+", ""))).otherwise(0)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def repeated_words(w: Column) -> Column:
    """How many words stand in a three-word window that the text holds twice or more.

    w: a lambda variable, for it is looked up for every word.  Windows are compared by a 64-bit hash of their words'
    hashes.  Only where some are equal are they sorted with their places, so that equal neighbours are repeats."""

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    def starts(s: Column) -> Column:
        same = F.filter(s, lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.get(s, j - 1)["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x, j: F.least(x - F.get(p, j), F.lit(3)))
        return F.when(F.size(p) == 0, 0).otherwise(F.aggregate(gaps, F.lit(3), lambda a, b: a + b))

    def counted(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.named_struct(F.lit("h"), x, F.lit("i"), i)))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(_let(placed, lambda s: _let(starts(s), covered)))

    return _let(_let(F.transform(w, lambda x: F.xxhash64(x)), windows), counted)


def line_fails(line: Column) -> Column:
    """The rules on one line (a lambda variable); a line without a word passes (it carries nothing)."""
    n = F.length(line)
    symbols = _held(line, SYMBOLS) > MAX_SYMBOLS * n
    shouts = line.contains("!") & (_held(line, "!") > MAX_SHOUTS * n)
    capitals = (n >= 10) & ((n - F.length(F.regexp_replace(line, "[A-Z]+", ""))) > MAX_CAPITALS * n)

    def short_rules(trimmed: Column) -> Column:
        low = F.lower(trimmed)
        phrases = _let(low, lambda x: F.exists(F.array(*[F.lit(y) for y in BOILERPLATE]), lambda y: F.contains(x, y)))
        menu = F.rtrim(F.translate(low, ".!:", "")).isin(*NAVIGATION)
        separators = _held(line, SEPARATORS) >= MAX_SEPARATORS
        return (F.length(trimmed) < SHORT_LINE) & (~F.substring(trimmed, -1, 1).isin(*ENDS) | menu) | (F.length(trimmed) < 5 * SHORT_LINE) & (separators | phrases)

    return _let(F.btrim(line, F.lit(SPACES)), lambda t: (F.length(t) > 0) & (symbols | shouts | capitals | short_rules(t)))


def judgement(text: Column) -> Column:
    """A struct of the measures of a text, the verdict, and the text without the lines that fail."""
    t = F.coalesce(text, F.lit(""))

    def by_word(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def by_line(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
        dups = _let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        passing = _let(F.filter(lines, lambda x: ~line_fails(x)), lambda x: F.struct(F.array_join(x, "\n").alias("text"), F.size(x).alias("n")))
        return F.struct(dups.cast("long").alias("n_dup_lines"), passing.alias("passing"))

    def verdict(parts: Column) -> Column:
        w, x = parts["w"], parts["l"]
        failed = (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > MAX_REPEATED * w["n_words"])
        lost = (parts["n"] - F.length(x["passing"]["text"]) + F.when(x["passing"]["n"] == 0, 1).otherwise(0)).cast("long")
        fine = ~failed & (lost <= MAX_LOST * parts["n"])
        return F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), _held(t, SYMBOLS).cast("long").alias("n_symbols"),
            x["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), lost.alias("lost_chars"),
            fine.alias("kept"), x["passing"]["text"].alias("cleaned"),
        )

    parts = F.struct(_let(words(text), by_word).alias("w"), _let(F.split(t, "\n", -1), by_line).alias("l"), F.length(t).alias("n"))
    return _let(parts, verdict)


def judge(docs: DataFrame, text: str = "text", only_kept: bool = False, name: str = "judgement") -> DataFrame:
    """docs with a struct ``name`` added, in place of a column that has its name: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    lost_chars, kept and cleaned (the text without the lines that fail). only_kept: rows that are kept.

    The judgement is the element of an exploded array, so that no rule of the optimiser evaluates it twice."""
    one = F.array(judgement(F.col(text)))
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()]
    return docs.select(*others, F.explode(F.filter(one, lambda j: j["kept"]) if only_kept else one).alias(name))
