"""Language identification by prediction by partial matching.

For each language, byte context trees up to order three are counted over all its texts.  The frozen statistics give a
code length to every byte after every context: method C escapes with exclusion, from the longest context kept down to
the uniform order.  A text belongs to the language whose model codes it shortest.

Statistics are summed over all labelled rows, and the trees keep every context.  A text's code length is a sum over its
bytes, and what a byte costs needs the trees of one language below one preceding byte only; so the model is cut into
shards of some languages and some preceding bytes, of MODEL_CELLS entries at most each (that bounds what is gathered
and held at once; one byte of one language may be alone above it, by its 65,793 contexts).  Each text meets every shard.

Rows with a null text, or a text without a letter, are ``und`` with score 0.  Without any labelled row all are.  Each
row is judged by its text alone, read whole whatever its length; repeated rows and null ids change nothing but the
counts; ties go to the first language by name; other columns have no part, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.words import chunks

MODEL_CELLS = 12_000_000
UNKNOWN = "und"


def _grams(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte the number of its three predecessors in its text (0 before the start) and itself."""
    x = raw.astype(np.uint32)
    out = x.copy()
    place = np.arange(len(x)) - np.repeat(starts[:-1], np.diff(starts))
    for k in (1, 2, 3):
        before = np.zeros_like(x)
        before[k:] = x[:-k] if k < len(x) else 0
        out |= np.where(place >= k, before, 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task's rows (lang, text)."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def send(lang: str) -> pa.RecordBatch:
        g, n = sums.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            own = batch.column(1).filter(pc.equal(langs, lang))
            for _, _, raw, starts in chunks(own):
                if len(raw):
                    g, n = np.unique(_grams(raw, starts), return_counts=True)
                    if lang in sums:
                        g, n = np.concatenate([sums[lang][0], g]), np.concatenate([sums[lang][1], n])
                        g, back = np.unique(g, return_inverse=True)
                        n = np.bincount(back, n).astype(np.int64)
                    sums[lang] = (g, n)
                    if len(g) > 1 << 20:
                        yield send(lang)
    for lang in list(sums):
        yield send(lang)


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # of each byte
    rows: np.ndarray  # of each context of three symbols
    bits: np.ndarray  # (context row * symbols + symbol, language)

    @property
    def n_symbols(self) -> int:
        return int(self.symbol.max()) + 1


def _code_lengths(levels: list[np.ndarray], parents: list[np.ndarray]) -> list[np.ndarray]:
    """Bits of every symbol after every context of each order, for one language.

    levels[o]: counts (contexts, symbols) of order o; parents[o]: each context's parent in order o - 1."""
    n_symbols = levels[0].shape[1]
    lower = None  # log2 of P(symbol | escaped from a context of this order), for its own excluded symbols
    out = []
    for order, n in enumerate(levels):
        n = n.astype(np.float64)
        seen = n > 0
        total, kinds = n.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        if order == 0:
            left = np.maximum(256 - kinds, 1)
            rest = np.broadcast_to(np.log2(left), n.shape)
        else:
            up = levels[order - 1][parents[order]].astype(np.float64)
            hidden = up * seen  # symbols that the escape has excluded
            t = up.sum(1, keepdims=True) - hidden.sum(1, keepdims=True)
            k = (up > 0).sum(1, keepdims=True) - (hidden > 0).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = np.log2((t + k) / up)
                escape = np.where(k > 0, np.log2((t + k) / np.maximum(k, 1)), 0.0)
            rest = np.where(up > 0, direct, escape + lower[parents[order]])
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = np.where(seen, np.log2((total + kinds) / n), np.where(kinds > 0, np.log2((total + kinds) / np.maximum(kinds, 1)), 0.0) + rest)
        lower = rest
        out.append(bits.astype(np.float32))
        assert bits.shape[1] == n_symbols
    return out


def build(languages: list[str], grams: dict[int, list[tuple[np.ndarray, np.ndarray]]], contexts: list[np.ndarray]) -> Model:
    """grams[order][language]: (gram, count) with gram = context bytes and the symbol; contexts[order]: those kept, sorted."""
    used = np.zeros(256, bool)
    for g, _ in grams[0]:
        used[g] = True
    used[0] = True
    symbol = np.full(256, used.sum(), np.int64)
    symbol[used] = np.arange(used.sum())
    a = int(used.sum()) + 1
    parents = [np.zeros(len(contexts[0]), np.int64)]
    for o in (1, 2, 3):
        if o == 1:
            parents.append(np.zeros(len(contexts[1]), np.int64))
        else:
            parents.append(np.searchsorted(contexts[o - 1], contexts[o] & ((1 << (8 * (o - 1))) - 1)))
    base = np.cumsum([0, *map(len, contexts)])
    bits = np.empty((int(base[-1]) * a, len(languages)), np.float32)
    for k in range(len(languages)):
        levels = []
        for o in range(4):
            g, n = grams[o][k]
            at = np.searchsorted(contexts[o], g >> 8)
            at_ok = np.minimum(at, max(len(contexts[o]) - 1, 0))
            ok = contexts[o][at_ok] == (g >> 8) if len(contexts[o]) else np.zeros(len(g), bool)
            level = np.zeros((len(contexts[o]), a), np.float32)
            level[at_ok[ok], symbol[g[ok] & 255]] = n[ok]
            levels.append(level)
        bits[:, k] = np.concatenate([x.ravel() for x in _code_lengths(levels, parents)])
    # The longest context kept for any three symbols.
    rows = np.zeros(a**3, np.int32)
    for o in (1, 2, 3):
        c = contexts[o]
        s = [symbol[(c >> (8 * i)) & 255] for i in range(o)]
        number = base[o] + np.arange(len(c))
        cube = rows.reshape(a, a, a)  # third before, second before, last
        if o == 1:
            cube[:, :, s[0]] = number
        elif o == 2:
            cube[:, s[1], s[0]] = number
        else:
            cube[s[2], s[1], s[0]] = number
    return Model(languages, symbol, rows, bits)


def _trees(counts: DataFrame, languages: list[str], after: list[int] | None) -> Model:
    """The model of some languages; after: the preceding bytes whose contexts are wanted, all if None."""
    counts = counts.filter(F.col("lang").isin(languages))
    contexts: list[np.ndarray] = [np.zeros(1, np.int64)]
    grams: dict[int, list] = {}
    for o in range(4):
        rows = counts.filter(F.shiftright("gram", 8).bitwiseAND(255).isin(after)) if o and after is not None else counts
        cut = rows.groupBy("lang", F.col("gram").bitwiseAND((1 << (8 * (o + 1))) - 1).alias("g")).agg(F.sum("n").alias("n"))
        got = cut.toArrow()
        lang, g, n = got["lang"].to_pandas().to_numpy(), got["g"].to_numpy(), got["n"].to_numpy()
        grams[o] = [(g[lang == x], n[lang == x]) for x in languages]
        if o:
            contexts.append(np.unique(g >> 8))
    return build(languages, grams, contexts)


def _counts(labelled: DataFrame) -> tuple[DataFrame, list[str]]:
    """The counts (lang, gram, n) of all rows, written, and the languages."""
    counts = labelled.filter("text is not null and lang is not null").select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from quire.llm.scratch import Scratch

    counts = Scratch(labelled.sparkSession, "ppm").table(counts, "grams")
    return counts, [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]


def train(labelled: DataFrame) -> Model | None:
    """labelled: (lang, text), lang not null. Counts all rows; the whole model at once."""
    counts, languages = _counts(labelled)
    return _trees(counts, languages, None) if languages else None


def plan_shards(contexts: dict[int, int], symbols: int, languages: list[str], cells: int) -> list[tuple[list[str], list[int]]]:
    """(languages, preceding bytes) of each shard; contexts: those of each preceding byte, over all languages."""
    at_once = max(1, min(len(languages), cells // (symbols * max(contexts.values()))))
    shards = []
    for low in range(0, len(languages), at_once):
        some = languages[low : low + at_once]
        part: list[int] = []
        size = 0
        for b, n in sorted(contexts.items(), key=lambda x: (-x[1], x[0])):
            if part and (size + n) * symbols * len(some) > cells:
                shards.append((some, part))
                part, size = [], 0
            part.append(b)
            size += n
        shards.append((some, part))
    return shards


def shards(labelled: DataFrame, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, Model]]:
    """(languages by number, whether a preceding byte belongs to it, model) of each shard; every language and byte is in one."""
    counts, languages = _counts(labelled)
    if not languages:
        return
    c = F.shiftright("gram", 8)
    orders = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), c.bitwiseAND((1 << (8 * o)) - 1).alias("c")) for o in (1, 2, 3)]))
    per_byte = counts.select(orders.alias("x")).distinct().groupBy(F.col("x.c").bitwiseAND(255).alias("b")).agg(F.count("*").alias("n"))
    contexts = {r["b"]: r["n"] for r in per_byte.collect()}
    symbols = counts.select(F.col("gram").bitwiseAND(255)).distinct().count() + 2
    number = {x: i for i, x in enumerate(languages)}
    for some, after in plan_shards(contexts, symbols, languages, cells):
        mine = np.zeros(256, bool)
        mine[after] = True
        if max(contexts, key=lambda b: (contexts[b], -b)) in after:
            mine[[b for b in range(256) if b not in contexts]] = True  # only order 0 knows them
        yield np.array([number[x] for x in some]), mine, _trees(counts, some, after)


def code_lengths(model: Model, raw: np.ndarray, starts: np.ndarray, mine: np.ndarray | None = None) -> np.ndarray:
    """Bits of each text under each language; mine: only of the bytes whose preceding byte is so marked."""
    n = len(starts) - 1
    a = round(len(model.rows) ** (1 / 3))
    out = np.zeros((n, len(model.languages)))
    if not len(raw):
        return out
    s = model.symbol[raw]
    place = np.arange(len(raw)) - np.repeat(starts[:-1], np.diff(starts))
    context = np.zeros(len(raw), np.int64)
    for k in (3, 2, 1):
        before = np.zeros_like(s)
        before[k:] = s[:-k] if k < len(s) else 0
        context = context * a + np.where(place >= k, before, model.symbol[0])
    if mine is not None and not mine.all():
        last = np.zeros_like(raw)
        last[1:] = raw[:-1]
        taken = mine[np.where(place >= 1, last, 0)]
        starts = np.concatenate(([0], np.cumsum(taken)))[starts]
        context, s = context[taken], s[taken]
    bits = model.bits[model.rows[context].astype(np.int64) * a + s]
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(bits, starts[:-1][full], axis=0, dtype=np.float64)
    return out


def _scored(names: list[str], parts: list):
    """parts: (languages by number, preceding bytes, broadcast model) of each shard; one is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(chunks(batch.column(2)))
            sums = [np.zeros((high - low, len(names))) for low, high, _, _ in texts]
            for which, mine, model in parts:
                # value stays in memory, and what was read from the file does not
                m: Model = model.value if len(parts) == 1 else model.load_from_path(model._path)
                for bits, (_, _, raw, starts) in zip(sums, texts, strict=True):
                    bits[:, which] += code_lengths(m, raw, starts, mine)
                del m
            for bits, (low, high, _, _) in zip(sums, texts, strict=True):
                part = batch.slice(low, high - low)
                best = bits.argmin(1)
                with np.errstate(under="ignore"):
                    share = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
                letters = pc.fill_null(pc.match_substring_regex(part.column(2), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                lang = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(np.where(letters, share, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; models learn from the rows with a language that are not held out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    parts, names = [], {}
    for which, mine, model in shards(rows.filter(~F.coalesce("held_out", F.lit(False))).select("lang", "text"), MODEL_CELLS):
        names |= dict(zip(which.tolist(), model.languages, strict=True))
        parts.append((which, mine, docs.sparkSession.sparkContext.broadcast(model)))
    rows = rows.select("doc_id", "held_out", "text")
    if not parts:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scored([names[i] for i in sorted(names)], parts), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
