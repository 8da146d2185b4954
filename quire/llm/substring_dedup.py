"""Substring dedup with repeated-phrase automata.

A window is WINDOW consecutive words; every word covered by a window that also starts anywhere else is removed.

1. Texts with equal word sequences are one sequence with a count, for they lose the same words.  Each window is charged
   to the least PHRASE-word phrase in it, so equal windows are charged to equal phrases.  A run of windows charged to
   one place of a phrase is one row (phrase, hash of all words of the run): about one row for 14 words, and the only
   thing that is counted over the whole corpus.  Only phrases that stand at two places can hold a window that recurs.
2. Each distinct run of such a phrase, whatever document holds it, is a segment of text: all documents are streamed,
   but for the runs whose phrase nothing else has, and equal runs once with their count.
3. Segments are dealt by phrase and cut into shards of SHARD_BYTES.  A shard compiles an Aho-Corasick automaton of the
   passages that recur by their hashes (the first and the last window of each stretch) and streams all its segments
   through it.  A pattern that is found at two places as text is confirmed; what confirmed patterns cover is removed.
4. A phrase with more than MOST_RUNS distinct runs would not fit a shard; its windows are counted one by one over the
   whole cluster, by 128-bit hashes.  (The way differs, the result does not.)

Sequences and runs are told apart by 128 bits of hashes, windows within a shard as text.  Null and empty texts have no
words and lose none.  Rows that repeat count as occurrences of each other; rows without an id are handled like any
other.  Texts of any length are taken whole.  There are no ties: all occurrences lose the words.  Other columns have no
part, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.names import fresh
from quire.llm.scratch import Scratch
from quire.llm.words import BASE, BASE_INV, chunks, hashed_words, mix, powers, runs_hashed

WINDOW, PHRASE = 35, 8
SHARD_BYTES = 1 << 20
MOST_RUNS = 2048
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


class _Spans:
    """Hashes of any run of words of a chunk."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        with np.errstate(over="ignore"):
            self.total = np.zeros(n + 1, np.uint64)
            np.cumsum(words * powers(BASE, n), out=self.total[1:])
        self.back = powers(BASE_INV, n + 1)

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[end] - self.total[first]) * self.back[first] + (end - first).astype(np.uint64))


def _least_phrases(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase hashes, place of the leftmost least phrase of the window that starts at each word)."""
    g = runs_hashed(words, PHRASE, 8)
    reach, at, n = 1, np.arange(len(g)), WINDOW - PHRASE + 1
    while reach < n:
        step = min(reach, n - reach)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        reach += step
    return g, at


def _runs(words: np.ndarray, first: np.ndarray):
    """(document, phrase, run hash, first and last window start within the document) of the runs of a chunk."""
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    g, at = _least_phrases(words)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(doc[: len(words) - WINDOW + 1] == doc[WINDOW - 1 :])
    if not len(starts):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    place = at[starts]
    new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    a, z = starts[new], starts[np.concatenate((new[1:] - 1, [len(starts) - 1]))]
    d = doc[a]
    return d, g[place[new]], _Spans(words)(a, z + WINDOW), a - first[d], z - first[d]


def _keys(words: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Two hashes of each text's word sequence."""
    n = len(first) - 1
    if not len(words):
        return [pa.array(np.zeros(n, np.int64))] * 2
    with np.errstate(over="ignore"):
        other = mix(words ^ _OTHER)
    return [pa.array(_Spans(w)(first[:-1], first[1:]).view(np.int64)) for w in (words, other)]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, k1, k2, n_words, sha): each row's word sequence, its length and digest."""
    for batch in batches:
        for low, high, raw, starts in chunks(batch.column(1)):
            words, _, _, first = hashed_words(raw, starts, lower=False)
            sha = [hashlib.sha256(b" ".join(raw[i:j].tobytes().split())).hexdigest() for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *_keys(words, first), pa.array(np.diff(first)), pa.array(sha)], ["doc_id", "k1", "k2", "n_words", "sha"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) of the texts that are long enough to hold a window."""
    for batch in batches:
        for low, high, raw, starts in chunks(batch.column(0)):
            words, _, _, first = hashed_words(raw, starts, lower=False)
            take = pa.array(np.flatnonzero(np.diff(first) >= WINDOW))
            yield pa.RecordBatch.from_arrays([*(k.take(take) for k in _keys(words, first)), batch.column(0).slice(low, high - low).take(take)], ["k1", "k2", "text"])


def _ragged(values: np.ndarray, doc: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values).cast(kind))


def _sequence_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, m, phrase, run, a, z): the runs of each sequence."""
    for batch in batches:
        for low, high, raw, starts in chunks(batch.column(3)):
            words, _, _, first = hashed_words(raw, starts, lower=False)
            n = high - low
            doc, phrase, run, a, z = _runs(words, first)
            columns = [_ragged(v, doc, n, t) for v, t in ((phrase, pa.int64()), (run, pa.int64()), (a, pa.int32()), (z, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(low, n) for i in range(3)), *columns], ["k1", "k2", "m", "phrase", "run", "a", "z"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(phrase, run, n, many, text): the words of the wanted runs of (text, runs), with one space between."""
    for batch in batches:
        for low, high, raw, starts in chunks(batch.column(0)):
            _, begin, end, first = hashed_words(raw, starts, lower=False)
            out: list[list] = [[], [], [], [], []]
            for i, runs in enumerate(batch.column(1).slice(low, high - low).to_pylist()):
                for r in runs:
                    words = raw[begin[first[i] + r["a"]] : end[first[i] + r["z"] + WINDOW - 1]].tobytes().split()
                    for column, value in zip(out, (r["phrase"], r["run"], r["n"], r["many"], b" ".join(words).decode()), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["phrase", "run", "n", "many", "text"])


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last place of each stretch of places that are marked."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2] - 1


def patterns(texts: list[bytes], counts: np.ndarray) -> set[bytes]:
    """The first and the last window of each stretch of windows that recur, by their hashes, in the segments of a shard."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    words, begin, end, first = hashed_words(raw, starts, lower=False)
    place = np.arange(len(words) - WINDOW + 1)
    of = np.searchsorted(first, place, "right") - 1
    place = place[place + WINDOW <= first[of + 1]]
    h = _Spans(words)(place, place + WINDOW)
    _, which = np.unique(h, return_inverse=True)
    again = np.bincount(which, counts[of[place]])[which] > 1
    marked = np.zeros(len(words) + 1, bool)
    marked[place[again]] = True
    found = set()
    for i in range(len(texts)):
        for s in {*np.concatenate(_stretches(marked[first[i] : first[i + 1]])).tolist()}:
            found.add(b" " + raw[begin[first[i] + s] : end[first[i] + s + WINDOW - 1]].tobytes() + b" ")
    return found


def covered(texts: list[bytes], counts: np.ndarray, passages: set[bytes]) -> list[list[tuple[int, int]]]:
    """The stretches of words [i, j) of each segment that confirmed passages cover; counts: how often each segment occurs."""
    import ahocorasick

    if not passages:
        return [[] for _ in texts]
    automaton = ahocorasick.Automaton()
    for i, passage in enumerate(passages):
        automaton.add_word(passage.decode("latin-1"), (i, len(passage)))
    automaton.make_automaton()
    times, hits = np.zeros(len(passages), np.int64), []
    for text, n in zip(texts, counts.tolist(), strict=True):
        stream = b" " + text + b" "
        found = [(end - length + 1, i) for end, (i, length) in automaton.iter(stream.decode("latin-1"))]
        for _, i in found:
            times[i] += n
        hits.append((np.flatnonzero(np.frombuffer(stream, np.uint8) == 32), found))
    out = []
    for gaps, found in hits:
        at = np.searchsorted(gaps, [place for place, i in found if times[i] > 1])
        cover = np.zeros(len(gaps) + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        low, high = _stretches(np.cumsum(cover) > 0)
        out.append(list(zip(low.tolist(), (high + 1).tolist(), strict=True)))
    return out


_SPANS = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))


def _shard(rows: list[tuple]) -> pa.RecordBatch:
    """(phrase, run, spans) of the segments of a shard that lose words."""
    texts, counts = [r[3].encode() for r in rows], np.array([r[2] for r in rows], np.int64)
    spans = covered(texts, counts, patterns(texts, counts))
    hit = [i for i, s in enumerate(spans) if s]
    return pa.RecordBatch.from_arrays(
        [pa.array([rows[i][0] for i in hit], pa.int64()), pa.array([rows[i][1] for i in hit], pa.int64()), pa.array([[{"i": a, "j": b} for a, b in spans[i]] for i in hit], _SPANS)], ["phrase", "run", "spans"]
    )


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shards of a task's segments (phrase, run, n, text), which come by phrase; a phrase is in one shard."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if size >= SHARD_BYTES and row[0] != rows[-1][0]:
                yield _shard(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield _shard(rows)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, phrase, run, s, n): each window of the segments (phrase, run, n, text)."""
    for batch in batches:
        for low, high, raw, starts in chunks(batch.column(3)):
            words, _, _, first = hashed_words(raw, starts, lower=False)
            with np.errstate(over="ignore"):
                hashes = [_Spans(words), _Spans(mix(words ^ _OTHER))]
            n = np.diff(first) - WINDOW + 1
            row = np.repeat(np.arange(high - low), n)
            s = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            place, take = first[row] + s, pa.array(row + low)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(h(place, place + WINDOW).view(np.int64)) for h in hashes), batch.column(0).take(take), batch.column(1).take(take), pa.array(s.astype(np.int32)), batch.column(2).take(take)],
                ["h1", "h2", "phrase", "run", "s", "n"],
            )


def _gone(spans: list[dict], n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for x in spans:
        out[x["i"] : x["j"]] = True
    return out


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c1, c2, n_removed, kept_sha256) of the sequences (k1, k2, text, spans)."""
    for batch in batches:
        removed, kept = [], []
        for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = text.encode().split()
            gone = _gone(spans, len(words))
            removed.append(int(gone.sum()))
            kept.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["c1", "c2", "n_removed", "kept_sha256"])


def _cut(text: str, gone: np.ndarray) -> str:
    """The text without the words that are gone, each cut up to the next word; other white space stays as it is."""
    raw = text.encode()
    _, first, _, _ = hashed_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=False)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    at = np.append(first, len(raw))[edges].tolist()
    pieces, done = [], 0
    for i, j in zip(at[::2], at[1::2], strict=True):
        pieces.append(raw[done:i])
        done = j
    return b"".join([*pieces, raw[done:]]).decode()


class _Found:
    """The tables of one call: sequences (k1, k2, text, m) and, of those that lose words, covers (k1, k2, spans)."""

    def __init__(self, docs: DataFrame, text: str):
        self.scratch = Scratch(docs.sparkSession, "repeats")
        table, drop = self.scratch.table, self.scratch.drop
        key = ["k1", "k2"]
        texts = docs.select(F.col(text).cast("string").alias("text"))
        self.sequences = table(texts.mapInArrow(_sequences, "k1 long, k2 long, text string").groupBy(*key).agg(F.first("text").alias("text"), F.count("*").alias("m")), "sequences")
        rows = self.sequences.select(*key, "m", "text").mapInArrow(_sequence_runs, "k1 long, k2 long, m long, phrase array<long>, run array<long>, a array<int>, z array<int>")
        rows = table(rows, "runs")
        runs = rows.select(*key, "m", F.explode(F.arrays_zip("phrase", "run", "a", "z")).alias("r")).select(*key, "m", "r.*")
        # The place of a run is the first one that is seen: any will do, for the words are the same.
        kinds = table(runs.groupBy("phrase", "run").agg(F.sum("m").alias("n"), *[F.first(c).alias(c) for c in ("k1", "k2", "a", "z")]), "all-kinds")
        often = kinds.groupBy("phrase").agg(F.sum("n").alias("places"), F.count("*").alias("runs")).filter("places > 1")
        often = table(often.select("phrase", (F.col("runs") > MOST_RUNS).alias("many")), "often")  # on its own, so that a frequent phrase can be split in the join
        kinds = table(kinds.join(often, "phrase"), "kinds")
        drop("all-kinds", "often")
        wanted = kinds.groupBy(*key).agg(F.collect_list(F.struct("phrase", "run", "n", "many", "a", "z")).alias("runs"))  # those of one sequence
        segments = self.sequences.join(wanted, key).select("text", "runs").mapInArrow(_segments, "phrase long, run long, n long, many boolean, text string")
        segments = table(segments, "segments")
        drop("kinds")
        spans = "array<struct<i:int,j:int>>"
        dealt = segments.filter("not many").select("phrase", "run", "n", "text").repartition("phrase").sortWithinPartitions("phrase")
        hits = dealt.mapInArrow(_streamed, f"phrase long, run long, spans {spans}")
        windows = segments.filter("many").select("phrase", "run", "n", "text").mapInArrow(_windows, "h1 long, h2 long, phrase long, run long, s int, n long")
        windows = table(windows, "windows")
        again = table(windows.groupBy("h1", "h2").agg(F.sum("n").alias("places")).filter("places > 1").select("h1", "h2"), "again")
        single = windows.join(again, ["h1", "h2"]).groupBy("phrase", "run").agg(F.collect_list(F.struct(F.col("s").alias("i"), (F.col("s") + WINDOW).alias("j"))).alias("spans"))
        hits = table(hits.unionByName(single.select("phrase", "run", F.col("spans").cast(spans))), "hits")
        drop("segments", "windows", "again")
        covers = runs.join(hits, ["phrase", "run"]).select(*key, F.explode(F.transform("spans", lambda x: F.struct((F.col("a") + x["i"]).alias("i"), (F.col("a") + x["j"]).alias("j")))).alias("x"))
        self.covers = table(covers.groupBy(*key).agg(F.collect_list("x").alias("spans")), "covers")
        drop("runs", "hits")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs."""
    found = _Found(docs, text)
    table = found.scratch.table
    cut = found.sequences.select("k1", "k2", "text").join(found.covers, ["k1", "k2"]).mapInArrow(_digested, "c1 long, c2 long, n_removed long, kept_sha256 string")
    cut = table(cut, "cut")
    found.scratch.drop("sequences", "covers")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = texts.mapInArrow(_summaries, "doc_id long, k1 long, k2 long, n_words long, sha string")
    out = rows.join(cut, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def _with_keys(text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw, starts in chunks(batch.column(text_at)):
                words, _, _, first = hashed_words(raw, starts, lower=False)
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, *_keys(words, first)], [*batch.schema.names, *names])

    return run


def _without(text_at: int, spans_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            for i, spans in enumerate(batch.column(spans_at).to_pylist()):
                if spans:
                    texts[i] = _cut(texts[i], _gone(spans, len(texts[i].encode().split())))
            columns = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns) if i != spans_at]
            yield pa.RecordBatch.from_arrays(columns, [n for i, n in enumerate(batch.schema.names) if i != spans_at])

    return run


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the repeated passages cut out of the text; texts that lose nothing stay as they are."""
    covers = _Found(docs, text).covers
    k1, k2, c1, c2, spans = fresh(docs, "k1", "k2", "c1", "c2", "spans")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(k1, T.LongType()), T.StructField(k2, T.LongType())])
    keyed = docs.mapInArrow(_with_keys(at, [k1, k2]), schema)
    covers = covers.select(F.col("k1").alias(c1), F.col("k2").alias(c2), F.col("spans").alias(spans))
    out = keyed.join(covers, (F.col(k1) == F.col(c1)) & (F.col(k2) == F.col(c2)), "left").select(*docs.columns, spans)
    return out.mapInArrow(_without(at, len(docs.columns)), docs.schema)
