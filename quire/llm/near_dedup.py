"""MinHash near-dedup with sequential Bayesian verification.

1. One pass over the texts makes, for each document, the size and a 128-bit fingerprint of its set of five-word
   shingles, BANDS band keys of ROWS minhashes each and a sketch of SKETCH minhashes at 8 bits.
2. Documents with equal sets are one class; its least id stands for it, so copies are never compared.
3. Representatives that share a band key are candidates, but for those that an exact bound rules out: two sets have no
   more in common than the shingles of either that stand in more than RARE of the candidates' texts, and the rare ones
   that both hold.  Pairs that share rare shingles are enumerated from these (RARE texts each at most); for all others
   the bound is the number of a text's frequent shingles.  Texts that differ from a large group by shingles of their
   own, and cannot reach the threshold with any of it, are so never paired with the group.
4. In each bucket the texts are first compared with one hub only, HUB_ROUNDS times; after each round the components of
   all links are found, and buckets that lie within one component are done.  The pairs between components that then remain,
   and that the bound admits, are all compared.
5. A pair's sketches are compared BATCH hashes at a time; it is dropped as soon as the posterior probability (uniform
   prior) that its similarity reaches the threshold falls below MISS.  Survivors are confirmed on their full sets.

A pair at the threshold itself is missed with a probability of about 1e-5: that of sharing none of BANDS keys, each with
0.75**ROWS (4e-6), plus MISS for each batch.  Shingles are compared by 64-bit hashes.  A bucket of texts that are all
alike, just below the threshold, by shingles that they share with many, costs pairs in the square of its size.

Null and empty texts have no shingles and are linked with nothing: their component is their own id.  Texts of any length
are taken whole.  Rows that repeat an id are one document: what one of its texts is linked with, all its rows with
shingles are.  Rows without an id have the component of the texts that equal theirs, null where all of these are without
an id, and are kept.  Ties: the least id stands for its group.  Other columns have no part.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.names import fresh
from quire.llm.scratch import Scratch
from quire.llm.words import chunks, hashed_words, mix, runs_hashed

WIDTH = 5
THRESHOLD = (75, 100)
BANDS, ROWS = 64, 6
SKETCH, BATCH, MISS = 256, 32, 1e-6
#: A shingle in at most so many texts is rare.
RARE = 4
HUB_ROUNDS = 1
_RNG = np.random.Generator(np.random.PCG64(75))
_FLIP = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_ODD = _RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(raw: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    words, _, _, first = hashed_words(raw, starts, lower=True)
    five = runs_hashed(words, WIDTH, WIDTH)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        out.append(np.unique(five[a : b - WIDTH + 1]) if n >= WIDTH else runs_hashed(words[a:b], n, n) if n else five[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minhashes, one row for each hash function and one column for each set that is not empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out, v = np.empty((BANDS * ROWS, len(sets)), np.uint32), np.empty_like(flat)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            np.bitwise_xor(flat, _FLIP[k], out=v)
            np.multiply(v, _ODD[k], out=v)
            out[k] = np.minimum.reduceat(v, starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys; the band's number is part of its key."""
    x = sig.reshape(BANDS, ROWS, -1).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        for r in range(ROWS):
            key = mix(key ^ x[:, r]) * np.uint64(0xD6E8FEB86659FD93)
    return mix(key).view(np.int64).T


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, raw, starts in chunks(batch.column(1)):
            sets = shingle_sets(raw, starts)
            full = [i for i, s in enumerate(sets) if len(s)]
            n = high - low
            prints = np.zeros((2, n), np.int64)
            bands: list = [None] * n
            sketch: list = [None] * n
            if full:
                sig = signatures([sets[i] for i in full])
                keys, sketches = band_keys(sig), sig[:SKETCH].astype(np.uint8).T.copy()
                for j, i in enumerate(full):
                    bands[i], sketch[i] = keys[j], sketches[j].tobytes()
                    with np.errstate(over="ignore"):
                        prints[0, i], prints[1, i] = np.stack([mix(sets[i]).sum(), mix(sets[i] ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[0]), pa.array(prints[1]), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"],
            )


def least_matches(n: int) -> int:
    """The least number of equal hashes among n at which the posterior probability of reaching the threshold is MISS or more."""
    s = THRESHOLD[0] / THRESHOLD[1]
    p = s + (1 - s) / 256  # 8 bits agree by chance, too
    below = 0.0
    for m in range(n + 1):  # 1 - I_p(m + 1, n - m + 1) = P(Bin(n + 1, p) <= m)
        below += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        if below >= MISS:
            return m
    return n


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, matches) of the pairs (a, b, sketch of a, sketch of b) that no batch of hashes rules out."""
    least = [least_matches(n) for n in range(BATCH, SKETCH + 1, BATCH)]
    for batch in batches:
        for low in range(0, batch.num_rows, 1 << 14):
            part = batch.slice(low, 1 << 14)
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in (2, 3))
            alive, matches = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
            for k, m in enumerate(least):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (x[alive, cut] == y[alive, cut]).sum(1)
                stay = matches >= m
                alive, matches = alive[stay], matches[stay]
            take = pa.array(alive)
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(matches)], ["a", "b", "matches"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, text of a, text of b) that are linked."""
    num, den = THRESHOLD
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            part = batch.slice(low, 64)
            left, right = ([s for _, _, raw, starts in chunks(part.column(c)) for s in shingle_sets(raw, starts)] for c in (2, 3))
            linked = []
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                if den * min(len(x), len(y)) >= num * max(len(x), len(y)) > 0:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if den * both >= num * (len(x) + len(y) - both):
                        linked.append(i)
            take = pa.array(linked, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take)], ["a", "b"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, s): the shingles of the texts of (node, text)."""
    for batch in batches:
        for low, high, raw, starts in chunks(batch.column(1)):
            sets = shingle_sets(raw, starts)
            rows = pa.array(np.repeat(np.arange(low, high), [len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.concatenate(sets).view(np.int64))], ["node", "s"])


def _admits(common: Column, n: Column) -> Column:
    """Whether sets of n shingles together can reach the threshold with so many in common."""
    num, den = THRESHOLD
    return (num + den) * common >= num * n


class _Search:
    """The links between representatives (node, n_shingles, bands, sketch), found round by round."""

    def __init__(self, reps: DataFrame, texts: DataFrame, scratch: Scratch):
        self.scratch = scratch
        rows = reps.select("node", F.explode("bands").alias("band"))
        shared = rows.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("band")
        shared = scratch.table(shared, "shared")
        self.buckets = scratch.table(rows.join(shared, "band").distinct(), "buckets")
        nodes = scratch.table(self.buckets.select("node").distinct(), "nodes")
        self.sketches = scratch.table(reps.select("node", "n_shingles", "sketch").join(nodes, "node", "left_semi"), "sketches")
        self.texts = scratch.table(texts.withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi").distinct(), "texts")
        scratch.drop("shared", "nodes")

    def bounds(self) -> tuple[DataFrame, DataFrame]:
        """((node, n, c) of texts with enough frequent shingles, pairs (a, b) that share rare ones and that the bound admits).

        n: the size of a node's set, c: how many of its shingles are frequent.  (A node with several texts: the least size and
        the sum, so that the bound holds for each of them.)"""
        table = self.scratch.table
        shingles = table(self.texts.mapInArrow(_shingled, "node long, s long"), "shingles")
        lows = table(shingles.groupBy("s").agg(F.count("*").alias("texts")).filter(F.col("texts") <= RARE), "lows")
        few = table(shingles.join(lows, "s").select("s", "node", (F.col("texts") == 1).alias("alone")), "few")
        self.scratch.drop("shingles", "lows")
        sizes = self.sketches.groupBy("node").agg(F.min("n_shingles").alias("n"), F.sum("n_shingles").alias("all"))
        held = few.groupBy("node").agg(F.count(F.when(F.col("alone"), 1)).alias("own"), F.count(F.when(~F.col("alone"), 1)).alias("rare"))
        bound = sizes.join(held, "node", "left").fillna(0, ["own", "rare"]).withColumn("c", F.col("all") - F.col("own") - F.col("rare"))
        bound = table(bound.filter(_admits(F.col("c") + F.col("rare"), F.col("n") + F.col("c") + F.col("rare"))).select("node", "n", "c"), "bound")
        both = few.filter("not alone").join(bound.select("node"), "node").groupBy("s").agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # RARE at most
        pairs = F.flatten(F.transform("nodes", lambda x, i: F.transform(F.slice("nodes", F.lit(1), i), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        both = both.select(F.explode(pairs).alias("p")).filter("p.a > p.b").groupBy("p.a", "p.b").agg(F.count("*").alias("rare"))
        a, b = (bound.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}")) for x in "ab")
        both = both.join(a, "a").join(b, "b").filter(_admits(F.least("ca", "cb") + F.col("rare"), F.col("na") + F.col("nb"))).select("a", "b")
        both = table(both, "sharing")
        self.scratch.drop("few")
        return bound.filter(_admits(F.col("c"), F.col("n") + F.col("c"))), both

    def linked(self, pairs: DataFrame, best: bool, name: str) -> DataFrame:
        """The links among candidate pairs (a, b); best: only each a's likeliest partner is tried."""
        table = self.scratch.table
        pairs = table(pairs, f"{name}-pairs")
        x = self.sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
        y = self.sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
        left = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_pruned, "a long, b long, matches long")
        if best:
            left = left.groupBy("a").agg(F.max_by("b", F.struct("matches", -F.col("b"))).alias("b"))
        left = table(left.select("a", "b"), f"{name}-left")
        tx = self.texts.select(F.col("node").alias("a"), F.col("text").alias("tx"))
        ty = self.texts.select(F.col("node").alias("b"), F.col("text").alias("ty"))
        out = table(left.join(tx, "a").join(ty, "b").select("a", "b", "tx", "ty").mapInArrow(_confirmed, "a long, b long"), f"{name}-links")
        self.scratch.drop(f"{name}-pairs", f"{name}-left")
        return out

    def components(self, given: DataFrame) -> DataFrame:
        """(node, component) of all nodes that links or the given ones (a, b) join."""
        table = self.scratch.table
        core, rare = self.bounds()
        links = self.linked(rare, False, "rare").unionByName(given)
        found = None
        core = table(self.buckets.join(core, "node"), "core")
        side = [F.col(c).alias(f"{c}2") for c in ("node", "n", "c", "component")]
        for k in range(HUB_ROUNDS + 1):
            at = core.withColumn("component", F.col("node")) if found is None else core.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
            # The least node is the hub of the first round; other rounds take other hubs, dealt by bucket.
            order = F.col("node") if k == 0 else F.xxhash64("node", "band", F.lit(k))
            hubs = at.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(F.struct(*side), order).alias("hub"))
            hubs = table(hubs.filter("low < high").select("band", "hub"), f"hubs-{k}")  # on its own, so that a large bucket can be split in the join
            if hubs.isEmpty():  # all buckets are done
                break
            if k < HUB_ROUNDS:
                pairs = at.join(hubs.select("band", "hub.*"), "band").filter("component <> component2")
            else:
                mixed = table(at.join(hubs.select("band"), "band"), "mixed")
                of = table(mixed.groupBy("node").agg(F.collect_list("band").alias("bands")), "bands")  # BANDS at most
                mixed = table(mixed.join(of, "node"), "dealt")
                pairs = mixed.join(mixed.select("band", *side, F.col("bands").alias("bands2")), "band").filter("component > component2")
            pairs = pairs.filter(_admits(F.least("c", "c2"), F.col("n") + F.col("n2")))
            if k == HUB_ROUNDS:
                pairs = pairs.filter(F.col("band") == F.array_min(F.array_intersect("bands", "bands2")))  # each pair in one bucket
            pairs = pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
            new = self.linked(pairs, k < HUB_ROUNDS, f"round-{k}")
            self.scratch.drop(f"hubs-{k}")
            if found is None:
                links = links.unionByName(new)
            elif not new.isEmpty():
                links = new.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
            else:
                continue
            found = table(components(links, self.scratch, f"components-{k}"), f"found-{k}")
        return table(components(links, self.scratch, "components"), "found") if found is None else found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; component_id: the least id that links reach; kept: that id's own rows."""
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    features = texts.mapInArrow(_features, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary")
    features = scratch.table(features.withColumn("row", F.monotonically_increasing_id()), "features")
    sets = ["n_shingles", "f1", "f2"]
    # Each class by one of its rows, that with the least id; only narrow rows are sorted.
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("one")
    classes = features.filter("n_shingles > 0").groupBy(*sets).agg(least)
    classes = scratch.table(classes.select(*sets, F.col("one.doc_id").alias("node"), "one.row"), "classes")
    members = scratch.table(features.select("doc_id", *sets).join(classes.select(*sets, "node"), sets, "left").select("doc_id", "n_shingles", "node"), "members")
    chosen = classes.filter("node is not null").select("row", "node").hint("shuffle_hash")
    reps = scratch.table(features.join(chosen, "row").select("node", "n_shingles", "bands", "sketch"), "reps")
    scratch.drop("features", "classes")
    # An id with several texts stands for them all.
    nodes = members.filter("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("top")).filter("b < top")
    nodes = scratch.table(nodes.select("doc_id", "b"), "repeated")
    given = members.join(nodes, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    found = _Search(reps, texts, scratch).components(given)
    scratch.drop("reps")
    out = members.join(found, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one of each group of near duplicates: those of its least id.

    Where ids repeat, each text of an id is a document of its own, and rows with the same id and text are one.  Rows
    without an id all stay."""
    nulls, named = docs.filter(F.col(doc_id).isNull()), docs.filter(F.col(doc_id).isNotNull())
    id_, h1, h2, n, number, value = fresh(docs, "id", "h1", "h2", "n", "number", "value")
    if named.groupBy(doc_id).count().filter("count > 1").isEmpty():
        kept = near_duplicates(named, doc_id, text).filter("kept").select(F.col("doc_id").alias(id_))
        return named.join(kept, F.col(doc_id).cast("long") == F.col(id_)).select(*docs.columns).unionByName(nulls)
    # Texts are told apart by two hashes and numbered in the order of ids, so that the least id stays the least.
    whole = F.col(text).cast("string")
    keyed = named.withColumns({id_: F.col(doc_id).cast("long"), h1: F.xxhash64(whole), h2: F.xxhash64(F.lit(1), whole)})
    key = [id_, h1, h2]
    scratch = Scratch(docs.sparkSession, "numbers")
    numbers = keyed.groupBy(*key).agg(F.count("*").alias(n)).orderBy(*key)
    numbers = scratch.table(numbers.withColumn(number, F.monotonically_increasing_id()), "numbers")
    numbered = scratch.table(keyed.join(numbers, key).select(number, whole.alias(value)).distinct(), "numbered")
    kept = near_duplicates(numbered, number, value).filter("kept").select(F.col("doc_id").alias(number)).distinct()
    chosen = scratch.table(numbers.join(kept, number), "chosen")
    rows = keyed.join(chosen, key)
    once = rows.filter(F.col(n) == 1).select(*docs.columns)
    again = rows.filter(F.col(n) > 1).dropDuplicates(key).select(*docs.columns)
    return once.unionByName(again).unionByName(nulls)
