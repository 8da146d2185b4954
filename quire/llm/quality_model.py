"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams: of character classes (one to three), of words (one and two, hashed), and of how
much its words and word triples repeat, and words their predecessors.  Indicators are scaled by the log ratio of their smoothed shares in the two
classes, and a linear hinge-loss model is fitted on them by dual coordinate descent.  Margins become scores by a
logistic fit on a fifth of the sample that the model does not see.

The model is fitted on a sample of about SAMPLE distinct labelled texts (id, label, text), drawn and put in order by
hashes, so that reruns and other partitionings fit the same model; every row is scored.
Null and empty texts are sets of few n-grams and get a score like any other; texts of any length are taken whole.
Labels other than 0 and 1 are left out; an id with both labels, or with several texts, gives a row for each, and rows
that repeat count once.  Rows without an id are scored, but have no label.  With labels of one class only, or none, all
scores are the share of label 1, or 0.5.  Ties: equal texts have equal scores.  Other columns have no part, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch
from quire.llm.words import chunks, hashed_words, runs_hashed

SAMPLE = 12_000
PENALTY, EPOCHS = 0.1, 10
WORD_BITS = 17
THRESHOLD = 0.3

# Character classes: one for each kind of letter, digit and space, and one for each mark.
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[0x80:0xC0] = 6
_CLASS[0xC0:] = 7
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_MARKS] = np.arange(8, 8 + len(_MARKS))
CLASSES = 8 + len(_MARKS)
_ONE, _TWO, _THREE = 0, CLASSES, CLASSES + CLASSES**2
_WORDS = _THREE + CLASSES**3
_REPEATS = _WORDS + (1 << WORD_BITS)
FEATURES = _REPEATS + 36


def feature_sets(raw: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The sorted features of each text of a chunk."""
    words, _, _, first = hashed_words(raw, starts, lower=True)
    pairs, triples = runs_hashed(words, 2, 2), runs_hashed(words, 3, 3)
    c = _CLASS[raw]
    mask = np.uint64((1 << WORD_BITS) - 1)
    flags = np.zeros(FEATURES, bool)
    out = []
    for i in range(len(starts) - 1):
        x, w = c[starts[i] : starts[i + 1]], words[first[i] : first[i + 1]]
        p, t = pairs[first[i] : max(first[i], first[i + 1] - 1)], triples[first[i] : max(first[i], first[i + 1] - 2)]
        flags[_ONE + x] = True
        flags[_TWO + x[:-1] * CLASSES + x[1:]] = True
        flags[_THREE + (x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:]] = True
        flags[_WORDS + (w & mask).astype(np.int64)] = True
        flags[_WORDS + (p & mask).astype(np.int64)] = True
        for j, run in enumerate((w, t)):
            flags[_REPEATS + 12 * j + (11 if not len(run) else int(10 * len(np.unique(run)) / len(run)))] = True
        flags[_REPEATS + 24 + (11 if len(w) < 2 else int(10 * (w[1:] == w[:-1]).mean()))] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        out.append(found)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nth, label, features) of the rows (nth, label, text)."""
    for batch in batches:
        for low, high, raw, starts in chunks(batch.column(2)):
            sets = pa.array([s.astype(np.int32) for s in feature_sets(raw, starts)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), sets], ["nth", "label", "features"])


def log_ratios(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    count = np.zeros((2, FEATURES))
    for s, label in zip(sets, y, strict=True):
        count[int(label > 0), s] += 1
    count += 1
    count /= count.sum(1, keepdims=True)
    return np.log(count[1] / count[0])


def hinge_fit(sets: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, seed: int = 8) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model, by dual coordinate descent; classes weigh the same."""
    w, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(y))
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    top = PENALTY * 0.5 / share[(y > 0).astype(int)]
    norm = np.array([v @ v for v in values]) + 1.0
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)).tolist():
            s, v = sets[i], values[i]
            slope = y[i] * (w[s] @ v + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), top[i])
            d = (new - alpha[i]) * y[i]
            if d:
                w[s] += d * v
                bias += d
                alpha[i] = new
                moved = max(moved, abs(slope))
        if moved < 1e-3:
            break
    return w, bias


def logistic_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))), by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * margin * margin).sum(), (r * margin).sum()], [(r * margin).sum(), r.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def fit(sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights for each feature, then the bias: the score is the logistic of their sum."""
    out = np.zeros(FEATURES + 1, np.float32)
    if not len(labels) or labels.min() == labels.max():
        share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
        out[-1] = np.log(share / (1 - share))
        return out
    y = np.where(labels > 0, 1.0, -1.0)
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    seen = np.flatnonzero(~held)
    ratio = log_ratios([sets[i] for i in seen], y[seen])
    # Each text is scaled to unit length.
    unit = lambda s: ratio[s] / max(np.linalg.norm(ratio[s]), 1e-9)
    w, bias = hinge_fit([sets[i] for i in seen], [unit(sets[i]) for i in seen], y[seen])
    test = np.flatnonzero(held) if held.any() else seen
    a, b = logistic_fit(np.array([w[sets[i]] @ unit(sets[i]) + bias for i in test]), y[test])
    return np.concatenate([a * w, ratio, [a * bias + b]]).astype(np.float32)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets, labels, nth = [], [], []
    for batch in batches:
        nth += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
        f = batch.column(2)
        at, flat = f.offsets.to_numpy(), f.values.to_numpy()
        sets += [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    order = sorted(range(len(nth)), key=lambda i: (nth[i], labels[i], sets[i].tobytes()))
    model = fit([sets[i].astype(np.int64) for i in order], np.array([labels[i] for i in order], np.float64))
    yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], ["model"])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.frombuffer(shared.value, np.float32).astype(np.float64)
        w, ratio, bias = (m[:FEATURES], m[FEATURES:-1], m[-1]) if len(m) > FEATURES + 1 else (m[:-1], None, m[-1])
        for batch in batches:
            for low, high, raw, starts in chunks(batch.column(2)):
                part = batch.slice(low, high - low)
                if ratio is None:
                    margin = np.full(high - low, bias)
                else:
                    margin = np.array([w[s] @ ratio[s] / max(np.linalg.norm(ratio[s]), 1e-9) + bias for s in feature_sets(raw, starts)])
                score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; learns from the labels of rows that are not held out."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "labels")
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("string").alias("text"))
    named = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("l_id"), F.col(label).cast("double").alias("label")).distinct()
    named = scratch.table(named, "named")
    seen = rows.filter(~F.coalesce("held_out", F.lit(False))).withColumn("t", F.xxhash64("text"))
    pairs = seen.select("doc_id", "t").join(named, F.col("doc_id") == F.col("l_id")).select("l_id", "label", "t").distinct()
    pairs = scratch.table(pairs.withColumn("nth", F.xxhash64("l_id", "label", "t")), "pairs")
    n = pairs.count()
    if n > SAMPLE:
        pairs = pairs.filter(F.pmod("nth", F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
    sample = scratch.table(pairs.withColumnRenamed("t", "l_t"), "sample")  # about SAMPLE rows, so that it can be broadcast
    known = seen.join(F.broadcast(sample), (F.col("doc_id") == F.col("l_id")) & (F.col("t") == F.col("l_t"))).select("nth", "label", "text").dropDuplicates(["nth", "label"])
    model = known.mapInArrow(_features, "nth long, label double, features array<int>").repartition(1).mapInArrow(_fitted, "model binary").first()
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(bytes(model[0]) if model else fit([], np.zeros(0)).tobytes())
    return rows.mapInArrow(_scored(shared), f"doc_id {kind}, held_out boolean, score double, predicted int")
