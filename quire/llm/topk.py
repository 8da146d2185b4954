"""Exact top-k search by distributed histogram selection.

Vectors become integers (floor(scale * x)), are packed into blocks, and every block of queries meets every block of
candidates once in a round.  A round bins the scores of each query from a bound down to a width of one: each cell
(query block, candidate block) counts its scores by bin, tile by tile, and sends only the bins at the top that hold its
own k best, which include all bins that the global k-th value can lie in.  Sums over cells locate the bin of the k-th
score, the next round splits that bin, and when bins are one wide the k-th value is known.  A last pass keeps the scores
above it and, of those equal to it, the smallest ids.  A cell moves n_queries + n_candidates vectors for their product
in scores, so blocks are large and tiles bound the memory.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id.  Components may be
as large as a double can be: scores are exact integers up to LIMIT on either side, and set to it beyond.  Only vectors
of a query's own length are its candidates.  Rows that repeat an id are queries and candidates of their own, but no
row is a candidate for a query with its id.  Ties go to smaller ids.  Empty vectors score 0.  Other columns have no
part, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch

QUERY_BLOCK, BLOCK = 8192, 16384
QUERY_TILE, TILE = 1024, 4096
BIN_BITS = 11
LIMIT = (1 << 62) - 1
#: Block ids are dealt to so many tasks when cells are listed.
SALTS = 64
_PACKED = "dim int, part int, nth int, n int, ids binary, vectors binary, most long"


def _integers(values: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each usable vector, its row, all their integers)."""
    n = len(values)
    flat = values.flatten()
    lengths = np.where(values.is_valid().to_numpy(zero_copy_only=False), np.diff(values.offsets.to_numpy()), 0)
    x = np.floor(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
    row = np.repeat(np.arange(n), lengths)
    bad = np.zeros(n, bool)
    bad[row[~np.isfinite(x)]] = True
    good = values.is_valid().to_numpy(zero_copy_only=False) & ~bad
    rows = np.flatnonzero(good)
    return lengths[rows], rows, x[good[row]]


def _blocks(size: int, scale: float):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths, rows, x = _integers(batch.column(1), scale)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[rows] if len(rows) else np.zeros(0, np.int64)
            at = np.concatenate(([0], np.cumsum(lengths)))
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                for low in range(0, len(own), size):
                    some = own[low : low + size]
                    v = x[(at[some][:, None] + np.arange(dim)).ravel()]
                    most = min(int(np.abs(v).max()), LIMIT) if len(v) else 0
                    kind = np.int32 if most < 2**31 else np.float64
                    row = [dim, part, nth, len(some), ids[some].astype(np.int64).tobytes(), v.astype(kind).tobytes(), most]
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["dim", "part", "nth", "n", "ids", "vectors", "most"])
                    nth += 1

    return pack


def _matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["vectors"], np.int32 if row["most"] < 2**31 else np.float64).reshape(row["n"], row["dim"])


def _wide(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers of any size, within LIMIT: those of large vectors one by one."""
    most = math.isqrt(LIMIT // max(1, x.shape[1]))
    big_x, big_y = (np.abs(v).max(1, initial=0) > most for v in (x, y))
    out = np.zeros((len(x), len(y)), np.int64)
    out[np.ix_(~big_x, ~big_y)] = x[~big_x].astype(np.int64) @ y[~big_y].astype(np.int64).T
    whole = [[[int(c) for c in row] for row in v] for v in (x, y)]
    for i, j in np.argwhere(big_x[:, None] | big_y[None, :]).tolist():
        out[i, j] = min(max(sum(a * b for a, b in zip(whole[0][i], whole[1][j], strict=True)), -LIMIT), LIMIT)
    return out


def _tiles(q: dict, c: dict, low: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first query, first candidate, exact scores) of each tile of a cell, by query; below any low where a candidate has the query's id.

    Scores have 32 bits if the cell's bound and all lows leave room for their differences, else 64."""
    x, y = _matrix(q), _matrix(c)
    bound = q["dim"] * q["most"] * c["most"]
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else None
    narrow = bound < 2**30 and len(low) > 0 and int(np.abs(low).max()) < 2**30
    none = -(2**30) if narrow else -(2**62) - 1
    qi, ci = np.frombuffer(q["ids"], np.int64), np.frombuffer(c["ids"], np.int64)
    if kind is not None:
        x, y = x.astype(kind), y.astype(kind)
    for i in range(0, len(qi), QUERY_TILE):
        for j in range(0, len(ci), TILE):
            u, v = x[i : i + QUERY_TILE], y[j : j + TILE]
            s = (_wide(u, v) if kind is None else u @ v.T).astype(np.int32 if narrow else np.int64)
            mine, theirs = qi[i : i + QUERY_TILE], ci[j : j + TILE]
            order = np.argsort(theirs, kind="stable")
            first, end = np.searchsorted(theirs, mine, "left", order), np.searchsorted(theirs, mine, "right", order)
            for r in np.flatnonzero(first < end):
                s[r, order[first[r] : end[r]]] = none
            yield i, j, s


def _state(q: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(q["low"], np.int64), np.frombuffer(q["need"], np.int64)


def _histogram(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """(qblock, qpos, bin, n) of one cell: its top bins until they hold as many scores as the query needs."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
    block = 0

    def close(first: int, counts: np.ndarray, need: np.ndarray) -> None:
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        row, bin_ = np.nonzero((counts > 0) & (above < need[:, None]))
        for column, value in zip(out, (row + first, bin_, counts[row, bin_]), strict=True):
            column.append(value)

    if left.num_rows and right.num_rows:
        c, q = left.to_pylist()[0], right.to_pylist()[0]
        (low, need), shift, bins = _state(q), q["shift"], 1 << q["bits"]
        block, at, counts = q["qblock"], 0, np.zeros((min(QUERY_TILE, len(low)), bins), np.int64)
        for i, _, s in _tiles(q, c, low):
            if i != at:
                close(at, counts, need[at : at + QUERY_TILE])
                at, counts = i, np.zeros((min(QUERY_TILE, len(low) - i), bins), np.int64)
            d = s - low[i : i + QUERY_TILE].astype(s.dtype)[:, None]
            d >>= shift
            row, k = np.nonzero((d >= 0) & (d < bins))
            counts += np.bincount(row * bins + d[row, k], minlength=counts.size).reshape(counts.shape)
        close(at, counts, need[at : at + QUERY_TILE])
    row, bin_, n = (np.concatenate(x) for x in out)
    return pa.table({"qblock": pa.array(np.full(len(row), block), pa.int64()), "qpos": pa.array(row, pa.int32()), "bin": pa.array(bin_, pa.int32()), "n": pa.array(n, pa.int64())})


def _best(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """(qblock, qpos, query_id, vec_id, score) of a cell: scores above the k-th value, and the smallest ids that equal it."""
    rows = [np.zeros(0, np.int64)] * 4
    block = 0
    if left.num_rows and right.num_rows:
        c, q = left.to_pylist()[0], right.to_pylist()[0]
        block, (low, need) = q["qblock"], _state(q)
        ci = np.frombuffer(c["ids"], np.int64)
        hits: list[list[np.ndarray]] = [[], [], []]
        for i, j, s in _tiles(q, c, low):
            r, k = np.nonzero(s >= low[i : i + QUERY_TILE].astype(s.dtype)[:, None])
            for column, value in zip(hits, (r + i, k + j, s[r, k].astype(np.int64)), strict=True):
                column.append(value)
        r, k, score = (np.concatenate(x) for x in hits)
        order = np.lexsort((ci[k], -score, r))
        r, k, score = r[order], k[order], score[order]
        tie = score == low[r]
        # Of the ties of a query, as many as it needs; they come last in its run, by id.
        seen = np.cumsum(tie)
        start = np.searchsorted(r, r)
        nth = seen - (seen - tie)[start]
        keep = ~tie | (nth <= need[r])
        r, k = r[keep], k[keep]
        rows = [r, np.frombuffer(q["ids"], np.int64)[r], ci[k], score[keep]]
    return pa.table({"qblock": pa.array(np.full(len(rows[0]), block), pa.int64()), "qpos": pa.array(rows[0], pa.int32()), "query_id": pa.array(rows[1]), "vec_id": pa.array(rows[2]), "score": pa.array(rows[3])})


def search(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row for which ``queries`` holds, ties to smaller ids."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    both = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull())
    rows = both.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x"))
    asked = both.filter(queries).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x"))
    c = scratch.table(rows.mapInArrow(_blocks(BLOCK, scale), _PACKED), "candidates")
    # Queries are spread over few scan tasks; gather them so that their blocks are full.
    n_asked, most = asked.count(), c.agg(F.coalesce(F.max("most"), F.lit(0))).first()[0]
    q = scratch.table(asked.repartition(max(1, n_asked // QUERY_BLOCK), "id").mapInArrow(_blocks(QUERY_BLOCK, scale), _PACKED), "queries")
    q = q.withColumn("qblock", F.col("part").cast("long") * (1 << 32) + F.col("nth")).withColumn("bound", F.least(F.lit(float(most)) * F.col("most") * F.col("dim") * (1 + 2.0**-40), F.lit(float(LIMIT))).cast("long"))
    c = c.select("dim", (F.col("part").cast("long") * (1 << 32) + F.col("nth")).alias("cblock"), "n", "ids", "vectors", "most")
    bound = q.agg(F.coalesce(F.max("bound"), F.lit(0))).first()[0]
    total_bits = max(1, (2 * bound).bit_length())
    # Block ids only: which cells there are.
    salted = c.select("dim", "cblock", F.pmod(F.xxhash64("cblock"), F.lit(SALTS)).alias("salt"))
    cells = salted.join(q.select("dim", "qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")), ["dim", "salt"])
    cells = scratch.table(cells.select("cblock", "qblock"), "cells")
    n_cells = max(cells.count(), 1)
    dealt = c.join(cells, "cblock")

    def meet(state: DataFrame, shift: int, bits: int, f, schema: str) -> DataFrame:
        """f over every cell. state: qblock, qpos, low, need."""
        packed = state.groupBy("qblock").agg(F.sort_array(F.collect_list(F.struct("qpos", "low", "need"))).alias("s"))
        own = q.join(packed, "qblock")
        text = lambda field: F.transform(F.col("s"), lambda x: x[field])
        own = own.select("qblock", "dim", "n", "ids", "vectors", "most", "bound", text("low").alias("low"), text("need").alias("need"), F.lit(shift).alias("shift"), F.lit(bits).alias("bits"))
        own = own.mapInArrow(_state_packed, "qblock long, dim int, n int, ids binary, vectors binary, most long, bound long, low binary, need binary, shift int, bits int")
        parts = min(n_cells, max(4096, n_cells // 16))
        left = dealt.repartition(parts, "cblock", "qblock").groupBy("cblock", "qblock")
        right = own.join(cells, "qblock").repartition(parts, "cblock", "qblock").groupBy("cblock", "qblock")
        return left.cogroup(right).applyInArrow(f, schema)

    state = q.select("qblock", "bound", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("qpos")).select("qblock", "qpos", (-F.col("bound")).alias("low"), F.lit(k).cast("long").alias("need"))
    bits, nth = min(BIN_BITS, total_bits), 0
    shift = total_bits - bits
    while True:
        counts = meet(state, shift, bits, _histogram, "qblock long, qpos int, bin int, n long").groupBy("qblock", "qpos", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("qblock", "qpos").orderBy(F.desc("bin"))
        counts = counts.withColumn("upto", F.sum("n").over(down))
        # The bin of the k-th score; with fewer than k candidates, none is left out.
        at = state.withColumnRenamed("low", "l").withColumnRenamed("need", "m").join(counts, ["qblock", "qpos"])
        hit = at.filter("upto >= m").groupBy("qblock", "qpos").agg(F.max("bin").alias("bin"), F.min("upto").alias("upto"), F.max_by("n", "bin").alias("n"))
        new = state.join(hit, ["qblock", "qpos"], "left")
        new = new.select("qblock", "qpos", F.when(F.col("bin").isNull(), F.col("low")).otherwise(F.col("low") + F.shiftleft(F.col("bin").cast("long"), shift)).alias("low"), F.when(F.col("bin").isNull(), F.col("need")).otherwise(F.col("need") - (F.col("upto") - F.col("n"))).alias("need"))
        nth += 1
        state = scratch.table(new, f"state-{nth}")
        if shift == 0:
            break
        bits = min(BIN_BITS, shift)
        shift -= bits
    best = meet(state, 0, 0, _best, "qblock long, qpos int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("qblock", "qpos").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _state_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [pa.array([np.asarray(v, np.int64).tobytes() for v in batch.column(i).to_pylist()], pa.binary()) if name in ("low", "need") else batch.column(i) for i, name in enumerate(batch.schema.names)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
