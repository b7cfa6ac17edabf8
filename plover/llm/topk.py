"""Exact top-k search by distributed histogram selection.

Vectors become integers, ``floor(scale * x)``, so scores are exact.  Queries go in blocks of at most ``BLOCK_VALUES``
numbers, which is what a broadcast holds; every block meets all candidates.  For each block

1. every task scores its candidates (a matrix product) and counts them in ``BINS`` equal bins of the score range; only
   bins at or above the task's own k-th score are sent, as the global k-th score is never below that; counts are added;
2. the bin that holds a query's k-th score becomes its new range, and so on until a bin is one score wide: the exact
   k-th score, with the exact number of higher ones;
3. the last pass keeps scores above it, and of its ties the smallest ids of each task; a window breaks the ties.

Scores are recomputed in each pass rather than kept, as there are queries times candidates of them.

Defined results: rows with a null id or vector, or a null, NaN or infinite component, take no part.  Vectors score only
against vectors of their own length; an empty vector scores 0 against other empty ones.  A query's own rows are those
with its id; rows that repeat another candidate each count.  Fewer than k candidates give that many rows; an empty
table gives none.  Components of over 64 bits and scores of over 62 bits
saturate, so such a row stops nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.llm.common import save, save_all

BINS = 1024
BLOCK_VALUES = 1 << 20
EXACT = float(1 << 53)
MOST = (1 << 62) - 1


def quantise(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``id, v``: the integer vectors that take part."""
    x = df[vector_col].cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return df.filter(df[id_col].isNotNull() & good).select(df[id_col].cast("bigint").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"))


def _matrices(ids: pa.Array, v: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    ids = ids.to_numpy(zero_copy_only=False)
    off = v.offsets.to_numpy()
    flat = v.values.to_numpy(zero_copy_only=False)
    n = np.diff(off)
    for d in np.unique(n):
        at = np.flatnonzero(n == d)
        yield ids[at], flat[(off[at][:, None] + np.arange(d)).astype(np.int64)].reshape(len(at), d)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products of all rows; in floating point where that is exact."""
    d = q.shape[1]
    if d == 0 or not len(c):
        return np.zeros((len(q), len(c)), dtype=np.int64)
    most = float(np.abs(q.astype(float)).max()) * float(np.abs(c.astype(float)).max()) * d
    if most < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most >= 2.0**63:
        return np.clip(q.astype(object) @ c.astype(object).T, -MOST, MOST).astype(np.int64)
    return np.clip(q @ c.T, -MOST, MOST)


class _Block:
    """Queries of one block: by length, their ids, vectors and numbers."""

    def __init__(self, rows: list) -> None:
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.ids = [r.id for r in rows]
        for d in {len(r.v) for r in rows}:
            at = [i for i, r in enumerate(rows) if len(r.v) == d]
            self.of[d] = np.array([rows[i].id for i in at], dtype=np.int64), np.array([rows[i].v for i in at], dtype=np.int64).reshape(len(at), d), np.array(at)

    def scored(self, batches: Iterator[pa.RecordBatch], step: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of queries, ids of candidates, their scores, and which of them count."""
        for b in batches:
            for ids, m in _matrices(b.column(0), b.column(1)):
                if (q := self.of.get(m.shape[1])) is not None:
                    for i in range(0, len(ids), step):
                        c = ids[i : i + step]
                        yield q[2], c, _scores(q[1], m[i : i + step]), q[0][:, None] != c[None, :]


def _histogram(block: _Block, lo: np.ndarray, width: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(lo), BINS + 1), dtype=np.int64)  # the last bin: above the range
        for q, _, s, ok in block.scored(batches):
            rel = s - lo[q][:, None]
            bins = np.minimum(rel // width[q][:, None], BINS)
            ok &= rel >= 0
            for r, n in enumerate(q):
                count[n] += np.bincount(bins[r][ok[r]], minlength=BINS + 1)
        above = count[:, ::-1].cumsum(1)[:, ::-1] - count  # in higher bins
        q, b = np.nonzero((count > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(count[q, b], pa.int64())], ["q", "b", "n"])

    return run


def _ranges(block: _Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = {}, {}
        big = np.iinfo(np.int64)
        for q, _, s, ok in block.scored(batches):
            least, most = np.where(ok, s, big.max).min(1, initial=big.max), np.where(ok, s, big.min).max(1, initial=big.min)
            for r in np.flatnonzero(ok.any(1)):
                n = int(q[r])
                lo[n], hi[n] = min(lo.get(n, big.max), least[r]), max(hi.get(n, big.min), most[r])
        q = sorted(lo)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array([int(lo[x]) for x in q], pa.int64()), pa.array([int(hi[x]) for x in q], pa.int64())], ["q", "lo", "hi"])

    return run


def _filter(block: _Block, kth: np.ndarray, need: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: dict[int, np.ndarray] = {}
        for q, c, s, ok in block.scored(batches):
            r, j = np.nonzero((s > kth[q][:, None]) & ok)
            yield pa.RecordBatch.from_arrays([pa.array(q[r], pa.int32()), pa.array(c[j], pa.int64()), pa.array(s[r, j], pa.int64())], ["q", "id", "score"])
            for r in np.flatnonzero(((s == kth[q][:, None]) & ok).any(1)):
                n = int(q[r])
                ids = np.concatenate([ties.get(n, np.empty(0, np.int64)), c[(s[r] == kth[n]) & ok[r]]])
                ties[n] = np.sort(ids)[: need[n]]
        for n, ids in ties.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), n), pa.int32()), pa.array(ids, pa.int64()), pa.array(np.full(len(ids), kth[n]), pa.int64())], ["q", "id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, id, score``; both tables as :func:`quantise` makes them.  Equal queries are answered once.

    Queries are saved with their block's number; blocks are answered one after another, as each is a few whole passes over the
    candidates, and their answers saved, so no plan grows with their number.
    """
    queries = queries.dropDuplicates()
    n, longest = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, math.ceil(n * max(1, longest or 1) / (BLOCK_VALUES // 2)))
    if blocks == 1:
        return _one_block(candidates, queries.orderBy("id").collect(), k)
    queries = save(queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")), "topk-queries")
    return save_all((_one_block(candidates, queries.filter(F.col("block") == b).orderBy("id").collect(), k) for b in range(blocks)), "topk-answers")


def _one_block(candidates: DataFrame, rows: list, k: int) -> DataFrame:
    spark = candidates.sparkSession
    if sum(len(r.v) for r in rows) > BLOCK_VALUES:
        raise ValueError("a block of queries is over its bound")
    block = _Block(rows)
    n = len(rows)
    lo, hi = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for r in candidates.mapInArrow(_ranges(block), "q int, lo long, hi long").groupBy("q").agg(F.min("lo"), F.max("hi")).collect():
        lo[r[0]], hi[r[0]] = r[1], r[2]
    width = np.maximum(1, -((lo - hi - 1) // BINS))  # of a bin, for each query
    above, open_ = np.zeros(n, np.int64), hi >= lo
    # Every query's range shrinks to one bin at a time until bins are one score wide.
    while open_.any():
        counts: dict[int, dict[int, int]] = {}
        agg = candidates.mapInArrow(_histogram(block, lo, width, k), "q int, b int, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
        # Of a query's bins, those below its k-th score aren't needed: a window keeps the driver's part small.
        w = Window.partitionBy("q").orderBy(F.desc("b"))
        agg = agg.withColumn("above", F.sum("n").over(w) - F.col("n")).filter(F.col("above") < k)
        for r in agg.collect():
            counts.setdefault(r.q, {})[r.b] = r.n
        for q in np.flatnonzero(open_):
            have, seen, at = 0, counts.get(int(q), {}), 0
            for at in sorted(seen, reverse=True):
                if have + seen[at] >= k or at == min(seen):
                    break
                have += seen[at]
            above[q] = have
            lo[q] += at * width[q]
            open_[q] = width[q] > 1
            width[q] = max(1, -(-int(width[q]) // BINS))
    kth, need = lo, np.maximum(0, k - above)
    schema = "q int, id long, score long"
    kept = candidates.mapInArrow(_filter(block, kth, need), schema)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    names = spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], "n int, query_id long")
    ranked = kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), ranked["q"] == names["n"]).select("query_id", "rank", "id", "score")


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """Top k of all rows of ``df`` for its rows that ``is_query`` picks: ``query_id, rank, vec_id, score``."""
    vectors = save(quantise(df, id_col, vector_col, scale), "topk-vectors")
    return top_k(quantise(df.filter(is_query), id_col, vector_col, scale), vectors, k).withColumnRenamed("id", "vec_id")
