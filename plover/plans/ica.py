"""Independent components of every outer fold's training rows, which are never collected.

One pass takes a triangular factor of each outer fold's rows; those of a training set's folds, one under the other, give its own, and so its scaler and its principal axes as the
singular value decomposition of the rows does.  The whitened rows of all training sets are then written once, in packed pieces, and each fixed-point step of all of
them is a pass over those: what comes to the driver is components^2 numbers from each task and training set.  Training sets whose whitened rows have at most ``SMALL``
numbers take their steps in one task each instead.  Steps, start and end are those of ``solvers.fast_ica``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.config import Config
from plover.functions import solvers
from plover.functions.reducers import ICA
from plover.sources.work import save

ROWS = 4096  # of a packed piece
SMALL = 1 << 20


def factors(rows: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Of rows ``fold, x ARRAY``, a triangular factor of (1, x) by fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for b in batches:
            fold = b.column(0).to_numpy(zero_copy_only=False)
            a = np.column_stack([np.ones(len(fold)), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(fold), width)])
            for k in np.unique(fold).tolist():
                have[k] = np.linalg.qr(np.vstack([have[k], a[fold == k]] if k in have else [a[fold == k]]), "r")
        if have:
            yield pa.RecordBatch.from_arrays([pa.array(list(have)), pa.array([r.tobytes() for r in have.values()])], ["fold", "r"])

    def merge(pdf):
        r = np.linalg.qr(np.vstack([np.frombuffer(x).reshape(-1, width + 1) for x in pdf["r"]]), "r")
        return pdf.iloc[:1].assign(r=[r.tobytes()])

    few = rows.select("fold", "x").coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    got = few.mapInArrow(run, "fold long, r binary").groupBy("fold").applyInPandas(merge, "fold long, r binary").collect()  # a row a fold
    return {r.fold: np.frombuffer(r.r).reshape(-1, width + 1) for r in got}


class Start:
    """A training set's scaler, whitening and first unmixing, from its triangular factor."""

    def __init__(self, r: np.ndarray, n: int, centre: np.ndarray, k: int, seed: int) -> None:
        first = r[0] / (np.sign(r[0, 0]) * np.sqrt(n))  # (1, means)
        m, s = first[1:], np.sqrt((r[1:, 1:] ** 2).sum(0) / n)
        s = np.where(s > 10 * np.finfo(float).eps * np.maximum(np.abs(centre + m), 1e-300), s, 1.0)
        z = np.linalg.qr(r[1:, 1:] / s, "r")  # rows less their means have this factor
        u, d, _ = np.linalg.svd(z.T, full_matrices=False)
        k = min(k, int((d > 1e-10 * d[0]).sum()) or 1)
        self.n, self.mean, self.scale, self.factor = n, m, s, z
        self.white = (u[:, :k] / d[:k]).T * np.sqrt(n)
        self.w = decorrelated(np.random.RandomState(seed).normal(size=(k, k)))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.white @ ((x - self.mean) / self.scale).T

    def made(self, w: np.ndarray, names: list[str]) -> ICA:
        unmix = w @ self.white
        sd = np.sqrt(((self.factor @ unmix.T) ** 2).sum(0) / self.n)
        unmix = unmix / np.where(sd > 0, sd, 1.0)[:, None]
        return ICA(names, self.mean, self.scale, np.zeros(len(names)), unmix, np.linalg.pinv(unmix))


def decorrelated(a: np.ndarray) -> np.ndarray:
    e, v = np.linalg.eigh(a @ a.T)
    return v @ np.diag(1 / np.sqrt(np.maximum(e, 1e-300))) @ v.T @ a


def sums(w: np.ndarray, z: np.ndarray) -> np.ndarray:
    """What a step sums over whitened columns: products with tanh, and its slopes."""
    g = np.tanh(w @ z)
    return np.column_stack([g @ z.T, (1 - g * g).sum(1)])


def stepped(w: np.ndarray, total: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    new = decorrelated(total[:, :-1] / n - np.diag(total[:, -1] / n) @ w)
    return new, float(np.max(np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1)))


def fit(placed: DataFrame, names: list[str], centre: list[float], cfg: Config, tol: float = 1e-4) -> dict[int, ICA]:
    """The reducer of each outer fold from rows ``fold, x ARRAY`` (features less ``centre``), for such features."""
    spark, p, mid = placed.sparkSession, len(names), np.array(centre)
    rows = save(placed.select("fold", "x"), "ica-rows")
    r, counts = factors(rows, p), {x.fold: x["count"] for x in rows.groupBy("fold").count().collect()}  # a row a fold
    starts = {}
    for k in sorted(counts):
        others = [f for f in counts if f != k]
        starts[k] = Start(np.linalg.qr(np.vstack([r[f] for f in others]), "r"), sum(counts[f] for f in others), mid, int(cfg.ica_components), cfg.ica_seed)
    shared = spark.sparkContext.broadcast(starts)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                fold, x = b.column(0).to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, p)
                packed = [(k, s.whitened(x[fold != k]).tobytes()) for k, s in shared.value.items()]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in packed]), pa.array([z for _, z in packed], pa.binary())], ["k", "z"])

    pieces = save(rows.mapInArrow(whiten, "k long, z binary"), "ica-whitened")
    found = {}
    small = [k for k, s in starts.items() if s.n * len(s.w) <= SMALL]
    if small:

        def alone(pdf):
            k = int(pdf["k"].iloc[0])
            s, w = shared.value[k], shared.value[k].w
            z = np.hstack([np.frombuffer(x).reshape(len(w), -1) for x in pdf["z"]])
            for _ in range(cfg.ica_max_iter):
                w, moved = stepped(w, sums(w, z), s.n)
                if moved < tol:
                    break
            return pdf.iloc[:1].assign(z=[w.tobytes()])

        few = pieces.filter(F.col("k").isin(small)).repartition(len(small), "k")
        for x in few.groupBy("k").applyInPandas(alone, "k long, z binary").collect():  # a row a fold
            found[x.k] = np.frombuffer(x.z).reshape(starts[x.k].w.shape)
    now = {k: s.w for k, s in starts.items() if k not in found}
    for _ in range(cfg.ica_max_iter):
        if not now:
            break
        ws = spark.sparkContext.broadcast(now)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for k, z in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    w = ws.value[k]  # noqa: B023
                    total[k] = total.get(k, 0.0) + sums(w, np.frombuffer(z.as_buffer()).reshape(len(w), -1))
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tobytes() for x in total.values()])], ["k", "s"])

        left = pieces.filter(F.col("k").isin(list(now))).coalesce(2 * spark.sparkContext.defaultParallelism)
        added: dict[int, np.ndarray] = {}
        for x in left.mapInArrow(run, "k long, s binary").collect():  # components^2 numbers from a task, of a bounded number of tasks
            added[x.k] = added.get(x.k, 0.0) + np.frombuffer(x.s).reshape(len(now[x.k]), -1)
        ws.unpersist()
        for k, total in added.items():
            new, moved = stepped(now[k], total, starts[k].n)
            if moved < tol:
                found[k] = new
                del now[k]
            else:
                now[k] = new
    found |= now  # as far as the last step came
    return {k: starts[k].made(found[k], names) for k in sorted(found)}

