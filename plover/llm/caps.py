"""Near copies among vectors by spherical-cap filters from structured product codes.

1. *Distinct vectors*: rows with the same numbers are folded into one class, merged by salted groups first.
2. *Filters*: a table is a random rotation and, for each quarter of the rotated vector, a small random code; a filter is a product of four codewords, so few codewords make many directions.
   A vector is list-decoded to the ``LIST`` directions whose caps it lies deepest in: best pairs of codewords in each half, then best pairs of pairs.  The rotation makes
   the chance of a miss the same for every pair at an angle, so it is measured on random pairs at the least similarity, and there are as many tables as bring it under ``MISS``.
3. *Join on filters*: vectors that share one meet.  Frequent filters are cut into slices, and pairs of slices meet by themselves.  Runs of one length form
   stacked matrix products in float64, and every pair at or above the threshold counts under the smallest filter that both have: once.
4. *Links*: a task gives each vector its number of links (with multiplicities) and one edge to the smallest member of its local component, never the pairs.
   Components of those edges are found by distributed label propagation.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing.  Only vectors of one length are compared.  Rows that repeat are linked with
each other.  Ids may be null or repeat: the smallest id of a component is that of known ids, and a row is kept if its id is that one.  Other columns aren't read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.llm.common import arrow_schema, parts, save
from plover.llm.simhash import components

LIST = 8
MISS = 1e-4
BLOCKS = 4
SLICE = 512
SALTS = 48
SALT_ROWS = 1 << 20


class Code:
    """One table of filters for vectors of ``dim`` numbers: ``k ** BLOCKS`` directions."""

    def __init__(self, dim: int, k: int, seed: int) -> None:
        rng = np.random.RandomState((seed * 1_000_003 + dim) % (1 << 32))
        self.k, self.size = k, max(1, -(-dim // BLOCKS))
        self.turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        words = rng.normal(size=(BLOCKS, k, self.size))
        self.words = words / np.linalg.norm(words, axis=2, keepdims=True)

    def decode(self, units: np.ndarray, count: int) -> np.ndarray:
        """``(N, count)`` filters whose caps the vectors lie deepest in."""
        n = len(units)
        x = np.zeros((n, BLOCKS * self.size))
        x[:, : units.shape[1]] = units @ self.turn
        score = np.einsum("nbd,bkd->nbk", x.reshape(n, BLOCKS, self.size), self.words)
        half = []
        for b in (0, 2):
            s = (score[:, b, :, None] + score[:, b + 1, None, :]).reshape(n, -1)
            c = min(count, s.shape[1])
            at = np.argpartition(-s, c - 1, axis=1)[:, :c]
            half.append((at, np.take_along_axis(s, at, 1)))
        both = (half[0][1][:, :, None] + half[1][1][:, None, :]).reshape(n, -1)
        c = min(count, both.shape[1])
        at = np.argpartition(-both, c - 1, axis=1)[:, :c]
        i, j = np.divmod(at, half[1][1].shape[1])
        return np.take_along_axis(half[0][0], i, 1) * self.k**2 + np.take_along_axis(half[1][0], j, 1)


@lru_cache(64)
def code(dim: int, k: int, seed: int) -> Code:
    return Code(dim, k, seed)


def tables_for(dim: int, k: int, least: float, miss: float = MISS, trials: int = 2000) -> int:
    """How many tables bring the chance that a pair at ``least`` shares no filter under ``miss``, by random pairs."""
    rng = np.random.RandomState(7)
    x = rng.normal(size=(trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.normal(size=(trials, dim))
    e -= (e * x).sum(1, keepdims=True) * x
    e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)
    y = least * x + math.sqrt(max(0.0, 1 - least * least)) * e
    lost = np.mean([~(c.decode(x, LIST)[:, :, None] == c.decode(y, LIST)[:, None, :]).any((1, 2)) for c in (code(dim, k, 10_000 + s) for s in range(3))])
    # Three standard errors above what the trials show.
    lost = min(0.9, lost + 3 * math.sqrt(max(lost, 1 / trials) / (3 * trials)))
    return max(1, math.ceil(math.log(miss) / math.log(lost)))


def filters(units: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Sorted filters of all tables, as 32-bit numbers (where two filters share one, their vectors meet there)."""
    out = []
    for t in range(tables):
        f = code(units.shape[1], k, t).decode(units, LIST).astype(np.uint64)
        start = np.uint64(((t + 1) * 0x9E3779B97F4A7C15 + units.shape[1] * 0xD1B54A32D192ED03) % (1 << 64))
        h = (f + start) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(32)).astype(np.int64))
    return np.sort(np.concatenate(out, axis=1), axis=1)


def unit(raw: bytes, width: str) -> np.ndarray:
    x = np.frombuffer(raw, dtype=width).astype(float)
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def classes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", salts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows ``id, digest, salt`` (no digest: links with nothing), and distinct vectors ``node, digest, salts, least, n, vec``."""
    if salts is None:
        salts = SALTS + vectors.select(F.count("*")).first()[0] // SALT_ROWS
    width = "<f4" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"
    kind = vectors.schema[id_col].dataType.simpleString()
    x = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].alias("v"))
    real = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
    x = x.select("id", F.when(real, F.col("v")).alias("v"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    schema = f"id {kind}, salt int, digest binary, vec binary"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = []
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(width) + np.dtype(width).type(0)  # -0.0 becomes 0.0
            at = np.concatenate([[0], np.cumsum(b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
            there = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            vec = [flat[at[i] : at[i + 1]].tobytes() if there[i] else None for i in range(b.num_rows)]
            digest = [None if v is None else hashlib.blake2b(v, digest_size=32).digest() for v in vec]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field("id").type), b.column(2), pa.array(digest, pa.binary()), pa.array(vec, pa.binary())], schema=arrow)

    rows = save(x.select("id", "v", "salt").mapInArrow(run, schema), "cap-rows")
    salted = rows.filter("digest IS NOT NULL").groupBy("digest", "salt").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    merged = salted.groupBy("digest").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.first("vec").alias("vec"), F.collect_list("salt").alias("salts"))
    return rows.select("id", "digest", "salt"), save(merged.withColumn("node", F.monotonically_increasing_id()), "cap-classes")


def _linked(units: np.ndarray, lists: np.ndarray, key: int, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of linked pairs for which ``key`` is the smallest filter that both have."""
    close = units[a] @ units[b].T >= least
    if a is b:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    if not len(i):
        return i, j
    if len(i) * lists.shape[1] ** 2 < 1 << 22:
        p, q = lists[a[i]], lists[b[j]]
        own = ~((p[:, :, None] == q[:, None, :]) & (p < key)[:, :, None]).any((1, 2))
        return i[own], j[own]
    # Many pairs: which pairs share a smaller filter is a product of incidences.
    p, q = lists[a], lists[b]
    values = np.intersect1d(p[p < key], q[q < key])
    shared = np.zeros(close.shape, dtype=np.float32)
    for s in range(0, len(values), 4096):
        some = values[s : s + 4096]
        side = []
        for x in (p, q):
            m = np.zeros((len(x), len(some)), dtype=np.float32)
            at = np.minimum(np.searchsorted(some, x), len(some) - 1)
            r, c = np.nonzero(some[at] == x)
            m[r, at[r, c]] = 1
            side.append(m)
        shared += side[0] @ side[1].T
    own = shared[i, j] == 0
    return i[own], j[own]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(distinct: DataFrame, least: float, width: str, k: int, tables: dict[int, int], slice_rows: int = SLICE) -> DataFrame:
    """``node, links, root``: partial numbers of links, and edges, from every task."""
    arrow = arrow_schema("node long, n long, vec binary, key long, lists binary")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                raw = b.column(2).to_pylist()
                size = np.array([len(r) for r in raw])
                for s in np.unique(size):
                    which = np.flatnonzero(size == s)
                    units = np.stack([unit(raw[i], width) for i in which])
                    dim = units.shape[1]
                    f = filters(units, k, tables[dim])
                    fresh = np.append(np.ones((len(f), 1), dtype=bool), f[:, 1:] != f[:, :-1], axis=1)
                    row, col = np.nonzero(fresh)
                    own = which[row]
                    lists = [x.astype("<u4").tobytes() for x in f]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), b.column(2).take(own), pa.array(f[row, col]), pa.array([lists[i] for i in row], pa.binary())], schema=arrow)

    listed = save(distinct.select("node", "n", "vec").mapInArrow(decode, "node long, n long, vec binary, key long, lists binary"), "cap-listed")
    # Slices of a filter: members are dealt by node, and every two slices meet.  Filters with one member have no pairs.
    size = listed.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("c")).filter("c > 1").select("k", F.ceil(F.col("c") / slice_rows).cast("int").alias("of"))
    met = listed.hint("merge").join(size, F.col("key") == F.col("k"))
    mine = F.pmod(F.xxhash64("node"), F.col("of")).cast("int").alias("mine")
    met = met.select("node", "n", "vec", "key", "lists", "of", mine)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))).alias("p")
    met = met.select("node", "n", "vec", "key", "lists", "mine", pair).select("key", "p.i", "p.j", "mine", "node", "n", "vec", "lists")
    met = met.repartition(parts(met), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    out_schema = arrow_schema("node long, links long, root long")

    def meet(table: pa.Table) -> pa.RecordBatch:
        """What the whole runs of ``table`` give."""
        col = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "mine", "node", "n")}
        raw, lists = table.column("vec").to_pylist(), table.column("lists").to_pylist()
        rows = len(raw)
        cut = np.append(True, (col["key"][1:] != col["key"][:-1]) | (col["i"][1:] != col["i"][:-1]) | (col["j"][1:] != col["j"][:-1]))
        begin = np.append(np.flatnonzero(cut), rows)
        n, size = np.diff(begin), np.array([len(r) for r in raw])
        got: list[tuple[np.ndarray, np.ndarray]] = []
        for s in np.unique(size):
            units = np.zeros((rows, s // np.dtype(width).itemsize))
            at = np.flatnonzero(size == s)
            x = np.frombuffer(b"".join(raw[i] for i in at), dtype=width).reshape(len(at), -1).astype(float)
            x /= np.abs(x).max(1, keepdims=True)
            units[at] = x / np.sqrt((x * x).sum(1, keepdims=True))
            known = np.zeros((rows, max(len(lists[i]) for i in at) // 4), dtype=np.int64)
            for i in at:
                known[i] = np.frombuffer(lists[i], dtype="<u4")
            for length in np.unique(n[n > 1]):
                runs = np.flatnonzero((n == length) & (size[begin[:-1]] == s))
                alone = (length <= 32) & (col["i"][begin[runs]] == col["j"][begin[runs]])
                large, runs = runs[~alone], runs[alone]
                if len(runs):
                    step = max(1, (1 << 20) // int(length) ** 2)
                    for c in range(0, len(runs), step):
                        place = begin[runs[c : c + step]][:, None] + np.arange(length)
                        x = units[place]
                        r, i, j = np.nonzero(np.triu(x @ x.transpose(0, 2, 1) >= least, 1))
                        a, b = place[r, i], place[r, j]
                        for d in range(0, len(a), 4096):
                            p, q = known[a[d : d + 4096]], known[b[d : d + 4096]]
                            own = ~((p[:, :, None] == q[:, None, :]) & (p < col["key"][a[d : d + 4096]][:, None])[:, :, None]).any((1, 2))
                            got.append((a[d : d + 4096][own], b[d : d + 4096][own]))
                for r in large:
                    place = np.arange(begin[r], begin[r + 1])
                    left, right = place[col["mine"][place] == col["i"][place]], place[col["mine"][place] == col["j"][place]]
                    if col["i"][begin[r]] == col["j"][begin[r]]:
                        right = left
                    i, j = _linked(units, known, int(col["key"][begin[r]]), left, right, least)
                    got.append((left[i], right[j]))
        a, b = (np.concatenate([g[x] for g in got]) if got else np.empty(0, dtype=int) for x in (0, 1))
        total = np.bincount(a, col["n"][b], rows) + np.bincount(b, col["n"][a], rows)
        root = _roots(rows, a, b)
        touched = np.unique(np.concatenate([a, b]))
        return pa.RecordBatch.from_arrays([pa.array(col["node"][touched]), pa.array(total[touched].astype(np.int64)), pa.array(col["node"][root[touched]])], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: list[pa.RecordBatch] = []
        for b in batches:
            ahead.append(b)
            table = pa.Table.from_batches(ahead)
            if table.num_rows < 8192:
                continue
            key = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            change = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if len(change):
                yield meet(table.slice(0, int(change[-1])))
                table = table.slice(int(change[-1]))
            ahead = table.to_batches()
        if ahead:
            yield meet(pa.Table.from_batches(ahead))

    return met.mapInArrow(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", slice_rows: int = SLICE, salts: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    width = "<f4" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"
    rows, distinct = classes(vectors, id_col, vec_col, salts)
    sizes = {r.d // np.dtype(width).itemsize: r.c for r in distinct.groupBy(F.octet_length("vec").alias("d")).agg(F.count("*").alias("c")).collect()}  # a row a length of vectors
    k = max(4, math.ceil((4 * max(sizes.values(), default=1)) ** (1 / BLOCKS)))
    made = save(links(distinct, least, width, k, {d: tables_for(d, k, least) for d in sizes}, slice_rows), "cap-links")
    number = made.groupBy(F.col("node").alias("v1")).agg(F.sum("links").alias("links"))
    roots = components(made.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()).select(F.col("v").alias("v2"), "root")
    named = distinct.select("node", "digest", "salts", "least", "n").join(number, F.col("node") == F.col("v1"), "left").join(roots, F.col("node") == F.col("v2"), "left")
    named = save(named.select("digest", "salts", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "cap-named")
    first = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    keys = named.join(first, F.col("root") == F.col("r")).select(F.col("digest").alias("d"), F.explode("salts").alias("s"), (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(keys.hint("merge"), (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
