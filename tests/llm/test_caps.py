"""Near copies among vectors against brute force, and on awkward tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plover.llm import caps

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = {i: np.array(rows[i][1], dtype=np.float32).astype(float) for i in ok}
    unit = {i: u / np.linalg.norm(u) for i, u in unit.items()}
    for d in {len(u) for u in unit.values()}:
        at = [i for i in ok if len(unit[i]) == d]
        close = (m := np.stack([unit[i] for i in at])) @ m.T >= least
        for p, q in zip(*np.nonzero(np.triu(close, 1))):
            n[at[p]] += 1
            n[at[q]] += 1
            a, b = top(at[p]), top(at[q])
            root[max(a, b)] = min(a, b)
    first = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            first[top(i)] = min(first.get(top(i), v), v)
    return sorted(((v, n[i], first.get(top(i)), v == first.get(top(i))) for i, (v, _) in enumerate(rows)), key=str)


def near(r, x, cos):
    e = r.normal(size=len(x))
    x = x / np.linalg.norm(x)
    e -= (e @ x) * x
    return cos * x + np.sqrt(1 - cos * cos) * e / np.linalg.norm(e)


def planted(seed=0):
    r = np.random.RandomState(seed)
    base = r.normal(size=(150, 16))
    rows = [*base, *(near(r, x, c) for x in base[:60] for c in (0.949, 0.9505, 0.97)), *(near(r, base[100], 0.985) for _ in range(80)), *(base[5],) * 30, *(3 * base[6],) * 2]
    x = base[140]
    for _ in range(6):
        rows.append(x := near(r, x, 0.96))  # a chain
    rows = [(i * 7 % len(rows), [float(v) for v in np.float32(x)]) for i, x in enumerate(rows)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] + [1.0] * 15), (5004, [None] + [1.0] * 15), (5005, [float("inf")] + [1.0] * 15), (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (5008, [1e30] * 16), (5009, [1.0] * 16), (None, [1.0] * 16), (5009, [1.0] * 16), (5010, [-0.0, 1.0]), (5011, [0.0, 1.0])]
    return rows + odd


@pytest.mark.parametrize("slice_rows", [512, 5])
def test_against_brute_force(spark, slice_rows):
    rows = planted()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, caps.near_duplicates(df, slice_rows=slice_rows, salts=3).collect()), key=str)
    assert got == brute(rows)


def test_doubles_and_a_lower_threshold(spark):
    r = np.random.RandomState(4)
    base = r.normal(size=(60, 32))
    rows = [(i, list(map(float, np.float32(v)))) for i, v in enumerate([*base, *(near(r, x, 0.82) for x in base)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, caps.near_duplicates(df, least=0.8).collect()), key=str) == brute(rows, 0.8)


def test_recall_at_the_threshold():
    """Pairs at the least similarity, the hardest, are met but for a share of ``MISS``."""
    r = np.random.RandomState(9)
    x = r.normal(size=(5000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.stack([near(r, v, 0.95) for v in x])
    k = 16
    tables = caps.tables_for(64, k, 0.95)
    a, b = caps.filters(x, k, tables), caps.filters(y, k, tables)
    met = sum(bool(np.intersect1d(p, q).size) for p, q in zip(a, b))
    assert 5000 - met <= 3 and tables <= 8


def test_whole_table(spark, sf):
    from plover.llm.queries import op12_embedding_dedup

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op12_embedding_dedup(spark, sf).collect()), key=str) == brute(rows)


def test_awkward_tables(spark):
    assert caps.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0)], SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("id", "node", "digest", "salt", "vec", "n", "key", "k", "of")])
    assert sorted(map(tuple, caps.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
