"""Rows that repeat an id but nothing else."""

import numpy as np
from pyspark.sql import functions as F

from plover.llm import simhash, topk


def test_near_dedup_keeps_other_texts_of_an_id(spark):
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join(f"v{i}" for i in range(200))
    df = spark.createDataFrame([(3, a), (5, a + " end"), (5, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:2]) for r in simhash.drop(df).collect()) == [(3, "w0"), (5, "v0")]


def test_top_k_of_many_vectors_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VALUES", 400)
    r = np.random.RandomState(0)
    rows = [(100, [float(x) for x in r.normal(size=8)]) for _ in range(100)] + [(1, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(df, F.col("vec_id") % 100 == 0, k=1).collect()
    assert len(got) == 100 and {x.vec_id for x in got} == {1}
