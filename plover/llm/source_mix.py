"""Mixing sources to target weights.

Words of a source form one stream (its documents in hash order), cut into blocks of ``block_words`` words; the last
block may be shorter.  Targets are found by water filling: each source's share of all words is its weight's, but at
most ``max_repeat`` times its size, the excess going to the others by weight.  A source's quota is its target in
blocks.  Output shards of ``shard_slots`` slots draw multinomial source counts from what is left of the quotas, so
the totals meet the quotas exactly; each task draws its shards' counts down a seeded binary tree of shard ranges.  The j-th slot of a source stands for the block at ``j``'s place in a keyed
pseudorandom permutation of the block numbers (a Feistel network with cycle walking; a new key for each pass), and
slots meet blocks by number in a join.  Nothing depends on partitioning, so reruns agree.

Only per-source totals (``MAX_SOURCES`` at most, checked) come to the driver.  Positions in a stream come from sums by
hash bucket, so a source that holds a third of all rows is spread over all buckets.  Slots come from a few rows that each
stand for thousands, which the planner can't tell, so their joins are told not to broadcast.

Defined results: a null text has no words and takes nothing; null is a source of its own, last in the order; rows that
repeat are separate documents; no document is taken over ``max_repeat`` times, as each pass uses a block once.
Extra columns pass through ``materialise``.  An empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.llm.common import WORD, save, text_or_empty

BLOCK_WORDS = 32
SHARD_SLOTS = 1 << 16
MAX_REPEAT = 3
MAX_SOURCES = 1_000_000
BUCKET_ROWS = 256
GROUP = 1024  # buckets whose sums are added first
WEIGHTS = (5.0, 2.0, 1.0)
MASK = (1 << 64) - 1


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeat: float = MAX_REPEAT) -> list[float]:
    """Words for each source: shares of ``sum(sizes)`` by weight, capped at ``max_repeat`` sizes, the excess reshared."""
    cap = [max_repeat * s for s in sizes]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if total <= 0 or left * weights[i] / total >= cap[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(cap[i])
        left = max(0.0, left - sum(cap[i] for i in full))
        free -= set(full)
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """The places of ``i`` in a keyed permutation of ``range(n)``."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = np.asarray(i, dtype=np.uint64).copy()
    walk = np.ones(len(out), dtype=bool)
    with np.errstate(over="ignore"):
        while walk.any():
            x = out[walk]
            a, b = x >> np.uint64(half), x & low
            for r in range(4):
                a, b = b, a ^ (_mix64(b ^ np.uint64((key * 4 + r + 1) * 0xD1B54A32D192ED03 & MASK)) & low)
            out[walk] = (a << np.uint64(half)) | b
            walk[walk] = out[walk] >= n
    return out.astype(np.int64)


def shard_counts(quota: Sequence[int], shard_slots: int, seed: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Each source's slots in a shard, and before it: multinomial draws from what is left of the quotas, down a binary tree of
    shard ranges, each split seeded by its range.  A shard's path is all that is drawn, so tasks need no one else's draws."""
    left = np.asarray(quota, dtype=np.int64).copy()
    begun = np.zeros_like(left)
    lo, hi = 0, -(-int(left.sum()) // shard_slots)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        want, rng = (mid - lo) * shard_slots, np.random.default_rng([seed, lo, hi])
        got = np.zeros_like(left)
        while (short := want - int(got.sum())) > 0:
            open_ = left - got
            got += np.minimum(rng.multinomial(short, open_ / open_.sum()), open_)
        if shard < mid:
            left, hi = got, mid
        else:
            begun, left, lo = begun + got, left - got, mid
    return left, begun


def _ranked(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """``key, bucket, k`` that name a row (even where ids repeat), ``doc_id, source`` and the columns ``more``.

    ``key`` stands for the source and is never null, so that joins by it keep the window's partitioning.
    """
    source = docs[source_col]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"), docs[id_col].alias("doc_id"), source.alias("source"),
        F.xxhash64(docs[id_col], docs[text_col]).alias("h"), F.length(docs[text_col]).alias("chars"), *more,
    )
    buckets = max(1, math.ceil(docs.select(F.count("*")).first()[0] / BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    w = Window.partitionBy("key", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "h", "chars")
    return rows.withColumn("k", F.row_number().over(w)).drop("h", "chars")


def positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every document's place in its source's stream: ``key, doc_id, source, size, bucket, k, lo``."""
    size = F.regexp_count(text_or_empty(docs[text_col]), F.lit(WORD)).cast("bigint").alias("size")
    rows = _ranked(docs, id_col, text_col, source_col, size)
    rows = save(rows.withColumn("end", F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("k"))), "mix-rows")
    sums = rows.groupBy(F.col("key").alias("b_key"), F.col("bucket").alias("b_bucket")).agg(F.max("end").alias("b_size")).withColumn("b_group", F.expr(f"b_bucket div {GROUP}"))
    sums = save(sums, "mix-sums")
    # Sums before a bucket: those of the groups before its group, and of the buckets before it in its group.
    groups = sums.groupBy(F.col("b_key").alias("g_key"), F.col("b_group").alias("g_group")).agg(F.sum("b_size").alias("g_size"))
    groups = groups.withColumn("before", F.sum("g_size").over(Window.partitionBy("g_key").orderBy("g_group")) - F.col("g_size")).drop("g_size")
    inside = F.sum("b_size").over(Window.partitionBy("b_key", "b_group").orderBy("b_bucket")) - F.col("b_size")
    before = sums.withColumn("inside", inside).join(groups, (F.col("b_key") == F.col("g_key")) & (F.col("b_group") == F.col("g_group")))
    before = before.select("b_key", "b_bucket", (F.col("before") + F.col("inside")).alias("start"))
    out = rows.join(before, (F.col("key") == F.col("b_key")) & (F.col("bucket") == F.col("b_bucket")))
    return out.select("key", "doc_id", "source", "size", "bucket", "k", (F.col("start") + F.col("end") - F.col("size")).alias("lo"))


def plan(pos: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: ``source, s, source_size, target, n_blocks, quota``."""
    sums = pos.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    sums.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
    sizes = [r.n for r in sums]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], max_repeat)
    rows = []
    for i, (r, t) in enumerate(zip(sums, goal, strict=True)):
        n = -(-r.n // block_words)
        rows.append((r.source, i, r.n, float(t), n, min(max_repeat * n, round(t * n / r.n)) if r.n else 0))
    return pos.sparkSession.createDataFrame(rows, "source string, s int, source_size long, target double, n_blocks long, quota long")


def slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """Every slot of the mix: ``shard, s, pass, block``."""
    spark = sources.sparkSession
    known = sources.orderBy("s").collect()  # MAX_SOURCES rows at most
    shared = spark.sparkContext.broadcast((np.array([r.s for r in known], dtype=np.int64), np.array([r.quota for r in known], dtype=np.int64), np.array([r.n_blocks for r in known], dtype=np.int64)))
    n_shards = -(-sum(r.quota for r in known) // shard_slots)
    shards = spark.range(0, n_shards, 1, max(1, min(n_shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, quota, n_blocks = shared.value
        for pdf in batches:
            for shard in pdf["id"].tolist():
                got, begun = shard_counts(quota, shard_slots, seed, shard)
                for i in np.flatnonzero(got).tolist():
                    n, j = int(n_blocks[i]), np.arange(begun[i], begun[i] + got[i])
                    turn, at = j // n, j % n
                    block = np.empty_like(j)
                    for t in np.unique(turn):
                        block[turn == t] = permute(at[turn == t], n, (seed << 40) + (int(t) << 32) + int(numbers[i]))
                    yield pd.DataFrame({"shard": shard, "s": numbers[i], "pass": turn.astype(np.int32), "block": block})

    return shards.mapInPandas(fill, "shard long, s int, pass int, block long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0, **cols) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positions with their source's numbers (saved), the plan, and the block uses ``s, block, pass``."""
    pos = save(positions(docs, **cols), "mix-positions")
    sources = plan(pos, weights, max_repeat, block_words)
    return pos.join(F.broadcast(sources.withColumnRenamed("source", "p_source")), pos["source"].eqNullSafe(F.col("p_source"))).drop("p_source"), sources, slots(sources, shard_slots, seed)


def _pieces(pos: DataFrame, block_words: int, *more: str) -> DataFrame:
    """A row for each block that a document touches, one with no words for a document without words."""
    lo, hi = F.col("lo"), F.col("lo") + F.col("size")
    first, last = F.expr(f"lo div {block_words}"), F.expr(f"greatest(lo, lo + size - 1) div {block_words}")
    out = pos.select("key", "doc_id", "source", "s", "bucket", "k", "lo", "size", "source_size", "target", *more, F.explode(F.sequence(first, last)).alias("d_block"))
    start, end = F.greatest(lo, F.col("d_block") * block_words), F.least(hi, (F.col("d_block") + 1) * block_words)
    return out.withColumn("w0", start - lo).withColumn("w1", F.greatest(start, end) - lo)


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS, **kw) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every document."""
    pos, _, used = mix(docs, block_words=block_words, **kw)
    uses = used.groupBy(F.col("s").alias("u_s"), F.col("block").alias("u_block")).agg(F.count("*").alias("uses")).hint("merge")
    pieces = _pieces(pos, block_words)
    met = pieces.join(uses, (pieces["s"] == uses["u_s"]) & (pieces["d_block"] == uses["u_block"]), "left")
    words = (F.col("w1") - F.col("w0")) * F.coalesce("uses", F.lit(0))
    return met.groupBy("s", "bucket", "k", "doc_id", "source", "size", "source_size", "target").agg(F.sum(words).alias("taken")).select("doc_id", "source", "size", "source_size", "target", "taken")


def materialise(docs: DataFrame, block_words: int = BLOCK_WORDS, text_col: str = "text", length_col: str | None = "n_chars", **kw) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: one row for each document and pass that takes any of its words.

    The row's text holds the taken words; words that follow each other in the document keep the white space between them,
    and a line feed joins the rest.  A document that is taken whole keeps its text as it is.
    """
    names = list(docs.columns)
    pos, _, used = mix(docs, block_words=block_words, text_col=text_col, **kw)
    uses = used.select(F.col("s").alias("u_s"), F.col("block").alias("u_block"), F.col("pass")).hint("merge")
    pieces = _pieces(pos, block_words)
    met = pieces.join(uses, (pieces["s"] == uses["u_s"]) & (pieces["d_block"] == uses["u_block"])).filter("w1 > w0")
    spans = met.groupBy("key", "bucket", "k", "size").agg(F.sort_array(F.collect_list(F.struct("pass", "w0", "w1"))).alias("spans"))
    # A bucket's spans go to its rows as one map (some 256 documents' spans), by the window's own keys: texts are shuffled once.
    spans = spans.groupBy(F.col("key").alias("p_key"), F.col("bucket").alias("p_bucket")).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("size", "spans")))).alias("of"))
    row = F.struct(*[docs[c] for c in names]).alias("row")
    full = _ranked(docs, kw.get("id_col", "doc_id"), text_col, kw.get("source_col", "source"), row)
    out = full.join(spans.hint("merge"), (F.col("key") == F.col("p_key")) & (F.col("bucket") == F.col("p_bucket")))
    out = out.select("row", F.try_element_at("of", F.col("k")).alias("mine")).filter(F.col("mine").isNotNull())
    out = out.select("row", F.col("mine.size").alias("size"), F.col("mine.spans").alias("every"), F.explode(F.array_distinct(F.col("mine.spans.pass"))).alias("pass"))
    out = out.select("row", "size", F.filter("every", lambda x: x["pass"] == F.col("pass")).alias("spans"))
    cut = F.pandas_udf(_cut, "string")
    whole = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["w1"] - x["w0"]) == F.col("size")
    out = out.withColumn("new", F.when(whole, F.col(f"row.`{text_col}`")).otherwise(cut(F.col(f"row.`{text_col}`"), F.col("spans.w0"), F.col("spans.w1"))))
    made = {text_col: F.col("new")} | ({length_col: F.length("new").cast(docs.schema[length_col].dataType)} if length_col in names else {})
    return out.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


def _cut(text: pd.Series, begin: pd.Series, end: pd.Series) -> pd.Series:
    import re

    word = re.compile(WORD)
    out = []
    for t, b, e in zip(text, begin, end, strict=True):
        at = [(m.start(), m.end()) for m in word.finditer(t or "")]
        runs: list[list[int]] = []
        for x, y in zip(b, e, strict=True):
            if runs and runs[-1][1] == x:
                runs[-1][1] = y
            else:
                runs.append([int(x), int(y)])
        out.append("\n".join(t[at[x][0] : at[y - 1][1]] for x, y in runs))
    return pd.Series(out, dtype=object)
