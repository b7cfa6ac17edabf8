"""Best-fit packing by bulk-synchronous rounds.

Documents become token pieces; only those over ``capacity`` are cut, and of these the first piece takes the remainder,
so every other piece fills a sequence by itself.  The rest is packed class by class, from large sizes to small (a class
holds sizes over ``c`` up to ``2c``).  Within a class, rounds repeat until no gap takes a document:

1. *range-sort*: unplaced documents of the class and gaps that can take one are sorted together by size;
2. *successor sweep*: every partition walks its range upwards and gives each gap the largest open document below it, so
   a document goes to its nearest gap above.  What a partition can't settle is a row of open gaps followed by a row of
   open documents; ranks resolve who meets whom across partitions: from the partitions' counts alone (two numbers each)
   follows which open document, by rank, meets which open gap, and an equi-join on those ranks pairs them;
3. *update*: gaps shrink, and the next round sorts them again.

A gap of ``m`` times the class's largest size takes ``m`` documents in a round, so small documents don't need a round
for each one that a gap holds.  When no gap of the class is left, its open documents open sequences: runs of as many
as fit.  At most ``log2(capacity)`` classes have a few rounds each, whatever the number of documents.

Partitions hold at most ``ROWS`` sort rows, and only two counts per partition come to the driver.

Defined results: a null text is empty and has the end token only; a piece never exceeds the capacity; equal sizes are
ordered by row number; rows that repeat are packed each; an empty table gives an empty packing.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plover.llm.common import save, text_or_empty

CAPACITY = 1024
ROWS = 100_000
LAST_CLASS = 32  # sizes up to this are one class

_encoders: dict[str, Callable[[str], np.ndarray]] = {}  # of this worker


def encoder(tokenizer: str) -> Callable[[str], np.ndarray]:
    """Ids of a text under a byte-level BPE tokenizer file, special strings taken as the file says.

    The merges are run by tiktoken, which gives the ids of the tokenizers library in a quarter of its time; a file that
    isn't plain byte-level BPE, and a text that tiktoken refuses, go to the tokenizers library itself.
    """
    if tokenizer in _encoders:
        return _encoders[tokenizer]
    import json

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)

    def plain(text: str) -> np.ndarray:
        return np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4")

    run = plain
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        import public_tokenizers
        import tiktoken

        # GPT-2's printable stand-ins for bytes: a byte stands for itself if printable, else for the next code from 256.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(char[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def run(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
            except BaseException as e:  # its panics aren't Exceptions
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
                return plain(text)

    _encoders[tokenizer] = run
    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece, and its ``ids`` if asked for."""
    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for b in batches:
            for k in range(0, b.num_rows, 256):
                of, piece, start, length, crc, all_ids = [], [], [], [], [], []
                for i in range(k, min(k + 256, b.num_rows)):
                    ids = np.append(encode(b.column(1)[i].as_py()), np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    head = (n - 1) % capacity + 1
                    at = [0, *range(head, n, capacity)]
                    for p, a in enumerate(at):
                        z = at[p + 1] if p + 1 < len(at) else n
                        of.append(i)
                        piece.append(p)
                        start.append(a)
                        length.append(z - a)
                        crc.append(zlib.crc32(ids[a:z].tobytes()))
                        if with_ids:
                            all_ids.append(ids[a:z].astype(np.int32))
                cols = [b.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names + ["ids"] * with_ids)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _split(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of ``df`` range-sorted by size, with ids breaking ties, in partitions of about ROWS rows."""
    return df.repartitionByRange(max(1, -(-n // ROWS)), "size", "gap", "id").sortWithinPartitions("size", "gap", "id")


class _Sweep:
    """What one partition's walk settles.  Items in order of size, documents before gaps of their size."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        gap, slots, size, ids = (pdf[c].to_numpy() for c in ("gap", "slots", "size", "id"))
        stack: list[int] = []
        self.pairs: list[tuple[int, int]] = []
        open_gaps: list[int] = []
        for i in range(len(ids)):
            if not gap[i]:
                stack.append(i)
                continue
            for _ in range(slots[i]):
                if stack:
                    self.pairs.append((stack.pop(), i))
                else:
                    open_gaps.append(i)
        self.size, self.ids = size, ids
        self.open_gaps, self.open_docs = open_gaps, stack[::-1]  # the largest document first


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    found = [b for b in batches if len(b)]
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"size": [], "gap": [], "id": [], "slots": []})


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (kind 0) and what stays open (1: gap slot, 2: document) with its rank in the partition."""
    from pyspark import TaskContext

    s = _Sweep(_whole(batches))
    part = TaskContext.get().partitionId()
    rows = [(0, part, 0, s.ids[d], s.ids[g], s.size[d], s.size[g]) for d, g in s.pairs]
    rows += [(1, part, k, -1, s.ids[g], 0, s.size[g]) for k, g in enumerate(s.open_gaps)]
    rows += [(2, part, k, s.ids[d], -1, s.size[d], 0) for k, d in enumerate(s.open_docs)]
    yield pd.DataFrame(rows, columns=["kind", "part", "k", "doc", "seq", "size", "gap"]).astype("int64")


def _across(counts: list) -> list[tuple[int, int, int, int, int]]:
    """Which open documents meet which open gaps: ``doc part, first rank, gap part, first rank, number``."""
    docs = {r.part: r.n for r in counts if r.kind == 2}
    gaps = {r.part: r.n for r in counts if r.kind == 1}
    out, stack = [], []
    for p in sorted(docs.keys() | gaps.keys()):
        free, at = gaps.get(p, 0), 0
        while free and stack:
            dp, first, n = stack.pop()
            m = min(free, n)
            out.append((dp, first, p, at, m))
            free, at = free - m, at + m
            if n > m:
                stack.append((dp, first + m, n - m))
        if docs.get(p):
            stack.append((p, 0, docs[p]))
    return out


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``id, seq, round, size, k`` of every item of ``items`` (``id, size``): its sequence, and the order in it.

    A sequence's number is its first item's id.
    """
    spark = items.sparkSession
    left = save(items.select("id", "size"), "pack-items")
    placed: list[DataFrame] = []
    gaps, n_gaps, rnd = None, 0, 0  # seq, gap
    hist = {r.c: r.n for r in left.groupBy(F.when(F.col("size") <= LAST_CLASS, F.lit(LAST_CLASS)).otherwise(F.expr("cast(power(2, ceil(log2(size))) as bigint)")).alias("c")).agg(F.count("*").alias("n")).collect()}
    for ceiling in sorted(hist, reverse=True):
        largest = min(ceiling, capacity)
        floor_ = 0 if ceiling <= LAST_CLASS else ceiling // 2
        open_docs, n_open = left.filter((F.col("size") > floor_) & (F.col("size") <= ceiling)), hist[ceiling]
        while gaps is not None and n_open:
            # A wide gap takes as many documents of the class as are sure to fit; any other tries to take one.
            slots = F.greatest(F.lit(1), F.floor(F.col("gap") / largest)).cast("bigint")
            wide = gaps.filter(F.col("gap") > floor_).select(F.col("gap").alias("size"), F.lit(1).alias("gap"), F.col("seq").alias("id"), slots.alias("slots"))
            both = open_docs.select("size", F.lit(0).alias("gap"), "id", F.lit(1).cast("bigint").alias("slots")).unionByName(wide)
            swept = save(_split(both, n_open + n_gaps).mapInPandas(_sweep, "kind long, part long, k long, doc long, seq long, size long, gap long"), "pack-sweep")
            counts = swept.groupBy("kind", "part").agg(F.count("*").alias("n")).collect()
            met = _across(counts)
            n_pairs = sum(r.n for r in counts if r.kind == 0) + sum(m for *_, m in met)
            if not n_pairs:
                break
            pairs = swept.filter("kind = 0").select("doc", "seq", "size")
            still = swept.filter("kind = 2").select(F.col("doc").alias("id"), "size")
            if met:
                plan = spark.createDataFrame(met, "dp long, d0 long, gp long, g0 long, m long")
                d = swept.filter("kind = 2").join(F.broadcast(plan), (F.col("part") == F.col("dp")) & (F.col("k") >= F.col("d0")) & (F.col("k") < F.col("d0") + F.col("m")), "left")
                d = d.select("doc", "size", "gp", (F.col("g0") + F.col("k") - F.col("d0")).alias("gk"))
                g = swept.filter("kind = 1").select("part", F.col("k").alias("r"), "seq")
                pairs = pairs.unionByName(d.filter("gp IS NOT NULL").join(g, (d["gp"] == g["part"]) & (d["gk"] == g["r"])).select("doc", "seq", "size"))
                still = d.filter("gp IS NULL").select(F.col("doc").alias("id"), "size")
            placed.append(pairs.select(F.col("doc").alias("id"), "seq", F.lit(rnd).alias("round"), "size"))
            used = pairs.groupBy("seq").agg(F.sum("size").alias("used"))
            gaps = save(gaps.join(used, "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")), "pack-gaps")
            open_docs, n_open = still, n_open - n_pairs
            rnd += 1
        if n_open:
            opened = _open(open_docs, capacity, n_open)
            placed.append(opened.select("id", "seq", F.lit(rnd).alias("round"), "size"))
            new = opened.groupBy("seq").agg((F.lit(capacity) - F.sum("size")).alias("gap"))
            gaps = save((new if gaps is None else gaps.unionByName(new)).filter("gap > 0"), "pack-gaps")
            n_gaps += n_open  # at most
            rnd += 1
    if not placed:
        return items.select("id", F.col("id").alias("seq"), F.lit(0).alias("round"), "size")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def _open(docs: DataFrame, capacity: int, n: int) -> DataFrame:
    """Open sequences for documents of a class: runs of the size order, as many as fit in each."""
    ordered = _split(docs.select("size", F.lit(0).alias("gap"), "id"), n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = _whole(batches)
        size, ids = pdf["size"].to_numpy()[::-1], pdf["id"].to_numpy()[::-1]
        seq, used, now = np.empty(len(ids), dtype=np.int64), capacity, -1
        for i in range(len(ids)):
            if used + size[i] > capacity:
                now, used = ids[i], 0
            seq[i] = now
            used += size[i]
        yield pd.DataFrame({"id": ids.astype("int64"), "seq": seq, "size": size.astype("int64")})

    return save(ordered.mapInPandas(run, "id long, seq long, size long"), "pack-opened")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row."""
    made = pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
    made = save(made.withColumn("id", F.monotonically_increasing_id()), "pieces")
    full = made.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("id")).withColumn("offset", F.lit(0).cast("bigint"))
    part = made.filter(F.col("length") < capacity)
    spots = pack(part.select("id", F.col("length").alias("size")), capacity)
    w = Window.partitionBy("seq").orderBy("round", F.desc("size"), "id").rowsBetween(Window.unboundedPreceding, 0)
    spots = spots.withColumn("offset", F.sum("size").over(w) - F.col("size")).select(F.col("id").alias("spot"), F.col("seq").alias("sequence_id"), "offset")
    packed = part.join(spots, part["id"] == spots["spot"]).drop("spot")
    return full.unionByName(packed).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The training sequences, ``sequence_id, input_ids, lengths``: each at most ``capacity`` ids; document ids must be unique."""
    ids = pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids=True).select(F.col("doc_id").alias("d"), F.col("piece").alias("p"), "ids")
    rows = packed.join(ids, (F.col("doc_id") == F.col("d")) & (F.col("piece") == F.col("p")))
    parts = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("x"))
    return parts.select("sequence_id", F.flatten("x.ids").alias("input_ids"), F.col("x.length").alias("lengths"))
