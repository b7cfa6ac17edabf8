"""Removal of repeated byte strings by a common-prefix interval tree over a distributed enhanced suffix array.

A byte goes if it lies in a string of ``length`` bytes that also starts elsewhere, in any document, this one included.

1. *Runs.*  The anchor of a window (a string of ``length`` bytes) is its seed of ``SEED_BYTES`` bytes with the smallest hash.
   Equal windows have equal anchors at equal places.  Successive windows with one anchor form a *run*, so a text yields a row
   for each run (about 1.2 in 100 bytes), not for each suffix.  Runs whose anchor occurs once hold no repeat.
2. *Classes.*  Other runs carry their bytes (from their first window to the end of their last); equal ones, by a 128-bit
   BLAKE2b digest, are one class with a count, so what copies share is worked on once.
3. *Suffixes.*  A class's suffix at a window enters the array if the window occurs twice or more and starts the class, or is
   left-diverse: its occurrences differ in the byte before them, or have none.  Equal suffixes are one leaf, with their
   count and left bytes.
4. *Array.*  Suffixes that share ``length`` bytes share an anchor, so a task sorts the leaves of whole anchors, with the
   lengths of the prefixes that neighbours share.  Anchors met over ``hot`` times are spread: their classes are dealt in
   slices, windows counted by hash over all slices (which picks the same suffixes), and leaves meet by their first
   ``length`` bytes; where over ``hot`` leaves begin alike, they are split by range, and the intervals that reach over a
   part's edges are found from skeletons of at most two blocks for each length.
5. *Tree.*  A stack scan gives the intervals with common prefixes: one row each, with parent, length, count and left diversity,
   and one row for each suffix, with its deepest interval (its span).  Rows grow with the suffixes, not with nesting.

``remove_repeats`` takes spans back from suffixes to runs and texts.  A class's suffixes end with its run, so a repeat that goes on
over several runs is an interval for each of them.

Window hashes only choose candidates; suffixes are compared as bytes, runs by BLAKE2b, texts are named by 96 bits of hash.

Defined results: a null text is empty; shorter texts lose nothing; matches never cross texts; equal rows are each
answered, and repeat each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plover.llm.common import discard, parts, save, text_or_empty

LENGTH = 200
SEED_BYTES = 64
HOT = 1024
SLICE = 4096  # classes of hot anchors that a task holds at once
MAX_RANGES = 4096
PIECE = 1 << 20  # bytes worked on at once
_POS = 24  # bits of a position; PIECE and the longest overlap stay below


class Hashes:
    """Hashes of substrings of a byte array: polynomial, modulo 2**64, over random byte values."""

    def __init__(self, seed: int, most: int) -> None:
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        base = int(rng.integers(1, 1 << 62)) * 4 + 3
        back = pow(base, -1, 1 << 64)
        self.up = np.cumprod(np.append(np.uint64(1), np.full(most, base, dtype=np.uint64)), dtype=np.uint64)
        self.down = np.cumprod(np.append(np.uint64(1), np.full(most, back, dtype=np.uint64)), dtype=np.uint64)

    def sums(self, b: np.ndarray) -> np.ndarray:
        return np.append(np.uint64(0), np.cumsum(self.byte[b] * self.up[: len(b)], dtype=np.uint64))

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.down[start]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


_made: dict[tuple[int, int], Hashes] = {}


def hashes(seed: int, most: int) -> Hashes:
    if (seed, most) not in _made:
        _made[seed, most] = Hashes(seed, most)
    return _made[seed, most]


def runs(texts: list[bytes], length: int = LENGTH, seed: int = SEED_BYTES) -> dict[str, np.ndarray]:
    """Runs of all texts: ``text`` number, ``start`` of the first window, ``n`` windows, hash of the anchor."""
    out: list[tuple] = []
    batch: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), PIECE):  # a window lies in one piece only
            piece = t[a : a + PIECE + length - 1]
            if len(piece) >= length:
                batch.append((i, a, piece))
                size += len(piece)
                if size >= PIECE:
                    out.append(_runs(batch, length, seed))
                    batch, size = [], 0
    if batch:
        out.append(_runs(batch, length, seed))
    names = ("text", "start", "n", "anchor")
    return {k: np.concatenate([x[j] for x in out]) if out else np.empty(0, np.int64) for j, k in enumerate(names)}


def _runs(batch: list[tuple[int, int, bytes]], length: int, seed: int) -> tuple:
    h = hashes(1, 2 * PIECE + 2 * length)
    b = np.frombuffer(b"".join(p for *_, p in batch), dtype=np.uint8)
    sizes = np.array([len(p) for *_, p in batch])
    owner = np.repeat(np.arange(len(batch)), sizes)
    begin = np.append(0, np.cumsum(sizes)[:-1])
    s = h.sums(b)
    w = length - seed + 1
    at = np.arange(len(b) - seed + 1)
    kmer = h.of(s, at, at + seed)
    v = (kmer >> np.uint64(_POS) << np.uint64(_POS)) | at.astype(np.uint64)  # leftmost of equal ones
    pad = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    pad[: len(v)] = v
    grid = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    win = np.arange(len(b) - length + 1)
    least = np.minimum(behind[win], ahead[win + w - 1])
    win = win[owner[win] == owner[win + length - 1]]
    anchor = (least[win] & np.uint64((1 << _POS) - 1)).astype(np.int64)
    new = np.append(True, (np.diff(win) != 1) | (np.diff(anchor) != 0) | (np.diff(owner[win]) != 0))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(win)))
    start, anchor = win[first], anchor[first]
    of = owner[start]
    return np.array([x[0] for x in batch])[of], start - begin[of] + np.array([x[1] for x in batch])[of], n, kmer[anchor].view(np.int64)


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(docs[text_col])
    return docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("u"), F.hash(text, F.lit(7)).alias("u2"))


def _bytes(col: pa.Array) -> list[bytes]:
    return col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()).to_pylist()


def _emit_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                c = b.slice(k, 256)
                r = runs(_bytes(c.column(2)), length)
                of = pa.array(r["text"], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(r["anchor"], pa.int64()), c.column(0).take(of), c.column(1).take(of), pa.array(r["start"], pa.int64()), pa.array(r["n"], pa.int32())], ["anchor", "u", "u2", "start", "n"])

    return run


_OCCURRENCES = "anchor long, cls binary, u long, u2 int, start long, n int, weight long, hot boolean, prev int, bytes binary"


def _emit_occurrences(length: int):
    """Each run asked for with its class and the byte before it (-1: none); a task sends the bytes of a class once or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for b in batches:
            for k in range(0, b.num_rows, 64):
                c = b.slice(k, 64)
                if len(sent) > 100_000:
                    sent = set()
                cols: list[list] = [[] for _ in range(10)]
                for t, u, u2, *asked in zip(_bytes(c.column(2)), *(c.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7)), strict=True):
                    for a, s, n, w, hot in zip(*asked, strict=True):
                        body = t[s : s + n - 1 + length]
                        cls = hashlib.blake2b(body, digest_size=16, salt=a.to_bytes(8, "little", signed=True)).digest()
                        new = cls not in sent
                        sent.add(cls)
                        for col, x in zip(cols, (a, cls, u, u2, s, n, w, hot, t[s - 1] if s else -1, body if new else None), strict=True):
                            col.append(x)
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, kinds, strict=True)], [x.split()[0] for x in _OCCURRENCES.split(", ")])

    return run


# --- suffixes --------------------------------------------------------------------------------------------------------------


class _Windows:
    """The windows of some classes' bytes: row and offset of each, its hash, and the bounds of the bytes before it."""

    def __init__(self, pdf: pd.DataFrame, length: int, seeds: tuple[int, ...] = (2,)) -> None:
        n = pdf["n"].to_numpy().astype(np.int64)
        sizes = n - 1 + length
        begin = np.append(0, np.cumsum(sizes)[:-1]).astype(np.int64)
        flat = np.frombuffer(b"".join(pdf["bytes"]), dtype=np.uint8)
        self.row = np.repeat(np.arange(len(pdf)), n)
        self.t = np.arange(len(self.row)) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
        at = begin[self.row] + self.t
        mix = pdf["anchor"].to_numpy().view(np.uint64)[self.row] * np.uint64(0x9E3779B97F4A7C15)
        self.keys = []
        for seed in seeds:
            h = hashes(seed, max(1 << 21, 1 << len(flat).bit_length()))
            s = h.sums(flat)
            self.keys.append(h.of(s, at, at + length) ^ mix)
        self.weight = pdf["weight"].to_numpy()[self.row]
        before = flat[np.maximum(at - 1, 0)].astype(np.int64) if len(flat) else at
        first = self.t == 0
        self.lo = np.where(first, pdf["lo"].to_numpy()[self.row], before)
        self.hi = np.where(first, pdf["hi"].to_numpy()[self.row], before)

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows in the order of their keys, where groups of equal keys begin, their weights and bounds."""
        order = np.lexsort(self.keys[::-1])
        new = np.append(True, np.logical_or.reduce([np.diff(k[order]) != 0 for k in self.keys]))[: len(order)]
        first = np.flatnonzero(new)
        if not len(first):
            return order, first, first, first, first
        return order, first, np.add.reduceat(self.weight[order], first), np.minimum.reduceat(self.lo[order], first), np.maximum.reduceat(self.hi[order], first)


def _diverse(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (lo < 0) | (lo != hi)


_SUFFIXES = "sid binary, suffix binary, weight long, lo int, hi int, cls binary, t int"


def _strings(pdf: pd.DataFrame, w: _Windows, at: np.ndarray) -> list[bytes]:
    body = pdf["bytes"].tolist()
    return [body[r][o:] for r, o in zip(w.row[at].tolist(), w.t[at].tolist(), strict=True)]


def _suffix_rows(pdf: pd.DataFrame, w: _Windows, at: np.ndarray) -> pd.DataFrame:
    row, t = w.row[at], w.t[at]
    cls, made = pdf["cls"].tolist(), _strings(pdf, w, at)
    return pd.DataFrame({"sid": [hashlib.blake2b(s, digest_size=16).digest() for s in made], "suffix": made, "weight": w.weight[at], "lo": w.lo[at].astype(np.int32), "hi": w.hi[at].astype(np.int32), "cls": [cls[r] for r in row.tolist()], "t": t.astype(np.int32)})


def _deal(length: int, bins: int):
    """A row for each bin of window hashes that a slice has: ``bin, slice`` and packed hashes, weights and bounds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = _Windows(pdf, length, (2, 3))
        order, first, weight, lo, hi = w.groups()
        table = np.stack([w.keys[0][order[first]].view(np.int64), w.keys[1][order[first]].view(np.int64), weight, lo, hi], axis=1)
        bin_ = (table[:, 0].view(np.uint64) % np.uint64(bins)).astype(np.int64)
        by = np.argsort(bin_, kind="stable")
        cut = [p for p in np.split(by, np.flatnonzero(np.diff(bin_[by])) + 1) if len(p)]
        return pd.DataFrame({"bin": [int(bin_[p[0]]) for p in cut], "slice": int(pdf["slice"].iloc[0]), "packed": [table[p].tobytes() for p in cut]})

    return run


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each slice, its windows that repeat over all slices, and whether they are left-diverse."""
    tables = [np.frombuffer(x, dtype=np.int64).reshape(-1, 5) for x in pdf["packed"]]
    of = np.repeat(pdf["slice"].to_numpy(), [len(t) for t in tables])
    t = np.concatenate(tables)
    order = np.lexsort((t[:, 1], t[:, 0]))
    t, of = t[order], of[order]
    first = np.flatnonzero(np.append(True, (t[1:, :2] != t[:-1, :2]).any(1)))
    n = np.diff(np.append(first, len(t)))
    again = np.repeat(np.add.reduceat(t[:, 2], first) > 1, n)
    left = np.repeat(_diverse(np.minimum.reduceat(t[:, 3], first), np.maximum.reduceat(t[:, 4], first)), n)
    said, of = np.column_stack([t[:, :2], left.astype(np.int64)])[again], of[again]
    by = np.argsort(of, kind="stable")
    names, begin = np.unique(of[by], return_index=True)
    return pd.DataFrame({"slice": names.astype(np.int32), "said": [x.tobytes() for x in np.split(said[by], begin[1:])][: len(names)]})


def _of_slices(length: int):
    def run(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[x.split()[0] for x in _SUFFIXES.split(", ")])
        w = _Windows(pdf, length, (2, 3))
        said = np.concatenate([np.empty((0, 3), dtype=np.int64), *(np.frombuffer(x, dtype=np.int64).reshape(-1, 3) for x in replies["said"])])
        known = {(a, b): bool(d) for a, b, d in said.tolist()}
        got = [known.get(k) for k in zip(w.keys[0].view(np.int64).tolist(), w.keys[1].view(np.int64).tolist(), strict=True)]
        at = np.array([i for i, d in enumerate(got) if d is not None and (d or w.t[i] == 0)], dtype=np.int64)
        return _suffix_rows(pdf, w, at)

    return run


# --- array and tree ----------------------------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi - 1:  # a[:lo] == b[:lo], a[:hi] != b[:hi]
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def interval_tree(lcp: list[int], own: list[int], least: int) -> list[tuple[int, int, int]]:
    """Length, first and end of every interval of sorted leaves whose members share ``least`` bytes or more.

    lcp: the prefix each leaf shares with the one before it (the first: 0); own: the length of a leaf that counts twice or
    more, and so is an interval itself, else 0.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for i in range(len(lcp) + 1):
        shared = lcp[i] if i < len(lcp) else 0
        shared = shared if shared >= least else 0
        first = i - 1
        while stack and stack[-1][0] > shared:
            depth, first = stack.pop()
            out.append((depth, first, i))
        if shared and not (stack and stack[-1][0] == shared):
            stack.append((shared, first))
        if i < len(lcp) and own[i] >= least and not (stack and stack[-1][0] == own[i]):
            stack.append((own[i], i))
    return out


def label(prefix: bytes) -> bytes:
    """The name of the interval whose members share ``prefix``."""
    return hashlib.blake2b(prefix, digest_size=16, person=b"interval").digest()


_NODES = "kind int, id binary, parent binary, length int, count long, lo int, hi int, item int, part int, lcp int, sample binary, g long"


def _node_frame(rows: list[tuple]) -> pd.DataFrame:
    """kind 0: an interval; 1: a leaf (id: its suffix's), 3: a suffix (id: its class, item: its place), and its deepest
    interval as parent and length; 2: a block of a part's skeleton."""
    names = [x.split() for x in _NODES.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pd.DataFrame({name: pd.Series(c, dtype={"int": "Int32", "long": "Int64"}.get(kind, object)) for (name, kind), c in zip(names, cols, strict=True)})


def tree(suffixes: list[bytes], sids: list[bytes], weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int, before: bytes | None = None, after: bytes | None = None, part: int = 0, g: int = 0) -> list[tuple]:
    """Rows of one part of the array: leaves in order, ``before`` and ``after`` the leaves on either side of the part."""
    m = len(suffixes)
    lcp = [common_prefix(before, suffixes[0]) if before is not None else 0, *(common_prefix(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False))]
    lcp.append(common_prefix(suffixes[-1], after) if after is not None else 0)
    lcp = [x if x >= least else 0 for x in lcp]
    own = [len(s) if w > 1 else 0 for s, w in zip(suffixes, weight.tolist(), strict=True)]
    rows: list[tuple] = []
    for i in range(m):
        deep = max(lcp[i], lcp[i + 1], own[i])
        rows.append((1, sids[i], label(suffixes[i][:deep]) if deep else None, deep, int(weight[i]), int(lo[i]), int(hi[i]), None, None, None, None, None))
    total = np.append(0, np.cumsum(weight))
    for depth, a, z in interval_tree([0, *lcp[1:m]], own, least):
        if not (a == 0 and lcp[0] >= depth or z == m and lcp[m] >= depth):  # else it reaches over an edge
            up = max(lcp[a], lcp[z])
            rows.append((0, label(suffixes[a][:depth]), label(suffixes[a][:up]) if up else None, depth, int(total[z] - total[a]), int(lo[a:z].min()), int(hi[a:z].max()), None, None, None, None, None))
    if before is not None or after is not None:
        inner = np.array(lcp[1:m], dtype=np.int64)
        cut = np.zeros(m - 1, dtype=bool)
        if m > 1:
            ahead, behind = np.minimum.accumulate(inner), np.minimum.accumulate(inner[::-1])[::-1]
            cut = np.append(True, ahead[1:] < ahead[:-1]) | np.append(behind[:-1] < behind[1:], True)
        edges = [0, *(np.flatnonzero(cut) + 1).tolist(), m]
        for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
            rows.append((2, None, None, None, int(total[z] - total[a]), int(lo[a:z].min()), int(hi[a:z].max()), k, part, lcp[a], suffixes[a], g))
    return rows


def _of_buckets(length: int):
    """The trees of whole buckets (all classes of an anchor)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [b for b in batches if len(b)]
        if not found:
            return
        pdf = pd.concat(found, ignore_index=True).sort_values("anchor", kind="stable", ignore_index=True)
        anchors = pdf["anchor"].to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1])), len(pdf))
        i = 0
        while i < len(edge) - 1:  # whole buckets, some thousand classes at a time
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + SLICE, side="right")) - 1)
            part = pdf.iloc[edge[i] : edge[j]].reset_index(drop=True)
            i = j
            w = _Windows(part, length)
            order, first, weight, lo, hi = w.groups()
            n = np.diff(np.append(first, len(order)))
            again, left = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
            again[order], left[order] = np.repeat(weight > 1, n), np.repeat(_diverse(lo, hi), n)
            at = np.flatnonzero(again & (left | (w.t == 0)))
            if not len(at):
                continue
            made = _strings(part, w, at)
            by = np.array(sorted(range(len(made)), key=made.__getitem__))
            begins = np.append(True, [made[x] != made[y] for x, y in zip(by[1:].tolist(), by[:-1].tolist(), strict=True)])
            head = np.flatnonzero(begins)
            at = at[by]
            weight, lo, hi = np.add.reduceat(w.weight[at], head), np.minimum.reduceat(w.lo[at], head), np.maximum.reduceat(w.hi[at], head)
            rows = tree([made[x] for x in by[head].tolist()], list(range(len(head))), weight, lo, hi, length)
            deep = {x[1]: x[2:4] for x in rows if x[0] == 1}
            cls = part["cls"].tolist()
            members = [(3, cls[r], *deep[leaf], None, None, None, t, None, None, None, None) for r, t, leaf in zip(w.row[at].tolist(), w.t[at].tolist(), (np.cumsum(begins) - 1).tolist(), strict=True) if deep[leaf][1]]
            yield _node_frame([x for x in rows if x[0] == 0] + members)

    return run


def _trees(length: int):
    """The trees of leaves that meet by their first bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [b for b in batches if len(b)]
        if found:
            pdf = pd.concat(found, ignore_index=True)
            pdf = pdf.iloc[np.array(sorted(range(len(pdf)), key=pdf["suffix"].tolist().__getitem__))]
            rows = tree(pdf["suffix"].tolist(), pdf["sid"].tolist(), *(pdf[c].to_numpy() for c in ("weight", "lo", "hi")), length)
            for i in range(0, len(rows), 20_000):
                yield _node_frame(rows[i : i + 20_000])

    return run


def _tree_of_part(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.array(sorted(range(len(pdf)), key=pdf["suffix"].tolist().__getitem__))]
        edge = pdf.iloc[0]
        return _node_frame(tree(pdf["suffix"].tolist(), pdf["sid"].tolist(), *(pdf[c].to_numpy() for c in ("weight", "lo", "hi")), length, edge["before"], edge["after"], int(edge["part"]), int(edge["g"])))

    return run


def _over_edges(length: int):
    """The intervals of more than one part, from the parts' skeletons."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "item"], ignore_index=True)
        sample, lcp, part = pdf["sample"].tolist(), [0, *pdf["lcp"].iloc[1:].astype(int).tolist()], pdf["part"].tolist()
        weight, lo, hi = (pdf[c].to_numpy(dtype=np.int64) for c in ("count", "lo", "hi"))
        total = np.append(0, np.cumsum(weight))
        rows = []
        for depth, a, z in interval_tree(lcp, [0] * len(lcp), length):
            if part[a] != part[z - 1]:
                up = max(lcp[a], lcp[z] if z < len(lcp) else 0)
                rows.append((0, label(sample[a][:depth]), label(sample[a][:up]) if up else None, depth, int(total[z] - total[a]), int(lo[a:z].min()), int(hi[a:z].max()), None, None, None, None, None))
        return _node_frame(rows)

    return run


def _classes(docs: DataFrame, length: int, id_col: str, text_col: str, hot: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences of runs that may repeat (``cls, u, u2, start, n, weight``), and their classes (with bytes), both saved."""
    rows = _ids(docs, id_col, text_col)
    long = rows.filter(F.octet_length("text") >= length).select("u", "u2", "text")
    found = save(long.mapInArrow(_emit_runs(length), "anchor long, u long, u2 int, start long, n int"), "runs")
    met = save(found.groupBy(F.col("anchor").alias("m_anchor")).agg(F.count("*").alias("c")).filter("c > 1").select("m_anchor", (F.col("c") > hot).alias("hot")), "met-anchors")
    known = save(found.join(met.hint("merge"), F.col("anchor") == F.col("m_anchor")).drop("m_anchor"), "known-runs")  # saved, so that a hot anchor's join can be split
    discard(found)
    discard(met)
    listed = known.groupBy("anchor", "u", "u2", "start", "n", "hot").agg(F.count("*").alias("weight"))
    asked = listed.groupBy(F.col("u").alias("a_u"), F.col("u2").alias("a_u2")).agg(F.collect_list(F.struct("anchor", "start", "n", "weight", "hot")).alias("asked"))
    asked = save(asked, "asked-runs")
    discard(known)
    once = long.groupBy("u", "u2").agg(F.first("text").alias("text"))
    joined = once.join(asked.hint("merge"), (F.col("u") == F.col("a_u")) & (F.col("u2") == F.col("a_u2"))).select("u", "u2", "text", *(F.col(f"asked.{c}").alias(f"a_{c}") for c in ("anchor", "start", "n", "weight", "hot")))
    occurrences = save(joined.mapInArrow(_emit_occurrences(length), _OCCURRENCES), "occurrences")
    discard(asked)
    classes = occurrences.groupBy("anchor", "cls").agg(F.sum("weight").alias("weight"), F.min("prev").alias("lo"), F.max("prev").alias("hi"), F.max("n").alias("n"), F.max("hot").alias("hot"), F.max("bytes").alias("bytes"))
    return occurrences.drop("bytes"), save(classes, "run-classes")


def _hot_suffixes(many: DataFrame, length: int) -> DataFrame:
    """The suffixes of the classes of hot anchors, saved."""
    slices = 1 + many.count() // SLICE
    sliced = save(many.withColumn("slice", F.pmod(F.xxhash64("cls"), F.lit(slices)).cast("int")), "hot-slices")
    dealt = sliced.groupBy("slice").applyInPandas(_deal(length, max(parts(many), 4 * slices)), "bin long, slice int, packed binary")
    said = dealt.groupBy("bin").applyInPandas(_count, "slice int, said binary")
    out = save(sliced.groupBy("slice").cogroup(said.groupBy("slice")).applyInPandas(_of_slices(length), _SUFFIXES), "hot-suffixes")
    discard(sliced)
    return out


def _hot_nodes(suffixes: DataFrame, length: int, hot: int) -> DataFrame:
    """Rows of the tree over these suffixes (see ``_node_frame``)."""
    leaves = suffixes.groupBy("sid", "suffix").agg(F.sum("weight").alias("weight"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    leaves = save(leaves.withColumn("g", F.xxhash64(F.substring("suffix", 1, length))), "leaves")
    big = save(leaves.groupBy(F.col("g").alias("b_g")).agg(F.count("*").alias("d")).filter(F.col("d") > hot).select("b_g"), "hot-prefixes")
    flagged = save(leaves.join(big.hint("merge"), F.col("g") == F.col("b_g"), "left").select(*leaves.columns, F.col("b_g").isNotNull().alias("hot")), "flagged-leaves")
    cold = flagged.filter("NOT hot").repartition(parts(suffixes), "g").mapInPandas(_trees(length), _NODES)
    many = flagged.filter("hot")
    count = many.count()
    if not count:
        return cold
    ranges = min(MAX_RANGES, 1 + count // hot)
    share = max(1, count // (16 * ranges))
    picked = sorted(bytes(r.suffix) for r in many.filter(F.pmod(F.xxhash64("sid"), F.lit(share)) == 0).select("suffix").collect())  # about 16 * ranges rows
    shared = suffixes.sparkSession.sparkContext.broadcast(picked[::16])

    @F.pandas_udf("int")
    def range_of(suffix: pd.Series) -> pd.Series:
        from bisect import bisect_right

        bounds = shared.value
        return pd.Series([bisect_right(bounds, bytes(s)) for s in suffix], dtype="int32")

    many = save(many.drop("hot").withColumn("part", range_of("suffix")), "ranged-leaves")
    ends = many.groupBy("g", "part").agg(F.min("suffix").alias("least"), F.max("suffix").alias("most"))
    w = Window.partitionBy("g").orderBy("part")  # at most MAX_RANGES rows
    ends = ends.withColumn("before", F.lag("most").over(w)).withColumn("after", F.lead("least").over(w))
    ends = save(ends.select(F.col("g").alias("e_g"), F.col("part").alias("e_part"), "before", "after"), "range-ends")
    many = many.join(ends.hint("merge"), (F.col("g") == F.col("e_g")) & (F.col("part") == F.col("e_part"))).drop("e_g", "e_part")
    warm = save(many.groupBy("g", "part").applyInPandas(_tree_of_part(length), _NODES), "nodes-of-ranges")
    over = warm.filter("kind = 2").groupBy("g").applyInPandas(_over_edges(length), _NODES)
    return cold.unionByName(warm.filter("kind < 2")).unionByName(over)


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences of classes (``cls, u, u2, start, n, weight``), suffixes of classes (``cls, t, interval, depth``: their deepest
    intervals) and intervals (``id, parent, length, count, maximal``); saved."""
    occurrences, classes = _classes(docs, length, id_col, text_col, hot)
    nodes = save(classes.filter("NOT hot").repartition(parts(classes), "anchor").mapInPandas(_of_buckets(length), _NODES), "nodes")
    members = nodes.filter("kind = 3").select(F.col("id").alias("cls"), F.col("item").alias("t"), F.col("parent").alias("interval"), F.col("length").alias("depth"))
    many = classes.filter("hot")
    if many.limit(1).count():
        suffixes = _hot_suffixes(many, length)
        warm = save(_hot_nodes(suffixes, length, hot), "hot-nodes")
        deep = warm.filter("kind = 1 AND length > 0").select(F.col("id").alias("l_sid"), F.col("parent").alias("interval"), F.col("length").alias("depth"))
        of = suffixes.select("sid", "cls", "t").join(deep.hint("merge"), F.col("sid") == F.col("l_sid"))
        members = members.unionByName(save(of.select("cls", "t", "interval", "depth"), "hot-members"))
        nodes = nodes.filter("kind = 0").unionByName(warm.filter("kind = 0"))
        discard(suffixes)
    discard(classes)
    intervals = nodes.filter("kind = 0").select("id", "parent", "length", "count", ((F.col("lo") < 0) | (F.col("lo") != F.col("hi"))).alias("maximal"))
    return occurrences, members, intervals


def merged(begin: list[int], end: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for x, y in sorted(zip(begin, end, strict=True)):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def spans(occurrences: DataFrame, members: DataFrame) -> DataFrame:
    """``g_u, g_u2, a, z``: of each text that repeats, arrays of where its spans begin and end; saved."""

    @F.pandas_udf("array<struct<a: int, z: int>>")
    def join_up(a: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([[{"a": x, "z": y} for x, y in merged(b.tolist(), e.tolist())] for b, e in zip(a, z, strict=True)], dtype=object)

    own = F.collect_list(F.struct(F.col("t").alias("a"), (F.col("t") + F.col("depth")).alias("z"))).alias("own")
    of = members.groupBy(F.col("cls").alias("s_cls")).agg(own)
    of = save(of.select("s_cls", join_up("own.a", "own.z").alias("own")), "class-spans")
    met = occurrences.select("cls", "u", "u2", "start").join(of.hint("merge"), F.col("cls") == F.col("s_cls"))
    met = met.select("u", "u2", F.transform("own", lambda s: s["a"] + F.col("start")).alias("a"), F.transform("own", lambda s: s["z"] + F.col("start")).alias("z"))
    return save(met.groupBy(F.col("u").alias("g_u"), F.col("u2").alias("g_u2")).agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("z")).alias("z")), "spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` of every row; ``kept`` holds the remaining bytes."""
    occurrences, members, _ = repeats(docs, length, id_col, text_col, hot)
    gone = spans(occurrences, members)
    rows = _ids(docs, id_col, text_col)
    met = rows.join(gone.hint("merge"), (F.col("u") == F.col("g_u")) & (F.col("u2") == F.col("g_u2")), "left").select("doc_id", "text", "a", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                c = b.slice(k, 512)
                size, removed, n_spans, kept, sha = [], [], [], [], []
                for t, a, z in zip(_bytes(c.column(1)), c.column(2), c.column(3), strict=True):
                    found = merged(a.as_py() or [], z.as_py() or [])
                    left, at = [], 0
                    for x, y in found:
                        left.append(t[at:x])
                        at = y
                    rest = b"".join([*left, t[at:]])
                    size.append(len(t))
                    removed.append(len(t) - len(rest))
                    n_spans.append(len(found))
                    kept.append(rest)
                    sha.append(hashlib.sha256(rest).hexdigest())
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
