"""SimHash near-dedup by Golay-code fuzzy hashing.

A document's fingerprint has a bit for each bit of XXH64 that is set in over half of its word shingles' hashes.  The 64
bits are cut into three segments.  If two fingerprints differ in 3 bits at most, two of the segments differ in 1 bit at
most each (were two segments off by 2 or more, that made 4).  A segment is padded to 23 bits and decoded by the binary
Golay code, which is perfect, so every word has one nearest codeword: its 12-bit index is the segment's key, and
decoding the segment and its one-bit neighbours gives the one to six keys under which a segment 1 bit away can be found.
A pair of segments makes a 24-bit key: each fingerprint is listed under 3 keys and looked up under about 84, links are
found by an equi-join, and verified by counting bits.

``similar_groups`` groups texts whose word shingles (five words, each once, case of A-Z and kind of white space ignored) have a
Jaccard similarity of 0.8 or more; it finds all of them.

1. A similar text has at least 0.8 of a text's shingles.  Shingles are dealt by hash, packed by batch of texts, counted, and
   those that occur in other texts go back to their batch, packed.  Texts that have fewer than that are done.
2. The others' shingles are ordered by how many texts have them.  Two similar texts share one of their
   rarest ``size - ceil(0.8 * size) + 1``, so the texts that share such ones hang together.
3. Texts that hang together are compared with each other: in one task up to a tile's bounds, else in tiles by size, two at a time, as products of
   0/1 matrices.  Pairs are never listed; a group gives links that span its similar texts, each verified on the texts.

Distinct fingerprints are linked, not documents, so copies are never expanded into pairs.  Components come from
distributed label propagation with hooking and pointer jumping; labels are written to the shared folder in each round.

Defined results: null and empty texts have no words, and fingerprint zero, which links like any other; a text of fewer
words than a shingle is one shingle; a component's id is its smallest document id (null ids count only if alone);
repeated rows each get their row; an empty table gives an empty result; extra columns pass through ``drop``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.llm.common import discard, parts, save, text_or_empty

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
PAIRS = ((0, 1), (0, 2), (1, 2))
MAX_BITS = 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, n: int = 3) -> int:
    """The fingerprint of one text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split() cuts at the same six characters
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < n:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words])[: len(words) - n + 1].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)]
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        h = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), n) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


class Golay:
    """Decoding of 23-bit words to the index of the nearest codeword, by syndrome."""

    POLY = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1

    def __init__(self) -> None:
        error = np.zeros(2048, dtype=np.int64)
        bits = [0, *(1 << i for i in range(23))]
        patterns = np.unique([a | b | c for a in bits for b in bits for c in bits])
        error[self.syndrome(patterns)] = patterns  # 2048 patterns of weight 3 at most, a syndrome each
        self.error = error

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        x = np.array(x, dtype=np.int64)
        for i in range(22, 10, -1):
            x ^= np.where(x >> i & 1, self.POLY << (i - 11), 0)
        return x

    def index(self, x: np.ndarray) -> np.ndarray:
        return (x ^ self.error[self.syndrome(x)]) >> 11

    def keys(self, x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the word and of its neighbours in the low ``bits``, and which of them are met for the first time."""
        near = self.index(x[:, None] ^ np.append(0, 1 << np.arange(bits))[None, :])
        near = np.sort(near, axis=1)
        return near, np.append(np.ones((len(x), 1), dtype=bool), near[:, 1:] != near[:, :-1], axis=1)


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        own = [golay.index(s) for s in _segments(fp)]
        keys = np.concatenate([(p << 24) | (own[i] << 12) | own[j] for p, (i, j) in enumerate(PAIRS)])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(fp, len(PAIRS)))], ["key", "fp"])


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for b in batches:
        every = b.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(every), 1024):
            fp = every[k : k + 1024]
            near = [golay.keys(s, n) for s, (_, n) in zip(_segments(fp), SEGMENTS, strict=True)]
            for p, (i, j) in enumerate(PAIRS):
                at, x, y = np.nonzero(near[i][1][:, :, None] & near[j][1][:, None, :])
                keys = (p << 24) | (near[i][0][at, x] << 12) | near[j][0][at, y]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at])], ["key", "fp"])


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: every two distinct fingerprints of column ``fp`` (distinct) that differ in ``max_bits`` at most, once."""
    if max_bits > MAX_BITS:
        raise ValueError(f"all links are found up to {MAX_BITS} bits only")
    listed = fps.mapInArrow(_listing, "key long, fp long").select(F.col("key").alias("k"), F.col("fp").alias("a"))
    sought = fps.mapInArrow(_lookup, "key long, fp long").select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    # The planner takes the keys for as few as the fingerprints they come from; they must not be broadcast.
    return listed.hint("merge").join(sought, (F.col("k") == F.col("key")) & near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``v, root`` of every node of ``edges`` (``a, b``): the smallest node that it reaches."""
    both = save(edges.select(F.col("a").alias("u"), F.col("b").alias("w")).union(edges.select("b", "a")), "links")
    label = save(both.groupBy(F.col("u").alias("v")).agg(F.least(F.col("v"), F.min("w")).alias("l")), "labels") if both.limit(1).count() else both.selectExpr("u AS v", "w AS l")
    while True:
        heard = both.join(label.select(F.col("v").alias("u"), "l"), "u").groupBy(F.col("w").alias("x")).agg(F.min("l").alias("m"))
        known = label.join(heard, label["v"] == heard["x"], "left").select("v", "l", F.least("l", "m").alias("m"))
        # A node takes its smallest neighbour's label, and so does the node that its label names.
        told = known.select(F.explode(F.array(F.struct("v", "m", "l"), F.struct(F.col("l").alias("v"), F.col("m"), F.lit(None).cast("bigint").alias("l")))).alias("t")).select("t.*")
        new = told.groupBy("v").agg(F.min("m").alias("l"), F.max("l").alias("old"))
        up = new.select(F.col("v").alias("p"), F.col("l").alias("pl"))
        new = save(new.join(up, new["l"] == up["p"], "left").select("v", F.coalesce("pl", "l").alias("l"), "old"), "labels")
        if new.filter(F.col("l") != F.col("old")).limit(1).count() == 0:
            return new.select("v", F.col("l").alias("root"))
        label = new.select("v", "l")


def near_duplicates(docs: DataFrame, n: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    made = save(fingerprints(docs, n, id_col, text_col), "fingerprints")
    distinct = save(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), max_bits))
    named = distinct.join(roots, distinct["fp"] == roots["v"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = save(named.join(ids, "root").select(F.col("fp").alias("f"), "component_id"), "fingerprint-components")
    return made.join(of, made["fp"] == of["f"]).select("doc_id", "fp", "component_id")


SIMILARITY = 0.8
BUCKET = 1 << 21  # shingles that a task sorts at once
FLUSH = 1 << 20
TILE, TILE_SHINGLES = 512, 1 << 20  # texts of a tile, and their shingles
WIDE = 4096


def shingles(text: str, n: int = 5) -> set[bytes]:
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each of ``sizes``, the distinct hashes of the shingles of that many words (of all words, if they are fewer)."""
    import xxhash

    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    word = np.array([known[w] for w in words], dtype=np.uint64)
    out, joined, k = {}, word, 1
    for n in sorted(min(n, len(word)) for n in sizes):
        while k < n:
            joined, k = _mixed(joined[:-1] * _GOLDEN + word[k:]), k + 1
        out[n] = np.unique(joined)
    return [out[min(n, len(word))] for n in sizes]


def alike(text: str, other: set[bytes], n: int, similarity: float) -> bool:
    """Whether a text's shingles and the set ``other`` have at least this Jaccard similarity.

    It stops as soon as so many shingles are missing from ``other`` that no rest of the text can make up for them.
    """
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    places = max(1, len(w) - n + 1) if w else 0
    bearable = (places - similarity * len(other)) / (1 + similarity) + 1e-6
    shared: set[bytes] = set()
    missing: set[bytes] = set()
    for i in range(places):
        x = b" ".join(w[i : i + n])
        if x in other:
            shared.add(x)
        else:
            missing.add(x)
            if len(missing) > bearable:
                return False
    return len(shared) >= similarity * (len(missing) + len(other))


def _text_shingles(text: str, n: int) -> np.ndarray:
    """The distinct hashes of a text's shingles; texts without words share one."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return shingle_hashes(words, (n,))[0] if words else np.zeros(1, dtype=np.uint64)


def _deal(n: int, bits: int):
    """Shingles by batch of texts and bucket (the hash's first ``bits``): the last 32 bits of each hash that the batch has there, in how many
    of its texts, and in which (their numbers).  The names and sizes of a batch's texts go with its first bucket; the first text names the batch.

    A batch has 256 shingles a bucket at least (fewer where it holds 65,536 texts, or a task's last), so rows grow as the shingles do.
    """
    full = max(FLUSH, 256 << bits)

    def pack(nodes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in sets], dtype=np.int32)
        h = np.concatenate(sets)
        order = np.argsort(h)
        h, owner = h[order], np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        many, h, at = np.diff(np.append(start, len(h))).astype(np.int32), h[start], np.append(start, len(h))
        bucket, low = (h >> np.uint64(64 - bits)).astype(np.int32), h.astype(np.uint32)
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(h)).tolist()
        names, rows = (np.array(nodes, dtype=np.int64).tobytes(), sizes.tobytes()), []
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            rows.append((int(bucket[i]), nodes[0], *(names if i == 0 else (b"", b"")), low[i:j].tobytes(), many[i:j].tobytes(), owner[at[i] : at[j]].tobytes(), None))
        yield _packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, held = [], [], 0
        for b in batches:
            for node, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = _text_shingles(t.as_py(), n)
                nodes.append(node)
                sets.append(x)
                held += len(x)
                if held >= full or len(nodes) == 1 << 16:
                    yield from pack(nodes, sets)
                    nodes, sets, held = [], [], 0
        if sets:
            yield from pack(nodes, sets)

    return run


_PACKED = ("bucket", "batch", "names", "sizes", "hashes", "many", "owners", "totals")
_KINDS = "bucket int, batch long, " + ", ".join(f"{c} binary" for c in _PACKED[2:])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *(pa.binary(),) * 6), strict=True)], list(_PACKED))


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """Rows that follow each other with the same value in ``column``."""
    rows: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and rows[0][column] != row[column]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _joined(rows: list[tuple], column: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), dtype=kind)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's rows, the shingles that two texts or more have, with how many have them (``totals``), by batch as they came."""
    for rows in _runs(batches, 0):
        many = _joined(rows, 5, np.int32)
        values, at = np.unique(_joined(rows, 4, np.uint32), return_inverse=True)
        total = np.bincount(at, many, len(values)).astype(np.int64)[at]  # whole numbers below 2^53
        out, begin = [], 0
        for bucket, batch, names, sizes, hashes, own, owners, _ in rows:
            h, own = np.frombuffer(hashes, dtype=np.uint32), np.frombuffer(own, dtype=np.int32)
            t = total[begin : begin + len(h)]
            begin += len(h)
            met = t > 1
            if names or met.any():
                out.append((bucket, batch, names, sizes, h[met].tobytes(), own[met].tobytes(), np.frombuffer(owners, dtype=np.uint16)[np.repeat(met, own)].tobytes(), t[met].tobytes()))
        if out:
            yield _packed(out)


def _rarest(similarity: float):
    """Each text that can have a similar one, its size, and its rarest shingles among which a similar text has one.

    The rarest come first, and those of one text only are met by none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 1):
            names, size, own, owner = _joined(rows, 2, np.int64), _joined(rows, 3, np.int32).astype(np.int64), _joined(rows, 5, np.int32), _joined(rows, 6, np.uint16).astype(np.int64)
            bucket = np.repeat(np.array([r[0] for r in rows], dtype=np.int64), [len(r[4]) // 4 for r in rows])
            key, total = np.repeat(bucket << 32 | _joined(rows, 4, np.uint32), own), np.repeat(_joined(rows, 7, np.int64), own)
            enough = np.ceil(similarity * size - 1e-9).astype(np.int64)  # of its shingles, a similar text has so many
            first = 1 - enough + np.bincount(owner, minlength=len(names))
            held = (first > 0)[owner]
            key, total, owner = key[held], total[held], owner[held]
            order = np.lexsort((key, total, owner))
            key, owner = key[order], owner[order]
            key = key[np.arange(len(owner)) - np.searchsorted(owner, owner) < first[owner]]
            texts = np.flatnonzero(first > 0)
            edge = np.append(0, np.cumsum(first[texts])).astype(np.int32)
            if len(texts):
                yield pa.RecordBatch.from_arrays([pa.array(names[texts]), pa.array(size[texts]), pa.ListArray.from_arrays(pa.array(edge), pa.array(key))], ["node", "size", "keys"])

    return run


def _prefixes(texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """``node, size, keys`` of :func:`_rarest`.  Buckets hold about ``BUCKET`` shingles each, so their number grows with the texts; a task has
    the rows of a bucket together, and then those of a batch."""
    held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(held // 6 // BUCKET).bit_length())
    dealt = texts.select("node", "text").mapInArrow(_deal(n, bits), _KINDS).repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    met = dealt.mapInArrow(_shared, _KINDS).repartition(parts(texts), "batch").sortWithinPartitions("batch")
    return met.mapInArrow(_rarest(similarity), "node long, size long, keys array<long>")


def _linked(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> np.ndarray:
    """Which two of the sets of hashes are similar; where both sides occur, of the two sides only."""
    size = np.array([len(x) for x in sets])
    h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    new = np.append(True, h[1:] != h[:-1])
    many = np.diff(np.append(np.flatnonzero(new), len(h)))
    term, kept = np.cumsum(new) - 1, np.repeat(many > 1, many)
    term, owner = (np.cumsum(many > 1) - 1)[term[kept]], owner[kept]
    both = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for i in range(0, int(term[-1]) + 1 if len(term) else 0, WIDE):
        a, b = np.searchsorted(term, (i, i + WIDE))
        m = np.zeros((len(sets), min(WIDE, int(term[-1]) + 1 - i)), dtype=np.float32)
        m[owner[a:b], term[a:b] - i] = 1
        both += (m @ m.T).astype(np.int64)  # whole numbers below 2^24
    near = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
    return near & (side[:, None] != side[None, :]) if side.any() and not side.all() else near


def _compare(n: int, similarity: float):
    """Links that span each group's similar texts, verified on the texts."""

    def forest(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        side = np.array([r[5] for r in rows], dtype=bool)
        near = _linked([_text_shingles(r[6], n) for r in rows], side, similarity)
        np.fill_diagonal(near, False)
        new = near.any(1)
        for first in range(len(rows)):
            todo = [first] if new[first] else []
            new[first] = False
            while todo:
                at = todo.pop()
                found = np.flatnonzero(near[at] & new)
                of = shingles(rows[at][6], n) if len(found) else set()
                for j in found.tolist():
                    if alike(rows[j][6], of, n, similarity):
                        new[j] = False
                        todo.append(j)
                        yield rows[at][4], rows[j][4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if links := list(forest(rows)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and rows[0][:4] != row[:4]:
                    yield from made(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from made(rows)

    return run


def _tiles(members: DataFrame, similarity: float) -> DataFrame:
    """``node`` and the groups ``root, band, low, high`` in which it is compared (``side``: as one of the second of two tiles).

    Texts that hang together and fill one tile at most are one group.  More are cut by size into bands, so that similar ones are in one
    band or in neighbours, and bands into tiles; every two tiles of a band, or of neighbours, make a group.
    """
    sized = members.withColumn("b", F.floor(F.log("size") / F.log(F.lit(1.0001 / similarity))).cast("int"))
    tiles = lambda n, size: F.ceil(F.greatest(n / TILE, size / TILE_SHINGLES)).cast("int")
    counts = sized.groupBy("root", "b").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    bands = counts.groupBy(F.col("root").alias("r")).agg(tiles(F.sum("n"), F.sum("s")).alias("all"), F.map_from_entries(F.collect_list(F.struct("b", tiles(F.col("n"), F.col("s"))))).alias("parts"))
    parts_of = lambda b: F.coalesce(F.try_element_at("parts", b), F.lit(0))
    part = F.pmod(F.xxhash64("node"), parts_of(F.col("b"))).cast("int")
    row = sized.join(bands, F.col("root") == F.col("r")).withColumn("part", part)
    group = lambda band, low, high, side: F.struct(band.alias("band"), low.alias("low"), high.alias("high"), side.alias("side"))
    upto = lambda b, f: F.transform(F.filter(F.sequence(F.lit(0), parts_of(b)), lambda j: j < parts_of(b)), f)
    own, b = F.col("part"), F.col("b")
    many = F.concat(
        upto(b, lambda j: group(2 * b, F.least(own, j), F.greatest(own, j), own > j)),
        upto(b + 1, lambda j: group(2 * b + 1, own, j, F.lit(False))),
        upto(b - 1, lambda j: group(2 * b - 1, j, own, F.lit(True))),
    )
    one = F.array(group(F.lit(0), F.lit(0), F.lit(0), F.lit(False)))
    return row.select("node", "root", F.explode(F.when(F.col("all") == 1, one).otherwise(many)).alias("g")).select("node", "root", "g.*")


def similar_texts(texts: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``v, root`` of the nodes of ``texts`` (``node, text``, a row each) that have a similar one: components of similar pairs."""
    prefixes = save(_prefixes(texts, shingle, similarity), "prefixes")
    members = prefixes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    met = members.groupBy(F.col("key").alias("k")).agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("k", "a")
    stars = save(members.join(met.hint("merge"), F.col("key") == F.col("k")).filter("a < node").select("a", F.col("node").alias("b")).distinct(), "candidate-links")
    groups = components(stars)
    discard(stars)
    tiles = save(_tiles(prefixes.join(groups, F.col("node") == F.col("v")).select("node", "size", "root"), similarity), "tiles")
    discard(prefixes)
    copies = tiles.withColumnRenamed("node", "i").join(texts.hint("merge"), F.col("i") == F.col("node")).select("root", "band", "low", "high", "node", "side", "text")
    copies = copies.repartition(parts(texts), "root", "band", "low", "high").sortWithinPartitions("root", "band", "low", "high")
    found = save(copies.mapInArrow(_compare(shingle, similarity), "a long, b long"), "similar-links")
    discard(tiles)
    return components(found)


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, group_id`` (and ``node``, the text's hash) of every row: the smallest id of its text's component under similarity; equal texts are similar."""
    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text")).withColumn("node", F.xxhash64("text"))
    least = save(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct-texts")
    texts = rows.select("node", "text")
    if least.filter("copies > 1").limit(1).count():  # none after exact dedup, which saves a shuffle of the texts
        texts = save(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
    roots = similar_texts(texts, shingle, similarity)
    named = least.join(roots, F.col("node") == F.col("v"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("group_id"))
    of = save(named.join(ids, "root").select(F.col("node").alias("f"), "group_id"), "text-groups")
    return rows.join(of, F.col("node") == F.col("f")).select("doc_id", "group_id", "node")


def drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows whose id is their group's, with the columns of ``docs``; rows with null ids that no id reaches stay.

    A row that goes is named by its id and its text, so others of its id stay.
    """
    found = similar_groups(docs, id_col=id_col, text_col=text_col, **kw)
    gone = found.filter(F.col("doc_id") != F.col("group_id")).select(F.col("doc_id").alias("__gone_id"), F.col("node").alias("__gone_node")).distinct()
    return docs.join(gone, (docs[id_col] == gone["__gone_id"]) & (F.xxhash64(text_or_empty(docs[text_col])) == gone["__gone_node"]), "left_anti")
