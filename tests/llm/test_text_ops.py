"""Operators on texts against brute force, and on awkward tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plover.llm import exact_dedup, packing, simhash, source_mix, suffix_dedup, token_count, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(t):
    return (t or "").translate(str.maketrans(UP, LOW))


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randint(0, 400)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base = [" ".join(words(i, r.randint(1, 120))) for i in range(60)]
    texts = base + base[:8] + [t.upper() for t in base[8:12]] + [base[20] + " extra", None, None, "", "   ", "é À ß 漢字 😀", "x" * 5000, " ".join(words(99, 6000)), "<|endoftext|> a", "tab\tnew\nline", "\x0b\x0c"]
    out = [(i, t, r.choice(["en", None]), ["a", "b", None, "a", "a"][i % 5], len(t or "")) for i, t in enumerate(texts)]
    return out + [(5, base[5], None, None, None), (None, base[6], "en", "a", 1), (None, None, None, None, None)] + [out[7]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


CLASH = ["id", "norm", "digest", "salt", "keep_id", "u", "fp", "row", "size", "k", "lo", "bucket", "h", "s", "score", "value", "component_id", "__gone", "dup_kept", "dup_keep_id", "w_keep", "kept"]


@pytest.fixture(scope="module")
def clash(docs):
    """Extra columns whose names the operators use inside."""
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- exact dedup ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, rows, weak):
    digest = (lambda c: F.lit(b"\x01").cast("binary")) if weak else exact_dedup.sha256  # all texts share the weak digest
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    got = exact_dedup.annotate(docs, digest=digest).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        ids = groups[lower(r.text)]
        want = max((i for i in ids if i is not None), default=None)
        assert (r.dup_keep_id, r.dup_group_size) == (want, len(ids))
        kept[lower(r.text)] += r.dup_kept
        assert not r.dup_kept or r.doc_id == want
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.deduplicate(docs, digest=digest).count() == len(groups)


def test_exact_dedup_edges(clash, empty):
    out = exact_dedup.deduplicate(clash)
    assert out.columns == clash.columns and out.count() > 0
    assert exact_dedup.annotate(empty).count() == 0
    marked = exact_dedup.annotate(clash)
    assert marked.columns[: len(clash.columns)] == clash.columns and len(set(marked.columns)) == len(marked.columns)
    assert marked.select("dup_keep_id", "_dup_keep_id", "_dup_kept").filter("_dup_kept").count() == out.count()


def test_exact_dedup_of_null_ids(spark):
    df = spark.createDataFrame([(None, "a", i) for i in range(40)] + [(None, "b", 0)] * 3 + [(1, "b", 0)], "doc_id long, text string, n int")
    kept = [(r.doc_id, r.text) for r in exact_dedup.deduplicate(df, salts=7).collect()]
    assert sorted(kept, key=str) == [(1, "b"), (None, "a")]


# --- token counts -----------------------------------------------------------------------------------------------------


def test_token_counts(docs, rows, empty, clash):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs, path, limit=500).collect())
    want = sorted((str(r[0]), len((r[1] or "").encode()), n := len(m.encode(r[1] or "")), n > 500) for r in rows)
    assert got == want
    assert token_count.count_tokens(empty, path).count() == 0 and token_count.count_tokens(clash, path).count() == len(rows)


def test_token_counts_of_odd_strings():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m, c = sentencepiece.SentencePieceProcessor(model_file=path), token_count.Counter(path, keep=500)
    r = random.Random(0)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "梦", "<s>", "</s>", "<0x0A>", "the", "aaa", "        ", "▁", "😀", "\x00", "ab", "----", "00", "Ａ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["a" * 20000, "ab" * 9000]
    for i in range(0, len(texts), 100):
        assert c.texts(texts[i : i + 100]) == [len(x) for x in m.encode(texts[i : i + 100])]


# --- SimHash -----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, n=3):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows, empty, clash):
    fps = {i: brute_fingerprint(r[1]) for i, r in enumerate(rows)}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    root = brute_components(pairs, fps)
    members = defaultdict(list)
    for i, x in root.items():
        members[x].append(rows[i][0])
    want = Counter((rows[i][0], fps[i], min((m for m in members[root[i]] if m is not None), default=None)) for i in fps)
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop(clash).columns == clash.columns


def test_golay_links_are_all_links(spark):
    r = np.random.RandomState(0)
    base = r.randint(0, 1 << 63, 60, dtype=np.int64).astype(np.uint64)
    fps = [int(b) for b in base]
    for b in base[:40]:
        for _ in range(6):
            x = int(b)
            for bit in r.choice(64, r.randint(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    want = {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    got = [frozenset((e.a % (1 << 64), e.b % (1 << 64))) for e in simhash.links(df).collect()]
    assert set(got) == want and len(got) == len(want)
    g = simhash.Golay()
    x = np.arange(0, 1 << 23, 977)
    code = g.index(x)
    assert len(np.unique(g.error)) == 2048 and code.max() < 4096
    with pytest.raises(ValueError):
        simhash.links(df, 4)


def test_similar_groups(spark):
    r = random.Random(4)
    rows = []
    for i in range(120):
        w = [f"w{r.randint(0, 9999)}" for _ in range(200)]
        rows.append((i, " ".join(w)))
        for j in range(4):  # 1 to 4 words changed: similarities of 0.82 to 0.95
            v = list(w)
            for p in range(j + 1):
                v[20 + 45 * p] = f"z{i}{j}"
            rows.append((1000 + 10 * i + j, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.group_id for x in simhash.similar_groups(df).collect()}
    sets = {i: simhash.shingles(t) for i, t in rows}
    joined = [i for i in got if i >= 1000 and got[i] == (i - 1000) // 10]
    assert all(got[i] == i for i in range(120)) and len(joined) >= 0.9 * 480
    assert all(g == i or g == (i - 1000) // 10 or len(sets[i] & sets[g]) > 0 for i, g in got.items())


def test_alike_is_exact():
    r = random.Random(3)
    hits = 0
    for _ in range(3000):
        a = [r.choice("abcdef") if r.random() < 0.3 else f"w{r.randint(0, 400)}" for _ in range(r.randint(0, 80))]
        b = [f"z{r.randint(0, 9)}" if r.random() < 0.04 else w for w in a][: r.randint(max(0, len(a) - 8), len(a) + 1)]
        n = r.choice((1, 2, 5))
        x, y = simhash.shingles(" ".join(a), n), simhash.shingles(" ".join(b), n)
        want = len(x & y) >= 0.8 * len(x | y)
        hits += want
        assert simhash.alike(" ".join(a), y, n, 0.8) == want
    assert 300 < hits < 2700


def test_shingle_hashes_count_distinct_shingles():
    for text in ("", "one", "a b a b a b a b", "x " * 40, "one two three four five six seven"):
        words = text.encode().split()
        assert [len(h) for h in simhash.shingle_hashes(words, (2, 5))] == [len(simhash.shingles(text, n)) for n in (2, 5)]


def brute_similar(rows):
    sets = {i: simhash.shingles(t or "") for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return brute_components(pairs, sets)


def mixed_texts():
    """Isolated pairs at 0.8 to 0.9, chains by members other than the smallest, a frequent passage, few and no words."""
    r = random.Random(5)
    fresh = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    texts, passage = [None, "", " ", "One word", "one  word", "other"], fresh(40)
    for i in range(150):
        w = fresh(r.randint(30, 120))
        v, gone = list(w), len(w) // 50 + 1
        for k in range(gone):
            v[len(w) * (k + 1) // (gone + 1)] = f"z{i}"
        texts += [" ".join(w), " ".join(v)]
        if i < 20:
            v = list(v)
            v[0], v[-1] = f"x{i}", f"y{i}"
            texts.append(" ".join(v))
    texts += [" ".join(passage + fresh(k)) for k in range(0, 12) for _ in range(4)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows


def test_similar_pairs_are_all_found(spark):
    rows = mixed_texts()
    got = {x.doc_id: x.group_id for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_similar(rows)
    split = [i for i in want if got[i] != got[want[i]]]
    assert not split and len(set(want.values())) < len(rows) - 50


def test_only_similar_texts_are_grouped(spark):
    """A line repeated in different texts sets the fingerprints' bits; it doesn't make the texts similar."""
    r = random.Random(6)
    line = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(9))
    rows = mixed_texts() + [(1000 + i, f"{line} " * 60 + " ".join(f"v{r.randint(0, 10**6)}" for _ in range(50))) for i in range(20)]
    want, least = brute_similar(rows), {}
    for i in sorted(want):
        least.setdefault(want[i], i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.group_id for x in simhash.similar_groups(df).collect()}
    assert got == {i: least[want[i]] for i in want}
    assert {x.doc_id for x in simhash.drop(df).collect()} == set(least.values())


def test_isolated_pairs_just_above_the_threshold(spark):
    """A tenth cut in front and words added at the end: all are found, by whatever words they share."""
    r = random.Random(8)
    rows = []
    for i in range(300):
        w = [f"w{int(10 ** r.uniform(0, 4))}" for _ in range(r.randint(60, 400))]
        v = w[len(w) // 10 :] + [f"z{r.randint(0, 10**6)}" for _ in range(len(w) // 14)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    want = brute_similar(rows)
    got = {x.doc_id: x.group_id for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(want[2 * i] == want[2 * i + 1] for i in range(300)) > 200
    least = {}
    for i in sorted(want):
        least.setdefault(want[i], i)
    assert got == {i: least[want[i]] for i in want}


@pytest.mark.parametrize("copies", [1, 4])
def test_rows_between_tasks_follow_the_shingles(spark, monkeypatch, copies):
    """Texts dealt over ever more buckets aren't listed with each of them: no step makes more rows than texts, or than packed pieces."""
    made, frame = {}, type(spark.range(1))

    def counting(self, func, schema, own=frame.mapInArrow):
        total = made.setdefault((getattr(func, "__qualname__", ""), len(made)), spark.sparkContext.accumulator(0))

        def run(batches):
            for b in func(batches):
                total.add(b.num_rows)
                yield b

        return own(self, run, schema)

    r = random.Random(11)
    rows = []
    for i in range(100 * copies):
        w = [f"w{r.randint(0, 10**6)}" for _ in range(60)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-1], "z"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(simhash, "BUCKET", 256)
    monkeypatch.setattr(frame, "mapInArrow", counting)
    got = {x.doc_id: x.group_id for x in simhash.similar_groups(df).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
    buckets = 1 << (sum(len(t) for _, t in rows) // 6 // 256).bit_length()
    assert made and all(0 < n.value <= max(len(rows), 2 * buckets) for n in made.values()), {k: n.value for k, n in made.items()}


def test_batches_of_any_size_count_alike(spark, monkeypatch):
    """Shingles that occur in one batch only, in several, and in a batch more than once."""
    rows = mixed_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {x.doc_id: x.group_id for x in simhash.similar_groups(df).collect()}
    for flush, bucket in ((1, 1 << 21), (1 << 20, 500)):
        monkeypatch.setattr(simhash, "FLUSH", flush)
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        assert {x.doc_id: x.group_id for x in simhash.similar_groups(df).collect()} == want


@pytest.mark.parametrize("tile", [3, 40, 512])
def test_large_groups_by_tiles(spark, monkeypatch, tile):
    """Copies of one text at 0.4 to 0.95, of several sizes: links are found between all tiles, and no step lists pairs."""
    r, made = random.Random(9), {}
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "save", lambda df, name, own=simhash.save: made.setdefault((name, len(made)), own(df, name)))
    monkeypatch.setattr(simhash, "discard", lambda saved: None)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(140)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in r.sample(range(140), r.randint(1, 9)):
            w[p] = f"z{r.randint(0, 40)}"
        rows.append((i, " ".join(w[: r.choice((140, 125, 110))])))
    want, least = brute_similar(rows), {}
    for i in sorted(want):
        least.setdefault(want[i], i)
    got = {x.doc_id: x.group_id for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: least[want[i]] for i in want} and 1 < len(set(want.values())) < 140
    assert tile < 40 or max(df.count() for df in made.values()) < 150 * 16
    assert simhash.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    order = np.random.RandomState(1).permutation(n).tolist()
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    got = {r.v: r.root for r in simhash.components(edges).collect()}
    assert set(got[i] for i in range(n)) == {0} and got[1001] == 1000


# --- suffix dedup ---------------------------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    count, data = Counter(), [(t or "").encode() for t in texts]
    for b in data:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "held"), [(1024, 4096), (2, 16)])
def test_suffix_dedup(spark, hot, held, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", held)
    r = random.Random(hot)
    vocab = [f"v{i}" for i in range(3000)]
    shared = [" ".join(r.choices(vocab, k=r.randint(30, 120))) for _ in range(8)]
    texts = [None, "", "a" * 900, "ab" * 300, "é" * 400, "abc"]
    for _ in range(70):
        parts = [" ".join(r.choices(vocab, k=r.randint(1, 60))) if r.random() < 0.5 else r.choice(shared)[r.randint(0, 60) :][: r.randint(150, 500)] for _ in range(r.randint(1, 4))]
        texts.append(" ".join(parts))
    texts += texts[20:25] + [texts[30].replace(" v", " z", 1), texts[31] + texts[31]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(df, hot=hot).collect()}
    want = brute_repeats(texts, 200)
    assert [got[i] for i in range(len(texts))] == want


def test_suffix_dedup_edges(docs, rows, empty, clash):
    assert suffix_dedup.remove_repeats(docs).count() == len(rows)
    assert suffix_dedup.remove_repeats(clash).count() == len(rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def brute_maximal(t, least):
    out = set()
    for n in range(least, len(t)):
        where = defaultdict(set)
        for i in range(len(t) - n + 1):
            where[t[i : i + n]].add(i)
        for s, occ in where.items():
            left = {t[i - 1] if i else -1 for i in occ}
            right = {t[i + n] if i + n < len(t) else -1 for i in occ}
            if len(occ) > 1 and (len(left) > 1 or -1 in left) and (len(right) > 1 or -1 in right):
                out.add((s, len(occ)))
    return out


@pytest.mark.parametrize("cuts", [(), (7, 20, 33), tuple(range(1, 57))])
def test_tree_gives_maximal_repeats(cuts):
    """Whole, and in parts whose skeletons give the intervals over their edges."""
    r = random.Random(5)
    for _ in range(30):
        t = bytes(r.choice(b"ab") for _ in range(60))
        least = 4
        leaves = sorted((t[i:], t[i - 1] if i else -1) for i in range(len(t) - least + 1))
        edges = [0, *cuts, len(leaves)]
        rows, skeleton = [], []
        for p, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
            s = [x for x, _ in leaves[a:z]]
            left = np.array([x for _, x in leaves[a:z]])
            made = suffix_dedup.tree(s, s, np.ones(len(s), dtype=int), left, left, least, leaves[a - 1][0] if a else None, leaves[z][0] if z < len(leaves) else None, p)
            rows += [x for x in made if x[0] < 2]
            skeleton += [x for x in made if x[0] == 2]
        if skeleton:
            rows += suffix_dedup._over_edges(least)(suffix_dedup._node_frame(skeleton)).itertuples(index=False, name=None)
        nodes = [x for x in rows if x[0] == 0]
        names = {suffix_dedup.label(s): s for s in {t[i:j] for i in range(60) for j in range(i + least, 61)}}
        assert len({x[1] for x in nodes}) == len(nodes)
        assert {(names[x[1]], x[4]) for x in nodes if x[5] < 0 or x[5] != x[6]} == brute_maximal(t, least)
        for x in nodes:  # a parent is the longest shorter interval of which it is one
            up = [names[y[1]] for y in nodes if y[3] < x[3] and names[x[1]].startswith(names[y[1]])]
            assert (names[x[2]] if x[2] else None) == (max(up, key=len) if up else None)
        for x in (x for x in rows if x[0] == 1):
            deep = [names[y[1]] for y in nodes if x[1].startswith(names[y[1]])]
            assert (names[x[2]] if x[2] else None) == (max(deep, key=len) if deep else None)


# --- packing -------------------------------------------------------------------------------------------------------------------


def test_packing(docs, rows, empty, clash):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    cap = 256
    got = packing.pack_documents(docs, path, capacity=cap).toPandas()
    want = Counter()
    for r in rows:
        ids = [*own.encode(r[1] or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % cap + 1
        cuts = [0, *range(head, len(ids), cap), len(ids)]
        for p, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(str(r[0]), p, a, z - a, zlib.crc32(np.array(ids[a:z], dtype="<u4").tobytes()))] += 1
    ids = [None if x != x else int(x) for x in got.doc_id]
    assert Counter((str(i), p, a, n, c) for i, p, a, n, c in zip(ids, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    total = got.groupby("sequence_id").length.sum()
    assert total.max() <= cap and len(total) <= 1.1 * -(-int(got.length.sum()) // cap) + 2
    assert packing.pack_documents(empty, path).count() == 0
    assert packing.pack_documents(clash, path).count() > len(rows)


@pytest.mark.parametrize("sizes", [[10] * 500, [600] * 7 + [400] * 9 + [24] * 4, [1] * 3000, [1023], [512] * 11, []])
def test_packing_ties_and_small_sizes(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    got = packing.pack(df, 1024).toPandas()
    assert sorted(got.id) == list(range(len(sizes)))
    if sizes:
        total = got.groupby("seq")["size"].sum()
        best = []
        for s in sorted(sizes, reverse=True):
            fit = [i for i, u in enumerate(best) if u + s <= 1024]
            if fit:
                best[max(fit, key=lambda i: best[i])] += s
            else:
                best.append(s)
        assert total.max() <= 1024 and len(total) <= len(best) + 1


def test_sequences_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = [" ".join(words(i, 40 * i + 1)) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = packing.pack_documents(docs, path, capacity=128).persist()
    seqs = {r.sequence_id: r.input_ids for r in packing.sequences(packed, docs, path, capacity=128).collect()}
    back = defaultdict(list)
    for r in packed.orderBy("doc_id", "piece").collect():
        back[r.doc_id] += seqs[r.sequence_id][r.offset : r.offset + r.length]
    assert all(back[i] == [*own.encode(t).ids, 2] for i, t in enumerate(texts))


# --- mixing ------------------------------------------------------------------------------------------------------------------------


def test_targets():
    assert source_mix.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert source_mix.targets([10, 1000], [5, 2]) == pytest.approx([30, 980])
    assert source_mix.targets([0, 0], [1, 1]) == [0, 0] and source_mix.targets([], []) == []


def test_permutations_are_bijections():
    for n in (1, 2, 3, 7, 64, 1000):
        a = source_mix.permute(np.arange(n), n, 5)
        assert sorted(a.tolist()) == list(range(n))
    assert (source_mix.permute(np.arange(1000), 1000, 1) != source_mix.permute(np.arange(1000), 1000, 2)).any()


def test_draws_meet_quotas():
    quota = [1000, 0, 37, 5]
    before, shards = np.zeros(4, dtype=int), Counter()
    for shard in range(-(-sum(quota) // 100)):
        n, begun = source_mix.shard_counts(quota, 100, 0, shard)
        assert (begun == before).all() and (n >= 0).all()
        before = before + n
        shards[shard] = int(n.sum())
    assert before.tolist() == quota and all(v == 100 for v in list(shards.values())[:-1])


def test_mixing(docs, rows, empty, clash):
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = source_mix.taken(docs, block_words=4).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], size(r[1])) for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[r[3]] += size(r[1])
    names = sorted((s for s in by if s is not None)) + [None]
    goal = dict(zip(names, source_mix.targets([by[s] for s in names], [5, 2, 1]), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == by[r.source] and r.target == pytest.approx(goal[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.05 * goal[s] + 12 for s in names)
    again = source_mix.taken(docs.repartition(7), block_words=4).collect()
    assert Counter(again) == Counter(got)
    assert source_mix.taken(empty).count() == 0
    made = source_mix.materialise(clash, block_words=4)
    assert made.columns == clash.columns
    total = Counter()
    for r in made.collect():
        total[r.doc_id] += size(r.text)
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in got:
        want[r.doc_id] += r.taken
    assert +total == +want


# --- toxicity ---------------------------------------------------------------------------------------------------------------------------


def corpus(spark, n=600):
    r = random.Random(1)
    bad = ["vile", "grubworm", "snarlish"]
    rows, labels = [], []
    for i in range(n):
        w = [f"w{r.randint(0, 800)}" for _ in range(r.randint(5, 60))]
        toxic = int(r.random() < 0.3)
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randint(0, len(w)), r.choice(bad) + r.choice(["", "ing", "s"]))
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 1, toxic))
    truth = {i: t for i, t in ((x[0], int(any(b in x[1] for b in bad))) for x in rows)}
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth, rows


def test_toxicity(spark):
    docs, labels, truth, rows = corpus(spark)
    index = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == truth[i] for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert any(r.evidence for r in got.values())
    p = np.clip([got[i].score for i in held], 1e-9, 1 - 1e-9)
    y = np.array([truth[i] for i in held])
    assert -np.mean(np.where(y, np.log(p), np.log(1 - p))) < 0.3
    # The index gives what scoring every example gives.
    dense = np.zeros((len(index.ids), len(index.words)))
    of = np.repeat(np.repeat(np.arange(len(index.words)), np.diff(index.ends)), np.diff(index.cut))
    dense[index.docs, of] = index.weights
    assert set(index.words) >= {w for i, text in rows if i in set(index.ids.tolist()) for w in toxicity.words(text or "")}  # no term is left out
    assert np.allclose(np.linalg.norm(dense, axis=1), 1)
    for (_, text), (_, evidence) in zip(rows[:150], index.scores([x or "" for _, x in rows[:150]]), strict=True):
        ids, q = index.vector(text or "")
        full = dense[:, ids] @ q if len(ids) else np.zeros(len(dense))
        want = sorted(((-round(s, 12), d) for d, s in enumerate(full) if s > 0))[: index.k]
        d, s = index.nearest(ids, q)
        assert [x for _, x in want] == d.tolist() and np.allclose(s, [-x for x, _ in want])
        assert [e["doc_id"] for e in evidence] == index.ids[d].tolist()


def test_terms_and_ranges_by_arrays():
    assert toxicity._numbers({"a": 0, "b": 1}, ["b", "x", "a"]).tolist() == [1, -1, 0] and toxicity._numbers({}, []).tolist() == []
    at, n = toxicity._ranges(np.array([5, 2, 9], np.int32), np.array([7, 2, 12], np.int32))
    assert at.tolist() == [5, 6, 9, 10, 11] and n.tolist() == [2, 0, 3]


def test_toxicity_edges(spark, docs, rows, empty, clash):
    none = spark.createDataFrame([(None, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(docs, none)
    got = toxicity.score(docs, index).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.25}
    assert toxicity.score(empty, index).count() == 0
    assert toxicity.drop_toxic(clash, index).columns == clash.columns
    one = spark.createDataFrame([(i, 1, 1) for i in range(9)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, one)).count() == len(rows)
    assert isinstance(docs.schema, T.StructType)
