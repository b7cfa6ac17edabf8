"""Cross-tokenizer alignment against a brute-force version, and on awkward tables."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plover.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


def brute(rows, links="end"):
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def spans(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(of(i))))
            at += len(of(i))
        return out, b"".join(map(of, ids))

    made, count = [], Counter()
    for doc, text in rows:
        text = text or ""
        a, raw_a = spans(t.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(char[c] for c in t.id_to_token(i)))
        b, raw_b = spans(sp.encode(text), lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())
        if not text or not raw_a == raw_b == (" " + text).encode():
            made.append((doc, 0, 0, 0, [], ""))
            continue
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        pairs = [(x, y) for x, s, e in a for y, p, q in b if (e == q if links == "end" else s < q and p < e)]
        count.update(pairs)
        groups = ["|".join(",".join(str(i) for i, _, e in side if lo < e <= hi) for side in (a, b)) for lo, hi in zip([0, *cuts], cuts)]
        made.append((doc, len(a), len(b), len(cuts), pairs, ";".join(groups)))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return count, [(d, na, nb, ng, len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p), g and hashlib.sha256(g.encode()).hexdigest(), g) for d, na, nb, ng, p, g in made]


TEXTS = ["The cat sat on the mat.", "the  cat\tsat\n\non", "<|endoftext|> and <s> </s> <unk>", "naïve 漢字 😀 é", None, "", " ", "▁ marked", "a" * 300, "0x1F <0x41> 12,345.67", "The cat sat on the mat.", "ﬁ ligature ①", "x\u0000y", "tail "]


@pytest.mark.parametrize("links", ["end", "overlap"])
@pytest.mark.parametrize("chunk", [1, 40, 10**6])
def test_against_brute_force(spark, links, chunk):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "no id")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out, pairs = align.align(docs, A, B, links=links, chunk=chunk, with_groups=True)
    count, want = brute(rows, links)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups").collect()), key=key) == sorted(want, key=key)
    assert {(r.a_id, r.b_id): r.n for r in pairs.collect()} == count
    assert sum(w[1] > 0 for w in want) >= 10 and sum(w[1] == 0 for w in want) >= 2


def test_whole_table(spark, sf):
    from plover.llm.queries import op13_alignment

    got = {r.doc_id: tuple(r) for r in op13_alignment(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = sorted(rows, key=lambda r: len(r[1] or ""))[:60]
    some = {w[0]: w for w in brute(short)[1]}
    assert len(got) == len(rows)
    assert all(got[i][1:5] == w[1:5] and got[i][7] == w[7] for i, w in some.items())


def test_awkward_tables(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "word " * 200_000)], SCHEMA)
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("chunk", "code", "links", "of", "n", "codes")])
    got = sorted(map(tuple, align.align(clash, A, B)[0].collect()))
    assert got[0] == got[1] and got[2][1] == got[2][4] == 200_001
    assert align.align(spark.createDataFrame([], SCHEMA), A, B)[0].count() == 0
    with pytest.raises(ValueError):
        align.align(docs, A, B, links="other")


@pytest.mark.parametrize("links", ["end", "overlap"])
@pytest.mark.parametrize("known", [0, 9, 40])
def test_pairs_that_tasks_know_and_others(spark, monkeypatch, links, known):
    monkeypatch.setattr(align, "KNOWN", known)
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(0, TEXTS[0]), (None, "no id"), (None, None)]
    out, pairs = align.align(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B, links=links, chunk=40, with_groups=True)
    count, want = brute(rows, links)
    least = align.least_known(pairs)
    often = sum(n >= least for n in count.values())
    assert often <= known and (often > 0) == (known > 0) and often < len(count)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_links_of_frequent_pairs_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], SCHEMA)
    out, pairs = align.align(docs, A, B, chunk=40)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "length(links" in plan  # only documents with links left meet totals by chunk
    kept_as = align.width(A, B)
    made = align.aligned(docs, A, B, chunk=40)
    some = pairs.orderBy("code").limit(10)
    codes = {r.code for r in some.collect()}
    for often, left in ((pairs, lambda c: False), (some, lambda c: c not in codes), (pairs.limit(0), lambda c: True)):
        was = sorted((r.doc_id, [c for c in np.frombuffer(r.links, kept_as).tolist() if left(c)]) for r in made.filter("codes IS NULL").collect())
        assert sorted((r.doc_id, np.frombuffer(r.links, kept_as).tolist()) for r in align.summed(made, often, kept_as).collect()) == was


def test_counts_from_which_pairs_are_known(spark, monkeypatch):
    pairs = spark.createDataFrame([(2**40,), (8,), (7,), (4,), (3,), (1,), (1,)], "n long")
    for known, least in ((0, 1 << 62), (1, 2**40), (2, 8), (3, 8), (4, 4), (5, 2), (6, 2), (7, 1), (100, 1)):
        monkeypatch.setattr(align, "KNOWN", known)
        assert align.least_known(pairs) == least
    assert align.least_known(pairs.limit(0)) == 1 << 62
