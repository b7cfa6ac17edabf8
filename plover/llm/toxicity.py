"""Toxicity by nearest labelled examples: exact TF-IDF cosine, block-max inverted indexes, distance-weighted votes.

Learning uses labelled rows outside the held-out fold, at most ``MAX_TRAIN`` of them (the smallest hashes of text ids):
this is the documented bound of the sample, and of all that is collected and broadcast.

* *Terms* are all lower-cased words of the sampled texts.  None is left out.
* *Vectors* are ``(1 + ln tf) * idf * contrast``, of unit length.  ``idf`` counts the rows of the whole table that hold the
  term.  ``contrast`` is how far the term's odds differ between toxic and other examples, ``(|z| / (|z| + 4)) ** 6`` plus
  ``FLOOR``, where z is the log odds ratio by its standard error: a term that tells nothing counts little, but counts.
* The *index* holds the examples' postings by term, cut into blocks of ``BLOCK`` examples, with each term's largest weight in
  each block; terms of over ``1 / FREQUENT`` of the examples are kept as whole rows, which a batch of texts multiplies at
  once.  A text's products with those rows bound the k-th cosine from below; blocks whose upper bound, the largest such
  product plus ``sum of query weight * block maximum``, reaches it are scored by their postings.  The result is exactly that
  of scoring every example by all terms.
* *Votes*: a neighbour at cosine c weighs ``1 / (1.05 - c)``; the weighted share of toxic ones, with the base rate as one
  more vote, is calibrated by a logistic curve fitted to leave-one-out votes of the first ``CALIBRATE`` examples.  A text that
  shares no term with an example gets the base rate.  The neighbours are returned as evidence.

Scores depend on the text alone.  Whole texts are read.

Defined results: null and empty texts have no terms, and the base rate; labels that are null or whose document is missing
teach nothing; without labels scores are 0.25; ties in similarity go to the lower example number; repeated rows are
each scored; extra columns pass through ``drop_toxic``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.llm.common import text_or_empty

MAX_TRAIN = 8_000
CALIBRATE = 2_000
NEIGHBOURS = 8
BLOCK = 64
FLOOR = 0.002
FREQUENT = 20
BATCH = 64  # texts multiplied at once
FOLDS = 5
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds == 0


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and how many each range has."""
    n = (end - begin).astype(np.int64)
    after = np.cumsum(n)
    at = np.repeat(begin - after + n, n)
    at += np.arange(len(at))
    return at, n


def _numbers(known: dict[str, int], terms: Collection[str]) -> np.ndarray:
    """The terms' numbers, -1 for those that have none."""
    return np.fromiter(map(known.get, terms, repeat(-1)), np.int64, len(terms))


class Index:
    """Block-max inverted index over labelled examples, with its votes and their calibration."""

    def __init__(self, vocabulary: list[str], df: np.ndarray, n_rows: int, ids: np.ndarray, labels: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, k: int = NEIGHBOURS, calibrate: int = CALIBRATE) -> None:
        """df: rows of the table (of ``n_rows``) with each term; owner, term, tf: each example's terms and their counts."""
        self.words, self.k, self.known = vocabulary, k, None
        self.ids, self.labels = ids.astype(np.int64), labels.astype(np.float64)
        n, toxic = len(ids), float(labels.sum())
        self.prior = (toxic + 0.5) / (n + 2)
        n1 = np.bincount(term, weights=self.labels[owner], minlength=len(vocabulary))
        n0 = np.bincount(term, minlength=len(vocabulary)) - n1
        a, b, c, d = n1 + 0.5, toxic - n1 + 0.5, n0 + 0.5, n - toxic - n0 + 0.5
        z = np.abs(np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        self.weight = (1 + np.log((1 + n_rows) / (1 + np.maximum(df, n0 + n1)))) * ((z / (z + 4)) ** 6 + FLOOR)
        del n0, n1, a, b, c, d, z
        w = np.log(tf)
        w += 1
        w *= self.weight[term]
        norm = np.sqrt(np.bincount(owner, weights=w * w, minlength=n))
        w /= np.maximum(norm, 1e-300)[owner]
        # Examples whose weightiest terms are the same share blocks.
        top, most = np.full(n, len(vocabulary)), np.zeros(n)
        np.maximum.at(most, owner, w)
        lead = w == most[owner]
        np.minimum.at(top, owner[lead], term[lead])
        place = np.empty(n, dtype=np.int32)
        place[np.lexsort((self.ids, top))] = np.arange(n)
        self.ids, self.labels = self.ids[np.argsort(place)], self.labels[np.argsort(place)]
        self.n_blocks = -(-n // BLOCK)
        order = np.lexsort((place[owner], term))
        self.docs, self.weights, term = place[owner[order]], w[order], term[order]
        del owner, w, order
        of = self.docs // BLOCK
        cut = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(of) != 0)))[: len(term)]  # where each (term, block) begins
        self.weights = self.weights.astype(np.float32)
        self.cut = np.append(cut, len(term)).astype(np.int32)
        self.block = of[cut]
        self.most = np.maximum.reduceat(self.weights, cut) if len(cut) else np.empty(0, np.float32)
        self.ends = np.searchsorted(term[cut], np.arange(len(vocabulary) + 1)).astype(np.int32)
        n_terms = np.bincount(term, minlength=len(vocabulary))
        often = np.flatnonzero(n_terms > n / FREQUENT)  # fewer than FREQUENT * the mean length of an example
        self.row = np.full(len(vocabulary), -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.n_blocks * BLOCK))
        held = self.row[term] >= 0
        self.rows[self.row[term[held]], self.docs[held]] = self.weights[held]
        self.curve = (1.0, 0.0)
        own = np.argsort(self.docs, kind="stable")  # examples' vectors, from the postings
        edge = np.searchsorted(self.docs[own], np.arange(n + 1))
        self.curve = self._calibrate((i, term[own[edge[i] : edge[i + 1]]], self.weights[own[edge[i] : edge[i + 1]]]) for i in place[:calibrate].tolist() if edge[i] < edge[i + 1])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text; words that no example has would only scale its cosines alike."""
        if self.known is None:
            self.known = {t: i for i, t in enumerate(self.words)}
        counts = Counter(words(text))
        t, n = _numbers(self.known, counts), np.fromiter(counts.values(), np.int64, len(counts))
        t, n = t[t >= 0], n[t >= 0]
        if not len(t):
            return np.empty(0, np.int64), np.empty(0)
        w = (1 + np.log(n)) * self.weight[t]
        return t, w / math.sqrt(float(w @ w))

    def products(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Each vector's product with every example, by the frequent terms."""
        q = np.zeros((len(vectors), len(self.rows)))
        for i, (t, w) in enumerate(vectors):
            at = self.row[t]
            q[i, at[at >= 0]] = w[at >= 0]
        return q @ self.rows

    def nearest(self, t: np.ndarray, q: np.ndarray, skip: int = -1, product: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples that share a term."""
        s = (self.products([(t, q)])[0] if product is None else product).copy()
        if skip >= 0:
            s[skip] = 0
        rare = self.row[t] < 0
        t, q = t[rare], q[rare]
        at, n = _ranges(self.ends[t], self.ends[t + 1])
        block, of = self.block[at], np.repeat(q, n)
        bound = s.reshape(-1, BLOCK).max(1) + np.bincount(block, weights=of * self.most[at], minlength=self.n_blocks)
        kth = np.partition(s, len(s) - self.k)[len(s) - self.k] if len(s) >= self.k else 0.0
        use = np.flatnonzero((bound >= kth - 1e-12)[block])
        pair = at[use]
        post, n = _ranges(self.cut[pair], self.cut[pair + 1])
        s += np.bincount(self.docs[post], weights=np.repeat(of[use], n) * self.weights[post], minlength=len(s))
        if skip >= 0:
            s[skip] = 0
        kth = np.partition(s, len(s) - self.k)[len(s) - self.k] if len(s) >= self.k else 0.0
        d = np.flatnonzero((s > 0) & (s >= kth - 1e-9))
        d = d[np.lexsort((d, -np.round(s[d], 12)))[: self.k]]
        return d, s[d]

    def vote(self, d: np.ndarray, s: np.ndarray) -> float:
        w = 1 / (1.05 - np.minimum(s, 1.0))
        return float((w @ self.labels[d] + self.prior) / (w.sum() + 1))

    def _calibrate(self, vectors: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[float, float]:
        """Slope and offset on the votes' log odds, by Newton steps with a weak pull towards (1, 0)."""
        got = [(self.vote(*self.nearest(t, q, skip=i)), self.labels[i]) for i, t, q in vectors]
        if len(got) < 20:
            return 1.0, 0.0
        v, y = np.array(got).T
        x = np.log(v / (1 - v))
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([(p - y) @ x + (a - 1), (p - y).sum() + b])
            h = p * (1 - p)
            m = np.array([[h @ (x * x) + 1, h @ x], [h @ x, h.sum() + 1]])
            da, db = np.linalg.solve(m, g)
            a, b = a - da, b - db
        return (float(a), float(b)) if a > 0 and np.isfinite([a, b]).all() else (1.0, 0.0)

    def scores(self, texts: list[str]) -> Iterator[tuple[float, list[dict]]]:
        """Score and evidence of each text."""
        for i in range(0, len(texts), BATCH):
            vectors = [self.vector(t) for t in texts[i : i + BATCH]]
            for (t, q), product in zip(vectors, self.products(vectors), strict=True):
                d, s = self.nearest(t, q, product=product)
                v = self.vote(d, s)
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] * math.log(v / (1 - v)) + self.curve[1])))) if len(d) else self.prior
                yield p, [{"doc_id": int(self.ids[j]), "cosine": float(c), "toxic": int(self.labels[j])} for j, c in zip(d, s, strict=True)]

    def score(self, text: str) -> tuple[float, list[dict]]:
        return next(self.scores([text]))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text", calibrate: int = CALIBRATE) -> Index:
    """The index of the labelled rows outside the held-out fold; ``max_train`` of them at most, ``calibrate`` for the curve."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).filter(~held_out(F.col(id_col), folds)).select(F.col(id_col).cast("bigint").alias("l_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("l_id"), "l_id", "toxic").limit(max_train)
    spark = docs.sparkSession
    got = known.collect()  # bounded by max_train
    # As an Arrow table: rows from a list would start Python workers on the executors that stay for the whole run.
    known = spark.createDataFrame(pa.table({"l_id": pa.array([r[0] for r in got], pa.int64()), "toxic": pa.array([r[1] for r in got], pa.int32())}))
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), text_or_empty(docs[text_col]).alias("text"))
    sample = rows.join(F.broadcast(known), F.col("id") == F.col("l_id")).select("id", "toxic", F.xxhash64("text").alias("h"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [Counter(words(t.as_py())) for t in b.column(3)]
            terms, tf = pa.array([list(c.keys()) for c in made], pa.list_(pa.string())), pa.array([list(c.values()) for c in made], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), terms, tf], ["id", "toxic", "h", "terms", "tf"])

    got = sample.mapInArrow(count, "id long, toxic int, h long, terms array<string>, tf array<int>").toArrow().sort_by([("h", "ascending"), ("id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    terms = got["terms"].combine_chunks()
    owner = np.repeat(np.arange(len(terms), dtype=np.int32), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    words_ = terms.flatten().dictionary_encode()
    vocabulary, coded = words_.dictionary.to_pylist(), words_.indices.to_numpy()
    ids, toxic, tf = got["id"].to_numpy(), (got["toxic"].to_numpy() > 0).astype(np.int64), got["tf"].combine_chunks().flatten().to_numpy()
    del got, terms, words_
    shared = spark.sparkContext.broadcast(vocabulary)  # bounded by the sample

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {t: i for i, t in enumerate(shared.value)}
        held, n = np.zeros(len(ids) + 1, dtype=np.int64), 0  # the last counts for terms that the sample doesn't have
        for b in batches:
            n += b.num_rows
            for t in b.column(0):
                held[_numbers(ids, set(words(t.as_py())))] += 1
        at = np.flatnonzero(held[:-1])
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(held[part])], ["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n], pa.int64())], ["term", "n"])

    held = rows.select("text").mapInArrow(hold, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = held["term"].to_numpy(), held["n"].to_numpy()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return Index(vocabulary, df, int(n[term < 0].sum()), ids, toxic, owner, coded, tf, calibrate=calibrate)


EVIDENCE = "array<struct<doc_id: long, cosine: double, toxic: int>>"


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, evidence`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by MAX_TRAIN texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for b in batches:
            out = list(own.scores(b.column(1).to_pylist()))
            p = pa.array([x for x, _ in out], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), p, pa.array([int(x >= 0.5) for x, _ in out], pa.int32()), pa.array([e for _, e in out], kind)], ["doc_id", "score", "predicted", "evidence"])

    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int, evidence {EVIDENCE}")


def drop_toxic(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """The rows whose predicted label is 0, with the columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([p < 0.5 for p, _ in own.scores([t or "" for t in texts])])

    return docs.filter(clean(docs[text_col]))
