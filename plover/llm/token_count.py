"""Token counts by rank-synchronous array merging.

A SentencePiece BPE model's vocabulary becomes a sorted table of mergeable symbol pairs with their ranks.  Texts are cut
into pre-tokens (a run of word marks and what follows; nothing merges across those borders, which is checked against
the vocabulary), and the pre-tokens not seen before are merged together as one ragged array: in each round every
sequence applies its lowest-rank pair, and the symbols that survive are counted.

A round applies all of a sequence's occurrences of its lowest-rank pair (left to right, without overlap) where that
provably equals one-at-a-time merging, i.e. no pair that arises ranks as low; else the leftmost only.

Counts of pre-tokens are kept in a table of bounded size in each worker.

Defined results: a null text is empty and has 0 tokens; control symbols in texts are ordinary text; repeated rows are
each counted; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.llm.common import text_or_empty

MARK = "▁"  # stands for a space
NONE = np.iinfo(np.int32).max


class PairTable:
    """Symbols and mergeable pairs of a model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        n = m.get_piece_size()
        if not any(m.is_byte(i) for i in range(n)) or any(m.is_unused(i) for i in range(n)):
            raise ValueError("a BPE model with byte fallback and without unused pieces is asked for")
        pieces = {m.id_to_piece(i): m.get_score(i) for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        rank = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        symbols = dict.fromkeys([*pieces, *(c for p in pieces for c in p)])
        self.ids = {s: i for i, s in enumerate(symbols)}
        self.size = len(self.ids) + 1  # the last stands for any other character
        self.known = np.array([s in pieces for s in symbols])
        self.chars = {s: i for s, i in self.ids.items() if len(s) == 1}
        keys, ranks, made = [], [], []
        for p, score in pieces.items():
            for i in range(1, len(p)):
                if p[:i] in self.ids and p[i:] in self.ids:
                    keys.append(self.ids[p[:i]] * self.size + self.ids[p[i:]])
                    ranks.append(rank[score])
                    made.append(self.ids[p])
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = (np.array(x)[order] for x in (keys, np.array(ranks, np.int32), made))
        multi = [p for p in pieces if len(p) > 1]
        alone = "\n" if not any("\n" in p for p in multi) else ""
        if any(MARK in p.lstrip(MARK) for p in multi):
            self.cut = re.compile(r"(?s).+")
        else:
            self.cut = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + ("|\n" if alone else ""))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or NONE) and product of each pair."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def count(self, tokens: list[str]) -> np.ndarray:
        """The number of tokens of each (non-empty) pre-token."""
        out = np.zeros(len(tokens), dtype=np.int64)
        lengths = np.array([len(t) for t in tokens])
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(np.frexp(lengths[order])[1])) + 1
        for at in np.split(order, cuts):  # sequences of like length together
            for i in range(0, len(at), 20_000):
                self._merge(tokens, at[i : i + 20_000], out)
        return out

    def _merge(self, tokens: list[str], which: np.ndarray, out: np.ndarray) -> None:
        joined = "".join([tokens[i] for i in which])
        other = self.size - 1
        sym = np.fromiter((self.chars.get(c, other) for c in joined), dtype=np.int64, count=len(joined))
        known = np.append(self.known, False)
        lone = np.flatnonzero(~known[sym])
        weight = np.ones(len(sym), dtype=np.int64)
        weight[lone] = [len(joined[i].encode("utf-8", "surrogatepass")) for i in lone]
        seq = np.repeat(np.arange(len(which)), [len(tokens[i]) for i in which])
        while len(sym):
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            last = np.append(starts[1:], len(sym)) - 1
            rank, made = np.full(len(sym), NONE, dtype=np.int64), np.zeros(len(sym), dtype=np.int64)
            if len(sym) > 1:
                rank[:-1], made[:-1] = self.pairs(sym[:-1], sym[1:])
            rank[last] = NONE
            low = np.minimum.reduceat(rank, starts)
            n = np.diff(np.append(starts, len(sym)))
            live = low < NONE
            if not live.all():  # count what can't merge any more, and go on with the rest
                stay = np.repeat(live, n)
                gone = ~stay
                np.add.at(out, which[seq[gone]], weight[gone])
                sym, seq, weight, rank, made = (x[stay] for x in (sym, seq, weight, rank, made))
                low, n = low[live], n[live]
                if not len(sym):
                    break
                starts = np.append(0, np.cumsum(n)[:-1])
            group = np.repeat(np.arange(len(n)), n)
            hit = np.flatnonzero(rank == low[group])
            # Alternate members of a run of overlapping occurrences.
            run = np.append(True, np.diff(hit) != 1)
            place = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            take = hit[place % 2 == 0]
            g = group[take]
            first = np.append(True, g[1:] != g[:-1])
            if not first.all():
                lead = take[np.flatnonzero(first)[np.cumsum(first) - 1]]
                bad = made[take] != made[lead]
                # Pairs that arise: with the left neighbour as it is by then, and with the right one as it is now.
                m = made[take]
                left = sym[np.maximum(take - 1, 0)]
                prior = np.append(-2, take[:-1]) + 2 == take
                left = np.where(prior, np.append(0, m[:-1]), left)
                has_left = take > starts[g]
                bad |= has_left & (self.pairs(left, m)[0] <= low[g])
                has_right = take + 2 < starts[g] + n[g]
                bad |= has_right & (self.pairs(m, sym[np.minimum(take + 2, len(sym) - 1)])[0] <= low[g])
                bad_group = np.zeros(len(n), dtype=bool)
                bad_group[g[bad]] = True
                take = take[first | ~bad_group[g]]
            sym = sym.copy()
            sym[take] = made[take]
            weight[take] = 1
            stay = np.ones(len(sym), dtype=bool)
            stay[take + 1] = False
            sym, seq, weight = sym[stay], seq[stay], weight[stay]


class Counter:
    """Counts tokens of texts; knows the counts of pre-tokens it has met, up to ``keep``."""

    def __init__(self, path: str, keep: int = 400_000) -> None:
        self.table, self.keep, self.met = PairTable(path), keep, {}

    def texts(self, texts: list[str]) -> list[int]:
        normal = self.table.model.normalize
        cut, met = self.table.cut.findall, self.met
        pieces = [cut(normal(t)) if t else [] for t in texts]
        new = list({p for x in pieces for p in x if p not in met})
        if new:
            if len(met) + len(new) > self.keep:
                met.clear()
                new = list({p for x in pieces for p in x})
            met.update(zip(new, self.table.count(new).tolist(), strict=True))
        return [sum(map(met.__getitem__, x)) for x in pieces]


_counters: dict[str, Counter] = {}  # of this worker


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.  ``model``: the model file's path, on every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counters:
            _counters[model] = Counter(model)
        counter = _counters[model]
        for b in batches:
            texts = b.column(1)
            sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64, count=texts.offset + len(texts) + 1)[texts.offset :])
            n, i, ends = [], 0, np.cumsum(sizes)
            while i < len(sizes):  # a few MB at a time
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (4 << 20), side="right")))
                n += counter.texts(texts.slice(i, j - i).to_pylist())
                i = j
            tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), tokens, pa.array(np.array(n, dtype=np.int64) > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
