"""Cross-tokenizer alignment: token intervals joined by byte offset in DuckDB, pair counts merged in Spark.

1. *Per Arrow partition*: whole texts gather in chunks of some ``CHUNK`` bytes (a longer text is a chunk by itself).  Each is tokenised twice, and DuckDB
   gets a table of token intervals for each tokenizer.  Ends on which both tables agree are the cuts, numbered by a window sum; an ASOF join gives a token that ends elsewhere the first cut
   after its end, which closes its group.  Links are an equi-join of ends, or, for ``links="overlap"``, a range join of intervals within a group.  A chunk's pair
   counts are summed there.
2. *In Spark*: chunks' pair counts are merged by pair, and the highest count of each second id (a row for each id of a vocabulary, so broadcast) marks the best ones.
3. *Back*: totals of the most frequent pairs, ``KNOWN`` at most however many there are, go to all tasks, where documents sum them up and keep their other links.  A chunk asks for
   the totals of those by a join on the pair (a pair has one row a chunk, however frequent it is), and chunks meet their documents that have such links, a bounded group each.

Defined results: a text that is null, empty, or that either tokenizer's bytes don't give back has no tokens: zeros, and an empty groups column.  Special tokens' strings
in a text are plain text.  Rows that repeat are aligned and counted each; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.llm.common import arrow_schema, in_small_batches, save, text_or_empty

CHUNK = 2_000_000
KNOWN = 1 << 17  # pairs whose totals every task gets, 17 bytes each

_sides: dict[str, tuple] = {}  # of this worker


def byte_level(tokenizer: str) -> tuple:
    """``encode, table, lossless``: ids of a text under a byte-level BPE file, all of it plain text; each id's bytes; and whether every text comes back."""
    if tokenizer in _sides:
        return _sides[tokenizer]
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)
    own.encode_special_tokens = True
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab, special = spec["model"]["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
    table = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        table[i] = piece.encode() if piece in special else bytes(char[c] for c in piece)
    pre = spec.get("pre_tokenizer") or {}
    plain = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.int64)
    encode, lossless = plain, False
    if spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        fast = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks={table[i]: i for p, i in vocab.items() if p not in special}, special_tokens={})
        lossless = True

        def encode(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except BaseException as e:  # its panics aren't Exceptions
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
                return plain(text)

    _sides[tokenizer] = encode, table, lossless
    return _sides[tokenizer]


def pieces(model: str) -> tuple:
    """``encode, table`` of a sentencepiece model (ids as a list), which puts a space before the text."""
    if model not in _sides:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        table = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
        _sides[model] = sp.encode, table
    return _sides[model]


def width(tokenizer: str, model: str) -> str:
    """The type of pairs' codes in ``links``."""
    return "<u4" if len(byte_level(tokenizer)[1]) * len(pieces(model)[1]) < 1 << 32 else "<i8"


class Aligner:
    """Aligns chunks of texts; one for each task."""

    def __init__(self, tokenizer: str, model: str, links: str) -> None:
        import duckdb

        self.a, self.b, self.overlap = byte_level(tokenizer), pieces(model), links == "overlap"
        self.size = [np.array([len(t) for t in side[1]], dtype=np.int64) for side in (self.a, self.b)]
        # Ids as text, with the mark that follows one inside its group, then all with the mark after a group's last.
        self.text = [np.array([f"{i}{mark}" for mark in marks for i in range(len(side[1]))], dtype=object) for side, marks in ((self.a, ",|"), (self.b, ",;"))]
        # A pair's code is its first id times the second vocabulary's size, plus its second id.
        self.width = width(tokenizer, model)
        # A chunk's tables are bounded, so nothing need go to a disk.
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, if both give the text's bytes back."""
        if not text:
            return None
        raw = (" " + text).encode("utf-8", "surrogatepass")
        a = self.a[0](" " + text)
        # Byte-level ids of all bytes can't give others of the same number: their pre-tokens are cut from the text itself.
        if int(self.size[0][a].sum()) != len(raw) or not self.a[2] and b"".join(map(self.a[1].__getitem__, a.tolist())) != raw:
            return None
        b = self.b[0](text)
        return (a, np.array(b, dtype=np.int64)) if b"".join(map(self.b[1].__getitem__, b)) == raw else None

    def intervals(self, name: str, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Register ``ids`` as a table of intervals; the offsets run on from text to text."""
        e = np.cumsum(size[ids])
        self.db.register(name, pa.table({"id": ids, "s": e - size[ids], "e": e}))
        return e

    def chunk(self, texts: list[str], with_groups: bool) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Of each text ``n_a, n_b, n_groups, n_links, sha, links, groups``; and the chunk's pair codes and their counts."""
        got = [self.tokens(t) for t in texts]
        at = [i for i, g in enumerate(got) if g]
        out: list[tuple] = [(0, 0, 0, 0, "", b"", "" if with_groups else None)] * len(texts)
        if not at:
            return out, np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = (np.concatenate([got[i][k] for i in at]) for k in (0, 1))
        ends = self.intervals("a", a, self.size[0]), self.intervals("b", b, self.size[1])
        db = self.db
        db.execute("CREATE OR REPLACE TEMP TABLE cuts AS SELECT e, sum(1) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS g, a.id AS x, b.id AS y FROM a JOIN b USING (e)")
        cuts = db.execute("SELECT e, g FROM cuts").fetchnumpy()
        of = np.empty(int(ends[0][-1]) + 1, dtype=np.int64)  # the group of a token that ends at a byte
        of[cuts["e"]] = cuts["g"]
        for t in ("a", "b"):  # tokens that end within a group
            inner = db.execute(f"SELECT t.e, c.g FROM (SELECT e FROM {t} ANTI JOIN cuts USING (e)) t ASOF JOIN cuts c ON t.e <= c.e").fetchnumpy()
            of[inner["e"]] = inner["g"]
        group = [of[e] for e in ends]
        if self.overlap:
            for t, g in zip(("a", "b"), group, strict=True):
                db.register(f"{t}g", pa.table({"g": g}))
            with_g = lambda t: f"(SELECT * FROM {t} POSITIONAL JOIN {t}g)"
            db.execute(f"CREATE OR REPLACE TEMP TABLE pairs AS SELECT greatest(p.s, q.s) AS e, p.id * {len(self.b[1])} + q.id AS c FROM {with_g('a')} p JOIN {with_g('b')} q ON p.g = q.g AND p.s < q.e AND q.s < p.e")
        else:
            db.execute(f"CREATE OR REPLACE TEMP TABLE pairs AS SELECT e - 1 AS e, x * {len(self.b[1])} + y AS c FROM cuts")
        found = db.execute(f"SELECT e, c FROM pairs ORDER BY e{', c' if self.overlap else ''}").fetchnumpy()
        count = db.execute("SELECT c, count(*) AS n FROM pairs GROUP BY c").fetchnumpy()
        # Groups as text: a group's tokens of A, then those of B, each with the mark that follows it.
        n_groups = int(group[0][-1]) + 1
        before = [np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n_groups))]) for g in group]
        shown = np.empty(len(a) + len(b), dtype=object)
        for k, (ids, g) in enumerate(zip((a, b), group, strict=True)):
            last = np.append(g[1:] != g[:-1], True)
            shown[np.arange(len(ids)) + before[1 - k][g + k]] = self.text[k][ids + last * (len(self.text[k]) // 2)]
        n_a, n_b = (np.cumsum([len(got[i][k]) for i in at]) for k in (0, 1))
        stop = ends[0][n_a - 1]
        at_link, at_group = np.searchsorted(found["e"], stop), group[0][n_a - 1] + 1
        past = [np.concatenate([[0], x]) for x in (n_a, n_b, at_group, at_link)]
        for k, i in enumerate(at):
            lo, hi = [int(x[k]) for x in past], [int(x[k + 1]) for x in past]
            text = "".join(shown[lo[0] + lo[1] : hi[0] + hi[1]].tolist())[:-1]
            links = found["c"][lo[3] : hi[3]]
            out[i] = (*(z - y for y, z in zip(lo, hi, strict=True)), hashlib.sha256(text.encode()).hexdigest(), links.astype(self.width).tobytes(), text if with_groups else None)
        for t in ("a", "b", *(("ag", "bg") if self.overlap else ())):
            db.unregister(t)
        return out, count["c"].astype(np.int64), count["n"].astype(np.int64)


def aligned(docs: DataFrame, tokenizer: str, model: str, links: str = "end", with_groups: bool = False, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: ``chunk, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, links``; and a row a chunk with ``codes, counts``."""
    if links not in ("end", "overlap"):
        raise ValueError(f"links are those of ends or of overlaps, not {links!r}")
    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"chunk string, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, groups string, codes array<long>, counts array<long>"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, number = Aligner(tokenizer, model, links), TaskContext.get().partitionId(), 0

        def done(ids: list, texts: list[str]) -> pa.RecordBatch:
            got, codes, counts = own.chunk(texts, with_groups)
            cols = [[f"{part}/{number}"] * (len(ids) + 1), [*ids, None], *([*c, None] for c in zip(*got, strict=True)), [None] * len(ids) + [codes], [None] * len(ids) + [counts]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        ids, texts, size = [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                if ids and size + len(text) > chunk:
                    yield done(ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(b.column(0)[i].as_py())
                texts.append(text)
                size += len(text)
        if ids:
            yield done(ids, texts)

    return rows.mapInArrow(run, schema)


def pair_counts(made: DataFrame, model: str) -> DataFrame:
    """``code, n, a_id, b_id, best``: how many links hold each pair, and whether no pair of its second id has more."""
    size = F.lit(len(pieces(model)[1]))
    each = made.filter("codes IS NOT NULL").select(F.explode(F.arrays_zip("codes", "counts")).alias("t")).select("t.codes", "t.counts")
    total = each.groupBy(F.col("codes").alias("code")).agg(F.sum("counts").alias("n"))
    total = save(total.select("code", "n", F.floor(F.col("code") / size).alias("a_id"), (F.col("code") % size).alias("b_id")), "align-pairs")
    most = total.groupBy(F.col("b_id").alias("b")).agg(F.max("n").alias("most"))
    # A row for each id of the second vocabulary at most.
    return total.join(F.broadcast(most), F.col("b_id") == F.col("b")).select("code", "n", "a_id", "b_id", (F.col("n") == F.col("most")).alias("best"))


def least_known(pairs: DataFrame) -> int:
    """The count from which pairs are frequent: the least power of two that ``KNOWN`` pairs at most reach."""
    sizes = pairs.groupBy(F.length(F.bin("n")).alias("digits")).agg(F.count("*").alias("c")).collect()  # 63 rows at most
    least, known = 1 << 62, 0
    for r in sorted(sizes, reverse=True):
        known += r.c
        if known > KNOWN:
            break
        least = 1 << (r.digits - 1)
    return least


def summed(made: DataFrame, often: DataFrame, kept_as: str) -> DataFrame:
    """Documents with ``n_best`` and ``count_sum`` over their links of the pairs ``often``, and the links left."""
    rows = made.filter("codes IS NULL").drop("codes", "counts")
    found = often.select("code", "n", "best").orderBy("code").toArrow()  # KNOWN rows at most
    known = rows.sparkSession.sparkContext.broadcast([found[c].to_numpy() for c in ("code", "n", "best")])
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"chunk string, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string, links binary"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = (np.append(x, x.dtype.type(end)) for x, end in zip(known.value, (-1, 0, 0), strict=True))  # no pair's code is -1
        for b in batches:
            n_best, total, left = [], [], []
            for raw in b.column("links"):
                links = np.frombuffer(raw.as_buffer(), dtype=kept_as)
                at = np.searchsorted(code[:-1], links)
                hit = code[at] == links
                n_best.append(int(best[at[hit]].sum()))
                total.append(int(n[at[hit]].sum()))
                left.append(links[~hit].tobytes())
            new = {"n_best": n_best, "count_sum": total, "links": left}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else b.column(f.name) for f in arrow], schema=arrow)

    return rows.mapInArrow(run, schema)


def align(docs: DataFrame, tokenizer: str, model: str, links: str = "end", with_groups: bool = False, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` (and ``groups``), and the pair counts."""
    made = save(aligned(docs, tokenizer, model, links, with_groups, chunk, id_col, text_col), "aligned")
    pairs = save(pair_counts(made, model), "align-counts")
    kept_as, least = width(tokenizer, model), least_known(pairs)
    often, rest = pairs.filter(F.col("n") >= least), pairs.filter(F.col("n") < least)
    with in_small_batches(docs.sparkSession):  # of links
        rows = save(summed(made, often, kept_as), "align-summed")
    asked = made.filter("codes IS NOT NULL").select(F.col("chunk").alias("of"), F.explode("codes").alias("asked"))
    asked = asked.join(F.broadcast(often.select(F.col("code").alias("known"))), F.col("asked") == F.col("known"), "left_anti")
    # The planner takes the exploded codes for as few as the chunks.
    told = asked.hint("merge").join(rest, F.col("asked") == F.col("code")).select("of", "code", "n", "best")

    def judge(rows: pa.Table, told: pa.Table) -> pa.Table:
        code = told["code"].to_numpy()
        order = np.argsort(code)
        code, n, best = code[order], told["n"].to_numpy()[order], told["best"].to_numpy()[order]
        n_best, total = rows["n_best"].to_pylist(), rows["count_sum"].to_pylist()
        for i, raw in enumerate(rows["links"]):
            at = np.searchsorted(code, np.frombuffer(raw.as_buffer(), dtype=kept_as))
            n_best[i] += int(best[at].sum())
            total[i] += int(n[at].sum())
        new = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table({c: new.get(c, rows[c]) for c in kept})

    kept = [c for c in rows.columns if c not in ("chunk", "links")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    open_ = F.length("links") > 0
    met = rows.filter(open_).groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(judge, schema)
    out = rows.filter(~open_).select(*kept).union(met)
    return (out if with_groups else out.drop("groups")), pairs
