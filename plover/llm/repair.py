"""Conversation structure repair by a time-major tensor DP.

Role sequences are to be an optional system turn and then user/assistant pairs.  A row may be kept (0), given the role that fits (1) or deleted (2); an empty row may be
put in anywhere (5).  Blank rows and repeats are always deleted, and a truncated row that stays costs 5 more.  Four states (start, system, user, assistant) know all that matters
of what stands before a row, so costs to go are tensors of (row, conversation, state).

1. *Sort*: rows are range-sorted by conversation, turn and content, so a conversation of any length is spread over as many tasks as its rows need.
2. *Tasks*: runs of a conversation's rows are slices of ``SLICE`` rows at most.  A conversation that lies within one slice is repaired at once: conversations of like length form
   time-major tensors, costs to go are filled from the last row to the first for all of them, and the cheapest edits are traced forwards, ties by the smallest letter.
3. *Long ones*: of a conversation in several slices, a slice's cost matrix (state before, state after) is computed by the same DP; matrices compose, so a pass over a conversation's
   slices, from the last, gives costs to go at every seam, and a second one the state at every seam.  Slices are then traced by themselves, and written in order.
   Repeats are found within slices, and across slices by each slice's distinct contents.

A hash over the repaired conversation is read row after row by its nature, so the slices of a long conversation stream through one task, one at a time; nothing else does.

Defined results: a null in any column counts as one space, in ``conv_id`` as a conversation of its own.  Rows of one turn are in the order of role and text.
A conversation without rows has zeros, an empty audit and the hash of the empty string.  Other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.llm.common import arrow_schema, parts, save

SLICE = 4096
ROWS = 100_000  # rows that a task repairs at a time
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
TO = np.array([USER, USER, ASSISTANT, USER])  # the state after a user's or assistant's turn that fits
FAR = 10**15
LAST = np.array([0, 2 * INSERT, INSERT, 0])  # what each state costs at the end
BLANK, REPEAT, TRUNCATED = 1, 2, 3
INITIALS = {"s": 0, "u": 1, "a": 2}
ROLE = {USER: "user", ASSISTANT: "assistant"}
TAIL = {START: [], SYSTEM: ["user", "assistant"], USER: ["assistant"], ASSISTANT: []}  # the empty turns that end a conversation
LEGAL = ("su", "ua", "au")


# --- the DP ------------------------------------------------------------------------------------------------------------


def moves(initial: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows (any shape) and each state: the state after keeping (-1: none), the cost of keeping, and that of a new role."""
    n = (*initial.shape, 4)
    to = np.full(n, -1)
    to[..., START] = np.where(initial == 0, SYSTEM, np.where(initial == 1, USER, -1))
    to[..., SYSTEM] = to[..., ASSISTANT] = np.where(initial == 1, USER, -1)
    to[..., USER] = np.where(initial == 2, ASSISTANT, -1)
    more = np.where((fault == BLANK) | (fault == REPEAT), FAR, np.where(fault == TRUNCATED, CUT, 0))[..., None]
    return to, np.where(to >= 0, KEEP + more, FAR), np.broadcast_to(REROLE + more, n)


def with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs to go where empty turns may be put in first."""
    out = cost.copy()
    out[..., USER] = np.minimum(cost[..., USER], INSERT + cost[..., ASSISTANT])
    out[..., ASSISTANT] = np.minimum(cost[..., ASSISTANT], INSERT + cost[..., USER])
    for s in (START, SYSTEM):
        out[..., s] = np.minimum(cost[..., s], INSERT + out[..., USER])
    return out


def backward(initial: np.ndarray, fault: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to go ``(T + 1, C, 4)`` of conversations whose rows are columns; initial -1 marks places without a row."""
    t, c = initial.shape
    cost = np.empty((t + 1, c, 4), dtype=np.int64)
    cost[t] = end
    for i in range(t - 1, -1, -1):
        to, keep, rerole = moves(initial[i], fault[i])
        nxt = cost[i + 1]
        best = np.minimum(DELETE + nxt, keep + np.take_along_axis(nxt, np.maximum(to, 0), 1))
        best = with_inserts(np.minimum(best, rerole + nxt[:, TO]))
        cost[i] = np.where((initial[i] < 0)[:, None], nxt, best)
    return cost


def forward(initial: np.ndarray, fault: np.ndarray, cost: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest edits, the smallest letter first: letters ``(C, T, 3)`` (0: none; at most two inserts and the row's own) and the last states."""
    t, c = initial.shape
    letters = np.zeros((c, t, 3), dtype=np.uint8)
    state, each = state.copy(), np.arange(c)
    for i in range(t):
        to, keep, rerole = moves(initial[i], fault[i])
        nxt, here = cost[i + 1], initial[i] >= 0
        todo = here.copy()
        for k in range(3):
            left = cost[i][each, state]
            drop = todo & (DELETE + nxt[each, state] == left)
            letters[drop, i, 2] = ord("D")
            todo &= ~drop
            put = todo & (INSERT + cost[i][each, TO[state]] == left) if k < 2 else np.zeros(c, dtype=bool)
            stay = todo & ~put
            kept = stay & (to[each, state] >= 0) & (keep[each, state] + nxt[each, np.maximum(to[each, state], 0)] == left)
            letters[kept, i, 2] = ord("K")
            letters[stay & ~kept, i, 2] = ord("R")
            state = np.where(kept, to[each, state], np.where(stay | put, TO[state], state))
            letters[put, i, k] = ord("I")
            todo = put
            if not todo.any():
                break
    return letters, state


class Ragged:
    """Conversations (or slices) laid end to end, as time-major tensors by length."""

    def __init__(self, at: np.ndarray, initial: np.ndarray, fault: np.ndarray) -> None:
        self.at, self.initial, self.fault, self.n = at, initial, fault, np.diff(at)
        size = np.where(self.n > 0, np.ceil(np.log2(np.maximum(self.n, 1))), 0).astype(int)
        self.buckets = [np.flatnonzero((size == b) & (self.n > 0)) for b in np.unique(size[self.n > 0])]

    def tensor(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[which]
        t = int(n.max())
        place = np.arange(t)[:, None]
        here = place < n
        row = np.where(here, self.at[which] + place, 0)
        return np.where(here, self.initial[row], -1), np.where(here, self.fault[row], 0)

    def matrices(self) -> np.ndarray:
        """``(slices, 4, 4)``: the cheapest way from the state before a slice to the state after it."""
        out = np.tile(np.where(np.eye(4, dtype=bool), 0, FAR), (len(self.n), 1, 1))
        for which in self.buckets:
            initial, fault = self.tensor(which)
            for s in range(4):
                end = np.full((len(which), 4), FAR, dtype=np.int64)
                end[:, s] = 0
                out[which, :, s] = backward(initial, fault, with_inserts(end))[0]
        return np.minimum(out, FAR)

    def traced(self, end: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Costs, last states, and letters ``(rows, 3)`` of each, from states ``start`` and costs ``end`` at the end."""
        cost, state = end[np.arange(len(self.n)), start].copy(), start.copy()
        letters: list[np.ndarray] = [np.zeros((0, 3), dtype=np.uint8)] * len(self.n)
        for which in self.buckets:
            initial, fault = self.tensor(which)
            togo = backward(initial, fault, end[which])
            cost[which] = togo[0][np.arange(len(which)), start[which]]
            found, state[which] = forward(initial, fault, togo, start[which])
            for j, i in enumerate(which):
                letters[i] = found[j, : self.n[i]]
        return cost, state, letters


def written(letters: np.ndarray, state: int, roles: list[str], texts: list[str]) -> tuple[str, list[str], list[str]]:
    """The edits as letters, and the roles and texts that they leave."""
    flat = letters.ravel()
    kept: tuple[list[str], list[str]] = [], []
    for at in np.flatnonzero(flat).tolist():
        what, row = chr(flat[at]), at // 3
        if what == "D":
            continue
        if what == "K":
            state = SYSTEM if roles[row][:1] == "s" else int(TO[state])
            kept[0].append(roles[row])
        else:
            state = int(TO[state])
            kept[0].append(ROLE[state])
        kept[1].append("" if what == "I" else texts[row])
    return flat[flat > 0].tobytes().decode(), *kept


def as_text(roles: list[str], texts: list[str]) -> str:
    return "\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True))


# --- rows ---------------------------------------------------------------------------------------------------------------


def or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """Rows after damage by ``crc32(conv_id:turn)``: dropped (text null, there for its conversation's sake), emptied, without sentence marks, repeated, or the user's."""
    c = conversations.select(conversations["conv_id"], conversations["turn"], or_space(conversations["role"]).alias("role"), or_space(conversations["text"]).alias("text"))
    c = c.withColumn("kind", F.pmod(F.crc32(F.concat_ws(":", or_space(F.col("conv_id")), or_space(F.col("turn")))), F.lit(kinds)))
    text = F.when(F.col("kind") == 0, F.lit(None)).when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1))))
    return c.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


class Sorted:
    """Rows of one partition, in order; a run of a conversation is a group."""

    def __init__(self, table: pa.Table) -> None:
        self.conv, self.turn, self.role, self.text, fault = (table.column(i).to_pylist() for i in range(5))
        conv = np.array([repr(c) for c in self.conv], dtype=object)
        first = np.append(True, conv[1:] != conv[:-1])
        self.begin = np.append(np.flatnonzero(first), len(conv))
        self.there = np.array([t is not None for t in self.text], dtype=bool)
        again = pd.DataFrame({"g": np.cumsum(first), "r": self.role, "t": self.text})[self.there].duplicated()
        self.fault = np.array(fault, dtype=np.int64)
        at = again.index.to_numpy()[again.to_numpy()]
        self.fault[at] = np.where(self.fault[at] == BLANK, BLANK, REPEAT)
        self.initial = np.array([INITIALS.get(r[:1], 3) for r in self.role], dtype=np.int64)

    def rows(self, i: int) -> np.ndarray:
        """The rows of the i-th run that damage left."""
        span = np.arange(self.begin[i], self.begin[i + 1])
        return span[self.there[span]]


def counts(turns: list, roles: list[str], fault: np.ndarray) -> dict:
    """What is counted over a run of rows."""
    known = [t for t in turns if t is not None]
    illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
    number = {name: int((fault == k).sum()) for name, k in (("blank", BLANK), ("duplicate", REPEAT), ("truncated", TRUNCATED))}
    return number | {"lo": min(known, default=None), "hi": max(known, default=None), "distinct": len(set(known)), "illegal": illegal}


def gaps(lo: int | None, hi: int | None, distinct: int) -> int:
    return hi - lo + 1 - distinct if distinct else 0


COUNTED = "blank long, duplicate long, truncated long, illegal long"
REPORT = f"gaps long, {COUNTED}, cost long, audit string, repaired_sha256 string"


def _first_pass(rows: DataFrame, slice_rows: int, task_rows: int) -> DataFrame:
    """Conversations that lie within a partition, repaired, and slices of the others."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(trimmed == "", F.lit(BLANK)).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), F.lit(TRUNCATED)).otherwise(F.lit(0))
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", F.coalesce(fault, F.lit(0)).cast("int").alias("fault"), F.substring("text", 1, 64).alias("start"), F.md5("text").alias("digest"))
    # The last key divides rows that repeat as a whole; which of equal rows comes first makes no difference.
    order = ["conv_id", "turn", "role", "start", "digest"]
    placed = rows.repartitionByRange(parts(rows), *order, F.rand(17)).sortWithinPartitions(*order).drop("start", "digest")
    schema = f"conv_id {kind}, pos string, whole boolean, {REPORT}, turns array<bigint>, roles array<string>, texts array<string>, faults array<bigint>"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0

        def emit(table: pa.Table, open_first: bool, open_last: bool) -> Iterator[pa.RecordBatch]:
            got = Sorted(table)
            n = len(got.begin) - 1
            edges = ({0} if open_first else set()) | ({n - 1} if open_last else set())
            inner = [i for i in range(n) if i not in edges and got.begin[i + 1] - got.begin[i] <= slice_rows]
            held = [got.rows(i) for i in inner]
            out: list[dict] = []
            if inner:
                flat = np.concatenate(held)
                ragged = Ragged(np.cumsum([0, *map(len, held)]), got.initial[flat], got.fault[flat])
                cost, state, letters = ragged.traced(np.tile(LAST, (len(inner), 1)), np.full(len(inner), START))
                for j, (i, at) in enumerate(zip(inner, held, strict=True)):
                    roles = [got.role[x] for x in at]
                    c = counts([got.turn[x] for x in at], roles, got.fault[at])
                    audit, roles, texts = written(letters[j], START, roles, [got.text[x] for x in at])
                    end = TAIL[int(state[j])]
                    roles, texts = roles + end, texts + [""] * len(end)
                    sha = hashlib.sha256(as_text(roles, texts).encode("utf-8", "surrogatepass")).hexdigest()
                    out.append({"conv_id": got.conv[got.begin[i]], "pos": f"{part:09d}/{done + got.begin[i]:015d}", "whole": True, "gaps": gaps(c.pop("lo"), c.pop("hi"), c.pop("distinct")), **c, "cost": int(cost[j]), "audit": audit + "I" * len(end), "repaired_sha256": sha, "roles": roles, "texts": texts})
                for k in range(0, len(out), 1024):
                    yield pa.RecordBatch.from_pylist(out[k : k + 1024], schema=arrow)
            inside = set(inner)
            for i in (i for i in range(n) if i not in inside):
                span = got.rows(i)
                for a in range(0, max(1, len(span)), slice_rows):
                    at = span[a : a + slice_rows]
                    row = {"conv_id": got.conv[got.begin[i]], "pos": f"{part:09d}/{done + got.begin[i] + a:015d}", "whole": False, "turns": [got.turn[x] for x in at], "roles": [got.role[x] for x in at], "texts": [got.text[x] for x in at], "faults": got.fault[at].tolist()}
                    yield pa.RecordBatch.from_pylist([row], schema=arrow)

        ahead, n, open_first = [], 0, True
        for b in batches:
            ahead.append(b)
            n += b.num_rows
            if n >= task_rows:
                table = pa.Table.from_batches(ahead)
                conv = table.column(0).to_pylist()
                # The last conversation waits for the rest of its rows, unless it is all there is.
                cut = next((i for i in range(n - 1, 0, -1) if conv[i] != conv[i - 1]), n)
                yield from emit(table.slice(0, cut), open_first, cut == n)
                open_first, done = cut == n, done + cut
                ahead, n = (table.slice(cut).to_batches(), n - cut) if cut < n else ([], 0)
        if n:
            yield from emit(pa.Table.from_batches(ahead), open_first, True)

    return placed.mapInArrow(run, schema)


def _per_slice(slices: DataFrame, f, schema: str) -> DataFrame:
    """Rows that ``f`` makes of each slice (a dictionary)."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_pylist([f({k: b.column(j)[i].as_py() for j, k in enumerate(b.schema.names)})], schema=arrow)

    return slices.mapInArrow(run, schema)


def _ragged(row: dict) -> Ragged:
    initial = np.array([INITIALS.get(r[:1], 3) for r in row["roles"]], dtype=np.int64)
    return Ragged(np.array([0, len(initial)]), initial, np.array(row["faults"], dtype=np.int64))


def _long(slices: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The report and the repaired slices of conversations in several slices."""
    slices = slices.select("conv_id", "pos", F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv"), "turns", "roles", "texts", "faults")
    # Repeats across slices: a content has a row a slice.
    digest = F.sha2(F.concat(F.length("r").cast("string"), F.lit(":"), "r", "t"), 256)
    row = F.posexplode(F.arrays_zip(F.col("roles").alias("r"), F.col("texts").alias("t"), F.col("faults").alias("f")))
    each = slices.select("conv", "pos", row.alias("i", "x")).select("conv", "pos", "i", "x.r", "x.t", "x.f").filter(F.col("f").isin(0, TRUNCATED)).select("conv", "pos", "i", digest.alias("digest"))
    first = each.groupBy("conv", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("c")).filter("c > 1").select(F.col("conv").alias("v"), F.col("digest").alias("d"), "first")
    again = each.join(first.hint("merge"), (F.col("conv") == F.col("v")) & (F.col("digest") == F.col("d")) & (F.col("pos") > F.col("first"))).groupBy(F.col("pos").alias("p")).agg(F.collect_list("i").alias("again"))
    fault = F.transform("faults", lambda x, i: F.when(F.array_contains(F.coalesce("again", F.array().cast("array<int>")), i), F.lit(REPEAT)).otherwise(x).cast("bigint"))
    slices = save(slices.join(again, F.col("pos") == F.col("p"), "left").withColumn("faults", fault).drop("again", "p"), "repair-slices")

    def summary(r: dict) -> dict:
        c = counts(r["turns"], r["roles"], np.array(r["faults"]))
        return {k: r[k] for k in ("conv_id", "conv", "pos")} | c | {"head": r["roles"][0][:1] if r["roles"] else None, "end": r["roles"][-1][:1] if r["roles"] else None, "matrix": _ragged(r).matrices().ravel().tolist()}

    known = save(_per_slice(slices, summary, f"conv_id {kind}, conv string, pos string, {COUNTED}, lo bigint, hi bigint, distinct bigint, head string, end string, matrix array<bigint>"), "repair-matrices")

    def seams(pdf: pd.DataFrame) -> pd.DataFrame:
        """Costs to go after each slice."""
        pdf, cost, out = pdf.sort_values("pos"), LAST, []
        for m in pdf["matrix"][::-1]:
            out.append(cost)
            cost = np.minimum((np.asarray(m).reshape(4, 4) + cost).min(1), FAR)
        return pd.DataFrame({"at": pdf["pos"], "after": out[::-1]})

    after = known.select("conv", "pos", "matrix").groupBy("conv").applyInPandas(seams, "at string, after array<bigint>")
    slices = save(slices.join(after, F.col("pos") == F.col("at")).drop("at"), "repair-costs")

    def exits(r: dict) -> dict:
        g = _ragged(r)
        end = np.array([r["after"]])
        return {"conv": r["conv"], "pos": r["pos"], "exits": [int(g.traced(end, np.array([s]))[1][0]) for s in range(4)], "first": r["after"]}

    left = save(_per_slice(slices.select("conv", "pos", "roles", "faults", "after"), exits, "conv string, pos string, exits array<bigint>, first array<bigint>"), "repair-exits")

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, s, out = pdf.sort_values("pos"), START, []
        for e in pdf["exits"]:
            out.append(s)
            s = int(e[s])
        return pd.DataFrame({"at": pdf["pos"], "before": out, "last": [None] * (len(out) - 1) + [s]}).astype({"last": "Int64"})

    before = left.groupBy("conv").applyInPandas(states, "at string, before bigint, last bigint")

    def trace(r: dict) -> dict:
        letters = _ragged(r).traced(np.array([r["after"]]), np.array([r["before"]]))[2][0]
        audit, roles, texts = written(letters, r["before"], r["roles"], r["texts"])
        end = TAIL[r["last"]] if r["last"] is not None else []
        return {k: r[k] for k in ("conv_id", "conv", "pos")} | {"audit": audit + "I" * len(end), "roles": roles + end, "texts": texts + [""] * len(end)}

    made = save(_per_slice(slices.join(before, F.col("pos") == F.col("at")).drop("at"), trace, f"conv_id {kind}, conv string, pos string, audit string, roles array<string>, texts array<string>"), "repair-parts")

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        lo, hi, distinct = pdf["lo"].min(), pdf["hi"].max(), int(pdf["distinct"].sum())
        has = pdf[pdf["distinct"] > 0]
        distinct -= int((has["lo"].to_numpy()[1:] == has["hi"].to_numpy()[:-1]).sum())
        rows = pdf[pdf["head"].notna()]
        seam = sum(a + b not in LEGAL for a, b in zip(rows["end"][:-1], rows["head"][1:], strict=True))
        cost = LAST
        for m in pdf["matrix"][::-1]:
            cost = np.minimum((np.asarray(m).reshape(4, 4) + cost).min(1), FAR)
        out = {c: [int(pdf[c].sum())] for c in ("blank", "duplicate", "truncated")}
        return pd.DataFrame({"c": pdf["conv"].iloc[:1], "gaps": [gaps(int(lo) if distinct else None, int(hi) if distinct else None, distinct)], **out, "illegal": [int(pdf["illegal"].sum()) + seam], "cost": [int(cost[START])]})

    figures = known.drop("conv_id").groupBy("conv").applyInPandas(total, f"c string, gaps long, {COUNTED}, cost long")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes and audits of slices in order."""
        now, conv_id, sha, audit = None, None, None, []

        def end() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": conv_id, "conv": now, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema=arrow)

        for b in batches:
            for i in range(b.num_rows):
                r = {k: b.column(j)[i].as_py() for j, k in enumerate(b.schema.names)}
                if r["conv"] != now:
                    if now is not None:
                        yield end()
                    now, conv_id, sha, audit, any_ = r["conv"], r["conv_id"], hashlib.sha256(), [], False
                text = as_text(r["roles"], r["texts"])
                if r["roles"]:
                    sha.update((("\n" if any_ else "") + text).encode("utf-8", "surrogatepass"))
                    any_ = True
                audit.append(r["audit"])
        if now is not None:
            yield end()

    schema = f"conv_id {kind}, conv string, audit string, repaired_sha256 string"
    arrow = arrow_schema(schema)
    whole = made.repartition(parts(made), "conv").sortWithinPartitions("conv", "pos").mapInArrow(stream, schema)
    return whole.join(figures, F.col("conv") == F.col("c")).drop("conv", "c"), made.select("conv_id", "pos", "roles", "texts")


def repair(rows: DataFrame, slice_rows: int = SLICE, task_rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Repair rows ``conv_id, turn, role, text`` (a null text: no row, but its conversation is reported).

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` and the repaired turns ``conv_id, pos, n, role, text``,
    in the order of ``pos`` and ``n``.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    made = save(_first_pass(rows, slice_rows, task_rows), "repaired")
    names = ["conv_id", *(c.split()[0] for c in REPORT.split(", "))]
    done = made.filter("whole")
    report, turns = done.select(*names), done.select("conv_id", "pos", "roles", "texts")
    open_ = made.filter("NOT whole")
    if open_.limit(1).count():
        long, slices = _long(open_, kind)
        report, turns = report.unionByName(long.select(*names)), turns.unionByName(slices)
    turn = F.posexplode(F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text")))
    return report, turns.select("conv_id", "pos", turn.alias("n", "t")).select("conv_id", "pos", "n", "t.role", "t.text")
