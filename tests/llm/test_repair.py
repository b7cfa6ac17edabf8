"""Conversation repair against a recursive brute-force version, in one slice and in many, and on awkward tables."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from plover.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
SOME = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        c2, t2, role, text = (" " if v is None else v for v in (c, t, role, text))
        kind = zlib.crc32(f"{c2}:{t2}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute(rows):
    ids = {r[0] for r in rows}
    left = brute_damage(rows)
    out = set()
    for c in ids:
        mine = sorted((r for r in left if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in mine:
            marks = SOME.findall(text)
            faults.append("b" if not marks else "d" if (role, text) in seen else "t" if marks[-1] not in ".!?" else "")
            seen.add((role, text))

        def after(state, initial):
            return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

        @lru_cache(None)
        def best(i, state, inserts):
            found = [(0, "")] if i == len(mine) and state in ("", "a") else []
            step = lambda cost, letter, rest: found.append((cost + rest[0], letter + rest[1])) if rest else None
            if inserts < 3:
                for x in "ua":
                    if after(state, x):
                        step(5, "I", best(i, after(state, x), inserts + 1))
            if i < len(mine):
                step(2, "D", best(i + 1, state, 0))
                if faults[i] not in ("b", "d"):
                    extra = 5 * (faults[i] == "t")
                    if after(state, mine[i][2][:1]):
                        step(extra, "K", best(i + 1, after(state, mine[i][2][:1]), 0))
                    for x in "ua":
                        if after(state, x):
                            step(1 + extra, "R", best(i + 1, after(state, x), 0))
            return min(found, default=None)

        cost, audit = best(0, "", 0)
        lines, state, i = [], "", 0
        for x in audit:
            if x == "K":
                lines.append(f"{mine[i][2]}:{mine[i][3]}")
                state = after(state, mine[i][2][:1])
            elif x in "RI":
                state = "a" if state == "u" else "u"
                lines.append(f"{'user' if state == 'u' else 'assistant'}:{mine[i][3] if x == 'R' else ''}")
            i += x != "I"
        turns = [r[1] for r in mine if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.add((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def conversations(seed, n, longest=9):
    r = random.Random(seed)
    text = lambda: r.choice(["", " \n", "Yes.", "No!", "Why? ", "cut off", "ok", "é漢.", f"w{r.randint(0, 9)}.", None])
    role = lambda t: r.choice(["user", "assistant"][t % 2 : t % 2 + 1] * 5 + ["system", "tool", "", None, "assistant", "User"])
    return [(c, t if r.random() > 0.05 else None, "system" if t == 0 and r.random() < 0.5 else role(t), text() or f"t{t}." if r.random() < 0.6 else text()) for c in range(n) for t in range(r.randint(1, longest))]


@pytest.mark.parametrize("slice_rows,task_rows", [(4096, 100_000), (3, 7), (1, 1)])
def test_against_brute_force(spark, slice_rows, task_rows):
    rows = conversations(slice_rows, 80) + [(900, t, "user", f"u{t % 13}.") for t in range(60)] + [(None, 3, "user", "null id."), (None, 4, "assistant", "answer.")]
    rows += [(901, 1, "user", "same.")] * 9
    report, turns = repair.repair(repair.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3)), slice_rows, task_rows)
    got = {tuple(r) for r in report.collect()}
    want = brute(rows)
    assert got == want
    # The repaired turns give the hashes of the report.
    made = {}
    for r in sorted(turns.collect(), key=lambda r: (str(r.conv_id), r.pos, r.n)):
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(made.get(r[0], [])).encode()).hexdigest() == r[8] for r in got)


def test_tensors_match_slices(spark):
    r = np.random.RandomState(0)
    initial, fault = r.randint(0, 4, 40), r.choice([0, 0, 1, 2, 3], 40)
    whole = repair.Ragged(np.array([0, 40]), initial, fault).traced(repair.LAST[None], np.array([0]))[0][0]
    cost = repair.LAST
    for m in repair.Ragged(np.array([0, 7, 7, 30, 40]), initial, fault).matrices()[::-1]:
        cost = (m + cost).min(1)
    assert cost[0] == whole


def test_whole_table(spark, sf):
    from plover.llm.queries import op11_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in op11_repair(spark, sf).collect()} == brute(rows)


def test_awkward_tables(spark):
    empty = repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA)))
    assert empty[0].count() == empty[1].count() == 0
    rows = [(1, 1, "user", "word " * 100_000 + "."), (1, 2, "assistant", "x.")]
    clash = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("pos", "conv", "kind", "fault", "n", "copy")])
    assert {tuple(r) for r in repair.repair(repair.damaged(clash))[0].collect()} == brute(rows)
    # A conversation whose rows are all dropped.
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert tuple(repair.repair(repair.damaged(spark.createDataFrame([(5, gone, "user", "x")], SCHEMA)))[0].first()) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
