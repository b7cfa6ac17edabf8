"""Chat formatting with tool-call linking.

Messages come as ``conv_id, turn, role, text``.  An assistant's text may hold calls, ``<tool_call>{"id", "name",
"arguments", "after"}</tool_call>``; a message of role ``tool`` holds results, ``<tool_result>{"id", "content"}</tool_result>``.
``after`` lists identifiers of calls whose results a call needs, as do arguments of the form ``{"$result": id}``.

1. *Parse*: every message gives its plain content and its calls and results (by task, from whole texts).
2. *Link*: calls and results meet in a hash join on ``(conv_id, call_id)``.  The first of calls (and of results) that
   repeat an identifier counts; the others are reported.
3. *Order*: a call's level is 1 above the highest level of the calls it depends on.  Calls with one dependency are followed
   by pointer doubling to the first call with none or several, so a chain of n calls takes log n rounds; calls with several
   are then levelled in rounds of joins, one for each level of such calls.  Calls on or behind a cycle get none.
4. *Validate*: arguments against the JSON schema of the call's tool (a subset: type, enum, const, required,
   properties, additionalProperties, items, minimum, maximum, minLength, maxLength, pattern).
5. *Serialise*: one canonical JSON object (sorted keys, no spaces, UTF-8, shortest numbers) per message, one per call.

Conversations are never gathered: a row is a message, so one that holds a third of all rows is as wide as any other.

Defined results: null texts are empty and null roles are ``""``; calls whose JSON doesn't parse stay in the content and
count as malformed; an unknown tool is ``unknown_tool``; messages that repeat are each formatted; rows with a null
conv_id link to nothing; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plover.llm.common import save

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_RESULT = re.compile(r"<tool_result>(.*?)</tool_result>", re.S)
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool}


def canonical(value: Any) -> str:
    """Canonical JSON; numbers that JSON doesn't have become null, whole floats become integers."""

    def plain(v: Any) -> Any:
        if isinstance(v, float):
            return None if not math.isfinite(v) else int(v) if v == int(v) and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def validate(value: Any, schema: Any, at: str = "$") -> list[str]:
    """What is wrong with ``value``, as ``path: reason``."""
    if not isinstance(schema, dict):
        return [] if schema is not False else [f"{at}: not allowed"]
    out: list[str] = []
    kinds = schema.get("type")
    if kinds is not None:
        number = isinstance(value, (int, float)) and not isinstance(value, bool)

        def is_(k: str) -> bool:
            if k == "number":
                return number
            if k == "integer":
                return number and float(value).is_integer()
            return value is None if k == "null" else isinstance(value, _TYPES.get(k, ()))

        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(is_(k) for k in kinds):
            return [f"{at}: not of type {'|'.join(map(str, kinds))}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += validate(value[k], known[k], f"{at}.{k}")
            elif (more := schema.get("additionalProperties", True)) is not True:
                out += [f"{at}.{k}: not expected"] if more is False else validate(value[k], more, f"{at}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += validate(v, schema.get("items", True), f"{at}[{i}]")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
            out.append(f"{at}: range")
    return out


def _needs(value: Any) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return [value["$result"]]
        return [x for v in value.values() for x in _needs(v)]
    return [x for v in value for x in _needs(v)] if isinstance(value, list) else []


def parse(role: str | None, text: str | None) -> tuple[str, list[dict], list[dict], int]:
    """Plain content, calls, results and the number of malformed blocks of a message."""
    role, text, bad = role or "", text or "", 0
    calls: list[dict] = []
    results: list[dict] = []

    def take(m: re.Match) -> str:
        nonlocal bad
        try:
            x = json.loads(m[1])
            if role == "tool":
                results.append({"call_id": str(x["id"]), "content": canonical(x.get("content"))})
            else:
                args = x.get("arguments", {})
                args = json.loads(args) if isinstance(args, str) else args
                needs = dict.fromkeys([*(str(i) for i in x.get("after", [])), *_needs(args)])
                calls.append({"call_id": str(x["id"]), "name": str(x["name"]), "arguments": canonical(args), "needs": list(needs)})
        except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
            bad += 1
            return m[0]
        return ""

    pattern = _RESULT if role == "tool" else _CALL if role == "assistant" else None
    return (pattern.sub(take, text) if pattern else text), calls, results, bad


_PARSED = "conv_id long, turn long, role string, content string, malformed int, calls array<struct<call_id: string, name: string, arguments: string, needs: array<string>>>, results array<struct<call_id: string, content: string>>"


def format_messages(messages: DataFrame, schemas: dict[str, Any] | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages, ``conv_id, turn, role, message, n_calls, n_results, n_malformed``, and calls, ``conv_id, turn, seq, call_id,
    name, level, linked, result_turn, result, status, errors, call``.

    ``schemas`` maps a tool's name to its arguments' schema; it goes to every task and so should be small.  ``level``
    orders a conversation's calls topologically: by ``level, turn, seq``; null on a cycle.
    """
    schemas = schemas or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [parse(r, t) for r, t in zip(pdf["role"], pdf["text"], strict=True)]
            yield pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64"), "turn": pdf["turn"].astype("Int64"), "role": pdf["role"], "content": [x[0] for x in out], "malformed": [x[3] for x in out], "calls": [x[1] for x in out], "results": [x[2] for x in out]})

    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parsed = save(rows.mapInPandas(run, _PARSED), "chat-parsed")
    calls = parsed.select("conv_id", "turn", F.posexplode("calls").alias("seq", "c")).select("conv_id", "turn", "seq", "c.*")
    results = parsed.select("conv_id", "turn", F.posexplode("results").alias("seq", "r")).select("conv_id", "turn", "seq", "r.*")
    w = Window.partitionBy("conv_id", "call_id").orderBy(F.col("turn").asc_nulls_last(), "seq")
    calls = save(calls.withColumn("nth", F.row_number().over(w)), "chat-calls")
    results = results.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("turn").alias("result_turn"), F.col("content").alias("result"))
    linked = calls.join(results, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id")) & (F.col("nth") == 1), "left")
    level = _levels(calls.filter("nth = 1"))
    linked = linked.join(level, (F.col("conv_id") == F.col("l_conv")) & (F.col("call_id") == F.col("l_id")) & (F.col("nth") == 1), "left")

    @F.pandas_udf("array<string>")
    def wrong(name: pd.Series, arguments: pd.Series) -> pd.Series:
        return pd.Series([validate(json.loads(a), schemas[n]) if n in schemas else ["$: unknown tool"] for n, a in zip(name, arguments, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def message(role: pd.Series, content: pd.Series, calls: pd.Series, results: pd.Series) -> pd.Series:
        out = []
        for r, t, cs, rs in zip(role, content, calls, results, strict=True):
            m: dict[str, Any] = {"role": r, "content": t}
            if len(cs):
                m["tool_calls"] = [{"id": c["call_id"], "name": c["name"], "arguments": json.loads(c["arguments"])} for c in cs]
            if len(rs):
                m["tool_results"] = [{"id": x["call_id"], "content": json.loads(x["content"])} for x in rs]
            out.append(canonical(m))
        return pd.Series(out, dtype=object)

    @F.pandas_udf("string")
    def one_call(call_id: pd.Series, name: pd.Series, arguments: pd.Series, result: pd.Series) -> pd.Series:
        return pd.Series([canonical({"id": i, "name": n, "arguments": json.loads(a), "result": json.loads(r) if isinstance(r, str) else None}) for i, n, a, r in zip(call_id, name, arguments, result, strict=True)], dtype=object)

    linked = linked.withColumn("errors", wrong("name", "arguments")).withColumn("linked", F.col("result_turn").isNotNull())
    late = F.col("linked") & (F.col("result_turn") < F.col("turn"))
    status = (
        F.when(F.col("nth") > 1, "repeated_id").when(F.array_contains("errors", "$: unknown tool"), "unknown_tool").when(F.size("errors") > 0, "invalid_arguments")
        .when(F.col("level").isNull(), "cyclic").when(late, "result_before_call").when(~F.col("linked"), "no_result").otherwise("ok")
    )
    call_rows = linked.select("conv_id", "turn", "seq", "call_id", "name", "level", "linked", "result_turn", "result", status.alias("status"), "errors", one_call("call_id", "name", "arguments", "result").alias("call"))
    message_rows = parsed.select("conv_id", "turn", "role", message("role", "content", "calls", "results").alias("message"), F.size("calls").alias("n_calls"), F.size("results").alias("n_results"), F.col("malformed").alias("n_malformed"))
    return message_rows, call_rows


def _levels(calls: DataFrame) -> DataFrame:
    """``l_conv, l_id, level`` of every call not on or behind a cycle; ``calls`` has an identifier once in a conversation."""
    edges = calls.select("conv_id", "call_id", F.explode("needs").alias("need"))
    known = calls.select(F.col("conv_id").alias("n_conv"), F.col("call_id").alias("n_id"))
    edges = edges.join(known, (F.col("conv_id") == F.col("n_conv")) & (F.col("need") == F.col("n_id")), "left_semi").distinct()
    needs = save(edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("need").alias("need")), "chat-needs")
    roots = calls.select("conv_id", "call_id").join(needs.select(F.col("conv_id").alias("e_conv"), F.col("call_id").alias("e_id")), (F.col("conv_id").eqNullSafe(F.col("e_conv"))) & (F.col("call_id") == F.col("e_id")), "left_anti")
    roots = roots.select(F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_id"), F.lit(0).cast("bigint").alias("level"))
    # Calls with one need point at it; pointers double until all lead to calls that have none or several.
    single = needs.filter("n = 1")
    pointers = save(single.select("conv_id", "call_id", F.col("need").alias("to"), F.lit(1).cast("bigint").alias("far")), "chat-pointers")
    for _ in range(single.count().bit_length() + 1):
        ahead = pointers.select(F.col("conv_id").alias("a_conv"), F.col("call_id").alias("a_id"), F.col("to").alias("a_to"), F.col("far").alias("a_far"))
        moved = pointers.join(ahead, (F.col("conv_id") == F.col("a_conv")) & (F.col("to") == F.col("a_id")), "left")
        pointers = save(moved.select("conv_id", "call_id", F.coalesce("a_to", "to").alias("to"), (F.col("far") + F.coalesce("a_far", F.lit(0))).alias("far"), F.col("a_to").isNotNull().alias("open")), "chat-pointers")
        if pointers.filter("open").limit(1).count() == 0:
            break
    ends = pointers.filter("NOT open") if "open" in pointers.columns else pointers  # the rest is on or behind a cycle
    several = needs.filter("n > 1").select(F.col("conv_id").alias("s_conv"), F.col("call_id").alias("s_id"))
    left = edges.join(several, (F.col("conv_id") == F.col("s_conv")) & (F.col("call_id") == F.col("s_id")), "left_semi")
    of = ends.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_id"), "to", "far")
    left = left.join(of, (F.col("conv_id") == F.col("p_conv")) & (F.col("need") == F.col("p_id")), "left")
    left = save(left.select("conv_id", "call_id", F.coalesce("to", "need").alias("need"), (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.lit(None).cast("bigint").alias("known")), "chat-edges")
    front, found = roots, [roots]
    while left.limit(1).count():
        met = front.select(F.col("l_conv").alias("f_conv"), F.col("l_id").alias("f_id"), F.col("level").alias("f_level"))
        left = left.join(met, (F.col("conv_id") == F.col("f_conv")) & (F.col("need") == F.col("f_id")), "left").select("conv_id", "call_id", "need", "far", F.coalesce("known", F.col("f_level") + F.col("far")).alias("known"))
        left = save(left, "chat-edges")
        done = left.groupBy(F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_id")).agg(F.max("known").alias("level"), F.count_if(F.col("known").isNull()).alias("waits"))
        front = save(done.filter("waits = 0").drop("waits"), "chat-level")
        if front.limit(1).count() == 0:
            break  # what is left waits for itself
        found.append(front)
        left = save(left.join(front, (F.col("conv_id") == F.col("l_conv")) & (F.col("call_id") == F.col("l_id")), "left_anti"), "chat-edges")
    anchors = found[0]
    for more in found[1:]:
        anchors = anchors.unionByName(more)
    anchors = save(anchors, "chat-anchors")
    led = ends.join(anchors, (F.col("conv_id") == F.col("l_conv")) & (F.col("to") == F.col("l_id"))).select("conv_id", "call_id", (F.col("level") + F.col("far")).alias("level"))
    return anchors.unionByName(led.toDF("l_conv", "l_id", "level"))
