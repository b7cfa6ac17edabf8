"""Search, URL, chat and pipeline operators against brute force, and on awkward tables."""

import json
import re
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plover.llm import chat_format, simhash, topk, toxicity, url_filter

# --- exact top-k -----------------------------------------------------------------------------------------------


def brute_top(rows, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % 100 == 0:
            s = sorted(((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in good if j != i and len(c) == len(q)))[:k]
            out |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(s)}
    return out


def test_top_k(spark):
    r = random.Random(2)
    rows = [(i, [round(r.gauss(0, 0.3), 3) for _ in range(6)]) for i in range(250)]
    rows += [(i, [0.5, 0.25, 0.0, -0.5, 0.1, 0.2]) for i in range(250, 330)]  # copies: ties beyond k
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (500, [float("inf")] * 6), (None, [0.1] * 6), (600, [0.5, 0.5]), (601, [0.1, 0.2]), (700, []), (800, [300.0] * 6), (900, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for k in (1, 10):
        got = {(x.query_id, x.rank, x.vec_id, x.score) for x in topk.search(df, F.col("vec_id") % 100 == 0, k).collect()}
        assert got == brute_top(rows, k)
    small = df.filter("vec_id IN (0, 1, 2)")
    assert topk.search(small, F.col("vec_id") % 100 == 0, 10).count() == 2


def test_top_k_edges(spark, monkeypatch):
    df = spark.createDataFrame([(i, [i / 300, 1.0]) for i in range(301)], "vec_id long, embedding array<float>").select("*", *[F.lit(1).alias(c) for c in ("id", "v", "q", "score", "rank")])
    whole = {tuple(x) for x in topk.search(df, F.col("vec_id") % 100 == 0, 3).collect()}
    monkeypatch.setattr(topk, "BLOCK_VALUES", 8)  # two queries a block
    assert {tuple(x) for x in topk.search(df, F.col("vec_id") % 100 == 0, 3).collect()} == whole and len(whole) == 12
    big = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e17, 0.0]), (2, [1.0, 1.0]), (3, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    found = [(r.vec_id, r.score) for r in topk.search(big, F.col("vec_id") == 0, 3).orderBy("rank").collect()]
    assert [i for i, _ in found] == [1, 2, 3] and found[0][1] == topk.MOST and found[2][1] == -topk.MOST  # saturated, not an error
    assert topk.search(df.filter("vec_id < 0"), F.col("vec_id") % 100 == 0, 3).count() == 0


# --- URL filter --------------------------------------------------------------------------------------------------------


def brute_url(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    bare = rest[:end]
    cut = bare.find("/") if "/" in bare else len(bare)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in bare[:cut])
    path = bare[cut:]
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URLS = ["http://a.example.org/es/1", "HTTPS://EXAMPLE.org/en/12?x=/y", "http://x.org", "http://x.org/", "http://notexample.org/es/2", "ftp://b.com/de/#a", "http://b.com/de", "c.com/de/", None, "", "://", "http://?q", "http://É.com/fr/é", "http://com/fr/", "http://a.b.c.d.e.example.org/en/1", "http://a.com/fr/de/", "x://y://z.com/de/\nq", "http://u@h.com:80/de/x", "http://.com/fr/", "http://com./fr/"]


@pytest.mark.parametrize("rows,blocks", [(50_000, 1 << 14), (0, 64)])
def test_url_filter(spark, rows, blocks):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, html string").select("*", *[F.lit("z").alias(c) for c in ("key", "host", "path", "rule", "uid", "hit", "n")])
    rules = spark.createDataFrame([*RULES, ("org", None, "block"), (None, "/", "block"), ("net", "/", None), ("com", "/de/", "block")], "host string, path string, verdict string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules, broadcast_rows=rows, blocks=blocks).collect())
    assert got == Counter((i, *brute_url(u, RULES)) for i, u in enumerate(URLS + URLS[:3]))
    kept = url_filter.keep_allowed(pages, rules)
    assert kept.columns == pages.columns and kept.count() == sum(brute_url(u, RULES)[3] == "allow" for u in URLS + URLS[:3])


def test_url_filter_edges(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/"), (None, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.url_filter(pages, rules).collect()} == {"allow"}
    assert url_filter.url_filter(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


def test_url_filter_drops_failing_candidates_before_the_shuffle(spark):
    """A listing over the broadcast bound and mostly unlisted pages: a row a page, and the keys that pass, go on."""
    rules = spark.range(3000).select(F.format_string("s%d.example.net", "id").alias("host"), F.format_string("/p%d/", F.col("id") % 7).alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 20 == 0, F.format_string("http://a.s%d.example.net/p%d/q/r/s", "id", F.col("id") % 7)).otherwise(F.format_string("http://x%d.a.b.c.other.org/long/path/of/%d", "id", "id")).alias("url"))
    out = url_filter.url_filter(pages, rules, broadcast_rows=0)
    plan = out._jdf.queryExecution().optimizedPlan()
    got = {r.page_id: r.verdict for r in out.collect()}
    assert got == {i: "block" if i % 20 == 0 else "allow" for i in range(2000)}
    tree = plan.toString()
    above = tree[tree.index("Join LeftOuter") : tree.index("Generate posexplode")]
    assert re.search(r"^[ :+-]*Filter .*\bat#", above, re.M), above


# --- chat --------------------------------------------------------------------------------------------------------------------


def call(i, name="search", args=None, **kw):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": args if args is not None else {"query": "x"}} | kw) + "</tool_call>"


def result(i, content):
    return "<tool_result>" + json.dumps({"id": i, "content": content}) + "</tool_result>"


TOOLS = {"search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False}}
SCHEMA = "conv_id long, turn long, role string, text string"


def test_chat_linking(spark):
    rows = [
        (1, 0, "user", "hi \"é\" <tool_call>no</tool_call>"), (1, 1, "assistant", "ok " + call("a") + call("b", args={"query": {"$result": "a"}}) + call("c", after=["b"])),
        (1, 2, "tool", result("a", {"z": 1.0, "a": [None]}) + result("b", "é")), (1, 3, "assistant", call("a") + call("d", args={"query": ""}) + call("e", name="nope") + "<tool_call>{bad</tool_call>"),
        (2, 0, "assistant", call("x", after=["y"]) + call("y", after=["x"]) + call("z", after=["y"])), (2, 1, "tool", result("x", 1)), (3, 0, "tool", result("q", 2)), (3, 1, "assistant", call("q")),
        (4, 0, None, None), (None, 0, "assistant", call("a")), (None, 1, "tool", result("a", 1)), (5, None, "assistant", call("m", args={"limit": 0, "query": "k", "more": 1})),
    ]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("calls", "content", "message", "level", "seq")])
    messages, calls = chat_format.format_messages(df, TOOLS)
    m = {(r.conv_id, r.turn): r for r in messages.collect()}
    assert len(m) == len(rows)
    assert m[1, 0].message == '{"content":"hi \\"é\\" <tool_call>no</tool_call>","role":"user"}' and m[1, 0].n_calls == 0
    assert json.loads(m[1, 2].message)["tool_results"] == [{"content": {"a": [None], "z": 1}, "id": "a"}, {"content": "é", "id": "b"}]
    assert m[1, 3].n_malformed == 1 and m[4, 0].message == '{"content":"","role":""}'
    c = {(r.conv_id, r.turn, r.seq): r for r in calls.collect()}
    got = {(k[0], r.call_id, r.turn): (r.status, r.level, r.linked) for k, r in c.items()}
    assert got[1, "a", 1] == ("ok", 0, True) and got[1, "b", 1][1:] == (1, True) and got[1, "c", 1] == ("no_result", 2, False)
    assert got[1, "a", 3][0] == "repeated_id" and got[1, "d", 3][0] == "invalid_arguments" and got[1, "e", 3][0] == "unknown_tool"
    assert got[1, "b", 1][0] == "invalid_arguments"  # a reference isn't a string
    assert {got[2, i, 0][:2] for i in "xyz"} == {("cyclic", None)}
    assert got[3, "q", 1][0] == "result_before_call" and got[None, "a", 0][2] is False
    assert sorted(c[5, None, 0].errors) == ["$.limit: range", "$.more: not expected"]
    assert c[1, 1, 0].call == '{"arguments":{"query":"x"},"id":"a","name":"search","result":{"a":[null],"z":1}}'


def test_canonical_json_round_trip_and_schemas():
    v = {"b": [1.0, 2.5, float("nan")], "a": {"é": None, "x": True}}
    s = chat_format.canonical(v)
    assert s == '{"a":{"x":true,"é":null},"b":[1,2.5,null]}' and chat_format.canonical(json.loads(s)) == s
    ok = lambda x, y: chat_format.validate(x, y) == []
    assert ok(3, {"type": "integer", "maximum": 3}) and not ok(True, {"type": "integer"}) and ok(None, {"type": ["null", "string"]})
    assert ok(3.0, {"type": "integer"}) and not ok("b", {"enum": ["a"]}) and not ok([1, "x"], {"items": {"type": "number"}}) and not ok("ab", {"pattern": "^a$"})


def test_chat_levels(spark):
    """A chain of 2000 calls takes few rounds; calls with several needs, and those behind cycles, get what brute force gives."""
    r = random.Random(9)
    needs = {(0, f"c{i}"): [f"c{i - 1}"] if i else [] for i in range(2000)}
    for conv in range(1, 60):
        n = r.randint(1, 12)
        for i in range(n):
            needs[conv, f"n{i}"] = [f"n{r.randint(0, n - 1 if r.random() < 0.08 else max(0, i - 1))}" for _ in range(r.choice([0, 1, 1, 2, 3]))] if i or r.random() < 0.1 else []
    want, moved = {}, True
    while moved:
        moved = False
        for k, v in needs.items():
            if k not in want and all((k[0], x) in want for x in v):
                want[k], moved = max((want[k[0], x] + 1 for x in v), default=0), True
    saves = []
    own = chat_format.save
    chat_format.save = lambda df, name: saves.append(name) or own(df, name)
    try:
        df = spark.createDataFrame([(c, i, v) for (c, i), v in needs.items()], "conv_id long, call_id string, needs array<string>")
        got = {(x.l_conv, x.l_id): x.level for x in chat_format._levels(df).collect()}
    finally:
        chat_format.save = own
    assert got == want and len(want) < len(needs) and want[0, "c1999"] == 1999
    assert saves.count("chat-pointers") < 15 and len(saves) < 45


def test_chat_edges(spark):
    messages, calls = chat_format.format_messages(spark.createDataFrame([], SCHEMA))
    assert messages.count() == 0 and calls.count() == 0
    one = spark.createDataFrame([(1, 1, "assistant", "x" * 200_000 + call("a"))] * 2, SCHEMA)
    messages, calls = chat_format.format_messages(one, TOOLS)
    assert messages.count() == 2 and Counter(r.status for r in calls.collect()) == {"no_result": 1, "repeated_id": 1}


# --- pipeline -----------------------------------------------------------------------------------------------------------------------


def pipeline_rows(n=400):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(80, 160))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            w.insert(r.randint(0, len(w)), r.choice(["vileness", "grubworm"]))
        rows.append((i, " ".join(w), "en", f"s{i % 3}" if i % 9 else None, 0))
        labels.append((i, 1, int(toxic)))
    clean = [x for x in rows if x[0] % 4]
    rows += [(1000 + j, x[1].upper() if j % 2 else x[1], "en", "s0", 0) for j, x in enumerate(clean[:20])]  # exact copies
    rows += [(2000 + j, x[1] + " coda", "en", "s1", 0) for j, x in enumerate(clean[30:50])]  # near copies
    return rows, labels


def test_pipeline_stages(spark, tmp_path):
    import re

    import corpus_pipeline
    from tests.llm.test_text_ops import brute_components, brute_fingerprint, lower

    rows, labels = pipeline_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "source_mix", "packing"]
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"stage{k}"))
            at = spark.read.parquet(str(tmp_path / f"stage{k}"))
            seen.append(at.collect())
    clean, unique, far, mixed = seen
    assert {r.doc_id for r in clean} == {r[0] for r in rows if "vileness" not in r[1].lower() and "grubworm" not in r[1].lower()}
    best = {}
    for r in clean:
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert {r.doc_id for r in unique} == set(best.values())
    fps = {r.doc_id: brute_fingerprint(r.text) for r in unique}
    sets = {r.doc_id: simhash.shingles(r.text) for r in unique}
    alike = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = brute_components([(a, b) for a in fps for b in fps if a < b and alike(a, b)], fps)
    assert {r.doc_id for r in far} == set(root.values()) and len(far) < len(unique)
    words = Counter()
    size = {r.doc_id: len(re.findall(r"\S+", r.text)) for r in far}
    for r in mixed:
        words[r.doc_id] += len(re.findall(r"\S+", r.text))
    assert all(words[i] <= 3 * size[i] for i in words) and 0.9 < sum(words.values()) / sum(size.values()) < 1.1
    packed = out.collect()
    total = Counter()
    for r in packed:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 1024 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_nulls(spark, tmp_path):
    import corpus_pipeline

    rows = [(None, None, None, None, None)] * 3 + [(1, None, "en", "a", 0), (1, "x y z", None, None, None), (2, "", "en", "a", 0)] + [(i, f"doc number {i} " * 40, "en", None, 1) for i in range(3, 12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_hand_over_few_whole_texts_at_once(spark):
    """Batches of whole texts are held by the JVM and by Python: 1,000 rows at most, and fewer where the session asks for fewer."""
    import corpus_pipeline

    key, most = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.sparkContext.accumulator(0)
    before = spark.conf.get(key)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "'web' AS source", "8L AS n_chars")

    def seen(batches):
        for b in batches:
            most.add(int(b.num_rows > 1000))
            yield b

    try:
        for given, kept in ((10_000, "1000"), (0, "1000"), (200, "200")):
            spark.conf.set(key, given)
            corpus_pipeline.mix_sources(spark, docs, "")
            assert spark.conf.get(key) == kept
            assert docs.mapInArrow(seen, docs.schema).count() == 3000
        assert most.value == 0
    finally:
        spark.conf.set(key, before)


def test_stages_hand_over_few_bytes_at_once(spark):
    """Near-dedup's packed rows are large: 1,000 of them would be one batch of 64 MB.  A bound that the session sets stays."""
    import corpus_pipeline

    key, rows = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(rows), spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "repeat('x', 100000) AS text", "'en' AS lang", "'web' AS source", "100000L AS n_chars")

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    try:
        for given, most in ((None, 4.4e6), (1_000_000, 1.2e6)):
            spark.conf.unset(key) if given is None else spark.conf.set(key, given)
            corpus_pipeline.mix_sources(spark, docs, "")
            got = docs.mapInArrow(seen, "size long, n long").collect()
            assert sum(r.n for r in got) == 300 and max(r["size"] for r in got) < most
    finally:
        spark.conf.unset(key)
        spark.conf.set(rows, before)


def test_learning_toxicity_starts_no_workers_for_rows_of_the_driver(spark, monkeypatch):
    """A list of rows would go through an RDD of Python objects, whose workers stay beside those of the stages."""
    rows = [(i, f"doc number {i} " + ("bad" if i % 2 else "good"), i % 2) for i in range(40)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    want = toxicity.fit(docs, labels)

    def refuse(*args, **kw):
        raise AssertionError("rows of Python objects")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    got = toxicity.fit(docs, labels)
    assert (got.ids == want.ids).all() and (got.labels == want.labels).all() and got.score("doc bad")[0] > got.score("doc good")[0]
