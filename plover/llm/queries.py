"""The operators' queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.llm import align, caps, chat_format, exact_dedup, packing, repair, simhash, source_mix, suffix_dedup, token_count, topk, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: The tools that conversations may call, with their arguments' schemas.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}


def with_calls(conversations: DataFrame) -> DataFrame:
    """Conversations with tool calls made from their own turns: each assistant's turn calls a tool with its text, after the call
    two turns before, and each user's turn after the first answers the call of the turn before, in a message of role tool."""
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    name = F.element_at(F.array(F.lit("calculate"), F.lit("search"), F.lit("translate")), (F.pmod("turn", F.lit(3)) + 1).cast("int"))
    limit = (F.col("turn") - 1).alias("limit")
    arguments = F.when(name == "calculate", F.to_json(F.struct(F.col("text").alias("expression")))).otherwise(F.to_json(F.struct(F.col("text").alias("query"), limit)))
    call = F.concat(F.lit('<tool_call>{"id":"t'), "turn", F.lit('","name":"'), name, F.lit('","after":["t'), F.col("turn") - 2, F.lit('"],"arguments":'), arguments, F.lit("}</tool_call>"))
    result = F.concat(F.lit("<tool_result>"), F.to_json(F.struct(F.concat(F.lit("t"), F.col("turn") - 1).alias("id"), F.col("text").alias("content"))), F.lit("</tool_result>"))
    own = c.select("conv_id", "turn", "role", F.when(F.col("role") == "assistant", F.concat("text", call)).otherwise(F.col("text")).alias("text"))
    return own.unionByName(c.filter("role = 'user' AND turn > 0").select("conv_id", "turn", F.lit("tool").alias("role"), result.alias("text")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, calls = chat_format.format_messages(with_calls(table(spark, sf_dir, "conversations")), TOOLS)
    line = F.concat_ws(" ", "seq", "call_id", F.coalesce(F.col("level").cast("string"), F.lit("-")), "status", F.concat_ws(",", "errors"), "call")
    of = calls.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(
        F.sum(F.col("linked").cast("int")).alias("linked"), F.sum((F.col("status") != "ok").cast("int")).alias("faulty"), F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("calls")
    )
    out = messages.join(of, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("n_calls") > 0), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return out.select("conv_id", "turn", "role", "message", n("n_calls").alias("n_calls"), n("n_results").alias("n_results"), n("linked").alias("n_linked"), n("faulty").alias("n_faulty"), F.coalesce("calls", F.lit("")).alias("calls"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.judged(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("w_keep").alias("keep_id"), F.col("w_size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200).drop("kept")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))[0]


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


QUERIES = {"op1_packing": op1_packing, "op2_top_k": op2_top_k, "op3_toxicity": op3_toxicity, "op4_chat_format": op4_chat_format, "op5_exact_dedup": op5_exact_dedup, "op6_token_count": op6_token_count, "op7_suffix_dedup": op7_suffix_dedup, "op8_source_mix": op8_source_mix, "op9_url_filter": op9_url_filter, "op10_simhash": op10_simhash, "op11_repair": op11_repair, "op12_embedding_dedup": op12_embedding_dedup, "op13_alignment": op13_alignment}

_UP, _LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op2_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    # Calls are in steps of two turns, so a call's level is its place in an unbroken run of such steps.
    "op4_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
k AS (SELECT conv_id, turn, text, ['calculate', 'search', 'translate'][(turn % 3 + 1)::INT] AS name FROM c WHERE role = 'assistant'),
u AS (SELECT conv_id, turn, text FROM c WHERE role = 'user' AND turn > 0),
g AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM k),
l AS (SELECT g.conv_id, g.turn, g.text, name, row_number() OVER (PARTITION BY g.conv_id, g.turn % 2, run ORDER BY g.turn) - 1 AS level,
        u.text AS answer, u.turn IS NOT NULL AS linked,
        CASE WHEN name = 'calculate' THEN '{"expression":' || to_json(g.text) || '}' ELSE '{"limit":' || (g.turn - 1)::VARCHAR || ',"query":' || to_json(g.text) || '}' END AS args,
        concat_ws(',', CASE WHEN name = 'translate' THEN '$: unknown tool' END, CASE WHEN name = 'search' AND g.turn < 2 THEN '$.limit: range' END,
                  CASE WHEN name = 'search' AND g.text = '' THEN '$.query: length' END) AS errors
      FROM g LEFT JOIN u ON g.conv_id = u.conv_id AND g.turn + 1 = u.turn),
s AS (SELECT *, CASE WHEN name = 'translate' THEN 'unknown_tool' WHEN errors <> '' THEN 'invalid_arguments' WHEN NOT linked THEN 'no_result' ELSE 'ok' END AS status FROM l)
SELECT c.conv_id, c.turn, c.role,
       '{"content":' || to_json(c.text) || ',"role":' || to_json(c.role) || CASE WHEN s.turn IS NULL THEN '' ELSE ',"tool_calls":[{"arguments":' || args || ',"id":"t' || s.turn::VARCHAR || '","name":"' || name || '"}]' END || '}' AS message,
       (s.turn IS NOT NULL)::BIGINT AS n_calls, 0::BIGINT AS n_results, coalesce(linked, false)::BIGINT AS n_linked, coalesce(status <> 'ok', false)::BIGINT AS n_faulty,
       CASE WHEN s.turn IS NULL THEN '' ELSE '0 t' || s.turn::VARCHAR || ' ' || level::VARCHAR || ' ' || status || ' ' || errors || ' {"arguments":' || args || ',"id":"t' || s.turn::VARCHAR || '","name":"' || name || '","result":' || coalesce(to_json(answer)::VARCHAR, 'null') || '}' END AS calls
FROM c LEFT JOIN s ON c.role = 'assistant' AND c.conv_id = s.conv_id AND c.turn = s.turn
UNION ALL
SELECT conv_id, turn, 'tool', '{"content":"","role":"tool","tool_results":[{"content":' || to_json(text) || ',"id":"t' || (turn - 1)::VARCHAR || '"}]}', 0, 1, 0, 0, '' FROM u""",
    "op5_exact_dedup": f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UP}', '{_LO}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t""",
    "op12_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: x::DOUBLE) AS e, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE ok),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95),
c(x, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, c.r FROM c JOIN l ON c.x = l.x WHERE c.r < l.y),
n AS (SELECT x, count(*) AS k FROM l GROUP BY x), m AS (SELECT x, min(r) AS r FROM c GROUP BY x)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, m.r AS component_id, m.r = vec_id AS kept FROM embeddings JOIN m ON m.x = vec_id LEFT JOIN n ON n.x = vec_id""",
    "op9_url_filter": """
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^([^?#]*)', 1) AS bare FROM u),
p AS (SELECT page_id,
        translate(CASE WHEN strpos(bare, '/') > 0 THEN substr(bare, 1, strpos(bare, '/') - 1) ELSE bare END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        CASE WHEN strpos(bare, '/') > 0 THEN substr(bare, strpos(bare, '/')) ELSE '' END AS path FROM b),
r(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT p.page_id, p.host, p.path, rhost || rpath AS rule, v,
        row_number() OVER (PARTITION BY p.page_id ORDER BY length(rhost || rpath) DESC) AS k
      FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1""",
}
