"""URL filtering: a blocked Bloom filter before an exact hash join; DataFrame functions only.

A listing entry is a canonical URL prefix: a host, which also stands for its subdomains, and a path prefix.  A page URL
is canonicalised to host and path, and every ``host suffix + path prefix`` that could be listed is a candidate key.
The Bloom filter (one 64-bit word per block, so a test reads one word) is asked for each candidate where the page is read, and those
that fail go there, before any shuffle; a page's first candidate stays as the page's own row, without a key if it fails.  What passes
is joined with the listing by the exact key, which removes the filter's false positives; the longest listed key wins.

The filter has a word (8 bytes) for every six entries, ``blocks`` at most, a bound that is a parameter; with more entries it
passes more candidates on to the join, and stays right.  Its words are a scalar subquery's array: one row of them, computed once.  The listing is broadcast only if it has at most ``BROADCAST_ROWS`` rows;
a larger one is shuffled, with salts, so that a hot entry is spread; rows without a key meet nothing and are spread by page.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule.  Rules with a null
host, path or verdict are ignored; of equal rules the smallest verdict by code point counts.  Repeated rows are each
judged.  Empty tables give empty results, and an empty listing gives every page the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.llm.common import ascii_lower

BLOCKS = 1 << 21  # 16 MB of words
PROBES = 4
BROADCAST_ROWS = 50_000
SALTS = 64


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path of a URL."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    bare = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    slash = F.locate("/", bare)
    host = F.when(slash > 0, F.substr(bare, F.lit(1), slash - 1)).otherwise(bare)
    path = F.when(slash > 0, F.substr(bare, slash)).otherwise(F.lit(""))
    return ascii_lower(host), path


def _bits(key: Column) -> Column:
    """The bits of a key within its word, from one hash."""
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("bigint")
    for i in range(PROBES):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def bloom(rules: DataFrame, blocks: int) -> Column:
    """The filter's words, as an array, for the keys in column ``key``."""
    words = bloom_words(rules, blocks)
    every = rules.sparkSession.range(blocks).join(words, F.col("id") == F.col("b"), "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0)).alias("w")))), lambda x: x["w"]).alias("words")).scalar()


def bloom_words(rules: DataFrame, blocks: int) -> DataFrame:
    return rules.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("b"), _bits(F.col("key")).alias("w")).groupBy("b").agg(F.expr("bit_or(w)").alias("w"))


def may_hold(words: Column, key: Column, blocks: int) -> Column:
    bits = _bits(key)
    return F.get(words, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).bitwiseAND(bits) == bits


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", blocks: int = BLOCKS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.  ``rules``: ``host, path, verdict``."""
    listed = rules.dropna(subset=["host", "path", "verdict"]).groupBy(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).agg(F.min("verdict").alias("r_verdict"))
    listed = listed.select(F.concat_ws("\n", "r_host", "r_path").alias("key"), F.concat("r_host", "r_path").alias("r_rule"), "r_verdict", F.length("r_path").alias("n"), F.length("r_host").alias("h"))
    host, path = canonical(F.col(f"`{url_col}`"))
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    n_listed = listed.count()
    blocks = min(blocks, max(64, 1 << (n_listed // 6).bit_length()))
    words = bloom(listed.select("key"), blocks)
    lengths = F.array(*[F.lit(r.n) for r in listed.select("n").distinct().orderBy("n").collect()]).cast("array<int>")  # of listed paths: bounded by the longest
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat_ws("\n", s, p))))
    tried = rows.select("uid", "page_id", "host", "path", F.posexplode_outer(keys).alias("at", "tried"))
    hits = tried.withColumn("hit", F.when(may_hold(words, F.col("tried"), blocks), F.col("tried"))).filter(F.col("hit").isNotNull() | (F.coalesce("at", F.lit(0)) == 0)).drop("at", "tried")
    if n_listed <= broadcast_rows:
        found = hits.join(F.broadcast(listed), hits["hit"] == listed["key"], "left")
    else:
        many = listed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        own = F.xxhash64("uid")
        hits = hits.withColumn("h_salt", F.when(F.col("hit").isNull(), own).otherwise(F.pmod(own, F.lit(SALTS))))
        found = hits.join(many, (hits["hit"] == many["key"]) & (hits["h_salt"] == many["salt"]), "left")
    best = F.max(F.when(F.col("key").isNotNull(), F.struct(F.col("n") + F.col("h"), "h", "r_rule", "r_verdict"))).alias("best")
    return found.groupBy("uid", "page_id", "host", "path").agg(best).select("page_id", "host", "path", F.col("best.r_rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The pages that are not blocked, with their own columns; joined by id (pages of a blocked id go)."""
    blocked = url_filter(pages, rules, id_col, url_col).filter("verdict = 'block'").select(F.col("page_id").alias("__blocked")).distinct()
    return pages.join(blocked, pages[id_col].eqNullSafe(blocked["__blocked"]), "left_anti")
