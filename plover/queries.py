"""Queries over the driver's tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.config import Config, Roles
from plover.operators import ingest, splits, stats, transforms
from plover.sources import tables
from plover.sources.work import save, shared_dir, sink

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

P = 63  # features; the last component of a vector is the outcome's noise
NAMES = [f"brain_{i:03d}" for i in range(P)]


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def R(x: str) -> str:  # noqa: N802
    return f"(round({x}, 6) + 0.0)"


# --- fixtures ----------------------------------------------------------------------------------------------------------


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def emb(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, y, y2, label, features, noise``: a planted linear outcome over the vectors' components."""
    e = F.col("e")
    d = read(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return d.select(F.col("vec_id").cast("string").alias("row_id"), "vec_id", (3 * e[0] - 2 * e[1] + e[63]).alias("y"), (e[0] + 2 * e[2] + e[63]).alias("y2"), "label", F.slice("e", 1, P).alias("features"))


def emb_long(spark: SparkSession, sf: str, n: int = P) -> DataFrame:
    d = emb(spark, sf).select("row_id", F.posexplode(F.slice("features", 1, n)).alias("f_idx", "value"))
    return d.withColumn("feature", F.format_string("brain_%03d", "f_idx"))


EMB = """emb0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
emb AS (SELECT vec_id::VARCHAR AS row_id, vec_id, 3*e[1] - 2*e[2] + e[64] AS y, e[1] + 2*e[3] + e[64] AS y2, label, e[1:63] AS features FROM emb0)"""


def long_sql(n: int = P) -> str:
    return f"{EMB},\nlong AS (SELECT row_id, i::INT AS f_idx, printf('brain_%03d', i) AS feature, features[i+1] AS value FROM emb, range({n}) t(i))"


def cust(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, y, c, w, n_orders, avg_total, max_total`` of customers with orders."""
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("avg_total"), F.max("o_totalprice").alias("max_total"))
    c = read(spark, sf, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"]).select(F.col("c_custkey").cast("string").alias("row_id"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").cast("double").alias("c"), F.col("n_orders").cast("double").alias("w"), "n_orders", "avg_total", "max_total")


CUST = """ord AS (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS avg_total, max(o_totalprice) AS max_total FROM orders GROUP BY o_custkey),
cust AS (SELECT c_custkey::VARCHAR AS row_id, c_acctbal AS y, c_nationkey::DOUBLE AS c, n_orders::DOUBLE AS w, n_orders, avg_total, max_total FROM customer JOIN ord ON c_custkey = o_custkey)"""


def docq(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels, null where there are none."""
    d, l_ = read(spark, sf, "documents"), read(spark, sf, "labels").withColumnRenamed("doc_id", "l_id")
    return d.join(l_, d["doc_id"] == l_["l_id"], "left").select(F.col("doc_id").cast("string").alias("SUBJ_ID"), F.col("quality").cast("double").alias("TX_RESPONSE"), F.col("toxic").cast("double").alias("COV_toxic"), F.col("n_chars").cast("double").alias("brain_chars"), F.length("text").cast("double").alias("brain_length"), (F.col("n_chars") % 7).cast("double").alias("brain_mod"), F.col("lang").alias("site"))


DOCQ = """docq AS (SELECT d.doc_id::VARCHAR AS SUBJ_ID, quality::DOUBLE AS TX_RESPONSE, toxic::DOUBLE AS COV_toxic, n_chars::DOUBLE AS brain_chars, length(text)::DOUBLE AS brain_length, (n_chars % 7)::DOUBLE AS brain_mod, lang AS site
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
DOCQ_ROLES = Roles("SUBJ_ID", "TX_RESPONSE", "brain", ("COV_toxic",), None)
COMPLETE = "TX_RESPONSE IS NOT NULL AND COV_toxic IS NOT NULL AND brain_chars IS NOT NULL AND brain_length IS NOT NULL AND brain_mod IS NOT NULL AND site IS NOT NULL AND SUBJ_ID IS NOT NULL"


def oof(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a fixed rule: ``row_id, task, y_true, y_pred``."""
    d = emb(spark, sf)
    x = d["features"]
    two = F.array(F.struct(F.lit("a").alias("task"), F.col("y").alias("y_true"), (3 * x[0] - 1.5 * x[1]).alias("y_pred")), F.struct(F.lit("b").alias("task"), F.col("y2").alias("y_true"), (0.9 * x[0] + 1.8 * x[2]).alias("y_pred")))
    return d.select("row_id", F.explode(two).alias("t")).select("row_id", "t.*")


OOF = f"""{EMB},
oof AS (SELECT row_id, 'a' AS task, y AS y_true, 3*features[1] - 1.5*features[2] AS y_pred FROM emb
UNION ALL SELECT row_id, 'b', y2, 0.9*features[1] + 1.8*features[3] FROM emb)"""


def binary(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, y_true (0/1), score (coarse, so with ties), y_pred, p_true``."""
    d = emb(spark, sf)
    s = F.floor(d["features"][0] * 40) / 40
    p = 1 / (1 + F.exp(-4 * s))
    y = (d["label"] < 5).cast("int")
    return d.select("row_id", y.alias("y_true"), p.alias("score"), (s >= 0).cast("int").alias("y_pred"), F.when(y == 1, p).otherwise(1 - p).alias("p_true"))


BIN = f"""{EMB},
b0 AS (SELECT row_id, (label < 5)::INT AS y_true, floor(features[1] * 40) / 40 AS s FROM emb),
b AS (SELECT row_id, y_true, 1 / (1 + exp(-4 * s)) AS score, (s >= 0)::INT AS y_pred, CASE WHEN y_true = 1 THEN 1 / (1 + exp(-4 * s)) ELSE 1 - 1 / (1 + exp(-4 * s)) END AS p_true FROM b0)"""


def multi(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, y_true, y_pred``: ten classes, predicted by the largest of ten components."""
    d = emb(spark, sf)
    first = F.slice("features", 1, 10)
    return d.select("row_id", F.col("label").alias("y_true"), (F.array_position(first, F.array_max(first)) - 1).cast("int").alias("y_pred"), first.alias("s"))


MULTI = f"""{EMB},
m AS (SELECT row_id, label AS y_true, (list_position(features[1:10], list_max(features[1:10])) - 1)::INT AS y_pred, features[1:10] AS s FROM emb)"""


def coefs(spark: SparkSession, sf: str, n_folds: int = 5) -> DataFrame:
    """``feature, fold, iter, task, coef`` from the orders: a long table with zeros and changes of sign."""
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    v = F.when(k % 11 == 0, 0.0).otherwise((F.pmod(k * 37, F.lit(1000)) - 400 - 20 * (k % 13)) / 1000.0)
    return o.select(F.format_string("brain_%03d", k % 13).alias("feature"), (k % n_folds).cast("bigint").alias("fold"), F.floor(k / 65).cast("bigint").alias("iter"), F.when(k % 2 == 0, "a").otherwise("b").alias("task"), v.alias("coef"))


COEF = """coef AS (SELECT printf('brain_%03d', o_orderkey % 13) AS feature, (o_orderkey % 5)::BIGINT AS fold, floor(o_orderkey / 65)::BIGINT AS iter, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS task,
CASE WHEN o_orderkey % 11 = 0 THEN 0.0::DOUBLE ELSE ((o_orderkey * 37) % 1000 - 400 - 20 * (o_orderkey % 13))::DOUBLE / 1000.0::DOUBLE END AS coef FROM orders)"""


def fold_coefs(spark: SparkSession, sf: str) -> DataFrame:
    return coefs(spark, sf).groupBy("feature", "fold").agg(F.avg("coef").alias("coef"))


FCOEF = f"{COEF},\nfc AS (SELECT feature, fold, avg(coef) AS coef FROM coef GROUP BY feature, fold)"


def cluster_map(spark: SparkSession, sf: str) -> DataFrame:
    """``feature, f_idx, cluster``: the places of all vectors' numbers, eight of them a cluster."""
    at = emb_long(spark, sf).select("feature", "f_idx").distinct()
    return at.select("feature", "f_idx", F.concat(F.lit("c"), F.floor(F.col("f_idx") / 8).cast("string")).alias("cluster"))


PLACES = f"places AS (SELECT DISTINCT unnest(range(least(len(embedding), {P}))) AS i FROM embeddings)"
MAP = f"{PLACES}, cmap AS (SELECT printf('brain_%03d', i) AS feature, i::INT AS f_idx, 'c' || (i // 8)::VARCHAR AS cluster FROM places)"

# --- sources, roles, filters ------------------------------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {DOCQ} SELECT * FROM docq")
def scan_subjects(spark, sf):
    path = scratch(spark, "subjects")
    sink(docq(spark, sf), path, "table.csv", one_file=False)
    return tables.scan_subjects(spark, f"{path}/table.csv", DOCQ_ROLES)


@query(f"WITH {MAP} SELECT feature, cluster FROM cmap")
def scan_cluster_map(spark, sf):
    path = scratch(spark, "cluster-map")
    cluster_map(spark, sf).select("feature", "cluster").write.csv(path)
    return tables.scan_cluster_map(spark, path)


@query("SELECT l_quantity::DOUBLE AS score FROM lineitem UNION ALL SELECT l_tax::DOUBLE FROM lineitem")
def null_union(spark, sf):
    path = scratch(spark, "chunks")
    for i, c in enumerate(("l_quantity", "l_tax")):
        sink(read(spark, sf, "lineitem").select(F.col(c).cast("double").alias("null_r2")), path, f"perm_chunk_{i}", one_file=False)
    return tables.scan_null_chunks(spark, path)


@query("SELECT max(l_discount)::DOUBLE AS score FROM lineitem")
def scalar_scan(spark, sf):
    path = scratch(spark, "score")
    sink(read(spark, sf, "lineitem").agg(F.max("l_discount").cast("double").alias("score")), path, "nested_cv_scores")
    return spark.createDataFrame([(tables.scan_score(spark, f"{path}/nested_cv_scores"),)], "score double")


@query(f"WITH {long_sql()} SELECT row_id, f_idx, feature, {R('value')} AS value FROM long")
def fixture_long(spark, sf):
    return rounded(emb_long(spark, sf), "value").select("row_id", "f_idx", "feature", "value")


@query(f"WITH {DOCQ} SELECT * FROM docq WHERE {COMPLETE}")
def listwise_deletion(spark, sf):
    return ingest.listwise_deletion(docq(spark, sf))


@query(f"WITH {DOCQ} SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE {COMPLETE})::BIGINT AS n_complete, count(*) FILTER (WHERE NOT ({COMPLETE}))::BIGINT AS n_dropped FROM docq")
def deletion_counts(spark, sf):
    return ingest.deletion_counts(docq(spark, sf))


@query(f"WITH {DOCQ} SELECT SUBJ_ID AS row_id, TX_RESPONSE AS y, COV_toxic AS cov, 1.0::DOUBLE AS w, brain_chars AS x0, brain_length AS x1, brain_mod AS x2 FROM docq WHERE {COMPLETE}")
def role_projection(spark, sf):
    rows, _ = ingest.role_projection(docq(spark, sf), Config(DOCQ_ROLES, covariate_method="incorporate"))
    x = F.col("features")
    return rows.select("row_id", F.col("y")[0].alias("y"), F.col("cov")[0].alias("cov"), "w", x[0].alias("x0"), x[1].alias("x1"), x[2].alias("x2"))


@query(f"WITH {DOCQ} SELECT brain_chars, brain_length, brain_mod FROM docq")
def feature_select(spark, sf):
    d = docq(spark, sf)
    return d.select(*ingest.feature_columns(d.columns, DOCQ_ROLES))


@query(f"WITH {DOCQ} SELECT SUBJ_ID, COV_toxic FROM docq")
def covariate_projection(spark, sf):
    d = docq(spark, sf)
    ingest.required(d, DOCQ_ROLES.covariates)
    return d.select("SUBJ_ID", *DOCQ_ROLES.covariates)


@query(f"WITH {MAP} SELECT 'sub' AS block, feature FROM cmap WHERE contains(feature, '_01') UNION ALL SELECT 'list', feature FROM cmap WHERE feature IN ('brain_003', 'brain_020')")
def block_columns(spark, sf):
    names = [r.feature for r in cluster_map(spark, sf).orderBy("f_idx").select("feature").collect()]  # the table's columns
    rows = [("sub", f) for f in ingest.block_columns(names, "_01")] + [("list", f) for f in ingest.block_columns(names, ["brain_003", "brain_020", "absent"])]
    return spark.createDataFrame(rows, "block string, feature string")


def ntile_sql(seed: int, k: int, src: str, cols: str = "row_id") -> str:
    return f"SELECT {cols}, (ntile({k}) OVER (ORDER BY md5('{seed}|' || row_id), row_id) - 1)::BIGINT AS fold FROM {src}"


@query(f"WITH {CUST}, f AS ({ntile_sql(42, 5, 'cust', 'row_id, y')}) SELECT row_id, y, fold, k, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS part FROM f, (SELECT range AS k FROM range(5))")
def fold_train_test(spark, sf):
    f = splits.kfold(cust(spark, sf).select("row_id", "y"), 5)
    return f.select("row_id", "y", "fold", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(5)])).alias("k")).withColumn("part", F.when(F.col("fold") == F.col("k"), "test").otherwise("train"))


@query(f"WITH {MAP} SELECT feature FROM cmap WHERE f_idx >= 40")
def map_coverage_anti(spark, sf):
    return ingest.map_coverage(cluster_map(spark, sf).select("feature"), cluster_map(spark, sf).filter("f_idx < 40").select("feature", "cluster"))


@query(f"WITH {CUST} SELECT row_id, avg_total AS raw, CASE WHEN avg_total > 150000 THEN avg_total ELSE 0.0 END AS filled FROM cust")
def nan_replacement(spark, sf):
    d = cust(spark, sf).select("row_id", F.col("avg_total").alias("raw"), F.when(F.col("avg_total") > 150000, F.col("avg_total")).otherwise(float("nan")).alias("filled"))
    return ingest.replace_nan(d, "filled", 0.0)


@query(f"WITH {CUST} SELECT row_id, c AS d0, w AS d1, avg_total AS d2, max_total AS d3 FROM cust")
def assemble_matrix(spark, sf):
    d = cust(spark, sf).select("row_id", F.array("c").alias("cov"), F.array("w", "avg_total", "max_total").alias("features"))
    x = F.col("design")
    return ingest.assemble(d).select("row_id", *[x[i].alias(f"d{i}") for i in range(4)])


@query(f"WITH {CUST} SELECT row_id, w AS c0, avg_total AS c1, 2::INT AS n FROM cust")
def strip_covariates(spark, sf):
    d = cust(spark, sf).select("row_id", F.array("c", "y", "w", "avg_total").alias("coef"))
    return ingest.strip_covariates(d, 2).select("row_id", F.col("coef")[0].alias("c0"), F.col("coef")[1].alias("c1"), F.size("coef").alias("n"))


@query("SELECT l_returnflag AS cluster_id, l_linestatus AS status, count(*)::BIGINT AS null_score FROM lineitem GROUP BY 1, 2")
def relabel(spark, sf):
    d = read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("score"))
    return d.withColumnsRenamed({"l_returnflag": "cluster_id", "l_linestatus": "status", "score": "null_score"})


@query(f"WITH {CUST} SELECT {R('min(y)')} AS min_weight, count(*) FILTER (WHERE y < 0)::BIGINT AS n_negative FROM cust")
def weight_validation(spark, sf):
    return rounded(ingest.negative_weights(cust(spark, sf), "y"), "min_weight")


@query(f"WITH {CUST}, f AS ({ntile_sql(42, 5, 'cust')}), s AS (SELECT fold, count(*) AS n_test FROM f GROUP BY fold), t AS (SELECT count(*) AS n FROM cust) SELECT fold, (n - n_test)::BIGINT AS n_train, ((n - n_test) // 2)::BIGINT AS half, 189::BIGINT AS need, (n - n_test) // 2 < 189 AS warn FROM s, t")
def subsample_viability(spark, sf):
    return ingest.subsample_viability(splits.kfold(cust(spark, sf).select("row_id"), 5), P)


@query(f"WITH {EMB} SELECT count(*)::BIGINT AS n, 63::BIGINT AS p, (count(*) // 5)::BIGINT AS ceiling, {R('count(*) / 63')} AS np_ratio, 63 > count(*) // 5 AS over FROM emb")
def np_diagnostic(spark, sf):
    return rounded(ingest.np_diagnostic(emb(spark, sf), P), "np_ratio")


@query(f"WITH {CUST} SELECT count(*)::BIGINT AS n, {R('sum(w)*sum(w)/sum(w*w)')} AS ess, {R('sum(w)*sum(w)/sum(w*w)/count(*)')} AS ess_ratio, sum(w)*sum(w)/sum(w*w)/count(*) < 0.5 AS low FROM cust")
def weight_ess(spark, sf):
    return rounded(ingest.weight_ess(cust(spark, sf)), "ess", "ess_ratio")


@query(f"WITH {CUST} SELECT row_id, {R('w * count(*) OVER () / sum(w) OVER ()')} AS w FROM cust")
def weight_normalize(spark, sf):
    return rounded(ingest.normalize_weights(cust(spark, sf).select("row_id", "w")), "w")


@query(f"WITH {EMB} SELECT label::VARCHAR AS label, (row_number() OVER (ORDER BY label) - 1)::BIGINT AS k FROM (SELECT DISTINCT label FROM emb)")
def sorted_labels(spark, sf):
    return ingest.sorted_labels(emb(spark, sf), "label")


@query("SELECT DISTINCT l_linestatus AS d, l_returnflag AS f FROM lineitem")
def distinct_labels(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_linestatus").alias("d"), F.col("l_returnflag").alias("f")).distinct()


# --- aggregates and metrics ---------------------------------------------------------------------------------------------------

RANKED = "rk AS (SELECT row_id, f_idx, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS value FROM long), ry AS (SELECT row_id, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS y FROM emb)"


@query(f"WITH {long_sql()} SELECT feature, f_idx, {R('corr(value, y)')} AS r FROM long JOIN emb USING (row_id) GROUP BY feature, f_idx")
def univariate_pearson(spark, sf):
    return rounded(stats.univariate_pearson(emb_long(spark, sf), emb(spark, sf).select("row_id", "y")), "r")


@query(f"WITH {long_sql()}, {RANKED} SELECT feature, f_idx, {R('corr(value, ry.y)')} AS r FROM rk JOIN ry USING (row_id) GROUP BY feature, f_idx")
def univariate_spearman(spark, sf):
    return rounded(stats.univariate_spearman(emb_long(spark, sf), emb(spark, sf).select("row_id", "y")), "r")


@query(f"WITH {long_sql()}, c AS (SELECT feature, f_idx, corr(value, y) AS r FROM long JOIN emb USING (row_id) GROUP BY feature, f_idx) SELECT feature, f_idx, {R('r')} AS r FROM c ORDER BY abs(c.r) DESC, feature LIMIT 10")
def top10_pearson(spark, sf):
    return rounded(stats.top_by_strength(stats.univariate_pearson(emb_long(spark, sf), emb(spark, sf).select("row_id", "y"))), "r")


@query(f"WITH {long_sql()}, {RANKED}, c AS (SELECT feature, f_idx, corr(value, ry.y) AS r FROM rk JOIN ry USING (row_id) GROUP BY feature, f_idx) SELECT feature, f_idx, {R('r')} AS r FROM c ORDER BY abs(c.r) DESC, feature LIMIT 10")
def top10_spearman(spark, sf):
    return rounded(stats.top_by_strength(stats.univariate_spearman(emb_long(spark, sf), emb(spark, sf).select("row_id", "y"))), "r")


def pairs_sql(src: str) -> str:
    return f"SELECT a.f_idx AS i, b.f_idx AS j, corr(a.value, b.value) AS r FROM {src} a JOIN {src} b ON a.row_id = b.row_id AND a.f_idx <= b.f_idx GROUP BY 1, 2"


@query(f"WITH {long_sql()}, c AS ({pairs_sql('long')}) SELECT i, j, {R('r')} AS r FROM c")
def corr_matrix_pearson(spark, sf):
    return rounded(stats.corr_matrix(emb(spark, sf)), "r")


@query(f"WITH {long_sql()}, {RANKED}, c AS ({pairs_sql('rk')}) SELECT i, j, {R('r')} AS r FROM c")
def corr_matrix_spearman(spark, sf):
    ranked = stats.average_rank(emb_long(spark, sf), "value", ["f_idx"])
    wide = ranked.groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("f_idx", "rank"))), lambda x: x["rank"].cast("double")).alias("features"))  # P values a row
    return rounded(stats.corr_matrix(wide), "r")


def _distance(spark, sf, signed):
    c = stats.corr_matrix(emb(spark, sf)).filter("i < j")
    return c.select("i", "j", r6(stats.corr_distance(F.col("r"), signed)).alias("d"))


@query(f"WITH {long_sql()}, c AS ({pairs_sql('long')}) SELECT i, j, {R('sqrt(2*(1-abs(r)))')} AS d FROM c WHERE i < j")
def corr_distance_unsigned(spark, sf):
    return _distance(spark, sf, False)


@query(f"WITH {long_sql()}, c AS ({pairs_sql('long')}) SELECT i, j, {R('sqrt(2*(1-r))')} AS d FROM c WHERE i < j")
def corr_distance_signed(spark, sf):
    return _distance(spark, sf, True)


@query("SELECT s_suppkey AS n_rows, greatest(3, ceil(log2(63) * pow(100.0::DOUBLE / s_suppkey, 0.25)))::BIGINT AS min_size FROM supplier WHERE s_suppkey > 0")
def auto_min_cluster(spark, sf):
    return read(spark, sf, "supplier").filter("s_suppkey > 0").select(F.col("s_suppkey").alias("n_rows"), stats.auto_min_cluster(F.lit(63.0), F.col("s_suppkey")).alias("min_size"))


@query(f"WITH {long_sql()} SELECT feature, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS sd0, {R('stddev_samp(value)')} AS sd1 FROM long GROUP BY feature")
def feature_moments(spark, sf):
    return rounded(stats.feature_moments(emb_long(spark, sf)), "mean", "sd0", "sd1")


METRICS = "mt AS (SELECT task, sqrt(avg((y_true-y_pred)*(y_true-y_pred))) AS rmse, avg(abs(y_true-y_pred)) AS mae, 1 - sum((y_true-y_pred)*(y_true-y_pred)) / (var_pop(y_true) * count(*)) AS r2, corr(y_true, y_pred) AS pearson, count(*) AS n FROM oof GROUP BY task)"


@query(f"WITH {OOF}, {METRICS} SELECT task, {R('rmse')} AS rmse, {R('mae')} AS mae, {R('r2')} AS r2, {R('pearson')} AS pearson, n::BIGINT AS n FROM mt")
def regression_metrics(spark, sf):
    return rounded(stats.regression_metrics(oof(spark, sf)), "rmse", "mae", "r2", "pearson")


@query(f"WITH {OOF}, {METRICS} SELECT {R('sqrt(avg(rmse*rmse))')} AS rmse, {R('avg(mae)')} AS mae, {R('avg(r2)')} AS r2 FROM mt")
def nested_cv_r2(spark, sf):
    return rounded(stats.macro_regression(stats.regression_metrics(oof(spark, sf))), "rmse", "mae", "r2")


@query(f"WITH {OOF} SELECT task, {R('corr(y_true, y_pred)')} AS r FROM oof GROUP BY task")
def regression_pearson(spark, sf):
    return stats.regression_metrics(oof(spark, sf)).select("task", r6("pearson").alias("r"))


@query(f"""WITH {OOF}, {METRICS} SELECT task, metric, {R('value')} AS value FROM (SELECT task, unnest(['rmse', 'mae', 'r2']) AS metric, unnest([rmse, mae, r2]) AS value FROM mt)""")
def metric_rows(spark, sf):
    m = stats.regression_metrics(oof(spark, sf))
    return rounded(m.select("task", F.expr("stack(3, 'rmse', rmse, 'mae', mae, 'r2', r2) AS (metric, value)")), "value")


AUC_RANKS = "SELECT {k}, rank() OVER ({p} ORDER BY score) + (count(*) OVER (PARTITION BY {q} score) - 1) / 2 AS rk, pos FROM {src}"


@query(f"WITH {BIN}, x AS (SELECT y_true AS pos, score FROM b), rk AS ({AUC_RANKS.format(k='1 AS one', p='', q='', src='x')}) SELECT {R('(sum(rk * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(1 - pos))')} AS auc FROM rk")
def auc_binary(spark, sf):
    return rounded(stats.auc(binary(spark, sf), F.col("y_true") == 1, "score"), "auc")


OVR = f"{MULTI}, x AS (SELECT c AS label, s[c+1] AS score, (y_true = c)::INT AS pos FROM m, (SELECT range::INT AS c FROM range(10)))"


def _ovr(spark, sf):
    d = multi(spark, sf).select("y_true", F.posexplode("s").alias("label", "score"))
    return stats.auc(d, F.col("y_true") == F.col("label"), "score", ["label"])


@query(f"WITH {OVR}, rk AS ({AUC_RANKS.format(k='label', p='PARTITION BY label', q='label,', src='x')}), a AS (SELECT label, (sum(rk * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(1 - pos)) AS auc FROM rk GROUP BY label) SELECT label::VARCHAR AS label, {R('auc')} AS auc FROM a UNION ALL SELECT 'macro', {R('avg(auc)')} FROM a")
def auc_ovr(spark, sf):
    a = _ovr(spark, sf)
    return rounded(a.select(F.col("label").cast("string").alias("label"), "auc").unionByName(a.agg(F.avg("auc").alias("auc")).select(F.lit("macro").alias("label"), "auc")), "auc")


@query(f"WITH {BIN} SELECT {R('avg(-ln(least(greatest(p_true, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))')} AS log_loss FROM b")
def log_loss(spark, sf):
    return rounded(stats.log_loss(binary(spark, sf)), "log_loss")


@query(f"WITH {MULTI}, h AS (SELECT y_true, avg((y_true = y_pred)::INT) AS r FROM m GROUP BY y_true) SELECT {R('avg(r)')} AS balanced_accuracy FROM h")
def balanced_accuracy(spark, sf):
    return rounded(stats.balanced_accuracy(multi(spark, sf)), "balanced_accuracy")


def sens_sql(src: str) -> str:
    return f"SELECT label::INT AS label, {R('avg((y_pred = label)::INT) FILTER (WHERE y_true = label)')} AS sensitivity, {R('avg((y_pred <> label)::INT) FILTER (WHERE y_true <> label)')} AS specificity FROM {src}, (SELECT DISTINCT y_true AS label FROM {src}) GROUP BY label"


@query(f"WITH {BIN} {sens_sql('b')}")
def sens_spec_binary(spark, sf):
    return rounded(stats.recalls(binary(spark, sf)), "sensitivity", "specificity")


@query(f"WITH {MULTI} {sens_sql('m')}")
def sens_spec_ovr(spark, sf):
    return rounded(stats.recalls(multi(spark, sf)), "sensitivity", "specificity")


@query(f"WITH {MULTI} SELECT y_true::BIGINT AS k, {', '.join(f'count(*) FILTER (WHERE y_pred = {i})::BIGINT AS c{i}' for i in range(10))} FROM m GROUP BY y_true")
def confusion_matrix(spark, sf):
    return stats.confusion_matrix(multi(spark, sf), list(range(10)))


T975_4 = 2.7764451051977943  # the 0.975 quantile of t with 4 degrees of freedom

TT = f"""{FCOEF},
tt AS (SELECT feature, avg(coef) AS mean, stddev_samp(coef) AS sd, count(*) AS n FROM fc GROUP BY feature)"""


@query(f"WITH {TT} SELECT feature, {R('mean')} AS mean, {R('sd')} AS sd, {R('abs(sd/mean)')} AS cv, {R('mean/(sd/sqrt(n))')} AS t, {R(f'mean - {T975_4}*sd/sqrt(n)')} AS ci_low, {R(f'mean + {T975_4}*sd/sqrt(n)')} AS ci_high, (mean - {T975_4}*sd/sqrt(n) > 0 OR mean + {T975_4}*sd/sqrt(n) < 0) AS significant FROM tt")
def tier1_ttest(spark, sf):
    out = stats.fold_t_test(fold_coefs(spark, sf), 5)
    return rounded(out.select("feature", "mean", "sd", "cv", "t", "ci_low", "ci_high", "significant"), "mean", "sd", "cv", "t", "ci_low", "ci_high")


@query(f"WITH {FCOEF}, f AS (SELECT fold, avg(coef) AS a, max(coef) AS b, CASE WHEN fold < 2 THEN min(coef) END AS c FROM fc GROUP BY fold), u AS (SELECT 'a' AS param, a AS v FROM f UNION ALL SELECT 'b', b FROM f UNION ALL SELECT 'c', c FROM f) SELECT param, {R('avg(v)')} AS mean, {R('stddev_samp(v)')} AS sd, {R('min(v)')} AS min, {R('max(v)')} AS max, count(v)::BIGINT AS n_folds FROM u WHERE v IS NOT NULL GROUP BY param")
def fold_params_summary(spark, sf):
    f = fold_coefs(spark, sf).groupBy("fold").agg(F.avg("coef").alias("a"), F.max("coef").alias("b"), F.min("coef").alias("c0"))
    f = f.withColumn("c", F.when(F.col("fold") < 2, F.col("c0"))).withColumn("d", F.lit(float("nan")))
    return rounded(stats.param_summary(f, ["a", "b", "c", "d"]), "mean", "sd", "min", "max")


@query(f"WITH {COEF} SELECT feature, {R('avg(coef)')} AS mean, {R('quantile_cont(coef, 0.025)')} AS ci_low, {R('quantile_cont(coef, 0.975)')} AS ci_high, (quantile_cont(coef, 0.025) > 0 OR quantile_cont(coef, 0.975) < 0) AS is_significant FROM coef GROUP BY feature")
def bootstrap_ci(spark, sf):
    return rounded(stats.bootstrap_summary(coefs(spark, sf)).select("feature", "mean", "ci_low", "ci_high", "is_significant"), "mean", "ci_low", "ci_high")


PD = "greatest(avg((coef > 0)::INT), avg((coef < 0)::INT))"


@query(f"WITH {COEF} SELECT task, feature, {R(PD)} AS pd FROM coef GROUP BY task, feature")
def prob_direction(spark, sf):
    return coefs(spark, sf).groupBy("task", "feature").agg(r6(stats.direction()).alias("pd"))


@query(f"WITH {COEF} SELECT feature, {R(f'least(greatest(2*(1-{PD}), 0), 1)')} AS p_value FROM coef GROUP BY feature")
def pd_pvalue(spark, sf):
    return rounded(stats.bootstrap_summary(coefs(spark, sf)).select("feature", "p_value"), "p_value")


@query(f"WITH {COEF} SELECT feature, {R('((count(*) FILTER (WHERE coef >= 0.3)) + 1) / (count(*) + 1)')} AS p_value, count(*)::BIGINT AS n_permutations FROM coef GROUP BY feature")
def perm_pvalue(spark, sf):
    return rounded(stats.permutation_p(coefs(spark, sf), 0.3, ["feature"], "coef"), "p_value")


def _selected(spark, sf):
    return coefs(spark, sf).groupBy("fold", "iter", "task", "feature").agg((F.max("coef") > 0.2).cast("int").alias("selected"))


SEL = f"{COEF}, sel AS (SELECT fold, iter, task, feature, (max(coef) > 0.2)::INT AS selected FROM coef GROUP BY ALL)"


@query(f"WITH {SEL} SELECT task, feature, {R('avg(selected)')} AS selection_probability FROM sel GROUP BY task, feature")
def selection_frequency(spark, sf):
    return rounded(stats.selection_frequency(_selected(spark, sf), ["task", "feature"]), "selection_probability")


@query(f"WITH {SEL}, u AS (SELECT fold, iter, feature, max(selected) AS selected FROM sel GROUP BY ALL) SELECT feature, {R('avg(selected)')} AS selection_probability FROM u GROUP BY feature")
def selection_union(spark, sf):
    return rounded(stats.selection_union(_selected(spark, sf)), "selection_probability")


@query(f"WITH {COEF}, {MAP}, cm AS (SELECT fold, iter, cluster, avg(coef) AS coef FROM coef JOIN cmap USING (feature) GROUP BY ALL) SELECT cluster AS cluster_id, {R('avg(coef)')} AS mean, {R(PD)} AS pd, {R('quantile_cont(coef, 0.025)')} AS ci_low, {R('quantile_cont(coef, 0.975)')} AS ci_high, {R(f'least(greatest(2*(1-{PD}), 0), 1)')} AS p_value, (quantile_cont(coef, 0.025) > 0 OR quantile_cont(coef, 0.975) < 0) AS is_significant FROM cm GROUP BY cluster")
def cluster_importance(spark, sf):
    return rounded(stats.cluster_importance(coefs(spark, sf), cluster_map(spark, sf).select("feature", "cluster")), "mean", "pd", "ci_low", "ci_high", "p_value")


@query(f"WITH {FCOEF}, p AS (SELECT feature AS row_id, coef AS pred FROM fc) SELECT row_id, {R('avg(pred)')} AS mean, {R('stddev_samp(pred)')} AS sd FROM p GROUP BY row_id")
def predict_ensemble(spark, sf):
    return rounded(stats.ensemble(fold_coefs(spark, sf).select(F.col("feature").alias("row_id"), F.col("coef").alias("pred"))), "mean", "sd")


@query(f"WITH {COEF} SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE coef = 0)::BIGINT AS failed, {R('count(*) FILTER (WHERE coef = 0) / count(*)')} AS rate, 'warning' AS level FROM coef")
def boot_failure_rate(spark, sf):
    return rounded(stats.failure_rate(coefs(spark, sf).withColumn("ok", F.col("coef") != 0)), "rate")


@query(f"WITH {COEF} SELECT * FROM coef WHERE coef <> 0")
def failed_iterations(spark, sf):
    return coefs(spark, sf).filter(F.col("coef") != 0)


@query(f"WITH {COEF} SELECT count(*) FILTER (WHERE NOT (coef < 0.4))::BIGINT AS n_not_converged FROM coef")
def convergence_count(spark, sf):
    return stats.convergence(coefs(spark, sf).withColumn("converged", F.col("coef") < 0.4))


@query(f"WITH {COEF}, t AS (SELECT feature, task, avg(coef) AS coef FROM coef GROUP BY ALL) SELECT feature, {R('avg(coef)')} AS coef FROM t GROUP BY feature")
def coef_task_mean(spark, sf):
    t = coefs(spark, sf).groupBy("feature", "task").agg(F.avg("coef").alias("coef"))
    return rounded(t.groupBy("feature").agg(F.avg("coef").alias("coef")), "coef")


@query(f"WITH {COEF}, p AS (SELECT feature, task, least(greatest(2*(1-{PD}), 0), 1) / 20.0::DOUBLE + (CASE task WHEN 'a' THEN 0.0 ELSE 0.02 END)::DOUBLE AS p FROM coef GROUP BY feature, task), k AS (SELECT *, task || feature AS key FROM p), o AS (SELECT *, row_number() OVER (ORDER BY p, key) AS rn, count(*) OVER () AS n FROM k), m AS (SELECT *, max(CASE WHEN p <= rn * 0.05::DOUBLE / n THEN rn END) OVER () AS mx FROM o) SELECT key, {R('p')} AS p, coalesce(rn <= mx, false) AS rejected FROM m")
def bh_fdr(spark, sf):
    p = coefs(spark, sf).groupBy("feature", "task").agg(stats.direction_p(stats.direction()).alias("p0"))
    p = p.select(F.concat("task", "feature").alias("key"), (F.col("p0") / 20 + F.when(F.col("task") == "a", 0.0).otherwise(0.02)).alias("p"))
    return rounded(stats.bh_fdr(p, 0.05, "p", "key"), "p")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rank FROM lineitem")
def average_ranks(spark, sf):
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity")
    return stats.average_rank(d, "l_quantity", ["l_returnflag"]).drop("l_quantity").withColumn("rank", F.col("rank").cast("double"))


@query(f"WITH {CUST}, o AS (SELECT row_id, w, md5('0|' || row_id) AS h FROM cust), c AS (SELECT row_id, w, sum(w) OVER (ORDER BY h, row_id ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER () AS t FROM o) SELECT row_id, {R('(c - w) / t')} AS lo, {R('c / t')} AS hi FROM c")
def cumulative_weight(spark, sf):
    return rounded(splits.cumulative_weight(cust(spark, sf).select("row_id", "w")), "lo", "hi").select("row_id", "lo", "hi")


@query("WITH s AS (SELECT (o_orderkey % 5)::BIGINT AS fold, (o_custkey % 20)::BIGINT AS cand_id, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2, o_orderstatus), m AS (SELECT fold, cand_id, avg(score) AS mean_score FROM s GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY mean_score DESC, cand_id) AS k FROM m) SELECT fold, cand_id, (round(mean_score, 4) + 0.0) AS mean_score FROM o WHERE k = 1")
def inner_cv_best(spark, sf):
    s = read(spark, sf, "orders").groupBy((F.col("o_orderkey") % 5).alias("fold"), (F.col("o_custkey") % 20).alias("cand_id"), "o_orderstatus").agg(F.avg("o_totalprice").alias("score"))
    return stats.best_candidate(s).withColumn("mean_score", F.round("mean_score", 4) + 0.0)


@query(f"WITH {CUST} SELECT row_id, {R('CASE WHEN c <> 0 THEN y / c ELSE 0 END')} AS ratio FROM cust")
def safe_divide(spark, sf):
    return cust(spark, sf).select("row_id", r6(stats.safe_divide(F.col("y"), F.col("c"))).alias("ratio"))


@query(f"WITH {EMB} SELECT row_id, {R('1 / (1 + exp(-y))')} AS p FROM emb")
def expit(spark, sf):
    return emb(spark, sf).select("row_id", r6(transforms.expit(F.col("y"))).alias("p"))


@query(f"WITH {FCOEF}, s AS (SELECT feature, avg(coef) AS mean FROM fc GROUP BY feature) SELECT feature, {R('mean')} AS mean, {R('CASE WHEN sc.scale IS NULL THEN mean WHEN sc.scale = 0 THEN 0 ELSE mean / sc.scale END')} AS raw_mean FROM s LEFT JOIN (SELECT printf('brain_%03d', i) AS feature, i::DOUBLE AS scale FROM range(10) t(i)) sc USING (feature)")
def raw_coefficients(spark, sf):
    s = fold_coefs(spark, sf).groupBy("feature").agg(F.avg("coef").alias("mean"))
    scale = spark.range(10).select(F.format_string("brain_%03d", F.col("id").cast("int")).alias("feature"), F.col("id").cast("double").alias("scale"))
    return rounded(stats.raw_scale(s, scale, ["mean"]), "mean", "raw_mean")


@query(f"WITH {COEF}, s AS (SELECT feature, quantile_cont(coef, 0.5) AS lo FROM coef GROUP BY feature) SELECT feature, {R('lo')} AS lo FROM s WHERE lo > 0")
def significance_filter(spark, sf):
    s = coefs(spark, sf).groupBy("feature").agg(F.percentile("coef", F.lit(0.5)).alias("lo"))
    return rounded(stats.significant(s.withColumn("is_significant", F.col("lo") > 0)).select("feature", "lo"), "lo")


# --- splits and resampling --------------------------------------------------------------------------------------------------------


@query(f"WITH {CUST} {ntile_sql(42, 7, 'cust')}")
def kfold(spark, sf):
    return splits.kfold(cust(spark, sf).select("row_id"), 7)


@query(f"WITH {EMB} SELECT row_id, label, ((row_number() OVER (ORDER BY label, md5('42|' || row_id), row_id) - 1) % 5)::BIGINT AS fold FROM emb")
def stratified_kfold(spark, sf):
    return splits.stratified_kfold(emb(spark, sf).select("row_id", "label"), 5, "label").select("row_id", "label", "fold")


@query(f"WITH {EMB} SELECT row_id, (row_number() OVER (ORDER BY md5('0|' || row_id), row_id) - 1)::BIGINT AS fold FROM emb")
def loo(spark, sf):
    return splits.leave_one_out(emb(spark, sf).select("row_id"))


@query(f"WITH {EMB} SELECT row_id, k AS repeat, (ntile(3) OVER (PARTITION BY k ORDER BY md5('42/' || k::VARCHAR || '|' || row_id), row_id) - 1)::BIGINT AS fold FROM emb, (SELECT range AS k FROM range(4))")
def repeated_kfold(spark, sf):
    return splits.repeated_kfold(emb(spark, sf).select("row_id"), 3, 4)


@query("SELECT o_orderkey AS i, (o_orderkey * 7)::BIGINT AS seed, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::BIGINT AS job FROM orders")
def seed_partition(spark, sf):
    keys = read(spark, sf, "orders").groupBy("o_orderkey").agg(F.count("*").alias("c"))
    d = stats.prefix_sums(keys, "o_orderkey", [], ["c"]).select(F.col("__before_c").cast("bigint").alias("i"), "o_orderkey")
    return splits.seed_partition(d.withColumn("seed", F.col("o_orderkey") * 7), 7).select(F.col("o_orderkey").alias("i"), "seed", "job")


def perm_sql(cols: str, seed: str) -> str:
    return f"a AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || row_id), row_id) AS rn FROM emb), b AS (SELECT {cols}, row_number() OVER (ORDER BY md5('{seed}|' || row_id), row_id) AS rn FROM emb)"


@query(f"WITH {EMB}, {perm_sql('y, y2', '17')} SELECT a.row_id, a.label, {R('b.y')} AS y, {R('b.y2')} AS y2 FROM a JOIN b USING (rn)")
def label_permutation(spark, sf):
    return rounded(splits.permuted(emb(spark, sf).select("row_id", "label", "y", "y2"), ["y", "y2"], 17), "y", "y2")


@query(f"WITH {EMB}, {perm_sql('features', '5')} SELECT a.row_id, {R('a.features[1]')} AS x0, {R('b.features[11]')} AS x10, {R('b.features[12]')} AS x11 FROM a JOIN b USING (rn)")
def block_permutation(spark, sf):
    x = F.col("features")
    d = emb(spark, sf).select("row_id", x[0].alias("x0"), x[10].alias("x10"), x[11].alias("x11"))
    return rounded(splits.permuted(d, ["x10", "x11"], 5), "x0", "x10", "x11")


U32 = "('0x' || substr(md5({s}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"WITH {EMB}, o AS (SELECT row_id, (row_number() OVER (ORDER BY md5('0|' || row_id), row_id) - 1)::BIGINT AS rn, count(*) OVER () AS n FROM emb), d AS (SELECT rn AS draw, floor({U32.format(s="'boot9|' || rn::VARCHAR")} * n)::BIGINT AS pick FROM o) SELECT draw, o.row_id FROM d JOIN o ON o.rn = pick")
def bootstrap_draw(spark, sf):
    return splits.bootstrap_draw(emb(spark, sf), 9)


@query(f"WITH {CUST}, o AS (SELECT row_id, w, (row_number() OVER (ORDER BY md5('0|' || row_id), row_id) - 1)::BIGINT AS rn FROM cust), c AS (SELECT row_id, rn, (sum(w) OVER (ORDER BY rn) - w) / sum(w) OVER () AS lo, sum(w) OVER (ORDER BY rn) / sum(w) OVER () AS hi FROM o), d AS (SELECT rn AS draw, {U32.format(s="'wboot9|' || rn::VARCHAR")} AS u FROM o) SELECT draw, row_id FROM d JOIN c ON u >= lo AND u < hi")
def weighted_bootstrap_draw(spark, sf):
    return splits.weighted_bootstrap_draw(cust(spark, sf).select("row_id", "w"), 9)


@query(f"WITH {EMB}, o AS (SELECT row_id, row_number() OVER (ORDER BY md5('3|' || row_id), row_id) AS rn, count(*) OVER () AS n FROM emb) SELECT row_id FROM o WHERE rn <= n // 2")
def half_subsample(spark, sf):
    return splits.half_subsample(emb(spark, sf).select("row_id"), 3)


@query(f"WITH {CUST}, f AS ({ntile_sql(42, 5, 'cust', 'row_id, y, c AS x')}), k AS (SELECT range AS k FROM range(5)), g AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f, k WHERE fold <> k GROUP BY k) SELECT k AS fold, row_id, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS part, round(y - a - b * x, 4) + 0.0 AS residual FROM f JOIN g ON true")
def fold_residualize(spark, sf):
    f = splits.kfold(cust(spark, sf).select("row_id", "y", F.col("c").alias("x")), 5)
    return splits.fold_residualize(f).withColumn("residual", F.round("residual", 4) + 0.0)


SEEDS = [(0, 9), (1, 12), (2, 345)]
SEEDS_SQL = "seeds(i, seed) AS (VALUES (0, 9), (1, 12), (2, 345))"
RANKED = "o AS (SELECT row_id, w, y, (row_number() OVER (ORDER BY md5('0|' || row_id), row_id) - 1)::BIGINT AS rn, count(*) OVER () AS n FROM cust)"


@query(f"WITH {CUST}, {SEEDS_SQL}, {RANKED}, d AS (SELECT i, floor({U32.format(s="'boot' || seed::VARCHAR || '|' || rn::VARCHAR")} * n)::BIGINT AS pick FROM o, seeds) SELECT o.row_id, i::BIGINT AS seed, count(*)::BIGINT AS times FROM d JOIN o ON o.rn = pick GROUP BY 1, 2")
def bootstrap_counts(spark, sf):
    d = splits.bootstrap_counts(cust(spark, sf).select("row_id"), SEEDS)
    return d.select("row_id", F.explode("seeds").alias("seed")).groupBy("row_id", "seed").agg(F.count("*").alias("times"))


@query(f"WITH {CUST}, {SEEDS_SQL}, {RANKED}, c AS (SELECT row_id, (sum(w) OVER (ORDER BY rn) - w) / sum(w) OVER () AS lo, sum(w) OVER (ORDER BY rn) / sum(w) OVER () AS hi FROM o), d AS (SELECT i, {U32.format(s="'wboot' || seed::VARCHAR || '|' || rn::VARCHAR")} AS u FROM o, seeds) SELECT row_id, i::BIGINT AS seed, count(*)::BIGINT AS times FROM d JOIN c ON u >= lo AND u < hi GROUP BY 1, 2")
def weighted_bootstrap_counts(spark, sf):
    d = splits.bootstrap_counts(cust(spark, sf).select("row_id", "w"), SEEDS, "w")
    return d.select("row_id", F.explode("seeds").alias("seed")).groupBy("row_id", "seed").agg(F.count("*").alias("times"))


@query(f"WITH {CUST}, {SEEDS_SQL}, r AS (SELECT row_id, i, row_number() OVER (PARTITION BY i ORDER BY md5(seed::VARCHAR || '|' || row_id), row_id) AS k, count(*) OVER (PARTITION BY i) AS n FROM cust, seeds) SELECT row_id, i::BIGINT AS seed FROM r WHERE k <= n // 2")
def half_members(spark, sf):
    return splits.half_members(cust(spark, sf).select("row_id"), SEEDS).select("row_id", F.explode("seeds").alias("seed"))


@query(f"WITH {CUST}, {SEEDS_SQL}, {RANKED}, g AS (SELECT i, y, row_number() OVER (PARTITION BY i ORDER BY md5(seed::VARCHAR || '|' || row_id), row_id) - 1 AS rn FROM cust, seeds) SELECT row_id, i::INT AS seed, {R('g.y')} AS y FROM o JOIN g USING (rn)")
def permuted_values(spark, sf):
    d = splits.permuted_values(cust(spark, sf).select("row_id", "y"), "y", SEEDS)
    return d.select("row_id", F.posexplode("given").alias("seed", "y")).select("row_id", "seed", r6("y").alias("y"))


@query(f"WITH {CUST}, {SEEDS_SQL}, {RANKED}, d AS (SELECT i, floor({U32.format(s="'boot' || seed::VARCHAR || '|' || rn::VARCHAR")} * n)::BIGINT AS pick FROM o, seeds), x AS (SELECT i, cust.* FROM d JOIN o ON o.rn = pick JOIN cust USING (row_id)) SELECT i::BIGINT AS seed, round(count(*), 3) AS n, round(sum(c), 3) AS s_c, round(sum(c * c), 3) AS s_cc, round(sum(c * y) / 1000, 3) + 0.0 AS s_cy, round(sum(y * y) / 1000000, 3) AS s_yy FROM x GROUP BY i")
def bootstrap_moments(spark, sf):
    from plover.plans import resample

    df = cust(spark, sf).select("row_id", "y", F.col("c").alias("x_nation"))
    t = resample.Table(df, Config(Roles("row_id", "y", "x_"), outer_folds=5, inner_folds=3, n_candidates=1))
    g = resample.sample_moments(t, splits.bootstrap_counts(t.rows, SEEDS), SEEDS)
    at = lambda k, div=1: F.round(F.col("g")[k] / div, 3) + F.lit(0.0)
    return g.select(F.col("i").alias("seed"), at(0).cast("long").alias("n"), at(1).alias("s_c"), at(3).alias("s_cc"), at(4, 1000).alias("s_cy"), at(5, 1_000_000).alias("s_yy"))


# --- transformers ------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {long_sql()}, m AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS sd FROM long GROUP BY feature) SELECT row_id, feature, {R('(value - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END')} AS value FROM long JOIN m USING (feature)")
def standard_scale(spark, sf):
    return rounded(transforms.standard_scale(emb_long(spark, sf)).select("row_id", "feature", "value"), "value")


@query(f"WITH {CUST} SELECT row_id, {R('avg_total * sqrt(w)')} AS x0, {R('max_total * sqrt(w)')} AS x1, {R('y * sqrt(w)')} AS y FROM cust")
def sqrt_weight(spark, sf):
    d = transforms.sqrt_weight(cust(spark, sf).select("row_id", "w", F.array("avg_total", "max_total").alias("features"), F.array("y").alias("y")))
    return d.select("row_id", r6(F.col("features")[0]).alias("x0"), r6(F.col("features")[1]).alias("x1"), r6(F.col("y")[0]).alias("y"))


@query(f"WITH {CUST} SELECT row_id, {R('c / 0.25')} AS d0, {R('avg_total')} AS d1 FROM cust")
def covariate_scale(spark, sf):
    d = transforms.covariate_scale(cust(spark, sf).select("row_id", F.array("c", "avg_total").alias("design")), 1, 0.25)
    return d.select("row_id", r6(F.col("design")[0]).alias("d0"), r6(F.col("design")[1]).alias("d1"))


def loadings(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed loadings of clusters of eight features; the last feature is alone in its cluster."""
    last = F.col("f_idx") == P - 1
    return cluster_map(spark, sf).select(F.when(last, "solo").otherwise(F.col("cluster")).alias("cluster"), "feature", F.when(last, 1.0).otherwise((F.col("f_idx") % 8 + 1) / 10.0).alias("loading"))


LOADINGS = f"{PLACES}, ld AS (SELECT CASE WHEN i = {P - 1} THEN 'solo' ELSE 'c' || (i // 8)::VARCHAR END AS cluster, printf('brain_%03d', i) AS feature, CASE WHEN i = {P - 1} THEN 1.0::DOUBLE ELSE (i % 8 + 1) / 10.0::DOUBLE END AS loading FROM places)"


@query(f"WITH {long_sql()}, {LOADINGS}, z AS (SELECT row_id, feature, (value - avg(value) OVER (PARTITION BY feature)) / stddev_pop(value) OVER (PARTITION BY feature) AS z, value FROM long), s AS (SELECT cluster, count(*) AS n FROM ld GROUP BY cluster) SELECT row_id, CASE WHEN n > 1 THEN 'Cluster_' || cluster ELSE min(feature) END AS name, {R('CASE WHEN n > 1 THEN sum(z * loading) ELSE min(value) END')} AS score FROM z JOIN ld USING (feature) JOIN s USING (cluster) GROUP BY row_id, cluster, n")
def cluster_pca_transform(spark, sf):
    return rounded(transforms.cluster_scores(emb_long(spark, sf), loadings(spark, sf)), "score")


@query(f"WITH {LOADINGS}, s AS (SELECT cluster, count(*) AS n FROM ld GROUP BY cluster) SELECT CASE WHEN n > 1 THEN 'Cluster_' || cluster ELSE feature END AS name, feature, {R('CASE WHEN n > 1 THEN loading ELSE 1.0 END')} AS loading FROM ld JOIN s USING (cluster)")
def cluster_loadings(spark, sf):
    return rounded(transforms.named_loadings(loadings(spark, sf)).select("name", "feature", "loading"), "loading")


@query(f"WITH {COEF}, {LOADINGS}, s AS (SELECT cluster, count(*) AS n FROM ld GROUP BY cluster), l AS (SELECT CASE WHEN n > 1 THEN 'Cluster_' || cluster ELSE feature END AS name, feature, CASE WHEN n > 1 THEN loading ELSE 1.0 END AS loading FROM ld JOIN s USING (cluster)), rc AS (SELECT f.fold, l.name, (f.fold + 1) * length(l.name) / 10.0::DOUBLE AS coef FROM (SELECT DISTINCT fold FROM coef) f, (SELECT DISTINCT name FROM l) l) SELECT fold, feature, {R('sum(coef * loading)')} AS coef FROM rc JOIN l USING (name) GROUP BY fold, feature")
def backproject(spark, sf):
    named = transforms.named_loadings(loadings(spark, sf))
    folds = coefs(spark, sf).select("fold").distinct()  # a row a fold
    rc = named.select("name").distinct().join(F.broadcast(folds), how="cross").select("fold", "name", ((F.col("fold") + 1) * F.length("name") / 10.0).alias("coef"))
    return rounded(transforms.backproject(rc, named), "coef")


@query(f"WITH {EMB}, z AS (SELECT row_id, y, features[1] AS x, 3*features[1] - 2*features[2] AS lp, avg(features[1]) OVER () AS m, stddev_samp(features[1]) OVER () AS s FROM emb), c AS (SELECT row_id, y, x, lp, 1.5 * (x - m) / (s + 1e-10) AS contrib FROM z) SELECT row_id, 'brain_000' AS feature_name, {R('y - (lp - contrib)')} AS y_reg, {R('1 / (1 + exp(-(contrib + avg(lp - contrib) OVER ())))')} AS y_cls FROM c")
def plotting_data(spark, sf):
    d = emb(spark, sf)
    x = d["features"]
    rows = d.select("row_id", "y", (3 * x[0] - 2 * x[1]).alias("linear"), F.lit("brain_000").alias("feature"), x[0].alias("value"))
    coef = spark.createDataFrame([("brain_000", 1.5)], "feature string, coef double")
    reg, cls = transforms.plotting(rows, coef, False), transforms.plotting(rows, coef, True)
    return reg.select("row_id", "feature_name", r6("y_axis_value").alias("y_reg")).join(cls.select("row_id", r6("y_axis_value").alias("y_cls")), "row_id")


@query(f"WITH {EMB} SELECT row_id, {R('label::DOUBLE')} AS d0, {R('features[1]')} AS d1, {R('features[2]')} AS d2 FROM emb")
def representative_matrix(spark, sf):
    d = emb(spark, sf).select("row_id", F.array(F.col("label").cast("double")).alias("cov"), F.slice("features", 1, 2).alias("features"))
    return ingest.assemble(d).select("row_id", *[r6(F.col("design")[i]).alias(f"d{i}") for i in range(3)])


# --- operators that SQL doesn't express -----------------------------------------------------------------------------------------------------


def subject_table(spark: SparkSession, sf: str, kind: str) -> tuple[DataFrame, Config]:
    """The vectors as a subject table, and a configuration, for one of the kinds of outcome."""
    e = emb(spark, sf)
    wide = e.select(F.col("row_id").alias("SUBJ_ID"), *{"regression": ["y"], "weighted": ["y", (F.lit(1.0) + F.col("vec_id") % 3).alias("w"), (F.col("label") + 0.5 * F.col("y")).alias("COV_label")], "multitask": ["y", "y2"], "binary": [(F.col("features")[0] > 0).cast("int").alias("y")], "multiclass": [F.col("label").alias("y")]}[kind], *[F.col("features")[i].alias(n) for i, n in enumerate(NAMES)])
    outcome = ("y", "y2") if kind == "multitask" else "y"
    roles = Roles("SUBJ_ID", outcome, "brain", ("COV_label",) if kind == "weighted" else (), "w" if kind == "weighted" else None)
    classes = kind in ("binary", "multiclass")
    return wide, Config(roles, "classification" if classes else "regression", "predict", covariate_method="incorporate" if kind == "weighted" else "none", outer_folds=5, inner_folds=3, n_candidates=6 if not classes else 3, n_permutations=20, n_bootstraps=50, n_block_permutations=20, blocks={"first": ["brain_000", "brain_001"], "last": "brain_06"}, model_params={"alpha_min_predict": 1e-4, "alpha_max_predict": 0.1} if not classes else {"alpha_min_predict": 0.1, "alpha_max_predict": 10.0})


def run_of(spark: SparkSession, sf: str, kind: str, **change):
    from dataclasses import replace

    from plover.plans.runs import Run, collect_block

    df, cfg = subject_table(spark, sf, kind)
    cfg = replace(cfg, **change)
    return Run(spark, collect_block(df, cfg, cluster_map(spark, sf).select("feature", "cluster")), cfg)


def _performance(spark, sf, kind, **change):
    from plover.plans.report import performance

    run = run_of(spark, sf, kind, **change)
    return performance(run, run.out_of_fold())


@query()
def nested_cv_regression(spark, sf):
    return _performance(spark, sf, "regression")


@query()
def nested_cv_weighted_covariates(spark, sf):
    return _performance_by_moments(spark, sf, "weighted")


def by_moments(spark: SparkSession, sf: str, kind: str, like_rows: bool = False, **change):
    """A nested cross-validation by moments, with the map of ``run_of``."""
    from dataclasses import replace

    from plover.plans.moments import NestedCV

    df, cfg = subject_table(spark, sf, kind)
    return NestedCV(df, replace(cfg, **change), cluster_map(spark, sf).select("feature", "cluster"), like_rows)


def _moment_performance(found) -> DataFrame:
    from types import SimpleNamespace

    from plover.plans.report import performance

    return performance(SimpleNamespace(cfg=found.cfg, block=SimpleNamespace(classes=[], tasks=found.recipe.tasks)), save(found.out_of_fold(), "out-of-fold"))


def _performance_by_moments(spark, sf, kind, **change):
    return _moment_performance(by_moments(spark, sf, kind, like_rows=True, **change))


@query()
def nested_cv_pre_regress(spark, sf):
    return _moment_performance(by_moments(spark, sf, "weighted", covariate_method="pre_regress"))


@query(f"""WITH {CUST}, f AS ({ntile_sql(42, 5, 'cust', 'row_id, y, c, n_orders::DOUBLE AS q')}), k AS (SELECT range AS k FROM range(5)),
g AS (SELECT k, avg(y) AS my, avg(c) AS mc, avg(q) AS mq, covar_pop(y, c) AS yc, covar_pop(y, q) AS yq, covar_pop(c, q) AS cq, var_pop(c) AS cc, var_pop(q) AS qq FROM f, k WHERE fold <> k GROUP BY k),
b AS (SELECT k, my, mc, mq, (yc * qq - yq * cq) / (cc * qq - cq * cq) AS bc, (yq * cc - yc * cq) / (cc * qq - cq * cq) AS bq FROM g)
SELECT row_id, fold, round(y - my - bc * (c - mc) - bq * (q - mq), 4) + 0.0 AS residual FROM f JOIN b ON k = fold""")
def residual_outcomes(spark, sf):
    """Held-out outcomes less what two covariates predict, fitted to the other folds' moments."""
    from plover.plans.moments import NestedCV

    df = cust(spark, sf).select("row_id", "y", "c", F.col("n_orders").cast("double").alias("n_orders"), F.col("max_total").alias("x_max"))
    cfg = Config(Roles("row_id", "y", "x_", ("c", "n_orders")), covariate_method="pre_regress", outer_folds=5, inner_folds=3, n_candidates=1)
    return NestedCV(df, cfg).out_of_fold().select("row_id", "fold", (F.round("y_true", 4) + 0.0).alias("residual"))


def one_feature(spark: SparkSession, sf: str, **change):
    """Customers' balances on their largest order, and a configuration: one feature, whose elastic net has a closed form."""
    return cust(spark, sf).select("row_id", "y", F.col("max_total").alias("x_max")), one_feature_config(**change)


def one_feature_config(**change) -> Config:
    return Config(Roles("row_id", "y", "x_"), "regression", "predict", model_params={"alpha_min_predict": 20.0, "alpha_max_predict": 2000.0}, **change)


def _tried(n: int) -> list[dict[str, float]]:
    from plover.functions.fitting import candidates

    return candidates(one_feature_config(), n, 42)


ONE = "one AS (SELECT row_id, y, max_total - avg(max_total) OVER () AS x FROM cust)"
TRIED_SQL = "tried(cand_id, a, l1) AS (VALUES " + ", ".join(f"({i}, {p['alpha_or_c']!r}::DOUBLE, {p['l1_ratio']!r}::DOUBLE)" for i, p in enumerate(_tried(3))) + ")"
# Of sums less the row's own: means, sd, covariance with the standardised feature, and the soft-thresholded slope.
LESS = """m AS (SELECT *, (sx - x) / (n - 1) AS mx, (sy - y) / (n - 1) AS my FROM s),
v AS (SELECT *, sqrt((sxx - x * x) / (n - 1) - mx * mx) AS sd, (sxy - x * y) / (n - 1) - mx * my AS cxy FROM m),
b AS (SELECT *, my + sign(cxy) * greatest(abs(cxy / sd) - a * l1, 0) / (1 + a * (1 - l1)) * (x - mx) / sd AS y_pred FROM v, tried)"""


@query(f"""WITH {CUST}, {ONE}, {TRIED_SQL}, s AS (SELECT row_id, x, y, count(*) OVER () AS n, sum(x) OVER () AS sx, sum(y) OVER () AS sy, sum(x * x) OVER () AS sxx, sum(x * y) OVER () AS sxy FROM one),
{LESS} SELECT row_id, round(y, 3) AS y_true, round(y_pred, 3) + 0.0 AS y_pred FROM b WHERE cand_id = 0""")
def loo_predictions(spark, sf):
    """Each row predicted by the elastic net of all others."""
    from plover.plans import leave_one_out

    out = leave_one_out.outer(*one_feature(spark, sf, outer_folds="LOO", n_candidates=1))
    return out.select("row_id", F.round("y_true", 3).alias("y_true"), (F.round("y_pred", 3) + 0.0).alias("y_pred"))


@query(f"""WITH {CUST}, {ONE}, {TRIED_SQL}, f AS ({ntile_sql(42, 5, 'one', 'row_id, x, y')}), k AS (SELECT range AS k FROM range(5)),
s AS (SELECT k, x, y, count(*) OVER w AS n, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x * x) OVER w AS sxx, sum(x * y) OVER w AS sxy FROM f, k WHERE fold <> k WINDOW w AS (PARTITION BY k)),
{LESS} SELECT k AS fold, cand_id::BIGINT AS cand_id, round(-avg((y - y_pred) * (y - y_pred)) / 1000000, 6) AS score FROM b GROUP BY 1, 2""")
def loo_inner_search(spark, sf):
    """Candidates' inner scores with validation sets of one row each."""
    from plover.plans import leave_one_out

    out = leave_one_out.inner(*one_feature(spark, sf, outer_folds=5, inner_folds="LOO", n_candidates=3))
    return out.select("fold", "cand_id", F.round(F.col("score") / 1_000_000, 6).alias("score"))


@query()
def nested_cv_multitask(spark, sf):
    return _performance_by_moments(spark, sf, "multitask")


@query()
def nested_cv_binary(spark, sf):
    return _performance(spark, sf, "binary")


@query()
def nested_cv_multiclass(spark, sf):
    """Over rows that are never collected, with the folds of the row path."""
    from types import SimpleNamespace

    from plover.plans import multinomial, report

    df, cfg = subject_table(spark, sf, "multiclass")
    oof, _, _, classes = multinomial.nested_cv(df, cfg)
    return report.performance(SimpleNamespace(cfg=cfg, block=SimpleNamespace(classes=classes)), save(oof, "out-of-fold"))


@query()
def nested_cv_binary_rows(spark, sf):
    """The same as ``nested_cv_binary`` over rows that are never collected, for tables of any size."""
    from types import SimpleNamespace

    from plover.plans import logistic, report

    df, cfg = subject_table(spark, sf, "binary")
    oof, _, _, classes = logistic.nested_cv(df, cfg)
    return report.performance(SimpleNamespace(cfg=cfg, block=SimpleNamespace(classes=classes)), save(oof, "out-of-fold"))


@query()
def nested_cv_moments(spark, sf):
    from plover.plans import moments

    df, cfg = subject_table(spark, sf, "weighted")
    oof, _, _ = moments.nested_cv(df, cfg)
    return stats.regression_metrics(oof)


@query()
def search_candidates(spark, sf):
    return run_of(spark, sf, "regression").search()


@query()
def fold_diagnostics(spark, sf):
    return by_moments(spark, sf, "regression", like_rows=True).fold_models().drop("model")


@query()
def tier1_report(spark, sf):
    from plover.plans import report

    run = run_of(spark, sf, "multitask")
    return report.tier1(run.coefficients(), run.n_folds, run.cfg.ci_level)


def moment_table(spark: SparkSession, sf: str, kind: str = "regression"):
    """The table of a regression and its folds' parameters, by moments."""
    from plover.plans import moments, resample

    df, cfg = subject_table(spark, sf, kind)
    return resample.Table(df, cfg), moments.nested_cv(df, cfg)


@query()
def bootstrap_report(spark, sf):
    from plover.plans import report, resample

    t, (_, _, params) = moment_table(spark, sf)
    return report.importance(resample.bootstrap(t, params), resample.feature_scale(t), t.cfg.ci_level)


@query()
def bootstrap_report_weighted(spark, sf):
    from plover.plans import report, resample

    t, (_, _, params) = moment_table(spark, sf, "weighted")
    return report.tier2(resample.bootstrap(t, params), t.cfg.ci_level)


@query()
def selection_report(spark, sf):
    from plover.plans import resample

    t, (_, _, params) = moment_table(spark, sf)
    return stats.selection_frequency(resample.selection(t, params))


@query()
def permutation_test(spark, sf):
    from plover.plans import report, resample

    t = resample.Table(*subject_table(spark, sf, "regression"))
    return report.permutation_result(resample.null_scores(t), resample.observed_score(t))


@query()
def block_permutation_test(spark, sf):
    from plover.plans import report, resample

    t = resample.Table(*subject_table(spark, sf, "regression"))
    return report.block_result(resample.block_null_scores(t), resample.observed_score(t))


@query()
def hdbscan_clusters(spark, sf):
    return run_of(spark, sf, "regression", reduction="cluster_pca", min_cluster_size=3, n_candidates=2).loadings()


@query()
def apriori_pca(spark, sf):
    return by_moments(spark, sf, "regression", reduction="apriori", n_candidates=2).loadings()


@query()
def cluster_pca_scores(spark, sf):
    return by_moments(spark, sf, "regression", reduction="apriori", n_candidates=2).coefficients(reduced=True)


@query()
def fold_representatives(spark, sf):
    """Every row's cluster scores by the first fold's reducer."""
    d = by_moments(spark, sf, "regression", reduction="apriori", n_candidates=1).representative()
    return d.select("row_id", F.explode(F.map_from_arrays("names", "values")).alias("name", "score"))


@query()
def pearson_clusters(spark, sf):
    """Density clusters by distances of each fold's correlations, from its moments."""
    return by_moments(spark, sf, "regression", reduction="cluster_pca", distance="pearson", min_cluster_size=3, n_candidates=2).loadings()


@query()
def ica_components(spark, sf):
    return by_moments(spark, sf, "regression", like_rows=True, reduction="ica", ica_components=8, n_candidates=2).mixing()


@query()
def parallel_analysis(spark, sf):
    from plover.functions import solvers

    b = run_of(spark, sf, "regression").block
    return spark.createDataFrame([(solvers.parallel_analysis(b.x, standardize=s), s) for s in (False, True)], "n_components long, standardized boolean")


@query()
def ensemble_prediction(spark, sf):
    from plover.plans.runs import predict_ensemble as predict

    found = by_moments(spark, sf, "regression", like_rows=True)
    rows = emb(spark, sf).select("row_id", "features", F.array().cast("array<double>").alias("cov"))
    return predict(found.fold_models(), rows, found.cfg).drop("proba")


# --- more of the inventory ---------------------------------------------------------------------------------------------------------------------


@query(f"WITH {COEF} SELECT f.fold, i.iter, (f.fold * 1000000 + i.iter)::BIGINT AS task FROM (SELECT DISTINCT fold FROM coef) f, (SELECT DISTINCT iter FROM coef) i")
def task_list(spark, sf):
    c = coefs(spark, sf)
    folds = c.select("fold").distinct()  # a row a fold
    return c.select("iter").distinct().join(F.broadcast(folds), how="cross").select("fold", "iter", (F.col("fold") * 1_000_000 + F.col("iter")).alias("task"))


@query(f"WITH {long_sql()}, {MAP} SELECT row_id, cluster, {R('avg(value)')} AS mean, count(*)::BIGINT AS n FROM long JOIN cmap USING (feature) GROUP BY row_id, cluster")
def feature_map_join(spark, sf):
    m = cluster_map(spark, sf).select("feature", "cluster")
    return rounded(emb_long(spark, sf).join(F.broadcast(m), "feature").groupBy("row_id", "cluster").agg(F.avg("value").alias("mean"), F.count("*").alias("n")), "mean")


@query(f"WITH {CUST} SELECT count(*)::BIGINT AS n, round(regr_slope(y, c), 6) + 0.0 AS slope, round(regr_intercept(y, c), 4) + 0.0 AS intercept FROM cust")
def ols(spark, sf):
    return cust(spark, sf).agg(F.count("*").alias("n"), (F.round(F.regr_slope("y", "c"), 6) + 0.0).alias("slope"), (F.round(F.regr_intercept("y", "c"), 4) + 0.0).alias("intercept"))


@query(f"WITH {CUST} SELECT {R('sum(w * y) / sum(w)')} AS wmean, {R('sum(w * y * y) / sum(w)')} AS wsq FROM cust")
def weighted_moments(spark, sf):
    w, y = F.col("w"), F.col("y")
    return cust(spark, sf).agg(r6(F.sum(w * y) / F.sum(w)).alias("wmean"), r6(F.sum(w * y * y) / F.sum(w)).alias("wsq"))


@query(f"WITH {EMB} SELECT i.i::INT AS i, j.i::INT AS j, {R('sum(features[i.i+1] * features[j.i+1])')} AS g FROM emb, range({P}) i(i), range({P}) j(i) GROUP BY 1, 2")
def gram_matrix(spark, sf):
    g = stats._moment_sums(emb(spark, sf), "features").filter("i > 0")
    return g.select((F.col("i") - 1).alias("i"), F.posexplode("g").alias("j", "v")).filter("j > 0").select("i", (F.col("j") - 1).alias("j"), r6("v").alias("g"))


@query(f"WITH {EMB}, f AS ({ntile_sql(42, 5, 'emb', 'row_id, y')}), m AS (SELECT k, avg(y) AS p FROM f, (SELECT range AS k FROM range(5)) WHERE fold <> k GROUP BY k) SELECT fold, {R('sqrt(avg((y - p) * (y - p)))')} AS rmse, {R('avg((y - p) * (y - p))')} AS mse FROM f JOIN m ON fold = k GROUP BY fold")
def inner_score_rmse(spark, sf):
    f = splits.kfold(emb(spark, sf).select("row_id", "y"), 5)
    own = f.groupBy("fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    total = own.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    mean = own.join(F.broadcast(total), how="cross").select(F.col("fold").alias("k"), ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("p"))
    e = (F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))
    return f.join(F.broadcast(mean), F.col("fold") == F.col("k")).groupBy("fold").agg(r6(F.sqrt(F.avg(e))).alias("rmse"), r6(F.avg(e)).alias("mse"))


@query(f"WITH {COEF} SELECT task, feature, {R('avg(coef)')} AS boot_mean_coef, {R('quantile_cont(coef, 0.025)')} AS boot_ci_low, {R('quantile_cont(coef, 0.975)')} AS boot_ci_high, {R(PD)} AS pd, {R(f'least(greatest(2*(1-{PD}), 0), 1)')} AS p_value, (quantile_cont(coef, 0.025) > 0 OR quantile_cont(coef, 0.975) < 0) AS is_significant FROM coef GROUP BY task, feature")
def tier2_summary(spark, sf):
    from plover.plans import report

    return rounded(report.tier2(coefs(spark, sf).withColumn("ok", F.lit(True)), 0.95).drop("is_significant_fdr"), "boot_mean_coef", "boot_ci_low", "boot_ci_high", "pd", "p_value")


@query(f"WITH {COEF}, n AS (SELECT task AS block, coef AS score FROM coef) SELECT block, 0.2::DOUBLE AS observed_score, {R('((count(*) FILTER (WHERE score >= 0.2)) + 1) / (count(*) + 1)')} AS p_value FROM n GROUP BY block")
def block_pvalue(spark, sf):
    from plover.plans import report

    return rounded(report.block_result(coefs(spark, sf).select(F.col("task").alias("block"), F.col("coef").alias("score")), 0.2), "p_value")


@query(f"WITH {EMB}, z AS (SELECT row_id, features[1:4] AS x FROM emb) SELECT row_id, {R('avg(p)')} AS mean, {R('stddev_samp(p)')} AS sd FROM (SELECT row_id, f.k * x[1] + x[2] / (f.k + 1) - x[3] AS p FROM z, (SELECT range AS k FROM range(3)) f) GROUP BY row_id")
def ensemble_dot(spark, sf):
    rows = emb(spark, sf).select("row_id", F.slice("features", 1, 4).alias("x"))
    models = spark.createDataFrame([(k, [float(k), 1.0 / (k + 1), -1.0, 0.0]) for k in range(3)], "fold long, beta array<double>")
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rounded(stats.ensemble(rows.join(F.broadcast(models), how="cross").select("row_id", dot.alias("pred"))), "mean", "sd")
