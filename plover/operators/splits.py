"""Splits and resampling, in an order that comes from hashes of seed and row id, not from row positions.

A global order over all rows would put them in one task, so ranks come in two steps where they are needed over the whole
table: counts by hash bucket, then ranks within buckets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIGITS = 3  # hexadecimal, of the hash: 4096 buckets


def order_hash(seed: int | Column, row_id: Column) -> Column:
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat_ws("|", seed, row_id.cast("string")))


def uniform(h: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a hash."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_rank(df: DataFrame, seed: int | Column, by: list[str] | None = None, row_id: str = "row_id") -> DataFrame:
    """``h`` and ``rn``, the rank from 0 in the order of ``(h, row_id)``, and ``n``, within the groups ``by``."""
    by = by or []
    rows = df.withColumn("h", order_hash(seed, df[row_id])).withColumn("__b", F.substring("h", 1, DIGITS))
    sizes = rows.groupBy(*by, "__b").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by).orderBy("__b") if by else Window.orderBy("__b")  # a row a bucket
    all_ = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("__before", F.sum("__c").over(w) - F.col("__c")).withColumn("n", F.sum("__c").over(all_)).drop("__c")
    local = Window.partitionBy(*by, "__b").orderBy("h", row_id)
    on = [*by, "__b"]
    return rows.withColumn("__k", F.row_number().over(local)).join(sizes, on).withColumn("rn", F.col("__before") + F.col("__k") - 1).drop("__k", "__before", "__b")


def ntile_of(rn: Column, n: Column, k: int) -> Column:
    """The tile (from 0) of rank ``rn``; the first ``n mod k`` tiles have one row more."""
    q, r = F.floor(n / k), n % k
    big = r * (q + 1)
    return F.when(rn < big, F.floor(rn / (q + 1))).otherwise(r + F.floor((rn - big) / F.greatest(q, F.lit(1)))).cast("bigint")


def kfold(df: DataFrame, k: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """``fold``: shuffled folds; the first ``n mod k`` have one row more."""
    ranked = hash_rank(df, seed, row_id=row_id)
    return ranked.withColumn("fold", ntile_of(F.col("rn"), F.col("n"), k)).drop("h", "rn", "n")


def stratified_kfold(df: DataFrame, k: int, label: str, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """``fold``: rows in the order of label and hash are dealt round."""
    ranked = hash_rank(df, seed, by=[label], row_id=row_id).drop("n")
    sizes = df.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__c"))
    before = sizes.withColumn("__before", F.sum("__c").over(Window.orderBy("__l")) - F.col("__c"))  # one row a class
    out = ranked.join(F.broadcast(before), ranked[label].eqNullSafe(before["__l"]))
    return out.withColumn("fold", ((F.col("__before") + F.col("rn")) % k).cast("bigint")).drop("h", "rn", "__l", "__c", "__before")


def training_folds(df: DataFrame, k_out: int, k_in: int, seed: int | Column, label: str | None = None, row_id: str = "row_id") -> DataFrame:
    """``inner ARRAY`` of rows with ``fold``: for each outer fold, the row's inner fold in the training set of all others; -1 for its own.

    Every training set is dealt by itself, as by :func:`kfold`, or by :func:`stratified_kfold` with ``label`` (numbers).  All take their rows in one hash order, so a
    row's place in one is its place in the whole less the rows of the fold left out before it: sums by bucket and fold, and one window.
    """
    by, folds = [label] if label else [], range(k_out)
    rows = df.withColumn("__h", order_hash(seed, df[row_id])).withColumn("__b", F.substring("__h", 1, DIGITS))
    mine = lambda k: (F.col("fold") == k).cast("bigint")
    sizes = rows.groupBy(*by, "__b").agg(*[F.sum(mine(k)).alias(f"__c{k}") for k in folds])
    before = Window.orderBy(*by, "__b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    sums = [F.coalesce(F.sum(f"__c{k}").over(before), F.lit(0)).alias(f"__s{k}") for k in folds]
    sizes = sizes.select(*by, "__b", *sums, *[F.sum(f"__c{k}").over(Window.partitionBy(F.lit(0))).alias(f"__n{k}") for k in folds])
    local = Window.partitionBy(*by, "__b").orderBy("__h", row_id)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*rows.columns, F.row_number().over(local).alias("__k"), *[F.sum(mine(k)).over(upto).alias(f"__r{k}") for k in folds]).join(sizes, [*by, "__b"])
    rank, n = sum((F.col(f"__s{k}") for k in folds), F.col("__k") - 1), sum((F.col(f"__n{k}") for k in folds), F.lit(0))
    at = lambda k: rank - F.col(f"__s{k}") - F.col(f"__r{k}")
    part = lambda k: at(k) % k_in if label else ntile_of(at(k), n - F.col(f"__n{k}"), k_in)
    return rows.select(*df.columns, F.array(*[F.when(F.col("fold") == k, -1).otherwise(part(k)).cast("int") for k in folds]).alias("inner"))


def leave_one_out(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``fold``: each row's own, numbered in the order of hashes."""
    ranked = hash_rank(df, 0, row_id=row_id)
    return ranked.withColumn("fold", F.col("rn").cast("bigint")).drop("h", "rn", "n")


def repeated_kfold(df: DataFrame, k: int, repeats: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """``repeat, fold``: independent folds for each repeat."""
    many = df.withColumn("repeat", F.explode(F.array(*[F.lit(r).cast("bigint") for r in range(repeats)])))
    ranked = hash_rank(many, F.concat_ws("/", F.lit(str(seed)), F.col("repeat").cast("string")), by=["repeat"], row_id=row_id)
    return ranked.withColumn("fold", ntile_of(F.col("rn"), F.col("n"), k)).drop("h", "rn", "n")


def seed_stream(n: int, seed: int = 42) -> list[int]:
    """The seeds of ``n`` iterations, from NumPy's legacy generator."""
    return np.random.RandomState(seed).randint(0, 10**9, size=n).tolist()


def seed_frame(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return spark.createDataFrame(list(enumerate(seed_stream(n, seed))), "i long, seed long")


def seed_partition(seeds: DataFrame, n_jobs: int) -> DataFrame:
    """``job``: contiguous parts in the order of ``i``, the first ones larger."""
    total = seeds.agg(F.count("*").alias("__n"))  # one row
    return seeds.join(F.broadcast(total), how="cross").withColumn("job", ntile_of(F.col("i"), F.col("__n"), n_jobs)).drop("__n")


def permuted(df: DataFrame, columns: list[str], seed: int | Column, by: list[str] | None = None, row_id: str = "row_id") -> DataFrame:
    """``df`` with ``columns`` permuted jointly: the row of rank r in one hash order takes them from rank r in another."""
    by = by or []
    to = hash_rank(df.drop(*columns), 0, by=by, row_id=row_id).drop("h", "n")
    give = hash_rank(df.select(*by, row_id, *columns), seed, by=by, row_id=row_id).select(*by, "rn", *columns)
    return to.join(give, [*by, "rn"]).select(*df.columns)


def bootstrap_draw(df: DataFrame, seed: int, row_id: str = "row_id") -> DataFrame:
    """``draw, row_id``: as many draws as rows, with replacement; draw d takes the row of rank floor(u n)."""
    ranked = hash_rank(df.select(row_id), 0, row_id=row_id).select(row_id, "rn", "n")
    u = uniform(F.md5(F.concat_ws("|", F.lit(f"boot{seed}"), F.col("rn").cast("string"))))
    draws = ranked.select(F.col("rn").alias("draw"), F.floor(u * F.col("n")).cast("bigint").alias("pick"))
    return draws.join(ranked.select(F.col("rn").alias("pick"), row_id), "pick").select("draw", row_id)


def cumulative_weight(df: DataFrame, w: str = "w", row_id: str = "row_id") -> DataFrame:
    """``lo, hi``: each row's interval of cumulative share of the weight, in the order of hash rank.

    Sums by hash bucket come first, so the running sum within a bucket is all that a task orders.
    """
    rows = df.withColumn("__h", order_hash(0, df[row_id])).withColumn("__b", F.substring("__h", 1, DIGITS))
    sums = rows.groupBy("__b").agg(F.sum(w).alias("__s"))
    sums = sums.withColumn("__before", F.sum("__s").over(Window.orderBy("__b")) - F.col("__s")).withColumn("__total", F.sum("__s").over(Window.partitionBy(F.lit(0)))).drop("__s")
    local = Window.partitionBy("__b").orderBy("__h", row_id).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__k", F.sum(w).over(local)).join(F.broadcast(sums), "__b")
    return out.withColumn("hi", (F.col("__before") + F.col("__k")) / F.col("__total")).withColumn("lo", F.col("hi") - F.col(w) / F.col("__total")).drop("__h", "__b", "__k", "__before", "__total")


def weighted_bootstrap_draw(df: DataFrame, seed: int, w: str = "w", row_id: str = "row_id") -> DataFrame:
    """``draw, row_id``: draws with probability w / sum(w).

    A draw's u meets the interval that holds it by an equi-join on grid cells of [0, 1) and a range condition.  There are as
    many cells as rows, so intervals touch twice as many cells as there are rows at most, and a cell has one draw or so.
    """
    cells = max(1, df.count())
    spans = cumulative_weight(df, w, row_id).filter(F.col("hi") > F.col("lo"))
    ranked = hash_rank(df.select(row_id), 0, row_id=row_id).select(F.col("rn").alias("draw"))
    u = uniform(F.md5(F.concat_ws("|", F.lit(f"wboot{seed}"), F.col("draw").cast("string"))))
    draws = ranked.withColumn("u", u).withColumn("cell", F.floor(F.col("u") * cells))
    spans = spans.select(row_id, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.lit(cells - 1), F.floor(F.col("hi") * cells)))).alias("s_cell"))
    return draws.join(spans, (F.col("cell") == F.col("s_cell")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", row_id)


def half_subsample(df: DataFrame, seed: int, row_id: str = "row_id") -> DataFrame:
    """Half of the rows (rounded down), without replacement."""
    ranked = hash_rank(df, seed, row_id=row_id)
    return ranked.filter(F.col("rn") < F.expr("n div 2")).drop("h", "rn", "n")


def bootstrap_counts(df: DataFrame, seeds: list[tuple[int, int]], w: str | None = None, row_id: str = "row_id") -> DataFrame:
    """``row_id, seeds ARRAY``: of every row, the numbers of the seeds that draw it, each as often as it does.

    ``seeds`` are (number, seed); a seed's draws are those of :func:`bootstrap_draw`, or of :func:`weighted_bootstrap_draw` if ``w`` is given.
    """
    spark = df.sparkSession
    listed = spark.createDataFrame(seeds, "i long, seed long")
    ranked = hash_rank(df.select(row_id), 0, row_id=row_id).select(row_id, "rn", "n")
    name = "wboot" if w else "boot"
    draws = ranked.select("rn", "n").join(F.broadcast(listed), how="cross")  # rows x the seeds of one group
    draws = draws.withColumn("u", uniform(F.md5(F.concat_ws("|", F.concat(F.lit(name), F.col("seed").cast("string")), F.col("rn").cast("string")))))
    if w is None:
        picked = draws.select(F.floor(F.col("u") * F.col("n")).cast("bigint").alias("pick"), "i").groupBy("pick").agg(F.collect_list("i").alias("seeds"))
        return picked.join(ranked.select(F.col("rn").alias("pick"), row_id), "pick").select(row_id, "seeds")
    cells = max(1, df.count())
    spans = cumulative_weight(df.select(row_id, w), w, row_id).filter(F.col("hi") > F.col("lo"))
    spans = spans.select(row_id, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.lit(cells - 1), F.floor(F.col("hi") * cells)))).alias("s_cell"))
    draws = draws.select("i", "u", F.floor(F.col("u") * cells).alias("cell"))
    met = draws.join(spans, (F.col("cell") == F.col("s_cell")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return met.groupBy(row_id).agg(F.collect_list("i").alias("seeds"))


def half_members(df: DataFrame, seeds: list[tuple[int, int]], row_id: str = "row_id") -> DataFrame:
    """``row_id, seeds ARRAY``: the numbers of the seeds (number, seed) whose half sample, as of :func:`half_subsample`, holds the row.

    Rows aren't ordered: a histogram of each seed's hashes finds the bucket in which its half ends, and only that bucket's rows are ranked for the hash at which it does.
    """
    spark = df.sparkSession
    listed = spark.createDataFrame(seeds, "i long, seed long")
    h = order_hash(F.col("seed"), F.col(row_id))
    every = df.select(row_id).join(F.broadcast(listed), how="cross").select("i", row_id, h.alias("h"), F.substring(h, 1, DIGITS).alias("b"))
    total = df.count()
    size = every.groupBy("i", "b").agg(F.count("*").alias("c"))  # a row a bucket and seed
    size = size.withColumn("upto", F.sum("c").over(Window.partitionBy("i").orderBy("b")))
    ends = size.filter((F.col("upto") - F.col("c") < total // 2) & (F.col("upto") >= total // 2)).select(F.col("i").alias("e_i"), F.col("b").alias("e_b"), (F.lit(total // 2) - F.col("upto") + F.col("c")).alias("k"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("h", row_id))
    last = every.join(F.broadcast(ends), (F.col("i") == F.col("e_i")) & (F.col("b") == F.col("e_b"))).withColumn("rn", rank).filter("rn = k")
    last = last.select(F.col("i").alias("l_i"), F.col("h").alias("l_h"), F.col(row_id).alias("l_id"))  # a row a seed
    inside = every.join(F.broadcast(last), (F.col("i") == F.col("l_i")) & ((F.col("h") < F.col("l_h")) | ((F.col("h") == F.col("l_h")) & (F.col(row_id) <= F.col("l_id")))))
    return inside.groupBy(row_id).agg(F.collect_list("i").alias("seeds"))


def permuted_values(df: DataFrame, column: str, seeds: list[tuple[int, int]], row_id: str = "row_id") -> DataFrame:
    """``row_id, given ARRAY``: what :func:`permuted` gives each row in ``column`` for every seed (number, seed), in their order."""
    spark = df.sparkSession
    listed = spark.createDataFrame(seeds, "i long, seed long")
    to = hash_rank(df.select(row_id), 0, row_id=row_id).select(row_id, "rn")
    every = df.select(row_id, column).join(F.broadcast(listed), how="cross")
    give = hash_rank(every, F.col("seed"), by=["i"], row_id=row_id).groupBy("rn").agg(F.sort_array(F.collect_list(F.struct("i", column))).alias("g"))
    return to.join(give, "rn").select(row_id, F.transform("g", lambda x: x[column]).alias("given"))


def fold_residualize(df: DataFrame, y: str = "y", x: str = "x", fold: str = "fold") -> DataFrame:
    """``fold, row_id, part, residual`` for one covariate: the line fitted to a fold's training rows, taken from all rows.

    Training sums are totals less the fold's own, so there is one aggregation, not one for each fold.
    """
    own = df.groupBy(fold).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    total = own.agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy")])
    d = {c: F.col(f"t_{c}") - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")}
    fit = own.join(F.broadcast(total), how="cross").select(F.col(fold).alias("k"), *[v.alias(c) for c, v in d.items()])
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(F.abs(det) > 1e-12, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).otherwise(0.0)
    fit = fit.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    out = df.join(F.broadcast(fit.select("k", "slope", "intercept")), how="cross")  # one row a fold
    return out.select(F.col("k").alias("fold"), "row_id", F.when(F.col(fold) == F.col("k"), "test").otherwise("train").alias("part"), (F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)).alias("residual"))
