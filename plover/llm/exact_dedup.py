"""Exact dedup by skew-safe combining; DataFrame functions only.

1. *Locally*: a partial hash aggregate per map task folds equal texts into one row (largest id, count).
2. *Salted*: those rows are merged by ``(digest, salt, text)``.  The salt comes from the id, so a text that a third
   of all rows share is spread over ``salts`` groups.
3. *Globally*: at most ``salts`` winners of each text meet by digest and are merged by ``(digest, text)``.

The grouping keys hold the text itself at every stage, so equal digests of different texts never merge.
The winners carry the salts in which their text occurs; rows find their winner by ``(digest, salt)``, which spreads a
hot text again, without shuffling texts.  Only digests that two texts share (none, for SHA-256) are matched by text too.

Salts number ``SALTS`` at least, and one more for each ``SALT_ROWS`` rows, so that a salt's share of a hot text stays bounded; rows with null
ids take theirs from the whole row.

Defined results: a null text counts as empty.  A group keeps the row with the largest id (null ids are smallest); of
rows that repeat that id and text, one stays.  Extra columns pass through, whatever
their names; where one begins with ``dup_``, ``annotate`` puts underscores before its own.
An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.llm.common import ascii_lower, parts, save, text_or_empty

SALTS = 48
SALT_ROWS = 1 << 20


def sha256(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def _salt(docs: DataFrame, id_col: str, salts: int) -> Column:
    whole = [docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.pmod(F.when(docs[id_col].isNotNull(), F.xxhash64(docs[id_col])).otherwise(F.xxhash64(*whole)), F.lit(salts)).cast("int")


def winners(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct text: ``digest, keep_id, group_size, salts, variants, norm``.

    ``variants`` counts the texts of the digest; ``norm`` is the text where that is over 1 and else null.
    """
    rows = docs.select(docs[id_col].alias("id"), ascii_lower(text_or_empty(docs[text_col])).alias("norm"), _salt(docs, id_col, salts).alias("salt"))
    rows = rows.select("id", "norm", "salt", digest(F.col("norm")).alias("digest"))
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    merged = (
        salted.repartition(parts(docs), "digest")
        .groupBy("digest", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
        .withColumn("variants", F.count("*").over(Window.partitionBy("digest")))
    )
    return save(merged.withColumn("norm", F.when(F.col("variants") > 1, F.col("norm"))), "exact-winners")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``row`` (all columns), ``id, digest, w_keep, w_size, kept`` of every row."""
    if salts is None:
        salts = SALTS + docs.select(F.count("*")).first()[0] // SALT_ROWS
    won = winners(docs, id_col, text_col, salts, digest)
    keys = won.select(F.col("digest").alias("w_digest"), F.explode("salts").alias("w_salt"), F.col("keep_id").alias("w_keep"), F.col("group_size").alias("w_size"), F.array_min("salts").alias("w_first"), F.col("norm").alias("w_norm"))
    norm = ascii_lower(text_or_empty(docs[text_col]))
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), digest(norm).alias("digest"), _salt(docs, id_col, salts).alias("salt"))
    on = (F.col("digest") == F.col("w_digest")) & (F.col("salt") == F.col("w_salt"))
    if won.filter("variants > 1").limit(1).count():
        on = on & (F.col("w_norm").isNull() | (F.col("w_norm") == ascii_lower(text_or_empty(F.col(f"row.`{text_col}`")))))
    # Rows that repeat an id and text have one salt, so this window needs no shuffle of its own; of null ids, the first salt's stay.
    first = F.row_number().over(Window.partitionBy("digest", "salt", "id", "w_norm").orderBy(F.lit(1)))
    kept = F.col("id").eqNullSafe(F.col("w_keep")) & (F.col("id").isNotNull() | (F.col("salt") == F.col("w_first"))) & (first == 1)
    return left.join(keys.hint("merge"), on).withColumn("kept", kept)


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row with ``dup_digest, dup_keep_id, dup_group_size, dup_kept``; its own columns come first, unchanged."""
    name = "dup"
    while any(c.lower().startswith(f"{name}_") for c in docs.columns):
        name = f"_{name}"
    out = judged(docs, id_col, text_col, salts, digest)
    return out.select("row.*", F.col("digest").alias(f"{name}_digest"), F.col("w_keep").alias(f"{name}_keep_id"), F.col("w_size").alias(f"{name}_group_size"), F.col("kept").alias(f"{name}_kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return judged(docs, id_col, text_col, salts, digest).filter("kept").select("row.*")
