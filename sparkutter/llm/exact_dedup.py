"""Exact deduplication by skew-safe combining.

Texts are equal when identical after normalisation (by default: none). Three stages, each comparing the full
content: rows are deduplicated inside their partition (the map side of an aggregate over digest, salt and
text), groups of one digest and salt are merged, and the winners of the salts are combined for all. A group of
copies that holds a third of all rows thus reaches the last stage as at most ``salts`` rows. The way back is
salted, too: a group's result goes to each of its (digest, salt) pairs, and every row finds it there.

Cases: a null text counts as an empty one, empty texts are equal to each other, a doc_id that occurs twice
with the same text is two rows of one group, a null doc_id loses to any other (rows
whose whole group has null ids are all marked kept), an empty table gives an empty
result. Input columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, spread_join, table


def _compared(text_col: str, normalise) -> Column:
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    return text if normalise is None else normalise(text)


def combined(rows: DataFrame, salts: int) -> DataFrame:
    """g, t, best (the largest) and n of each text of ``rows`` (g, t, doc_id)."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).groupBy("g", "salt", "t").agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("n"))
    # The winners of the salts: the digest and the whole text once more.
    return salted.groupBy("g", "t").agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise=None, digest=None, salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column to the one that is compared; ``digest`` maps it to a grouping digest
    (default xxhash64). Digests need not be free of collisions: content decides.
    """
    digest = digest or (lambda c: F.xxhash64(c))
    rows = docs.select(F.col(id_col).alias("doc_id"), _compared(text_col, normalise).alias("t")).withColumn("g", digest(F.col("t")))
    winners = combined(rows, salts).select("g", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), F.sha2("t", 256).alias("sha"))
    winners = materialize(winners)
    # The texts of one digest: one, but for collisions.
    doubtful = winners.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    keys = materialize(rows.select("doc_id", "g", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("salt")))
    back = lambda some: spread_join(some, winners, ["g"], F.col("salt"))
    if doubtful.isEmpty():
        named = back(keys)
    else:
        # Collisions: within such a digest the full text tells its groups apart.
        doubtful = materialize(doubtful)
        full = combined(rows.join(doubtful, "g", "left_semi"), salts)
        full = full.select("g", "t", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), F.sha2("t", 256).alias("sha"))
        named = back(keys.join(doubtful, "g", "left_anti")).select("doc_id", "keep_id", "group_size", "sha")
        named = named.unionByName(rows.join(full, ["g", "t"]).select("doc_id", "keep_id", "group_size", "sha"))
    return named.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise=None, digest=None, salts: int = 16) -> DataFrame:
    """One row of ``docs`` for each text, with all its columns: one with the largest id (nulls only among themselves).

    The columns of a text's best row go with it through the same stages, so nothing is joined back.
    """
    digest = digest or (lambda c: F.xxhash64(c))
    # A text that is compared as it is need not be carried twice.
    carried = [c for c in docs.columns if c != text_col or normalise is not None]
    rest = F.struct(F.col(text_col).isNull().alias("none"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carried)])
    order = F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))
    rows = docs.select(_compared(text_col, normalise).alias("t"), order.alias("order"), rest.alias("rest")).withColumns({"g": digest(F.col("t")), "salt": F.pmod(F.col("order.row"), F.lit(salts))})
    best = [F.max_by("rest", "order").alias("rest"), F.max("order").alias("order")]
    rows = rows.groupBy("g", "salt", "t").agg(*best).groupBy("g", "t").agg(*best)
    text = F.when(~F.col("rest.none"), F.col("t"))
    return rows.select(*[(F.col(f"rest.c{carried.index(c)}") if c in carried else text).alias(c) for c in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
