"""Sharding by histogram sort: contiguous ranges of one key order, with near equal bytes.

The key of a row is the pair (hash of its text, hash of its id), 128 bits, so that equal texts lie side by
side and only a shard boundary inside a group of copies splits them. Each round counts the exact rows and
bytes below candidate boundaries: 256 probes split every key range that is still too coarse, namely one that
holds a splitter and more bytes than the tolerance, or one with more rows than a task should sort. All other
ranges are settled. When every splitter meets the tolerance, the rows are exchanged once, by range; a row's
slot is the number of rows before its range within the shard plus its rank inside the range.

A range is as large as a task should sort (``LEAF_ROWS``), or, in very large tables, a ``MOST_LEAVES``th of all rows.
So fewer than ``MOST_LEAVES + shards`` ranges are split in a round, whatever the table's size: 256 times as many
counters reach the driver and as many ranges, about a million, are broadcast at most.

Cases: a null text has no bytes and counts as empty, a null id is a value of its own, rows that repeat both id
and text are interchangeable and lie side by side, an empty table gives an empty result, other columns are
ignored whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, table

DEPTH = 16  # bytes of a key
LEAF_ROWS = 2_000_000
MOST_LEAVES = 4096


def key_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and the key as 32 hexadecimal digits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.concat(digits(F.xxhash64(text)), digits(F.xxhash64(F.lit(1), F.col(id_col)))).alias("key"),
    )


def histogram(keys: DataFrame, shards: int, tolerance: float, leaf_rows: int | None = None) -> list[tuple[str, int, int]]:
    """The settled ranges in key order, each (prefix, rows, bytes); ``tolerance`` is a share of a shard's bytes."""
    counts = lambda df, depth: [(r["p"], r["n"], r["b"]) for r in df.groupBy(F.substring("key", 1, 2 * depth).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()]
    leaves = sorted(counts(keys, 1))
    rows, total = sum(x[1] for x in leaves), sum(x[2] for x in leaves)
    most = leaf_rows or max(1, min(LEAF_ROWS, -(-rows // 64)), rows // MOST_LEAVES)
    targets = [total * i / shards for i in range(1, shards)]
    for depth in range(2, DEPTH + 1):
        coarse, below = [], 0
        for p, n, b in leaves:
            holds = bisect_left(targets, below + 1e-9) < bisect_left(targets, below + b)
            if len(p) == 2 * depth - 2 and n > 1 and (n > most or holds and b > tolerance * total / shards):
                coarse.append(p)
            below += b
        if not coarse:
            break
        probes = keys.sparkSession.createDataFrame([(p,) for p in coarse], "q string")
        finer = counts(keys.join(F.broadcast(probes), F.substring("key", 1, 2 * depth - 2) == F.col("q"), "left_semi"), depth)
        gone = set(coarse)
        leaves = sorted([x for x in leaves if x[0] not in gone] + finer)
    return leaves


def plan(leaves: list[tuple[str, int, int]], shards: int) -> list[tuple[str, int, int]]:
    """(prefix, shard, rows of the shard before it): every splitter goes to the range boundary nearest to its target."""
    total = sum(b for _, _, b in leaves)
    edges, below = [0], 0
    for _, _, b in leaves:
        edges.append(below := below + b)
    cuts = []
    for i in range(1, shards):
        target = total * i / shards
        j = bisect_left(edges, target)
        if j == len(edges) or j and target - edges[j - 1] <= edges[j] - target:
            j -= 1
        cuts.append(max(j, cuts[-1] if cuts else 0))
    out, shard, before = [], 0, 0
    for k, (p, n, _) in enumerate(leaves):
        while shard < shards - 1 and k >= cuts[shard]:
            shard, before = shard + 1, 0
        out.append((p, shard, before))
        before += n
    return out


def shard_rows(docs: DataFrame, *, shards: int = 8, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text", leaf_rows: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, key, shard, slot of every row."""
    spark = docs.sparkSession
    keys = materialize(key_table(docs, id_col, text_col))
    placed = plan(histogram(keys, shards, tolerance, leaf_rows), shards)
    schema = T.StructType([T.StructField("leaf", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("before", T.LongType())])
    rows, names = keys, []
    for width in sorted({len(p) for p, _, _ in placed}):
        names.append(f"at_{width}")
        at = spark.createDataFrame([x for x in placed if len(x[0]) == width], schema)
        at = at.select(F.col("leaf").alias(f"p_{width}"), F.struct("leaf", "shard", "before").alias(names[-1]))
        rows = rows.join(F.broadcast(at), F.substring("key", 1, width) == F.col(f"p_{width}"), "left").drop(f"p_{width}")
    at = F.coalesce(*[F.col(n) for n in names]) if names else F.lit(None).cast(T.StructType(schema.fields))
    rows = rows.withColumn("at", at).select("doc_id", "size", "text_crc32", "key", "at.leaf", "at.shard", "at.before")
    order = Window.partitionBy("leaf").orderBy("key", "doc_id")
    return rows.withColumn("slot", F.col("before") + F.row_number().over(order) - 1).drop("leaf", "before")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write all columns of ``docs`` below ``path``, a folder ``shard=N`` for each shard (ids must be unique).

    Columns of theirs named shard or slot give way.
    """
    key = options.get("id_col", "doc_id")
    at = shard_rows(docs, **options).select(F.col("doc_id").alias("__sparkutter_id"), "shard", "slot")
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    docs.select(*names).join(at, F.col(key).eqNullSafe(F.col("__sparkutter_id"))).drop("__sparkutter_id").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents"), shards=8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
