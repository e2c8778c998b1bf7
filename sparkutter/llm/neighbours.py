"""Approximate nearest neighbours by cosine: inverted lists with an adaptive scan over rotated dimensions.

Identical vectors are one candidate with its smallest ids, as many as a result can hold. Vectors are divided
into lists by the nearest of ``K`` directions, fitted by spherical k-means on a bounded sample (``SAMPLE``
rows, chosen by hash of the id). A query probes the lists of its nearest directions, as many as it takes for
``TARGET`` of the true neighbours in the sample: few where vectors cluster, more than half where they do not. At
full size neighbours are nearer than in the sample, so that is on the safe side. Within a list, unit
vectors are multiplied by one random rotation, so that any block of columns is a fair sample of a distance.
The scan adds up squared differences block by block. After d of D columns a candidate whose scaled partial
distance exceeds the threshold (the k-th best exact distance so far in this list) by more than a factor
1 + EPSILON / sqrt(d) is abandoned: the test of the hypothesis that it is no nearer than the threshold. The
survivors of all blocks get their exact cosine, in double precision, from the vectors as they are.

Lists are divided into parts of ``PART`` rows, dealt by hash, which a query scans all: a large list is many
small tasks. K grows with the table (``PER_LIST`` rows a list) up to ``MOST_LISTS``.

Cases: vectors that are null, zero, or hold a null or non-finite component take no part, neither as query nor
as candidate; vectors of different lengths are not compared, each length is a search of its own; a null id takes
no part; rows that repeat an id are distinct rows with that id; a query with fewer candidates gets them all, one
with none has no row; an empty table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

SAMPLE = 20_000
PER_LIST = 1000
MOST_LISTS = 4096
PART = 4096
BLOCK = 16
EPSILON = 2.1
TARGET = 0.97
TRIALS = 400


def fit_directions(sample: np.ndarray, k: int, seed: int = 7, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([np.argmax(sample[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, target: float, trials: int = TRIALS) -> int:
    """How many of its nearest lists a query needs for a share of ``target`` of its k neighbours in the sample."""
    queries = sample[:trials]
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    home = np.argmax(sample[np.unique(true)] @ centres.T, axis=1)
    home = home[np.searchsorted(np.unique(true), true)]
    rank = np.argsort(np.argsort(-(queries @ centres.T), axis=1), axis=1)
    need = np.sort(np.take_along_axis(rank, home, axis=1).ravel())
    return int(need[int(np.ceil(target * len(need))) - 1]) + 1


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def scan(queries: np.ndarray, rows: np.ndarray, turn: np.ndarray, k: int, epsilon: float = EPSILON, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(query number, row number) of the pairs that may be among the query's k nearest rows.

    While many pairs are alive a block is one matrix product for all; later it is added for the living alone.
    """
    a, x = (unit(queries) @ turn).astype(np.float32), (unit(rows) @ turn).astype(np.float32)
    dim, (m, n) = x.shape[1], (len(a), len(x))
    every = np.repeat(np.arange(m), n), np.tile(np.arange(n), m)
    if n <= k:
        return every
    part = np.zeros((m, n), np.float32)
    limit, alive = None, None
    for begin in range(0, dim, block):
        end = min(dim, begin + block)
        qa, xa = a[:, begin:end], x[:, begin:end]
        if alive is None:
            part += (qa * qa).sum(axis=1)[:, None] + (xa * xa).sum(axis=1) - 2 * (qa @ xa.T)
        else:
            part += ((qa[alive[0]] - xa[alive[1]]) ** 2).sum(axis=1)
        if limit is None:
            # The threshold: exact distances of the k rows that look nearest in the first block.
            first = np.argpartition(part, k - 1, axis=1)[:, :k]
            limit = ((x[first] - a[:, None, :]) ** 2).sum(axis=2).max(axis=1)
        # Single precision leaves a slack.
        factor = (1 + epsilon / np.sqrt(end)) ** 2 if end < dim else 1.0
        if alive is None:
            keep = part * (dim / end) <= (limit * factor + 1e-4)[:, None]
            if end == dim or keep.mean() < 0.3:
                alive = np.nonzero(keep)
                part = part[alive]
        else:
            keep = part * (dim / end) <= limit[alive[0]] * factor + 1e-4
            alive, part = (alive[0][keep], alive[1][keep]), part[keep]
    return alive


def nearest(vectors: DataFrame, *, every: int = 50, k: int = 5, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = materialize(raw.filter(F.col("vec_id").isNotNull()).filter(F.coalesce(sound, F.lit(False))))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n, (dim, total) in enumerate(sizes):
        part = _nearest_of(rows.filter(F.size("v") == dim), dim, total, every, k, target)
        found = found.union(part) if n else part
    return found


def _nearest_of(rows: DataFrame, dim: int, total: int, every: int, k: int, target: float) -> DataFrame:
    """nearest() over the ``total`` sound rows (vec_id, v) of one dimension."""
    # One candidate for all rows of one vector: a result holds k + 1 of them at most, the query itself among them.
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    distinct = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cand", F.col("ids")[0]))
    lists = max(1, min(MOST_LISTS, total // PER_LIST))
    sample = distinct.orderBy(F.xxhash64("cand")).limit(SAMPLE).select("v").toArrow()["v"]
    learn = unit(np.array(sample.to_pylist(), float).reshape(-1, dim))
    centres, turn = fit_directions(learn, lists), rotation(dim)
    probes = probes_needed(learn, centres, k, target)

    def assign(many: int):
        def run(batches):
            for batch in batches:
                x = np.array(batch.column("v").to_pylist(), float).reshape(-1, dim)
                if len(x):
                    near = unit(x) @ centres.T
                    n = min(many, near.shape[1])
                    at = np.argpartition(-near, n - 1, axis=1)[:, :n]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(at.astype(np.int32)), pa.list_(pa.int32()))], [*batch.schema.names, "lists"])

        return run

    candidates = distinct.select("cand", "v", "ids").mapInArrow(assign(1), "cand long, v array<double>, ids array<bigint>, lists array<int>")
    candidates = materialize(candidates.select("cand", "v", "ids", F.col("lists")[0].alias("list")))
    parts = candidates.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("of"))
    deal = F.pmod(F.xxhash64("cand"), F.col("of")).cast("int")
    members = candidates.join(F.broadcast(parts), "list").select("list", deal.alias("part"), "cand", "v", "ids")  # at most MOST_LISTS rows
    asked = rows.filter(F.col("vec_id") % every == 0)
    # Queries of one vector are one, too.
    asked = asked.groupBy("v").agg(F.min("vec_id").alias("ask"))
    asked = materialize(asked.select("ask", "v").mapInArrow(assign(probes), "ask long, v array<double>, lists array<int>"))
    probing = asked.select("ask", "v", F.explode("lists").alias("list")).join(F.broadcast(parts), "list")
    probing = probing.select("list", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("part"), "ask", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(left) and len(right):
            asks, q, x = left["ask"].to_numpy(), np.array(left["v"].to_list(), float), np.array(right["v"].to_list(), float)
            lengths = [np.sqrt((v * v).sum(axis=1)) for v in (q, x)]
            ids = right["ids"].to_list()
            step = max(1, 2_000_000 // len(x))
            for at in range(0, len(q), step):
                number, row = scan(q[at : at + step], x, turn, k + 1)
                number = number + at
                scores = (x[row] * q[number]).sum(axis=1) / (lengths[1][row] * lengths[0][number])
                order = np.lexsort((-scores, number))
                number, row, scores = number[order], row[order], scores[order]
                first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
                counts = np.diff(np.append(first, len(number)))
                worst = scores[first + np.minimum(counts, k + 1) - 1]
                keep = scores >= np.repeat(worst, counts)  # with ties
                number, row, scores = number[keep], row[keep], scores[keep]
                times = np.array([len(ids[r]) for r in row.tolist()], np.int64)
                out.append((np.repeat(asks[number], times), np.array([i for r in row.tolist() for i in ids[r]], np.int64), np.repeat(scores, times)))
        return pd.DataFrame(dict(zip(("ask", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = probing.groupBy("list", "part").cogroup(members.groupBy("list", "part")).applyInPandas(search, "ask long, vec_id long, score double")
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    named = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").join(asked.select("ask", "v"), "v").select("query_id", "ask")
    found = named.join(found, "ask").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
