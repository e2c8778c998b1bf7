"""Quality classifier: document statistics, random Fourier features, ridge scores, isotonic calibration.

Statistics of the whole text (shares of letter cases, digits and symbols, word lengths, repetition of words,
lines and word sequences) are standardised and mapped to cosine features whose inner products approximate a
Gaussian kernel. Each partition sums its part of the normal equations; the sums, ``features`` squared numbers
whatever the input, are added up in Spark and solved on the driver. Calibration: another part of the labelled
rows is scored, scores are rounded to 1/``BINS`` and counted in Spark, and pool-adjacent-violators runs over at
most that many points.

Learning uses the rows whose crc32(doc_id as text) mod 3 is 0 (ridge) or 2 (calibration), ``FIT_ROWS`` of them at
most, chosen by hash; remainder 1 is held out. The input of a score is the text alone.

Cases: null and empty texts have all statistics 0 and get the score that the model gives these; a null doc_id
is scored and never learned from; labels that repeat or contradict each other count each; with no labels of one
of the kinds, every score is the share of label 1 (0.5 with none at all) - nothing is rejected without labels.
Further columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .packing import slices

BINS = 4096
FEATURES = 256
N_STATS = 20
FIT_ROWS = 300_000  # labelled rows that a model learns from: a bounded sample, small enough to broadcast
KNOWN = "__sparkutter_known"


@cache
def _classes() -> np.ndarray:
    """Of each code point: 0 other, 1 lower, 2 upper, 3 other letter, 4 digit, 5 space, 6 sentence mark, 7 symbol."""
    import unicodedata

    out = np.zeros(0x110000, np.uint8)
    for c in range(0x30000):
        kind = unicodedata.category(chr(c))
        out[c] = {"Ll": 1, "Lu": 2, "Lt": 2, "Lo": 3, "Lm": 3, "Nd": 4, "Zs": 5}.get(kind, 7 if kind[0] in "PS" else 0)
    out[[9, 10, 11, 12, 13]] = 5
    out[[ord(c) for c in ".,;:?'\"-"]] = 6
    return out


def statistics(text: str) -> list[float]:
    """The ``N_STATS`` numbers of a text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_STATS
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_classes()[codes], minlength=8)
    letters, shown = max(1, int(kinds[1:4].sum())), max(1, len(codes) - int(kinds[5]))
    counts = Counter(words)
    most = counts.most_common(1)[0][1]
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = list(zip(words, words[1:], strict=False))
    same = sum(a == b for a, b in pairs)
    runs = len(set(zip(words, words[1:], words[2:], words[3:], strict=False)))
    lengths = np.fromiter(map(len, words), np.int64, n)
    marked = sum(w[-1] in "#$%&*!" for w in words)
    bare = sum(not any(map(str.isalnum, w)) for w, k in counts.items() if len(w) <= 3 for _ in range(k))
    stops = sum(k for w, k in counts.items() if len(w) <= 3)
    return [
        float(x)
        for x in (
            np.log1p(n) / 10, kinds[2] / letters, kinds[4] / shown, kinds[7] / shown, kinds[6] / shown, kinds[0] / shown,
            kinds[3] / letters, min(lengths.mean(), 30) / 10, min(lengths.std(), 30) / 10, min(lengths.max(), 100) / 100, len(counts) / n, most / n,
            same / n, runs / max(1, n - 3), 1 - len(set(lines)) / len(lines), min(len(lines) / n, 1), marked / n, bare / n,
            stops / n, sum(w[-1] in ".?" for w in words) / n,
        )
    ]


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the statistics, of each row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                x = np.array([statistics(t or "") for t in texts[a:b]], float)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """The fitted classifier; ``steps`` are the calibration's (from, value) pairs."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: list[tuple[float, float]]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        z = np.clip(z, -8, 8) @ self.directions + self.phases
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.steps:
            return np.full(len(x), 0.5)
        at = np.array([s for s, _ in self.steps])
        value = np.array([v for _, v in self.steps])
        return value[np.clip(np.searchsorted(at, self.raw(x), side="right") - 1, 0, len(at) - 1)]


def isotonic(points: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Pool adjacent violators over (score, sum of labels, weight) in order of score."""
    blocks: list[list[float]] = []
    for s, y, w in sorted(points):
        blocks.append([s, y, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, y2, w2 = blocks.pop()
            blocks[-1][1] += y2
            blocks[-1][2] += w2
    return [(s, y / w) for s, y, w in blocks]


def remainder(id_col) -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3))


def learned_from(labels: DataFrame, *, label: str = "quality", rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, ``label`` of the labels that a model learns from: all with remainder 0 or 2, but ``rows`` at most, chosen by hash."""
    sound = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label).filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id") != 1))
    return sound.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(rows)


def fit(stats: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = FIT_ROWS, features: int = FEATURES, width: float = 2.5, ridge: float = 1e-3, seed: int = 17) -> Model:
    """Learn from rows of ``stats`` (a written table) with a 0/1 ``label`` and remainder 0 or 2."""
    y = learned_from(labels, label=label, rows=rows).select("doc_id", F.col(label).cast("double").alias("y"))
    rows = materialize(stats.join(F.broadcast(y), "doc_id").withColumn("r", remainder("doc_id")).select("x", "y", "r"))
    moments = rows.filter("r = 0").select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    mean, scale = np.zeros(N_STATS), np.ones(N_STATS)
    for m in moments:
        mean[m["k"]], scale[m["k"]] = m["m"], max(m["s"] or 0.0, 1e-3)
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(size=(N_STATS, features)) / (width * np.sqrt(N_STATS / 4)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), [])
    size = features + 1

    def sums(batches):
        total = np.zeros((size, size + 2))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, N_STATS)
            t = np.array(batch.column(1).to_pylist(), float)
            if len(x):
                f = model.features(x)
                total[:, :size] += f.T @ f
                total[:, size] += f.T @ t
                total[0, size + 1] += len(t)
        if total[0, size + 1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["k", "v"])

    parts = rows.filter("r = 0").select("x", "y").mapInArrow(sums, "k int, v array<double>")
    # Rows of the partition sums meet by row number: size x (size + 2) numbers reach the driver.
    merged = parts.select("k", F.posexplode("v").alias("j", "v")).groupBy("k", "j").agg(F.sum("v").alias("v")) if features <= 32 else parts.groupBy("k").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(size + 2)]).alias("v")).select("k", F.posexplode("v").alias("j", "v"))
    gram = np.zeros((size, size + 2))
    for batch in merged.toArrow().to_batches():
        gram[batch.column("k").to_numpy(), batch.column("j").to_numpy()] = batch.column("v").to_numpy()
    n = gram[0, size + 1]
    if n:
        model.weights = np.linalg.solve(gram[:, :size] + ridge * n * np.eye(size) / size, gram[:, size])

    def rated(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, N_STATS)
            s = np.round(np.clip(model.raw(x), -1, 2) * (BINS / 3)) / (BINS / 3) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.float64()), batch.column(1)], ["s", "y"])

    which = "r = 2" if n else "r <> 1"
    points = rows.filter(which).select("x", "y").mapInArrow(rated, "s double, y double").groupBy("s").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).collect()
    model.steps = isotonic([(p["s"], p["y"], p["n"]) for p in points])
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of a statistics table."""

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS, **options) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns, without moving a text.

    The model needs the statistics of the labelled rows only; those of all rows are taken as they are judged.
    """
    labels = learned_from(labels, rows=rows)
    known = docs.join(F.broadcast(labels.select(F.col("doc_id").alias(KNOWN)).distinct()), docs[id_col].cast("long") == F.col(KNOWN), "left_semi")
    model = fit(materialize(statistics_table(known, id_col=id_col, text_col=text_col)), labels, rows=rows, **options)
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            for a, b in slices(texts):
                x = np.array([statistics(t or "") for t in texts[a:b]], float)
                yield batch.slice(a, b - a).filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(statistics_table(table(spark, sf_dir, "documents")))
    model = fit(stats, table(spark, sf_dir, "labels"))
    return scored(stats, model).select(
        "doc_id", (remainder("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
