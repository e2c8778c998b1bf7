"""A structured perceptron for token labels: averaged weights, first-order Viterbi decoding.

Training is sequential by nature, so each model trains in one Python task, and models (systems by folds) train
side by side with applyInPandas. Decoding is a pandas function over whole utterances with the weights, whose
size is that of the training vocabulary, in its closure.
"""

from __future__ import annotations

import json
import random
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import Families
from .tokens import KEY, LABELS

NONE = len(LABELS)  # the state before the first token


@dataclass
class Weights:
    """features[name] is a row of ``emit``; ``move[a, b]`` is for label b after a (the last a: none)."""

    features: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros((0, len(LABELS))))
    move: np.ndarray = field(default_factory=lambda: np.zeros((NONE + 1, len(LABELS))))
    history: list[float] = field(default_factory=list)

    def rows(self, names: list[str]) -> np.ndarray:
        return np.array([self.features[n] for n in names if n in self.features], int)

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "emit": self.emit.tolist(), "move": self.move.tolist(), "history": self.history})

    @classmethod
    def from_json(cls, text: str) -> Weights:
        d = json.loads(text)
        return cls(d["features"], np.array(d["emit"]).reshape(-1, len(LABELS)), np.array(d["move"]), d["history"])


def viterbi(sentence: list[np.ndarray], emit: np.ndarray, move: np.ndarray) -> list[int]:
    """The best label sequence; the earlier label wins ties."""
    if not sentence:
        return []
    best, back = emit[sentence[0]].sum(axis=0) + move[NONE], []
    for rows in sentence[1:]:
        paths = best[:, None] + move[:NONE]
        came = paths.argmax(axis=0)
        back.append(came)
        best = paths[came, np.arange(NONE)] + emit[rows].sum(axis=0)
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    return path[::-1]


def train(sentences: list[list[list[str]]], gold: list[list[str]], epochs: int = 15, seed: int = 13) -> Weights:
    """Sentences are lists of tokens' feature lists.

    Averages come from a second sum, in which an update at step s counts s times: the mean over all steps of a
    weight is its final value minus that sum over the number of steps.
    """
    names: dict[str, int] = {}
    data = [[np.array([names.setdefault(f, len(names)) for f in token], int) for token in s] for s in sentences]
    labels = [[LABELS.index(x) for x in g] for g in gold]
    emit, move = np.zeros((len(names), NONE)), np.zeros((NONE + 1, NONE))
    late_emit, late_move = np.zeros_like(emit), np.zeros_like(move)
    rng, order, steps, history = random.Random(seed), list(range(len(data))), 0, []
    for _ in range(epochs):
        rng.shuffle(order)
        wrong = total = 0
        for k in order:
            if not labels[k]:
                continue
            steps += 1
            truth, guess = labels[k], viterbi(data[k], emit, move)
            total += len(truth)
            if truth == guess:
                continue
            before = (NONE, NONE)
            for rows, t, g in zip(data[k], truth, guess, strict=True):
                if t != g:
                    wrong += 1
                    for label, sign in ((t, 1.0), (g, -1.0)):
                        np.add.at(emit, (rows, label), sign)
                        np.add.at(late_emit, (rows, label), sign * steps)
                if (before[0], t) != (before[1], g):
                    for place, sign in (((before[0], t), 1.0), ((before[1], g), -1.0)):
                        move[place] += sign
                        late_move[place] += sign * steps
                before = (t, g)
        history.append(wrong / total if total else 0.0)
    n = max(1, steps)
    # In whole numbers before the division, so that a mean of 0 is exactly 0.
    return Weights(names, (steps * emit - late_emit) / n, (steps * move - late_move) / n, history)


def sentences_of(pdf: pd.DataFrame, key: list[str]) -> list[pd.DataFrame]:
    order = [c for c in ("fold", "utt_seq") if c in pdf.columns] + [*key, "i"]
    pdf = pdf.sort_values(order, kind="stable")
    return [g for _, g in pdf.groupby([c for c in order if c != "i"], sort=False)]


def fit_models(rows: DataFrame, by: list[str], key: list[str] = KEY, epochs: int = 15, seed: int = 13) -> DataFrame:
    """by, weights (JSON), history of each group of ``rows`` (features, label, utt_seq, i).

    Sentences come in the order of (fold, utt_seq): shuffling permutes places, so the order matters.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = sentences_of(pdf, key)
        model = train([[list(f) for f in p["features"]] for p in parts], [list(p["label"]) for p in parts], epochs, seed)
        return pdf[by].head(1).assign(weights=model.to_json(), history=[model.history])

    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in by)
    return rows.groupBy(*by).applyInPandas(one, f"{kinds}, weights string, history array<double>")


def emissions(rows: DataFrame, model: Weights, key: list[str] = KEY) -> DataFrame:
    """key, i, label, score: of each token and label, the sum of its features' weights, by a join with the weights."""
    spark = rows.sparkSession
    named = [(f, LABELS[j], float(model.emit[i, j])) for f, i in model.features.items() for j in range(NONE)]
    weights = spark.createDataFrame(named, "feature string, label string, weight double")
    known = rows.select(*key, "i", F.explode("features").alias("feature")).join(weights, "feature")
    return known.groupBy(*key, "i", "label").agg(F.sum("weight").alias("score"))


def predict_groups(rows: DataFrame, models: DataFrame, by: list[str], key: list[str] = KEY, parts: int = 8) -> DataFrame:
    """``rows`` (with features) and pred, each group of ``by`` by its own model, in ``parts`` tasks, to which utterances are dealt."""
    out = [c for c in rows.columns if c != "features"]
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)))
    models = models.withColumn("_part", F.explode(F.array(*[F.lit(x).cast("long") for x in range(parts)])))

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left[out].assign(pred="O")
        model = Weights.from_json(right["weights"].iloc[0])
        parts = [label_part(p, model) for p in sentences_of(left, key)]
        return pd.concat(parts)[[*out, "pred"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in out) + ", pred string"
    return rows.groupBy(*by, "_part").cogroup(models.groupBy(*by, "_part")).applyInPandas(one, schema)


def label_part(part: pd.DataFrame, model: Weights) -> pd.DataFrame:
    path = viterbi([model.rows(list(f)) for f in part["features"]], model.emit, model.move)
    return part.assign(pred=[LABELS[x] for x in path])


def predict(rows: DataFrame, model: Weights, key: list[str] = KEY) -> DataFrame:
    """``rows`` (with features) and pred, for one model: utterances in Arrow batches, as many tasks as there are partitions."""
    sentences = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "features"))).alias("s"))

    def run(frames):
        for pdf in frames:
            pred = [[LABELS[x] for x in viterbi([model.rows(list(t["features"])) for t in s], model.emit, model.move)] for s in pdf["s"]]
            yield pdf.drop(columns="s").assign(pred=pred)

    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in key)
    found = sentences.mapInPandas(run, f"{kinds}, pred array<string>")
    found = found.select(*key, F.posexplode("pred").alias("i", "pred"))
    return rows.drop("features").join(found, [*key, "i"])


def save_model(path: str, model: Weights, families: Families = Families(), name: str = "perceptron") -> None:
    """One JSON file: the name, which feature families the model was trained on, its history and weights."""
    whole = {"name": name, "config": asdict(families), "train_history": model.history, "model": json.loads(model.to_json())}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(whole, f, ensure_ascii=False)


def load_model(path: str) -> tuple[Weights, Families, str]:
    """The model, the families to decode with, and its name."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    return Weights.from_json(json.dumps(whole["model"])), Families(**whole.get("config", {})), whole.get("name", "perceptron")


def weight_table(model: Weights) -> list[tuple[str, str, float]]:
    """(feature, label, weight) of every weight that is not 0."""
    names = sorted(model.features, key=model.features.get)
    return [(names[i], LABELS[j], float(model.emit[i, j])) for i, j in zip(*np.nonzero(model.emit), strict=True)]
