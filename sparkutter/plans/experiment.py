"""The experiment: rule systems and perceptrons with fewer and more features, over k folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..operators import detect, evaluate, perceptron
from ..operators.features import Families, featurize
from ..operators.tokens import folds

ABLATIONS = {
    "perceptron lex": Families(True, False, False),
    "perceptron lex+pros": Families(True, True, False),
    "perceptron lex+redup": Families(True, False, True),
    "perceptron pros+redup": Families(False, True, True),
    "perceptron full": Families(True, True, True),
}


def predictions(tokens: DataFrame, lex: Lexicon, k: int = 5, epochs: int = 15, seed: int = 13, systems: dict[str, Families] | None = None) -> DataFrame:
    """``tokens`` with system and pred: every token once for each system, by a model that has not seen its fold.

    All models of all systems and folds train in one Spark job, each in a task of its own.
    """
    rows = folds(tokens, k)
    out = detect.naive_labels(rows, lex).withColumn("system", F.lit("naive")).unionByName(detect.rule_labels(rows, lex).withColumn("system", F.lit("rules")))
    featured = None
    for name, families in (ABLATIONS if systems is None else systems).items():
        part = featurize(rows, lex, families).withColumn("system", F.lit(name))
        featured = part if featured is None else featured.unionByName(part)
    if featured is None:
        return out
    others = F.filter(F.array(*[F.lit(x) for x in range(k)]), lambda x: x != F.col("fold"))
    learn = featured.select("*", F.explode(others).alias("held"))
    models = perceptron.fit_models(learn, ["system", "held"], epochs=epochs, seed=seed)
    tested = perceptron.predict_groups(featured.withColumn("held", F.col("fold")), models, ["system", "held"])
    return out.unionByName(tested.drop("held"))


def results(tokens: DataFrame, lex: Lexicon, **options) -> DataFrame:
    """One row for each system with all scores over all folds."""
    return evaluate.summary(predictions(tokens, lex, **options), lex, ["system"])
