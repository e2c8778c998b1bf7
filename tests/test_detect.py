"""Repeats, detectors and spans on small sentences."""

import pytest
from pyspark.sql import functions as F

from sparkutter.functions import text as X
from sparkutter.functions.lexicon import Lexicon
from sparkutter.operators import detect, evaluate, repeats
from sparkutter.operators import tokens as K

LEX = Lexicon.indonesian()


def sentence(spark, words, gap=0.04, length=0.30, uid="u"):
    rows, now = [], 0.5
    for i, w in enumerate(words):
        word, label = w if isinstance(w, tuple) else (w, "O")
        rows.append((uid, i, word, round(now, 3), round(now + length, 3), label))
        now += length + gap
    table = spark.createDataFrame(rows, "uid string, i int, raw string, start double, end double, label string")
    return table.withColumn("w", X.canonical(F.col("raw")))


def labels(table, name="pred"):
    return [r[name] for r in table.orderBy("i").collect()]


def rules(spark, text, **options):
    return labels(detect.rule_labels(sentence(spark, text.split(), **options), LEX))


def test_example(spark):
    texts = spark.createDataFrame([("a", "eee jadi saya saya mau bertanya")], "uid string, text string")
    rows = K.neutral_times(K.explode_words(texts))
    out = detect.rule_labels(rows, LEX, unit=1000)
    assert labels(out) == ["FP", "DM", "REP", "O", "O", "O"]
    assert [(r["start"], r["end"]) for r in rows.orderBy("i").limit(3).collect()] == [(250, 395), (525, 755), (885, 1115)]
    assert K.clean_text(out, "pred", cut=K.CONSERVATIVE).first()["clean"] == "jadi saya mau bertanya"


@pytest.mark.parametrize(
    "text,expected",
    [
        ("saya mau ke pasar eh ke toko", "O O RPR RPR RPR O O"),
        ("filenya di folder unduhan eh di folder dokumen", "O RPR RPR RPR RPR O O O"),
        ("aa maksud saya bukan begitu arahnya", "FP O O O O O"),
        ("ya saya setuju sekali", "O O O O"),
        ("apa yang kamu maksud", "O O O O"),
        ("gitu saja sudah cukup", "O O O O"),
        ("eee ya jadi begini", "FP DM DM O"),
        ("sa- sapi itu", "PW O O"),
        ("apa ya namanya itu loh bagus", "DM DM DM DM DM O"),
    ],
)
def test_rules(spark, text, expected):
    assert rules(spark, text) == expected.split()


def test_runs_and_evidence(spark):
    found = repeats.events(sentence(spark, "yang yang yang".split()), LEX).orderBy("i").collect()
    assert [(r["i"], r["j"], r["run_length"], r["verdict"]) for r in found] == [(0, 1, 3, "disfluency"), (1, 2, 3, "disfluency")]
    one = lambda word, gap: repeats.events(sentence(spark, [word, word], gap=gap), LEX).first()
    assert one("anak", 0.30)["verdict"] == "reduplication"
    assert one("saya", 0.01)["verdict"] == "disfluency"
    gaps = spark.createDataFrame([(0.01,), (0.35,), (0.13,)], "g double")
    score = repeats.total(repeats.evidence(F.lit("peneliti"), F.col("g"), None, None, F.lit(2), LEX))  # lengths unknown
    assert [r[0] for r in gaps.select(repeats.verdict(score)).collect()] == ["reduplication", "disfluency", "ambiguous"]
    scores = [one("peneliti", g / 100)["score"] for g in range(0, 40, 13)]
    assert scores == sorted(scores, reverse=True)
    assert one("eee", 0.1)["reasons"][0] == "filler_repeated"


def test_naive_and_empty_words(spark):
    rows = sentence(spark, ["!!", "??", "ini", "ini"])
    assert labels(detect.naive_labels(rows, LEX)) == ["REP", "O", "REP", "O"]
    assert repeats.events(rows, LEX).count() == 1
    assert detect.rule_labels(rows.limit(0), LEX).count() == 0


def test_long_chain_of_phrases(spark):
    """Overlapping phrases are taken from the left, however long the chain."""
    words = "ya kan gitu ya kan gitu loh gitu kan".split()
    out = detect.mark_phrases(sentence(spark, words), LEX).orderBy("i").collect()
    taken, i = [False] * len(words), 0
    while i < len(words):
        n = out[i]["phrase_n"] if out[i]["phrase_cat"] == "discourse_marker" else None
        if n:
            taken[i : i + n] = [True] * n
        i += n or 1
    assert [r["in_marker"] for r in out] == taken


def test_spans_and_scores(spark):
    gold = [("eee", "FP"), ("saya", "O"), ("mau", "O")]
    rows = sentence(spark, gold).withColumn("pred", F.lit("O"))
    counts = {(r["gold"], r["pred"]): r["n"] for r in evaluate.confusion(rows).collect()}
    assert counts == {("FP", "O"): 1, ("O", "O"): 2}
    per = {r["label"]: r for r in evaluate.per_label(evaluate.confusion(rows)).collect()}
    assert per["FP"]["fn"] == 1 and per["O"]["fp"] == 1 and per["FP"]["f1"] == 0.0
    redup = sentence(spark, ["anak", "anak", "mandiri"]).withColumn("pred", F.when(F.col("i") == 0, "REP").otherwise("O"))
    r = evaluate.token_counters(redup, LEX).first()
    assert (r["redup"], r["redup_cut"], r["binary_fp"]) == (2, 1, 1)
    s = evaluate.summary(redup.withColumn("system", F.lit("x")), LEX, ["system"]).first()
    assert s["redup_kept"] == 0.5 and s["accuracy"] == pytest.approx(2 / 3)
    spans = K.label_spans(sentence(spark, [("a", "FP"), ("b", "FP"), ("c", "O"), ("d", "FP"), ("e", "PW")])).orderBy("i").collect()
    assert [(x["label"], x["i"], x["j"], x["text"]) for x in spans] == [("FP", 0, 2, "a b"), ("FP", 3, 4, "d"), ("PW", 4, 5, "e")]
    context = evaluate.errors(rows).first()
    assert context["context"] == "[eee] saya mau"


def test_folds_partition(spark):
    rows = spark.createDataFrame([(f"seed-{i:04d}",) for i in range(1, 168)], "uid string")
    assert [r["count"] for r in K.folds(rows).groupBy("fold").count().orderBy("fold").collect()] == [37, 30, 34, 26, 40]
    assert K.split(rows).filter("is_test").count() == 56
    held = {r["held"]: r["n"] for r in K.training_folds(rows).groupBy("held").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert held == {0: 130, 1: 137, 2: 133, 3: 141, 4: 127}
