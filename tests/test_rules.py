"""Cases from reading, each against plain Python or a value worked out by hand."""

import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkutter.functions import text as X
from sparkutter.functions.lexicon import Lexicon
from sparkutter.operators import asr, audit, detect, evaluate, perceptron, repeats
from sparkutter.operators import tokens as K
from sparkutter.operators.features import Families, featurize
from sparkutter.plans import reports
from sparkutter.sources import corpora
from test_detect import sentence

LEX = Lexicon.build(ambiguous=("eh",), editing=("eh", "maaf", "maaf eh", "aduh eh maaf"), strong=("maaf", "eh"))


def said(spark, text):
    return sentence(spark, [(w, "O") for w in text.split()], gap=0.1)


def test_rounding_as_in_python(spark):
    rng = random.Random(5)
    values = [k / 2000 for k in range(1, 4001, 2)] + [rng.uniform(0, 1e5) for _ in range(2000)] + [rng.randint(0, 10**8) / 1000 + 0.0005 for _ in range(2000)] + [0.0, 0.0005, 2.5e-4, 86399.9995]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.fixed3(F.col("v")).alias("t"), X.round3(F.col("v")).alias("r")).collect()
    assert [(r["t"], r["r"]) for r in rows] == [(f"{r['v']:.3f}", round(r["v"], 3)) for r in rows]


def labels(spark, text):
    rows = detect.mark_phrases(said(spark, text), LEX)
    rows = detect.repair_windows(rows, LEX, F.lit(False))
    return [(r["i"], r["term_n"], r["reparandum_n"]) for r in rows.orderBy("i").collect() if r["term_n"]]


def test_a_term_inside_another_counts_no_more(spark):
    # "maaf eh" drops the word before it; "eh" inside it begins no repair, the later "maaf" has no word after it.
    assert labels(spark, "p q r maaf eh s t maaf") == [(3, 2, 1)]
    assert labels(spark, "p maaf q eh r") == [(1, 1, 1), (3, 1, 1)]
    assert labels(spark, "p aduh eh maaf q") == [(1, 3, 1)]


def test_all_words_of_a_term_but_the_last_are_flagged(spark):
    rows = featurize(said(spark, "p aduh eh maaf q r"), LEX, Families(True, False, False)).orderBy("i").collect()
    flag = lambda name: [next(f for f in r["features"] if f.startswith(name + "=")).split("=")[1] == "True" for r in rows]
    assert flag("in_reparandum") == [True, True, True, False, False, False]
    assert flag("is_editterm") == [False, False, False, True, False, False]
    assert flag("after_editterm") == [False, False, False, False, True, False]


def test_utterances_without_tokens_count(spark, tmp_path):
    lines = [{"uid": "a", "tokens": [{"text": "ya", "start": 0, "end": 0.5}], "meta": {"k": "v"}}, {"uid": "b", "tokens": [], "source": "x"}]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n \t\n")
    table = corpora.read_utterances(spark, str(tmp_path / "in.jsonl"))
    facts = K.describe(table).first()
    assert (facts["utterances"], facts["tokens"], facts["disfluent"]) == (2, 1, 0)
    assert corpora.words_only(table).count() == 1
    assert corpora.write_utterances(table, str(tmp_path / "out")) == 2
    back = {r["uid"]: r for r in corpora.read_utterances(spark, str(tmp_path / "out")).collect()}
    assert back["a"]["meta"] == {"k": "v"} and back["b"]["i"] is None and back["b"]["source"] == "x" and back["a"]["source"] == "seed"


@pytest.mark.parametrize("line", ['{"uid": "a", "tokens": [', "no json", '{"tokens": []}', '{"uid": "a"}'])
def test_a_bad_line_fails(spark, tmp_path, line):
    (tmp_path / "in.jsonl").write_text('{"uid": "a", "tokens": []}\n' + line + "\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        corpora.read_utterances(spark, str(tmp_path / "in.jsonl")).collect()


def test_white_space_around_lines(spark):
    lines = spark.createDataFrame([(0, "\t# comment"), (1, " \t "), (2, "\tya/FP saya "), (3, "/FP a/b/DM x/ZZ")], "seq long, value string")
    got = [(r["seq"], r["raw"], r["label"]) for r in corpora.annotated(lines).orderBy("seq", "i").collect()]
    assert got == [(2, "ya", "FP"), (2, "saya", "O"), (3, "/FP", "O"), (3, "a/b", "DM"), (3, "x/ZZ", "O")]


def test_bad_transcripts_fail(spark):
    files = spark.createDataFrame([("a", " \n[ {\"word\": \"x\", \"start\": 0, \"end\": 1}]"), ("b", "{\"words\": [{\"text\": \"y\"}]}")], "file string, json string")
    assert sorted((r["file"], r["text"]) for r in corpora.words_of_json(files).collect()) == [("a", "x"), ("b", "y")]
    with pytest.raises((PySparkException, Py4JJavaError)):
        corpora.words_of_json(spark.createDataFrame([("a", "{\"words\": [")], "file string, json string")).collect()


def test_both_units_give_the_same_verdicts(spark):
    lex = Lexicon.indonesian()
    rng = random.Random(3)
    rows, at = [], 0
    for i in range(600):
        start = at + rng.randint(-10, 250)
        at = start + rng.randint(30, 400)
        rows.append(("u", i, rng.choice(["anak", "saya", "eee"]), max(0, start), at))
    ms = spark.createDataFrame(rows, "uid string, i int, raw string, start long, end long").withColumn("w", X.canonical(F.col("raw")))
    sec = ms.withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000})
    a = {r["i"]: (r["verdict"], r["score"]) for r in repeats.events(ms, lex, unit=1000).collect()}
    b = {r["i"]: (r["verdict"], r["score"]) for r in repeats.events(sec, lex).collect()}
    assert set(a) == set(b) and len(a) > 100
    # Exactly at a threshold, a gap in seconds may fall on either side of it.
    assert sum(a[i][0] != b[i][0] for i in a) <= 2 and all(abs(a[i][1] / 1000 - b[i][1]) < 0.5 for i in a if a[i][0] == b[i][0])


def test_download_status(spark):
    rows = [(5, 5, "x", "present"), (5, 4, "x", "to-fetch"), (None, 4, "x", "present"), (None, None, "x", "to-fetch-unverified"), (5, None, "", "no-link"), (5, 5, None, "no-link")]
    got = spark.createDataFrame(rows, "size int, there int, address string, want string").select("want", corpora.download_status(F.col("size"), F.col("there"), F.col("address")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_models_remember_their_families(tmp_path):
    model = perceptron.train([[["a"], ["b"]]], [["O", "FP"]], epochs=2)
    perceptron.save_model(str(tmp_path / "m"), model, Families(True, False, True), "n")
    back, families, name = perceptron.load_model(str(tmp_path / "m"))
    assert back.to_json() == model.to_json() and families == Families(True, False, True) and name == "n"


def test_reports(spark, tmp_path):
    table = said(spark, "eh saya saya maaf saya pergi eh anak anak").withColumns({"file": F.lit("f"), "utt_seq": F.lit(0), "source": F.lit("s.wav")})
    text = reports.audit_report(table, LEX, ["file", "uid"])
    assert "eh(2)" in text and "| saya |" in text
    both = detect.naive_labels(table, LEX).withColumn("system", F.lit("naive"))
    paths = reports.write_experiment(both, LEX, str(tmp_path / "x"))
    assert json.loads(open(paths["json"]).read())["wrongly_cut"] and spark.read.json(paths["edl_json"]).count() == 1
    from sparkutter.operators.edl import EdlConfig

    lines = reports.render_commands(both, "out", EdlConfig(), "pred")
    assert len(lines) == 1 and lines[0].startswith("ffmpeg ") and "out/s.mp4" in lines[0]
    assert "drawtext" not in reports.render_commands(both, "out", EdlConfig(), "pred", proof=True)[0]


def test_no_error_at_all(spark):
    table = said(spark, "a b").withColumn("pred", F.lit("O"))
    assert [r["wrong"] for r in evaluate.erroneous(table).collect()] == [0]
    assert evaluate.erroneous(table.withColumn("pred", F.lit("FP"))).first()["wrong"] == 1


def test_words_in_loops(spark):
    rows = spark.createDataFrame([("f", n, w) for n, w in enumerate("a b b b b c d e d e d e d e f".split())], "file string, n int, text string")
    assert [r["text"] for r in asr.without_loops(rows, asr.loops(rows)).orderBy("n").collect()] == ["a", "c", "f"]
    assert audit.gap_audit is not None
