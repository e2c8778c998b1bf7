"""Reports and the command line."""

import json

from pyspark.sql import functions as F

from sparkutter.__main__ import main
from sparkutter.functions.lexicon import Lexicon
from sparkutter.operators import audit, detect, edl
from sparkutter.operators.tokens import CONSERVATIVE
from sparkutter.plans import reports
from test_detect import sentence

LEX = Lexicon.indonesian()


def test_texts(spark, tmp_path):
    table = detect.rule_labels(sentence(spark, [("eee", "FP"), ("saya", "REP"), ("saya", "O"), ("mau", "O")]), LEX)
    assert reports.weight_table(LEX).count("\n") == 12 and "+3,0" in reports.weight_table(LEX)
    assert "-> saya mau" in reports.detected(table, CONSERVATIVE)
    assert "saya saya: disfluency" in reports.explained(table, LEX)
    paths = reports.write_experiment(table.withColumns({"system": F.lit("rules"), "utt_seq": F.lit(0)}), LEX, str(tmp_path / "x"))
    assert json.loads(open(paths["json"]).read())["systems"][0]["accuracy"] == 1.0 and "# Systems" in open(paths["markdown"]).read()
    pooled = audit.audit(table.withColumn("file", F.lit("f")), LEX, ["file", "uid"])
    assert reports.audit_text(pooled).splitlines()[-1].startswith("| all | 1 | 4 |")
    written = edl.write_edl(table.withColumn("source", F.lit("a.mp4")), str(tmp_path / "edl"), label="pred")
    cuts, kept, bounds = reports.read_edl(spark, written["json"])
    assert bounds.count() == 1 and cuts.count() >= 1 and kept.count() >= 1


def test_command_line(spark, tmp_path, capsys):
    main(["detect", "eee jadi saya saya mau bertanya"])
    assert "jadi saya mau bertanya" in capsys.readouterr().out
    text = tmp_path / "c.txt"
    text.write_text("eee/FP saya mau\nanak anak main\n")
    main(["build", str(text), "--out", str(tmp_path / "corpus/")])
    main(["edl", str(tmp_path / "corpus") + "/", "--out", str(tmp_path / "edl")])
    assert spark.read.json(str(tmp_path / "edl/json")).count() == 1
