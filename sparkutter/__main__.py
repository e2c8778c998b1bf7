"""python -m sparkutter COMMAND ...: the transcript analyses from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.lexicon import Lexicon
from .operators import asr, audit, detect, edl, perceptron
from .operators import tokens as K
from .operators.features import Families, featurize
from .plans import experiment, reports
from .sources import corpora, simulate


def labelled(table, detector: str, lex: Lexicon, model: str | None):
    if detector == "naive":
        return detect.naive_labels(table, lex)
    if detector == "rules":
        return detect.rule_labels(table, lex)
    weights, families, _ = perceptron.load_model(model)
    return perceptron.predict(featurize(table, lex, families), weights)


words = corpora.words_only


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sparkutter", description=__doc__)
    parser.add_argument("command", choices=["stats", "build", "experiment", "train", "detect", "explain", "media", "ingest", "audit", "edl", "render"])
    parser.add_argument("path", help="annotated text (stats, build, experiment, train), utterances as JSON lines (detect, explain, edl, render), ASR JSON (ingest, audit), provenance CSV (media); for detect and explain also a sentence")
    parser.add_argument("--out", help="where to write")
    parser.add_argument("--lexicon", help="folder of another lexicon")
    parser.add_argument("--detector", choices=["naive", "rules", "model"], default="rules")
    parser.add_argument("--model", help="weights written by train")
    parser.add_argument("--cut", choices=["conservative", "aggressive"], default="conservative")
    parser.add_argument("--max-gap", type=float, default=0.8, help="ingest, audit: silence between utterances")
    parser.add_argument("--prefix", default="asr", help="ingest: of utterance names")
    parser.add_argument("--no-glue", action="store_true", help="ingest: keep words that begin with a hyphen apart")
    parser.add_argument("--provenance", help="audit: table with the lengths of the media")
    parser.add_argument("--without", nargs="*", choices=["lexical", "prosody", "reduplication"], default=[], help="train: feature families to leave out")
    parser.add_argument("--gold", action="store_true", help="edl, render: cut by the labels as they are")
    for name, value in (("share", 0.5), ("guard", 0.03), ("least", 0.05), ("merge", 0.12)):
        parser.add_argument(f"--{name}", type=float, default=value, help=f"edl, render: the configuration's {name}")
    parser.add_argument("--proof", action="store_true", help="render: each cut with its surroundings, before and after")
    parser.add_argument("--pad", type=float, default=2.0, help="render --proof: seconds around a cut")
    parser.add_argument("--most", type=int, help="render --proof: this many cuts")
    parser.add_argument("--media-seconds", type=float, help="render: the recording's length")
    parser.add_argument("--crf", type=int, default=23)
    parser.add_argument("--preset", default="veryfast")
    parser.add_argument("--epochs", type=int, default=15)
    parser.add_argument("--folds", type=int, default=5)
    parser.add_argument("--seed", type=int, default=13)
    parser.add_argument("--timing-seed", type=int, default=20260812)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("sparkutter").getOrCreate()
    lex = Lexicon.load(a.lexicon) if a.lexicon else Lexicon.indonesian()
    cut = K.CONSERVATIVE if a.cut == "conservative" else K.DISFLUENT

    def utterances():
        if not a.path.endswith((".json", ".jsonl", "/")):
            if not a.path.strip():
                raise SystemExit("the text is empty")
            table = corpora.plain_text(spark.createDataFrame([("text", a.path)], "uid string, text string"))
            return table.withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000, "source": F.lit("text"), "utt_seq": F.lit(0)})
        return corpora.read_utterances(spark, a.path)

    if a.command in ("stats", "build", "experiment", "train"):
        table = simulate.build_corpus(spark, a.path, a.timing_seed)
        if a.command == "stats":
            K.describe(table).show(truncate=False)
            K.label_counts(table).show()
        elif a.command == "build":
            print(corpora.write_utterances(table, a.out))
        elif a.command == "experiment":
            print(reports.write_experiment(experiment.predictions(table, lex, a.folds, a.epochs, a.seed), lex, a.out))
        else:
            families = Families(**{f: False for f in a.without})
            model = perceptron.fit_models(featurize(table, lex, families).withColumn("one", F.lit(1)), ["one"], epochs=a.epochs, seed=a.seed).first()
            perceptron.save_model(a.out, perceptron.Weights.from_json(model["weights"]), families)
            print(model["history"])
    elif a.command == "detect":
        print(reports.detected(labelled(words(utterances()), a.detector, lex, a.model), cut))
    elif a.command == "explain":
        print(reports.explained(words(utterances()), lex))
    elif a.command == "media":
        rows = corpora.read_provenance(spark, a.path)
        corpora.provenance_report(rows).show(1000, truncate=False)
        corpora.provenance_totals(rows).show()
    elif a.command in ("ingest", "audit"):
        table = asr.utterances(corpora.asr_words(spark, a.path), a.max_gap, a.prefix, not a.no_glue)
        if table.isEmpty():
            raise SystemExit(f"no timed words in {a.path}")
        if a.command == "ingest":
            print(corpora.write_utterances(table.withColumn("source", F.col("file")).withColumn("uid", F.concat_ws("/", "file", "uid")), a.out))
        else:
            print(reports.audit_report(table, lex, ["file", "uid"]))
            if a.provenance:
                media = corpora.read_provenance(spark, a.provenance).select(F.regexp_replace("berkas", r"\.[^.]*$", "").alias("file"), F.col("durasi_detik").alias("seconds"))
                audit.file_notes(audit.audit(table, lex, ["file", "uid"]).filter("file IS NOT NULL"), media).select("file", "rate", "coverage", "notes").show(1000, truncate=False)
    else:
        table = words(utterances())
        table = table if a.gold else labelled(table, a.detector, lex, a.model)
        label, config = "label" if a.gold else "pred", edl.EdlConfig(cut=cut, share=a.share, guard=a.guard, least=a.least, merge=a.merge)
        if a.command == "edl":
            print(edl.write_edl(table, a.out, config, label))
        else:
            print("\n".join(reports.render_commands(table, a.out, config, label, a.proof, a.pad, a.most, a.media_seconds, a.crf, a.preset)))


if __name__ == "__main__":
    main()
