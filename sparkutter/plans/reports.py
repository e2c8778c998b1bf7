"""Reports as text. Each takes small aggregated tables, so what reaches the driver is bounded by labels, systems or files."""

from __future__ import annotations

import json
import shlex
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..operators import audit, edl, evaluate, repeats
from ..operators.tokens import DESCRIPTIONS, KEY, LABELS

FAMILIES = {
    "known_reduplication": ("lexical", "the doubled form is a listed reduplication"),
    "already_doubled": ("lexical", "a reduplication is said again"),
    "filler_repeated": ("lexical", "a filler is said again"),
    "function_word": ("morphosyntactic", "a function word does not double"),
    "open_class": ("morphosyntactic", "an ordinary word may double"),
    "gap_short": ("prosodic", "silence of at most {short} s"),
    "gap_long": ("prosodic", "silence of at least {long} s"),
    "gap_between": ("prosodic", "silence between {short} and {long} s, in proportion"),
    "length_clipped": ("prosodic", "the first copy is cut short (ratio below {clipped})"),
    "length_equal": ("prosodic", "both copies are as long (ratio {least} to {most})"),
    "run_three_or_more": ("structural", "{run} copies or more"),
}


def markdown(rows: list[list], head: list[str]) -> str:
    line = lambda x: "| " + " | ".join(str(v) for v in x) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)])


def weight_table(lex: Lexicon) -> str:
    """The evidence for and against reduplication, as Markdown with decimal commas."""
    facts = {"short": lex.gap_redup, "long": lex.gap_disfl, "clipped": repeats.CLIPPED_MOST, "least": repeats.EQUAL_LEAST, "most": repeats.EQUAL_MOST, "run": repeats.LONG_RUN}
    say = lambda key: f"{repeats.WEIGHTS[key]:+.1f}".replace(".", ",")
    worth = lambda key: f"{say('gap_short')} to {say('gap_long')}" if key == "gap_between" else say(key)
    rows = [[family, rule.format(**facts), worth(key)] for key, (family, rule) in FAMILIES.items()]
    return markdown(rows, ["family", "rule", "weight"])


def comparison(summary: DataFrame, by: str = "system") -> str:
    """One line for each system."""
    names = ["accuracy", "micro_f1", "macro_f1", "binary_f1", "span_f1", "redup_kept", "fluent_cut_rate"]
    rows = [[r[by], *(f"{r[n]:.4f}" for n in names)] for r in summary.orderBy(by).collect()]
    return markdown(rows, [by, *names])


def confusion_text(counts: DataFrame) -> str:
    """Gold labels down, predictions across."""
    n = {(r["gold"], r["pred"]): r["n"] for r in counts.collect()}
    return markdown([[g, *(n.get((g, p), 0) for p in LABELS)] for g in LABELS], ["gold", *LABELS])


def label_report(counts: DataFrame) -> str:
    """Scores of each label; labels that neither occur nor are predicted stay out."""
    rows = {r["label"]: r for r in evaluate.per_label(counts).collect()}
    shown = [rows[x] for x in LABELS if x in rows and rows[x]["tp"] + rows[x]["fp"] + rows[x]["fn"] > 0]
    return markdown([[r["label"], r["tp"] + r["fn"], *(f"{r[c]:.4f}" for c in ("precision", "recall", "f1"))] for r in shown], ["label", "support", "precision", "recall", "f1"])


def audit_text(audits: DataFrame, file: str = "file") -> str:
    """One line for each file, the pooled one last."""
    names = ["utterances", "tokens", "gaps", "zero", "reduplication", "grey", "disfluency", "filled_pause", "discourse_marker", "editing_strong", "editing_weak", "pause_rate", "events", "by_prosody"]
    rows = audits.orderBy(F.col(file).asc_nulls_last()).collect()
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else "-" if v is None else v
    return markdown([[r[file] or "all", *(show(r[n]) for n in names)] for r in rows], [file, *names])


def detected(tokens: DataFrame, cut, pred: str = "pred", key: list[str] = KEY, limit: int = 25) -> str:
    """The first utterances: each word with its label, then what stays. A report, so the limit is the feature."""
    rows = tokens.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "raw", F.col(pred).alias("label"), "start", "end"))).alias("x")).orderBy(*key).limit(limit)
    out = []
    for r in rows.collect():
        out.append(f"[{', '.join(str(r[k]) for k in key)}]")
        out += [f"  {t['start']:>9.3f} {t['end']:>9.3f}  {t['label']:<4} {t['raw']}" for t in r["x"]]
        out.append("  -> " + " ".join(t["raw"] for t in r["x"] if t["label"] not in cut))
    return "\n".join(out)


def explained(tokens: DataFrame, lex: Lexicon, key: list[str] = KEY, unit: int = 1, limit: int = 25) -> str:
    """The first repeats with verdict, score and reasons."""
    rows = repeats.events(tokens, lex, key, unit).orderBy(*key, "i").limit(limit).collect()
    return "\n".join(f"{r['base']} {r['base']}: {r['verdict']} (score {r['score']}, confidence {r['confidence']:.2f}) because of {', '.join(r['reasons'])}" for r in rows)


def audit_report(tokens: DataFrame, lex: Lexicon, key: list[str], file: str = "file", samples: int = 25) -> str:
    """The audits, the filler forms (the first twelve, then all) and the first repeats."""
    order = [*[k for k in key if k != file], "i"]
    order = [file, *order] if file in tokens.columns else order
    forms = [f"{r['form']}({r['n']})" for r in audit.top_fillers(tokens, lex, order, None).collect()]
    events = audit.repeat_samples(tokens, lex, samples, [k for k in order if k != "i"]).collect()
    shown = markdown([[r["base"], f"{r['gap']:.3f}", f"{r['score']:+.2f}"] for r in events], ["repeat", "gap", "score"])
    return "\n\n".join([audit_text(audit.audit(tokens, lex, key, file), file), "Fillers: " + ", ".join(forms[:12]), "All forms: " + ", ".join(forms), shown])


def write_experiment(predictions: DataFrame, lex: Lexicon, folder: str, shown: str | None = None) -> dict[str, str]:
    """results.json and report.md of an experiment's predictions, and a demo EDL of the first utterances with errors; returns the paths.

    ``shown`` is the system whose errors are listed; by default the full model, or the best where there is none.
    """
    predictions = predictions.cache()
    summary = evaluate.summary(predictions, lex, ["system"]).cache()
    names = [r["system"] for r in summary.orderBy(F.desc("micro_f1")).collect()]
    best = shown or ("perceptron full" if "perceptron full" in names else names[0])
    rows = predictions.filter(F.col("system") == best)
    counts = evaluate.confusion(rows)
    errors = [r.asDict() for r in evaluate.first_errors(rows, 25).collect()]
    wrongly_cut = [r.asDict() for r in evaluate.first_errors(rows, 15, focus="O").collect()]
    demo = rows.join(evaluate.erroneous(rows).select("uid"), "uid", "left_semi").withColumn("source", F.lit("contoh_podcast.wav"))
    Path(folder).mkdir(parents=True, exist_ok=True)
    paths = {"json": f"{folder}/results.json", "markdown": f"{folder}/report.md"}
    paths |= {f"edl_{k}": v for k, v in edl.write_edl(demo, f"{folder}/edl_demo", label="pred").items()}
    Path(paths["json"]).write_text(json.dumps({"systems": [r.asDict() for r in summary.orderBy("system").collect()], "errors": errors, "wrongly_cut": wrongly_cut}, ensure_ascii=False, indent=1), encoding="utf-8")
    listed = lambda found: markdown([[e["uid"], e["gold"], e["predicted"], e["context"]] for e in found], ["utterance", "gold", "predicted", "context"])
    parts = ["# Systems", comparison(summary), f"# {best}", label_report(counts), confusion_text(counts), "# Errors", listed(errors), "# Clean words that were cut", listed(wrongly_cut)]
    parts += ["# Evidence", weight_table(lex), "# Labels", markdown(list(map(list, DESCRIPTIONS.items())), ["label", "meaning"])]
    Path(paths["markdown"]).write_text("\n\n".join(parts) + "\n", encoding="utf-8")
    return paths


def render_commands(tokens: DataFrame, out: str, config: edl.EdlConfig, label: str, proof: bool = False, pad: float = 2.0, most: int | None = None, seconds: float | None = None, crf: int = 23, preset: str = "veryfast") -> list[str]:
    """The command lines that render every recording without its cuts, or its proof clips; ffmpeg itself is not run."""
    bounds = edl.timeline(tokens)
    cuts = edl.merge_cuts(edl.raw_cuts(tokens, config, label), config)
    spans = edl.proof_clips(cuts, bounds, pad, most) if proof else edl.keeps(cuts, bounds)
    if seconds is not None and not proof:
        spans = edl.extend(spans, F.lit(seconds))
    graphs = edl.ffmpeg_filter(spans).orderBy("source").collect()
    return [shlex.join(edl.ffmpeg_arguments(r["source"], f"{out}/{Path(r['source']).stem}.mp4", r["filter"], crf, preset)) for r in graphs]


def read_edl(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cuts, keeps, bounds) of written EDL JSON lines; keeps that end before they start drop out."""
    rows = spark.read.json(path)
    cuts = rows.select("source", F.explode("cuts").alias("x")).select("source", "x.*") if "cuts" in rows.columns else spark.createDataFrame([], "source string, n long, start double, end double")
    kept = rows.select("source", F.explode("keeps").alias("x")).select("source", "x.*").filter("end > start")
    return cuts, kept, edl.bounds_of(cuts, kept)


