"""Audits of ASR transcripts: can their gaps, fillers and repeats be trusted?

Every audit is one aggregate over GROUPING SETS of file and all files, so that the pooled row costs no second
pass; ``file`` is null in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.lexicon import Lexicon
from .repeats import events
from .tokens import KEY, by_position

# Fixed values.
ZERO_GAP = 1e-6
SPOKEN_PAUSE_RATE = 0.0256
TRUSTED_ZERO_SHARE = 0.20
SLOW_SPEECH = 1.5  # words a second
LOW_COVERAGE = 0.70


def gaps(tokens: DataFrame, key: list[str] = KEY, extra: list[str] | None = None) -> DataFrame:
    """One row for each neighbouring pair: gap, never below 0."""
    between = F.col("start") - F.lag("end").over(by_position(key))
    rows = tokens.select(*(extra or []), *key, "i", between.alias("gap")).filter("gap IS NOT NULL")
    return rows.withColumn("gap", F.greatest("gap", F.lit(0).cast("long")))


def zone(gap: Column, lex: Lexicon, unit: int = 1) -> Column:
    short, long_ = (round(lex.gap_redup * unit), round(lex.gap_disfl * unit)) if unit == 1000 else (lex.gap_redup, lex.gap_disfl)
    return F.when(gap <= short, "reduplication").when(gap >= long_, "disfluency").otherwise("grey")


def grouped(rows: DataFrame, file: str | None, aggregates: list[Column]) -> DataFrame:
    if file is None:
        return rows.agg(*aggregates)
    return rows.groupingSets([[F.col(file)], []], F.col(file)).agg(*aggregates)


def gap_audit(tokens: DataFrame, lex: Lexicon, key: list[str] = KEY, file: str | None = None, unit: int = 1) -> DataFrame:
    """gaps, zero gaps and their share, gaps in each zone, median, and whether prosody can be trusted.

    The exact median counts distinct gaps. Times have three decimals at most, so these are as many as a recording's
    longest silence has milliseconds, however many gaps there are.
    """
    rows = gaps(tokens, [*([file] if file else []), *[k for k in key if k != file]])
    kind = zone(F.col("gap"), lex, unit)
    zero = F.count_if(F.col("gap") <= (0 if unit == 1000 else ZERO_GAP))
    out = grouped(rows, file, [
        F.count("gap").alias("gaps"), zero.alias("zero"), *[F.count_if(kind == z).alias(z) for z in ("reduplication", "grey", "disfluency")],
        F.coalesce(F.percentile("gap", F.lit(0.5)), F.lit(0.0)).alias("median"),
    ])
    share = X.ratio(F.col("zero"), F.col("gaps"))
    return out.withColumns({"zero_share": share, "prosody_trusted": share < TRUSTED_ZERO_SHARE})


def filler_audit(tokens: DataFrame, lex: Lexicon, file: str | None = None) -> DataFrame:
    """Tokens, each category's count (editing terms strong or not), rates, and whether pauses seem to be missing."""
    kind = lex.category(F.col("w"))
    edit = kind == L.EDIT
    out = grouped(tokens, file, [
        F.count(F.lit(1)).alias("tokens"), *[F.count_if(kind == k).alias(k) for k in (L.FP, L.FP_AMB, L.DM)],
        F.count_if(edit & lex.is_strong(F.col("w"))).alias("editing_strong"), F.count_if(edit & ~lex.is_strong(F.col("w"))).alias("editing_weak"),
    ])
    rate = X.ratio(F.col(L.FP) + F.col(L.DM) + F.col("editing_strong"), F.col("tokens"))
    pauses = X.ratio(F.col(L.FP), F.col("tokens"))
    return out.withColumns({"rate": rate, "pause_rate": pauses, "pauses_missing": pauses < SPOKEN_PAUSE_RATE / 2})


def filler_forms(tokens: DataFrame, lex: Lexicon, order: list[str] | None = None) -> DataFrame:
    """Each filler as it was normalised, with its count; ``order`` names the columns of the corpus order, for first, where it appears first."""
    first = [F.min(F.struct(*order)).alias("first")] if order else []
    return tokens.filter(lex.is_filler(F.col("w"))).groupBy(X.normalise(F.col("raw")).alias("form")).agg(F.count(F.lit(1)).alias("n"), *first)


def top_fillers(tokens: DataFrame, lex: Lexicon, order: list[str], limit: int | None = 12) -> DataFrame:
    """The forms by count, ties by first appearance: a report, so the limit is the feature (None: all forms)."""
    rows = filler_forms(tokens, lex, order).orderBy(F.desc("n"), "first").drop("first")
    return rows if limit is None else rows.limit(limit)


def repeat_audit(tokens: DataFrame, lex: Lexicon, key: list[str] = KEY, file: str | None = None, unit: int = 1) -> DataFrame:
    """Events by verdict, and how many verdicts prosody alone decides."""
    rows = events(tokens, lex, [*([file] if file else []), *[k for k in key if k != file]], unit)
    out = grouped(rows, file, [
        F.count(F.lit(1)).alias("events"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("reduplication", "disfluency", "ambiguous")],
        F.count_if(F.col("verdict") != F.col("verdict_without_prosody")).alias("by_prosody"),
    ])
    return out.withColumn("prosody_share", X.ratio(F.col("by_prosody"), F.col("events")))


def repeat_samples(tokens: DataFrame, lex: Lexicon, limit: int = 25, key: list[str] = KEY, unit: int = 1) -> DataFrame:
    """The first events in corpus order: a report, so the limit is the feature."""
    return events(tokens, lex, key, unit).select(*key, "i", "base", "gap", "score").orderBy(*key, "i").limit(limit)


def speech(tokens: DataFrame, key: list[str] = KEY, file: str | None = None) -> DataFrame:
    """utterances, tokens and seconds of speech (first start to last end of each utterance)."""
    by = [*([file] if file else []), *[k for k in key if k != file]]
    each = tokens.groupBy(*by).agg((F.max_by("end", "i") - F.min_by("start", "i")).alias("t"), F.count("i").alias("n"))
    return grouped(each, file, [F.count(F.lit(1)).alias("utterances"), F.sum("n").alias("tokens"), F.sum("t").alias("speech")])


def file_notes(audits: DataFrame, media: DataFrame, file: str = "file") -> DataFrame:
    """``audits`` (file, tokens, speech, pauses_missing) with coverage of the media and notes on what looks wrong.

    ``media`` has file and seconds; files that it lacks have no coverage.
    """
    rows = audits.join(media, file, "left")
    rate, coverage = X.ratio(F.col("tokens"), F.col("speech")), F.when(F.col("seconds") > 0, F.col("speech") / F.col("seconds"))
    notes = F.array_compact(F.array(F.when(rate < SLOW_SPEECH, "slow"), F.when(coverage < LOW_COVERAGE, "low coverage"), F.when(F.col("pauses_missing"), "pauses missing")))
    return rows.withColumns({"rate": rate, "coverage": coverage, "notes": notes})


def audit(tokens: DataFrame, lex: Lexicon, key: list[str] = KEY, file: str = "file", unit: int = 1) -> DataFrame:
    """All audits side by side, a row for each file and one for all."""
    out = speech(tokens, key, file)
    for part in (gap_audit(tokens, lex, key, file, unit), filler_audit(tokens, lex, file).drop("tokens"), repeat_audit(tokens, lex, key, file, unit)):
        names = [c for c in part.columns if c != file]
        part = part.select(F.col(file).alias("_file"), *[F.col(c).alias(f"repeat_{c}") if c in out.columns else F.col(c) for c in names])
        out = out.join(part, F.col(file).eqNullSafe(F.col("_file")), "left").drop("_file")
    return out
