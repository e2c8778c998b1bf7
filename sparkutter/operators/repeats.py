"""Adjacent repeats: grammatical reduplication, or a stumble?

Evidence is added up from the word, the silence between the copies, their lengths and the number of copies.
With times in whole milliseconds the score is in thousandths, an exact number; with seconds it is a double,
summed in the order of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexicon import Lexicon, one_of
from .tokens import KEY, by_position, gap_before, running

# The weight of each piece of evidence, in order, and the limits between verdicts.
WEIGHTS = {
    "known_reduplication": 3.0,
    "already_doubled": -3.0,
    "function_word": -3.0,
    "open_class": 0.5,
    "filler_repeated": -2.5,
    "gap_short": 1.5,
    "gap_long": -1.5,
    "length_clipped": -0.8,
    "length_equal": 0.4,
    "run_three_or_more": -2.0,
}
MARGIN = 0.75
CLIPPED_MOST = 0.6
EQUAL_LEAST, EQUAL_MOST = 0.8, 1.25
LONG_RUN = 3


def evidence(b: Column, gap: Column, first: Column | None, second: Column | None, run: Column, lex: Lexicon, unit: int = 1) -> list[tuple[str, Column, Column]]:
    """(name, holds, contribution) of each rule, in order. ``b`` is canonical; first and second are durations."""
    exact = unit == 1000
    weight = lambda name: F.lit(round(WEIGHTS[name] * 1000)) if exact else F.lit(WEIGHTS[name])
    pair = F.concat(b, F.lit("-"), b)
    function = lex.is_function(b) & ~one_of(pair, lex.function_doubled)
    short, long_ = lex.gap_redup * unit, lex.gap_disfl * unit
    if exact:
        short, long_ = round(short), round(long_)
        between = F.lit(1500) - (3000 * (gap - short) / (long_ - short)).cast("long")
    else:
        share = (gap - short) / (long_ - short) if long_ > short else F.lit(0.5)
        between = weight("gap_short") + (WEIGHTS["gap_long"] - WEIGHTS["gap_short"]) * share
    rules = [
        ("known_reduplication", lex.is_known_doubled(pair), weight("known_reduplication")),
        ("already_doubled", b.contains("-") & lex.is_hyphen_doubled(b), weight("already_doubled")),
        ("function_word", function, weight("function_word")),
        ("open_class", ~function & lex.can_double(b), weight("open_class")),
        ("filler_repeated", lex.is_filler(b), weight("filler_repeated")),
        ("gap_short", gap <= short, weight("gap_short")),
        ("gap_long", (gap > short) & (gap >= long_), weight("gap_long")),
        ("gap_between", (gap > short) & (gap < long_), between),
    ]
    if first is not None and second is not None:
        both = (first > 0) & (second > 0)
        ratio = F.when(both, first / second)
        equal = (ratio >= EQUAL_LEAST) & (ratio <= EQUAL_MOST)
        rules.append(("length_clipped", F.coalesce(ratio < CLIPPED_MOST, F.lit(False)), weight("length_clipped")))
        rules.append(("length_equal", F.coalesce(equal, F.lit(False)), weight("length_equal")))
    rules.append(("run_three_or_more", run >= LONG_RUN, weight("run_three_or_more")))
    return rules


def total(rules: list[tuple[str, Column, Column]]) -> Column:
    score = F.lit(0)
    for _, holds, value in rules:
        score = score + F.when(holds, value).otherwise(F.lit(0))
    return score


def verdict(score: Column, unit: int = 1) -> Column:
    margin = round(MARGIN * 1000) if unit == 1000 else MARGIN
    return F.when(score > margin, "reduplication").when(score < -margin, "disfluency").otherwise("ambiguous")


def confidence(score: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(score) / 3)


def with_verdict(rows: DataFrame, lex: Lexicon, key: list[str] = KEY, unit: int = 1) -> DataFrame:
    """``rows`` with verdict: of each adjacent pair, at its first copy; null elsewhere.

    A run of three or more shows in the neighbours, so that no run length is needed here.
    """
    order = by_position(key)
    w = F.col("w")
    ahead = lambda n: F.lead("w", n).over(order)
    pair = (w != "") & (w == ahead(1))
    longer = F.coalesce(w == ahead(2), F.lit(False)) | F.coalesce(w == F.lag("w").over(order), F.lit(False))
    run = F.when(longer, LONG_RUN).otherwise(2)
    gap = F.greatest(F.lead("start").over(order) - F.col("end"), F.lit(0).cast("long"))
    second = F.lead("end").over(order) - F.lead("start").over(order)
    # In steps, so that windows and the score are worked out once.
    rows = rows.withColumns({"_pair": pair, "_run": run, "_gap": gap, "_second": second, "_first": F.col("end") - F.col("start")})
    score = total(evidence(w, F.col("_gap"), F.col("_first"), F.col("_second"), F.col("_run"), lex, unit))
    rows = rows.withColumn("_score", F.when(F.col("_pair"), score))
    rows = rows.withColumn("verdict", F.when(F.col("_score").isNotNull(), verdict(F.col("_score"), unit)))
    return rows.drop("_pair", "_run", "_gap", "_second", "_first", "_score")


def events(tokens: DataFrame, lex: Lexicon, key: list[str] = KEY, unit: int = 1) -> DataFrame:
    """One row for each adjacent pair: i, j, base, gap, run_length, score, verdict, confidence, reasons, and the verdict without prosody."""
    order = by_position(key)
    same = F.coalesce((F.col("w") != "") & (F.col("w") == F.lag("w").over(order)), F.lit(False))
    rows = tokens.select(*key, "i", "w", "start", "end", gap_before(key).alias("gap"), same.alias("same"), F.coalesce(F.lead("w").over(order) == F.col("w"), F.lit(False)).alias("next"))
    # Only members of runs go on.
    rows = rows.filter(F.col("same") | F.col("next") & (F.col("w") != ""))
    rows = rows.withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(running(key)))
    inside = Window.partitionBy(*key, "run").orderBy("i")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"run_length": F.count(F.lit(1)).over(whole), "first": F.lag(F.col("end") - F.col("start")).over(inside)}).filter("same")
    rules = evidence(F.col("w"), F.col("gap"), F.col("first"), F.col("end") - F.col("start"), F.col("run_length"), lex, unit)
    bare = lex.neutral_gap * unit
    without = total(evidence(F.col("w"), F.lit(round(bare) if unit == 1000 else bare), None, None, F.col("run_length"), lex, unit))
    reasons = F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds, _ in rules]))
    rows = rows.select(*key, (F.col("i") - 1).alias("i"), F.col("i").alias("j"), F.col("w").alias("base"), "gap", F.col("run_length").cast("long").alias("run_length"), total(rules).alias("score"), without.alias("without"), reasons.alias("reasons"))
    return rows.withColumns({"verdict": verdict(F.col("score"), unit), "verdict_without_prosody": verdict(F.col("without"), unit), "confidence": confidence(F.col("score") / (1000 if unit == 1000 else 1))}).drop("without")
