"""From ASR words to utterances: broken loops, segments, silence, hyphens, sentences."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

FILE = ["file"]


def utterances(words: DataFrame, most_gap: float = 0.8, prefix: str = "asr", glue: bool = True) -> DataFrame:
    """A token table of words (file, n, text, start, end): a new utterance after each silence above ``most_gap``.

    Empty words and those that end before they start drop out first. With ``glue``, a token "-x" joins the one
    before it within an utterance.
    """
    rows = words.withColumn("raw", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).filter("raw IS NOT NULL AND raw <> '' AND end >= start")
    rows = rows.filter(X.normalise(F.col("raw")) != "")
    order = Window.partitionBy("file").orderBy("n")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    silent = F.col("start") - F.lag("end").over(order) > most_gap
    rows = rows.withColumn("utt_seq", F.sum(F.when(silent, 1).otherwise(0)).over(so_far))
    if glue:
        # What was glued before ends as its last part does, so the neighbour alone decides.
        inside = Window.partitionBy("file", "utt_seq").orderBy("n")
        joins = F.col("raw").startswith("-") & (F.length("raw") > 1) & ~F.lag("raw").over(inside).endswith("-")
        rows = rows.withColumn("part", F.sum(F.when(joins, 0).otherwise(1)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.groupBy("file", "utt_seq", "part").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "raw"))), lambda x: x["raw"]), "").alias("raw"), F.min("n").alias("n"), F.min_by("start", "n").alias("start"), F.max("end").alias("end")
        )
    place = Window.partitionBy("file", "utt_seq").orderBy("n")
    return rows.select(
        F.col("file"), "utt_seq", F.format_string(f"{prefix}-%04d", F.col("utt_seq").cast("int") + 1).alias("uid"), (F.row_number().over(place) - 1).alias("i"),
        "raw", X.canonical(F.col("raw")).alias("w"), "start", "end", F.lit("O").alias("label"),
    )


def sessionize(rows: DataFrame, most_gap: float, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """``rows`` with session, counted up where a row starts more than ``most_gap`` after the one before it ended."""
    order = Window.partitionBy(*key).orderBy(start, *[c for c in ("n", "event_id") if c in rows.columns])
    fresh = F.col(start) - F.lag(end).over(order) > most_gap
    return rows.withColumn("session", F.sum(F.when(fresh, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def segments(words: DataFrame, least_gap: float = 0.8, key: list[str] = FILE) -> DataFrame:
    """key, segment, start, end, text, words: cut where the next word is at least ``least_gap`` away."""
    order = Window.partitionBy(*key).orderBy("n")
    fresh = F.when(F.col("start") - F.lag("end").over(order) >= least_gap, 1).otherwise(0)
    rows = words.withColumn("segment", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.sort_array(F.collect_list(F.struct("n", F.col("text").alias("word"), "start", "end")))
    return rows.groupBy(*key, "segment").agg(F.min_by("start", "n").alias("start"), F.max_by("end", "n").alias("end"), listed.alias("words")).select(
        *key, "segment", "start", "end", F.array_join(F.transform("words", lambda w: w["word"]), "").alias("text"), F.transform("words", lambda w: w.dropFields("n")).alias("words")
    )


def loop_candidates(words: DataFrame, longest: int = 4, rounds: int = 4, key: list[str] = FILE) -> DataFrame:
    """key, n (where), width, period, rounds, content: word sequences that repeat at least ``rounds`` times in a row."""
    order = Window.partitionBy(*key).orderBy("n")
    back = Window.partitionBy(*key).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    rows = words.withColumn("t", F.lower(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))).withColumn("pos", F.row_number().over(order) - 1)
    for k in range(1, longest + 1):
        rows = rows.withColumn(f"same{k}", F.coalesce(F.col("t") == F.lead("t", k).over(order), F.lit(False)))
    for k in range(1, longest + 1):
        # How far the text goes on equal to itself k words later: up to the next place where it does not.
        stop = F.last(F.when(~F.col(f"same{k}"), F.col("pos")), ignorenulls=True).over(back)
        rows = rows.withColumn(f"rounds{k}", 1 + F.floor((stop - F.col("pos")) / k))
    for k in range(1, longest):
        rows = rows.withColumn(f"next{k}", F.lead("t", k).over(order))
    content = [F.concat_ws(" ", "t", *[f"next{j}" for j in range(1, k)]) for k in range(1, longest + 1)]
    found = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("period"), F.col(f"rounds{k}").alias("rounds"), content[k - 1].alias("content")) for k in range(1, longest + 1)]), lambda x: x["rounds"] >= rounds))
    rows = rows.select(*key, "pos", found.alias("x"))
    return rows.select(*key, F.col("pos").alias("begin"), (F.col("pos") + F.col("x.period") * F.col("x.rounds")).alias("stop"), "x.period", "x.rounds", "x.content")


def loops(words: DataFrame, longest: int = 4, rounds: int = 4, key: list[str] = FILE) -> DataFrame:
    """key, begin, stop (word positions, end exclusive), period, rounds, content: overlapping candidates are one, described by the widest."""
    order = Window.partitionBy(*key).orderBy("begin", F.desc(F.col("stop") - F.col("begin")), "period")
    rows = loop_candidates(words, longest, rounds, key)
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"order": F.row_number().over(order), "new": F.when(F.col("begin") < reached, 0).otherwise(1)})
    rows = rows.withColumn("loop", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    widest = F.struct(F.col("stop") - F.col("begin"), -F.col("order"))
    best = lambda c: F.max_by(c, widest).alias(c)
    return rows.groupBy(*key, "loop").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), best("period"), best("rounds"), best("content")).drop("loop")


def without_loops(words: DataFrame, found: DataFrame, key: list[str] = FILE) -> DataFrame:
    """``words`` outside the loops."""
    order = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = words.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy("n")) - 1)
    rows = rows.join(found.select(*key, F.col("begin").cast("int").alias("pos"), F.col("stop").alias("_stop")), [*key, "pos"], "left")
    rows = rows.withColumn("_reach", F.max("_stop").over(order))
    return rows.filter(F.coalesce(F.col("pos") >= F.col("_reach"), F.lit(True))).drop("pos", "_stop", "_reach")


def silence_profile(spark: SparkSession, path: str, hop: float = 0.01, relative: float = 3.0) -> DataFrame:
    """file, silent (a flag for each frame) and hop of WAV files (16-bit mono; others raise an error).

    A frame is silent if its effective amplitude is below ``relative`` times the tenth percentile, or 2 % of the
    loudest if that is more. The last whole frame is left out.
    """

    def profile(data: bytes) -> list[bool]:
        with wave.open(io.BytesIO(data)) as w:
            if w.getsampwidth() != 2 or w.getnchannels() != 1:
                raise ValueError("only 16-bit mono WAV files are taken")
            rate, samples = w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.int64)
        size = int(rate * hop)
        frames = len(range(0, len(samples) - size, size)) if 0 < size <= len(samples) else 0
        if not frames:
            return []
        loudness = np.sqrt((samples[: frames * size].reshape(frames, size) ** 2).sum(axis=1) / size)
        ordered = np.sort(loudness)
        limit = max((ordered[frames // 10] or 1.0) * relative, ordered[-1] * 0.02)
        return (loudness < limit).tolist()

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"file": pdf["file"], "silent": [profile(x) for x in pdf["content"]], "hop": hop})

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("file"), "content")
    return files.mapInPandas(run, "file string, silent array<boolean>, hop double")


def trimmed(words: DataFrame, profiles: DataFrame, least: float = 0.04, key: list[str] = FILE) -> DataFrame:
    """``words`` without the silent frames at their edges, then no word past the start of the next; and changed.

    A word stays as it is where its frames are unknown, all silent, or would leave less than ``least`` seconds.
    """
    rows = words.join(profiles, key, "left")
    frames = F.coalesce(F.size("silent"), F.lit(0))
    a = F.floor(F.col("start") / F.col("hop")).cast("int")
    b = F.least(F.floor(F.col("end") / F.col("hop")).cast("int"), frames - 1)
    usable = (frames > 0) & (a < frames) & (b > a)
    rows = rows.withColumns({"a": F.when(usable, a), "b": F.when(usable, b)})
    part = F.slice("silent", F.col("a") + 1, F.col("b") - F.col("a") + 1)
    rows = rows.withColumn("part", F.when(F.col("a").isNotNull(), part))
    head = F.array_position("part", F.lit(False)) - 1
    tail = F.array_position(F.reverse("part"), F.lit(False)) - 1
    first, last = F.col("a") + head, F.col("b") - tail
    sound = (head >= 0) & (last > first) & ((last + 1) * F.col("hop") - first * F.col("hop") >= least)
    start, end = first * F.col("hop"), (last + 1) * F.col("hop")
    rows = rows.withColumns({"_s": F.when(sound, start), "_e": F.when(sound, end)})
    moved = F.coalesce((F.abs(F.col("_s") - F.col("start")) > 1e-9) | (F.abs(F.col("_e") - F.col("end")) > 1e-9), F.lit(False))
    rows = rows.withColumn("changed", moved).withColumns({"start": F.coalesce(X.round3(F.col("_s")), "start"), "end": F.coalesce(X.round3(F.col("_e")), "end")})
    following = F.lead("start").over(Window.partitionBy(*key).orderBy("n"))
    rows = rows.withColumn("end", F.when(F.col("end") > following, X.round3(F.greatest("start", following))).otherwise(F.col("end")))
    return rows.select(*words.columns, "changed")


def usable_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with both times."""
    return chunks.filter("timestamp.a IS NOT NULL AND timestamp.b IS NOT NULL")


def transcript(chunks: DataFrame, profiles: DataFrame | None = None, key: list[str] = FILE) -> tuple[DataFrame, DataFrame]:
    """What follows recognition: chunks (file, n, text, timestamp) to segments, and the loops taken out."""
    words = usable_chunks(chunks).select(*key, "n", "text", F.col("timestamp.a").alias("start"), F.col("timestamp.b").alias("end"))
    found = loops(words, key=key)
    words = without_loops(words, found, key)
    if profiles is not None:
        words = trimmed(words, profiles, key=key).drop("changed")
    return segments(words, key=key), found


def speech_rate(tokens: Column, seconds: Column) -> Column:
    return X.ratio(tokens, seconds)
