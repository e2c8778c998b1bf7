"""Token tables: one row for each word of an utterance.

A token table has the key columns ``KEY`` of its utterance, ``i`` (position from 0), ``raw``, ``w`` (canonical),
``start`` and ``end``. Times are seconds (double) or, with ``unit=1000``, whole milliseconds (long). All
operators over neighbours use one window, ``by_position``, so that Spark exchanges and sorts tokens once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import text as T

KEY = ["uid"]

LABELS = ("O", "FP", "DM", "REP", "RPR", "PW")
DISFLUENT = ("FP", "DM", "REP", "RPR", "PW")
CONSERVATIVE = ("FP", "REP", "RPR", "PW")
DESCRIPTIONS = {
    "O": "clean word - keep it",
    "FP": "filled pause - hesitation sound (eee, emm, hmm)",
    "DM": "discourse marker used as filler (kayak, gitu, apa ya)",
    "REP": "repetition - same word said twice by mistake",
    "RPR": "reparandum - words the speaker dropped, then fixed",
    "PW": "partial word - half a word (sa- sapi)",
}


def by_position(key: list[str] = KEY) -> WindowSpec:
    return Window.partitionBy(*key).orderBy("i")


def running(key: list[str] = KEY) -> WindowSpec:
    return by_position(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def explode_words(texts: DataFrame, text_col: str = "text", keep: list[str] = KEY, together: list[str] | None = None) -> DataFrame:
    """``keep``, i, raw and w of each word.

    ``together`` names the key of the windows that follow: whole texts are exchanged by it here, which moves a
    fraction of what their words would, and the words need no exchange any more. The number of partitions is that of
    shuffles, but one for each core at least, and stays so: by the size of the texts, too few tasks would be left for
    the work on their words.
    """
    if together:
        spark = texts.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        texts = texts.select(*keep, text_col).repartition(parts, *together)
    words = texts.select(*keep, F.posexplode(T.tokens(F.col(text_col))).alias("i", "raw"))
    return words.withColumn("w", T.canonical(F.col("raw"), trimmed=True))


def neutral_times(tokens: DataFrame, key: list[str] = KEY, *, lead: int = 250, gap: int = 130) -> DataFrame:
    """start and end in milliseconds, for words that have none: durations follow syllables, gaps are all the same."""
    duration = F.greatest(F.lit(50), 60 + 85 * T.syllables(F.col("raw"), trimmed=True)).cast("long")
    tokens = tokens.withColumn("_d", duration)
    end = lead + F.col("i") * gap + F.sum("_d").over(running(key))
    return tokens.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.col("_d")).drop("_d")


def gap_before(key: list[str] = KEY) -> Column:
    """Silence before a token; 0 at the start and where tokens overlap."""
    zero = F.lit(0).cast("long")
    return F.coalesce(F.greatest(F.col("start") - F.lag("end").over(by_position(key)), zero), zero)


def gap_after(key: list[str] = KEY) -> Column:
    zero = F.lit(0).cast("long")
    return F.coalesce(F.greatest(F.lead("start").over(by_position(key)) - F.col("end"), zero), zero)


def nested(tokens: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row for each utterance, with its tokens in order as an array of structs."""
    fields = [c for c in ("i", "raw", "start", "end", "label", "pred") if c in tokens.columns]
    return tokens.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("tokens"))


def label_spans(tokens: DataFrame, label: str = "label", key: list[str] = KEY, wanted=DISFLUENT) -> DataFrame:
    """Maximal runs of one wanted label: label, i, j (exclusive), start, end, text."""
    order = by_position(key)
    change = F.when(F.col(label) == F.lag(label).over(order), 0).otherwise(1)
    rows = tokens.withColumn("_new", change).withColumn("_run", F.sum("_new").over(running(key)))
    rows = rows.filter(F.col(label).isin(list(wanted)))
    return rows.groupBy(*key, "_run", F.col(label).alias("label")).agg(
        F.min("i").alias("i"),
        (F.max("i") + 1).alias("j"),
        F.min_by("start", "i").alias("start"),
        F.max_by("end", "i").alias("end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "raw"))), lambda x: x["raw"]), " ").alias("text"),
    ).drop("_run")


def clean_text(tokens: DataFrame, label: str = "label", cut=DISFLUENT, key: list[str] = KEY) -> DataFrame:
    """The words of each utterance that are not cut, joined by spaces."""
    rows = F.sort_array(F.collect_list(F.struct("i", "raw", F.col(label).alias("label"))))
    kept = F.filter(rows, lambda x: ~x["label"].isin(list(cut)))
    return tokens.groupBy(*key).agg(F.array_join(F.transform(kept, lambda x: x["raw"]), " ").alias("clean"))


def label_counts(tokens: DataFrame, label: str = "label") -> DataFrame:
    """Every label with its count, 0 for those that do not occur."""
    counts = tokens.agg(*[F.count_if(F.col(label) == x).alias(x) for x in LABELS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("n")) for x in LABELS])).alias("x")).select("x.*")


def describe(tokens: DataFrame, label: str = "label", key: list[str] = KEY) -> DataFrame:
    """utterances, tokens, disfluent tokens, their share (4 places) and the speech time."""
    each = tokens.groupBy(*key).agg(
        F.count("i").alias("n"), F.count_if(F.col(label).isin(list(DISFLUENT))).alias("d"), (F.max_by("end", "i") - F.min_by("start", "i")).alias("t")
    )
    return each.agg(
        F.count(F.lit(1)).alias("utterances"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("disfluent"),
        F.round(T.ratio(F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))), 4).alias("disfluent_share"),
        F.sum("t").alias("speech"),
    )


def folds(tokens: DataFrame, k: int = 5) -> DataFrame:
    """``tokens`` with its utterance's fold: the MD5 of uid modulo k."""
    return tokens.withColumn("fold", T.md5_bucket(F.col("uid"), k))


def split(tokens: DataFrame, test_share: float = 0.3) -> DataFrame:
    """``tokens`` with is_test."""
    return tokens.withColumn("is_test", T.md5_bucket(F.col("uid"), 100) < round(test_share * 100))


def training_folds(tokens: DataFrame, k: int = 5) -> DataFrame:
    """For each fold, the tokens of all others (a column ``held`` names it)."""
    others = F.array(*[F.lit(x) for x in range(k)])
    rows = folds(tokens, k)
    return rows.select("*", F.explode(F.filter(others, lambda x: x != F.col("fold"))).alias("held"))
