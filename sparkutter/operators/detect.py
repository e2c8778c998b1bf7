"""Disfluency detectors: labels for every token, as stacked window expressions over one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions.lexicon import Lexicon, one_of
from .repeats import with_verdict
from .tokens import KEY, by_position, gap_after, running

# Fixed values.
MOST_REPARANDUM = 4
CUT_OFF_GAP = 0.35


def ahead(n: int, key: list[str]) -> Column:
    return F.lead("w", n).over(by_position(key))


def with_phrases(rows: DataFrame, lex: Lexicon, key: list[str] = KEY) -> DataFrame:
    """``rows`` with phrase_n and phrase_cat: length and category of the longest phrase that begins at a token; null without one."""
    sizes = range(2, lex.longest_phrase + 1)
    rows = rows.withColumns({f"_w{k}": ahead(k, key) for k in range(1, lex.longest_phrase)})
    listed = lambda n, kind: [p for p, c in lex.phrases.items() if c == kind and p.count(" ") == n - 1]
    for n in sizes:
        rows = rows.withColumn("_words", F.concat(F.col("w"), *[x for k in range(1, n) for x in (F.lit(" "), F.col(f"_w{k}"))]))
        rows = rows.withColumn(f"_p{n}", F.when(one_of(F.col("_words"), listed(n, L.DM)), L.DM).when(one_of(F.col("_words"), listed(n, L.EDIT)), L.EDIT))
    length = F.lit(None).cast("int")
    for n in sizes:
        length = F.when(F.col(f"_p{n}").isNotNull(), n).otherwise(length)
    rows = rows.withColumns({"phrase_n": length, "phrase_cat": F.coalesce(*[F.col(f"_p{n}") for n in reversed(sizes)])})
    return rows.drop("_words", *[f"_p{n}" for n in sizes], *[f"_w{k}" for k in range(1, lex.longest_phrase)])


def taken(rows: DataFrame, hit: Column, n: Column, most: int, key: list[str] = KEY) -> DataFrame:
    """``rows`` with taken: of the stretches of ``n`` tokens that begin where ``hit`` holds, those that a scan from left to right takes.

    A stretch that is taken hides those that begin inside it. Whether one is taken depends only on its cluster, the
    stretches that begin less than ``most`` tokens after each other, so a cluster is scanned as a short array.
    """
    rows = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    if most < 2:
        return rows.withColumnRenamed("_hit", "taken")
    order = by_position(key)
    near = F.lit(False)
    for k in range(1, most):
        near |= F.coalesce(F.lag("_hit", k).over(order), F.lit(False))
    rows = rows.withColumn("_cluster", F.sum(F.when(near, 0).otherwise(1)).over(running(key)))
    whole = Window.partitionBy(*key, "_cluster").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_hits", F.collect_list(F.when(F.col("_hit"), F.struct(F.col("i").cast("int").alias("i"), n.cast("int").alias("n")))).over(whole))
    # The last stretch taken, of those that begin here or before.
    start = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("free"))
    step = lambda acc, x: F.when(x["i"] >= acc["free"], F.struct(x["i"].alias("at"), (x["i"] + x["n"]).alias("free"))).otherwise(acc)
    return rows.withColumn("taken", F.when(F.col("_hit"), F.aggregate("_hits", start, step, lambda acc: acc["at"]) == F.col("i")).otherwise(F.lit(False))).drop("_hit", "_cluster", "_hits")


def mark_phrases(tokens: DataFrame, lex: Lexicon, key: list[str] = KEY) -> DataFrame:
    """``tokens`` with phrase_n, phrase_cat and in_marker: inside a discourse phrase, taken from left to right."""
    most = lex.longest_phrase
    if most < 2:
        return tokens.withColumns({"phrase_n": F.lit(None).cast("int"), "phrase_cat": F.lit(None).cast("string"), "in_marker": F.lit(False)})
    rows = with_phrases(tokens, lex, key)
    rows = taken(rows, F.col("phrase_cat") == L.DM, F.col("phrase_n"), most, key)
    rows = rows.withColumn("_end", F.when(F.col("taken"), F.col("i") + F.col("phrase_n")))
    inside = F.col("i") < F.last("_end", ignorenulls=True).over(running(key))
    return rows.withColumn("in_marker", F.coalesce(inside, F.lit(False))).drop("taken", "_end")


def naive_labels(tokens: DataFrame, lex: Lexicon, key: list[str] = KEY, name: str = "pred") -> DataFrame:
    """Every lexicon word is a filler, and every first of two equal neighbours a repetition."""
    rows = mark_phrases(tokens, lex, key)
    category = lex.category(F.col("w"))
    label = F.when(F.col("w") == ahead(1, key), "REP").when(F.col("in_marker"), "DM")
    label = label.when(category.isin(L.FP, L.FP_AMB), "FP").when(category.isin(L.DM, L.EDIT), "DM").otherwise("O")
    return rows.withColumn(name, label).drop("phrase_n", "phrase_cat", "in_marker")


def single_fillers(rows: DataFrame, lex: Lexicon, key: list[str] = KEY) -> DataFrame:
    """``rows`` (of mark_phrases) with the label FP, DM or O after phrases and single words.

    Some markers are fillers only after a filler: these hand the state of the token before them on, all other
    tokens set it. So the state is the last one set.
    """
    w = F.col("w")
    category = lex.category(w)
    following = F.coalesce(lex.is_filler(ahead(1, key)), F.lit(False))
    marker = ~F.col("in_marker") & (category == L.DM)
    passes = marker & (one_of(w, lex.openers) & (F.col("i") > 0) | one_of(w, lex.answers) & ~following)
    tail = one_of(ahead(1, key), lex.tails)
    sets = F.col("in_marker") | category.isin(L.FP, L.FP_AMB) | marker & ~(one_of(w, lex.demonstratives) & tail)
    rows = rows.withColumns({"_cat": category, "_set": F.when(~F.coalesce(passes, F.lit(False)), F.coalesce(sets, F.lit(False)))})
    rows = rows.withColumn("_filler", F.coalesce(F.last("_set", ignorenulls=True).over(running(key)), F.lit(False)))
    label = F.when(F.col("in_marker"), "DM").when(~F.col("_filler"), "O").when(F.col("_cat").isin(L.FP, L.FP_AMB), "FP").otherwise("DM")
    return rows.withColumn("label_now", F.when(F.col("in_marker") | F.col("_cat").isNotNull(), label).otherwise("O")).drop("_cat", "_set", "_filler")


def filler_flags(rows: DataFrame, lex: Lexicon) -> Column:
    """Inside a discourse phrase, or a filler by itself wherever it stands."""
    return F.col("in_marker") | F.coalesce(lex.category(F.col("w")).isin(L.FP, L.FP_AMB, L.DM), F.lit(False))


def repair_windows(rows: DataFrame, lex: Lexicon, blocked: Column, key: list[str] = KEY) -> DataFrame:
    """``rows`` (of mark_phrases) with, at an editing term with a repair: term_n, its words, and reparandum_n, the words to drop before it.

    A repair is a rough copy: among the m words on either side of the term, two at the same place are equal or
    begin with the same four letters. The largest m up to ``MOST_REPARANDUM`` counts; without any, a strong
    term drops the word before it unless that is ``blocked``. Terms are taken from left to right: one that begins
    inside another with a repair counts no more.
    """
    order = by_position(key)
    w = F.col("w")
    category = lex.category(w)
    strong_word = lex.is_strong(w)
    term = F.coalesce(category.isin(L.EDIT, L.FP_AMB), F.lit(False)) & (one_of(w, lex.editing) | strong_word)
    phrase = F.coalesce(F.col("phrase_cat") == L.EDIT, F.lit(False))
    rows = rows.withColumns({"_n": F.when(phrase, F.col("phrase_n")).when(term, 1).otherwise(0), "_strong": phrase | strong_word, "_blocked": blocked})
    reach = MOST_REPARANDUM
    longest = max(1, *(p.count(" ") + 1 for p, c in lex.phrases.items() if c == L.EDIT), 1) if lex.phrases else 1
    # Words are alike if their first four letters (or all, if there are fewer) are the same.
    rows = rows.withColumn("_k", F.substring("w", 1, 4))
    before = {f"_b{k}": F.lag("_k", k).over(order) for k in range(1, reach + 1)}
    after = {f"_a{k}": F.lead("_k", k).over(order) for k in range(1, reach + longest)}
    rows = rows.withColumns(before | after | {"_before": F.lag("_blocked").over(order)})

    def behind(k: int) -> Column:
        """The k-th word after the term, however long that is."""
        out = F.lit(None).cast("string")
        for n in range(1, longest + 1):
            out = F.when(F.col("_n") == n, F.col(f"_a{n + k - 1}")).otherwise(out)
        return out

    rows = rows.withColumns({f"_r{k}": behind(k) for k in range(1, reach + 1)})
    found = F.lit(None).cast("int")
    for m in range(1, reach + 1):
        # Words i-m .. i-1 against as many after the term; all of them must exist.
        match = F.lit(False)
        for k in range(m):
            match |= F.col(f"_b{m - k}") == F.col(f"_r{k + 1}")
        found = F.when(F.col(f"_b{m}").isNotNull() & F.col(f"_r{m}").isNotNull() & match, m).otherwise(found)
    room = F.col("_b1").isNotNull() & F.col("_r1").isNotNull()
    fallback = F.when(room & F.col("_strong") & ~F.coalesce(F.col("_before"), F.lit(False)), 1)
    best = F.when(F.col("_n") > 0, F.coalesce(found, fallback))
    extra = [c for c in rows.columns if c.startswith("_")]
    rows = rows.withColumn("reparandum_n", best).withColumn("term_n", F.when(F.col("reparandum_n").isNotNull(), F.col("_n")))
    if longest > 1:
        rows = taken(rows, F.col("term_n").isNotNull(), F.col("term_n"), longest, key)
        rows = rows.withColumns({c: F.when(F.col("taken"), F.col(c)) for c in ("term_n", "reparandum_n")}).drop("taken")
    return rows.drop(*extra)


def inside_repair(lex: Lexicon, key: list[str] = KEY) -> tuple[Column, Column]:
    """(in the reparandum, in the term) of rows of repair_windows."""
    order = by_position(key)
    reparandum = F.lit(False)
    for d in range(1, MOST_REPARANDUM + 1):
        reparandum |= F.coalesce(F.lead("reparandum_n", d).over(order) >= d, F.lit(False))
    term = F.col("term_n").isNotNull()
    for d in range(1, lex.longest_phrase):
        term |= F.coalesce(F.lag("term_n", d).over(order) > d, F.lit(False))
    return reparandum, term


def rule_labels(tokens: DataFrame, lex: Lexicon, key: list[str] = KEY, unit: int = 1, name: str = "pred", keep_ambiguous: bool = True) -> DataFrame:
    """Phrases, single fillers by context, cut-off words, repetitions by evidence, repairs; the later rule wins where it may."""
    names = tokens.columns
    rows = single_fillers(mark_phrases(tokens, lex, key), lex, key)
    rows = with_verdict(rows, lex, key, unit)
    limit = round(CUT_OFF_GAP * 1000) if unit == 1000 else CUT_OFF_GAP
    cut_off = lex.is_cut_off(F.col("raw"), F.col("w"), ahead(1, key), gap_after(key), limit)
    rows = rows.withColumn("label_now", F.when((F.col("label_now") == "O") & cut_off, "PW").otherwise(F.col("label_now")))
    repeated = F.col("verdict") == "disfluency"
    if not keep_ambiguous:
        repeated |= (F.col("verdict") != "disfluency") & ~lex.is_hyphen_doubled(F.col("w"))
    repeated = F.coalesce(repeated, F.lit(False)) & (F.col("label_now") != "PW")
    rows = rows.withColumn("label_now", F.when(repeated, "REP").otherwise(F.col("label_now")))
    rows = repair_windows(rows, lex, F.col("label_now").isin("FP", "DM"), key)
    reparandum, term = inside_repair(lex, key)
    rows = rows.withColumn(name, F.when(reparandum | term, "RPR").otherwise(F.col("label_now")))
    return rows.select(*[c for c in names if c != name], name)
