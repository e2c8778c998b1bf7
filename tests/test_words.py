"""Functions on words, against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sparkutter.functions import text as X
from sparkutter.functions.lexicon import Lexicon, plain_canonical

LEX = Lexicon.indonesian()


def values(spark, words, expression):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, raw string").withColumn("w", X.canonical(F.col("raw")))
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_canonical(spark):
    words = ["eeee", "hmmmm", "aaaaa", "", "EEEE", "Saya,", "(anak-anak)", "sa-", "-kira", "  x  ", "!!"]
    expected = ["ee", "hmm", "aa", "", "ee", "saya", "anak-anak", "sa-", "kira", "x", ""]
    assert values(spark, words, F.col("w")) == expected
    assert [plain_canonical(w) for w in words] == expected


def test_syllables_and_shapes(spark):
    assert values(spark, ["saya", "anak-anak", "mmm", "aia", ""], X.syllables(F.col("raw"))) == [2, 4, 1, 1, 1]
    assert values(spark, ["Saya", "a1", "sa-", "a-b", "x", "A1-"], X.shape(F.col("raw"))) == ["Cap", "Num", "TrailHyphen", "Hyphen", "plain", "Cap|Num|TrailHyphen"]


def test_timecode(spark):
    times = spark.createDataFrame([(0.0,), (1.5,), (61.25,), (3661.001,), (-5.0,)], "s double")
    got = [r[0] for r in times.select(X.timecode(X.milliseconds(F.col("s")))).collect()]
    assert got == ["00:00:00.000", "00:00:01.500", "00:01:01.250", "01:01:01.001", "00:00:00.000"]


def test_buckets(spark):
    import hashlib

    names = [f"u-{i}" for i in range(200)]
    for m in (5, 100):
        assert values(spark, names, X.md5_bucket(F.col("raw"), m)) == [int(hashlib.md5(n.encode()).hexdigest(), 16) % m for n in names]
    edges = spark.createDataFrame([(0.05,), (0.1,), (0.7,)], "v double").select(X.bucket(F.col("v"), (0.1, 0.5)))
    assert [r[0] for r in edges.collect()] == ["b0", "b1", "b2"]


def test_lexicon(spark):
    words = ["eh", "eee", "maaf", "jadi", "rumah", "saya", "masing-masing", "ab"]
    assert values(spark, words, LEX.category(F.col("w"))) == ["filled_pause_ambiguous", "filled_pause", "editing_term", "discourse_marker", None, None, None, None]
    assert values(spark, words, LEX.can_double(F.col("w"))) == [False, False, False, False, True, False, True, False]
    doubled = ["sayur-mayur", "a-b-c", "saya", "anak-anak", "berlari-lari", "saya-saya", "buku-bukuan", "x-", "kucing-kucing", "rumah-rumahan"]
    assert values(spark, doubled, LEX.is_hyphen_doubled(F.col("w"))) == [True, False, False, True, True, False, True, False, True, True]


@pytest.mark.parametrize(
    "raw,following,gap,expected",
    [("sa-", None, 0.0, True), ("sap", "sapi", 0.1, True), ("sap", "sapi", 0.4, False), ("saya", "sayang", 0.1, False), ("s", "sapi", 0.1, False), ("sapi", "sapi", 0.1, False), ("-", "x", 0.0, False)],
)
def test_cut_off(spark, raw, following, gap, expected):
    row = spark.createDataFrame([(raw, following, gap)], "raw string, n string, g double").withColumn("w", X.canonical(F.col("raw")))
    assert row.select(LEX.is_cut_off(F.col("raw"), F.col("w"), F.col("n"), F.col("g"), 0.35)).first()[0] is expected
