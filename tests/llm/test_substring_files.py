"""Tables of op2 lie in few files, however many shuffle partitions there are."""

import random

from sparkutter.llm import substring_dedup

HELD = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def documents(spark):
    rng = random.Random(7)
    passages = [[f"p{rng.randrange(5000)}" for _ in range(40)] for _ in range(60)]
    rows = []
    for i in range(300):
        own = [f"w{rng.randrange(5000)}" for _ in range(30)]
        rows.append((i, " ".join([*own, *passages[i % 60], *passages[7 * i % 60][:20], *own[:5]])))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_few_files(spark, monkeypatch):
    written = []

    def watched(df, write=substring_dedup.materialize):
        out = write(df)
        written.append((len(out.inputFiles()), sorted(out.columns)))
        return out

    words = lambda: substring_dedup.repeated_words(documents(spark))
    want = sorted(map(tuple, words().collect()))
    monkeypatch.setattr(substring_dedup, "materialize", watched)
    before = {k: spark.conf.get(k) for k in HELD}
    for k, v in HELD.items():
        spark.conf.set(k, v)
    try:
        got = sorted(map(tuple, substring_dedup.materialize(words()).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
    assert sum(r[2] for r in got) > 5000
    cores = spark.sparkContext.defaultParallelism
    # Python works the paths out in their last stage.
    paths = sorted(["tag", "first", "windows", "source", "source_first"])
    many = [columns for n, columns in written if n > cores]
    assert len(written) > 8
    assert many in ([], [paths]), written
