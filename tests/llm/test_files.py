"""Small tables of the near stage lie in few files, however many shuffle partitions there are."""

import random

from sparkutter.llm import near_dedup

HELD = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def documents(spark):
    rng = random.Random(7)
    rows = []
    for group in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for copy in range(6):
            now = list(words)
            for _ in range(copy):
                now[rng.randrange(60)] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(now)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_few_files(spark, monkeypatch):
    written = []

    def watched(df, write=near_dedup.materialize):
        out = write(df)
        written.append((len(out.inputFiles()), sorted(out.columns)))
        return out

    classes = lambda: sorted(map(tuple, near_dedup.near_duplicate_classes(documents(spark), block=8).collect()))
    want = classes()
    monkeypatch.setattr(near_dedup, "materialize", watched)
    before = {k: spark.conf.get(k) for k in HELD}
    for k, v in HELD.items():
        spark.conf.set(k, v)
    try:
        got = classes()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
    assert max(r[2] for r in got) == 6
    # Those that Python works out in their last stage, and the texts of a bucket that is dealt again.
    free = (["a", "b"], ["digest", "id", "key", "keys", "n", "row", "words"], ["histogram", "id", "keys", "n", "words"], ["id", "n", "words"])
    cores = spark.sparkContext.defaultParallelism
    assert all(n <= cores for n, columns in written if columns not in map(list, free)), written
    assert sum(n > cores for n, _ in written) <= 4, written
