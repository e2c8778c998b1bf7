"""Compaction of a word graph against plain Python."""

import random

from sparkutter.llm import substring_dedup


def brute(pieces):
    """Join piece after piece wherever all that come to a place go on there, and none begins."""
    rows = [list(p) for p in pieces]
    place = lambda p: (p[3], p[4] + p[2])
    nodes, goes_on = {}, {}
    begin = {(p[0], p[1], p[3], p[4]): p for p in map(tuple, rows)}
    for p in map(tuple, rows):
        nodes.setdefault(place(p), [0, 0, 0])[0] += 1
        nodes.setdefault((p[3], p[4]), [0, 0, 0])[1] += 1
        following = begin.get((p[0], p[1] + p[2], p[3], p[4] + p[2]))
        if following:
            goes_on[p] = following
            nodes[place(p)][2] += 1
    plain = {n for n, (coming, going, passing) in nodes.items() if coming == going == passing}
    joined = {goes_on[p] for p in goes_on if place(p) in plain}
    out = []
    for p in map(tuple, rows):
        if p not in joined:
            windows, q = p[2], p
            while q in goes_on and place(q) in plain:
                q = goes_on[q]
                windows += q[2]
            out.append((p[0], p[1], windows, p[3], p[4]))
    return sorted(out)


def test_compaction(spark):
    rng = random.Random(4)
    pieces = []
    for tag in range(60):
        at = 0
        for _ in range(rng.randint(1, 6)):  # walks along sources, cut at places that many share
            source, a, at = rng.randint(100, 102), 10 * rng.randint(0, 5), at + rng.randint(0, 1) * 3
            for _ in range(rng.randint(1, 9)):
                n = 10 if rng.random() < 0.9 else 5
                pieces.append((tag, at, n, source, a))
                at, a = at + n, a + n
    pieces += [(200, 0, 3, 300, 7), (200, 3, 4, 300, 10), (200, 7, 1, 300, 14)]
    got = substring_dedup.compact(spark.createDataFrame(pieces, substring_dedup.PATH))
    assert sorted((r["tag"], r["first"], r["windows"], r["source"], r["source_first"]) for r in got.collect()) == brute(pieces)
    assert (200, 0, 8, 300, 7) in brute(pieces) and len(brute(pieces)) < len(pieces)
    assert substring_dedup.compact(spark.createDataFrame([], substring_dedup.PATH)).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:200_000]) + " end"), (3, "x " * 50_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, tag string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_words(docs).collect()}
    assert got == {1: 0, 2: 199_000, 3: 0}
