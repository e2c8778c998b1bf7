"""Exact, near and passage deduplication against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkutter.llm import exact_dedup, near_dedup, substring_dedup

SCHEMA = "doc_id long, text string, digest string, key int, g int, t string, id string, spans string"


def frame(spark, rows):
    """Documents with columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "z", "s") for i, t in rows], SCHEMA)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


ODD = [(0, None), (1, ""), (2, "a"), (3, "a"), (3, "a"), (4, "a "), (None, "a"), (5, "w " * 30_000), (6, "w " * 30_000), (None, "only null"), (7, " \n")]


@pytest.mark.parametrize("digest", [None, F.length])
def test_exact(spark, digest):
    """Also with a digest that collides."""
    got = exact_dedup.exact_groups(frame(spark, ODD), digest=digest, salts=3).collect()
    groups = {}
    for i, t in ODD:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(ODD)
    want = []
    for i, t in ODD:
        ids = groups[t or ""]
        best = max((x for x in ids if x is not None), default=None)
        want.append((i, best, len(ids), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_exact_keeps_all_columns(spark):
    kept = exact_dedup.keep_first(frame(spark, ODD))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "6", "7", "None"])
    assert exact_dedup.keep_first(frame(spark, [])).count() == 0 and exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_alignment():
    rng = random.Random(1)
    for _ in range(4000):
        a = [rng.randint(0, rng.choice([2, 8])) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 3) if rng.random() < 0.2 else x for x in a if rng.random() > 0.15]
        most, true = rng.randint(0, 9), distance(a, b)
        assert near_dedup.within(a, b, most) == (true if true <= most else None)


def near_copies(rng, n=120):
    """Groups of near copies of random texts, and texts that share a long passage."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(30)]
    texts = []
    while len(texts) < n:
        base = [word() for _ in range(rng.randint(40, 100))]
        if rng.random() < 0.4:
            base = passage + base
        for _ in range(rng.choice([1, 1, 2, 5])):
            texts.append(" ".join(word() if rng.random() < 0.015 else w for w in base))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 2])
def test_near_against_all_pairs(spark, block):
    """With a tiny block, every way of comparing large buckets is used."""
    docs = near_copies(random.Random(3))
    words = {i: t.split() for i, t in docs}
    root = {i: i for i in words}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in words:
        for j in range(i):
            longer = max(len(words[i]), len(words[j]))
            if near_dedup.within([hash(w) for w in words[i]], [hash(w) for w in words[j]], int(0.2 * longer + 1e-9)) is not None:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(frame(spark, docs), block=block).collect()}
    assert got == {i: find(i) for i in words}


def test_near_odd_rows(spark):
    long_ = " ".join(f"w{i}" for i in range(20_000))
    rows = [(0, None), (1, ""), (2, " \n "), (3, "a b c"), (4, "a  b\nc"), (5, "a b"), (6, long_), (7, long_ + " x"), (None, "a b c"), (8, "a b c"), (9, "a " * 500), (10, "a " * 450), (11, long_.replace("w5 ", "y "))]
    got = {r["doc_id"]: r for r in near_dedup.near_duplicate_classes(frame(spark, rows)).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, None: None, 8: 3, 9: 9, 10: 9, 11: 6}
    assert got[3]["class_size"] == 3 and got[3]["kept"] and not got[4]["kept"]
    kept = near_dedup.keep_one(frame(spark, rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["0", "1", "2", "3", "5", "6", "9", "None"])
    assert near_dedup.near_duplicate_classes(frame(spark, [])).count() == 0


def brute_passages(rows, window):
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    import re

    split = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("groups", [3_000_000, 50])
def test_passages(spark, groups):
    rng = random.Random(11)
    pool = [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(10, 40))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(rng.choice("mnopqrstuv") + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 4))]
        rows.append((rng.randint(0, 10_000) if rng.random() < 0.9 else i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(5, None), (6, ""), (7, "x x x " * 10), (3, "x x x " * 9), (3, "x x x " * 9), (None, pool[0]), (8, " ".join(pool)), (9, "y " * 12), (20_000, " ".join(pool))]
    got = substring_dedup.repeated_words(frame(spark, rows), group_words=groups).drop("spans").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_passages(rows, 13)


def test_no_passages(spark):
    assert substring_dedup.repeated_words(frame(spark, [])).count() == 0
    row = substring_dedup.repeated_words(frame(spark, [(1, "a b c")])).first()
    assert (row["n_words"], row["n_removed"], row["spans"]) == (3, 0, [])
