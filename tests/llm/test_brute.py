"""Choices that SQL cannot express, against plain Python."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from sparkutter.llm import exact_dedup, near_dedup, packing, pieces, quality, secrets, sharding, urls

ODD = "doc_id long, text string, lang string, source string, n_chars long, row long, x string, used int, g int, part int, node int, at int"


def odd(spark, rows):
    """Documents whose other columns clash with names used inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2, 3, 4, 5, 6) for i, t in rows], ODD)


def brute_tree(paths, examples, blocked):
    """Purity of each (host, path), by recursion over its host's paths."""
    total, bad = sum(examples.values()), sum(blocked.values())
    base = bad / total if total else 0.0
    out = {}

    def pure(b, e, parent):
        return (b + urls.SMOOTHING * parent) / (e + urls.SMOOTHING)

    def go(members, level, parent):
        e, b = sum(examples[m] for m in members), sum(blocked[m] for m in members)
        here = pure(b, e, parent)
        deeper = [m for m in members if len(m[1].split("/")) - 1 > level]
        if not 0 < b < e:
            deeper = []
        for m in set(members) - set(deeper):
            out[m] = here
        segment = {m: m[1].split("/")[1 + level] for m in deeper}
        segment = {m: "*" if re.match(urls.VARIABLE, s) else s for m, s in segment.items()}
        pe, pb = sum(examples[m] for m in deeper), sum(blocked[m] for m in deeper)
        children = {}
        for s in set(segment.values()):
            e1, b1 = sum(examples[m] for m in deeper if segment[m] == s), sum(blocked[m] for m in deeper if segment[m] == s)
            share = pb / max(pe, 1)
            if e1 == 0 or pe - e1 == 0:
                alike = share * (1 - share) == 0
            else:
                error = math.sqrt(share * (1 - share) * (1 / e1 + 1 / (pe - e1)))
                alike = abs(b1 / e1 - (pb - b1) / (pe - e1)) <= urls.Z * error
            children.setdefault("*" if alike else s, []).extend(m for m in deeper if segment[m] == s)
        for c in children.values():
            go(c, level + 1, here)

    for host in {h for h, _ in paths}:
        go([m for m in paths if m[0] == host], 0, base)
    return out


def test_tree(spark):
    rng = random.Random(12)
    rules = (("a.com", "/x/bad", "block"), ("a.com", "/x", "allow"), ("b.com", "/1", "block"), ("b.com", "/q/w/e/r/t/y/no", "block"), ("b.com", "/q", "allow"), ("c.com", "/", "block"))
    rows = []
    for i in range(1500):
        depth = rng.randint(0, 9)
        path = "".join("/" + rng.choice(["x", "bad", "good", "1", "q", "w", str(rng.randint(0, 5)), "no", ""]) for _ in range(depth))
        if rng.random() < 0.2:
            path = "/q/w/e/r/t/y/" + rng.choice(["no", "yes", "other"]) + "/" + str(rng.randint(0, 3))
        rows.append((i, f"http://{rng.choice(['a', 'b', 'b', 'c', 'd'])}.com{path}"))
    rows += [(None, "http://b.com/x/bad"), (3, "http://b.com/x/bad"), (3, "http://b.com/x/bad"), (9_999, "http://a.com/" + "x/" * 3000 + "bad"), (10_000, None)]
    pages = spark.createDataFrame([(i, u, "h", "t", 1, "s") for i, u in rows], "page_id long, url string, host string, template string, mixed int, segment string")
    got = urls.judge(pages, rules=rules).collect()
    assert len(got) == len(rows)
    examples, blocked = {}, {}
    for r in got:
        key = (r["host"], r["path"])
        examples[key] = examples.get(key, 0) + (r["rule"] is not None)
        blocked[key] = blocked.get(key, 0) + (r["rule"] is not None and r["verdict"] == "block")
    want = brute_tree(set(examples), examples, blocked)
    assert max(abs(r["purity"] - want[r["host"], r["path"]]) for r in got) < 1e-9
    assert all(r["verdict"] == ("block" if r["purity"] >= urls.THRESHOLD else "allow") for r in got if r["rule"] is None)


def brute_p(s):
    """The battery on one string, with exact tails of the same approximations."""
    alphabet = next(a for p, a in secrets.ENCODINGS if re.search(p or "", s))
    k, n = len(alphabet), len(s)
    v = [alphabet.index(c) + 1 for c in s]
    chi = sum((v.count(x) - n / k) ** 2 / (n / k) for x in range(1, k + 1))
    side = (k // 2) / k
    p = 2 * side * (1 - side)
    changes = sum((a > k / 2) != (b > k / 2) for a, b in zip(v, v[1:]))
    runs = (changes - (n - 1) * p) ** 2 / ((n - 1) * p * (1 - p))
    mean = sum(v) / n
    around = sum((x - mean) ** 2 for x in v)
    serial = (sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / around + 1 / n) ** 2 * n if around else n
    beyond, free = n * (k * (secrets.NUMBERS if k == 16 else secrets.WRITING) - 1), k + 1
    scale, h = (free + 2 * beyond) / (free + beyond), (free + beyond) ** 2 / (free + 2 * beyond)
    z = (((chi + runs + serial) / (scale * h)) ** (1 / 3) - 1 + 2 / (9 * h)) / math.sqrt(2 / (9 * h))
    return chi, runs, serial, 0.5 * math.erfc(-z / math.sqrt(2))


def strings():
    rng = random.Random(5)
    out = ["".join(rng.choice(a) for _ in range(n)) for _, a in secrets.ENCODINGS for n in (20, 24, 31, 32, 50, 64, 120)]
    out += ["".join(rng.choice(["the", "re", "ing", "tion", "an", "er", "Of", "_"]) for _ in range(n)) for n in (9, 12, 20, 60)]
    return out + ["a" * 30, "=" * 40, "0123456789" * 3, "abcdefghijklmnopqrstuvwxyz0123456789", "ab" * 20]


def test_battery(spark):
    got = secrets.battery(spark.createDataFrame([(s,) for s in strings()], "s string"), "s").collect()
    for r in got:
        chi, runs, serial, p = brute_p(r["s"])
        assert r["chi"] == pytest.approx(chi, abs=1e-6) and r["runs"] == pytest.approx(runs, abs=1e-6) and r["serial"] == pytest.approx(serial, abs=1e-6)
        assert r["p"] == pytest.approx(p, rel=0.02, abs=2e-7)


def test_added_spans(spark):
    """All candidates, their p-values and the rule for each class of lengths, from the texts on."""
    rng = random.Random(6)
    pool = strings()
    rows = [(i, " ".join(rng.choice([rng.choice(pool), "word", "token = 'abcdefgh" + rng.choice(pool) + "'", "tail"]) for _ in range(6))) for i in range(150)]
    rows += [(1, rows[1][1]), (1, "other " + pool[5]), (None, pool[40]), (500, None), (501, "x" * 30_000 + " " + pool[41] + " secret=0123456789")]
    tests, base = [], {}
    for at, (_, t) in enumerate(rows):
        spans = []
        for kind, pattern in enumerate((secrets.ASSIGN, r"AKIA[A-Z0-9]+", r"[0-9a-f]+")):
            for m in re.finditer(pattern, t or ""):
                if len(m[0 if kind else 2]) >= (8, 16, 32)[kind]:
                    spans.append((m.start(), kind, m.end()))
        base[at] = spans
        for m in re.finditer(secrets.TOKEN, t or ""):
            if not any(a < m.end() and m.start() < b for a, _, b in spans):
                tests.append((at, m.start(), m.end(), brute_p(m[0])[3]))
    size = lambda x: max(c for c, (least, _) in enumerate(secrets.LENGTHS) if x[2] - x[1] >= least)
    q = lambda x: min(3000, max(0, math.floor(-10 * math.log10(max(x[3], 1e-300)))))
    added = {}
    for c in range(len(secrets.LENGTHS)):
        own = [x for x in tests if size(x) == c]
        cut = [k for k in {q(x) for x in own} if 10 ** (-k / 10) * len(own) <= secrets.RATE * secrets.LENGTHS[c][1] * sum(q(x) >= k for x in own)]
        for x in own:
            if cut and q(x) >= min(cut):
                added.setdefault(x[0], []).append((x[1], 3, x[2]))
    got = sorted(repr((r["doc_id"], [tuple(x) for x in r["spans"]])) for r in secrets.find_spans(odd(spark, rows)).collect())
    assert got == sorted(repr((i, sorted(base[at] + added.get(at, [])))) for at, (i, _) in enumerate(rows))
    assert sum(map(len, added.values())) > 20


def test_masks(spark):
    """Chunk by chunk, also across their ends, and rows that share an id."""
    rows = [(1, "é" * 13 + " token=abcdefgh1 " + "y" * 9), (1, "token=abcdefgh1"), (1, "clean"), (2, "secret: 0123456789abcdef0123456789abcdef z password=hunter2hunter2"), (None, "日本 api_key = 'q" + "w" * 40 + "' 日"), (3, None), (4, "x " * 500)]
    want = []
    for i, t in rows:
        spans = sorted((m.start(), m.end()) for p, least in ((secrets.ASSIGN, 0), (r"[0-9a-f]+", 32)) for m in re.finditer(p, t or "") if len(m[0]) >= least)
        out, at = "", 0
        for a, b in spans:
            out, at = (out + t[at:a] + "[SECRET]", b) if a >= at else (out, max(at, b))
        want.append((i, out + (t or "")[at:] if t is not None else None))
    for chunk in (7, 4096):
        assert sorted(repr((r["doc_id"], r["text"])) for r in secrets.redact(odd(spark, rows), chunk=chunk).collect()) == sorted(map(repr, want))


def test_splitters(spark):
    """Against all row boundaries in key order."""
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(900)] + [(i, "a hot text") for i in range(900, 1500)]
    got = sharding.shard_rows(odd(spark, rows), shards=8, leaf_rows=20).collect()
    got.sort(key=lambda r: (r["key"], r["doc_id"]))
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    edges = np.concatenate([[0], np.cumsum([r["size"] for r in got])])
    for s in range(1, 8):
        target = edges[-1] * s / 8
        cut = edges[sum(r["shard"] < s for r in got)]
        assert abs(cut - target) <= np.abs(edges - target).min() + 0.001 * edges[-1] / 8 + 1e-9
    for s in range(8):
        assert [r["slot"] for r in got if r["shard"] == s] == list(range(sum(r["shard"] == s for r in got)))


def test_normal_equations(spark):
    """Partition sums, ridge weights and calibration against one matrix."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["good", "words", "AND", "##", "123"]) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    stats = quality.statistics_table(odd(spark, rows)).cache()
    labels = spark.createDataFrame([(i, int("##" not in t[: len(t) // 3]), 0) for i, t in rows], "doc_id long, quality int, toxic int")
    model = quality.fit(stats.repartition(7), labels)
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    x = {r["doc_id"]: r["x"] for r in stats.collect()}
    part = lambda r: [i for i in x if zlib.crc32(str(i).encode()) % 3 == r]
    a = np.array([x[i] for i in part(0)])
    assert np.allclose(model.mean, a.mean(axis=0)) and np.allclose(model.scale, np.maximum(a.std(axis=0), 1e-3))
    f = model.features(a)
    t = np.array([y[i] for i in part(0)], float)
    n, size = len(a), f.shape[1]
    assert np.allclose(model.weights, np.linalg.solve(f.T @ f + 1e-3 * n * np.eye(size) / size, f.T @ t), atol=1e-6)
    raw = np.round(np.clip(model.raw(np.array([x[i] for i in part(2)])), -1, 2) * (quality.BINS / 3)) / (quality.BINS / 3)
    ys = np.array([y[i] for i in part(2)], float)
    # Isotonic least squares by its min-max formula.
    at = sorted(set(raw))
    mean = lambda i, j: ys[(raw >= at[i]) & (raw <= at[j])].mean()
    for i, s in enumerate(at):
        want = max(min(mean(j, k) for k in range(i, len(at))) for j in range(i + 1))
        assert [v for b, v in model.steps if b <= s + 1e-12][-1] == pytest.approx(want)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_bins(rule):
    """Every choice of a bin's next piece, among all pieces one by one."""
    rng = np.random.default_rng(8)
    lengths = np.concatenate([rng.integers(1, 90, 150), rng.integers(1, 4, 40), [100, 100, 99]])
    limits = dict(capacity=100, documents=6, attention=31 / 32 * 100 * 100)
    left, want = sorted(lengths.tolist()), []
    w = (1.0, 0.05, 0.05)
    while left:
        bins, n = [], left[-1]
        room, docs, budget = limits["capacity"], limits["documents"], limits["attention"]
        while True:
            left.remove(n)
            bins.append(n)
            room, docs, budget = room - n, docs - 1, budget - n * n
            fits = [m for m in left if m <= room and m * m <= budget and docs > 0]
            if not fits:
                break
            residual = (room / limits["capacity"], docs / limits["documents"], budget / limits["attention"])
            item = lambda m: (m / limits["capacity"], 1 / limits["documents"], m * m / limits["attention"])
            cost = (lambda m: -sum(a * b * c for a, b, c in zip(w, item(m), residual))) if rule == "dot" else (lambda m: sum(a * (c - b) ** 2 for a, b, c in zip(w, item(m), residual)))
            n = min(sorted(set(fits)), key=lambda m: (round(cost(m), 12), m))
        want.append(sorted(bins))
    sequence, _ = packing.pack_lengths(lengths, rule=rule, **limits)
    got = [sorted(lengths[sequence == s].tolist()) for s in np.unique(sequence)]
    assert sorted(got) == sorted(want)
    assert any(len(b) == 6 for b in got) and any(sum(x * x for x in b) > 0.9 * limits["attention"] for b in got)


def test_groups_are_packed_again(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(600, 1500)) for i in range(400)]
    table = packing.materialize(packing.piece_table(odd(spark, rows)))
    counts = {}
    for size in (40, 100_000):
        out = packing.pack(table, group_rows=size).collect()
        assert sorted((r["doc_id"], r["piece"], r["length"]) for r in out) == sorted((r["doc_id"], r["piece"], r["length"]) for r in table.collect())
        bins = {}
        for r in out:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for b in bins.values():
            b.sort()
            assert [a for a, _ in b] == np.concatenate([[0], np.cumsum([n for _, n in b])])[:-1].tolist() and sum(n for _, n in b) <= 2048
        counts[size] = len(bins)
    assert counts[40] <= 1.03 * counts[100_000] + 1


def test_rows_that_share_an_id(spark):
    """Content decides, not the id."""
    rows = [(3, "a"), (3, "b"), (5, "b"), (4, None), (4, ""), (None, "a"), (None, "c"), (None, "c"), (5, "b")]
    kept = exact_dedup.keep_first(odd(spark, rows))
    assert kept.columns == odd(spark, []).columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == [("3", "a"), ("4", ""), ("5", "b"), ("None", "c")]
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c = text(60), text(60), text(60)
    rows = [(1, a), (3, a + " x"), (3, b), (7, b + " y"), (3, c), (3, c), (None, a), (9, "")]
    got = near_dedup.near_duplicate_classes(odd(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["class_id"], r["class_size"], r["kept"]) for r in got) == sorted([("1", 1, 2, True), ("3", 1, 2, False), ("3", 3, 2, True), ("7", 3, 2, False), ("3", 3, 2, True), ("3", 3, 2, False), ("None", None, 1, True), ("9", 9, 1, True)])
    kept = near_dedup.keep_one(odd(spark, rows))
    assert kept.columns == odd(spark, []).columns
    assert sorted(r["text"] for r in kept.collect()) == sorted([a, b, c, a, ""])


def test_names_that_clash(spark):
    rows = [(1, "one text"), (None, None), (2, ""), (2, "two")]
    docs = odd(spark, rows)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in quality.scored(quality.statistics_table(docs), quality.fit(quality.statistics_table(docs), labels)).collect()) == ["1", "2", "2", "None"]
    assert pieces.encode(docs).count() == 4 and packing.pack(packing.piece_table(docs)).count() == 4
    assert sorted(str(r["doc_id"]) for r in packing.pack(packing.piece_table(docs)).collect()) == ["1", "2", "2", "None"]


def test_a_long_unit(monkeypatch):
    """One word longer than an index, with and without places that no piece crosses."""
    rng = random.Random(7)
    encoder = pieces.PieceEncoder(packing.tokenizer_path(pieces.MODEL))
    units = ["".join(rng.choice("qzxjvwk7日") for _ in range(6000)), "the" * 1500]
    whole = [encoder.encode_units([u])[0] for u in units]
    monkeypatch.setattr(pieces, "INDEX_CHARS", 700)
    parts = list(encoder.separate(units[0]))
    assert len(parts) > 5 and "".join(parts) == units[0]
    assert encoder.lookup(units) == whole
    monkeypatch.undo()
    data = encoder.lookup(["qz" * 1_500_000])[0]
    assert sum(len(encoder.pieces.bytes[i]) for i in np.frombuffer(data, "<i4")) == 3_000_000


def test_empty_tables_through_the_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    odd(spark, []).write.parquet(str(tmp_path / "a/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "a/labels.parquet"))
    assert pipeline.run(spark, str(tmp_path / "a")).count() == 0
    rows = [(None, "no id"), (None, None), (1, "x" * 200_000), (2, "word " * 30_000), (2, "word " * 30_000 + "end"), (3, None), (3, "")]
    odd(spark, rows).write.parquet(str(tmp_path / "b/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "b/labels.parquet"))
    out = pipeline.run(spark, str(tmp_path / "b")).collect()
    # Without labels nothing is rejected; of equal texts one stays, of near copies, too.
    assert sorted({str(r["doc_id"]) for r in out}) == ["1", "2", "3", "None"]
    lengths = {}
    for r in out:
        lengths.setdefault(str(r["doc_id"]), 0)
        lengths[str(r["doc_id"])] += r["length"]
    assert lengths["3"] == 1


def test_intermediate_tables_go(spark, tmp_path):
    from sparkutter.llm import common

    kept = []

    def make():
        kept.append(common.materialize(spark.range(5)))
        return kept[0].filter("id > 2")

    out = common.settled(make)
    assert out.count() == 2
    left = {f.split("/")[-2] for f in out.inputFiles()}
    folder = common.own_folder(spark).removeprefix("file:")
    import os

    assert left <= set(os.listdir(folder)) and not {f.split("/")[-2] for f in kept[0].inputFiles()} & set(os.listdir(folder))
    assert not getattr(common._open, "scopes", None)


def test_neighbours_that_share_an_id(spark):
    from sparkutter.llm import neighbours

    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (None, [1.0, 0.0]), (0, [0.5, 0.5])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["query_id"] for r in got} == {0} and {r["vec_id"] for r in got} == {1}
