"""Neighbours, URL templates, secrets, shards."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkutter.llm import neighbours, secrets, sharding, urls

DOCS = "doc_id long, text string, size int, key string, shard string, base string, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", "s", "b", "x") for i, t in rows], DOCS)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "l") for i, v in rows], "vec_id long, embedding array<float>, lists int, v string")


def exact(rows, every, k):
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, (i, a) in enumerate(sound):
        if i % every == 0:
            found = sorted((-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), j) for r, (j, b) in enumerate(sound) if j != i)
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(i, rows[50][1]) for i in range(3000, 3400)]  # copies, as near as can be
    odd = [(5000, None), (5050, [0.0] * 32), (5100, [float("nan")] * 32), (5150, [None] * 32), (5200, [float("inf")] + [1.0] * 31), (None, [1.0] * 32), (5250, [1.0, 2.0])]
    got = {}
    for r in neighbours.nearest(vectors(spark, rows + odd)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact(rows, 50, 5)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert [j for j, _ in got[50]] == [3000, 3001, 3002, 3003, 3004]
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    scores = {q: dict(want[q]) for q in want}
    assert all(abs(s - scores[q][j]) < 1e-12 for q in got for j, s in got[q] if j in scores[q])


def test_few_neighbours(spark):
    got = neighbours.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])])).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(vectors(spark, [])).count() == 0
    assert neighbours.nearest(vectors(spark, [(0, [1.0])])).count() == 0


URLS = [
    "http://A.Example.ORG/es/1?x", "https://example.org/en/12#y", "http://x.org", "http://x.org/", "http://borg/", "http://a.com/fr/x", "http://a.com/de/x", "http://com/de/", "http://a.com/en/9", None, "",
    "nothing", "ftp://u.net?x=/fr/", "://", "http://a.b.example.org/en/2", "http://a.com/de", "HTTP://É.com/fr/", "http://a://b.org/q",
]


def test_rules(spark):
    def parse(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]

    rows = [(i, u, "h", "r") for i, u in enumerate(URLS + URLS)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string, template string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = parse(rows[r["page_id"]][1])
        assert (r["host"], r["path"]) == (host, path)
        fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert r["rule"] == best[0]
        assert r["verdict"] == best[1] if best[1] else r["verdict"] in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string, template string"), rules=()).filter("verdict <> 'allow' OR rule IS NOT NULL").count() == 0


def test_templates(spark):
    """Pages under a path with many blocked examples are blocked; the number in it does not matter."""
    rules = (("a.com", "/bad/1", "block"), ("a.com", "/good/1", "allow"))
    rows = [(n, f"http://a.com/{kind}/{n % 2 + 1}{n:03d}/x") for n, kind in ((i, "bad" if i % 4 < 2 else "good") for i in range(400))]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).filter("rule IS NULL")
    assert {(r["verdict"], r["path"].split("/")[1]) for r in got.collect()} == {("block", "bad"), ("allow", "good")}
    assert got.filter("template LIKE '/bad/*%'").count() == 100


BASE = (("assign", re.compile(secrets.ASSIGN)), ("access", re.compile(r"AKIA[A-Z0-9]+")), ("hex", re.compile(r"[0-9a-f]+")))


def base_spans(t):
    least = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE) for m in p.finditer(t) if least[kind](m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_secrets(spark):
    rng = random.Random(2)
    pieces = ["password", "TOKEN", "api_key", "apikey", " ", "=", ":", '"', "'", "abcdefgh", "x1", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "日本", "secret=", "\n", "=="]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "password: token: abcdefghij"), (403, "a" * 100_000 + " secret=12345678"), (None, "token = 'abcdefgh'"), (404, rows[0][1]), (404, rows[0][1])]
    got = secrets.find_spans(frame(spark, rows)).select("doc_id", secrets.written(F.col("base")).alias("b")).collect()
    assert sorted(map(repr, ((r["doc_id"], r["b"]) for r in got))) == sorted(map(repr, ((i, base_spans(t or "")) for i, t in rows)))
    assert secrets.find_spans(frame(spark, [])).count() == 0


def test_randomness(spark):
    rng = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(20)]
    words = ["".join(rng.choice(["the", "re", "ing", "tion", "an", "er"]) for _ in range(9)) for _ in range(200)] + ["=" * 40, "a" * 30, "WordWordWordWordWordWord", "-" * 25]
    rows = [(i, f"some text {k} and more") for i, k in enumerate(keys)] + [(100 + i, f"some text {w} and more") for i, w in enumerate(words)]
    found = {r["doc_id"] for r in secrets.find_spans(frame(spark, rows)).filter("size(spans) > 0").collect()}
    assert len([i for i in found if i < 100]) >= 18 and not [i for i in found if i >= 100]


def test_redaction(spark):
    rows = [(1, "x token=abcdefgh1 y"), (2, "clean"), (3, None), (1, "other"), (4, "secret=0123456789abcdef0123456789abcdef")]
    docs = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()))) == sorted(map(repr, [(1, "x [SECRET] y", 12), (2, "clean", 5), (3, None, None), (1, "other", 5), (4, "[SECRET]", 8)]))


@pytest.mark.parametrize("leaf_rows", [None, 7])
def test_shards(spark, leaf_rows):
    rng = random.Random(6)
    rows = [(i, None if i % 50 == 0 else "x" * rng.randint(0, 200) + str(rng.randint(0, 40))) for i in range(1500)]
    rows += [(i, "the same text for a third of all rows") for i in range(1500, 2200)] + [(9999, "twice")] * 3 + [(None, "é"), (3000, "y" * 3000)]
    got = sharding.shard_rows(frame(spark, rows), leaf_rows=leaf_rows).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * 3001
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    # One key order: equal texts are adjacent.
    ordered = [r["text_crc32"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(a != b for a, b in zip(ordered, ordered[1:], strict=False)) + 1 == len({r["text_crc32"] for r in got})


def test_few_shards(spark, tmp_path):
    assert sharding.shard_rows(frame(spark, [])).count() == 0
    assert [(r["shard"], r["slot"]) for r in sharding.shard_rows(frame(spark, [(1, "a")])).collect()][0][1] == 0
    docs = frame(spark, [(i, str(i)) for i in range(40)])
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == 40
