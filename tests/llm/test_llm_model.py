"""Quality scores, pieces, packing, the pipeline."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkutter.llm import packing, pieces, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and house river letter summer quiet between window morning always garden people country".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def good(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 120))).capitalize() + "."


def bad(rng):
    return rng.choice([lambda: " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(60)), lambda: "And " * rng.randint(30, 200), lambda: " ".join(rng.choice(WORDS) + "###" for _ in range(60))])()


def corpus(seed=1, n=600):
    rng = random.Random(seed)
    truth = {i: int(rng.random() < 0.8) for i in range(n)}
    return [(i, good(rng) if y else bad(rng)) for i, y in truth.items()], truth


def test_quality(spark):
    rows, truth = corpus()
    odd = [(10_000, None), (10_001, ""), (10_002, "  \n"), (None, "x"), (10_003, "y " * 50_000), (10_003, "z")]
    stats = quality.statistics_table(frame(spark, rows + odd)).cache()
    labels = spark.createDataFrame([(i, y, 0) for i, y in truth.items()] + [(0, truth[0], 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(stats, labels)
    got = quality.scored(stats, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"] >= 0.5) == truth[r["doc_id"]] for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean(held) > 0.95
    steps = [v for _, v in model.steps]
    assert steps == sorted(steps)
    empty = quality.fit(stats, labels.limit(0))
    assert {r["score"] for r in quality.scored(stats, empty).collect()} == {0.5}
    one = quality.fit(stats, labels.filter("quality = 1"))
    assert min(r["score"] for r in quality.scored(stats, one).collect()) == 1.0
    kept = quality.keep_good(frame(spark, rows + odd), labels)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, y in truth.items() if y}
    assert quality.keep_good(frame(spark, []), labels).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, truth = corpus(2, 200)
    stats = quality.statistics_table(frame(spark, rows)).cache()
    table = lambda flip: spark.createDataFrame([(i, (1 - y) if flip and zlib.crc32(str(i).encode()) % 3 == 1 else y, 0) for i, y in truth.items()], "doc_id long, quality int, toxic int")
    a, b = (quality.fit(stats, table(f)) for f in (False, True))
    assert np.allclose(a.weights, b.weights) and a.steps == b.steps


def test_isotonic():
    assert quality.isotonic([(0, 1, 1), (1, 0, 1), (2, 1, 1), (3, 3, 3)]) == [(0, 0.5), (2, 1.0)]
    assert quality.isotonic([]) == []


ODD = [None, "", " ", "  ", "a  b", " a", "a \n b\n\n  c", "\n", "▁▁x ▁y", "日本 語テ １２3", "x" * 700, "ab" * 300 + " " + "é" * 300, "   " * 40, "\x00a", "a\U0010ffffb", "😀 é", "a\tb\r\nc"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice(" ab\nthe▁éz梦er") for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [good(rng) for _ in range(100)]


def test_pieces(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=packing.tokenizer_path(pieces.MODEL))
    docs = frame(spark, list(enumerate(texts)))
    encoded = pieces.encode(docs).cache()
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert [i for i, t in enumerate(texts) if ids[i] != library.encode(t or "")] == []
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()}
    assert [i for i in ids if back[i] != library.decode(ids[i])] == []
    assert [i for i, t in enumerate(texts) if MARKLESS(t) and back[i] != (t or "")] == []
    assert pieces.encode(frame(spark, [])).count() == 0


def MARKLESS(t):
    return "▁" not in (t or "")


def test_long_units_take_the_heap():
    encoder = pieces.PieceEncoder(packing.tokenizer_path(pieces.MODEL))
    long_ = "the" * 120
    a = encoder.encode_units(["▁" + long_, "▁the"])
    assert sum(len(encoder.pieces.bytes[i]) for i in np.frombuffer(a[0], "<i4")) == len(("▁" + long_).encode())
    grid = pieces.edges(np.frombuffer("▁thethethe".encode("utf-32-le"), np.uint32), encoder.pieces)
    b, e = pieces.relax_long(grid, 0, 10, encoder.pieces)
    (_, b2, e2) = (np.concatenate(x) for x in zip(*pieces.relax(grid, np.array([0]), np.array([10]), encoder.pieces), strict=True))
    assert (b.tolist(), e.tolist()) == (sorted(b2.tolist()), sorted(e2.tolist()))


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    rows = list(enumerate(texts)) + [(100_000, "word " * 9000), (100_001, "<|endoftext|> É <|startoftext|>x"), (None, "a"), (7, "dup"), (7, "dup")]
    table = packing.piece_table(frame(spark, rows)).cache()
    got = {}
    for r in table.collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want = [(k, k * 2048, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(ids[a : a + 2048] for a in range(0, len(ids), 2048))]
        assert set(want) <= set(got[i])
    packed = packing.pack(table, group_rows=300).collect()
    assert len(packed) == table.count()
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in packed)
    assert len(bins) <= -(-total // 2048) + -(-len(packed) // 300) + 1
    assert packing.pack(packing.piece_table(frame(spark, []))).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_capacities(rule):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 600, 800)
    sequence, offset = packing.pack_lengths(lengths, capacity=1000, documents=4, attention=400_000.0, rule=rule)
    for s in np.unique(sequence):
        part = lengths[sequence == s]
        assert part.sum() <= 1000 and len(part) <= 4 and (part.astype(float) ** 2).sum() <= 400_000 or len(part) == 1
        assert sorted(offset[sequence == s]) == sorted(np.cumsum(part[np.argsort(offset[sequence == s])]) - part[np.argsort(offset[sequence == s])])
    assert len(packing.pack_lengths(np.array([], np.int64), capacity=10, documents=2, attention=100.0)[0]) == 0


def test_word_encoder_forgets(monkeypatch):
    encoder = packing.WordEncoder(packing.tokenizer_path(packing.TOKENIZER))
    first = encoder.encode(pa.array(["a b c", None, "b"]))
    monkeypatch.setattr(packing, "KNOWN_WORDS", 1)
    again = encoder.encode(pa.array(["a b c", None, "b"]))
    assert first[0].tolist() == again[0].tolist() and first[1].tolist() == again[1].tolist()


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, truth = corpus(7, 300)
    rng = random.Random(8)
    rows = [(i, t + f" note = n{rng.randint(0, 999)}number{rng.randint(0, 99)}" if truth[i] and i % 2 else t) for i, t in rows]
    fine = [good(rng) for _ in range(3)]
    near = fine[1].split()
    near[3] = "other"
    rows += [(1000, fine[0]), (1001, fine[0]), (1002, fine[1] + " " + fine[1]), (1003, fine[1] + " " + " ".join(near)), (1004, fine[2] + " password = hunter2hunter2"), (1005, None)]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y, 0) for i, y in truth.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left, seen = docs, {}
    for name, stage in pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path)).cache()
        assert left.columns == docs.columns
        seen[name] = {r["doc_id"]: r["text"] for r in left.collect()}
    clean = {i for i, y in truth.items() if y}
    assert len(clean - set(seen["quality classifier"])) <= 0.02 * len(clean)
    assert 1000 not in seen["exact dedup"] and 1001 in seen["exact dedup"]
    assert 1002 in seen["near dedup"] and 1003 not in seen["near dedup"]
    assert seen["secret scan"][1004].endswith("[SECRET]") and seen["secret scan"][1001] == fine[0]
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(seen["secret scan"])
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None


def test_contract_columns(spark):
    """The queries' columns and types on the smallest driver tables."""
    import os

    from sparkutter.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the driver tables are not here")
    want = {
        "op2_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
        "op3_dimension_scan": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
        "op4_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op5_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op7_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
        "op8_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
        "op9_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
        "op10_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    }
    for name, columns in want.items():
        got = dict(QUERIES[name](spark, folder).dtypes)
        assert {c: got[c] for c in columns} == columns
    assert len(QUERIES) == 10
