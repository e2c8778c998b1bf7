"""Cuts, ASR post-processing, audits, sources."""

import json
import struct
import wave

import pytest
from pyspark.sql import functions as F

from sparkutter.functions.lexicon import Lexicon
from sparkutter.operators import asr, audit, edl
from sparkutter.sources import corpora, simulate
from test_detect import sentence

LEX = Lexicon.indonesian()


def words(spark, items, file="f"):
    return spark.createDataFrame([(file, n, *x) for n, x in enumerate(items)], "file string, n int, text string, start double, end double")


def test_edl_invariants(spark):
    table = sentence(spark, [("eee", "FP"), ("jadi", "O"), ("saya", "REP"), ("saya", "O"), ("mau", "O"), ("per-", "PW"), ("pergi", "O"), ("eee", "FP")], gap=0.2).withColumn("source", F.lit("a.mp4"))
    bounds = edl.timeline(table)
    cuts = edl.merge_cuts(edl.raw_cuts(table))
    kept = edl.keeps(cuts, bounds)
    parts = sorted([(r["start"], r["end"]) for r in cuts.collect()] + [(r["start"], r["end"]) for r in kept.collect()])
    assert parts[0][0] == bounds.first()["begin"] and parts[-1][1] == bounds.first()["finish"]
    assert all(a[1] == pytest.approx(b[0]) for a, b in zip(parts, parts[1:], strict=False))
    spoken = [(r["start"], r["end"]) for r in table.filter("label = 'O'").collect()]
    assert all(c["end"] <= s or c["start"] >= e for c in cuts.collect() for s, e in spoken)
    stats = edl.statistics(cuts, kept, bounds).first()
    assert stats["kept"] + stats["removed"] == pytest.approx(stats["duration"])
    assert "concat=n=" in edl.ffmpeg_command(kept, bounds).first()["command"]
    assert edl.ffmpeg_command(kept.limit(0), bounds).first()["command"].startswith("#")
    assert edl.extend(kept, F.lit(99.0)).agg(F.min("start"), F.max("end")).first() == (0.0, 99.0)
    with pytest.raises(ValueError):
        edl.ffmpeg_arguments("a", "b", "")


def test_proof_clips(spark):
    cuts = spark.createDataFrame([("s", 0, 10.0, 10.4), ("s", 1, 11.0, 11.5)], "source string, n int, start double, end double")
    bounds = spark.createDataFrame([("s", 0.0, 20.0)], "source string, begin double, finish double")
    clips = edl.proof_clips(cuts, bounds, pad=5.0).orderBy("n", "part").collect()
    assert all(c["end"] <= 11.0 for c in clips[:3]) and all(c["start"] >= 10.4 for c in clips[3:])
    assert edl.proof_clips(cuts, bounds, pad=5.0, most=1).count() == 3


def test_write_edl(spark, tmp_path):
    table = sentence(spark, [("eee", "FP"), ("jadi", "O")], gap=0.2).withColumn("source", F.lit("a.mp4"))
    paths = edl.write_edl(table, str(tmp_path / "edl"))
    row = spark.read.json(paths["json"]).first()
    assert row["source"] == "a.mp4" and row["cuts"][0]["label"] == "FP" and row["after"] == "jadi"
    assert spark.read.csv(paths["csv"], header=True).count() == 1


@pytest.mark.parametrize("times,found", [(3, []), (4, [(0, 4)]), (26, [(0, 26)])])
def test_loops(spark, times, found):
    rows = words(spark, [("ya ", k * 1.0, k + 0.5) for k in range(times)])
    assert [(r["begin"], r["stop"]) for r in asr.loops(rows).collect()] == found
    left = asr.without_loops(rows, asr.loops(rows)).count()
    assert left == (0 if found else times)


def test_loops_against_a_scan(spark):
    import random

    rng = random.Random(5)
    for _ in range(6):
        t = [rng.choice("ab") for _ in range(40)]
        candidates = []
        for i in range(len(t)):
            for n in range(1, 5):
                k = 1
                while t[i + k * n : i + (k + 1) * n] == t[i : i + n] and i + (k + 1) * n <= len(t):
                    k += 1
                if k >= 4:
                    candidates.append((i, i + k * n, n, k))
        got = {(r["begin"], r["stop"], r["period"], r["rounds"]) for r in asr.loop_candidates(words(spark, [(x, 0.0, 0.0) for x in t])).collect()}
        assert got == set(candidates)


def test_segments_and_utterances(spark):
    rows = words(spark, [("a", 0.0, 0.2), ("b", 1.0, 1.2), ("c", 2.1, 2.2)])
    assert asr.segments(rows).count() == 3
    assert asr.utterances(rows).select("uid").distinct().count() == 2
    glued = asr.utterances(words(spark, [("kira", 0.0, 0.2), ("-kira", 0.2, 0.4), ("saja", 0.4, 0.5), ("sa-", 0.5, 0.6), ("-sapi", 0.6, 0.7), ("-", 0.7, 0.8), ("!!", 0.8, 0.9), ("x", 1.0, 0.9)]))
    assert [(r["raw"], r["end"]) for r in glued.orderBy("i").collect()][:4] == [("kira-kira", 0.4), ("saja", 0.5), ("sa-", 0.6), ("-sapi", 0.7)]
    assert glued.count() == 4


def test_json_shapes(spark, tmp_path):
    word = {"word": " hai", "start": 0.0, "end": 0.5}
    shapes = {"a": {"segments": [{"words": [word]}, {"words": None}], "words": []}, "b": {"words": [word]}, "c": [{"text": "hai", "start": 0.0, "end": 0.5}]}
    for name, x in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(x))
    rows = corpora.asr_words(spark, str(tmp_path))
    assert sorted((r["file"], r["text"].strip()) for r in rows.collect()) == [("a", "hai"), ("b", "hai"), ("c", "hai")]


def test_silence(spark, tmp_path):
    def write(name, samples, channels=1):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(channels), w.setsampwidth(2), w.setframerate(16000)
            w.writeframes(struct.pack(f"<{len(samples)}h", *samples))

    write("a.wav", [0] * 1600 + [8000, -8000] * 1600 + [0] * 1600)
    write("b.wav", [1] * 10)
    got = {r["file"]: r["silent"] for r in asr.silence_profile(spark, str(tmp_path / "*.wav")).collect()}
    assert got["a"] == [True] * 10 + [False] * 20 + [True] * 9 and got["b"] == []
    table = words(spark, [("x", 0.05, 0.35), ("y", 0.34, 0.39)], "a")
    out = asr.trimmed(table, asr.silence_profile(spark, str(tmp_path / "a.wav"))).orderBy("n").collect()
    assert (out[0]["start"], out[0]["end"], out[0]["changed"]) == (0.1, 0.3, True)
    assert (out[1]["start"], out[1]["changed"]) == (0.34, False)
    write("c.wav", [0] * 3200, channels=2)
    with pytest.raises(Exception, match="mono"):
        asr.silence_profile(spark, str(tmp_path / "c.wav")).collect()


def test_audits(spark):
    rows = words(spark, [("satu", 0.0, 0.5), ("dua", 0.45, 1.0), ("eee", 1.13, 1.4), ("tiga", 1.7, 2.0)])
    table = asr.utterances(rows)
    gap = audit.gap_audit(table, LEX, ["file", "uid"], "file").filter("file IS NULL").first()
    assert (gap["gaps"], gap["zero"], gap["reduplication"], gap["grey"], gap["disfluency"]) == (3, 1, 1, 1, 1)
    whole = audit.audit(table, LEX, ["file", "uid"]).filter("file = 'f'").first()
    assert whole["tokens"] == 4 and whole["filled_pause"] == 1 and whole["events"] is None or whole["events"] == 0
    media = spark.createDataFrame([("f", 10.0)], "file string, seconds double")
    notes = audit.file_notes(audit.speech(table, ["file", "uid"], "file").withColumn("pauses_missing", F.lit(False)), media).filter("file = 'f'").first()
    assert notes["coverage"] == pytest.approx(0.2) and notes["notes"] == ["low coverage"]


def test_provenance(spark, tmp_path):
    def write(*rows):
        path = tmp_path / "p.csv"
        path.write_text("\n".join([",".join(corpora.PROVENANCE), *rows]) + "\n")
        return str(path)

    good = "a.mp4,t,s,http://x,,l,2020,2021,60,240,30,i,c"
    rows = corpora.read_provenance(spark, write(good, ",,,,,,,,,,,,", "b.mp4,t,BELUM DICATAT,http://y,http://z,l,2020,2021,10,BELUM DICATAT,,i,c"))
    report = {r["berkas"]: r for r in corpora.provenance_report(rows).collect()}
    assert report["a.mp4"]["quoted_share"] == 0.25 and report["a.mp4"]["ready"] and report["a.mp4"]["address"] == "http://x"
    assert report["b.mp4"]["quoted_share"] is None and report["b.mp4"]["open"] == ["penutur"] and report["b.mp4"]["address"] == "http://z"
    for bad in ((good, good), (good.replace("60", "x"),)):
        with pytest.raises(ValueError):
            corpora.read_provenance(spark, write(*bad))
    with pytest.raises(ValueError):
        corpora.only_named(rows, ["zzz"])


def test_corpus_round_trip(spark, tmp_path):
    path = tmp_path / "c.txt"
    path.write_text("# x\n\neee/FP saya/REP saya mau/XX a/b/DM /FP\nsatu dua\n")
    table = simulate.build_corpus(spark, str(path))
    assert [(r["raw"], r["label"]) for r in table.orderBy("utt_seq", "i").collect()] == [("eee", "FP"), ("saya", "REP"), ("saya", "O"), ("mau/XX", "O"), ("a/b", "DM"), ("/FP", "O"), ("satu", "O"), ("dua", "O")]
    assert table.filter("end < start").count() == 0 and simulate.build_corpus(spark, str(path)).exceptAll(table).count() == 0
    n = corpora.write_utterances(table.withColumn("speaker", F.lit("S1")), str(tmp_path / "out"))
    back = corpora.read_utterances(spark, str(tmp_path / "out"))
    assert n == 2 and back.select("uid", "i", "raw", "label", "start").exceptAll(table.select("uid", "i", "raw", "label", "start")).count() == 0
    with pytest.raises(Exception, match="bad token"):
        corpora.check_tokens(back.withColumn("label", F.lit("ZZ"))).collect()


def test_stream(spark, tmp_path):
    from sparkutter.streaming.sessions import live_utterances

    (tmp_path / "in").mkdir()
    rows = [{"file": "f", "start": s, "end": s + 0.3, "text": t} for s, t in ((0.0, "a"), (0.4, "b"), (2.0, "c"), (5.0, "d"))]
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("file string, start double, end double, text string").json(str(tmp_path / "in"))
    query = live_utterances(stream, patience_ms=3_600_000).writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["utterance"], r["text"]) for r in spark.sql("SELECT * FROM closed ORDER BY utterance").collect()] == [(0, "a b"), (1, "c")]
