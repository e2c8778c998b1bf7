"""Removal of passages that repeat across documents, by a compacted de Bruijn graph of word windows.

Every window of 13 words is an edge of the graph. An edge repeats if it occurs in two documents; a word goes
if one of its edges also occurs in a document with a smaller id. Only the first document of each word sequence
enters the graph: of any other, all windows repeat.

1. Seeds. The smallest hash among the five-word runs of a window is its minimiser; equal windows have equal
   ones, and neighbouring windows mostly share theirs. Minimisers are packed by batch and sent to groups by
   their value; a group returns those that two documents have. A minimiser that already repeats inside a batch
   is known there, and only one entry of it is sent: a passage in a third of all documents costs one entry a
   batch.
2. Edges. Windows with such a minimiser are sent to the group of that minimiser, again with one document's
   entries for what repeats inside a batch. There every occurrence finds the smallest document with that edge,
   and neighbouring occurrences whose sources are neighbours as well compact into one path.
3. Compaction. The nodes of the graph are the places in the sources where paths begin and end. Nonbranching ones,
   which every path that comes to them leaves in the same way, are compacted by joins of path ends with path
   beginnings and pointer jumping; so all documents that share a stretch have it cut at the same places.
4. Verification. Each path's source words are cut out of the source document and digested (128 bits), once for
   every distinct stretch; the digest is joined to the paths and must be that of the document's own words. So
   the 64-bit hashes of edges only propose.

Group sizes follow from the number of words, so memory is bounded at every input size. What stays is joined
with the texts once more to cut the words out.

Cases: null and empty texts have no words and kept text '' (sha256 of nothing); texts shorter than a window
lose nothing; a null id neither removes nor loses; rows with one id are one document, whose windows do not
remove each other across its rows; empty tables give empty results; further columns are ignored whatever
their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, materialize, shuffle_partitions, spread_join, table
from .near_dedup import arrays, run_hashes
from .packing import runs, strings

WINDOW = 13
SEED = 5
GROUP_WORDS = 3_000_000
#: Words in each file of texts, at most, unless there are fewer files than cores.
FILE_WORDS = 1_000_000
_LOW = np.uint64(0xFFFFFFFFFFFF)


class WordHasher:
    """64-bit hashes of words (the same as Spark's xxhash64), with those met before looked up."""

    def __init__(self, most: int = 200_000):
        from xxhash import xxh64_intdigest

        self.digest, self.known, self.most = xxh64_intdigest, {}, most

    def __call__(self, texts: list[bytes]):
        """The hashes of each text's words, which single spaces separate."""
        known, digest = self.known, self.digest
        if len(known) > self.most:
            known.clear()
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        words = split.flatten().dictionary_encode()
        names = strings(words.dictionary)
        for w in names:
            if w not in known:
                known[w] = digest(w.encode(), seed=42)
        hashes = np.fromiter(map(known.__getitem__, names), np.uint64, len(names))[words.indices.to_numpy()]
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        return (hashes[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def sha(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def minimisers(hashes: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The minimiser of every window (48 bits), or nothing if the text is too short."""
    if len(hashes) < window:
        return np.empty(0, np.uint64)
    runs = run_hashes(hashes, seed) & _LOW
    best, reach = runs, 1
    span = window - seed + 1
    while 2 * reach <= span:  # the minimum over twice the reach
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    return np.minimum(best[: len(hashes) - window + 1], best[span - reach :]) if span > reach else best


def pack(fields: list[np.ndarray]) -> bytes:
    return len(fields[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(f).tobytes() for f in fields)


def unpack(data: bytes, kinds: list) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(data, kind, n, at))
        at += size
    return out


def pack_runs(owner: np.ndarray) -> bytes:
    """A column with long runs of one value."""
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    return pack([owner[cut], np.diff(np.append(cut, len(owner))).astype(np.uint32)])


def unpack_runs(data: bytes) -> np.ndarray:
    value, times = unpack(data, [np.int64, np.uint32])
    return np.repeat(value, times)


def starts(*columns: np.ndarray) -> np.ndarray:
    """True where any of the columns changes."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t (the words, joined by single spaces) and tag, a hash of t."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    # Only texts that need it go through the pattern.
    text = F.trim(F.when(F.instr(text, "  ") > 0, F.regexp_replace(text, " +", " ")).otherwise(text))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    return rows.withColumn("tag", F.xxhash64("t"))


def survey(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tag of the word sequence, n_words, sha256 of all words."""
    n = F.when(F.col("t") == "", 0).otherwise(F.octet_length("t") - F.octet_length(F.replace("t", F.lit(" "), F.lit(""))) + 1)
    return plain(docs, id_col, text_col).select("doc_id", "tag", n.cast("long").alias("n_words"), F.sha2("t", 256).alias("sha"))


def by_tag(tags: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """(tag, its packed columns) of each tag."""
    order = np.argsort(tags, kind="stable")
    tags, columns = tags[order], [c[order] for c in columns]
    cut = np.flatnonzero(starts(tags))
    return [(int(tags[i]), pack([c[i:j] for c in columns])) for i, j in zip(cut, np.append(cut, len(tags))[1:], strict=True)]


def packed_batch(rows: list[tuple[int, int | None, bytes]]) -> pa.RecordBatch:
    """Rows of a known tag, or entries of many (tag None: ``many``; a null would make pandas round the others)."""
    columns = list(zip(*((p, t is None, t or 0, d) for p, t, d in rows), strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], ["part", "many", "tag", "data"])


def shared_seeds(docs: DataFrame, id_col: str, text_col: str, groups: int, window: int, seed: int) -> DataFrame:
    """tag and data: minimisers of a word sequence that another one has as well."""

    def emit(batches):
        for batch in batches:
            own, hashed = batch.column(0).to_pylist(), list(arrays(batch.column(1)))
            for a, b in runs(map(len, hashed), 1_000_000):
                seeds, tags = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
                for tag, h in zip(own[a:b], hashed[a:b], strict=True):
                    seeds.append(np.unique(minimisers(h, window, seed)))
                    tags.append(np.full(len(seeds[-1]), tag, np.int64))
                m, t = np.concatenate(seeds), np.concatenate(tags)
                order = np.lexsort((t, m))
                m, t = m[order], t[order]
                once = starts(m, t)  # not again for a copy
                m, t = m[once], t[once]
                first = starts(m)
                times = np.diff(np.append(np.flatnonzero(first), len(m)))
                known = np.repeat(times > 1, times)
                rows = [(abs(tag) % groups, tag, data) for tag, data in by_tag(t[known], m[known])]
                m, t = m[first], t[first]
                part = (m % np.uint64(groups)).astype(np.int64)
                order = np.lexsort((t, part))
                m, t, part = m[order], t[order], part[order]
                cut = np.flatnonzero(starts(part))
                for i, j in zip(cut, np.append(cut, len(m))[1:], strict=True):
                    six = np.ascontiguousarray(m[i:j].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                    rows.append((int(part[i]), None, (j - i).item().to_bytes(8, "little") + six + pack_runs(t[i:j])))
                yield packed_batch(rows)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[~pdf["many"]]
        out = list(zip(known["tag"], known["data"], strict=True))
        seeds, tags = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for data in pdf["data"][pdf["many"]]:
            n = int.from_bytes(data[:8], "little")
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 8).reshape(-1, 6)
            seeds.append(wide.view(np.uint64).ravel())
            tags.append(unpack_runs(data[8 + 6 * n :]))
        m, t = np.concatenate(seeds), np.concatenate(tags)
        order = np.lexsort((t, m))
        m, t = m[order], t[order]
        first = np.flatnonzero(starts(m))
        times = np.diff(np.append(first, len(m)))
        several = np.repeat(t[first] != t[np.append(first, len(m))[1:] - 1], times) if len(m) else np.empty(0, bool)
        out += by_tag(t[several], m[several])
        return pd.DataFrame(out, columns=["tag", "data"])

    words = F.transform(F.split("t", " "), lambda w: F.xxhash64(w))
    rows = plain(docs, id_col, text_col).select("tag", words.alias("w")).mapInArrow(emit, "part int, many boolean, tag long, data binary")
    return rows.groupBy("part").applyInPandas(merge, "tag long, data binary")


PATH = "tag long, first long, windows long, source long, source_first long"


def path_rows(tag, pos, source, source_pos) -> list[np.ndarray]:
    """Compact occurrences: neighbours whose sources are neighbours, too, become one path."""
    order = np.lexsort((pos, tag))
    tag, pos, source, source_pos = (c[order] for c in (tag, pos, source, source_pos))
    new = starts(tag, source, pos - source_pos)
    if len(pos):
        new[1:] |= pos[1:] != pos[:-1] + 1
    cut = np.flatnonzero(new)
    return [tag[cut], pos[cut], np.diff(np.append(cut, len(pos))), source[cut], source_pos[cut]]


def paths(texts: DataFrame, groups: int, window: int, seed: int) -> DataFrame:
    """The paths of the graph: stretches of windows that a document with a smaller id has as well.

    ``texts``: tag, rep (its smallest id), z (compressed text) and seeds (lists of packed minimisers).
    """
    entry = [np.uint64, np.int32]

    def emit(batches):
        import zstandard

        hasher, opened = WordHasher(), zstandard.ZstdDecompressor()
        for batch in batches:
            table = [batch.column(c).to_pylist() for c in ("tag", "rep", "z", "seeds")]
            columns = [[] for _ in range(5)]  # edge, rep, tag, pos, seed
            # Compressed sizes say little about the memory that words take.
            for a, b in runs(map(zstandard.frame_content_size, table[2]), 4_000_000):
                hashed = hasher([opened.decompress(z) for z in table[2][a:b]])
                for tag, rep, h, seeds in zip(table[0][a:b], table[1][a:b], hashed, table[3][a:b], strict=True):
                    m = minimisers(h, window, seed)
                    pos = np.flatnonzero(np.isin(m, np.concatenate([unpack(s, [np.uint64])[0] for s in seeds])))
                    if len(pos):
                        edges = run_hashes(h, window)[pos]
                        for c, x in zip(columns, (edges, np.full(len(pos), rep), np.full(len(pos), tag), pos, m[pos]), strict=True):
                            c.append(x)
            if columns[0]:
                yield packed_batch(entries(*(np.concatenate(c) for c in columns)))

    def entries(edge, rep, tag, pos, m) -> list[tuple]:
        rows = resolve(edge, rep, tag, pos)
        out = [(abs(int(t)) % groups, int(t), pack([np.array([x]) for x in r])) for t, *r in zip(*rows, strict=True)]
        # The rest learn their source in the group of their seed: here they have the smallest id.
        order = np.lexsort((pos, tag, rep, edge))
        edge, rep, tag, pos, m = (c[order] for c in (edge, rep, tag, pos, m))
        first = np.flatnonzero(starts(edge))
        own = rep == np.repeat(rep[first], np.diff(np.append(first, len(edge))))
        edge, rep, tag, pos, m = (c[own] for c in (edge, rep, tag, pos, m))
        part = (m % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((pos, tag, part))
        edge, rep, tag, pos, part = (c[order] for c in (edge, rep, tag, pos, part))
        cut = np.flatnonzero(starts(part))
        for i, j in zip(cut, np.append(cut, len(part))[1:], strict=True):
            out.append((int(part[i]), None, pack([edge[i:j], pos[i:j].astype(np.int32)]) + pack_runs(rep[i:j]) + pack_runs(tag[i:j])))
        return out

    def resolve(edge, rep, tag, pos) -> list[np.ndarray]:
        """Paths of the occurrences for which a smaller id has the edge."""
        order = np.lexsort((pos, tag, rep, edge))
        edge, rep, tag, pos = (c[order] for c in (edge, rep, tag, pos))
        first = np.flatnonzero(starts(edge))
        lead = np.repeat(first, np.diff(np.append(first, len(edge))))
        late = rep > rep[lead]
        return path_rows(tag[late], pos[late], tag[lead][late], pos[lead][late])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["tag", "first", "windows", "source", "source_first"]
        known = pdf[~pdf["many"]]
        done = [[int(t), *(int(x[0]) for x in unpack(d, [np.int64] * 4))] for t, d in zip(known["tag"], known["data"], strict=True)]
        columns = [[np.empty(0, k)] for k in (np.uint64, np.int64, np.int64, np.int64)]
        for data in pdf["data"][pdf["many"]]:
            edge, pos = unpack(data, entry)
            rest = data[8 + 12 * len(edge) :]
            n = int.from_bytes(rest[:8], "little")
            for c, x in zip(columns, (edge, unpack_runs(rest[: 8 + 12 * n]), unpack_runs(rest[8 + 12 * n :]), pos.astype(np.int64)), strict=True):
                c.append(x)
        found = resolve(*(np.concatenate(c) for c in columns))
        frame = pd.DataFrame(dict(zip(names, found, strict=True)))
        return pd.concat([frame, pd.DataFrame(done, columns=names)]).astype("int64")

    rows = texts.select("tag", "rep", "z", "seeds").mapInArrow(emit, "part int, many boolean, tag long, data binary")
    return rows.groupBy("part").applyInPandas(merge, PATH)


def compact(pieces: DataFrame) -> DataFrame:
    """Nonbranching paths of ``pieces`` (written), joined to one row each.

    A node is a place in a source (source, position), where pieces end and begin. A piece goes on in the next one if
    that begins where it ends, in the document and in the source. A node is nonbranching if every piece that comes
    to it goes on, and no other begins there; all that pass through it are joined to the piece before it, and
    pointer jumping finds the first piece of each path.
    """
    size = pieces.count()
    tail = pieces.select("tag", F.col("first").alias("before"), (F.col("first") + F.col("windows")).alias("first"), "source", (F.col("source_first") + F.col("windows")).alias("source_first"))
    on = ["tag", "first", "source", "source_first"]
    passing = materialize(gathered(tail.join(pieces.select(*on), on), size))
    count = lambda rows, name: rows.select("source", "source_first", *[F.lit(int(n == name)).alias(n) for n in ("coming", "going", "passing")])
    nodes = count(tail, "coming").unionByName(count(pieces, "going")).unionByName(count(passing, "passing"))
    nodes = nodes.groupBy("source", "source_first").agg(*[F.sum(n).alias(n) for n in ("coming", "going", "passing")])
    plain = nodes.filter("coming = passing AND going = passing").select("source", "source_first")
    # A passage that very many documents share makes a hot node.
    links = spread_join(passing, plain, ["source", "source_first"], F.pmod(F.xxhash64("tag"), F.lit(64))).select("tag", "first", "before")
    heads = materialize(gathered(links.withColumnRenamed("before", "head"), size))
    while True:
        further = heads.select("tag", F.col("first").alias("head"), F.col("head").alias("to"))
        now = heads.join(further, ["tag", "head"], "left").select("tag", "first", F.coalesce("to", "head").alias("head"), F.col("to").isNotNull().alias("moved"))
        now = materialize(gathered(now, size))
        heads = now.drop("moved")
        if now.filter("moved").isEmpty():
            break
    rows = pieces.join(heads, ["tag", "first"], "left").withColumn("head", F.coalesce("head", "first"))
    rows = rows.groupBy("tag", "head").agg(F.min("first").alias("first"), F.sum("windows").alias("windows"), F.first("source").alias("source"), F.min("source_first").alias("source_first")).drop("head")
    return gathered(rows, size)


def digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def source_digests(found: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """source, source_first, windows, whole: the digest of the source's words, once for every distinct stretch."""

    def run(batches):
        import zstandard

        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for tag, z, stretches in zip(*(batch.column(c).to_pylist() for c in ("tag", "z", "stretches")), strict=True):
                words = opened.decompress(z).decode().split(" ")
                for s in stretches:
                    n = s["windows"]
                    for c, x in zip(out, (tag, s["source_first"], n, digest(words[s["source_first"] : s["source_first"] + n + window - 1])), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["source", "source_first", "windows", "whole"])

    wanted = found.select("source", "source_first", "windows").distinct().groupBy(F.col("source").alias("tag")).agg(F.collect_list(F.struct("source_first", "windows")).alias("stretches"))
    return texts.select("tag", "z").join(wanted, "tag").mapInArrow(run, "source long, source_first long, windows long, whole binary")


def cut(texts: DataFrame, checked: DataFrame, window: int) -> DataFrame:
    """tag, rep, n_removed, sha_kept and spans (word positions removed, end exclusive) after verification of every path."""

    def run(batches):
        import zstandard

        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for tag, rep, z, found in zip(*(batch.column(c).to_pylist() for c in ("tag", "rep", "z", "paths")), strict=True):
                words = opened.decompress(z).decode().split(" ")
                gone = np.zeros(len(words) + 1, np.int64)
                for p in found:
                    end = p["first"] + p["windows"] + window - 1
                    if digest(words[p["first"] : end]) == p["whole"]:
                        gone[p["first"]] += 1
                        gone[end] -= 1
                covered = np.cumsum(gone)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]]))).reshape(-1, 2)
                for c, x in zip(out, (tag, rep, int(covered.sum()), sha([w for w, g in zip(words, covered.tolist(), strict=True) if not g]), edges.tolist()), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))), strict=True)], ["tag", "rep", "n_removed", "sha_kept", "spans"])

    grouped = checked.groupBy("tag").agg(F.collect_list(F.struct("first", "windows", "whole")).alias("paths"))
    return texts.select("tag", "rep", "z").join(grouped, "tag").mapInArrow(run, "tag long, rep long, n_removed long, sha_kept string, spans array<array<long>>")


def compressed(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """tag, rep, z, seeds: the words of the first document of each wanted tag."""

    def shrink(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press.compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())], ["rep", "tag", "z"])

    texts = plain(docs, id_col, text_col).select(F.col("doc_id").alias("rep"), "tag", "t").mapInArrow(shrink, "rep long, tag long, z binary")
    rows = texts.join(wanted, ["rep", "tag"]).select("tag", "rep", "z", "seeds")
    # Rows that repeat both id and text are one document.
    return rows if wanted.filter("times > 1").isEmpty() else rows.dropDuplicates(["rep", "tag"])


def repeated_words(docs: DataFrame, *, window: int = WINDOW, seed: int = SEED, group_words: int = GROUP_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (word ranges removed, end exclusive) of each row."""
    spark = docs.sparkSession
    rows = materialize(survey(docs, id_col, text_col))
    total, size = rows.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(shuffle_partitions(spark), -(-total // group_words))
    reps = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy("sha").agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"))
    reps = materialize(gathered(reps.select("sha", "rep", "first.tag", (F.col("n") - F.col("ids") + 1).alias("times")), size))
    seeds = shared_seeds(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, groups, window, seed)
    wanted = seeds.groupBy("tag").agg(F.collect_list("data").alias("seeds")).join(reps.select("tag", "rep", "times"), "tag")
    wanted = materialize(gathered(wanted, total, FILE_WORDS))
    texts = materialize(gathered(compressed(docs, wanted, id_col, text_col), total, FILE_WORDS))
    found = materialize(compact(materialize(paths(texts, groups, window, seed))))
    wholes = source_digests(found, texts, window)
    checked = found.join(wholes, ["source", "source_first", "windows"]).select("tag", "first", "windows", "whole")
    done = cut(texts, checked, window)
    # Copies: every window of theirs starts in the first of them.
    rows = rows.drop("tag").join(reps.drop("times"), "sha", "left").join(done, ["tag", "rep"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False))
    first = F.coalesce(F.col("doc_id") == F.col("rep"), F.lit(False)) & F.col("n_removed").isNotNull()
    return gathered(rows, size).select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(first, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(sha([]))).when(first, F.col("sha_kept")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))).when(first, F.col("spans")).otherwise(F.expr("cast(array() as array<array<bigint>>)")).alias("spans"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents")).drop("spans")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), own AS (
  SELECT k, min(doc_id) AS m FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM win JOIN own USING (k) WHERE m < doc_id)
), tok AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), kept AS (
  SELECT t.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY t.p) AS text
  FROM tok t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.p = g.p GROUP BY t.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
