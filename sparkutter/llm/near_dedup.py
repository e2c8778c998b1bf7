"""Near-duplicate detection by Order MinHash and banded alignment.

Texts are sequences of words. Rows with one word sequence are one node, and the node's words come from one of
them. Order MinHash: every run of five words is labelled with how often it has occurred before; under each of
``REPEATS`` hash functions the ``TAKE`` smallest labelled runs are taken and kept in text order, so that a sketch
agrees for texts that share them in the same order. Nodes that agree in a sketch are candidates; they are linked
if their edit similarity in words, 1 - distance / longer length, is at least 0.8. The distance comes from a
bit-parallel alignment inside the band of diagonals that this bound allows. It compares words by 32-bit hashes:
two different words count as equal with a chance of 2 ** -32, and nothing else in the decision is approximate.

No bucket is expanded into its pairs. First, every bucket's leader is compared with its other members and the
links are merged into classes by joins; a large group of copies is one class then. What remains are pairs of
different classes within a bucket. Changing a word moves at most two in a histogram of hashed words, so the
histograms of similar texts differ by at most twice the allowed distance: a vectorised comparison inside the
bucket drops, without loss, most pairs that are not similar. The others are aligned there and then, unless a link
has joined their classes before, and only links leave the task. A pair is compared in the first bucket it shares.
The members of a bucket's largest class are split over blocks, which rows and words bound, and meet the bucket's
other members in each. A bucket with too many of those for one block is dealt again, without loss, by pairs of
neighbouring words: an edit changes at most two of them, so in any fixed order of the labelled pairs the first
2 (1 - s) n + 2 of two similar texts hold a common one; the order is by rarity, so that the passage which filled
the bucket comes last and the new buckets are small. Any that is not is compared block by block. Nothing is capped
or sampled.

Texts of fewer than five words have one run, all their words. Cases: texts without words (null, empty, blank)
are classes of their own; a null id takes no part and gets a null class; rows that repeat an id are rows of their
own, each in the class of its text; empty tables give empty results; further columns are ignored whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, SPACE, content_key, gathered, materialize, settled, spread_join, table

RUN = 5
TAKE = 2
REPEATS = 16
BLOCK = 1024
BLOCK_WORDS = 4_000_000
BINS = 256
SIMILARITY = 0.8
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words (uint64); of all words if there are fewer: a sum with random odd factors, mixed."""
    k = min(k, len(words))
    n = len(words) - k + 1
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h += words[j : j + n] * factors[j]
    return mix(h)


def occurrence(values: np.ndarray) -> np.ndarray:
    """How often each value has occurred before its place."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(len(s))
    out = np.empty(len(s), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def sketches(words: np.ndarray, repeats: int = REPEATS, take: int = TAKE, k: int = RUN) -> np.ndarray:
    """One key for each repeat."""
    runs = run_hashes(words, k)
    labelled = mix(runs + occurrence(runs).astype(np.uint64) * _BASE)
    number = np.arange(1, repeats + 1, dtype=np.uint64)[:, None]
    take = min(take, len(runs))
    if take == len(runs):
        at = np.tile(np.arange(take), (repeats, 1))
    else:
        # Odd multipliers permute the 64-bit numbers.
        ranks = mix((labelled[None, :] + number * _BASE) * (number * np.uint64(2) + np.uint64(1)))
        at = np.sort(np.argpartition(ranks, take - 1, axis=1)[:, :take], axis=1)
    keys = number[:, 0] * _M1
    for j in range(take):
        keys = mix(keys * _BASE + runs[at[:, j]])
    return keys


def within(a: list[int], b: list[int], most: int) -> int | None:
    """The edit distance of two sequences if it is at most ``most``, else None.

    Bit-parallel alignment (Hyyro 2003): a column of the dynamic programme is two bit vectors, its steps up and
    down, cut to the 2 * most + 1 diagonals around the main one.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    first = 0
    while first < len(b) and a[first] == b[first]:
        first += 1
    last = 0
    while last < len(b) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    n, m = len(a), len(b)
    if not m or not most:
        return max(n, m) if max(n, m) <= most else None
    half = min(most, n)
    top = 2 * half
    mask = (2 << top) - 1
    places: dict[int, int] = {}
    for i, v in enumerate(a):
        places[v] = places.get(v, 0) | (1 << i)
    # At column j, bit t stands for row j - half + t. Column 0 rises by one from row to row.
    up, down, distance = mask ^ ((1 << half) - 1), 0, half
    for j in range(1, m + 1):
        shift = j - half - 1
        match = places.get(b[j - 1], 0)
        match = (match >> shift if shift >= 0 else match << -shift) & mask
        level = ((((match & up) + up) ^ up) | match | down) & mask  # equal to the cell up and left
        rises = (down | ~(level | up)) & mask
        falls = level & up
        if j <= n - half:  # down the lowest diagonal ...
            distance += not level >> top & 1
            if distance > most + half - (n - m):  # each later column wins back one at most
                return None
        else:  # ... then along the last row
            distance += (rises >> (n - j + half) & 1) - (falls >> (n - j + half) & 1)
        level >>= 1
        up = (falls | ~(level | rises)) & mask
        down = level & rises
    return distance if distance <= most else None


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    return within(a.tolist(), b.tolist(), int((1 - similarity) * longer + 1e-9)) is not None


def hashed_words(text_col: str) -> F.Column:
    return F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE), lambda w: F.when(w != "", F.xxhash64(w)))


def arrays(column: pa.Array):
    """The arrays of a list column, without their nulls."""
    values, offsets = column.values, column.offsets.to_numpy()
    plain = values.to_numpy(zero_copy_only=False) if not values.null_count else None
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if plain is not None:
            yield plain[a:b].view(np.uint64)
        else:
            yield values.slice(a, b - a).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def sketch_table(docs: DataFrame, id_col: str, text_col: str, keyed: bool) -> DataFrame:
    """row (a number), key (of its content), id, digest of the word sequence (null: no words), sketch keys, n and words (32-bit hashes, as one binary)."""
    import hashlib

    def run(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for w in arrays(batch.column(3)):
                facts = (hashlib.blake2b(w.tobytes(), digest_size=16).digest(), sketches(w).view(np.int64)) if len(w) else (None, None)
                for c, x in zip(columns, (*facts, len(w), (w >> np.uint64(32)).astype(np.uint32).tobytes()), strict=True):
                    c.append(x)
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["row", "key", "id", "digest", "keys", "n", "words"])

    key = content_key(id_col, text_col) if keyed else F.lit(None).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), key.alias("key"), F.col(id_col).cast("long").alias("id"), hashed_words(text_col).alias("w"))
    return rows.mapInArrow(run, "row long, key string, id long, digest binary, keys array<long>, n long, words binary")


def sequence_table(rows: DataFrame) -> DataFrame:
    """id, words, n, histogram (of hashed words) and keys of ``rows`` (id, words, n, keys); arrays of numbers are binaries."""

    def run(batches):
        for batch in batches:
            histograms = []
            for x in batch.column(1):
                w = np.frombuffer(x.as_buffer(), np.uint32)
                histograms.append(np.minimum(np.bincount((w % np.uint32(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
            keys = [k.astype(np.uint64).tobytes() for k in arrays(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(histograms, pa.binary()), pa.array(keys, pa.binary())], ["id", "words", "n", "histogram", "keys"])

    return rows.select("id", "words", "n", "keys").mapInArrow(run, "id long, words binary, n long, histogram binary, keys binary")


def verify(pairs: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """a, b, ok of each pair."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("wa"), batch.column("wb")
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), similarity) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    left = sequences.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    right = sequences.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long, ok boolean")


def components(links: DataFrame) -> DataFrame:
    """id and class_id (the smallest id that links lead to) of every id in ``links`` (a, b), which should be written rows.

    Each round takes the smallest class among the neighbours and then that class's own class.
    """
    size = 2 * links.count()
    edges = materialize(gathered(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), size))
    now = materialize(gathered(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("class_id")), size))
    while True:
        near = edges.join(now.select(F.col("id").alias("b"), "class_id"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("near"))
        near = now.join(near, "id").select("id", F.col("class_id").alias("old"), F.least("class_id", "near").alias("new"))
        jump = now.select(F.col("id").alias("new"), F.col("class_id").alias("far"))
        now = materialize(gathered(near.join(jump, "new").select("id", "old", F.least("new", "far").alias("class_id")), size))
        if now.filter("old <> class_id").isEmpty():
            return now.select("id", "class_id")


def blocks(buckets: DataFrame, classes: DataFrame, block: int, block_words: int = BLOCK_WORDS, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets (key, repeat, id, n; ``size`` rows, if known) that hold more than one class, in the blocks where they are compared.

    And those of buckets with too many rows, or words, outside the largest class.
    """
    rows = buckets.join(classes, "id", "left").select("key", "repeat", "id", "n", F.coalesce("class_id", "id").alias("class_id"))
    sizes = rows.groupBy("key", "class_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("words"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("rows", "words", "class_id")).alias("top"), F.count(F.lit(1)).alias("classes"), F.sum("rows").alias("rows"), F.sum("words").alias("words"))
    parts = lambda n, words: F.greatest(F.ceil(n / block), F.ceil(words / block_words)).cast("int")
    sizes = sizes.filter("classes > 1").select(
        "key",
        F.col("top.class_id").alias("top"),
        parts(F.col("top.rows"), F.col("top.words")).alias("of"),
        (parts(F.col("rows") - F.col("top.rows"), F.col("words") - F.col("top.words")) > 1).alias("large"),
    )
    rows = rows.join(sizes, "key")
    rows = materialize(rows if size is None else gathered(rows, size))
    fits = rows.filter("NOT large")
    largest_class = F.col("class_id") == F.col("top")
    own = F.array(F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    every = F.sequence(F.lit(0), F.col("of") - 1)
    # In which block the others meet each other: the first.
    fits = fits.select("key", "repeat", "id", "class_id", F.explode(F.when(largest_class, own).otherwise(every)).alias("block"), (~largest_class).alias("guest"))
    return fits, rows.filter("large").select("key", "id", "n", "class_id")


def crossed(rows: DataFrame, block: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Block against block, for buckets that are large even after they were dealt again."""
    sizes = rows.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_words)).cast("int").alias("of"))
    rows = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other")
    rows = rows.select("key", "id", "class_id", "of", "own", other)
    pair = F.least("own", "other") * F.col("of") + F.greatest("own", "other")
    return rows.select("key", F.lit(-1).alias("repeat"), "id", "class_id", pair.alias("block"), F.lit(False).alias("guest"))


def plausible(repeat, block, classes, guest, n, h, keys, similarity):
    """(i, later j, allowed distances) of a block's members that lengths, histograms and classes leave to compare.

    Members are sorted by n, so that the longer text, whose allowance counts, is j. ``classes`` may change
    between two steps.
    """
    most = ((1 - similarity) * n + 1e-9).astype(np.int64)
    shared = max(0, int(repeat[0]))
    for i in range(len(n) - 1):
        j = np.arange(i + 1, len(n))
        j = j[(n[j] - n[i] <= most[j]) & (classes[j] != classes[i])]
        if len(j) and guest[i] and block[0]:
            j = j[~guest[j]]
        if len(j) and shared:
            j = j[~(keys[j, :shared] == keys[i, :shared]).any(axis=1)]
        if len(j):
            # Of two bytes the larger less the smaller.
            j = j[(np.maximum(h[j], h[i]) - np.minimum(h[j], h[i])).sum(axis=1, dtype=np.int64) <= 2 * most[j]]
        if len(j):
            yield i, j, most


def by_block(rows: DataFrame, compare, schema: str) -> DataFrame:
    """``compare`` (columns of one block -> list of rows) over all blocks; a block may span Arrow batches."""
    names = rows.columns
    out = [x.split()[0] for x in schema.split(", ")]

    def column(batch, name):
        values = batch.column(name)
        if name == "histogram":
            return np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, BINS)
        if name == "keys":
            return np.frombuffer(b"".join(values.to_pylist()), np.int64).reshape(-1, REPEATS)
        if name == "words":
            words = np.empty(len(values), object)
            words[:] = [np.frombuffer(x, np.uint32) for x in values.to_pylist()]
            return words
        return values.to_numpy(zero_copy_only=False)

    def run(batches):
        def done(found):
            found = sorted(set(found))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(len(out))], out)

        left = None  # the last block, which may go on in the next batch
        for batch in batches:
            now = [column(batch, c) for c in names]
            now = now if left is None else [np.concatenate(x) for x in zip(left, now, strict=True)]
            if not len(now[0]):
                continue
            cut = np.flatnonzero(np.concatenate([[True], (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])]))
            found: list[tuple] = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                found += compare({c: x[a:b] for c, x in zip(names, now, strict=True)})
            left = [x[cut[-1] :].copy() for x in now]
            yield done(found)
        if left is not None:
            yield done(compare(dict(zip(names, left, strict=True))))

    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "n", "id").mapInArrow(run, schema)


def from_pivots(words, classes, pivots: int = 8, members: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of each member's distance from a member of each of the largest classes.

    Edit distance is a metric: the distance of two texts is no less than the difference of theirs from a third.
    """
    low, high = [np.zeros(len(words))], [np.full(len(words), np.inf)]
    which, times = np.unique(classes, return_counts=True)
    for c in which[np.argsort(-times, kind="stable")][: min(pivots, int((times >= members).sum()))]:
        pivot = words[int(np.flatnonzero(classes == c)[0])].tolist()
        caps = [max(len(pivot), len(w)) // 2 for w in words]
        known = [within(pivot, w.tolist(), cap) for w, cap in zip(words, caps, strict=True)]
        low.append(np.array([cap + 1 if d is None else d for d, cap in zip(known, caps, strict=True)], float))
        high.append(np.array([np.inf if d is None else d for d in known]))
    return np.stack(low), np.stack(high)


def block_links(rows: DataFrame, sequences: DataFrame, similarity: float, size: int) -> DataFrame:
    """Links a, b between different classes within a block, up to those that join no classes any more.

    ``size``: about how many rows there are. First without words: which members have a plausible partner at all. Only these are given their words.
    """
    facts = ("repeat", "block", "classes", "guest", "n", "histogram", "keys")
    args = lambda x: [x["class_id" if f == "classes" else f] for f in facts]

    def mark(x):
        wanted = np.zeros(len(x["n"]), bool)
        for i, j, _ in plausible(*args(x), similarity):
            wanted[i] = True
            wanted[j] = True
        return [(int(k), int(b), int(i)) for k, b, i in zip(x["key"][wanted], x["block"][wanted], x["id"][wanted], strict=True)]

    def align(x):
        found = []
        x["class_id"] = classes = x["class_id"].copy()
        low, high = from_pivots(x["words"], classes)
        for i, j, most in plausible(*args(x), similarity):
            a = x["words"][i].tolist()
            apart = np.maximum(low[:, j] - high[:, i : i + 1], low[:, i : i + 1] - high[:, j]).max(axis=0, initial=0)
            for k in j[apart <= most[j]].tolist():
                if classes[k] != classes[i] and within(a, x["words"][k].tolist(), int(most[k])) is not None:
                    found.append((int(min(x["id"][i], x["id"][k])), int(max(x["id"][i], x["id"][k]))))
                    classes[classes == classes[k]] = classes[i]
        return found

    columns = ["key", F.col("block").cast("long").alias("block"), F.col("repeat").cast("int").alias("repeat"), "id", "class_id", "guest", F.col("n").cast("long").alias("n"), "histogram", "keys"]
    narrow = rows.join(sequences.drop("words"), "id").select(*columns)
    marked = materialize(gathered(by_block(narrow, mark, "key long, block long, id long").distinct(), size))
    rows = rows.withColumn("block", F.col("block").cast("long")).join(marked, ["key", "block", "id"], "left_semi")
    wide = rows.join(sequences, "id").select(*columns, "words")
    return by_block(wide, align, "a long, b long").filter("a < b").distinct()


def redealt(ids: DataFrame, sequences: DataFrame, similarity: float, counters: int = 1 << 16) -> DataFrame:
    """Buckets by the neighbouring words of which similar texts must share a pair, for ``ids``."""
    rows = materialize(sequences.select("id", "n", "words").join(ids, "id", "left_semi"))

    def labelled(x) -> np.ndarray:
        pairs = run_hashes(np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64), 2)
        return mix(pairs + occurrence(pairs).astype(np.uint64) * _BASE)

    def count(batches):
        total = np.zeros(counters, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount((labelled(x) % np.uint64(counters)).astype(np.int64), minlength=counters)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    # Of a fixed size, however many texts: rarity only sets the order, which may be any.
    rarity = np.zeros(counters, np.int64)
    for r in rows.select("words").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        rarity[r["at"]] = r["n"]

    def deal(batches):
        for batch in batches:
            keys, owners, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                w = labelled(x)
                order = np.lexsort((w, rarity[(w % np.uint64(counters)).astype(np.int64)]))
                keys.append(w[order[: 2 * int((1 - similarity) * n + 1e-9) + 2]].view(np.int64))
                owners.append(np.full(len(keys[-1]), i))
                lengths.append(np.full(len(keys[-1]), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, owners, lengths)], ["key", "id", "n"])

    return rows.mapInArrow(deal, "key long, id long, n long")


def several(buckets: DataFrame) -> DataFrame:
    """``buckets`` (with key and id) that have more than one member, with their leader, the smallest id."""
    leaders = buckets.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("most")).filter("leader < most").drop("most")
    return buckets.join(leaders, "key")


def linked_classes(buckets: DataFrame, sequences: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """id and class_id, the smallest id that links between members of one bucket lead to, where that is another."""
    pairs = buckets.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    classes = components(materialize(verify(pairs, sequences, similarity).filter("ok").select("a", "b")))
    # Most links show there; for the others, only members of other classes are left to compare.
    size = buckets.count()
    fits, large = blocks(buckets.drop("leader"), classes, block, size=size)
    large = materialize(gathered(large.select("id").distinct(), size))
    if not large.isEmpty():
        dealt = several(redealt(large, sequences, similarity)).drop("leader").withColumn("repeat", F.lit(-1))
        more, large = blocks(dealt, classes, block)
        fits = fits.unionByName(more).unionByName(crossed(large, block))
    # They join classes, which are few.
    named = lambda c: classes.select(F.col("id").alias(c), F.col("class_id").alias(f"of_{c}"))
    links = block_links(fits, sequences, similarity, size).join(named("a"), "a", "left").join(named("b"), "b", "left")
    links = materialize(gathered(links.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a <> b").distinct(), size))
    if links.isEmpty():
        return classes
    merged = components(links)
    alone = merged.join(classes, "id", "left_anti")
    further = classes.join(merged.select(F.col("id").alias("class_id"), F.col("class_id").alias("to")), "class_id", "left")
    return further.select("id", F.coalesce("to", "class_id").alias("class_id")).unionByName(alone)


def near_duplicate_classes(docs: DataFrame, *, similarity: float = SIMILARITY, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """doc_id, class_id (smallest id of its class), class_size, kept of each row; and content_key(), if ``keyed``.

    One row of each class is kept, one with its smallest id.
    """
    if not 0.5 < similarity <= 1:
        raise ValueError("the similarity must be above 0.5")
    sketched = materialize(sketch_table(docs, id_col, text_col, keyed))
    size = sketched.count()
    worded = sketched.filter("id IS NOT NULL AND digest IS NOT NULL")
    nodes = worded.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("rows"))
    # A node's number: of 64 bits, and one for each digest, whatever ids the rows have.
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("first.id").alias("least"), F.col("first.row").alias("row"), "rows")
    nodes = materialize(gathered(nodes, size))
    facts = worded.join(nodes.select("row", F.col("node").alias("id_")), "row").select(F.col("id_").alias("id"), "keys", "n")
    buckets = materialize(gathered(several(facts.select(F.posexplode("keys").alias("repeat", "key"), "id", "n")), REPEATS * size))
    wanted = nodes.join(buckets.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("row", "node")
    # A merge join at any size that matters; the same at small ones.
    sequences = materialize(sequence_table(worded.drop("id", "key").join(wanted.hint("merge"), "row").withColumnRenamed("node", "id")))
    classes = linked_classes(buckets, sequences, similarity, block)
    named = nodes.join(classes.select(F.col("id").alias("node"), "class_id"), "node", "left").withColumn("class", F.coalesce("class_id", "node"))
    named = materialize(gathered(named.select("digest", "node", "class", "least", "row", "rows"), size))
    heads = named.groupBy("class").agg(F.min(F.struct("least", "row")).alias("head"), F.sum("rows").alias("class_size"))
    named = spread_join(named.select("digest", "node", "class"), heads, ["class"], F.pmod(F.xxhash64("node"), F.lit(64))).select("digest", F.col("head.least").alias("class_id"), F.col("head.row").alias("head"), "class_size")
    rows = sketched.select("row", "key", "id", "digest").join(named, F.col("id").isNotNull() & (sketched["digest"] == named["digest"]), "left")
    lone = F.when(F.col("id").isNotNull(), F.col("id"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.coalesce("class_id", lone).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(F.col("head") == F.col("row"), F.lit(True)).alias("kept"),
        *([F.col("key").alias(ROW)] if keyed else []),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that their classes do not keep; null ids stay.

    Of rows with the same id and text that a class keeps, one stays.
    """
    rows = settled(lambda: near_duplicate_classes(docs, id_col=id_col, text_col=text_col, keyed=True, **options).filter("class_size > 1").select(ROW, "kept"))
    rows = materialize(rows.groupBy(ROW).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times")))
    # A merge join at any size that matters; the same at small ones.
    out = docs.withColumn(ROW, content_key(id_col, text_col)).join(rows.filter("NOT kept").select(ROW).hint("merge"), ROW, "left_anti")
    again = rows.filter("kept AND times > 1").select(ROW)
    if not again.isEmpty():
        alone = out.join(again, ROW, "left_anti")
        out = alone.unionByName(out.join(again, ROW, "left_semi").dropDuplicates([ROW]))
    return out.select(*docs.columns)


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
