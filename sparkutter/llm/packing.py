"""Best-fit packing of tokenised documents into sequences, with several capacities.

A document becomes its token ids followed by the end id; only a document longer than a sequence is cut, into
whole sequences and a rest. Pieces are dealt by hash into groups of about ``group_rows``; each group is packed
by itself, so memory is bounded and a lost executor repeats one group. The pieces of sequences that are not full
(``FULL``) are packed again, those of all groups together, in groups of the same size; and so on until one group
is left. A pass that saves no sequence is not taken.

A sequence has three capacities: tokens, documents (``DOCUMENTS``) and attention cost, the sum of squared piece
lengths (``ATTENTION`` of the square of the token capacity); a piece that alone costs more has a sequence for
itself. An open sequence takes, of all pieces that fit under every capacity, the one that ``rule`` ranks first:
``norm`` leaves the smallest weighted norm of the residual vector, ``dot`` has the largest weighted dot
product with it. Pieces of one length are interchangeable, so a group is a histogram of lengths and a choice
looks at no more than ``capacity`` classes.

Cases: null and empty texts are the end id alone, repeated rows are packed each, a null id stays null, an empty
table gives an empty result, further columns are ignored whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

TOKENIZER = "word_bpe_49k.json"
DOCUMENTS = 256
ATTENTION = 31 / 32
FULL = 0.98
KNOWN_WORDS = 250_000  # entries of a worker's word cache, which is kept twice over
PIECE_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def tokenizer_path(name: str) -> str:
    """A file as it is, or the installed public vocabulary of that name."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def of_worker(make, *key):
    """``make(*key)``, once for each Python worker: workers serve many tasks."""
    import sys
    import types

    kept = sys.modules.setdefault("_sparkutter_worker", types.ModuleType("_sparkutter_worker")).__dict__
    name = (make.__name__, *key)
    if name not in kept:
        kept[name] = make(*key)
    return kept[name]


def strings(column: pa.Array) -> list[str]:
    """As to_pylist(), faster."""
    return column.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Token ids of whole texts, word by word.

    White space separates words and belongs to no token, so the ids of a text are those of its words in order;
    words met before are looked up.
    """

    #: White space that separates words here; any other stays inside a word, and the tokenizer treats it there.
    SPACES = "\n\t\r"
    TOGETHER = 1000  # words that the tokenizer gets as one text

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A special token that is cut out of a text before anything else; between words, it keeps them apart.
        special = [(i, t.content) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.wall, self.mark = special[-1] if special else (None, "")
        self.special = [t for _, t in special]
        # Whether upper case does not matter, and a word and the mark after it are always apart.
        whole = json.loads(self.tokenizer.to_str())
        normal, cut = whole["normalizer"] or {}, whole["pre_tokenizer"] or {}
        steps = [x["type"] for x in normal.get("normalizers", [normal])]
        patterns = [x["pattern"].get("Regex", "") for x in cut.get("pretokenizers", [cut]) if x.get("type") == "Split"]
        self.folds = "Lowercase" in steps and set(steps) <= {"NFC", "Replace", "Lowercase"} and bool(patterns) and patterns[0].endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def of_words(self, names: pa.Array) -> list[bytes]:
        """The ids of each of these distinct words. Words that differ in case or in a last mark are worked out once."""
        if not self.folds:
            return self.lookup(strings(names))
        # Latin letters that are one letter in lower case and in normal form, too (U+0130 is not).
        letters = pc.match_substring_regex(names, r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]+[.,!?;:]?$")
        stems = pc.if_else(letters, pc.ascii_lower(names), names)
        marked = np.flatnonzero(pc.and_(letters, pc.match_substring_regex(names, "[.,!?;:]$")).to_numpy(zero_copy_only=False))
        marks = strings(pc.utf8_slice_codeunits(stems.take(pa.array(marked)), -1))
        stems = pc.if_else(letters, pc.utf8_rtrim(stems, ".,!?;:"), stems).dictionary_encode()
        each = self.lookup(strings(stems.dictionary))
        out = list(map(each.__getitem__, stems.indices.to_numpy().tolist()))
        of_mark = dict(zip(".,!?;:", self.lookup(list(".,!?;:")), strict=True))
        for k, m in zip(marked.tolist(), marks, strict=True):
            out[k] += of_mark[m]
        return out

    def tokenized(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each of these words."""
        lone = [k for k, w in enumerate(words) if self.wall is None or any(t in w for t in self.special)]
        if lone:
            # Words that hold such a token themselves, or no such token at all: one by one.
            found = {k: array("I", self.tokenizer.encode(words[k], add_special_tokens=False).ids).tobytes() for k in lone}
            rest = [k for k in range(len(words)) if k not in found]
            if rest:
                found |= zip(rest, self.tokenized([words[k] for k in rest]), strict=True)
            return [found[k] for k in range(len(words))]
        texts = [self.mark.join(words[k : k + self.TOGETHER]) for k in range(0, len(words), self.TOGETHER)]
        out: list[bytes] = []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            walls = np.flatnonzero(ids == self.wall) * 4
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *(walls + 4).tolist()], [*walls.tolist(), len(data)], strict=True)]
        return out

    def lookup(self, words: list[str]) -> list[bytes]:
        """tokenized() of each of these distinct words, most of them from memory."""
        if len(self.known) > KNOWN_WORDS:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        found = list(map(known.get, words))
        new = []
        for k in [k for k, x in enumerate(found) if x is None]:
            w = words[k]
            x = before.get(w)
            if x is None:
                new.append(k)
            else:
                found[k] = known[w] = x
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            for k, x in zip(part, self.tokenized([words[k] for k in part]), strict=True):
                found[k] = known[words[k]] = x
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) in one array, and where each text's begin and the last one's end."""
        texts = pc.fill_null(texts, "")
        for c in self.SPACES:
            texts = pc.replace_substring(texts, c, " ")
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        at = words.indices.to_numpy()
        ids = self.of_words(words.dictionary)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.cumsum(sizes) - sizes
        each = sizes[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        kind = np.int32 if max(ends[-1], sizes.sum()) < 2**31 else np.int64
        flat = np.frombuffer(b"".join(ids), np.uint32)[np.repeat((begins[at] - ends[:-1]).astype(kind), each) + np.arange(ends[-1], dtype=kind)]
        offsets = split.offsets.to_numpy()
        return flat, ends[offsets - offsets[0]]


def slices(texts: list[str | None], budget: int = 4_000_000):
    """Runs of texts with about ``budget`` characters each, as (first, end)."""
    return runs((len(t or "") for t in texts), budget)


def runs(sizes, budget: int):
    first, size, k = 0, 0, -1
    for k, n in enumerate(sizes):
        size += n
        if size >= budget:
            yield first, k + 1
            first, size = k + 1, 0
    if first <= k:
        yield first, k + 1


def as_array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def piece_table(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    end = array("I", [end_id]).tobytes()

    def cut(batches):
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            # Larger slices repeat more words: about 8 MB of text at a time.
            if batch is not None:
                held.append(batch)
                if sum(b.nbytes for b in held) < 8_000_000:
                    continue
            if not held:
                continue
            together = pa.Table.from_batches(held).combine_chunks()
            held = []
            encoder = of_worker(WordEncoder, tokenizer_path(tokenizer))
            docs_, texts = together.column(0).to_pylist(), as_array(together.column(1))
            for a, b in runs(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 8_000_000):
                out: list[list] = [[], [], [], [], []]
                flat, ends = encoder.encode(texts.slice(a, b - a))
                for doc, begin, stop in zip(docs_[a:b], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    data = flat[begin:stop].tobytes() + end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack_lengths(lengths: np.ndarray, *, capacity: int, documents: int, attention: float, weights=(1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; a piece that alone breaks a capacity gets a sequence of its own."""
    order = np.argsort(lengths, kind="stable")
    values, firsts, left = np.unique(lengths[order], return_index=True, return_counts=True)
    taken = np.zeros(len(values), np.int64)
    size, cost = values.astype(float), values.astype(float) ** 2
    w = np.asarray(weights, float)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    number, remaining = -1, len(lengths)
    while remaining:
        number += 1
        room, docs, budget, at = capacity, documents, float(attention), 0
        largest = int(np.flatnonzero(left)[-1])
        choice = largest
        while True:
            n = int(values[choice])
            row = order[firsts[choice] + taken[choice]]
            sequence[row], offset[row] = number, at
            taken[choice] += 1
            left[choice] -= 1
            remaining -= 1
            at, room, docs, budget = at + n, room - n, docs - 1, budget - n * n
            if room <= 0 or docs <= 0 or budget <= 0:
                break
            upto = int(np.searchsorted(values, room, side="right"))
            fit = np.flatnonzero((left[:upto] > 0) & (cost[:upto] <= budget))
            if not len(fit):
                break
            item = np.stack([size[fit] / capacity, np.full(len(fit), 1 / documents), cost[fit] / attention])
            residual = np.array([room / capacity, docs / documents, budget / attention])[:, None]
            if rule == "dot":
                choice = int(fit[np.argmax((w[:, None] * item * residual).sum(0))])
            else:
                choice = int(fit[np.argmin((w[:, None] * (residual - item) ** 2).sum(0))])
    return sequence, offset


def pack(pieces: DataFrame, *, capacity: int = 2048, documents: int = DOCUMENTS, attention: float | None = None, weights=(1.0, 0.05, 0.05), rule: str = "norm", group_rows: int = 20_000) -> DataFrame:
    """``pieces`` with sequence_id and offset. It counts the pieces, so give it a written table."""
    cost = float(attention or ATTENTION * capacity * capacity)

    def packed(rows: DataFrame, groups: int, level: int) -> DataFrame:
        def one(key, pdf):
            pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
            lengths = pdf["length"].to_numpy(np.int64)
            sequence, offset = pack_lengths(lengths, capacity=capacity, documents=documents, attention=cost, weights=weights, rule=rule)
            used = np.bincount(sequence, lengths, minlength=1)[sequence].astype(np.int64)
            return pdf.drop(columns="part").assign(sequence_id=(level << 58) + (int(key[0]) << 24) + sequence, offset=offset, used=used)

        part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level)), F.lit(groups)).alias("part")
        return rows.select(*PIECE_COLUMNS, part).groupBy("part").applyInPandas(one, PACKED + ", used long")

    out: DataFrame | None = None
    rows, level, before = pieces, 0, None
    groups = max(1, -(-pieces.count() // group_rows))
    while True:
        done = materialize(packed(rows, groups, level))
        if before is not None:
            # Packed again: only if that saves sequences.
            now = done.agg(F.count_distinct("sequence_id")).first()[0]
            if now >= before[0]:
                done = before[1]
                groups = 1
        loose = done.filter(F.col("used") <= FULL * capacity)
        facts = loose.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first() if groups > 1 else (0, 0)
        if groups == 1 or not facts[0]:
            return (done if out is None else out.unionByName(done)).drop("used")
        full = done.filter(F.col("used") > FULL * capacity)
        out = full if out is None else out.unionByName(full)
        rows, before, level = loose, (facts[1], loose), level + 1
        groups = max(1, -(-facts[0] // group_rows))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialize(piece_table(table(spark, sf_dir, "documents"))))
