"""SentencePiece encoding and decoding by suffix-array matching.

Texts of a batch are normalised (spaces become U+2581, one is put in front) and cut into units that no piece
crosses: before a run of U+2581, and around line ends. Distinct new units of the batch are concatenated and
indexed by a suffix array (ordered by as many characters as the longest piece has). Every piece is searched in
it, all by one vectorised binary search, character by character; its range of suffixes is the set of its
occurrences, the edges, which are laid out by position and length. Relaxation: tokens begin as characters, and
in each step every unit at once replaces, of all neighbouring pairs that an edge spans, the leftmost of those
with the best score by that edge, until no edge fits. This is byte-pair encoding in its own order, so the ids
are those of the library; a shortest path over the edges would not be, as the model is no unigram model.
Characters without a piece become bytes. Units seen before are looked up.

Decoding concatenates the pieces, joins bytes to characters (invalid ones become U+FFFD), turns U+2581 into
spaces and drops the first.

Cases: null and empty texts have no ids, and no ids decode to ''; very long units are indexed in parts, cut where
no piece crosses, and relaxed with a heap, in the same order; repeated rows are encoded each; an empty table gives an empty result; further columns are
ignored whatever their names. Only BPE models with byte fallback and without normalisation rules are taken.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .packing import of_worker, runs, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
INDEX_CHARS = 600_000
LONG_UNIT = 200
KNOWN_UNITS = 200_000
_NONE = np.int32(2**31 - 1)


class Pieces:
    """A model's pieces: of each id its bytes, of each matched piece its rank by score."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or len(model.normalizer_spec.precompiled_charsmap) or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with byte fallback and no normalisation are supported")
        self.of_byte = np.zeros(256, np.int32)
        self.bytes: list[bytes] = []
        plain: list[tuple[int, str, float]] = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.of_byte[int(p.piece[3:5], 16)] = i
                self.bytes.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == 1:
                plain.append((i, p.piece, p.score))
                self.bytes.append(p.piece.encode())
            else:
                self.bytes.append(" ⁇ ".encode() if p.type == 2 else b"")
        if any("\n" in p or MARK in p.strip(MARK) or p.endswith(MARK) and p.strip(MARK) for _, p, _ in plain):
            raise ValueError("a piece crosses units")
        self.width = max(len(p) for _, p, _ in plain)
        self.ids = np.array([i for i, _, _ in plain], np.int32)
        self.lengths = np.array([len(p) for _, p, _ in plain])
        self.codes = np.zeros((len(plain), self.width), np.uint32)
        for k, (_, p, _) in enumerate(plain):
            self.codes[k, : len(p)] = [ord(c) for c in p]
        scores = np.array([s for _, _, s in plain])
        _, rank = np.unique(-scores, return_inverse=True)  # equal scores, equal ranks
        self.rank = np.full(len(model.pieces) + 1, _NONE, np.int32)  # the last: no piece
        self.rank[self.ids] = rank
        self.none = len(model.pieces)


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` characters at least."""
    rank, reach = codes.astype(np.uint64), 1
    order = np.argsort(rank, kind="stable")
    while reach < depth:
        behind = np.concatenate([rank[reach:] + np.uint64(1), np.zeros(min(reach, len(rank)), np.uint64)])[: len(rank)]
        key = (rank << np.uint64(32)) | behind
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(len(s), np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])).astype(np.uint64)
        reach *= 2
    return order


def edges(codes: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The piece id at each position (row) and length (column, from 1); pieces.none where there is none."""
    order = suffix_order(codes, pieces.width)
    padded = np.concatenate([codes, np.zeros(pieces.width, np.uint32)])
    low, high = np.zeros(len(pieces.ids), np.int64), np.full(len(pieces.ids), len(codes), np.int64)
    for depth in range(pieces.width):
        live = np.flatnonzero((pieces.lengths > depth) & (low < high))
        wanted = pieces.codes[live, depth]
        bounds = []
        for side in (0, 1):  # the first suffix not before, and the first after
            a, b = low[live].copy(), high[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                seen = padded[order[np.minimum(mid, len(order) - 1)] + depth]
                right = open_ & ((seen < wanted) if side == 0 else (seen <= wanted))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            bounds.append(a)
        low[live], high[live] = bounds
    times = high - low
    found = np.repeat(np.arange(len(low)), times)
    at = order[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + low[found]]
    grid = np.full((len(codes), pieces.width), pieces.none, np.int32)
    grid[at, pieces.lengths[found] - 1] = pieces.ids[found]
    return grid


def relax(grid: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(unit, begin, end) of the final tokens of units [starts, ends), in several parts."""
    width, rank = pieces.width, pieces.rank
    sizes = ends - starts
    unit = np.repeat(np.arange(len(starts)), sizes)
    begin = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    end = begin + 1
    done = []
    while len(unit):
        span = end[1:] - begin[:-1]
        fits = (unit[1:] == unit[:-1]) & (span <= width)
        score = np.full(len(unit), _NONE, np.int32)
        k = np.flatnonzero(fits)
        score[k] = rank[grid[begin[k], span[k] - 1]]
        heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        best = np.minimum.reduceat(score, heads)
        counts = np.diff(np.append(heads, len(unit)))
        open_ = np.repeat(best < _NONE, counts)
        if not open_.all():
            done.append((unit[~open_], begin[~open_], end[~open_]))
            unit, begin, end, score = unit[open_], begin[open_], end[open_], score[open_]
            best, counts = best[best < _NONE], counts[best < _NONE]
            if not len(unit):
                break
        hit = np.flatnonzero(score == np.repeat(best, counts))
        hit = hit[np.concatenate([[True], unit[hit][1:] != unit[hit][:-1]])]  # the leftmost of each unit
        end[hit] = end[hit + 1]
        keep = np.ones(len(unit), bool)
        keep[hit + 1] = False
        unit, begin, end = unit[keep], begin[keep], end[keep]
    return done


def relax_long(grid: np.ndarray, start: int, stop: int, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """begin and end of the final tokens of one unit, with a heap."""
    end = {p: p + 1 for p in range(start, stop)}
    before = {p + 1: p for p in range(start, stop)}
    heap: list[tuple[int, int, int, int]] = []

    def offer(p: int) -> None:
        m = end[p]
        e = end.get(m)
        if e is not None and e - p <= pieces.width:
            r = int(pieces.rank[grid[p, e - p - 1]])
            if r < _NONE:
                heapq.heappush(heap, (r, p, m, e))

    for p in range(start, stop):
        offer(p)
    while heap:
        _, p, m, e = heapq.heappop(heap)
        if end.get(p) != m or end.get(m) != e:
            continue
        end[p], before[e] = e, p
        del end[m], before[m]
        offer(p)
        if p in before:
            offer(before[p])
    begins = np.array(sorted(end))
    return begins, np.array([end[p] for p in begins.tolist()])


class PieceEncoder:
    """Encodes texts, remembering units."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each unit."""
        joined = "\U0010ffff".join(units) + "\U0010ffff"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.cumsum(sizes + 1) - sizes - 1
        grid = edges(codes, self.pieces)
        short = np.flatnonzero(sizes <= LONG_UNIT)
        parts = [(short[u], b, e) for u, b, e in relax(grid, starts[short], starts[short] + sizes[short], self.pieces)]
        for u in np.flatnonzero(sizes > LONG_UNIT):
            b, e = relax_long(grid, int(starts[u]), int(starts[u] + sizes[u]), self.pieces)
            parts.append((np.full(len(b), u), b, e))
        if not parts:
            return [b""] * len(units)
        unit, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(begin, kind="stable")
        unit, begin, end = unit[order], begin[order], end[order]
        ids = grid[begin, end - begin - 1]
        odd = np.flatnonzero(ids == self.pieces.none)
        if len(odd):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[begin[odd]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(x) for x in raw]
            at = np.repeat(np.arange(len(ids)), times)
            ids, unit = ids[at], unit[at]
            ids[ids == self.pieces.none] = self.pieces.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        data = ids.astype("<i4").tobytes()
        cut = np.searchsorted(unit, np.arange(len(units) + 1)) * 4
        return [data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def separate(self, unit: str):
        """Parts of a unit that is too long for one index, cut where no edge, and so no token, crosses.

        A stretch without such a place grows until it has one.
        """
        width, start, size = self.pieces.width, 0, INDEX_CHARS
        while len(unit) - start > size:
            codes = np.frombuffer(unit[start : start + size].encode("utf-32-le", "surrogatepass"), np.uint32)
            grid, crossed = edges(codes, self.pieces), np.zeros(size + width + 1, np.int64)
            for n in range(2, width + 1):
                at = np.flatnonzero(grid[:, n - 1] != self.pieces.none)
                np.add.at(crossed, at + 1, 1)
                np.add.at(crossed, at + n, -1)
            # Near its end, edges may reach beyond the stretch.
            free = np.flatnonzero(np.cumsum(crossed)[1 : size - width] == 0) + 1
            if not len(free):
                size *= 2
                continue
            yield unit[start : start + int(free[-1])]
            start, size = start + int(free[-1]), INDEX_CHARS
        yield unit[start:]

    def lookup(self, units: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_UNITS:
            self.known, self.before = {}, self.known
        new = []
        for u in units:
            if u not in self.known:
                if u in self.before:
                    self.known[u] = self.before[u]
                else:
                    new.append(u)
        for u in [u for u in new if len(u) > INDEX_CHARS]:
            self.known[u] = b"".join(self.encode_units([x])[0] for x in self.separate(u))
        new = [u for u in new if len(u) <= INDEX_CHARS]
        for a, b in runs(map(len, new), INDEX_CHARS):
            self.known.update(zip(new[a:b], self.encode_units(new[a:b]), strict=True))
        return [self.known[u] for u in units]

    #: Units of a text in which spaces are not single; otherwise words are units.
    UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none)."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, f"  |{MARK}|\\x{{10FFFF}}"), pc.starts_with(texts, " "))
        usual = pc.if_else(odd, "", texts)
        split = pc.split_pattern(pc.replace_substring(usual, "\n", " \n "), " ")
        words = split.flatten().dictionary_encode()
        names, at = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        line = names.index("\n") if "\n" in names else -1
        ends_line = at == line
        bare = np.concatenate([[False], ends_line[:-1]])  # right after a line end: no space before
        bare[offsets[:-1][offsets[:-1] < len(bare)]] = False
        # Of each word: as it is, or with the mark.
        kind = at * 2 + ~(bare | ends_line)
        kinds, kind = np.unique(kind, return_inverse=True)
        ids = self.lookup_all([names[k >> 1] if k & 1 == 0 else MARK + names[k >> 1] for k in kinds.tolist()])
        sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        begins = np.cumsum(sizes) - sizes
        each = sizes[kind]
        stops = np.concatenate([[0], np.cumsum(each)])
        flat = np.frombuffer(b"".join(ids), "<i4")[np.repeat(begins[kind] - stops[:-1], each) + np.arange(stops[-1])]
        bounds = stops[offsets]
        out = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k, t in enumerate(usual.to_pylist()):
            if not t:
                text = texts[k].as_py()
                units = self.UNIT.findall(MARK + text.replace(" ", MARK)) if text else []
                out[k] = np.frombuffer(b"".join(self.lookup_all(units)), "<i4")
        return out

    def lookup_all(self, units: list[str]) -> list[bytes]:
        if "" not in self.known:
            self.known[""] = b""
        known = dict(zip(distinct := list(dict.fromkeys(units)), self.lookup(distinct), strict=True))
        return [known[u] for u in units]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.pieces.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, *, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each row."""

    def run(batches):
        for batch in batches:
            encoder = of_worker(PieceEncoder, tokenizer_path(model))
            for a, b in runs(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 4_000_000):
                ids = encoder.encode(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, *, model: str = MODEL) -> DataFrame:
    """doc_id and text of each row of (doc_id, ids); null ids are none."""

    def run(batches):
        for batch in batches:
            encoder = of_worker(PieceEncoder, tokenizer_path(model))
            texts = [encoder.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (unsigned, little-endian signed 32-bit ids), decoded_sha256 of each document."""

    def run(batches):
        for batch in batches:
            encoder = of_worker(PieceEncoder, tokenizer_path(MODEL))
            for a, b in runs(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 4_000_000):
                ids = encoder.encode(batch.column(1).slice(a, b - a))
                columns = [batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                columns.append(pa.array([hashlib.sha256(encoder.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")
