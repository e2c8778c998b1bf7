"""A lexicon as sets of canonical words, and look-ups in it as column expressions.

The sets are small and fixed, so a look-up is a hashed IN over literals inside the generated code: no join, no
broadcast.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..resources import words as W
from .text import PUNCTUATION

FP, FP_AMB, DM, EDIT = "filled_pause", "filled_pause_ambiguous", "discourse_marker", "editing_term"


def plain_normalise(word: str) -> str:
    """normalise() for one Python string."""
    return word.strip().lower().lstrip(PUNCTUATION + "-").rstrip(PUNCTUATION)


def plain_canonical(word: str) -> str:
    """canonical() for one Python string, for building lexicons."""
    word = plain_normalise(word)
    kept = ""
    for c in word:
        if not kept.endswith(c * 2):
            kept += c
    return kept


def one_of(word: Column, items) -> Column:
    items = sorted(items)
    return F.coalesce(word.isin(items), F.lit(False)) if items else F.lit(False)


@dataclass(frozen=True)
class Lexicon:
    pauses: frozenset[str] = frozenset()
    ambiguous: frozenset[str] = frozenset()
    markers: frozenset[str] = frozenset()
    editing: frozenset[str] = frozenset()
    strong: frozenset[str] = frozenset()
    phrases: dict[str, str] = field(default_factory=dict)  # words joined by a space -> category
    doubled: frozenset[str] = frozenset()  # known reduplications
    function: frozenset[str] = frozenset()
    function_doubled: frozenset[str] = frozenset()
    affixes: tuple[str, ...] = ()
    gap_redup: float = W.GAP_REDUPLICATION_MOST
    gap_disfl: float = W.GAP_DISFLUENCY_LEAST
    # Markers that are fillers only in some places.
    openers: tuple[str, ...] = W.OPENERS
    answers: tuple[str, ...] = W.ANSWERS
    demonstratives: tuple[str, ...] = W.DEMONSTRATIVES
    tails: tuple[str, ...] = W.DEMONSTRATIVE_TAILS

    @classmethod
    def build(cls, *, pauses=(), ambiguous=(), markers=(), marker_phrases=(), editing=(), strong=None, doubled=(), function=(), function_doubled=(), affixes=(), gap_redup=W.GAP_REDUPLICATION_MOST, gap_disfl=W.GAP_DISFLUENCY_LEAST, **context):
        """From plain lists; entries with a space are phrases, and later lists win: marker phrases, editing, markers."""
        single = lambda items: frozenset(c for x in items if " " not in x and (c := plain_canonical(x)))
        phrases: dict[str, str] = {}
        for items, category in ((marker_phrases, DM), (editing, EDIT), (markers, DM)):
            for x in items:
                if len(x.split()) > 1:
                    phrases[" ".join(plain_canonical(p) for p in x.split())] = category
        strong = W.STRONG_EDITING_TERMS if strong is None else strong
        return cls(single(pauses), single(ambiguous), single(markers), single(editing), single(strong), phrases, single(doubled), single(function), single(function_doubled), tuple(affixes), gap_redup, gap_disfl, **context)

    @classmethod
    def indonesian(cls) -> Lexicon:
        return cls.build(
            pauses=W.FILLED_PAUSES,
            ambiguous=W.AMBIGUOUS_PAUSES,
            markers=W.DISCOURSE_MARKERS,
            marker_phrases=W.DISCOURSE_PHRASES,
            editing=W.EDITING_TERMS,
            strong=W.STRONG_EDITING_TERMS,
            doubled=W.INHERENT_REDUPLICATIONS + W.LEXICAL_REDUPLICATIONS + W.RHYMING_REDUPLICATIONS,
            function=W.FUNCTION_WORDS,
            function_doubled=W.FUNCTION_REDUPLICATIONS,
            affixes=W.AFFIX_PATTERNS,
        )

    @classmethod
    def load(cls, folder: str) -> Lexicon:
        """From the two JSON files of a lexicon folder."""
        fillers = json.loads((Path(folder) / "fillers_id.json").read_text(encoding="utf-8"))
        redup = json.loads((Path(folder) / "reduplication_id.json").read_text(encoding="utf-8"))
        gaps = redup.get("ambang_prosodi", {})
        return cls.build(
            pauses=fillers.get("filled_pause", ()),
            ambiguous=fillers.get("filled_pause_ambiguous", ()),
            markers=fillers.get("discourse_marker", ()),
            marker_phrases=fillers.get("discourse_marker_multiword", ()),
            editing=fillers.get("editing_term", ()),
            strong=fillers.get("editing_term_kuat"),
            doubled=[*redup.get("inheren", ()), *redup.get("lexicalized", ()), *redup.get("berima", ())],
            function=redup.get("kata_fungsi", ()),
            function_doubled=redup.get("kata_fungsi_boleh_reduplikasi", ()),
            affixes=redup.get("pola_afiks_reduplikasi", {}).get("pola", ()),
            gap_redup=float(gaps.get("gap_reduplikasi_maks_detik", W.GAP_REDUPLICATION_MOST)),
            gap_disfl=float(gaps.get("gap_disfluensi_min_detik", W.GAP_DISFLUENCY_LEAST)),
        )

    @property
    def longest_phrase(self) -> int:
        return max([1, *(p.count(" ") + 1 for p in self.phrases)])

    @property
    def neutral_gap(self) -> float:
        return (self.gap_redup + self.gap_disfl) / 2

    # Look-ups; ``w`` is a canonical word.

    def category(self, w: Column) -> Column:
        """The first category that holds the word; null if none does."""
        return F.when(one_of(w, self.pauses), FP).when(one_of(w, self.ambiguous), FP_AMB).when(one_of(w, self.editing), EDIT).when(one_of(w, self.markers), DM)

    def is_filler(self, w: Column) -> Column:
        return one_of(w, self.pauses | self.ambiguous | self.editing | self.markers)

    def is_function(self, w: Column) -> Column:
        return one_of(w, self.function)

    def is_strong(self, w: Column) -> Column:
        return one_of(w, self.strong)

    def is_known_doubled(self, w: Column) -> Column:
        """A reduplicated word: listed, or formed by an affix pattern."""
        known = one_of(w, self.doubled | self.function_doubled)
        for pattern in self.affixes:
            known |= w.rlike(pattern if pattern.startswith("^") else "^" + pattern)
        return known

    def can_double(self, w: Column) -> Column:
        """Listed as such; else neither a function word nor a filler, and three letters or more."""
        return one_of(w, self.function_doubled) | ~(self.is_function(w) | self.is_filler(w)) & (F.length(w) >= 3)

    def is_hyphen_doubled(self, w: Column) -> Column:
        """One hyphen between two parts that repeat each other, wholly or at an end, or a known word."""
        left, right = F.substring_index(w, "-", 1), F.substring_index(w, "-", -1)
        two = (F.length(F.translate(w, "-", "")) == F.length(w) - 1) & (left != "") & (right != "")
        ends = right.endswith(left) | left.endswith(right) | right.startswith(left) | left.startswith(right)
        return two & (self.is_known_doubled(w) | F.when(left == right, self.can_double(left)).otherwise(ends))

    def is_cut_off(self, raw: Column, w: Column, next_w: Column, gap_after: Column, longest_gap) -> Column:
        """A word that breaks off: it ends in a hyphen, or the next word begins with it soon enough."""
        stem = F.rtrim(w, F.lit("-"))
        dash = F.rtrim(raw).endswith("-") & (F.length(stem) >= 1)
        begun = (F.length(stem) >= 2) & (stem != next_w) & next_w.startswith(stem) & ~self.is_function(stem) & ~self.is_filler(stem) & (gap_after <= longest_gap)
        return (w != "") & (dash | F.coalesce(begun, F.lit(False)))
