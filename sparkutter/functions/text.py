"""String functions on words. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = ".,!?;:\"'()[]{}"
WHITE = r"(?U)\s+"


def tokens(text: Column) -> Column:
    """The words of a text as an array (Unicode white space separates)."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without (Unicode) white space around it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise(raw: Column, trimmed: bool = False) -> Column:
    """Lower case, without punctuation around it; hyphens go in front only, as a trailing one marks a cut-off word."""
    word = raw if trimmed else strip(raw)
    return F.rtrim(F.ltrim(F.lower(word), F.lit(PUNCTUATION + "-")), F.lit(PUNCTUATION))


def collapse(word: Column, most: int = 2) -> Column:
    """Runs of one character cut to ``most``."""
    return F.regexp_replace(word, r"(?s)(.)\1{%d,}" % most, "$1" * most)


def canonical(raw: Column, trimmed: bool = False) -> Column:
    """The key for every look-up."""
    return collapse(normalise(raw, trimmed))


def syllables(raw: Column, trimmed: bool = False) -> Column:
    """Groups of vowels, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(F.translate(normalise(raw, trimmed), "-", ""), F.lit("[aiueo]+"))).cast("int")


def shape(raw: Column) -> Column:
    """Cap, Num, TrailHyphen or Hyphen, joined by a bar; plain if none holds."""
    first = F.substring(raw, 1, 1)
    parts = F.concat_ws(
        "|",
        F.when(first.rlike(r"^\p{Lu}"), "Cap"),
        F.when(raw.rlike(r"\p{Nd}"), "Num"),
        F.when(raw.endswith("-"), "TrailHyphen").when(raw.contains("-"), "Hyphen"),
    )
    return F.when(parts == "", "plain").otherwise(parts)


def bucket(value: Column, edges: tuple[float, ...]) -> Column:
    """b0 below the first edge, b1 below the second, and so on."""
    out = F.lit(f"b{len(edges)}")
    for i, edge in reversed(list(enumerate(edges))):
        out = F.when(value < F.lit(edge), f"b{i}").otherwise(out)
    return out


def timecode(ms: Column) -> Column:
    """HH:MM:SS.mmm of whole milliseconds; negative times are 0."""
    ms = F.greatest(ms.cast("long"), F.lit(0))
    part = lambda unit, base: F.floor(ms / unit).cast("long") % base
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), ms % 1000)


def milliseconds(seconds: Column) -> Column:
    """Whole milliseconds, halves to even."""
    return F.rint(seconds * 1000).cast("long")


def thousandths(x: Column) -> Column:
    """A double that is not negative, as a whole number of thousandths: the nearest to its exact value, ties to even.

    Spark's round() and format_string() round the shortest decimal that stands for a double, which is half-way more
    often than the double itself. The product's rounding error is found by splitting the factor (Dekker).
    """
    p = x * 1000.0
    k = F.floor(p)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * 1000.0 - p) + (x - high) * 1000.0
    beyond = (p - k - 0.5) + error
    return (k + F.when((beyond > 0) | (beyond == 0) & (k % 2 == 1), 1).otherwise(0)).cast("long")


def round3(x: Column) -> Column:
    return thousandths(x) / 1000.0


def fixed3(x: Column) -> Column:
    """With three decimals, as text."""
    ms = thousandths(x)
    return F.concat((ms / 1000).cast("long").cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def md5_bucket(value: Column, modulus: int) -> Column:
    """The MD5 of a string, as a 128-bit number, modulo ``modulus``."""
    digest = F.md5(value)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")
    m = F.lit(modulus).cast("decimal(10,0)")
    return (((half(1) % m) * F.lit(2**64 % modulus) + half(17) % m) % m).cast("int")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def f_measure(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and their harmonic mean, each 0 where undefined."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return precision, recall, ratio(2 * precision * recall, precision + recall)


def ffmpeg_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\:'])", r"\\$1")
