"""Secret scans: fixed patterns, and strings that a battery of randomness tests finds random.

Patterns: assignments of a value to a secret's usual names, access keys, long hexadecimal strings. The battery
looks at every other run of at least 20 characters of an encoding's alphabet:

* its encoding is inferred from the characters it has (hexadecimal, base 32, 36, 62, 64), with an alphabet of k;
* three tests of uniform randomness: chi-squared over the alphabet (k - 1 degrees of freedom), runs above and
  below the alphabet's middle and serial correlation of neighbours (a squared normal deviate each);
* their sum has k + 1 degrees of freedom for a random string. Of ordinary writing it is larger, as letters
  are unevenly used, and more so the longer the string: non-central, by n (k S - 1), where S is the sum of squared
  shares of the letters (``WRITING``; of digits, for hexadecimal strings). The p-value of a string is the chance that
  ordinary writing of its length and alphabet gives a sum as small as its own: strings that fail any test badly
  have a large one, and so have short strings, which cannot show much.

The p-values of all these strings go through the Benjamini-Hochberg rule, separately and with their own share of
the error rate for each class of lengths, longer strings having more. The rule needs only counts of p-values
by magnitude: at most ``4 * 3001`` counters reach the driver, however many strings there are.

All of it is DataFrame expressions, linear in the length of a text. Positions are code points, ends exclusive.

Cases: a null text is empty, a null id stays null, empty texts have no spans, repeated rows are scanned each,
an empty table gives an empty result, further columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW, content_key, materialize, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs: the same matches as of the open-ended patterns with a length filter after.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Sums of squared shares: of letters in ordinary writing, and of ten digits that are used alike.
WRITING, NUMBERS = 0.065, 0.1
RATE = 0.01
CLEAN = "__sparkutter_clean"
#: Characters of a text that are masked together.
CHUNK = 4096
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: (pattern, alphabet in order), the first that fits.
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("^[A-Z2-7]+=*$", UPPER + "234567"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("", UPPER + LOWER + DIGITS + "+/-_="),
)
#: From this length on, with this weight of the error rate.
LENGTHS = ((20, 0.4), (32, 0.8), (48, 1.2), (64, 1.6))


def lower_tail(z: Column) -> Column:
    """P(N < z) for the normal distribution (Abramowitz and Stegun 26.2.17, error below 1e-7); far tails by its first term."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * F.when(x > 8, 1 / x).otherwise(poly)
    return F.when(z < 0, tail).otherwise(1 - tail)


def battery(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with n (the length), chi, runs and serial (the tests' statistics) and p of the string in ``column``."""
    s = F.col(column)
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(s.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    rows = rows.withColumns({"alphabet": alphabet, "n": F.length(s).cast("double")})
    rows = rows.withColumn("v", F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.col("alphabet"), c).cast("double")))
    k, n, v = F.length("alphabet").cast("double"), F.col("n"), F.col("v")
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda acc, x: acc + F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), F.lit(2.0)))
    changes = add(F.transform(pairs, lambda p: F.when((p["a"] > k / 2) != (p["b"] > k / 2), 1.0).otherwise(0.0)))
    # The share of neighbours on different sides, if characters are drawn alike; an odd alphabet has no middle.
    side = F.floor(k / 2) / k
    differ = 2 * side * (1 - side)
    rows = rows.withColumns({"mean": add(v) / n, "chi": k / n * squares - n, "runs": F.pow((changes - (n - 1) * differ) / F.sqrt((n - 1) * differ * (1 - differ)), F.lit(2.0))})
    mean = F.col("mean")
    around = add(F.transform(v, lambda x: (x - mean) * (x - mean)))
    beside = add(F.transform(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean)))
    # Neighbours in a random string are correlated by -1 / n; a string of one character fails.
    rows = rows.withColumn("serial", F.when(around > 0, F.pow((beside / around + 1 / n) * F.sqrt(n), F.lit(2.0))).otherwise(n))
    total, free = F.col("chi") + F.col("runs") + F.col("serial"), k + 1
    beyond = n * (k * F.when(k == 16, NUMBERS).otherwise(WRITING) - 1)
    # Non-central chi-squared as a scaled central one (Patnaik), and that as normal (Wilson and Hilferty).
    scale, h = (free + 2 * beyond) / (free + beyond), (free + beyond) * (free + beyond) / (free + 2 * beyond)
    part = 2 / (9 * h)
    z = (F.pow(F.greatest(total, F.lit(0.0)) / (scale * h), F.lit(1 / 3)) - (1 - part)) / F.sqrt(part)
    return rows.withColumn("p", lower_tail(z)).drop("alphabet", "v", "mean")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id), and their matches (row, kind, start, end, base, s).

    ``base``: a span of the patterns. The others, with their string s, are those that overlap none.
    """
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    nothing = F.expr("cast(array() as array<string>)")
    patterns = (ASSIGN, ACCESS, HEX, TOKEN)
    for i, pattern in enumerate(patterns):
        whole = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        rows = rows.withColumn(f"m{i}", F.when(F.col("t").contains("AKIA"), whole).otherwise(nothing) if pattern == ACCESS else whole)
    for i, pattern in enumerate(patterns):
        rows = rows.withColumn(f"g{i}", F.when(F.size(f"m{i}") > 0, F.split("t", pattern)).otherwise(nothing))

    def items(kind: int) -> Column:
        """Each match with the length of the text between it and the one before."""
        sound = (lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8) if kind == 0 else (lambda m: F.lit(True))
        return F.transform(
            f"m{kind}",
            lambda m, at: F.struct(
                F.lit(kind).alias("kind"), at.alias("at"), F.length(F.get(f"g{kind}", at)).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), sound(m).alias("sound"), (m if kind == 3 else F.lit(None).cast("string")).alias("s")
            ),
        )

    rows = materialize(rows.select("row", "doc_id", F.concat(*[items(i) for i in range(4)]).alias("items")))
    # Rows of one key, if they share it, have the same matches.
    found = rows.filter(F.size("items") > 0).groupBy("row").agg(F.first("items").alias("items")).select("row", F.inline("items"))
    one_kind = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(one_kind)).filter("sound")
    found = found.select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end", (F.col("kind") < 3).alias("base"), "s")
    forth, back = Window.partitionBy("row").orderBy("start"), Window.partitionBy("row").orderBy(F.desc("start"))
    found = found.withColumns({"reach": F.max(F.when(F.col("base"), F.col("end"))).over(forth), "next": F.min(F.when(F.col("base"), F.col("start"))).over(back)})
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return rows.select("row", "doc_id"), materialize(found.filter(F.col("base") | clear).drop("reach", "next"))


def magnitude(p: Column) -> Column:
    """-10 log10 p in whole numbers, rounded down, 0 to 3000."""
    return F.least(F.lit(3000), F.greatest(F.lit(0), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300)))))).cast("int")


def length_class(n: Column) -> Column:
    at = F.lit(0)
    for i, (least, _) in enumerate(LENGTHS):
        at = F.when(n >= least, F.lit(i)).otherwise(at)
    return at


def cutoffs(tests: DataFrame, rate: float) -> dict[int, int]:
    """For each class of lengths the least magnitude that the Benjamini-Hochberg rule accepts."""
    found: dict[int, dict[int, int]] = {}
    for r in tests.groupBy(length_class(F.col("n")).alias("c"), magnitude(F.col("p")).alias("q")).agg(F.count(F.lit(1)).alias("k")).collect():
        found.setdefault(r["c"], {})[r["q"]] = r["k"]
    out = {}
    for c, counts in found.items():
        total, above = sum(counts.values()), 0
        for q in sorted(counts, reverse=True):
            above += counts[q]
            # All p-values of magnitude q are at most 10 ** (-q / 10).
            if 10 ** (-q / 10) * total <= rate * LENGTHS[c][1] * above:
                out[c] = q
    return out


def span_table(docs: DataFrame, *, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id), and the spans found in them (row, kind as a number, start, end)."""
    rows, found = scan(docs, id_col, text_col)
    tests = materialize(battery(found.filter("NOT base"), "s").select("row", "kind", "start", "end", "n", "p"))
    accept = F.lit(False)
    for c, q in cutoffs(tests, rate).items():
        accept |= (length_class(F.col("n")) == c) & (magnitude(F.col("p")) >= q)
    names = ("row", "kind", "start", "end")
    return rows, found.filter("base").select(*names).unionByName(tests.filter(accept).select(*names))


def find_spans(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind as a number, end, in order) of each row."""
    rows, found = span_table(docs, **options)
    spans = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    rows = rows.join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")))
    return rows.select("doc_id", F.filter("spans", lambda x: x["kind"] < 3).alias("base"), "spans")


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, **options) -> DataFrame:
    """``docs`` with every span replaced by ``mask``, once for spans that overlap (and n_chars, where there is one, counted again).

    Rows without spans stay as they are. Texts with spans are masked in chunks, so the work is linear in their length.
    """
    rows = docs.withColumn(ROW, content_key(id_col, text_col))
    _, spans = span_table(rows, id_col=id_col, text_col=text_col, **options)
    spans = materialize(spans)
    # Spans that overlap are one.
    order = Window.partitionBy("row").orderBy("start", "end")
    new = F.coalesce(F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    merged = spans.withColumn("new", new.cast("int")).withColumn("of", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("row", "of").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    across = F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))
    merged = merged.select("row", F.explode(F.transform(across, lambda x: x.cast("int"))).alias("at"), "start", "end")
    inside = merged.groupBy("row", "at").agg(F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("at") * chunk).alias("a"), (F.col("end") - F.col("at") * chunk).alias("b")))).alias("cuts"))
    chunks = rows.select(F.col(ROW).alias("row"), F.col(text_col).alias("t")).join(spans.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    chunks = chunks.select("row", F.posexplode(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("at", "t")).join(inside, ["row", "at"], "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        # A span that began in an earlier chunk has left its mask there.
        before = F.substring(F.col("t"), (acc["at"] + 1).cast("int"), F.greatest(F.lit(0).cast("long"), x["a"] - acc["at"]).cast("int"))
        return F.struct(x["b"].alias("at"), F.concat(acc["out"], before, F.when(x["a"] >= 0, F.lit(mask)).otherwise("")).alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("t"), (acc["at"] + 1).cast("int"), F.lit(chunk)))
    chunks = chunks.select("row", "at", F.when(F.col("cuts").isNull(), F.col("t")).otherwise(F.aggregate("cuts", start, step, end)).alias("t"))
    clean = chunks.groupBy(F.col("row").alias(ROW)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "").alias(CLEAN))
    joined = rows.join(clean, ROW, "left")
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.coalesce(CLEAN, c).alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col(CLEAN).isNull(), F.col(c)).otherwise(F.length(CLEAN)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
