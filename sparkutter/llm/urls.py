"""URL filter: explicit rules first, then a tree of path templates for each host.

A rule names a host and the start of a path; it fits that host and its subdomains, and the longest rule that
fits decides. URLs with a rule are the labelled examples. All URLs, counted by host and path, form a tree for
each host, built level by level, however deep: a node branches as long as it has examples of both verdicts, and is
a leaf where its examples agree or there are none (no test could tell branches apart below it). A segment becomes a wildcard if it looks variable
(numbers, long hexadecimal strings), or if its branch is statistically like its siblings, that is, a two-sided
test does not tell its share of blocked examples from that of the other branches, or it has no examples while
the siblings that have some agree. Branches under one wildcard are merged and go on as one.

Every node has a purity, its share of blocked examples smoothed towards its parent's (the root's towards that
of all hosts). A URL without a rule is judged by its deepest node: blocked if the purity reaches
``threshold``. A node adds evidence only where it has examples, so the tree's effect fades to the parent's
value elsewhere.

All of it is DataFrame aggregates and joins on (host, template) counts; the tree is never on the driver.

Cases: a null URL, or one without "://", has an empty host and path and is judged like any other with them;
repeated pages count each; an empty table gives an empty result; without rules every verdict is allow; further
columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, spread_join, table

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
SALTS = 16
VARIABLE = r"^([0-9]+|[0-9a-f]{8,}|.*[0-9]{3,}.*)$"
SMOOTHING = 4.0
THRESHOLD = 0.5
Z = 1.96


def parsed(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with host and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumns({"host": lower, "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def ruled(rows: DataFrame, rules) -> tuple[Column, Column]:
    """The rule that decides, as text, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def purity(blocked: Column, examples: Column, parent: Column) -> Column:
    return (blocked + SMOOTHING * parent) / (examples + SMOOTHING)


def templates(counts: DataFrame) -> DataFrame:
    """host, path, template and purity for each distinct (host, path) of ``counts`` (with examples and blocked), a written table."""
    total = counts.agg(F.sum("examples").alias("e"), F.sum("blocked").alias("b")).first()
    base = F.lit(total["b"] / total["e"] if total["e"] else 0.0)
    hosts = counts.groupBy("host").agg(F.sum("examples").alias("e"), F.sum("blocked").alias("b"))
    mixed = lambda e, b: (F.col(b) > 0) & (F.col(b) < F.col(e))
    hosts = hosts.select("host", purity(F.col("b"), F.col("e"), base).alias("purity"), mixed("e", "b").alias("mixed"))
    # A host, or a template, with many paths is read in parts.
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS))
    parts = F.slice(F.split("path", "/"), 2, 2**31 - 1)
    rows = spread_join(counts, hosts, ["host"], salt).withColumns({"template": F.lit(""), "parts": parts})
    rows = materialize(rows.select("host", "path", "examples", "blocked", "template", "purity", "parts", "mixed"))
    done, level = None, 0
    while True:
        # Below a leaf nothing tells branches apart: all that follows is one wildcard a segment.
        further = F.col("mixed") & (F.size("parts") > level)
        leaves = rows.filter(~further).select("host", "path", F.concat("template", F.repeat(F.lit("/*"), F.size("parts") - level)).alias("template"), "purity")
        done, rows = leaves if done is None else done.unionByName(leaves), rows.filter(further)
        if rows.isEmpty():
            return done
        segment = F.get("parts", level)
        rows = rows.withColumn("segment", F.when(segment.rlike(VARIABLE), F.lit("*")).otherwise(segment))
        # A branch against its siblings.
        branch = rows.groupBy("host", "template", "segment").agg(F.sum("examples").alias("e"), F.sum("blocked").alias("b"))
        parent = branch.groupBy("host", "template").agg(F.sum("e").alias("pe"), F.sum("b").alias("pb"))
        branch = branch.join(parent, ["host", "template"])
        rest = F.col("pe") - F.col("e")
        pooled = F.col("pb") / F.greatest(F.col("pe"), F.lit(1))
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(F.col("e"), F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
        apart = F.abs(F.col("b") / F.greatest(F.col("e"), F.lit(1)) - (F.col("pb") - F.col("b")) / F.greatest(rest, F.lit(1)))
        alike = F.when((F.col("e") == 0) | (rest == 0), pooled * (1 - pooled) == 0).otherwise(apart <= Z * error)
        branch = materialize(branch.select("host", "template", "segment", F.when(alike, F.lit("*")).otherwise(F.col("segment")).alias("kept"), "e", "b"))
        nodes = branch.groupBy("host", "template", "kept").agg(F.sum("e").alias("ne"), F.sum("b").alias("nb"))
        branch = branch.drop("e", "b").join(nodes, ["host", "template", "kept"])
        rows = spread_join(rows, branch, ["host", "template", "segment"], salt)
        rows = materialize(
            rows.select(
                "host",
                "path",
                "examples",
                "blocked",
                F.concat_ws("/", "template", "kept").alias("template"),
                purity(F.col("nb"), F.col("ne"), F.col("purity")).alias("purity"),
                "parts",
                mixed("ne", "nb").alias("mixed"),
            )
        )
        level += 1


def judge(pages: DataFrame, *, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each row."""
    rows = parsed(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    rule, verdict = ruled(rows, rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    counts = materialize(rows.groupBy("host", "path").agg(F.count("ruled").alias("examples"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")))
    rows = rows.join(templates(counts), ["host", "path"])
    method = F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
