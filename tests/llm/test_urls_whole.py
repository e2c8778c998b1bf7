"""The URL tree below its fourth segment."""

from sparkutter.llm import urls

RULES = (("h.com", "/a/b/c/d/e/bad/1", "block"), ("h.com", "/a/b/c/d/e/good/1", "allow"))


def test_deep_branches(spark):
    paths = [f"/a/b/c/d/e/{x}/{n}" for x in ("bad", "good") for n in (*range(100, 140), *range(200, 205))]
    pages = spark.createDataFrame([(i, "http://h.com" + p) for i, p in enumerate(paths)], "page_id long, url string")
    got = {r["path"]: r["verdict"] for r in urls.judge(pages, rules=RULES).collect()}
    assert got == {p: "block" if "/bad/" in p else "allow" for p in paths}
