import pytest
from pyspark.sql import functions as F

from wickline.llm import urls
from wickline.llm.queries import URL_RULES


def judged(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("template", F.lit(1))
    return urls.judge_urls(df, URL_RULES, **options)


CASES = [
    ("https://WWW.Example.ORG/es/1?x#y", "www.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"), ("http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
    ("http://a.com/de/x", "a.com", "/de/x", "com/de/", "block"), ("http://org/x", "org", "/x", "org/", "allow"), ("http://a.org", "a.org", "", None, None), ("http://a.org?q=/x", "a.org", "", None, None),
    ("http://telecom/de/1", "telecom", "/de/1", None, None), ("a.org/x", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("x://y://z/w", "y:", "//z/w", None, None), ("http://ÀB.org/É", "Àb.org", "/É", "org/", "allow"),
]


def test_parts_and_rules(spark):
    rows = {r.page_id: r for r in judged(spark, [(i, c[0]) for i, c in enumerate(CASES)]).collect()}
    assert len(rows) == len(CASES)
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_unlabelled_hosts_follow_the_pooled_template(spark):
    rows = [(i, f"http://h{i % 7}.com/de/{i}") for i in range(70)] + [(100 + i, f"http://h{i % 7}.com/fr/{i}") for i in range(70)] + [(1000, "http://q.net/de/5"), (1001, "http://q.net/fr/6")]
    found = {r.page_id: r for r in judged(spark, rows).collect()}
    assert (found[1000].verdict, found[1001].verdict) == ("block", "allow")
    assert found[1000].template == "/de/*" and found[1000].purity > 0.9


def test_segments_that_vary_become_wildcards(spark):
    words = [f"{a}{b}{c}" for a in "abc" for b in "defg" for c in "hijk"]
    rows = [(i, f"http://x.net/tag/{w}/view") for i, w in enumerate(words)] + [(100 + i, f"http://x.net/{w}") for i, w in enumerate(["aa", "bb"] * 20)]
    found = {r.page_id: r.template for r in judged(spark, rows).collect()}
    assert found[0] == "/tag/*/view" and found[100] == "/aa"


def test_repeated_rows_and_empty_table(spark):
    rows = judged(spark, [(1, "http://a.net/x"), (1, "http://a.net/x"), (None, "http://a.net/x")]).collect()
    assert len(rows) == 3 and len({(r.verdict, r.purity) for r in rows}) == 1
    assert judged(spark, []).collect() == []


def test_plan_is_native(spark):
    plan = judged(spark, [(1, "http://a.net/x")])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))


@pytest.mark.parametrize("depth", [1, 3])
def test_deep_paths_keep_their_tail(spark, depth):
    row = judged(spark, [(1, "http://a.net/a/b/c/d/e")], depth=depth).first()
    assert row.template == "/a/b/c/d/e"


def test_segments_of_any_depth_become_wildcards(spark):
    slugs = [a + b for a in "abcdef" for b in "ghijkl"]
    rows = [(i, f"http://x.com/de/a/b/c/d/e/{s}") for i, s in enumerate(slugs)] + [(100 + i, f"http://y.net/de/a/b/c/d/e/{s}z") for i, s in enumerate(slugs)]
    rows += [(200 + i, f"http://x.com/fr/{i}") for i in range(100)]
    found = {r.page_id: r for r in judged(spark, rows).collect()}
    assert {(found[100 + i].template, found[100 + i].verdict) for i in range(36)} == {("/de/a/b/c/d/e/*", "block")}


def test_siblings_that_are_alike_are_merged(spark):
    """Sections of a host with like shares of blocked urls are one branch; the odd one stays alone."""
    rows = []
    for section, blocked in (("a", 8), ("b", 7), ("c", 9), ("odd", 40), ("none", 0)):
        for i in range(40 if section != "none" else 3):
            word = "de" if i < blocked and section != "none" else "fr"
            rows.append((len(rows), f"http://h.net/{section}/{'x' if word == 'de' else 'y'}"))
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = [("block", f"h.net/{s}/x") for s in ("a", "b", "c", "odd")] + [("allow", f"h.net/{s}/y") for s in ("a", "b", "c")]
    found = {r.page_id: r for r in urls.judge_urls(df, rules, depth=1).collect()}
    assert len(found) == len(rows)
    # leaves below one section: /a/x is all blocked, /a/y all allowed, so neither is like their parent
    assert {r.branch for r in found.values() if r.path in ("/a/x", "/a/y")} == {"/a/x", "/a/y"}
    # /none/x and /none/y have no labels and are merged
    assert {r.branch for r in found.values() if r.path.startswith("/none/")} == {"/none/~"}


def test_merged_branches_share_their_counts(spark):
    """Slugs below one section, each with few labels of which some are blocked, are judged together."""
    rules = [("block", f"h.net/s/{c}/1") for c in "abcdefgh"] + [("allow", f"h.net/s/{c}/2") for c in "abcdefgh"]
    rows = [(len(rules) * 100 + 10 * i + j, f"http://h.net/s/{c}/{j}") for i, c in enumerate("abcdefgh") for j in (1, 1, 1, 2, 3)]
    found = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules, depth=2, max_children=100).collect()
    assert {r.branch for r in found} == {f"/s/{c}/~" for c in "abcdefgh"}  # one wildcard each, alike to its parent
    assert len({round(r.purity, 9) for r in found}) == 1 and 0.6 < found[0].purity < 0.8
    assert {r.verdict for r in found if r.rule is None} == {"block"}
