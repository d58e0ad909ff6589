"""URL filter: rules first, then a path-template tree.

A tree is grown per host over path segments.  Runs of digits are variable by
their look; a node whose children are many and seldom repeat is variable by
count, and its children become one wildcard.  Sibling branches are then merged
where their labels are statistically alike: those of one parent whose share of
blocked urls does not differ from the parent's become one branch with their
counts together, as do those without labels.  A branch is rejected by its
labelled share of blocked urls, smoothed towards that of the equally spelled
template over all hosts, and that towards the whole table.

Only DataFrame functions are used.  Urls are aggregated to one row a (host,
path with its digits replaced) before the tree is grown, and the tree is written
once; a host whose paths are all different keeps as many rows as it has urls.
Joins are on (host, template) or (host, path), aggregates combine before they
shuffle, and nothing is collected but two totals and the tree's depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickline.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of the tree between two cuts of its lineage.
LEVELS = 4
PARTS = r"(?s)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """A-Z lower-cased host; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null without one; rules are (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def template_tree(rows: DataFrame, depth: int | None, max_children: int, repeats: float) -> DataFrame:
    """(host, look, template, allowed, blocked) for each (host, look) of ``rows`` (host, look, label).

    ``look`` is the path with its runs of digits replaced; ``template`` has
    wildcards too for the segments, down to ``depth``, that vary by count;
    without a ``depth`` the tree goes down as far as a segment can vary: to
    where no more than ``max_children`` paths are left.
    """
    tree = rows.groupBy("host", "look").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("label") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("label") == "block", 1)).alias("blocked"),
    )
    tree = tree.withColumn("segments", F.split("look", "/")).withColumn("template", F.element_at("segments", 1))
    if depth is None:
        tree = materialize(tree, "paths")
        longest = tree.select(F.size("segments").alias("size")).orderBy(F.desc("size")).limit(max_children + 1).agg(F.min("size"), F.count("*")).first()
        depth = longest[0] - 1 if longest[1] > max_children else 0
    for level in range(1, depth + 1):
        segment = F.get("segments", F.lit(level))
        nodes = tree.groupBy("host", "template").agg(F.sum("n").alias("rows"), F.count_distinct(segment).alias("children"))
        varies = nodes.where((F.col("children") > max_children) & (F.col("children") * repeats > F.col("rows"))).select("host", "template", F.lit(True).alias("varies"))
        tree = tree.join(varies, ["host", "template"], "left").withColumn(
            "template", F.when(segment.isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(F.col("varies"), "*").otherwise(segment)))
        ).drop("varies")
        if level % LEVELS == 0 and level < depth:
            tree = materialize(tree, "levels")
    deeper = F.slice("segments", depth + 2, F.greatest(F.size("segments") - depth - 1, F.lit(0)))
    return tree.withColumn("template", F.concat("template", F.when(F.size("segments") > depth + 1, F.concat(F.lit("/"), F.array_join(deeper, "/"))).otherwise("")))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", depth: int | None = None, max_children: int = 20, repeats: float = 2.0, z: float = 2.0, strength: float = 5.0, reject: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, template, branch, purity) of every row.

    The urls that a rule decides are the labels.  purity is the smoothed share
    of blocked urls of the row's branch; where no rule fits, ``reject`` or
    more of it blocks.  Null urls and urls without ``://`` have an empty host
    and path and are judged as the branch of those.  Without any labels, purity
    is 0.5 throughout.  Repeated rows are judged alike; other columns are ignored,
    whatever their names.
    """
    host, path = F.col("host"), F.col("path")
    rule, label = longest_rule(host, path, rules)
    rows = pages.select(key, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.select(key, "host", "path", rule.alias("rule"), label.alias("label"), F.regexp_replace("path", "[0-9]+", "*").alias("look"))
    tree = materialize(template_tree(rows, depth, max_children, repeats).select("host", "look", "template", "allowed", "blocked"), "tree")

    total = tree.agg(F.sum("allowed"), F.sum("blocked")).first()
    allowed, blocked = total[0] or 0, total[1] or 0
    base = blocked / (allowed + blocked) if allowed + blocked else 0.5

    pooled = tree.groupBy("template").agg(((F.sum("blocked") + strength * base) / (F.sum("blocked") + F.sum("allowed") + strength)).alias("pooled"))
    branches = tree.groupBy("host", "template").agg(F.sum("blocked").alias("b"), (F.sum("blocked") + F.sum("allowed")).alias("m"))
    branches = branches.withColumn("parent", F.regexp_replace("template", "/[^/]*$", ""))
    b, m, share = F.col("b"), F.col("m"), F.col("share")
    families = branches.groupBy("host", "parent").agg((F.sum("b") / F.nullif(F.sum("m").cast("double"), F.lit(0.0))).alias("share"))
    alike = (m == 0) | (F.abs(b / m - share) <= z * F.sqrt(share * (1 - share) / m))
    branches = branches.join(families, ["host", "parent"]).withColumn("alike", alike)
    merged = branches.where("alike").groupBy("host", "parent").agg(F.sum("b").alias("all_b"), F.sum("m").alias("all_m"))
    branches = branches.join(merged, ["host", "parent"], "left").join(pooled, "template")
    own_b, own_m = F.when(F.col("alike"), F.col("all_b")).otherwise(b), F.when(F.col("alike"), F.col("all_m")).otherwise(m)
    branch = F.when(F.col("alike"), F.concat("parent", F.lit("/~"))).otherwise(F.col("template"))
    judged = branches.select("host", "template", branch.alias("branch"), ((own_b + strength * F.col("pooled")) / (own_m + strength)).alias("purity"))
    judged = tree.select("host", "look", "template").join(judged, ["host", "template"])
    verdict = F.coalesce("label", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return rows.join(judged, ["host", "look"]).select(key, "host", "path", "rule", verdict.alias("verdict"), "template", "branch", "purity")
