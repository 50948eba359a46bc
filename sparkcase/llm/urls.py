"""URL filter: host rules first, then a tree of path templates judged by labelled purity.

Each host's paths become a tree of segments. Segments that vary (digits, long
hex or mixed ids) turn into wildcards at once; any other node with many
different children, few of which repeat, turns all of them into one wildcard.
Paths are kept whole; nodes below DEPTH levels are generalised in one step, by
their own segments. Sibling branches with the same remainder whose labelled
shares do not differ significantly are merged. A template's purity is its share
of blocked labels in its host, smoothed towards the same template's share in all
hosts, that towards the host's share, and that towards everything's; templates
of high purity are rejected.

Labels come from the rules themselves: a url that a rule fits is labelled with
that rule's verdict, and the templates carry this to urls that no rule fits: a
kind of path that is blocked wherever a rule knows it is blocked elsewhere too,
one that is blocked here and allowed there is not. Counting goes by (host,
template), pre-aggregated, so a hot host is no hot task; the last join, by host
and template, is of plain tables and so a skew join.

Nulls: a null url, or one without "://", has an empty host and path, fits no
rule and is judged by the template of the empty host (allowed where there are
no labels). Repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Fixed rules of the query: verdict, host, path prefix.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEPTH = 8
MAX_CHILDREN = 16
MIN_VARIETY = 0.5
SMOOTHING = 4.0
SAME_Z = 1.96
REJECT_PURITY = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    some = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(some, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(some, pattern, 2)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path) and its verdict; null where none fits."""
    names, verdicts = [], []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        names.append(F.when(fits, F.lit(h + p)))
        verdicts.append(F.when(fits, F.lit(verdict)))
    none = F.lit(None).cast("string")
    return F.coalesce(*names, none), F.coalesce(*verdicts, none)


def fixed_template(path: Column) -> Column:
    """Segments with those that vary by their own look turned into wildcards."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    varies = r"^(?:[0-9]+|[0-9a-fA-F-]{16,}|(?=.*[0-9].*[0-9])[^.]{8,})((?:\.[A-Za-z]{1,5})?)$"
    return F.transform(parts, lambda s: F.regexp_replace(s, varies, "*$1"))


def wide_nodes(children: DataFrame, node: list[str]) -> DataFrame:
    """The nodes of many different children, few of which repeat; children: node, child, n."""
    different = children.groupBy(*node, "child").agg(F.sum("n").alias("n"))
    counted = different.groupBy(*node).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("n"))
    return counted.filter((F.col("children") > MAX_CHILDREN) & (F.col("children") >= MIN_VARIETY * F.col("n"))).select(*node)


def generalised(counts: DataFrame) -> DataFrame:
    """counts of (host, t0) with t, in which nodes of too many children hold one wildcard.

    Level by level from the root, down to DEPTH; a node's children are counted
    under its already generalised prefix. All deeper levels are one step. Two
    shuffles a step, all on aggregated rows.
    """
    deepest = counts.agg(F.max(F.size("t0"))).first()[0] or 0
    rows = counts.withColumn("t", F.col("t0"))
    for level in range(min(deepest, DEPTH)):
        child, node = F.get("t", F.lit(level)), ["host", "prefix"]
        at = rows.withColumn("prefix", F.slice("t", 1, level) if level else F.array().cast("array<string>"))
        wide = written(wide_nodes(at.filter(child.isNotNull()).select(*node, child.alias("child"), "n"), node), f"urltree{level}")
        if wide.isEmpty():
            continue
        rows = at.join(wide.withColumn("wide", F.lit(True)), node, "left").withColumn(
            "t",
            F.when(
                F.col("wide") & child.isNotNull(),
                F.transform("t", lambda s, i: F.when(i == level, F.lit("*")).otherwise(s)),
            ).otherwise(F.col("t")),
        ).drop("prefix", "wide")
        rows = written(rows, f"urlrows{level}")
    if deepest > DEPTH:
        node = ["host", "level", "prefix"]
        deep = rows.filter(F.size("t") > DEPTH).select("host", "t0", "t", "n", F.explode(F.sequence(F.lit(DEPTH), F.size("t") - 1)).alias("level"))
        deep = deep.withColumn("prefix", F.xxhash64(F.slice("t", F.lit(1), F.col("level")))).withColumn("child", F.get("t", F.col("level")))
        wide = wide_nodes(deep, node)
        levels = deep.join(wide, node).groupBy("host", "t0").agg(F.collect_set("level").alias("levels"))
        rows = written(rows.join(levels, ["host", "t0"], "left").withColumn(
            "t", F.when(F.col("levels").isNotNull(), F.transform("t", lambda s, i: F.when(F.array_contains("levels", i), F.lit("*")).otherwise(s))).otherwise(F.col("t"))
        ).drop("levels"), "urlrows")
    return rows


def templates(urls: DataFrame) -> DataFrame:
    """(host, t0, template, branch, n, blocked, labelled, purity) for rows (host, t0, verdict or null)."""
    counts = urls.groupBy("host", "t0").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("verdict") == "block").alias("blocked"),
        F.count_if(F.col("verdict").isNotNull()).alias("labelled"),
    )
    tree = generalised(written(counts, "urls")).withColumn("template", F.concat(F.lit("/"), F.array_join("t", "/")))
    leaf = tree.groupBy("host", "template", "t").agg(
        *[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")]
    )
    # The same templates in all hosts: a plain table, so that a template of many hosts is split in the join.
    pooled = written(leaf.groupBy("template").agg(F.sum("blocked").alias("all_blocked"), F.sum("labelled").alias("all_labelled")), "urlpool")
    # Siblings: branches of one node with the same remainder, in order of their labelled share (where they have none, of all hosts').
    place = F.greatest(F.size("t") - 2, F.lit(0))
    family = F.array_join(F.transform("t", lambda s, i: F.when(i == place, F.lit("\u0000")).otherwise(s)), "/")
    known = {k: F.when(F.col("labelled") > 0, F.col(k)).otherwise(F.col(f"all_{k}")) for k in ("blocked", "labelled")}
    leaf = leaf.join(pooled, "template").withColumns({"family": family, "weight": known["labelled"], "hits": known["blocked"]})
    leaf = leaf.withColumn("share", F.when(F.col("weight") > 0, F.col("hits") / F.col("weight")))
    order = Window.partitionBy("host", "family").orderBy(F.col("share").asc_nulls_last(), "template")
    before, seen = F.lag("share").over(order), F.lag("weight").over(order)
    both = (F.col("hits") + before * seen) / (F.col("weight") + seen)
    error = F.sqrt(both * (1 - both) * (1 / F.col("weight") + 1 / seen))
    same = (F.col("share") == before) | (F.col("share") - before <= SAME_Z * error) | (F.col("share").isNull() & before.isNull())
    leaf = leaf.withColumn("new", F.when(same, 0).otherwise(1)).withColumn(
        "branch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    sums = ("n", "blocked", "labelled", "all_blocked", "all_labelled")
    merged = leaf.groupBy("host", "family", "branch").agg(*[F.sum(c).alias(c) for c in sums])
    hosts = leaf.groupBy("host").agg(F.sum("blocked").alias("host_blocked"), F.sum("labelled").alias("host_labelled"))
    everywhere = hosts.agg(
        ((F.coalesce(F.sum("host_blocked"), F.lit(0)) + 1) / (F.coalesce(F.sum("host_labelled"), F.lit(0)) + 2)).alias("p")
    ).first()["p"]
    of_host = (F.col("host_blocked") + SMOOTHING * everywhere) / (F.col("host_labelled") + SMOOTHING)
    prior = (F.col("all_blocked") + SMOOTHING * of_host) / (F.col("all_labelled") + SMOOTHING)
    scored = merged.join(hosts, "host").withColumn(
        "purity", (F.col("blocked") + SMOOTHING * prior) / (F.col("labelled") + SMOOTHING)
    ).select("host", "family", "branch", "purity", F.col("labelled").alias("evidence"))
    by_template = leaf.select("host", "template", "family", "branch").join(scored, ["host", "family", "branch"])
    return tree.select("host", "t0", "template").join(by_template, ["host", "template"])


def judge(df: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """df with host, path, rule, template, purity and verdict (columns of these names are replaced)."""
    outputs = ["host", "path", "rule", "template", "purity", "verdict"]
    kept = [c for c in df.columns if c.lower() not in outputs]
    host, path = host_and_path(F.col(url_col))
    rows = df.select(*kept, host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict, "t0": fixed_template(F.col("path"))})
    known = written(
        templates(rows.select("host", "t0", "verdict")).select("host", "t0", "template", "purity"), "templates"
    )
    rejects = F.when(F.col("purity") >= REJECT_PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(known, ["host", "t0"]).select(
        *kept, "host", "path", "rule", "template", "purity", F.coalesce("verdict", rejects).alias("verdict")
    )


def op7_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
