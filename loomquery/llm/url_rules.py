"""URL filters: longest-rule lookup as a sort-merge range join over reversed-host keys.

A rule (host, path) fits its host and every subdomain when the url's path starts with the
rule's path. Both sides become one string key, `com.example/en/7`: the host's labels reversed,
then the path. A rule is then the interval of all keys that start with its own key, and a url
has one probe for each ancestor host, since a subdomain must meet the rules of its parents.

Intervals of string prefixes nest or are disjoint, so a sweep over the sorted boundaries needs
a stack: opening an interval pushes its rule, closing pops. `stacked` keeps that stack as a level
for each boundary and names the rule on top after it. `judge` sorts boundaries and probes
together by range partitions, so a host with any share of the urls spreads over many tasks (ties
of one key are cut by the row's own number), and fills the top rule forward. Only the state at the
end of each partition, one row a partition, is combined across partitions.

No Python runs on the executors. Cost: shuffles of urls and keys only; page bodies stay where they are
unless the caller selects them.

Keys are compared as UTF-8 bytes, and an interval ends at its key and a byte that UTF-8 never has; so any
character may occur in a url. The rules of one host are swept in one task, sorted on disk if need be; those of different hosts apart.

Defined results: a null url, and one without `://`, has an empty host and path, fits no rule and
gets the default verdict. Repeated rows each get their verdict. No rules: every url gets the
default verdict; no pages: an empty result. Rules with an empty or null host are not rules; a null path is an empty one. The longest
rule (host and path together) wins; of two as long the one with the longer host; if two rules have the same host and
path, `block` wins. A very long url is a key like others. host, path, rule and verdict replace columns of these names; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, partitions, written

#: Sorts after every byte of UTF-8, so key + LAST closes the interval of the keys that start with key.
LAST = b"\xff"
#: Their order at equal keys.
CLOSE, OPEN, PROBE = 0, 1, 2


def parts(url):
    """Columns (host, path) of a url, both empty where it has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def reversed_host(host):
    return F.concat_ws(".", F.reverse(F.split(host, r"\.")))


def stacked(rules: DataFrame) -> DataFrame:
    """(key, kind, top): each interval boundary and the rule on top of the stack after it.

    The stack's height is a running sum; after a boundary that leaves height h, the top is the last
    rule opened at height h. Intervals of different rule hosts are disjoint, so each host has its own sweep.
    """
    rules = (
        rules.select(F.lower("verdict").alias("verdict"), ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .filter("host is not null and host != ''")
        .groupBy("host", "path")
        .agg(F.min(F.struct((F.col("verdict") != "block").alias("late"), "verdict"))["verdict"].alias("verdict"))
        .select("*", F.concat(reversed_host(F.col("host")), F.lit("/"), F.col("path")).cast("binary").alias("start"))
    )
    rule = F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("n_host"), F.concat("host", "path").alias("rule"), "verdict", "start")
    edges = rules.select(
        "host", F.explode(F.array(
            F.struct(F.col("start").alias("key"), F.lit(OPEN).alias("kind"), F.lit(1).alias("step"), rule.alias("rule")),
            F.struct(F.concat("start", F.lit(bytearray(LAST))).alias("key"), F.lit(CLOSE).alias("kind"), F.lit(-1).alias("step"), rule.alias("rule")),
        )).alias("e")
    ).select("host", "e.*")
    order = [F.col("key"), F.col("kind")]
    sweep = Window.partitionBy("host").orderBy(*order)
    edges = edges.withColumn("height", F.sum("step").over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    opened = F.when(F.col("kind") == OPEN, F.col("rule"))
    level = Window.partitionBy("host", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # A rule that closes from height h + 1 leaves the rule last opened at height h on top, if h > 0.
    return edges.select("key", "kind", F.when(F.col("height") > 0, F.last(opened, True).over(level)).alias("top"))


def judge(spark: SparkSession, pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict; its own columns of these names are replaced."""
    pages = pages.drop(*[c for c in pages.columns if c.lower() in {"host", "path", "rule", "verdict"} and c != url])
    host, path = parts(F.col("u"))
    urls = pages.select(F.col(f"`{url}`").alias("u")).filter("u is not null").distinct().select("u", host.alias("host"), path.alias("path")).filter("host != ''")
    # A url's probes: its last 1, 2, ... labels, no deeper than any rule goes.
    deepest = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"] or 1
    labels = F.reverse(F.split("host", r"\."))
    ancestors = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit("/"), F.col("path")).cast("binary"))
    probes = urls.select("u", F.explode(ancestors).alias("key"), F.lit(PROBE).alias("kind"))

    edges = stacked(rules).select(F.lit(None).cast("string").alias("u"), "key", "kind", F.struct("top").alias("state"))
    events = probes.select("u", "key", "kind", F.lit(None).cast(edges.schema["state"].dataType).alias("state")).unionByName(edges)
    events = events.repartitionByRange(partitions(spark), "key", "kind", "u").withColumn("part", F.spark_partition_id())
    events = written(events, "url-sweep")  # both readers below must see the same cut into parts

    # The state at the start of a part: the last boundary in any part before it. One row a part.
    at = F.struct("key", "kind")
    ends = events.filter(F.col("kind") != PROBE).groupBy("part").agg(F.max_by("state", at).alias("state"))
    parts_seen = events.select("part").distinct().join(ends, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts_seen.select("part", F.last("state", True).over(before).alias("carried"))

    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = events.withColumn("state", F.last("state", True).over(sweep)).filter(F.col("kind") == PROBE).join(F.broadcast(carried), "part")
    met = met.select("u", F.coalesce("state", "carried")["top"].alias("rule")).filter("rule is not null")
    best = met.groupBy("u").agg(F.max("rule").alias("best"))

    # As bytes the urls are dealt for this join alone, not with the aggregate's partitions: a hot url, or null, can be split.
    key, own = free_name(pages, "url_"), free_name(pages, "best_")
    best = best.select(F.col("u").cast("binary").alias(key), F.col("best").alias(own))
    judged = pages.withColumn(key, F.col(f"`{url}`").cast("binary")).join(best, key, "left")
    host, path = parts(F.col(f"`{url}`"))
    return judged.select(*[F.col(f"`{c}`") for c in pages.columns], host.alias("host"), path.alias("path"), F.col(f"{own}.rule").alias("rule"), F.coalesce(f"{own}.verdict", F.lit(default)).alias("verdict"))


#: The rules that the query's contract fixes: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def default_rules(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(verdict, host, path)")
