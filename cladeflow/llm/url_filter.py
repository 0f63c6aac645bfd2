"""URL filters as a sort-merge range join of canonical keys and rule prefixes.

A canonical key is a host's labels in reverse (``com.example.``) and a path. A rule fits its host and all subdomains,
so a URL has one key for each suffix of its host at a label; on these keys every rule is a prefix, that is an interval.
Intervals of prefixes are disjoint or nested. URLs and rules are sorted together by key, and a sweep carries the stack
of rules that may be active: the last rule that began and those it is nested in. What is still a prefix of the URL's
key is active; the longest of these over the URL's keys wins.

Scale: DataFrame operations only. URLs are reduced to distinct ones first; a URL has as many keys as the longest rule
has labels at most, and keys whose host has no rule go before the sort. The sweep is dealt out by host suffix; a suffix with more than its share of the keys is split over several
parts, each of which gets that suffix's rules. The rules' table may be of any size; nothing is broadcast by a hint.

Very long URLs, paths and hosts of very many labels are judged like others. Null URLs and those without ``://`` have
empty hosts and paths, fit no rule and get the default verdict. Repeated rows are judged alike. Rules that are null or have no host are ignored. Between rules of one length the smaller string wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spark_util import spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The production rules.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, verdict string")


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(labels: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("."))


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """For each rule: host key, path, and the stack of the rules it is nested in, itself on top (longest first)."""
    cut = F.instr("rule", "/")
    host = F.translate(F.when(cut > 0, F.substring("rule", F.lit(1), cut - 1)).otherwise(F.col("rule")), UPPER, LOWER)
    own = rules.filter("rule is not null").select(
        reversed_host(F.split(host, r"\.")).alias("host_key"),
        F.when(cut > 0, F.substring("rule", cut, F.length("rule"))).otherwise("").alias("path"),
        F.col("rule"),
        F.col("verdict"),
    ).filter("host_key <> '.'").groupBy("host_key", "path").agg(F.min(F.struct("rule", "verdict")).alias("r"))
    prefixes = own.select("host_key", F.col("path").alias("of"), F.explode(F.expr("transform(sequence(0, length(path)), n -> substring(path, 1, n))")).alias("path"))
    entry = F.struct(F.length("path").alias("n"), F.col("path").alias("path"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    return prefixes.join(own, ["host_key", "path"]).groupBy("host_key", "of").agg(F.reverse(F.array_sort(F.collect_list(entry))).alias("stack")).withColumnRenamed("of", "path")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule and verdict of the winning rule, for the distinct ``url`` that some rule fits."""
    stacks = _rule_stacks(rules)
    # A suffix with more labels than any rule's host can't be one, so hosts of any length have few keys.
    longest = stacks.agg(F.max(F.length("host_key") - F.length(F.replace("host_key", F.lit("."), F.lit("")))).cast("int").alias("longest"))
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.col("longest"))), lambda n: reversed_host(F.slice(labels, F.size(labels) + 1 - n, n)))
    hosts = urls.select("url").filter(F.instr("url", "://") > 0).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = hosts.crossJoin(F.broadcast(longest)).select("url", "path", F.explode(suffixes).alias("host_key"))  # longest: one row
    # A suffix gets as many parts of the sweep as its share of the keys is worth.
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = keys.groupBy("host_key").count().join(stacks.select("host_key").distinct(), "host_key", "left_semi")
    total = counts.agg(F.sum("count").alias("total"))
    splits = counts.crossJoin(F.broadcast(total)).select("host_key", F.ceil(F.col("count") * 2 * parts / F.col("total")).cast("int").alias("splits"))  # total: one row
    spread = spread_join(keys, splits, "host_key").withColumn("part", F.pmod(F.xxhash64("url"), F.col("splits")).cast("int"))
    replicas = stacks.join(splits, "host_key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    events = spread.select("host_key", "part", "path", "url", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack")).unionByName(
        replicas.select("host_key", "part", "path", F.lit(None).cast("string").alias("url"), "stack")
    )
    sweep = Window.partitionBy("host_key", "part").orderBy("path", F.col("url").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("url is not null")
    active = F.get(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])), 0)
    best = swept.withColumn("best", active).filter("best is not null").groupBy("url").agg(F.min(F.struct((-F.length("best.rule")).alias("n"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))).alias("best"))
    return best.select("url", "best.rule", "best.verdict")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per page: page_id, host, path, rule (null where none fits) and verdict."""
    own = pages.select("page_id", "url")
    found = matched(own, rules).select(F.col("url").alias("judged_url"), "rule", F.col("verdict").alias("ruled"))
    joined = own.join(found, F.col("url") == F.col("judged_url"), "left")
    return joined.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"))
