"""Allow and block rules for urls, applied by a sorted sweep over reversed hosts. DataFrame functions only.

A rule is (host, path, verdict). It fits its host and every subdomain if the url's path starts with its path; of the
rules that fit, the one with the longest host and path wins (ties: the smaller rule string, then the smaller verdict).

Reversing a host's labels ("com.example.www.") turns "this host and all its subdomains" into one interval of keys, and
such intervals nest. Rule starts, rule ends and the urls' distinct hosts are sorted together; going through them in order,
the number of open intervals is a running sum and the rule open at each level is the last start of that level, so a stack
of active nested rules is one window over the sorted rows. The hosts of a top-level label are dealt over slices of about
`HOSTS` each, by their measured number, and each slice has all rule ends and starts of that label. Urls meet the stack of
their host in a join of two tables, which adaptive execution splits where one host has most urls.

Defined results: a null url, or one without "://", has an empty host and path and gets the default verdict, as does any
url that no rule fits; rules without a host are ignored; equal rules count once; repeated rows each get a row. The paths
of one rule host travel together in one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom.llm.common import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts in a slice, about.
HOSTS = 100_000
_LAST = "\U0010ffff"  # sorts after every continuation of a key


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def stacks(hosts: DataFrame, rules: DataFrame, spread: int = 1) -> DataFrame:
    """url_host, stack: for every row of hosts (url_host) the rule hosts that hold it, outermost first, with their paths.

    rules: host, path, verdict. spread: slices of a top-level label at least.
    """
    part_of = lambda key: F.substring_index(key, ".", 1)
    by_host = (
        rules.where(F.length("host") > 0)
        .select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host")
        .agg(F.array_sort(F.collect_set(F.struct("path", "verdict"))).alias("paths"))
        .withColumn("key", reversed_key(F.col("host")))
        .withColumn("part", part_of(F.col("key")))
    )
    levels = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0  # a host name has at most 127 labels
    given = hosts.withColumn("at", reversed_key(F.col("url_host"))).withColumn("part", part_of(F.col("at")))
    loads = given.groupBy("part").agg(F.greatest(F.lit(spread), F.ceil(F.count(F.lit(1)) / HOSTS)).cast("int").alias("slices"))
    marks = F.array(
        F.struct(F.col("key").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step")),
        F.struct(F.concat("key", F.lit(_LAST)).alias("at"), F.lit(2).alias("kind"), F.lit(-1).alias("step")),
    )
    events = by_host.join(loads, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.struct("host", "paths").alias("rule"), marks.alias("marks"))
    events = events.select("part", "slice", F.inline("marks"), "rule", F.lit(None).cast("string").alias("url_host"))
    points = given.join(loads, "part").select(
        "part", F.pmod(F.xxhash64("url_host"), F.col("slices")).cast("int").alias("slice"), "at", F.lit(1).alias("kind"), F.lit(0).alias("step"), F.lit(None).cast(events.schema["rule"].dataType).alias("rule"), "url_host",
    )
    sweep = W.partitionBy("part", "slice").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    both = events.unionByName(points).withColumn("depth", F.sum("step").over(sweep))
    opened = lambda level: F.last(F.when((F.col("kind") == 0) & (F.col("depth") == level), F.col("rule")), ignorenulls=True).over(sweep)
    both = both.withColumns({f"open{i}": opened(i) for i in range(1, levels + 1)}).where("kind = 1")
    none = F.lit(None).cast(events.schema["rule"].dataType)
    held = F.array_compact(F.array(none, *[F.when(F.col("depth") >= i, F.col(f"open{i}")) for i in range(1, levels + 1)]))
    return both.select("url_host", held.alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", spread: int = 1) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url). rules: host, path, verdict."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("url_host"), path_of(F.col("url")).alias("url_path"))
    of_host = cut(stacks(urls.select("url_host").distinct(), rules, spread))

    def as_rule(host: Column) -> Callable[[Column], Column]:
        return lambda p: F.struct((-F.length(F.concat(host, p["path"]))).alias("size"), F.concat(host, p["path"]).alias("rule"), p["verdict"].alias("verdict"))

    fits = F.flatten(F.transform("stack", lambda r: F.transform(F.filter(r["paths"], lambda p: F.col("url_path").startswith(p["path"])), as_rule(r["host"]))))
    best = urls.join(of_host, "url_host").withColumn("best", F.array_min(fits))
    return best.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
