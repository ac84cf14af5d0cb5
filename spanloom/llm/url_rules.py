"""URL filters as a sort-merge range join, in DataFrame operations only.

A rule ``host/path`` fits its host, all subdomains, and every path that starts with its path.
Written with its labels reversed, a host is followed by all its subdomains, so the hosts that a
rule's host covers are one interval of canonical keys, and so are the paths that its path covers.
Two sweeps find the rules. In the first, URLs and rules' hosts are sorted together by reversed host;
the sweep keeps the stack of nested rule hosts that were open at the last one's start. A URL's rule
hosts are those of the stack that are still open: prefixes of its own. In the second, each URL under
each of its rule hosts is sorted by path with that host's rules, and the stack holds nested paths.
The longest rule of all wins.

A sweep is dealt by ranges of the sorted keys, so a host or rule of any size is so many ranges:
each range is swept by itself and starts with the stack that the ranges before hand on. Stacks are
made on the rules' side alone.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no
rule; A-Z in hosts are lowered; repeated rows each get their verdict; a rule given twice with
both verdicts blocks; rules with a null or empty host fit nothing, a null rule path is empty;
of fitting rules of equal length the one with the longer host wins; without rules, or where
none fits, the verdict is the default; empty tables give empty tables; other columns of the
rows are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.llm.common import checkpoint

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty where there is no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, UPPER.lower())
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each with a full stop behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def _prefixes(value: Column, end: str) -> Column:
    """All prefixes of a text that end in ``end``, or all of them if that is empty."""
    lengths = F.sequence(F.lit(0), F.length(value))
    cut = F.transform(lengths, lambda n: F.substring(value, F.lit(1), n))
    return F.filter(cut, lambda p: F.endswith(p, F.lit(end)) & (p != "")) if end else cut


def _clean(rules: DataFrame) -> DataFrame:
    """rev, path, rule, reach, verdict: each rule once."""
    return (
        rules.where("host is not null and host <> ''")
        .select(F.translate("host", UPPER, UPPER.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.col("verdict") == "block").alias("blocks"), "verdict"))["verdict"].alias("verdict"))
        .select(reversed_host(F.col("host")).alias("rev"), "path", F.concat("host", "path").alias("rule"), F.length("path").alias("reach"), "verdict")
    )


def _host_stacks(clean: DataFrame) -> DataFrame:
    """rev, stack: for each rule host the rule hosts that are open at its start, outermost first."""
    hosts = clean.select("rev").distinct()
    below = hosts.select("rev", F.explode(_prefixes(F.col("rev"), ".")).alias("outer"))
    met = below.join(hosts.select(F.col("rev").alias("outer")), "outer")
    return met.groupBy("rev").agg(F.array_sort(F.collect_list("outer")).alias("stack"))  # a prefix sorts first


def _path_stacks(clean: DataFrame) -> DataFrame:
    """rev, path, stack: for each rule's start the rules of its host that are open there, outermost first."""
    rule = F.struct("reach", "part", "rule", "verdict", "rev")
    below = clean.select("rev", "path", F.explode(_prefixes(F.col("path"), "")).alias("part"))
    met = below.join(clean.withColumnRenamed("path", "part"), ["rev", "part"])
    return met.groupBy("rev", "path").agg(F.array_sort(F.collect_list(rule)).alias("stack"))


def _swept(urls: DataFrame, starts: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """The URLs with the stack of the last start at or before each, in the order of ``keys``.

    URLs of equal keys are told apart by ``ties``, so that ranges cut through them as well.
    """
    both = urls.withColumn("is_url", F.lit(1)).unionByName(starts.withColumn("is_url", F.lit(0)), allowMissingColumns=True)
    order = [*keys, "is_url", *ties]
    # ranges are numbered once and for all: the sweep and what is handed on must see the same ones
    dealt = checkpoint(both.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    ends = dealt.where("is_url = 0").groupBy("range").agg(F.max_by("stack", F.struct(*keys)).alias("end"))
    ranges = dealt.select("range").distinct().join(ends, "range", "left")  # one row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    handed = ranges.select("range", F.last("end", ignorenulls=True).over(before).alias("handed"))
    sweep = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("here", F.last("stack", ignorenulls=True).over(sweep)).where("is_url = 1")
    return swept.join(F.broadcast(handed), "range").withColumn("stack", F.coalesce("here", "handed")).drop("range", "here", "handed", "is_url")


def judge_urls(rows: DataFrame, url: str, rules: DataFrame, keep: list[str], default: str = "allow") -> DataFrame:
    """``keep`` columns with host, path, rule and verdict of each row's URL."""
    host, path = host_and_path(F.col(url))
    split = rows.select(*keep, host.alias("_host"), path.alias("_path"))
    clean = checkpoint(_clean(rules))
    urls = split.where("_host <> ''").select("_host", F.col("_path").alias("path")).distinct()
    hosts = _swept(urls.withColumn("rev", reversed_host(F.col("_host"))), _host_stacks(clean), ["rev"], ["path"])
    open_ = F.explode(F.filter("stack", lambda r: F.startswith(F.col("rev"), r)))
    under = hosts.select("_host", "path", open_.alias("outer")).select("_host", "path", F.col("outer").alias("rev"))
    paths = _swept(under, _path_stacks(clean), ["rev", "path"], ["_host"])
    # the last start may be another host's, or its path may have ended
    inner = F.try_element_at(F.filter("stack", lambda r: (r["rev"] == F.col("rev")) & F.startswith(F.col("path"), r["part"])), F.lit(-1))
    found = (
        paths.withColumn("r", inner).where("r is not null")
        .groupBy("_host", F.col("path").alias("_path"))
        .agg(F.max(F.struct(F.length("r.rule"), (F.length("r.rule") - F.col("r.reach")).alias("host_length"), "r.rule", "r.verdict")).alias("best"))
    )
    judged = split.join(found, ["_host", "_path"], "left")
    return judged.select(
        *keep, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
