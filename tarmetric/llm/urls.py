"""URL filters: a sort-merge range join of hosts under reversed-host keys, then of paths inside the rule hosts.

A host is keyed by its labels from the last to the first, each closed by a point (``com.example.``), so that a host
and all its subdomains are one interval that begins at the host's own key. Hosts and rule hosts are sorted together
in ranges; the rule host that precedes a host, with its stack of enclosing rule hosts, holds all whose intervals are
open there: the sweep carries that stack on, over the ends of ranges too, and the entries that are prefixes of the
key fit. Paths are swept in the same way inside a rule host, with the stack of its nested paths. Of the fitting
rules of a url the longest wins.

Equal (host, path) are judged once. Ranges hold about ``run_rows`` distinct keys, and a busy rule host is dealt over
several sorted runs, each with a copy of its paths, so no sweep grows with the table. The stack open at the start of
each range is found by one pass over one row a range.

Cases: a null url, or one without ``://``, has empty host and path; no fitting rule gives a null rule and the
default verdict; repeated rows are kept; among rules of equal length the one with the longer host wins; an
empty rule or url table works; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tarmetric.llm.common import ascii_lower, literal_rows, table
from tarmetric.session import materialize

# Host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"
RUN_ROWS = 2_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """``com.example.`` for ``example.com``: the key of a host begins with the keys of all hosts above it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def key_heads(key: Column) -> Column:
    """``c.``, ``c.b.``, ``c.b.a.`` for ``c.b.a.``."""
    labels = F.split(key, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))


def nested_hosts(rules: DataFrame) -> DataFrame:
    """Rule hosts by key with ``open``: all rule hosts that enclose the host, outermost first, itself last."""
    own = rules.select("host").distinct().select(reversed_host(F.col("host")).alias("key"), "host")
    heads = own.select("key", F.explode(key_heads(F.col("key"))).alias("head"))
    entry = F.struct(F.length("head").alias("n"), F.col("head").alias("key"), F.col("outer").alias("host"))
    joined = heads.join(own.select(F.col("key").alias("head"), F.col("host").alias("outer")), "head")
    return joined.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("open"))


def open_hosts(hosts: DataFrame, rules: DataFrame, run_rows: int) -> DataFrame:
    """host, rule_host: the rule hosts whose intervals hold each distinct host."""
    nested = nested_hosts(rules)
    none = F.lit(None).cast(nested.schema["open"].dataType)
    # a rule host stands before the host equal to it
    events = nested.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "open").union(
        hosts.select(reversed_host(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", none.alias("open"))
    )
    events = materialize(events, "url-hosts")
    ranges = max(1, -(-events.count() // run_rows))
    # the ranges are written, so that a repeated task cannot cut them anew
    ranged = materialize(events.repartitionByRange(ranges, "key", "kind").withColumn("range", F.spark_partition_id()), "url-host-ranges")
    last = ranged.groupBy("range").agg(F.max_by("open", F.when(F.col("kind") == 0, F.col("key"))).alias("last"))  # one row a range
    carried = last.select("range", F.last("last", ignorenulls=True).over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    sweep = W.partitionBy("range").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    swept = ranged.withColumn("active", F.last("open", ignorenulls=True).over(sweep)).where("kind = 1")
    swept = swept.join(carried, "range").withColumn("active", F.coalesce("active", "carried"))
    return swept.select("host", F.explode(F.filter("active", lambda r: F.col("key").startswith(r["key"]))).alias("r")).select("host", F.col("r.host").alias("rule_host"))


def nested_rules(rules: DataFrame) -> DataFrame:
    """Rules by host and path with ``stack``: all rules of that host that enclose the rule, outermost first, itself last."""
    own = rules.select("host", "path", "verdict").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    heads = own.select("host", "path", "verdict", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substr("path", F.lit(1), n))).alias("head"))
    outer = own.select("host", F.col("path").alias("head"), F.col("verdict").alias("head_verdict"))
    entry = F.struct(F.length("head").alias("n"), F.col("head").alias("path"), F.col("head_verdict").alias("verdict"))
    return heads.join(outer, ["host", "head"]).groupBy("host", "path").agg(F.array_sort(F.collect_list(entry)).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, run_rows: int = RUN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    nested = nested_rules(rules)
    hosted = rows.where("host <> ''")
    urls = materialize(hosted.select("host", "path").distinct(), "url-keys")
    opened = open_hosts(urls.select("host").distinct(), rules, run_rows)
    keys = urls.join(opened, "host").select("rule_host", "host", "path")
    runs = keys.groupBy("rule_host").agg(F.ceil(F.count("*") / run_rows).cast("int").alias("runs"))
    dealt = keys.join(runs, "rule_host").select("rule_host", F.pmod(F.xxhash64("host", "path"), F.col("runs")).cast("int").alias("run"), "host", "path")
    copies = nested.withColumnRenamed("host", "rule_host").join(runs, "rule_host").select("rule_host", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.col("path").alias("key"), "stack")
    # one sorted sequence of rules and keys a lane; a rule comes before the keys equal to it. A lane is one column, so
    # that a partitioning by rule_host alone does not serve and busy hosts are spread
    lane = F.concat_ws("#", "run", "rule_host")
    stack_type = nested.schema["stack"].dataType
    events = copies.select(lane.alias("lane"), "rule_host", "key", F.lit(0).alias("kind"), "stack", F.lit(None).cast("string").alias("host")).union(
        dealt.select(lane.alias("lane"), "rule_host", F.col("path").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(stack_type).alias("stack"), "host")
    )
    # the host is the same inside a run, so paths alone are sorted
    sweep = W.partitionBy("lane").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    active = F.last("stack", ignorenulls=True).over(sweep)
    swept = events.select("rule_host", "host", "kind", F.col("key").alias("path"), active.alias("active")).where("kind = 1")
    fits = F.filter("active", lambda r: F.col("path").startswith(r["path"]))
    inner = F.get(fits, F.size(fits) - 1)
    best = swept.select("host", "path", "rule_host", inner.alias("r")).where("r is not null")
    rank = F.struct((F.length("rule_host") + F.col("r.n")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "r.path").alias("rule"), F.col("r.verdict").alias("verdict"))
    verdicts = best.groupBy("host", "path").agg(F.max(rank).alias("best"))
    # rows without a host fit no rule and would all meet in one task
    judged = hosted.join(verdicts, ["host", "path"], "left").unionByName(rows.where("host = ''"), allowMissingColumns=True)
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), literal_rows(spark, RULES, "host string,path string,verdict string"))


ORACLE = f"""
with rule(rule_host, rule_path, verdict) as (values {", ".join(str(r) for r in RULES)}),
page as (select row_number() over () as r, page_id, coalesce(url, '') as url from pages),
part as (select r, page_id, case when position('://' in url) = 0 then '' else substr(url, position('://' in url) + 3) end as rest from page),
split as (select r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from part),
fit as (select s.r, rule_host || rule_path as rule, verdict, length(rule_host || rule_path) as n, length(rule_host) as h from split s join rule
  on (s.host = rule_host or ends_with(s.host, '.' || rule_host)) and starts_with(s.path, rule_path)),
best as (select r, rule, verdict, row_number() over (partition by r order by n desc, h desc) as k from fit)
select page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') as verdict from split left join (select * from best where k = 1) using (r)"""
