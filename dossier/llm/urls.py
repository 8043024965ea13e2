"""URL filters as a sort-merge range join of addresses and nested host rules.

A host's labels are reversed ("www.example.com" becomes "com.example.www."), so a rule's host and all its subdomains are
one interval of keys: those with the rule's key as prefix. Addresses and rules are range-partitioned by key; each task
sorts its rows and sweeps once, keeping a stack of the rules whose intervals are open. Intervals of hosts are nested or
apart, so a rule leaves the stack for good once a key lies beyond it. The rules of one host are found by their paths. Of the open rules whose path begins the address's
path, the longest (host and path together) decides.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import partitions, table

#: Boundaries are taken from so many sampled keys for each partition; that bounds what reaches the driver.
SAMPLED = 64

FIT = "row_key string, rule string, action string"


def host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _sweep(batches):
    stack, bucket = [], None
    for rows in batches:
        out = []
        for pid, key, kind, host, path, action, row_key in zip(rows["pid"], rows["key"], rows["kind"], rows["host"], rows["path"], rows["action"], rows["row_key"]):
            if pid != bucket:
                bucket, stack = pid, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, held, lengths = stack[-1]
                held[path] = host + path, action
                if len(path) not in lengths:
                    bisect.insort(lengths, len(path))
                continue
            best = None
            for _, held, lengths in stack:  # of a host's rules the longest path that fits: one look-up for each length
                for n in reversed(lengths):
                    if n <= len(path) and path[:n] in held:
                        found = held[path[:n]]
                        best = found if best is None or len(found[0]) >= len(best[0]) else best
                        break
            if best:
                out.append((row_key, *best))
        yield pd.DataFrame(out, columns=["row_key", "rule", "action"])


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(url, host, path, rule, verdict) for each distinct url; rule is null and the verdict `default` where none fits.

    urls: url. rules: host, path, action; of rules alike in host and path the action first by code point holds. Rules
    with a null host, path or action are ignored. A null url, or one without "://", has an empty host and path, which
    no rule fits. Equal urls are judged once. Rules may be as many as urls: nothing of them is broadcast but the
    partitions' boundaries, and each partition gets the rules that are open where it begins (ancestors of its first
    key, found by a join on the key's prefixes).
    """
    spark = urls.sparkSession
    n = partitions(spark)
    pages = urls.select("url").distinct().withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    found = pages.where("host <> ''").withColumn("key", host_key(F.col("host")))
    rules = rules.dropna(subset=["host", "path", "action"]).groupBy("host", "path").agg(F.min("action").alias("action"))
    rules = rules.withColumn("key", host_key(F.lower("host")))
    place = F.concat("key", F.lit("\0"), "path", F.lit("\0"), F.coalesce("url", F.lit("")))
    total = urls.count()
    sample = urls.select("url").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).where("host <> ''").withColumn("key", host_key(F.col("host")))
    some = sorted(r[0] for r in sample.sample(min(1.0, SAMPLED * n / max(total, 1)), seed=7).select(place).collect())
    bounds = sorted({some[len(some) * k // n] for k in range(1, n)}) if some else []

    @F.pandas_udf("int")
    def part_of(places: pd.Series) -> pd.Series:
        return places.map(lambda x: bisect.bisect_right(bounds, x))

    opening = spark.createDataFrame([(k + 1, b.split("\0")[0]) for k, b in enumerate(bounds)], "pid int, first string")
    prefixes = F.expr("transform(sequence(1, size(split(first, '[.]')) - 1), i -> concat(array_join(slice(split(first, '[.]'), 1, i), '.'), '.'))")
    carried = opening.select("pid", F.explode(prefixes).alias("key")).join(rules, "key")
    # A rule whose interval begins at the boundary's own key may sort before or after it: it is sent to both sides.
    starts = rules.withColumn("pid", part_of(F.concat("key", F.lit("\0"))))
    sent = starts.select("pid", "key", "host", "path", "action").union(carried.select("pid", "key", "host", "path", "action")).distinct()
    events = sent.select("pid", "key", F.lit(0).alias("kind"), "host", "path", "action", F.lit(None).cast("string").alias("row_key")).union(
        found.select(part_of(place).alias("pid"), "key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string"), "url")
    )
    dealt = events.repartition(n, "pid").sortWithinPartitions("pid", "key", "kind", "path")
    fits = dealt.mapInPandas(_sweep, FIT)
    judged = pages.join(fits.select(F.col("row_key").alias("url"), "rule", "action"), "url", "left")
    return judged.select("url", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


#: The rules of the registered query (fixed values): host, path, action.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    judged = judge(pages, rules)
    out = pages.alias("p").join(judged.alias("j"), F.col("p.url").eqNullSafe(F.col("j.url")), "left")
    return out.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r(h, q, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT p.*, h || q AS rule, action, row_number() OVER (PARTITION BY page_id, url ORDER BY length(h || q) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE k = 1
"""
