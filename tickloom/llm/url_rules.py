"""Allow and block rules for urls: a sorted sweep over reversed-host keys with a stack of nested rules.

A rule (host, path) fits its host and all subdomains whose path starts with the rule's path. The
canonical key is the host with its labels reversed, each ended by a dot, then the path, so every rule
is the interval of keys it prefixes. A url meets a rule host through one of its own key's label
prefixes; within that host key, rules and urls are swept in path order. Intervals of prefixes nest
or are disjoint, so what is active at a url is the stack of the last rule that started before it,
less the rules whose interval has ended. The rule with the longest host and path wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import lower_ascii, partitions


def split_url(url) -> tuple[F.Column, F.Column]:
    """(host, path): after the first ``://``; empty where the url is null or has none."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    return (lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _host_key(labels) -> F.Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("."))


def judge_urls(pages: DataFrame, rules: DataFrame, *, id: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``pages``.

    ``rules`` has host, path and action. A null or empty rule host, or a null path or action, makes a
    rule void; of rules with equal host and path ``block`` counts. Urls that no rule fits, null urls
    and urls without ``://`` get rule null and ``default``. Repeated rows and null ids are kept; an
    empty table gives an empty result. Equal (host, path) pairs are judged once. A host key with many
    urls is dealt over several salts, each with a copy of that host's rules.
    """
    host, path = split_url(F.col(url))
    parsed = pages.select(F.col(id), host.alias("host"), path.alias("path"))
    own = rules.select(lower_ascii(F.col("host")).alias("rhost"), F.col("path").alias("rpath"),
                       F.col("action").alias("action")) \
        .filter("rhost <> '' and rpath is not null and action is not null") \
        .groupBy("rhost", "rpath").agg(F.min(F.when(F.col("action") == "block", F.struct(F.lit(0), "action"))
                                             .otherwise(F.struct(F.lit(1), "action")))["action"].alias("action")) \
        .withColumn("key", _host_key(F.split("rhost", r"\.")))
    depth = own.agg(F.max(F.size(F.split("rhost", r"\.")))).first()[0] or 0

    # Stack at the start of each rule: the rules of its host whose path begins its path, itself included.
    inner = own.select("key", "rpath", F.explode(F.expr("sequence(0, length(rpath))")).alias("n")) \
        .select("key", "rpath", F.expr("substring(rpath, 1, n)").alias("prefix"))
    outer = own.select("key", F.col("rpath").alias("prefix"), "rhost", "action")
    stacks = inner.join(outer, ["key", "prefix"]).groupBy("key", "rpath").agg(F.sort_array(F.collect_list(
        F.struct(F.length("prefix").alias("n"), F.col("prefix").alias("path"), "rhost", "action"))).alias("stack"))

    # Label prefixes of the reversed host that are as short as some rule's host.
    labels = F.split("host", r"\.")
    pairs = parsed.filter("host <> ''").select("host", "path").distinct()
    keyed = pairs.select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(depth, 1)))),
        lambda n: _host_key(F.slice(labels, F.size(labels) - n + 1, n)))).alias("key")) \
        .join(own.select("key").distinct(), "key", "left_semi")
    shares = partitions(pages.sparkSession)
    counts = keyed.groupBy("key").agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    salts = counts.join(F.broadcast(total)).select(  # one row
        "key", F.ceil(F.col("rows") * shares / F.col("total")).cast("int").alias("salts"))

    starts = stacks.join(salts, "key").select(
        "key", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.col("rpath").alias("path"),
        F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack")
    urls = keyed.join(salts, "key").select(
        "key", F.expr("cast(pmod(xxhash64(host, path), salts) as int)").alias("salt"), "path",
        F.lit(1).alias("kind"), "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    sweep = Window.partitionBy("key", "salt").orderBy("path", "kind") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = starts.unionByName(urls).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)) \
        .filter("kind = 1").select("host", "path", F.try_element_at(F.filter(
            "active", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(-1)).alias("top")).filter("top is not null")
    best = swept.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("top.rhost") + F.col("top.n")).alias("n"), F.length("top.rhost").alias("h"),
        F.concat("top.rhost", "top.path").alias("rule"), F.col("top.action").alias("action"))).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select(
        F.col(id), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"))
