"""URL filters by a sort-merge range join, in DataFrame functions only.

A rule is a host and a path prefix; it fits the host, its subdomains and every path that begins with its path. Written as the
host's labels in reverse order, a border sign, then the path, a rule is a prefix of every key it fits, so it is an
interval in sorted order, and intervals of rules are nested or disjoint. A url has one key for each level of its host.

Rules and url keys are merged into one sorted sequence, dealt out by range. In the sweep each rule brings the
stack of rules active from its start on (itself and those around it); a url takes the stack last brought, drops what has ended
(what is no prefix of its key), and the innermost rule is left. What the stack is at the start of a range comes from the last rule
of the ranges before it.

Hot hosts and urls: equal (id, host, path) rows are counted before the sweep, ranges are cut by key and id, so that
a hot key spreads over as many ranges as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.llm.shared import staged

#: Neither hosts nor paths can hold it.
BORDER = "#"
RULE_COLUMNS = "host string, path string, verdict string"


def url_host(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url):
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed_host(host):
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """key, stack (the rule's own and all enclosing rules, innermost last) for each distinct rule.

    Rules with the same host and path count once; ``block`` wins over ``allow``. Rules with a null host are dropped.
    """
    keyed = (
        rules.filter("host is not null")
        .select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("key", F.concat(_reversed_host(F.col("host")), F.lit(BORDER), F.col("path")))
        .withColumn("rule", F.struct(F.length("key").alias("size"), "key", F.concat("host", "path").alias("name"), "verdict"))
    )
    # A subdomain is a url key of its own level, so only rules of the same host can enclose each other here.
    prefixes = keyed.select(
        F.col("key").alias("of"),
        F.explode(F.transform(F.sequence(F.length("key") - F.length("path"), F.length("key")), lambda n: F.col("key").substr(F.lit(1), n))).alias("key"),
    )
    return prefixes.join(keyed.select("key", "rule"), "key").groupBy(F.col("of").alias("key")).agg(F.sort_array(F.collect_list("rule")).alias("stack"))


def judge_urls(df: DataFrame, rules: DataFrame, id_col: str, url_col: str, default: str = "allow", partitions: int | None = None) -> DataFrame:
    """One row per input row: id, host, path, rule (as host and path, null if none fits), verdict.

    Of the rules that fit, the longest (host and path together) wins, on a tie the one with the longer host. A null url, or one
    without ``://``, has an empty host and path and gets ``default``. Ids may repeat or be null; repeated rows are judged
    once and come back as often as they came. Other columns are ignored. Without rules every row gets ``default``.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_col)
    urls = staged(df.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path")).groupBy("id", "host", "path").count(), "urls")
    labels = F.split("host", r"\.")
    levels = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.concat(F.array_join(F.reverse(F.slice(labels, -k, k)), "."), F.lit(BORDER), F.col("path")),
    )
    stacks = rule_stacks(rules)
    none = F.lit(None)
    events = stacks.select("key", F.lit(0).alias("is_url"), none.cast("string").alias("host"), none.cast("string").alias("path"), none.cast(urls.schema["id"].dataType).alias("id"), "stack").unionByName(
        urls.select(F.explode(levels).alias("key"), F.lit(1).alias("is_url"), "host", "path", "id", none.cast(stacks.schema["stack"].dataType).alias("stack"))
    )
    order = ["key", "is_url", "id"]
    dealt = staged(events.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges")
    # One row for each range: the stack its last rule leaves, carried over ranges without rules.
    last = dealt.groupBy("range").agg(F.max_by("stack", F.when(F.col("is_url") == 0, F.col("key"))).alias("left"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("range", F.last("left", ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter("is_url = 1")
    fits = F.filter(F.coalesce("active", "carried"), lambda r: F.col("key").startswith(r["key"]))
    best = (
        swept.join(F.broadcast(carried), "range")  # one row per range
        .select("id", "host", "path", F.element_at(F.when(F.size(fits) > 0, fits), -1).alias("rule"))
        .groupBy("id", "host", "path")
        .agg(F.max(F.struct(F.col("rule.size").alias("size"), F.length(F.col("rule.key")).alias("k"), F.col("rule.name").alias("rule"), F.col("rule.verdict").alias("verdict"))).alias("best"))
    )
    same = F.col("u.id").eqNullSafe(F.col("b.id")) & (F.col("u.host") == F.col("b.host")) & (F.col("u.path") == F.col("b.path"))
    return (
        urls.alias("u").join(best.alias("b"), same)
        .select(
            F.col("u.id").alias(id_col), F.col("u.host").alias("host"), F.col("u.path").alias("path"),
            F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("u.count"))).alias("_copy"),
        )
        .drop("_copy")
    )


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_COLUMNS)
