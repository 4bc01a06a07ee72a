"""Duplicate postings across sources: blocked similarity, greedy leaders, canonical choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.functions import location, text
from hirelake.functions.pay import lookup
from hirelake.operators import filters, near, nearest, ranking
from hirelake.operators.tables import kept

# How canonical a source is; the lowest number wins.
PRIORITY = {
    "greenhouse": 1, "lever": 1, "ashby": 1, "workday": 1, "smartrecruiters": 1, "recruitee": 1, "workable": 1, "bamboohr": 1, "breezy": 1, "pinpoint": 1,
    "personio": 1, "teamtailor": 1, "hackernews": 2, "workatastartup": 2, "usajobs": 2, "themuse": 3, "adzuna": 3, "jooble": 3, "reed": 3, "careerjet": 3,
    "remoteok": 4, "weworkremotely": 4,
}
THRESHOLD = 0.98
BUCKET = ["_company", "_title", "_country", "_remote"]


def bucketed(postings: DataFrame) -> DataFrame:
    """Active postings with the key within which duplicates are looked for; empty company or title is left out. Country and remote status
    are those stored, where there are such columns."""
    c = F.col
    country = c("country") if "country" in postings.columns else location.classify_country(c("location"))
    remote = c("remote_status") if "remote_status" in postings.columns else location.classify_remote(c("location"), c("description"))
    live = postings.filter(F.coalesce(c("is_active"), F.lit(True)))
    names = kept(live.select("company", "title").distinct(), "names")
    live = filters.per_distinct(live, ["company"], {"_company": text.normalize_company(c("company"))}, names)
    return (
        filters.per_distinct(live, ["title"], {"_title": text.normalize_title(c("title"))}, names)
        .withColumn("point_id", text.point_id(c("external_id")))
        .filter("_company <> '' and _title <> ''")
        .withColumn("_country", F.coalesce(country, F.lit(""))).withColumn("_remote", remote)
    )


def duplicate_pairs(postings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a < b (point ids), cosine: all pairs of one bucket with cosine at or above ``threshold``, those of copies as well. Their number is the square of
    a bucket of copies; :func:`duplicate_links` tells the same of each posting in one row. Cosines are told once for each two different vectors."""
    rows, alike = _classes(postings)
    links = near.near_pairs(alike.select(_key().alias("bucket"), F.col("class").alias("id"), "vector"), threshold)
    own = alike.filter((F.col("many") > 1) & near.sound("vector") & _key().isNotNull()).select(F.col("class").alias("a"), F.col("class").alias("b"), ranking.cosine(F.col("vector"), F.col("vector")).alias("cosine"))
    return near.member_pairs(rows.select("class", F.col("point_id").alias("id")), alike, links.unionByName(own.filter(F.col("cosine") >= threshold)))


def duplicate_classes(postings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, copy: the duplicates of one bucket without the pairs of copies. For each posting with the vector of an earlier one of its bucket a row with
    the least such posting (copy), and a row for each pair a < b of least postings whose different vectors reach ``threshold``. Two postings with a
    direction are duplicates if and only if they are of one class or their classes' least postings are such a pair."""
    rows, alike = _classes(postings)
    pairs = near.near_pairs(alike.select(_key().alias("bucket"), F.col("first").alias("id"), "vector"), threshold)
    copies = rows.join(alike.select("class", "first"), "class").filter("point_id <> first")
    return pairs.select("a", "b", F.lit(False).alias("copy")).unionByName(copies.select(F.col("first").alias("a"), F.col("point_id").alias("b"), F.lit(True).alias("copy")))


def duplicate_links(postings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """point_id, class_id, links of every posting with a vector: the least posting of its bucket with an equal vector, and how many others of its
    bucket are duplicates of it. A vector without direction (null or NaN in it, all 0) is in a class but has no links."""
    rows, alike = _classes(postings)
    counts = near.near_counts(alike.select(_key().alias("bucket"), F.col("first").alias("id"), "vector", "many"), threshold)
    own = F.when(near.sound("vector") & _key().isNotNull(), F.col("many") - 1).otherwise(0)
    told = alike.join(counts, alike["first"] == counts["id"], "left").select("class", F.col("first").alias("class_id"), (own + F.coalesce("n", F.lit(0))).alias("links"))
    return rows.join(told, "class").select("point_id", "class_id", "links")


def _key():
    """The bucket's columns in one, null where one of them is."""
    return F.to_json(F.when(F.expr(" and ".join(f"{k} is not null" for k in BUCKET)), F.array(*BUCKET)))


def _classes(postings: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Active postings that have a vector (class, point_id and ``keep``), and their classes of equal bucket and vector: class, BUCKET, first (the least
    id), many, vector. Of the vectors only those of the first postings are written or moved."""
    told = bucketed(postings).filter("vector is not null")
    part = lambda k: F.coalesce(F.concat(F.length(k), F.lit(":"), F.col(k)), F.lit("-"))  # noqa: E731  # lengths keep parts apart, and null from any text
    name = F.md5(F.concat(nearest.class_of(told, "vector"), *[part(k) for k in BUCKET])).alias("class")
    rows = kept(told.select(name, "point_id", *keep), "classed")
    groups = kept(rows.groupBy("class").agg(F.min("point_id").alias("first"), F.count("*").alias("many")), "groups")
    heads = told.select(name, F.col("point_id").alias("first"), *BUCKET, "vector").join(groups, ["class", "first"]).dropDuplicates(["class"])
    return rows, kept(heads.withColumn("vector", F.transform("vector", lambda x: x.cast("double") + 0.0)), "alike")


def greedy_leaders(pairs: DataFrame) -> DataFrame:
    """member, leader. In order of id, a point leads unless an earlier leader is its neighbour; others join their earliest leader.

    Rounds over edges alone: points without an undecided or leading earlier neighbour become leaders, their neighbours members.
    """
    edges = kept(pairs.select("a", "b"), "pairs")
    leaders, open_edges = None, edges
    while True:
        later = open_edges.select(F.col("b").alias("id")).distinct()
        fresh = open_edges.select(F.col("a").alias("id")).distinct().join(later, "id", "left_anti")
        fresh = kept(fresh, "leaders")
        if fresh.isEmpty():
            break
        leaders = fresh if leaders is None else leaders.unionByName(fresh)
        members = edges.join(fresh, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct()
        decided = kept(fresh.unionByName(members), "decided")
        # Edges that begin or end at a decided point leave; a point left alone leads only if it has later neighbours of its own.
        open_edges = kept(open_edges.join(decided, F.col("a") == F.col("id"), "left_anti").join(decided, F.col("b") == F.col("id"), "left_anti"), "open")
    if leaders is None:
        return edges.limit(0).select(F.col("b").alias("member"), F.col("a").alias("leader"))
    found = edges.join(leaders, F.col("a") == F.col("id"), "left_semi").join(leaders, F.col("b") == F.col("id"), "left_anti")
    return found.groupBy(F.col("b").alias("member")).agg(F.min("a").alias("leader"))


def dedupe_postings(postings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """external_id, canonical_id of every duplicate. In a cluster the most canonical source wins, then disclosed pay and length, then id.

    Postings of a bucket with equal vectors have the same neighbours, so the least stands for all of them while leaders are looked for. To see what
    would be marked, read the result (or ``dedupe_report``) and do not pass it on to ``mark_duplicates``.
    """
    hint = F.when(F.col("salary_max") > 0, 1.0).otherwise(0.0) + F.least(F.lit(2.0), F.coalesce(F.length("description"), F.lit(0)) / 1500.0)
    ranks = postings.withColumns({"_prio": F.coalesce(lookup(PRIORITY, F.col("source")), F.lit(99)), "_hint": hint})
    rows, alike = _classes(ranks, ("external_id", "_prio", "_hint"))
    led = greedy_leaders(near.near_pairs(alike.select(_key().alias("bucket"), F.col("first").alias("id"), "vector"), threshold))
    single = alike.filter((F.col("many") > 1) & near.sound("vector") & _key().isNotNull()).select(F.col("first").alias("member")).join(led, "member", "left_anti").withColumn("leader", F.col("member"))
    firsts = led.unionByName(led.select(F.col("leader").alias("member"), "leader")).unionByName(single).distinct()
    clusters = alike.join(firsts, F.col("first") == F.col("member")).select("class", "leader")
    order = Window.partitionBy("leader").orderBy("_prio", F.col("_hint").desc(), "point_id")
    ranked = rows.join(clusters, "class").select("external_id", "point_id", "leader", "_prio", "_hint").withColumn("canonical_id", F.first("external_id").over(order)).withColumn("n", F.row_number().over(order))
    return ranked.filter("n > 1").select("external_id", "canonical_id")


def mark_duplicates(postings: DataFrame, duplicates: DataFrame) -> DataFrame:
    out = postings.drop("canonical_id").join(duplicates, "external_id", "left")
    return out.withColumn("is_active", F.when(F.col("canonical_id").isNotNull(), False).otherwise(F.col("is_active")))


def dedupe_report(postings: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: total, active, buckets, candidate_buckets, duplicates, kept."""
    totals = postings.agg(F.count("*").alias("total"), F.sum(F.coalesce("is_active", F.lit(True)).cast("long")).alias("active"))
    sizes = bucketed(postings).groupBy("_company", "_title", "_country", "_remote").count()
    buckets = sizes.agg(F.count("*").alias("buckets"), F.sum((F.col("count") > 1).cast("long")).alias("candidate_buckets"))
    gone = duplicates.agg(F.count("*").alias("duplicates"))
    return totals.crossJoin(buckets).crossJoin(gone).withColumn("kept", F.col("active") - F.col("duplicates"))  # one row each


def sources_of(postings: DataFrame, ids: DataFrame, most: int = 50) -> DataFrame:
    """canonical_id, external_id, source, source_url of the duplicates of each id, by id, at most ``most`` each (a top-k)."""
    rows = postings.filter("canonical_id is not null and coalesce(source_url, '') <> ''").join(ids.select(F.col("external_id").alias("canonical_id")), "canonical_id", "left_semi")
    order = Window.partitionBy("canonical_id").orderBy("external_id")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).select("canonical_id", "external_id", "source", "source_url")


def verified_across(postings: DataFrame) -> DataFrame:
    return postings.filter("canonical_id is not null").groupBy("canonical_id").agg((F.count("*") + 1).alias("verified_across"))
