"""An index over predicates: every saved search is filed under one key that its matches must have, and meets only postings with that key.

Keys are the equality filters (``country=US``) and, for a keyword, its runs of three characters, since a keyword may lie within a word. A search is
filed under the key that the fewest postings have; whatever else it asks is checked on what meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.operators.tables import kept

#: Filters by equality, characters of a run, and the key of searches that ask nothing.
EQUALITIES, RUN, ANY = ("country", "remote_status", "industry"), 3, "*"


def _runs(text: Column, n: int) -> Column:
    """Different runs of ``n`` characters, none for shorter texts."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.concat(F.lit(f"{n}:"), F.substring(text, i, F.lit(n)))))).otherwise(F.array().cast("array<string>"))


def _equalities() -> list[Column]:
    return [F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}="), F.col(name))) for name in EQUALITIES]


def posting_keys(title: Column, short: list[int]) -> Column:
    """All keys of a posting with a lower-case ``title``; ``short``: lengths of keywords under three characters that are asked for."""
    runs = [_runs(F.coalesce(title, F.lit("")), n) for n in (*short, RUN)]
    return F.concat(F.array_compact(F.array(*_equalities())), *runs, F.array(F.lit(ANY)))


def search_keys(keyword: Column) -> Column:
    """Keys under which a search can be filed; ``keyword`` in lower case, null or empty asks nothing."""
    asked = F.coalesce(keyword, F.lit(""))
    short = [F.when(F.length(asked) == n, F.array(F.concat(F.lit(f"{n}:"), asked))) for n in range(1, RUN)]
    keys = F.concat(F.array_compact(F.array(*_equalities())), *[F.coalesce(x, F.array().cast("array<string>")) for x in short], _runs(asked, RUN))
    return F.when(F.size(keys) > 0, keys).otherwise(F.array(F.lit(ANY)))


def short_lengths(searches: DataFrame) -> list[int]:
    """Lengths under three of the keywords asked for, at most two."""
    length = F.length("keyword")
    return sorted(r[0] for r in searches.filter((length > 0) & (length < RUN)).select(length).distinct().collect())


def filed(searches: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """key, search_id, s_country, s_remote_status, s_industry, s_keyword: each search once, under the rarest of its keys by ``counts`` (key, n; a key
    without a count is the rarest). Without counts, as in a stream, under its longest key. Ties by key."""
    asked = searches.withColumn("_word", F.lower("keyword"))
    rows = asked.select("search_id", *[F.col(c).alias(f"s_{c}") for c in EQUALITIES], F.col("_word").alias("s_keyword"), search_keys(F.col("_word")).alias("keys"))
    rows = rows.withColumn("key", F.explode("keys")).drop("keys")
    if counts is None:
        rows = rows.withColumn("_n", -F.length("key"))
    else:
        rows = rows.join(counts.select("key", F.col("n").alias("_n")), "key", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    best = F.row_number().over(Window.partitionBy("search_id").orderBy("_n", "key"))
    return rows.withColumn("_r", best).filter("_r = 1").drop("_r", "_n")


def fits(title: Column) -> Column:
    """What a search asks besides its key, over the columns of :func:`filed` and a posting."""
    same = [F.col(f"s_{c}").isNull() | (F.col(f"s_{c}") == F.col(c)) for c in EQUALITIES]
    return same[0] & same[1] & same[2] & (F.coalesce("s_keyword", F.lit("")).eqNullSafe("") | title.contains(F.col("s_keyword")))


def newest_matches(live: DataFrame, searches: DataFrame, k: int) -> DataFrame:
    """search_id, external_id, rank: the ``k`` newest of ``live`` that each search matches, ties by id.

    Postings that agree in all that searches look at are matched once, by the ``k`` newest of them, so a frequent key brings no more rows than it has
    different titles. A search that asks nothing meets the ``k`` of those groups with the newest postings."""
    c, order = F.col, [F.col("stamp").desc(), F.col("external_id")]
    rows = live.select("external_id", *EQUALITIES, F.lower("title").alias("_title"), F.coalesce("posted_at", "scraped_at").alias("stamp"))
    rows = rows.withColumn("combo", F.to_json(F.struct(*EQUALITIES, "_title"), {"ignoreNullFields": "false"}))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("combo").orderBy(*order))).filter(c("_r") <= k)
    rows = kept(rows, "alike")  # at most k rows of each group, read three times
    combos = rows.filter("_r = 1").select("combo", *EQUALITIES, "_title", "stamp", "external_id")
    newest = combos.orderBy(*order).limit(k).select("combo", F.lit(True).alias("_new"))  # k rows
    keys = posting_keys(c("_title"), short_lengths(searches))
    keyed = combos.join(newest, "combo", "left").withColumn("key", F.explode(F.when(c("_new"), keys).otherwise(F.array_remove(keys, ANY)))).select("combo", *EQUALITIES, "_title", "key")
    index = filed(searches, keyed.groupBy("key").agg(F.count("*").alias("n")))
    met = index.join(keyed, "key").filter(fits(c("_title"))).select("search_id", "combo")
    found = met.join(rows.select("combo", "external_id", "stamp"), "combo")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("search_id").orderBy(*order)))
    return ranked.filter(c("rank") <= k).select("search_id", "external_id", "rank")


def matches(postings: DataFrame, searches: DataFrame, carry: list[str]) -> DataFrame:
    """search_id, external_id and ``carry`` of every match; ``postings`` may be a stream, each row of which meets a search once."""
    rows = postings.withColumn("_title", F.lower("title"))
    rows = rows.select("external_id", *EQUALITIES, "_title", *carry, F.explode(posting_keys(F.col("_title"), short_lengths(searches))).alias("key"))
    return rows.join(filed(searches), "key").filter(fits(F.col("_title"))).select("search_id", "external_id", *carry)
