"""Counts, histories, funnels and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.operators.filters import active_user_events

STATUSES = ["saved", "applied", "interviewing", "offer", "rejected", "withdrawn"]
GHOST_DAYS = 14


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def active_users(events: DataFrame, as_of: str, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Distinct active users in each window before ``as_of``, its bound included; events dated later count. A user's last event decides."""
    rows = active_user_events(events).groupBy("uid").agg(F.max("ts").alias("ts"))
    since = lambda d: F.col("ts") >= F.expr(f"timestamp_ntz '{as_of}' - interval {d} days")
    return rows.agg(*[F.count(F.when(since(d), 1)).alias(f"users_{d}d") for d in days])


def active_windows(events: DataFrame, hours: int = 24) -> DataFrame:
    """start, users: exact distinct active users in every window of ``hours`` hours that begins at a full hour and has some.

    An active hour of a user lies in the windows that begin up to ``hours`` - 1 hours before it; those that the user's hour before lies in as well are
    counted there. So a user adds one and takes one back for each active hour, whatever the windows' length, and what is summed up is a row an hour."""
    seen = active_user_events(events).select("uid", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour")).filter("hour is not null").distinct()
    first = F.greatest(F.col("hour") - (hours - 1), F.lag("hour").over(Window.partitionBy("uid").orderBy("hour")) + 1)
    changes = seen.withColumn("first", first).select(F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("n")), F.struct((F.col("hour") + 1).alias("at"), F.lit(-1).alias("n")))).alias("x"))
    hourly = changes.groupBy("x.at").agg(F.sum("x.n").alias("n"))
    order = Window.orderBy("at")  # one row for each hour
    told = hourly.select("at", F.lead("at").over(order).alias("end"), F.sum("n").over(order).alias("users")).filter("users > 0")
    return told.select(F.explode(F.sequence("at", F.col("end") - 1)).alias("hour"), "users").select(F.timestamp_seconds(F.col("hour") * 3600).alias("start"), "users")


def event_counts(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return events.filter(F.col("ts") >= F.expr(f"timestamp_ntz '{as_of}' - interval {days} days")).groupBy("event").agg(F.count("*").alias("n"))


def event_spikes(events: DataFrame, factor: float = 3.0, days: int = 7) -> DataFrame:
    """Daily counts of an event that exceed ``factor`` times the mean of its days before."""
    daily = events.groupBy("event", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("event").orderBy("day").rowsBetween(-days, -1)
    return daily.withColumn("mean", F.avg("n").over(before)).filter(F.col("n") > factor * F.col("mean"))


def cumulative_history(postings: DataFrame, as_of: str, countries: list[str], days: int = 90) -> DataFrame:
    """series, day, n: active postings scraped before the end of each of the last ``days`` days, in total and by country."""
    rows = postings.filter(F.coalesce("is_active", F.lit(True))).select(F.to_date("scraped_at").alias("day"), "country")
    return rolled_history(rows.groupBy("day", "country").agg(F.count("*").alias("n")), as_of, countries, days)


def rolled_history(deltas: DataFrame, as_of: str, countries: list[str], days: int = 90) -> DataFrame:
    """As :func:`cumulative_history`, from counts by day and country and what has been added to them or taken back since (day, country, n)."""
    spark, last = deltas.sparkSession, F.to_date(F.lit(as_of))
    first = F.date_sub(last, days - 1)
    daily = deltas.filter(F.col("day") <= last).groupBy(F.greatest("day", first).alias("day"), "country").agg(F.sum("n").alias("k"))
    series = daily.select(F.lit("total").alias("series"), "day", "k").unionByName(daily.filter(F.col("country").isin(*countries)).select(F.col("country").alias("series"), "day", "k"))
    spine = spark.createDataFrame([(s,) for s in ["total", *countries]], "series string").select("series", F.explode(F.sequence(first, last)).alias("day"))
    sums = spine.join(series.groupBy("series", "day").agg(F.sum("k").alias("k")), ["series", "day"], "left")
    running = Window.partitionBy("series").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("series", "day", F.coalesce(F.sum("k").over(running), F.lit(0)).alias("n"))


def application_funnel(apps: DataFrame) -> DataFrame:
    """Every status in its order with its count."""
    spark = apps.sparkSession
    dim = spark.createDataFrame(list(enumerate(STATUSES)), "place int, status string")
    return dim.join(apps.groupBy("status").agg(F.count("*").alias("k")), "status", "left").select("place", "status", F.coalesce("k", F.lit(0)).alias("n"))


def enrich_applications(apps: DataFrame, postings: DataFrame, as_of: str) -> DataFrame:
    """Applications with their posting, if it exists; ghosted where applied or interviewing and untouched for more than two weeks."""
    idle = F.col("last_touched_at") < F.expr(f"timestamp_ntz '{as_of}' - interval {GHOST_DAYS} days")
    out = apps.join(postings.select("external_id", "title", "company"), "external_id", "left")
    return out.withColumn("missing", F.col("title").isNull()).withColumn("ghosted", F.col("status").isin("applied", "interviewing") & idle)


def ordered_applications(apps: DataFrame) -> DataFrame:
    """Applications with ``place``: by status in its order, within a status the last touched first, then by id."""
    dim = F.create_map(*[F.lit(x) for i, s in enumerate(STATUSES) for x in (s, i)])
    within = Window.partitionBy("status").orderBy(F.col("last_touched_at").desc_nulls_last(), "app_id")
    return apps.withColumn("status_place", F.try_element_at(dim, F.col("status"))).withColumn("place", F.row_number().over(within))


def transition_tally(before: DataFrame, after: DataFrame, column: str, key: str = "external_id") -> DataFrame:
    """old, new, n of a backfilled column."""
    return transitions(before.select(key, F.col(column).alias("old")).join(after.select(key, F.col(column).alias("new")), key))


def transitions(both: DataFrame) -> DataFrame:
    """As :func:`transition_tally`, of rows that hold the value before (old) and after (new)."""
    return both.groupBy("old", "new").agg(F.count("*").alias("n"))


def backfill_totals(before: DataFrame, after: DataFrame, column: str, key: str = "external_id") -> DataFrame:
    """One row: updated, skipped (the value was right), unresolvable (no value before or after)."""
    return totals(before.select(key, F.col(column).alias("old")).join(after.select(key, F.col(column).alias("new")), key))


def totals(both: DataFrame) -> DataFrame:
    """As :func:`backfill_totals`, of rows that hold the value before (old) and after (new)."""
    both = both.select(*[F.nullif(F.col(x), F.lit("")).alias(x) for x in ("old", "new")])
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    changed = ~F.col("old").eqNullSafe(F.col("new"))
    return both.agg(n(changed).alias("updated"), n(~changed & F.col("new").isNotNull()).alias("skipped"), n(~changed & F.col("new").isNull()).alias("unresolvable"))


def user_count(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("total_users"))


#: Lines of a log that share a window; counts are carried from one such block to the next.
LOG_BLOCK = 100_000
#: Lines before a run's start in which the summary of the run before it is looked for.
SUMMARY_LINES = 10


def crawl_runs(log: DataFrame, as_of: str) -> DataFrame:
    """One row for each run of a crawl log (seq, ts, line): run (from 1), started, elapsed_minutes at ``as_of``, sources, concurrency, ok,
    skipped_or_done, embed_failures, latest_log_line, previous_run_summary. The last run is the current one.

    A run begins at a line of a starting crawler, which is not counted itself; what precedes the first is of none. Lines are numbered and runs told
    by blocks of ``seq`` with counts carried on, so no window holds the whole log."""
    c = F.col
    flags = log.select("seq", "ts", "line", c("line").contains("starting crawler").cast("long").alias("head"), c("line").contains("done - ingested=").cast("long").alias("summary")).withColumn("block", F.floor(c("seq") / LOG_BLOCK))
    within, before = Window.partitionBy("block").orderBy("seq"), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = flags.groupBy("block").agg(F.count("*").alias("_lines"), F.sum("head").alias("_heads"))
    sums = sums.select("block", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in ("_lines", "_heads")])  # one row for a block
    rows = flags.join(sums, "block").withColumn("n", c("_lines") + F.row_number().over(within)).withColumn("run", c("_heads") + F.sum("head").over(within))
    kind = F.when(c("head") == 1, "head").when(c("line").rlike(r"\[w\d+\] ok "), "ok").when(c("line").contains("context deadline exceeded"), "late").when(c("line").rlike(r"(^|[^A-Za-z0-9_])jobs$"), "jobs")
    rows = rows.withColumn("kind", kind)
    n = lambda k: F.count(F.when(c("kind") == k, 1)).alias(k)
    runs = rows.filter("run > 0").groupBy("run").agg(
        F.min(F.when(c("kind") == "head", F.struct("n", "ts", "line"))).alias("start"), n("ok"), n("jobs"), n("late"), F.max_by("line", "n").alias("latest_log_line"),
    )
    # The lines before a start are those of the run before it.
    near = rows.filter("summary = 1").select((c("run") + 1).alias("run"), c("n").alias("at"), "line")
    last = near.groupBy("run").agg(F.max(F.struct("at", "line")).alias("last"))
    listed = F.filter(F.split(F.regexp_extract("start.line", r"sources=\[([^\]]+)\]", 1), r"\s+"), lambda x: x != "")
    minutes = F.floor((F.lit(as_of).cast("timestamp_ntz").cast("timestamp").cast("double") - c("start.ts").cast("double")) / 60 + 0.5)
    return runs.join(last, "run", "left").select(
        "run", c("start.ts").alias("started"), F.coalesce(minutes, F.lit(0)).cast("long").alias("elapsed_minutes"), listed.alias("sources"), F.regexp_extract("start.line", r"concurrency=(\d+)", 1).try_cast("long").alias("concurrency"),
        "ok", c("jobs").alias("skipped_or_done"), c("late").alias("embed_failures"), "latest_log_line", F.when(c("last.at") >= c("start.n") - SUMMARY_LINES, c("last.line")).alias("previous_run_summary"),
    )


def derive_url_patterns(urls: DataFrame) -> DataFrame:
    """site, pattern: the longest common prefix of a site's URLs, cut after its last slash and quoted. The common prefix of a set is that of its least and greatest member."""
    ends = urls.groupBy("site").agg(F.min("url").alias("a"), F.max("url").alias("b"), F.count("*").alias("n"))
    least = F.least(F.length("a"), F.length("b"))
    fits = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda k: F.col("a").substr(F.lit(1), k) == F.col("b").substr(F.lit(1), k))
    common = F.col("a").substr(F.lit(1), F.coalesce(F.array_max(fits), F.lit(0)))
    cut = F.when(F.col("n") == 1, F.regexp_replace("a", "[^/]*$", "")).otherwise(F.regexp_replace(common, "[^/]*$", ""))
    quote = lambda c: F.regexp_replace(c, r"([.+*?()|\[\]{}^$\\])", r"\\$1")
    host = F.regexp_extract("a", "://([^/]+)", 1)
    return ends.select("site", F.when(cut.contains("://"), F.concat(F.lit("^"), quote(cut))).when(host != "", F.concat(F.lit("^https?://"), quote(host), F.lit("/"))).otherwise(F.lit("^https?://")).alias("pattern"))


def industry_centroids(df: DataFrame, label: str = "industry", column: str = "vector") -> DataFrame:
    parts = df.filter(F.col(label) != "other").select(label, F.posexplode(column).alias("i", "x"))
    means = parts.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centroid"))  # one value for each dimension


def history_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """day, country, n: what changes in the counts of active postings when the rows ``before`` (of the changed ids alone) become ``after``.

    A posting counts on its scraped day for its country while it is active; changes that cancel out leave no row."""
    live = lambda d, sign: d.filter(F.coalesce("is_active", F.lit(True))).select(F.to_date("scraped_at").alias("day"), "country", F.lit(sign).alias("n"))
    both = live(before, -1).unionByName(live(after, 1))
    return both.groupBy("day", "country").agg(F.sum("n").alias("n")).filter("n <> 0")
