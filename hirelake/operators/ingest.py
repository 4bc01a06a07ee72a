"""Validation, upsert, partial updates, backfills, exports and matching over postings."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.functions import location, rules, text
from hirelake.functions.pay import lookup
from hirelake.functions import pay
from hirelake.operators import filters, saved_searches, text_index
from hirelake.operators.filters import enriched, live_country
from hirelake.operators.tables import kept

# Enumerations and limits of the posting schema.
REMOTE = ["remote", "hybrid", "onsite", "unknown"]
LEVELS = ["intern", "junior", "mid", "senior", "staff", "principal", "manager", "director", "executive"]
LENGTHS = {"title": 512, "company": 256, "location": 512, "salary_range": 128, "source": 64, "source_url": 2048, "description": 100_000}
PERIODS = ["hourly", "daily", "weekly", "monthly", "annual"]
INDUSTRIES = ["tech", "healthcare", "retail", "food_service", "trades", "government", "education", "finance", "manufacturing", "logistics", "legal", "nonprofit", "media", "science", "other"]
UNITS = {"annual": "YEAR", "monthly": "MONTH", "weekly": "WEEK", "daily": "DAY", "hourly": "HOUR"}
SOURCE_NAMES = {
    "greenhouse": "Greenhouse", "lever": "Lever", "ashby": "Ashby", "workday": "Workday", "smartrecruiters": "SmartRecruiters", "recruitee": "Recruitee", "workable": "Workable", "bamboohr": "BambooHR",
    "breezy": "Breezy", "pinpoint": "Pinpoint", "personio": "Personio", "teamtailor": "Teamtailor", "hackernews": "HN Hiring", "workatastartup": "Y Combinator", "themuse": "The Muse", "adzuna": "Adzuna",
    "jooble": "Jooble", "reed": "Reed", "careerjet": "Careerjet", "remoteok": "RemoteOK", "weworkremotely": "We Work Remotely", "usajobs": "USAJobs",
}
#: What applying at a source takes: steps, minutes, whether an account is needed.
HANDOFF = {
    "greenhouse": ("single-page", "3-5", "no"), "ashby": ("single-page", "5-8", "no"), "lever": ("single-page", "5-8", "maybe"), "smartrecruiters": ("multi-step portal", "10-15", "yes"),
    "recruitee": ("per-company hosted", "5-10", "maybe"), "workable": ("multi-step portal", "8-12", "yes"),
}
ACCOUNT = {"no": "No account required", "maybe": "Account may be required", "yes": "Account required"}


def validation_reasons() -> Column:
    c = F.col
    checks = [
        (F.length(F.trim(F.coalesce(c("external_id"), F.lit("")))) == 0, "external_id"), (F.length(F.coalesce(c("title"), F.lit(""))) == 0, "title"),
        *[(F.length(c(name)) > most, f"{name}_long") for name, most in LENGTHS.items()], (F.length(F.coalesce(c("company"), F.lit(""))) == 0, "company"), (c("salary_min") < 0, "salary_min"), (c("salary_max") < 0, "salary_max"),
        (~c("salary_currency").rlike("^[A-Z]{3}$"), "salary_currency"), (~c("country").rlike("^[A-Z]{2}$"), "country"), (~c("remote_status").isin(*REMOTE), "remote_status"),
        (~c("experience_level").isin(*LEVELS), "experience_level"), (~c("salary_period").isin(*PERIODS), "salary_period"), (~c("industry").isin(*INDUSTRIES), "industry"), (c("location").isNull(), "location"), (c("source_url").isNull(), "source_url"), (c("scraped_at").isNull(), "scraped_at"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in checks]))


def validate_postings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reasons)."""
    for name in ("country", "remote_status", "experience_level", "salary_range", "salary_period", "salary_currency", "industry", "source", "description"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    for name in ("salary_min", "salary_max"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    if "source_url" not in df.columns:
        df = df.withColumn("source_url", F.lit(""))
    told = df.withColumn("reasons", validation_reasons())
    return told.filter(F.size("reasons") == 0).drop("reasons"), told.filter(F.size("reasons") > 0)


def posted_or_scraped(df: DataFrame) -> DataFrame:
    return df.withColumn("posted_at", F.coalesce("posted_at", "scraped_at"))


def upsert_postings(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows by id, the latest scrape winning; fresh rows are enriched before, given values stay."""
    both = current.unionByName(posted_or_scraped(enriched(incoming)), allowMissingColumns=True)
    newest = F.row_number().over(Window.partitionBy("external_id").orderBy(F.col("scraped_at").desc_nulls_last(), *[F.col(c) for c in ("title", "source")]))
    return both.withColumn("_n", newest).filter("_n = 1").drop("_n")


def skip_existing(new: DataFrame, existing: DataFrame, key: str = "external_id") -> DataFrame:
    return new.join(existing.select(key), key, "left_anti")


def skip_seen(urls: DataFrame, seen: DataFrame) -> DataFrame:
    return urls.join(seen.select("feed", "url"), ["feed", "url"], "left_anti")


def partial_update(table: DataFrame, updates: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Columns of ``updates`` replace those of equal key where they are not null. ``updates`` has one row for each key."""
    up = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in cols])
    out = table.join(up, table[key] == up["_key"], "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else table[c] for c in table.columns])


def backfill(postings: DataFrame, column: str, fresh: Column, force: bool = False) -> DataFrame:
    """``postings`` with ``column`` recomputed where it is empty (or everywhere); an unresolved value keeps the old one."""
    old = F.nullif(F.col(column), F.lit("")) if column in postings.columns else F.lit(None).cast("string")
    return postings.withColumn(column, F.coalesce(fresh, old) if force else F.coalesce(old, fresh))


def backfill_country(postings: DataFrame) -> DataFrame:
    """For a dry run, hold the result against ``postings`` with ``stats.transition_tally`` and ``stats.backfill_totals`` and write nothing."""
    told = filters.per_distinct(postings, ["location"], {"_told": location.classify_country(F.col("location"))})
    return told.withColumn("country", F.coalesce("_told", F.nullif(F.col("country"), F.lit("")))).drop("_told")


def backfill_industry(postings: DataFrame, force: bool = False) -> DataFrame:
    """Industry and job family where the industry is missing (or everywhere); postings without a title stay as they are, and a family that
    the rules do not tell stays too. The different texts are stored at once, so postings of few texts stay where they are, in their order."""
    titled, c = F.length(F.trim(F.coalesce("title", F.lit("")))) > 0, F.col
    for name in ("industry", "job_family"):
        if name not in postings.columns:
            postings = postings.withColumn(name, F.lit(None).cast("string"))
    due = titled & (F.lit(force) | (F.coalesce("industry", F.lit("")) == ""))
    texts = kept(postings.select("title", "description").distinct(), "texts")
    told = filters.per_distinct(postings, ["title", "description"], {"_industry": rules.classify_industry(c("title"), c("description")), "_family": rules.classify_job_family(c("title"), c("description"))}, texts, store=False)
    fresh = {"industry": F.when(due, c("_industry")).otherwise(c("industry")), "job_family": F.when(due, F.coalesce("_family", "job_family")).otherwise(c("job_family"))}
    return told.withColumns(fresh).drop("_industry", "_family")


def backfill_level(postings: DataFrame) -> DataFrame:
    return backfill(postings, "experience_level", rules.classify_title_or_body(F.col("title"), F.col("description"), F.col("industry")), force=True)


def contact_sink(df: DataFrame) -> DataFrame:
    """Contact messages without those that fill the hidden field; trimmed (empty: null), user agent cut at 200. Absent columns are null."""
    for name in ("subject", "ip", "user_agent"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    kept = df.filter(F.coalesce(F.trim("website"), F.lit("")) == "")
    return kept.select("ip", *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("name", "email", "subject", "message")], F.substring("user_agent", 1, 200).alias("user_agent"), "ts")


def to_jobposting_jsonld(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """external_id, jsonld and the columns in ``keep``: the posting as schema.org JSON; pay only where range and currency are known."""
    c = F.col
    stamp = F.coalesce("posted_at", "scraped_at")
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    typed = lambda kind, *cs: F.struct(F.lit(kind).alias("@type"), *cs)
    value = typed("QuantitativeValue", c("salary_min").alias("minValue"), c("salary_max").alias("maxValue"), F.coalesce(lookup(UNITS, c("salary_period")), F.lit("YEAR")).alias("unitText"))
    pay = F.when(c("salary_min").isNotNull() & c("salary_max").isNotNull() & c("salary_currency").isNotNull(), typed("MonetaryAmount", c("salary_currency").alias("currency"), value.alias("value")))
    address = typed("PostalAddress", F.coalesce(c("location"), F.lit("")).alias("addressLocality"), F.coalesce(c("country"), F.lit("")).alias("addressCountry"))
    doc = F.struct(
        F.lit("https://schema.org/").alias("@context"), F.lit("JobPosting").alias("@type"), c("title"), F.coalesce("description", "title").alias("description"),
        iso(stamp).alias("datePosted"), iso(stamp + F.expr("interval 30 days")).alias("validThrough"), F.lit("FULL_TIME").alias("employmentType"),
        typed("Organization", c("company").alias("name")).alias("hiringOrganization"), typed("Place", address.alias("address")).alias("jobLocation"), F.lit(False).alias("directApply"), pay.alias("baseSalary"),
    )
    return df.select("external_id", F.to_json(doc).alias("jsonld"), *keep)


def with_source_info(df: DataFrame) -> DataFrame:
    """``df`` with source_name: the display name, else the source with a capital first letter; ``Unknown`` where there is none."""
    source = F.coalesce("source", F.lit(""))
    shown = F.coalesce(lookup(SOURCE_NAMES, source), F.concat(F.upper(F.substring(source, 1, 1)), F.expr("substring(source, 2)")))
    return df.withColumn("source_name", F.when(source == "", "Unknown").otherwise(shown))


def with_apply_handoff(df: DataFrame) -> DataFrame:
    """``df`` with apply_steps, apply_minutes and apply_account of its source; null where nothing is known of it."""
    part = lambda i: lookup({k: v[i] for k, v in HANDOFF.items()}, F.coalesce("source", F.lit("")))
    return df.withColumns({"apply_steps": part(0), "apply_minutes": part(1), "apply_account": lookup(ACCOUNT, F.coalesce(part(2), F.lit("")))})


def write_feeds(df: DataFrame, path: str) -> None:
    """One ordered text file, a line for each feed; the list of feeds is configuration, not data."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("label", "url", "pattern", "company", "country", "max_pages")])
    df.orderBy("label", "url").coalesce(1).select(line.alias("value")).write.mode("overwrite").text(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def snapshot_export(tables: dict[str, DataFrame], folder: str, stamp: str, days: int = 7) -> None:
    """Write all tables under ``folder/snapshot-stamp`` (stamp: yyyy-MM-dd) and drop snapshots over ``days`` days older than it. Folders of other names stay."""
    spark = SparkSession.active()
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/snapshot-{stamp}/{name}")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    oldest = date.fromisoformat(stamp) - timedelta(days=days)
    for name in [s.getPath().getName() for s in fs.listStatus(root)]:
        told = re.fullmatch(r"snapshot-(\d{4}-\d{2}-\d{2})", name)
        if told and date.fromisoformat(told.group(1)) < oldest:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)


def parse_feed_config(df: DataFrame, column: str = "text") -> DataFrame:
    """label, url, pattern, company, country, max_pages from ``label|url|pattern|company|country|max`` joined by ``;``; bad rows are dropped."""
    rows = df.select(F.explode(F.split(column, ";")).alias("row")).select(F.split(F.trim("row"), r"\|").alias("p"))
    part = lambda i: F.nullif(F.trim(F.try_element_at("p", F.lit(i))), F.lit(""))
    return rows.select(
        part(1).alias("label"), part(2).alias("url"), part(3).alias("pattern"), part(4).alias("company"), F.upper(part(5)).alias("country"), F.coalesce(part(6).try_cast("int"), F.lit(1000)).alias("max_pages")
    ).filter("label is not null and url rlike '^https?://'")


def filter_feed_urls(urls: DataFrame, feeds: DataFrame) -> DataFrame:
    """URLs that match their feed's pattern (none: all)."""
    return urls.join(feeds.select(F.col("label").alias("feed"), "pattern"), "feed").filter(F.expr("pattern is null or url rlike pattern")).drop("pattern")


def cap_pages(urls: DataFrame, feeds: DataFrame) -> DataFrame:
    """The first ``max_pages`` URLs of each feed in the order of ``seq`` (1,000 where the feed states none). Before a feed's URLs meet, every task keeps
    as many of them as the largest of all limits."""
    limits = feeds.select(F.col("label").alias("feed"), F.when(F.col("max_pages") > 0, F.col("max_pages")).otherwise(1000).alias("_most"))
    largest = limits.agg(F.max("_most")).first()[0] or 0
    order = F.row_number().over(Window.partitionBy("feed").orderBy("seq", "url"))
    return urls.join(limits, "feed").withColumn("_n", order).filter((F.col("_n") <= largest) & (F.col("_n") <= F.col("_most"))).drop("_n", "_most")


#: Landed answers of a slug probe.
PROBE_HITS = "adapter string, slug string, company string, url string, jobs bigint"


def read_probe_hits(raw: DataFrame) -> DataFrame:
    """Probe hits from JSON lines (``value``); broken lines and those without adapter or slug are dropped."""
    return raw.select(F.from_json("value", PROBE_HITS).alias("h")).select("h.*").filter("adapter is not null and coalesce(slug, '') <> ''")


def get_postings(postings: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """The postings of ``ids`` (external_id), classified anew and with quality; an unknown id gives no row."""
    found = postings.join(ids.select("external_id").distinct(), "external_id", "left_semi")
    return pay.with_quality(enriched(found), as_of)


def novel_slugs(hits: DataFrame, known: DataFrame) -> DataFrame:
    key = lambda d: d.withColumn("slug", F.lower("slug"))
    return key(hits).select("adapter", "slug").distinct().join(key(known).select("adapter", "slug"), ["adapter", "slug"], "left_anti")


def read_seeds(df: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed lines without blanks and comments, the first of equal ones (ignoring case). Needs ``seq``, the line's place."""
    rows = df.select("seq", F.trim(column).alias("seed")).filter("seed <> '' and seed not like '#%'")
    return rows.groupBy(F.lower("seed").alias("key")).agg(F.min(F.struct("seq", "seed")).alias("f")).select("f.seed")


#: As ``limit`` of ``chunk_text``: no chunk is left out.
ALL_CHUNKS = (1 << 31) - 1


def chunk_text(df: DataFrame, id_col: str, column: str, low: int = 40, high: int = 280, limit: int = 25) -> DataFrame:
    """id, pos, chunk: sentences packed up to ``high`` characters; longer ones cut; packs under ``low`` dropped; the first ``limit``."""
    plain = F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", " "))
    pieces = F.filter(F.transform(F.split(plain, r"(?<=[.!?])\s+|\s*•\s+"), lambda p: F.trim(p)), lambda p: p != "")
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(s: Column, p: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1)), F.lit(high))
        cut = F.transform(starts, lambda i: F.trim(p.substr(i, F.lit(high))))
        flushed = F.when(s["buf"] != "", F.concat(s["out"], F.array(s["buf"]))).otherwise(s["out"])
        packed = F.when(F.length(s["buf"]) >= low, F.concat(s["out"], F.array(s["buf"]))).otherwise(s["out"])
        fits = F.length(s["buf"]) + F.length(p) + 1 <= high
        long = F.length(p) > high
        out = F.when(long, F.concat(flushed, cut)).when(fits, s["out"]).otherwise(packed)
        buf = F.when(long, F.lit("")).when(fits & (s["buf"] != ""), F.concat(s["buf"], F.lit(" "), p)).otherwise(p)
        return F.struct(out.alias("out"), buf.alias("buf"))

    last = lambda s: F.slice(F.when(F.length(s["buf"]) >= low, F.concat(s["out"], F.array(s["buf"]))).otherwise(s["out"]), 1, limit)
    return df.select(id_col, F.posexplode(F.aggregate(pieces, state, step, last)).alias("pos", "chunk"))


def extract_skills(df: DataFrame, id_col: str, column: str, industry: Column, lexicon: DataFrame) -> DataFrame:
    """id, name, category, place of each lexicon skill in the text, as whole words. The lexicon (industry, place, name, category, term) may be of any
    size: runs of as many words and marks as its terms have are joined with it by industry (tech where it has none) and spelling. Each different text
    of an industry is looked through once; rows meet its skills by the text's SHA-256. The lexicon and the skills are stored first, so a join knows their size."""
    terms = kept(lexicon.select("industry", "place", "name", "category", F.lower("term").alias("gram"), text_index.phrase_length(F.col("term")).alias("pieces")), "terms")
    shapes = terms.select("industry", "pieces").distinct().collect()  # a handful of industries by as many lengths as the longest term has pieces, at most
    banks, lengths = sorted({r[0] for r in shapes if r[0] is not None}), sorted({r[1] for r in shapes if r[1] is not None and r[1] > 0})
    bank = F.when(industry.isin(*banks), industry).otherwise("tech")
    rows = df.select(F.col(id_col), F.col(column).alias("_text"), bank.alias("industry")).filter("_text is not null")
    told = text_index.phrase_grams(rows.select("_text", "industry").distinct(), "_text", lengths).join(terms.drop("pieces"), ["industry", "gram"])
    told = kept(told.groupBy(F.sha2("_text", 256).alias("_key"), "industry", "name").agg(F.min("place").alias("place"), F.min("category").alias("category")), "skills")
    hits = rows.select(id_col, F.sha2("_text", 256).alias("_key"), "industry").join(told, ["_key", "industry"])
    return hits.groupBy(id_col, "name").agg(F.min("place").alias("place"), F.min("category").alias("category"))


def expand_queries(queries: DataFrame, banks: DataFrame) -> DataFrame:
    """query, embed_text, keywords: the best entry of the industry's bank, else the common one, else tech.

    ``banks``: bank, key, embed_text, keywords. An exact key wins, else the longest key held as words. Runs of words of a query, as long as the
    banks' keys, are joined with the keys; the longest that is found is kept.
    """
    norm = text.normalize_query(F.col("query"))
    asked = queries.withColumn("norm", norm).withColumn("bank_of", F.coalesce("industry", rules.classify_industry(F.col("query"), F.lit("")))).select("query", "norm", F.when(F.col("bank_of") == "food_service", "retail").otherwise(F.col("bank_of")).alias("bank_of"))
    words = F.split("norm", " ")
    lengths = sorted(r[0] for r in banks.select(F.size(F.split("key", " "))).distinct().collect())  # as many as the longest key has words, at most
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i.cast("int"), F.lit(n)), " "))
    runs = [F.when(F.size(words) >= n, run(n)).otherwise(F.array().cast("array<string>")) for n in lengths]
    rank = F.when(F.col("bank") == F.col("bank_of"), 0).when(F.col("bank") == "common", 1).when(F.col("bank") == "tech", 2)
    held = asked.withColumn("key", F.explode(F.array_distinct(F.concat(*runs)))) if runs else asked.withColumn("key", F.lit(None).cast("string")).limit(0)
    hits = held.join(banks, "key").withColumn("r", rank).filter("r is not null")
    best = Window.partitionBy("query").orderBy("r", (F.col("key") == F.col("norm")).desc(), F.length("key").desc(), "key")
    top = hits.withColumn("n", F.row_number().over(best)).filter("n = 1").select("query", "embed_text", "keywords")
    return queries.select("query").join(top, "query", "left")


def match_saved_searches(postings: DataFrame, searches: DataFrame, as_of: str, k: int = 60) -> DataFrame:
    """search_id, external_id, rank: each saved search's newest matches among active postings. Filters are columns of ``searches``; null filters nothing."""
    return saved_searches.newest_matches(postings.filter(F.coalesce("is_active", F.lit(True))), searches, k)


def new_since(matches: DataFrame, searches: DataFrame) -> DataFrame:
    """search_id, new_count: matches that the last snapshot did not hold."""
    told = matches.join(searches.select("search_id", "last_result_ids"), "search_id")
    return told.groupBy("search_id").agg(F.sum((~F.array_contains(F.coalesce("last_result_ids", F.array().cast("array<string>")), F.col("external_id"))).cast("long")).alias("new_count"))
