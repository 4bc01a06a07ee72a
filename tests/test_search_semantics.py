"""What search, ingest and reports do with stored values, bounds and files."""

import json

from pyspark.sql import functions as F

from hirelake.operators import dedupe, filters, ingest, ranking, stats
from hirelake.streaming import jobs

POSTING = "external_id string, title string, company string, location string, country string, description string, source string, source_url string, scraped_at timestamp_ntz, posted_at timestamp_ntz, is_active boolean, salary_max double"


def postings(spark, *rows):
    given = [("title", "Engineer"), ("company", "Acme"), ("location", ""), ("country", None), ("description", ""), ("source", "lever"), ("source_url", "u"), ("scraped_at", "2024-05-01T00:00:00"), ("posted_at", None), ("is_active", True)]
    full = [dict(given) | r for r in rows]
    return spark.read.schema(POSTING).json(spark.sparkContext.parallelize([json.dumps(r) for r in full], 1))


def test_the_location_decides_and_the_stored_country_narrows(spark):
    df = postings(spark, {"external_id": "stale", "location": "San Francisco, CA", "country": "CA"}, {"external_id": "empty", "location": "Toronto, ON", "country": ""}, {"external_id": "null", "location": "Toronto, ON"}, {"external_id": "kept", "location": "Somewhere", "country": "CA"}, {"external_id": "other", "location": "Berlin, DE", "country": "DE"})
    found = lambda *c: {r.external_id for r in filters.SearchFilter(country=list(c)).apply(df, "2024-05-02 00:00:00").collect()}
    assert found("CA") == {"empty", "null", "kept"} and found("US") == set() and found("US", "CA") == {"stale", "empty", "null", "kept"}
    assert {r.external_id: r.country for r in filters.enriched(df).collect()} == {"stale": "US", "empty": "CA", "null": "CA", "kept": "CA", "other": "DE"}
    got = ingest.get_postings(df, df.filter("external_id = 'stale'").select("external_id").union(spark.createDataFrame([("none",)], "external_id string")), "2024-05-02 00:00:00").collect()
    assert [(r.external_id, r.country, r.quality is not None) for r in got] == [("stale", "US", True)]


def test_stream_takes_an_id_once(spark, tmp_path):
    landing, table = tmp_path / "in", str(tmp_path / "table")
    landing.mkdir()
    row = {"title": "Engineer", "company": "Acme", "location": "Berlin, DE", "source": "lever", "source_url": "u", "scraped_at": "2024-05-01T00:00:00"}
    for k, ids in enumerate((["a", "b", "a"], ["b", "c"], ["c", "a"])):
        (landing / f"{k}.json").write_text("\n".join(json.dumps(row | {"external_id": i, "title": f"Engineer {k}"}) for i in ids))
        jobs.stream_ingest(spark, str(landing), table, str(tmp_path / "cp"), POSTING).awaitTermination()
    got = sorted((r.external_id, r.title, r.country) for r in spark.read.parquet(table).collect())
    assert got == [("a", "Engineer 0", "DE"), ("b", "Engineer 0", "DE"), ("c", "Engineer 1", "DE")]


def test_bounds_are_included_and_only_active_events_count(spark):
    rows = [("u1", "login", "2024-01-09T00:00:00"), ("u1", "view", "2024-01-09T12:00:00"), ("u2", "view", "2024-01-09T13:00:00"), ("u3", "register", "2024-01-03T00:00:00"), (None, "login", "2024-01-09T14:00:00")]
    events = spark.createDataFrame(rows, "uid string, event string, t string").select("uid", "event", F.col("t").cast("timestamp_ntz").alias("ts"))
    assert tuple(stats.active_users(events, "2024-01-10 00:00:00").first()) == (1, 2, 2)
    assert {r.event: r.n for r in stats.event_counts(events, "2024-01-10 00:00:00").collect()} == {"login": 2, "view": 2, "register": 1}
    windows = jobs.sliding_active(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    assert max(r.users for r in windows) == 1
    counts = jobs.tumbling_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    assert sum(r.n for r in counts) == 5


def test_alerts_heed_every_filter(spark):
    p = spark.createDataFrame([("a", "Nurse", "US", "remote", "healthcare"), ("a", "Nurse", "US", "remote", "healthcare"), ("b", "Nurse", "US", "onsite", "tech")], "external_id string, title string, country string, remote_status string, industry string").withColumn("scraped_at", F.current_timestamp())
    s = spark.createDataFrame([("s1", "US", "remote", None, "nurse"), ("s2", None, None, "tech", None), ("s3", "DE", None, None, None)], "search_id string, country string, remote_status string, industry string, keyword string")
    assert sorted((r.search_id, r.external_id) for r in jobs.stream_alerts(p, s).collect()) == [("s1", "a"), ("s2", "b")]


def test_limits_of_a_posting(spark):
    df = postings(spark, {"external_id": "ok", "title": "x" * 512}, {"external_id": "t", "title": "x" * 513}, {"external_id": "c", "company": "x" * 257}, {"external_id": "u", "source_url": "x" * 2049}, {"external_id": "d", "description": "x" * 100_001}, {"external_id": "s", "source": "x" * 65}, {"external_id": "l", "location": None})
    valid, rejected = ingest.validate_postings(df.withColumn("salary_period", F.when(F.col("external_id") == "ok", "annual")))
    assert [r.external_id for r in valid.collect()] == ["ok"]
    assert {r.external_id: r.reasons for r in rejected.collect()} == {"t": ["title_long"], "c": ["company_long"], "u": ["source_url_long"], "d": ["description_long"], "s": ["source_long"], "l": ["location"]}


def test_contacts_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(" Ann ", "a@b", " hi ", "m", "", "1.2.3.4", "u" * 300, 1), ("Bot", "", "", "m", "http://x", "", "", 2)], "name string, email string, subject string, message string, website string, ip string, user_agent string, ts int")
    row = ingest.contact_sink(df).collect()
    assert len(row) == 1 and (row[0].name, row[0].subject, row[0].ip, len(row[0].user_agent)) == ("Ann", "hi", "1.2.3.4", 200)
    (tmp_path / "mine").mkdir()
    for stamp in ("2024-05-01", "2024-05-05", "2024-05-10"):
        ingest.snapshot_export({"t": df}, str(tmp_path), stamp, days=7)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["mine", "snapshot-2024-05-05", "snapshot-2024-05-10"]


def test_equal_vectors_are_one_neighbour(spark):
    rows = [{"external_id": f"lever:x:{i}", "location": "Berlin, DE", "description": "d" * i} for i in range(30)]
    near = F.array(F.lit(1.0), F.when(F.col("external_id").rlike("[0-4]$"), 0.0).when(F.col("external_id").rlike("[5-8]$"), 0.05).otherwise(5.0))
    df = postings(spark, *rows).withColumn("vector", near)
    pairs = dedupe.duplicate_pairs(df).collect()
    want = {}
    for b in sorted({p.b for p in pairs}):
        want[b] = min(p.a for p in pairs if p.b == b)
    got = dedupe.dedupe_postings(df)
    assert got.count() == len(want) and len(pairs) > got.count()
    assert got.join(dedupe.mark_duplicates(df, got).filter("is_active"), "external_id", "left_semi").count() == 0


def test_quantised_search_of_vectors_of_any_length(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) * rng.uniform(0.1, 50)).tolist()) for i in range(400)]
    df, asked = spark.createDataFrame(rows, "external_id int, vector array<double>"), rng.normal(size=16).tolist()
    exact = [r.external_id for r in ranking.vector_topk(df, asked, 10).collect()]
    assert len(set(exact) & {r.external_id for r in ranking.quantised_topk(df, asked, 10).collect()}) >= 9
    assert ranking.candidates(25, filters.SearchFilter()) == 100 and ranking.candidates(25, filters.SearchFilter(country=["US"])) == 200 and ranking.candidates(80, filters.SearchFilter(location="x")) == 300


def test_a_day_of_any_size_is_browsed_in_turns(spark):
    import datetime as d
    import random

    rng, start = random.Random(4), d.datetime(2024, 5, 1)
    days = [0] * 8 + [1, 2, None]
    rows = [(f"p{i:04}", rng.choice(["Hot"] * 6 + ["B", "C", "", None, *[f"x{k}" for k in range(20)]]), None if (k := rng.choice(days)) is None else start + d.timedelta(days=k, minutes=rng.randrange(90))) for i in range(900)]
    df = spark.createDataFrame(rows, "external_id string, company string, at timestamp_ntz")
    for ascending in (False, True):
        sign, by_day = (1 if ascending else -1), {}
        for i, company, at in rows:
            by_day.setdefault(None if at is None else at.date(), []).append((0 if at is None else sign * at.timestamp(), i, company or "__unknown__"))
        want = []
        for day in sorted(by_day, key=lambda x: (x is None, 0 if x is None else sign * x.toordinal())):
            seen, first, turns = {}, {}, []
            for pos, (_, i, company) in enumerate(sorted(by_day[day])):
                first.setdefault(company, pos)
                seen[company] = seen.get(company, -1) + 1
                turns.append((seen[company], first[company], i))
            want += [i for _, _, i in sorted(turns)]
        got = ranking.interleaved(df, F.col("at"), ascending)
        assert [r.external_id for r in got.orderBy("place").collect()] == want and got.columns == [*df.columns, "place"]
        assert sorted(r.place for r in got.collect()) == list(range(1, 901))
    one_day = df.filter("cast(at as date) = '2024-05-01'")
    ordered = ranking._numbered(one_day.select("external_id", "company"), ["company", "external_id"], "test")
    sizes = [r["count"] for r in ordered.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)  # as many tasks as the session has partitions
    assert ranking.interleaved(df.limit(0), F.col("at")).count() == 0


def test_a_feed_is_cut_in_its_tasks(spark):
    urls = spark.range(500).select(F.concat(F.lit("f"), F.col("id") % 3).alias("feed"), F.concat(F.lit("u"), "id").alias("url"), (F.col("id") * 7 % 500).alias("seq"))
    feeds = spark.createDataFrame([("f0", 4), ("f1", 9), ("f9", 5)], "label string, max_pages int")
    out = ingest.cap_pages(urls, feeds)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    want = [(f, u) for f, n in (("f0", 4), ("f1", 9)) for _, u in sorted((i * 7 % 500, f"u{i}") for i in range(500) if f"f{i % 3}" == f)[:n]]
    assert sorted((r.feed, r.url) for r in out.collect()) == sorted(want)
    assert ingest.cap_pages(urls, feeds.limit(0)).count() == 0
