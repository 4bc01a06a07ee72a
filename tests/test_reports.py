import datetime as d

import pytest
from pyspark.sql import functions as F

from hirelake.functions import pay
from hirelake.operators import matching, stats
from hirelake.sources import feeds

c = F.col
RAW = "source string, tenant string, fetched_at timestamp, page int, body string"
T = d.datetime(2024, 5, 1)


def test_of_a_fetch_the_first_page_wins_and_a_later_fetch_replaces_it(spark):
    job = lambda title, url, i=5: f'{{"id":{i},"title":"{title}","companyName":"Acme","applyUrl":"{url}"}}'
    body = lambda *jobs: '{"props":{"jobs":[' + ",".join(jobs) + "]}}"
    rows = [("workatastartup", "", T, 2, body(job("Second", "a"))), ("workatastartup", "", T, 1, body(job("First", "z"), job("Later on its page", "b")))]
    assert [r.title for r in feeds.normalize(spark.createDataFrame(rows, RAW), "workatastartup").collect()] == ["First"]
    rows.append(("workatastartup", "", T + d.timedelta(days=1), 9, body(job("Newer", "y"))))
    found = feeds.normalize(spark.createDataFrame(rows, RAW), "workatastartup")
    assert [r.title for r in found.collect()] == ["Newer"] and found.columns == feeds.POSTING_COLUMNS
    assert [r.title for r in feeds.normalize(spark.createDataFrame(rows[:1], RAW).drop("page"), "workatastartup").collect()] == ["Second"]


@pytest.mark.parametrize(
    "low,high,shown",
    [
        (110_000, 140_500, "$110k – $140.5k USD"), (0, 90_000, "up to $90k USD"), (90_250, None, "from $90.2k USD"), (90_750, 0, "from $90.8k USD"), (900, 1_949, "$900 – $1.9k USD"), (1_950, 99_950, "$1.9k – $100.0k USD"),
        (None, None, None), (0, 0, None), (1_000_000, 1_234_567, "$1000k – $1234.6k USD"),
    ],
)
def test_stated_pay(spark, low, high, shown):
    df = spark.createDataFrame([(low, high)], "a long, b long")
    assert df.select(pay.format_salary_range(c("a"), c("b"), F.lit("USD")).alias("s")).first().s == shown


def test_tenths_are_those_of_the_nearest_double(spark):
    got = {r.n: r.s for r in spark.range(1_000, 130_000, 50).select(c("id").alias("n"), pay._thousands(c("id")).alias("s")).collect()}
    assert got == {n: f"${n // 1000}k" if n % 1000 == 0 else f"${n / 1000:.1f}k" for n in range(1_000, 130_000, 50)}


def test_a_feed_that_states_one_end(spark):
    body = '[{"id":"1","position":"A","salary_min":50000},{"id":"2","position":"B","salary_max":60500,"salary_min":0},{"id":"3","position":"C","description":"Pay $120k - $150k"},{"id":"4","position":"D","salary_min":0,"salary_max":0}]'
    body = body.replace('"position"', '"legal":"","position"')
    out = feeds.normalize(spark.createDataFrame([("remoteok", "", T, 1, body)], RAW), "remoteok")
    got = {r.title: (r.salary_min, r.salary_max, r.salary_range) for r in out.collect()}
    assert got == {"A": (50000.0, None, "from $50k USD"), "B": (None, 60500.0, "up to $60.5k USD"), "C": (120000.0, 150000.0, "$120k – $150k USD"), "D": (None, None, None)}


def test_two_pages_of_a_site_are_looked_at(spark):
    page = '<script type="application/ld+json">{"@type":"JobPosting"}</script>'
    rows = [("a", f"https://a/jobs/{i}", page if i == 3 else "", i) for i in (1, 2, 3)] + [("b", f"https://b/jobs/{i}", page if i == 2 else "", i) for i in (1, 2)]
    assert [tuple(r) for r in matching.discover_feeds(spark.createDataFrame(rows, "site string, url string, html string, seq int")).collect()] == [("b", "^https://b/jobs/", 2)]


def test_crawl_reports(spark, monkeypatch):
    lines = [
        "2024/05/01 09:00:00 [w1] ok of no run", "2024/05/01 09:59:00 done - ingested=7 skipped=1", "", "2024/05/01 10:00:00 starting crawler sources=[lever  ashby] concurrency=4", "2024/05/01 10:00:01 [w0] ok lever:x",
        "no time: context deadline exceeded", "2024/05/01 10:01:00 [lever] 12 jobs", "2024/05/01 11:00:00 done - ingested=1", *["x"] * 10, "2024/05/01 12:00:00 starting crawler", "",
    ]
    raw = spark.createDataFrame(list(enumerate(lines)), "seq long, value string")
    for block in (100_000, 3):  # runs that lie over many blocks too
        monkeypatch.setattr(stats, "LOG_BLOCK", block)
        got = stats.crawl_runs(matching.read_crawl_log(raw), "2024-05-01 12:30:30").orderBy("run").collect()
        assert [(r.elapsed_minutes, r.sources, r.concurrency, r.ok, r.skipped_or_done, r.embed_failures, r.latest_log_line, r.previous_run_summary) for r in got] == [
            (151, ["lever", "ashby"], 4, 1, 1, 1, "x", lines[1]), (31, [], None, 0, 0, 0, lines[-2], None),
        ]
    assert stats.crawl_runs(matching.read_crawl_log(raw.limit(2)), "2024-05-01 12:30:30").count() == 0
