"""Backfills tell labels of different texts, not of rows."""

from hirelake.operators import ingest


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_industries_are_told_for_different_texts(spark):
    rows = [("Software Engineer", "", None), ("Software Engineer", None, "kept"), (None, "", "x"), ("Nurse", "legal", None)]
    df = spark.createDataFrame(rows, "title string, industry string, job_family string").selectExpr("*", "cast(null as string) as description")
    assert "Aggregate" in plan(ingest.backfill_industry(df))
    got = sorted((str(r.title), str(r.industry), str(r.job_family)) for r in ingest.backfill_industry(df).collect())
    assert got == [("None", "", "x"), ("Nurse", "legal", "None"), *[("Software Engineer", "tech", "software_engineering")] * 2]


def test_postings_of_few_texts_stay_where_they_are(spark):
    rows = [(i, ("Nurse", "Software Engineer", "", None)[i % 4], "", "legal" if i % 3 == 0 else None) for i in range(2_000)]
    df = spark.createDataFrame(rows, "id long, title string, description string, industry string")
    after = ingest.backfill_industry(df)
    assert "SortMergeJoin" not in after._jdf.queryExecution().executedPlan().toString()
    got = [(r.id, r.industry) for r in after.select("id", "industry").collect()]
    assert got == [(i, "legal" if i % 3 == 0 else ("healthcare", "tech", None, None)[i % 4]) for i in range(2_000)]


def test_countries_are_told_for_different_places_and_tallied_in_place(spark):
    from pyspark.sql import functions as F

    from hirelake.operators import stats

    rows = [("a", "Berlin, DE", "ZZ"), ("b", "Berlin, DE", ""), ("c", "", "FR"), ("d", "", None), ("e", "Austin, TX", "US")]
    before = spark.createDataFrame(rows, "external_id string, location string, country string")
    after = ingest.backfill_country(before.withColumn("old", F.col("country")))
    assert "Aggregate" in plan(after)
    both = after.select("old", F.col("country").alias("new"))
    tell = lambda df: sorted(map(str, df.collect()))
    assert tell(stats.transitions(both)) == tell(stats.transition_tally(before, ingest.backfill_country(before), "country"))
    assert tuple(stats.totals(both).first()) == tuple(stats.backfill_totals(before, ingest.backfill_country(before), "country").first()) == (2, 2, 1)


def test_documents_carry_columns(spark):
    row = {"external_id": "a", "posting_key": 1, "title": "T", "description": "d", "company": "C", "location": "Bonn", "country": "DE", "salary_currency": "EUR", "salary_period": "annual"}
    df = spark.createDataFrame([row]).selectExpr("*", "1d as salary_min", "2d as salary_max", "timestamp_ntz'2024-01-01' as posted_at", "timestamp_ntz'2024-01-01' as scraped_at")
    got = ingest.to_jobposting_jsonld(df, ("posting_key", "scraped_at"))
    assert got.columns == ["external_id", "jsonld", "posting_key", "scraped_at"] and "Join" not in plan(got) and got.first().posting_key == 1
