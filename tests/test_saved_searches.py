"""The index over predicates against plain loops."""

import random

from pyspark.sql import functions as F

from hirelake.operators import ingest, saved_searches
from hirelake.streaming import jobs

SEARCH = "search_id string, country string, remote_status string, industry string, keyword string"
POSTING = "external_id string, country string, remote_status string, industry string, title string, day int, active boolean"


def tables(spark, n_postings, n_searches, seed=1):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    postings = [(f"p{i:05}", pick("US", "US", "DE", None), pick("remote", "onsite", None), pick("tech", "legal", None), pick("Senior Engineer", "engineering lead", "Nurse", "", None, "R&D é", "ab"), rng.randrange(30), pick(True, None, False)) for i in range(n_postings)]
    searches = [(f"s{i:05}", pick(None, None, "US", "DE", "FR"), pick(None, "remote"), pick(None, "tech", "legal"), pick(None, "", "ENGINEER", "nurse", "é", "r&", "zzz", "ngin", "b")) for i in range(n_searches)]
    p = spark.createDataFrame(postings, POSTING).withColumn("scraped_at", F.timestamp_seconds((F.col("day") + 19_000) * 86400)).withColumn("posted_at", F.when(F.col("day") % 3 == 0, F.col("scraped_at"))).withColumn("is_active", F.col("active"))
    return postings, searches, p, spark.createDataFrame(searches, SEARCH)


def hits(search, posting):
    return all(a is None or a == b for a, b in zip(search[1:4], posting[1:4])) and (not search[4] or posting[4] is not None and search[4].lower() in posting[4].lower())


def test_newest_matches_of_every_search(spark):
    postings, searches, p, s = tables(spark, 600, 250)
    for k in (3, 60):
        got = sorted(map(tuple, ingest.match_saved_searches(p, s, "", k).collect()))
        want = []
        for search in searches:
            found = sorted((-x[5], x[0]) for x in postings if x[6] is not False and hits(search, x))[:k]
            want += [(search[0], i, rank + 1) for rank, (_, i) in enumerate(found)]
        assert got == sorted(want)


def test_no_loop_over_searches_and_postings(spark):
    _, _, p, s = tables(spark, 3000, 100)
    many = s.crossJoin(spark.range(1000)).withColumn("search_id", F.concat("search_id", F.lit("-"), "id")).drop("id")
    plan = ingest.match_saved_searches(p, s, "", 2)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = ingest.match_saved_searches(p, many, "", 2)
    per_search = {r.n: r["count"] for r in found.groupBy("search_id").agg(F.count("*").alias("n")).groupBy("n").count().collect()}
    assert max(per_search) == 2 and sum(per_search.values()) % 1000 == 0  # 100,000 searches


def test_each_search_is_filed_once_under_its_rarest_key(spark):
    s = spark.createDataFrame([("a", "US", None, "tech", "nurse"), ("b", None, None, None, None), ("c", "US", None, None, None), ("d", None, None, None, "ab")], SEARCH)
    counts = spark.createDataFrame([("country=US", 9), ("industry=tech", 4), ("3:nur", 3), ("3:urs", 1), ("3:rse", 2)], "key string, n long")
    assert {r.search_id: r.key for r in saved_searches.filed(s, counts).collect()} == {"a": "3:urs", "b": "*", "c": "country=US", "d": "2:ab"}


def test_alerts_of_a_batch_and_a_stream(spark, tmp_path):
    postings, searches, p, s = tables(spark, 200, 60, 3)
    want = sorted((q[0], x[0]) for q in searches for x in postings if hits(q, x))
    assert sorted((r.search_id, r.external_id) for r in jobs.stream_alerts(p.unionByName(p), s).collect()) == want
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.stream_alerts(stream, s, "60 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    assert sorted((r.search_id, r.external_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_no_postings_no_searches(spark):
    _, _, p, s = tables(spark, 5, 5)
    assert ingest.match_saved_searches(p.limit(0), s, "").count() == 0 and ingest.match_saved_searches(p, s.limit(0), "").count() == 0
