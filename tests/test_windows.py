"""Windows of batches are exact."""

import datetime as d
import random

from pyspark.sql import functions as F

from hirelake.operators import stats


def test_windows_of_many_users_are_exact(spark):
    events = spark.range(60_000).select(F.lit("login").alias("event"), F.concat(F.lit("u"), F.col("id") % 20_000).alias("uid"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 3000).alias("ts"))
    got = stats.active_windows(events).collect()
    assert len(got) == 24 and {r.users for r in got} == {20_000}


def test_windows_equal_a_plain_count(spark):
    rng, start = random.Random(4), d.datetime(2024, 1, 1)
    rows = [(rng.choice(["login", "view"]), rng.choice([None, *[f"u{i}" for i in range(9)]]), start + d.timedelta(minutes=rng.randrange(60 * 24 * 9))) for _ in range(300)] + [("login", "u1", None), ("login", "u1", start + d.timedelta(days=30))]
    want = {}
    for event, uid, ts in rows:
        if event == "login" and uid and ts:
            for i in range(24):
                want.setdefault(ts.replace(minute=0) - d.timedelta(hours=i), set()).add(uid)
    got = stats.active_windows(spark.createDataFrame(rows, "event string, uid string, ts timestamp_ntz")).select(F.col("start").cast("timestamp_ntz"), "users").collect()
    assert {r.start: r.users for r in got} == {k: len(v) for k, v in want.items()} and len(got) == len(want)
