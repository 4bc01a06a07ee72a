"""Streams against batches and plain loops."""

import datetime as d
import json
import random

from pyspark.sql import functions as F

from hirelake.streaming import jobs

POSTING = "external_id string, title string, company string, location string, country string, description string, source string, source_url string, scraped_at timestamp_ntz, posted_at timestamp_ntz, is_active boolean, salary_max double"


def test_a_new_checkpoint_keeps_what_is_there(spark, tmp_path):
    landing, table = tmp_path / "in", str(tmp_path / "table")
    landing.mkdir()
    row = {"title": "Engineer", "company": "Acme", "location": "Berlin, DE", "source": "lever", "source_url": "u", "scraped_at": "2024-05-01T00:00:00"}

    def land(name, ids):
        (landing / name).write_text("\n".join(json.dumps(row | {"external_id": i}) for i in ids))

    run = lambda checkpoint: jobs.stream_ingest(spark, str(landing), table, str(tmp_path / checkpoint), POSTING).awaitTermination()
    held = lambda: sorted(r.external_id for r in spark.read.parquet(table).collect())
    land("0.json", ["a", "b"])
    run("first")
    land("1.json", ["c", "a"])
    run("second")  # reads both files again, as batch 0 of another query
    assert held() == ["a", "b", "c"]
    land("2.json", ["d", "c"])
    run("first")
    run("second")
    assert held() == ["a", "b", "c", "d"]


def test_ghosts_are_told_once_and_touches_reset_them(spark):
    rng, start = random.Random(5), d.datetime(2024, 1, 1)
    rows = [(f"a{rng.randrange(40)}", rng.choice(["applied", "applied", "interviewing", "rejected"]), start + d.timedelta(hours=i * 6, seconds=rng.randrange(60))) for i in range(300)]
    end = start + d.timedelta(days=90)
    rows.append(("clock", "rejected", end))
    got = [(r.app_id, r.last_touched_at) for r in jobs.replay(spark.createDataFrame(rows, "app_id string, status string, last_touched_at timestamp_ntz"), jobs.ghost_applications, "last_touched_at", 5).collect()]
    want = []
    for name in {r[0] for r in rows}:
        own = sorted((r[2], r[1]) for r in rows if r[0] == name)
        for (at, status), after in zip(own, [t for t, _ in own[1:]] + [end]):
            if status in ("applied", "interviewing") and after - at > d.timedelta(days=14):
                want.append((name, at))
    last = {(n, at) for n, at in want if at == max(r[2] for r in rows if r[0] == n)}
    assert last <= set(got) <= set(want) and len(got) == len(set(got))  # a touch in the same batch may come before the clock moves


def test_ghosts_need_no_python_and_heed_the_bound(spark):
    """Every end of a session is told, one within a batch too; two weeks to the microsecond are not yet too long."""
    end, days = d.datetime(2024, 3, 1), d.timedelta(days=14)
    rows = [("a", "applied", end - days), ("b", "applied", end - days - d.timedelta(milliseconds=1)), ("c", "applied", end - 3 * days), ("c", "interviewing", end - days - d.timedelta(days=1))]
    rows += [("d", "applied", end - 3 * days), ("d", "applied", end - 2 * days), ("d", "rejected", end - days), ("e", "applied", end - 3 * days), ("e", "rejected", end - 3 * days), ("f", None, end - 3 * days), ("clock", "rejected", end)]
    rows += [("g", "applied", end - 3 * days), ("g", "applied", end - 2 * days + d.timedelta(microseconds=1)), ("g", "rejected", end - days)]
    df = spark.createDataFrame(rows, "app_id string, status string, last_touched_at timestamp_ntz")
    want = {rows[1][::2], rows[2][::2], rows[3][::2], ("g", end - 3 * days)}
    for batches in (1, 3):
        got = jobs.replay(df, jobs.ghost_applications, "last_touched_at", batches).collect()
        assert {(r.app_id, r.last_touched_at) for r in got} == want and len(got) == 4
    plan = jobs.ghost_applications(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "TransformWithState" not in plan


def test_hours_are_counted_once_and_merged(spark):
    rng, start = random.Random(2), d.datetime(2024, 1, 1)
    rows = [(rng.choice(["login", "view", "register"]), rng.choice([None, *[f"u{i}" for i in range(60)]]), start + d.timedelta(minutes=rng.randrange(60 * 24 * 4))) for _ in range(500)]
    events = spark.createDataFrame(rows, "event string, uid string, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {}
    for event, uid, ts in rows:
        if event != "view" and uid:
            hour = ts.replace(minute=0, second=0)
            for i in range(24):
                want.setdefault(hour - d.timedelta(hours=i), set()).add(uid)
    batch = jobs.sliding_active(events)
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Expand") < plan.index("hll_sketch_agg")  # printed from the top: windows are laid over sketches
    told = lambda df: {r.s: r.users for r in df.select(F.col("window.start").cast("timestamp_ntz").alias("s"), "users").collect()}
    assert told(batch) == {k: len(v) for k, v in want.items()}
    streamed = told(jobs.replay(events, lambda s: jobs.sliding_active(s, "0 seconds"), "ts"))
    assert streamed and all(streamed[k] == len(want[k]) for k in streamed) and len(streamed) > 40


def test_a_sketch_is_within_its_error(spark):
    events = spark.range(60_000).select(F.lit("login").alias("event"), F.concat(F.lit("u"), F.col("id") % 20_000).alias("uid"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 3000).alias("ts"))
    assert {abs(r.users / 20_000 - 1) < 0.06 for r in jobs.sliding_active(events).collect()} == {True}


def test_rollups_take_back_what_changes(spark, tmp_path):
    from hirelake.operators import stats

    rng = random.Random(9)
    now, folder, landing = {}, str(tmp_path / "history"), str(tmp_path / "in")
    schema = "external_id string, country string, is_active boolean, scraped_at timestamp_ntz"
    for k in range(4):
        rows = {f"p{rng.randrange(60)}": (rng.choice(["US", "DE", None]), rng.choice([True, None, False]), d.datetime(2024, 1, 1) + d.timedelta(days=rng.randrange(40), hours=k)) for _ in range(40)}
        now |= rows
        late = [(i, "US", True, d.datetime(2020, 1, 1)) for i in rows]  # older rows of the same batch do not stand
        spark.createDataFrame([(i, *v) for i, v in rows.items()] + late, schema).coalesce(2).write.mode("append").parquet(landing)
        jobs.maintain_history(spark.readStream.schema(schema).parquet(landing), folder, str(tmp_path / "cp")).awaitTermination()
        if k == 2:  # the batch is lost after its folders were written, and replayed
            (tmp_path / "cp" / "commits" / "2").unlink()
            for crc in (tmp_path / "cp" / "commits").glob(".2.crc"):
                crc.unlink()
            jobs.maintain_history(spark.readStream.schema(schema).parquet(landing), folder, str(tmp_path / "cp")).awaitTermination()
    deltas = spark.read.parquet(f"{folder}/deltas")
    got = {(r.series, r.day): r.n for r in stats.rolled_history(deltas, "2024-02-05 00:00:00", ["US", "FR"], 30).collect()}
    table = spark.createDataFrame([(i, *v) for i, v in now.items()], schema)
    want = {(r.series, r.day): r.n for r in stats.cumulative_history(table, "2024-02-05 00:00:00", ["US", "FR"], 30).collect()}
    assert got == want and len(got) == 90 and max(got.values()) > 10


def test_a_replay_tells_its_rows_once(spark, tmp_path):
    """Rows that come out differently each time are told: every landing sees the same ones."""
    df = spark.range(200).select(F.expr("uuid()").alias("external_id"), F.timestamp_seconds((F.rand() * 100).cast("long") * 86_400).alias("scraped_at"))
    told = []

    def job(stream):
        told.append(stream)
        return stream

    assert jobs.replay(df, job, "scraped_at").count() == 200 and len(told) == 4
