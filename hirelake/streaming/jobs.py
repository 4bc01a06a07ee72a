"""Streaming jobs over postings and events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.operators import ingest, saved_searches, stats
from hirelake.operators.filters import active_user_events
from hirelake.operators.tables import kept, shared_path


def stream_ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: str, files: int = 16):
    """Landed posting files to the table: each batch is validated, cut to ids that the table does not hold, enriched and appended.

    A batch has a folder of its own, named by the checkpoint's query id and the batch's number. If it is replayed it writes that folder again and
    does not count itself as known; a stream with a new checkpoint has another id, so it adds to what is there."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(landing)

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        query = session.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        valid, _ = ingest.validate_postings(batch)
        if _folder_exists(session, table):
            known = session.read.schema("external_id string, query string, batch long").parquet(table)
            valid = ingest.skip_existing(valid, known.filter((F.col("query") != query) | (F.col("batch") != number)))
        fresh = ingest.upsert_postings(valid.limit(0), valid)
        fresh.write.mode("overwrite").parquet(f"{table}/query={query}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


#: What a rollup keeps of each version of a posting.
VERSION = "external_id string, country string, is_active boolean, scraped_at timestamp_ntz, version long"


def maintain_history(changes: DataFrame, folder: str, checkpoint: str):
    """Keep counts of active postings by day and country up to date with a stream of new and changed postings (external_id, country, is_active,
    scraped_at): ``folder/deltas`` gets what each batch adds and takes back, ``folder/versions`` the batch's rows. Of one posting's rows in a
    batch the latest scrape stands, ties by activity, then country; rows of later batches replace those of earlier ones.

    Batches of one checkpoint are numbered in order; a replayed batch writes its folders again and sees only the versions before it."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = F.row_number().over(Window.partitionBy("external_id").orderBy(F.col("scraped_at").desc(), "is_active", "country"))
        after = batch.select("external_id", "country", "is_active", F.col("scraped_at").cast("timestamp_ntz").alias("scraped_at"), F.lit(number).cast("long").alias("version")).withColumn("_n", last).filter("_n = 1").drop("_n")
        before = spark.createDataFrame([], VERSION)
        if _folder_exists(spark, f"{folder}/versions"):
            known = spark.read.schema(f"{VERSION}, batch long").parquet(f"{folder}/versions").filter(F.col("batch") < number).drop("batch")
            newest = F.row_number().over(Window.partitionBy("external_id").orderBy(F.col("version").desc()))
            before = known.join(after.select("external_id"), "external_id", "left_semi").withColumn("_n", newest).filter("_n = 1").drop("_n")
        stats.history_deltas(before, after).write.mode("overwrite").parquet(f"{folder}/deltas/batch={number}")
        after.write.mode("overwrite").parquet(f"{folder}/versions/batch={number}")

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: State of streams on local disk instead of memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(df: DataFrame, job: Callable[[DataFrame], DataFrame], order: str, batches: int = 4) -> DataFrame:
    """What ``job`` gives for ``df`` as a stream: rows are landed in ``batches`` ranges of ``order``, oldest first (nulls with them), and after each
    landing the stream, which goes on from its checkpoint, reads what has come. Results are appended to a table in the shared folder."""
    spark, key = df.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    landing, out, checkpoint = (shared_path(spark, f"replay-{x}") for x in ("landing", "out", "checkpoint"))
    df = kept(df, "replay-rows")  # each landing reads them again
    seconds = F.col(order).cast("timestamp").cast("double")
    low, high = df.agg(F.min(seconds), F.max(seconds)).first()
    part = F.coalesce(F.least(F.floor((seconds - F.lit(low or 0.0)) / F.lit(max((high or 0.0) - (low or 0.0), 1.0)) * batches), F.lit(batches - 1)), F.lit(0))
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        for i in range(batches):
            df.filter(part == i).write.mode("append").parquet(landing)
            result = job(spark.readStream.schema(df.schema).parquet(landing))
            result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(result.schema).parquet(out)


def dedupe_stream(df: DataFrame, delay: str = "2 hours") -> DataFrame:
    return df.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark(["external_id"])


def stream_alerts(df: DataFrame, searches: DataFrame, delay: str = "2 hours") -> DataFrame:
    """search_id, external_id, scraped_at of new postings that meet a saved search, each posting once within ``delay``. Searches are filed by key, and
    a posting meets those of its keys; those that ask nothing meet every posting."""
    once = dedupe_stream(df, delay) if df.isStreaming else df.dropDuplicates(["external_id"])
    return saved_searches.matches(once, searches, ["scraped_at"])


#: Logarithm of the registers of a sketch: a relative standard error of 1.6 %, exact for a few hundred users.
SKETCH_BITS = 12


def active_tiles(df: DataFrame, delay: str = "2 hours") -> DataFrame:
    """window, users: a sketch of the distinct active users of every hour, one for all events of the hour."""
    return active_user_events(df).withWatermark("ts", delay).groupBy(F.window("ts", "1 hour")).agg(F.hll_sketch_agg("uid", F.lit(SKETCH_BITS)).alias("users"))


def sliding_active(df: DataFrame, delay: str = "2 hours") -> DataFrame:
    """window, users: approximate distinct active users in windows of 24 hours every hour, from the hours' sketches. An event counts into one
    sketch; sketches, not events, go to the 24 windows that hold their hour."""
    tiles = active_tiles(df, delay).select(F.window_time("window").alias("hour"), "users")
    return tiles.groupBy(F.window("hour", "24 hours", "1 hour")).agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"))


def ghost_applications(df: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """app_id, last_touched_at of applications (app_id, status, last_touched_at) that are open and have been untouched for more than two weeks, told
    when that time has passed by the stream's clock, the latest touch of any application less ``delay``. Of touches at one time a closing one stands.

    Touches of an application at most two weeks apart are one session, and a session that ends with an open status is a ghost. State is a row for each
    session that still can go on. A session ends at its bound, an application a millisecond, the clock's unit, behind it."""
    rows = df.select("app_id", F.coalesce(~F.col("status").isin("applied", "interviewing"), F.lit(True)).alias("closed"), F.col("last_touched_at").cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", f"{delay} 1 millisecond")
    ended = rows.groupBy("app_id", F.session_window("ts", f"{stats.GHOST_DAYS} days")).agg(F.max(F.struct("ts", "closed")).alias("last"))
    return ended.filter("not last.closed").select("app_id", F.col("last.ts").cast("timestamp_ntz").alias("last_touched_at"))


def tumbling_counts(df: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    return df.withWatermark("ts", delay).groupBy(F.window("ts", width), "event").agg(F.count("*").alias("n"))


#: Limit and window in seconds of each rule.
RATE_RULES = {"search": (60, 60), "embed": (30, 60), "match-explain": (10, 60), "auth-read": (30, 60), "auth-write": (5, 3600), "profile-write": (30, 60), "contact": (5, 3600)}


def rate_step(limit: int, window: float) -> Callable:
    """State for applyInPandasWithState: (window end, count). A window begins at its first request; requests over the limit are rejected and not counted."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        end, count = state.get if state.exists else (0.0, 0)
        out = []
        for frame in frames:
            for t in sorted(frame["t"]):
                if t >= end:
                    end, count = t + window, 1
                elif count >= limit:
                    out.append((key[0], t, end))
                else:
                    count += 1
        state.update((end, count))
        yield pd.DataFrame(out, columns=["key", "t", "reset_at"])

    return step


def rate_violations(df: DataFrame, rule: str) -> DataFrame:
    """key, t, reset_at of rejected requests of a stream (key, t in epoch seconds)."""
    limit, window = RATE_RULES[rule]
    return df.groupBy("key").applyInPandasWithState(rate_step(limit, float(window)), "key string, t double, reset_at double", "end double, count int", "append", "NoTimeout")
