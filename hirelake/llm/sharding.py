"""Sharding by extendible hashing.

The directory is indexed by leading bits of a hash of the id. A bucket whose bytes exceed the limit splits on its next
bit, and only such buckets do, until every bucket fits. Only sums per hash prefix are shuffled, never texts: each round
counts the bytes of the oversized buckets' rows ``ROUND_BITS`` deeper, at most 2^ROUND_BITS cells for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.shared import staged

HASH_BITS = 60
ROUND_BITS = 12
PART_ROWS = 1_000_000


def hash_bits(col):
    """The first 60 bits of the MD5 of the id as text (null: empty), as '0' and '1'."""
    first = F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4)
    return F.lpad(F.bin(F.conv(first, 16, 10).cast("long")), HASH_BITS, "0")


def assign_shards(df: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, shard (the bucket's hash prefix, with a part number after ``/`` where needed), depth,
    n_bytes, shard_bytes, shard_rows.

    A null text has no bytes. Rows that share all 60 bits (the same id again, as a rule) cannot be split by hash; if together they
    exceed the limit, those of equal size are cut in parts of as many as fit (``PART_ROWS`` at most). Only a single row larger than the limit makes a shard that exceeds it.
    An empty table gives an empty result; one that fits gives the one shard ``''`` of depth 0. Other columns are ignored.
    """
    rows = staged(
        df.select(F.col(id_col).alias("id"), hash_bits(id_col).alias("bits"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")),
        "shard-rows",
    )
    full, leaves, depth = None, None, 0  # full: the buckets that are oversized at the depth reached
    while depth < HASH_BITS:
        step = min(ROUND_BITS, HASH_BITS - depth)
        below = rows if full is None else rows.join(full, F.substring("bits", 1, depth) == full["prefix"], "left_semi")
        cells = below.groupBy(F.substring("bits", 1, depth + step).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        depths = F.sequence(F.lit(depth), F.lit(depth + step))
        above = F.transform(depths, lambda k: F.struct(k.alias("depth"), F.col("cell").substr(F.lit(1), k).alias("bucket")))
        sums = staged(
            cells.select(F.explode(above).alias("x"), "bytes", "rows").groupBy("x.depth", "x.bucket").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")),
            "directory",
        )
        over = sums.filter(F.col("bytes") > limit_bytes)
        fit = sums.filter(F.col("bytes") <= limit_bytes)
        # A bucket that fits is a leaf if the one it split from does not fit; the whole table splits from nothing.
        split = over.select((F.col("depth") + 1).alias("_d"), F.col("bucket").alias("_p"))
        of = fit["bucket"].substr(F.lit(1), fit["depth"] - 1)
        found = fit.join(split, (fit["depth"] == split["_d"]) & (of == split["_p"]), "left_semi")
        if full is None:
            found = found.unionByName(fit.filter("depth = 0"))
        leaves = found if leaves is None else leaves.unionByName(found)
        depth += step
        full = over.filter(F.col("depth") == depth).select(F.col("bucket").alias("prefix"))
        if full.isEmpty():
            full = None
            break
    # The directory: each bucket is entered under all prefixes of its round's depth, so a row is looked up once a round, not once for each depth.
    deep = F.least(F.ceil(F.col("depth") / ROUND_BITS) * ROUND_BITS, F.lit(HASH_BITS)).cast("int")
    leaves = leaves.withColumn("deep", deep).withColumn("free", F.col("deep") - F.col("depth"))
    ends = F.when(F.col("free") == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), (F.pow(F.lit(2), F.col("free")) - 1).cast("int")), lambda k: F.lpad(F.bin(k), F.col("free"), F.lit("0"))))
    entered = leaves.select(F.explode(ends).alias("tail"), F.col("bucket").alias("shard"), "depth", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
    directory = staged(entered.select(F.concat("shard", "tail").alias("entry"), "shard", "depth", "shard_bytes", "shard_rows"), "directory")
    at = [r[0] for r in directory.select(F.length("entry")).distinct().collect()]  # at most one for each round
    ways = F.array(*[F.substring("bits", 1, k) for k in at]) if at else F.array().cast("array<string>")
    placed = rows.withColumn("entry", F.explode(ways)).join(directory, "entry").select("id", "shard", "depth", "n_bytes", "shard_bytes", "shard_rows")
    if full is None:
        return placed.withColumnRenamed("id", id_col)
    # Rows alike in hash, id and size are counted before they meet, then cut in parts of as many as fit (one, if none does).
    alike = rows.join(full, rows["bits"] == full["prefix"], "left_semi").groupBy("bits", "id", "n_bytes").agg(F.count("*").alias("many"))
    each = F.when(F.col("n_bytes") == 0, F.lit(PART_ROWS)).otherwise(F.least(F.lit(PART_ROWS), F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.col("n_bytes"))))).cast("long")
    parts = alike.withColumn("each", each).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / F.col("each")).cast("long"))).alias("part"))
    parts = parts.withColumn("shard_rows", F.least("each", F.col("many") - F.col("part") * F.col("each")))
    name = F.concat_ws("/", "bits", F.substring(F.sha1(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, 8), F.col("n_bytes").cast("string"), F.col("part").cast("string"))
    tail = parts.select("id", name.alias("shard"), F.lit(HASH_BITS).alias("depth"), "n_bytes", (F.col("n_bytes") * F.col("shard_rows")).alias("shard_bytes"), "shard_rows", F.explode(F.sequence(F.lit(1).cast("long"), "shard_rows")).alias("row"))
    return placed.unionByName(tail.drop("row")).withColumnRenamed("id", id_col)


def write_shards(df: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``df`` with a ``shard`` column as Parquet, one folder for each shard, and return the directory (one row per shard).

    An id goes where :func:`assign_shards` puts it. Rows of an id that had to be cut in parts are numbered (by the task that reads them, then
    in the task, so that none counts them all) and dealt out to the parts in turn; no folder holds more than its entry in the directory says.
    A column of ``df`` named ``shard`` is replaced; other columns may have any name. An empty table writes no folder.
    """
    plan = staged(assign_shards(df, limit_bytes, id_col, text_col).withColumnRenamed(id_col, "id"), "plan")
    cut = F.col("shard").contains("/")
    rows = df.drop("shard").select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n"))
    of = plan.filter(~cut).select("id", "shard").distinct()
    out = rows.join(of, rows["i"].eqNullSafe(of["id"])).select("row", "shard")
    stem = F.regexp_replace("shard", "/[0-9]+$", "")
    parts = staged(plan.filter(cut).groupBy("id", "n_bytes").agg(F.max("shard_rows").alias("each"), F.min(stem).alias("stem")), "parts")
    if not parts.isEmpty():
        hot = rows.join(parts, rows["i"].eqNullSafe(parts["id"]) & (rows["n"] == parts["n_bytes"])).select("row", "stem", "each", F.monotonically_increasing_id().alias("k"))
        hot = staged(hot, "hot-rows").withColumn("task", F.shiftright("k", 33))
        before = Window.partitionBy("stem").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
        starts = hot.groupBy("stem", "task").count().select("stem", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
        own = F.row_number().over(Window.partitionBy("stem", "task").orderBy("k")) - 1
        part = F.floor((F.col("start") + F.col("own")) / F.col("each")).cast("string")
        dealt = hot.withColumn("own", own).join(starts, ["stem", "task"]).select("row", F.concat_ws("/", "stem", part).alias("shard"))
        out = out.unionByName(dealt)
    out.select("row.*", "shard").repartition("shard").write.partitionBy("shard").parquet(path)
    return plan.groupBy("shard", "depth").agg(F.max("shard_bytes").alias("shard_bytes"), F.max("shard_rows").alias("shard_rows"))
