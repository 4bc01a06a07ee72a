"""Vectors of a bucket whose cosine reaches a threshold: exact, by a plain join in small buckets and by pairs of blocks in large ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators.ranking import cosine
from hirelake.operators.tables import kept

#: Vectors of a bucket up to which they are joined with one another row by row.
SMALL = 256
#: Vectors in a block of a larger bucket; a task holds two blocks, and the products of STRIP rows with one of them.
BLOCK = 8192
STRIP = 512
#: Members of a class in a block; a task holds the pairs of two blocks at a time.
MEMBERS = 256


def near_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """a, b, cosine of all pairs a < b of (bucket, id, vector) in one bucket whose cosine is at least ``threshold`` (above 0).

    Vectors with a null, a NaN or norm 0 are near nothing, nor are vectors of different lengths or rows without a bucket. Ids must differ within a bucket."""
    small, tasks = _plan(vectors.withColumn("many", F.lit(1).cast("long")), threshold)
    told = tasks.groupBy("task").applyInPandas(lambda rows: pd.concat(_pairs_of(rows, threshold)), "a string, b string, cosine double")
    return _joined(small, threshold).select("a", "b", "cosine").unionByName(told)


def near_counts(vectors: DataFrame, threshold: float) -> DataFrame:
    """id, n: for each of (bucket, id, vector, many) how many rows stand behind the other vectors near it, the sum of their ``many``; without those of 0.

    What is near is summed where it is found, so no pairs are written, however many there are."""
    small, tasks = _plan(vectors, threshold)
    both = _joined(small, threshold).select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("many_b").alias("n")), F.struct(F.col("b").alias("id"), F.col("many_a").alias("n")))).alias("x")).select("x.*")
    told = tasks.groupBy("task").applyInPandas(lambda rows: _counts_of(rows, threshold), "id string, n long")
    return both.unionByName(told).groupBy("id").agg(F.sum("n").alias("n"))


def member_pairs(members: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """a < b, cosine: all pairs of members (class, id) whose classes are linked by (a, b, cosine); a class that is linked with itself pairs its own members.
    ``classes`` has their sizes: class, many. Each two classes are linked once at most.

    No cosine is told and no pair is moved: members are cut in blocks by hash, blocks meet, and pairs are made of two blocks in the task that has them.
    Tasks are as many as the session's shuffle partitions: the pairs are to be spread, not the bytes of the blocks, by which tasks would be put together."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = kept(classes.select("class", F.ceil(F.col("many") / MEMBERS).alias("parts")).filter("parts > 1"), "large")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).alias("part")
    blocks = members.join(large, "class", "left").select("class", part, "id").repartition(n, "class", "part").groupBy("class", "part").agg(F.collect_list("id").alias("ids"))
    count = lambda side: large.select(F.col("class").alias(side), F.col("parts").alias(f"parts_{side}"))
    places = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"parts_{side}", F.lit(1)) - 1)).alias(f"part_{side}")
    met = links.join(count("a"), "a", "left").join(count("b"), "b", "left").select("a", "b", "cosine", "parts_b", places("a")).select("a", "b", "cosine", "part_a", places("b")).filter("a <> b or part_a <= part_b")
    for side in ("a", "b"):
        met = met.repartition(n, side, f"part_{side}").join(blocks.select(F.col("class").alias(side), F.col("part").alias(f"part_{side}"), F.col("ids").alias(f"ids_{side}")), [side, f"part_{side}"])
    alone = (F.col("a") == F.col("b")) & (F.col("part_a") == F.col("part_b"))
    pairs = met.select(alone.alias("alone"), "cosine", "ids_b", F.explode("ids_a").alias("x")).select("alone", "cosine", "x", F.explode("ids_b").alias("y"))
    return pairs.filter("x < y or not alone and x > y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")


def sound(vector: str) -> F.Column:
    """Whether a vector has a direction: no null, no NaN, a finite norm above 0."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce((square > 0) & (square < float("inf")), F.lit(False))


def _joined(small: DataFrame, threshold: float) -> DataFrame:
    a, b = (small.select("bucket", *[F.col(x).alias(f"{x}_{side}") for x in ("id", "many", "vector")]) for side in "ab")
    pairs = a.join(b, "bucket").filter("id_a < id_b").withColumn("cosine", cosine(F.col("vector_a"), F.col("vector_b")))
    return pairs.filter(F.col("cosine") >= threshold).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "many_a", "many_b", "cosine")


def _plan(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The rows of small buckets, and those of large ones dealt out to tasks: (task, side, id, many, vector).

    Unit vectors at a cosine of t are at most sqrt(2 - 2 t) apart, and so are their projections on a direction. Large buckets are cut into cells of that
    width, cells into blocks by hash; a block meets the blocks of its own cell and of the next one."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and not above 1")
    reach = math.sqrt(2 - 2 * threshold) + 1e-6
    rows = vectors.filter(F.col("bucket").isNotNull() & sound("vector")).select(F.md5(F.concat_ws("/", F.size("vector"), "bucket")).alias("bucket"), "id", "many", F.col("vector").cast("array<double>").alias("vector"))
    total = lambda f: F.aggregate("vector", F.lit(0.0), f)
    place = total(lambda s, x: s + x) / F.sqrt(total(lambda s, x: s + x * x)) / F.sqrt(F.size("vector"))
    rows = kept(rows.withColumn("cell", F.floor(place / reach)), "near")
    cells = rows.groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    buckets = cells.groupBy("bucket").agg(F.sum("n").alias("size")).filter(F.col("size") > SMALL)
    small = rows.join(buckets, "bucket", "left_anti")
    parts = kept(cells.join(buckets, "bucket").select("bucket", "cell", F.ceil(F.col("n") / BLOCK).alias("parts")), "near-cells")
    blocks = parts.select("bucket", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    left = blocks.select("bucket", F.col("cell").alias("cell_a"), F.col("part").alias("part_a"), F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"))
    met = left.join(blocks, ["bucket", "cell"]).filter("cell <> cell_a or part >= part_a")
    met = met.select("bucket", F.col("cell").alias("cell_b"), F.col("part").alias("part_b"), "cell_a", "part_a", F.concat_ws("/", "bucket", "cell_a", "part_a", "cell", "part").alias("task"))
    dealt = rows.join(parts, ["bucket", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    side = lambda s, pairs: dealt.join(pairs.select("bucket", F.col(f"cell_{s}").alias("cell"), F.col(f"part_{s}").alias("part"), "task"), ["bucket", "cell", "part"]).select("task", F.lit(s).alias("side"), "id", "many", "vector")
    return small, side("a", met).unionByName(side("b", met.filter("cell_a <> cell_b or part_a <> part_b")))


def _strips(rows: pd.DataFrame, threshold: float) -> Iterator[tuple]:
    """(rows of one side, rows of the other, places, places, cosines) of what is near, strip by strip. A task of one side compares it with itself."""
    sides = [rows[rows.side == s].sort_values("id", ignore_index=True) for s in ("a", "b")]
    alone = sides[1].empty
    a, b = sides[0], sides[0] if alone else sides[1]
    va, vb = (np.array(x.vector.tolist(), dtype=np.float64).reshape(len(x), -1) for x in (a, b))
    na, nb = (np.sqrt((v * v).sum(1)) for v in (va, vb))
    for start in range(0, len(a), STRIP):
        found = va[start : start + STRIP] @ vb.T / np.outer(na[start : start + STRIP], nb)
        i, j = np.nonzero(found >= threshold - 1e-9)
        if alone:
            i, j = i[i + start < j], j[i + start < j]
        cosines = found[i, j]
        for k in np.nonzero(np.abs(cosines - threshold) < 1e-9)[0]:  # added up in the order of the join of small buckets
            x, y = va[i[k] + start].tolist(), vb[j[k]].tolist()
            dot = lambda p, q: sum(s * t for s, t in zip(p, q))
            cosines[k] = dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)))
        sure = cosines >= threshold
        yield a, b, i[sure] + start, j[sure], cosines[sure]


def _pairs_of(rows: pd.DataFrame, threshold: float) -> Iterator[pd.DataFrame]:
    yield pd.DataFrame({"a": [], "b": [], "cosine": []}).astype({"a": str, "b": str, "cosine": float})
    for a, b, i, j, cosines in _strips(rows, threshold):
        x, y = a.id.to_numpy()[i], b.id.to_numpy()[j]
        swap = x > y
        yield pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y), "cosine": cosines})


def _counts_of(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    sums: dict[str, int] = {}
    for a, b, i, j, _ in _strips(rows, threshold):
        for ids, many, own, other in ((a.id, b.many, i, j), (b.id, a.many, j, i)):
            n = np.bincount(own, weights=many.to_numpy()[other], minlength=len(ids))
            for k in np.nonzero(n)[0]:
                sums[ids.iat[k]] = sums.get(ids.iat[k], 0) + int(n[k])
    return pd.DataFrame({"id": list(sums), "n": list(sums.values())}).astype({"id": str, "n": "int64"})
