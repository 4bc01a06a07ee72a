"""Postings that share a vector."""

from pyspark.sql import functions as F

from hirelake.operators import filters, nearest, ranking
from hirelake.operators.tables import kept


def test_equal_vectors_are_scored_once(spark, monkeypatch):
    """100,000 rows of ten vectors for 300 queries: 3,000 products, not 30 million."""
    seen = []
    best = nearest.best_classes
    monkeypatch.setattr(nearest, "best_classes", lambda queries, classes, k: (seen.append((queries.count(), classes.count())), best(queries, classes, k))[1])
    df = spark.range(100_000).select(F.col("id"), F.array(F.lit(1.0), (F.col("id") % 10).cast("double")).alias("vector"))
    asked = spark.range(300).select(F.concat(F.lit("u"), "id").alias("uid"), F.array(F.lit(1.0), (F.col("id") % 7).cast("double")).alias("asked"))
    got = ranking.batch_topk(asked, df, 12, "uid", "asked", "id").collect()
    assert seen == [(300, 10)] and len(got) == 3_600
    assert sorted(r.id for r in got if r.uid == "u8") == list(range(1, 121, 10))


def test_stored_classes_are_not_told_anew(spark, monkeypatch):
    """Rows that bring the class of their vector are not hashed again, and give the same result."""
    df = spark.range(1_000).select(F.col("id"), F.array(F.lit(1.0), (F.col("id") % 10).cast("double")).alias("vector"))
    stored = df.withColumn("vector_class", nearest.vector_class(F.col("vector")))
    asked = spark.range(7).select(F.col("id").alias("uid"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("asked"))
    top = lambda rows: sorted(map(tuple, ranking.batch_topk(asked, rows, 12, "uid", "asked", "id").collect()))
    want = top(df)
    monkeypatch.setattr(nearest, "vector_class", None)
    assert top(stored) == want and len(want) == 84


def test_rows_stay_where_they_are_while_labels_of_few_values_are_joined(spark):
    """Two million rows of 50 values are not shuffled or sorted for the join with the 50 that were told; nulls are told as well."""
    df = spark.range(2_000_000).select("id", F.when(F.col("id") % 50 > 0, F.concat(F.lit("a long title "), F.col("id") % 50)).alias("title"), F.lit("x" * 40).alias("more"))
    got = filters.per_distinct(df, ["title"], {"size": F.coalesce(F.length("title"), F.lit(-1))}, kept(df.select("title").distinct(), "titles"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert {(r["size"], r["count"]) for r in got.groupBy("size").count().collect()} == {(-1, 40_000), (14, 360_000), (15, 1_600_000)}
