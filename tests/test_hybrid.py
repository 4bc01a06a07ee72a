"""Hybrid search over postings."""

from pyspark.sql import functions as F

from hirelake.operators import filters, ranking


def test_passes_over_the_postings_are_made_once(spark, tmp_path):
    """The result reads the postings for its page alone, not again for the candidates of either pass and the total; it is that of plain loops."""
    n = 400
    df = spark.range(n).select(
        F.format_string("g:%03d", "id").alias("external_id"), F.when(F.col("id") % 40 == 0, "Software Engineer").otherwise("Cook").alias("title"), F.lit("").alias("description"), F.lit("Berlin, DE").alias("location"), F.lit("DE").alias("country"),
        F.lit("tech").alias("industry"), F.lit("greenhouse").alias("source"), F.lit(1.0).alias("salary_max"), F.lit("2024-05-01").cast("timestamp_ntz").alias("scraped_at"), F.lit(None).cast("timestamp_ntz").alias("posted_at"),
        (F.col("id") % 7 > 0).alias("is_active"), F.array(F.lit(1.0), F.col("id") / n).alias("vector"),
    )
    df.write.parquet(f"{tmp_path}/base")
    found = ranking.hybrid_search(spark.read.parquet(f"{tmp_path}/base"), [1.0, 1.0], ["software engineer"], filters.SearchFilter(), "2024-06-01 00:00:00", k=15)
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().toString().count("is_active") == 1
    live = [i for i in range(n) if i % 7]
    near = {i: r for r, i in enumerate(sorted(live, reverse=True)[:100], 1)}  # the nearest direction is that of the largest id
    words = {i: r for r, i in enumerate([i for i in live if i % 40 == 0], 1)}
    fused = {i: sum(1 / (ranking.RRF_K + part[i]) for part in (near, words) if i in part) for i in near.keys() | words.keys()}
    want = sorted(fused, key=lambda i: (-fused[i], i))[:15]
    rows = found.collect()
    assert [int(r.external_id[2:]) for r in rows] == want and {r.total for r in rows} == {len(fused)}
    assert all((r.score == ranking.KEYWORD_SCORE) == (int(r.external_id[2:]) not in near) for r in rows)
