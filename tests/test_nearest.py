"""Nearest rows of many queries against a plain loop."""

import pytest
from pyspark.sql import functions as F

from hirelake.operators import nearest, ranking


def plain(queries, df, k):
    pairs = df.crossJoin(queries).withColumn("score", ranking.cosine(F.col("vector"), F.col("asked"))).select("uid", "id", "score")
    return ranking.top_n_per_group(pairs, ["uid"], [F.col("score").desc(), F.col("id")], k)


@pytest.mark.parametrize("queries,vectors,strip,k", [(2048, 16384, 128, 5), (4, 16, 3, 5), (7, 1, 2, 40)])
def test_blocks_equal_a_plain_loop(spark, monkeypatch, queries, vectors, strip, k):
    import numpy as np

    monkeypatch.setattr(nearest, "QUERIES", queries), monkeypatch.setattr(nearest, "VECTORS", vectors), monkeypatch.setattr(nearest, "STRIP", strip)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 6))
    rows = [(f"{i:03d}", (base[i % 30] * [1.0, 2.0, 3.7][i % 3]).tolist()) for i in range(200)]
    odd = [[0.0] * 6, [0.0] * 6, [float("nan")] * 6, [None] + [1.0] * 5, [1.0], None, [1e-170] * 6, [float("inf")] + [1.0] * 5, [1e160] * 6, [-0.0] * 6, []]
    rows += [(f"x{i}", v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    asked = spark.createDataFrame([(f"q{i}", rows[j][1]) for i, j in enumerate([*range(0, 40, 3), *range(200, 211)])] + [("far", rng.normal(size=6).tolist())], "uid string, asked array<double>")
    want = plain(asked, df, k).collect()
    got = ranking.batch_topk(asked, df, k, "uid", "asked", "id").collect()
    tell = lambda rows: sorted((r.uid, r.id, str(r.score)) for r in rows)
    assert tell(got) == tell(want) and len(got) > 100
