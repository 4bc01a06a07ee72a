"""Connected components of an edge table, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.shared import discard, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (of one type that can be ordered, not null). Returns node, label for every node of an edge; the label is the
    smallest node it reaches.

    In each round a node takes the smallest label seen at its neighbours' labels and hands it to its own label as well, so paths
    shrink by a constant factor. Labels live in staged tables; only whether any label changed reaches the driver. Joins read
    exchanges on both sides, so adaptive execution can split a node with very many edges.
    """
    # Both directions come from one reading: edges that depend on the order of rows would differ between two.
    ways = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.filter("a <> b").select(F.explode(ways).alias("way")).select("way.a", "way.b").distinct()
    both = staged(both, "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        at = labels.withColumnRenamed("node", "of").withColumnRenamed("label", "next")
        jumped = labels.join(at, F.col("label") == F.col("of")).select("node", "label", "next")
        near = both.join(jumped.select("node", "next"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("next").alias("near"))
        told = jumped.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "next", "near").alias("best"), "near")
        own = F.struct("node", F.col("best").alias("label"), F.col("label").alias("old"))
        handed = F.struct(F.col("label").alias("node"), F.col("near").alias("label"), F.col("label").alias("old"))  # a label never rises above its node
        fresh = told.select(F.explode(F.array(own, handed)).alias("x")).groupBy("x.node").agg(F.min("x.label").alias("label"), F.min("x.old").alias("old"))
        fresh = staged(fresh, "labels")
        still = fresh.filter("label < old").isEmpty()
        discard(labels)
        labels = fresh.select("node", "label")
        if still:
            discard(both)
            return labels
