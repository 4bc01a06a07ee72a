import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.operators import dedupe, near

T = 0.98


def rows_of(rng, n, dim=8):
    """Families of near vectors of any length, of which some lie just on either side of the threshold, and vectors without direction."""
    out = []
    for i in range(n):
        base = np.random.default_rng(i % 12).normal(size=dim)
        out.append((f"b{i % 3}", f"{i:05d}", (base + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2])).dot(rng.uniform(0.1, 30)).tolist(), int(rng.integers(1, 5))))
    out += [("b0", "zero", [0.0] * dim, 2), ("b0", "zero2", [0.0] * dim, 1), ("b0", "nan", [float("nan")] * dim, 1), ("b1", "null", [None] + [1.0] * (dim - 1), 1), ("b1", "short", [1.0], 7), ("b1", "short2", [2.0], 1), (None, "x", [1.0], 1), (None, "y", [1.0], 1)]
    return out


def brute(rows):
    pairs = {}
    for (k, i, v, m), (l, j, w, n) in itertools.combinations(sorted(rows, key=lambda r: r[1]), 2):
        if k is None or k != l or len(v) != len(w) or None in v or None in w:
            continue
        x, y = np.array(v), np.array(w)
        size = np.sqrt(x @ x) * np.sqrt(y @ y)
        if size > 0 and x @ y / size >= T:
            pairs[i, j] = x @ y / size, m, n
    return pairs


@pytest.mark.parametrize("small,block,strip", [(256, 8192, 512), (5, 8192, 7), (0, 16, 512)])
def test_threshold_join_equals_brute_force(spark, monkeypatch, small, block, strip):
    monkeypatch.setattr(near, "SMALL", small), monkeypatch.setattr(near, "BLOCK", block), monkeypatch.setattr(near, "STRIP", strip)
    rows = rows_of(np.random.default_rng(5), 240)
    df = spark.createDataFrame(rows, "bucket string, id string, vector array<double>, many long").withColumn("extra", F.lit(1))
    want = brute(rows)
    got = near.near_pairs(df.drop("many"), T).collect()
    assert len(got) == len(want) > 300 and {(r.a, r.b) for r in got} == set(want)
    assert all(abs(r.cosine - want[r.a, r.b][0]) < 1e-12 for r in got)
    counts = {}
    for (a, b), (_, m, n) in want.items():
        counts[a], counts[b] = counts.get(a, 0) + n, counts.get(b, 0) + m
    assert {r.id: r.n for r in near.near_counts(df, T).collect()} == counts


def test_nothing_to_join(spark):
    empty = spark.createDataFrame([], "bucket string, id string, vector array<double>, many long")
    assert near.near_pairs(empty, T).count() == 0 and near.near_counts(empty, T).count() == 0
    with pytest.raises(ValueError):
        near.near_pairs(empty, 0.0)


def test_links_of_one_hot_bucket_need_no_pairs(spark):
    """4,000 copies and near copies of one posting: 8 million pairs, told in a row each."""
    n = 4_000
    vector = F.array(F.lit(1.0), F.when(F.col("id") % 10 == 0, F.col("id") / 1e7).otherwise(0.0))
    df = spark.range(n).select(F.concat(F.lit("lever:x:"), "id").alias("external_id"), F.lit("Acme").alias("company"), F.lit("Cook").alias("title"), F.lit("").alias("location"), F.lit("").alias("description"), F.lit(True).alias("is_active"), vector.alias("vector"))
    got = dedupe.duplicate_links(df).collect()
    assert len(got) == n and {r.links for r in got} == {n - 1} and len({r.class_id for r in got}) == n // 10


def test_copies_are_members_and_no_link_is_lost(spark):
    """Pairs of classes and membership tell all pairs, in a row for each copy and each pair of different vectors."""
    vector = F.array(F.lit(1.0), F.element_at(F.array(F.lit(0.0), F.lit(-0.0), F.lit(0.1), F.lit(5.0)), (F.col("id") % 4 + 1).cast("int")))
    df = spark.range(120).select(F.concat(F.lit("lever:x:"), "id").alias("external_id"), F.lit("Acme").alias("company"), F.element_at(F.array(F.lit("Cook"), F.lit("Nurse")), (F.col("id") % 3 % 2 + 1).cast("int")).alias("title"), F.lit("").alias("location"), F.lit("").alias("description"), F.lit(True).alias("is_active"), vector.alias("vector"))
    df = df.unionByName(df.limit(2).withColumn("external_id", F.concat(F.lit("zero:"), "external_id")).withColumn("vector", F.array(F.lit(0.0), F.lit(0.0))))
    rows = dedupe.duplicate_classes(df).collect()
    assert len(rows) < 130
    of = {r.b: r.a for r in rows if r.copy}
    links = {frozenset((r.a, r.b)) for r in rows if not r.copy}
    sound = [r.point_id for r in dedupe.bucketed(df).filter("vector[0] > 0").select("point_id").collect()]
    got = set()
    for a, b in itertools.combinations(sorted(sound), 2):
        x, y = of.get(a, a), of.get(b, b)
        if x == y or frozenset((x, y)) in links:
            got.add((a, b))
    assert got == {(r.a, r.b) for r in dedupe.duplicate_pairs(df).collect()} and len(got) > 1_000


def test_names_are_told_once_and_vectors_of_first_postings_alone_are_kept(spark, monkeypatch):
    """400 postings of two companies, two titles and three remote statuses (one of them null, one the text "null"): four pairs of names, 12 classes."""
    made = {}
    keep = dedupe.kept
    monkeypatch.setattr(dedupe, "kept", lambda df, tag: made.setdefault(tag, keep(df, tag)))
    pick = lambda step, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("id") / step) % len(values) + 1).cast("int"))
    df = spark.range(400).select(
        F.concat(F.lit("lever:x:"), "id").alias("external_id"), pick(1, "Acme", "Zed").alias("company"), pick(2, "Cook", "Nurse").alias("title"), F.lit("").alias("location"), F.lit("text").alias("description"), F.lit("lever").alias("source"),
        F.lit(1.0).alias("salary_max"), F.lit("").alias("country"), pick(4, None, "null", "remote").alias("remote_status"), F.lit(True).alias("is_active"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"),
    )
    got = dedupe.dedupe_postings(df).collect()
    assert made["names"].count() == 4 and made["alike"].count() == 12 and "vector" not in made["classed"].columns
    assert made["alike"].agg(F.sum("many")).first()[0] == 400
    known = [r for r in df.collect() if r.remote_status is not None]
    assert len(got) == len(known) - 8 and len({r.canonical_id for r in got}) == 8  # without a remote status a posting has no bucket


@pytest.mark.parametrize("members", [256, 3])
def test_all_pairs_of_postings_are_told_copies_as_well(spark, monkeypatch, members):
    """Copies, near copies on either side of the threshold, vectors without direction, negative zeros, postings of one id and without a bucket: as by brute force."""
    monkeypatch.setattr(near, "MEMBERS", members)
    rng = np.random.default_rng(11)
    kinds = [[1.0, 0.0], [1.0, -0.0], [2.0, 0.0], [1.0, 0.2], [1.0, 0.21], [0.0, 1.0], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [1.0], None]
    rows = [(f"lever:x:{i if i < 80 else i - 20}", "Acme", "Cook" if i % 5 else "Nurse", "", None if i % 19 == 7 else "remote", True, kinds[rng.integers(len(kinds))]) for i in range(100)]
    df = spark.createDataFrame(rows, "external_id string, company string, title string, country string, remote_status string, is_active boolean, vector array<double>")
    found = dedupe.bucketed(df).filter("vector is not null and _remote is not null").select("_title", "point_id", "vector").collect()
    want = []
    for x, y in itertools.combinations(found, 2):
        v, w = x.vector, y.vector
        if x._title == y._title and x.point_id != y.point_id and len(v) == len(w) and None not in v and None not in w:
            p, q = np.array(v), np.array(w)
            size = np.sqrt(p @ p) * np.sqrt(q @ q)
            if size > 0 and p @ q / size >= T:
                want.append((*sorted((x.point_id, y.point_id)), round(float(p @ q / size), 12)))
    got = [(r.a, r.b, round(r.cosine, 12)) for r in dedupe.duplicate_pairs(df).collect()]
    assert sorted(got) == sorted(want) and len(want) > 300


def test_registered_pairs_are_those_that_links_count(spark):
    from hirelake.plans import registry

    pairs = registry.j06_duplicate_pairs(spark, "/root/testdata/sf0.001")
    links = registry.j06_duplicate_links(spark, "/root/testdata/sf0.001").agg(F.sum("links")).first()[0]
    assert pairs.columns == ["a", "b"] and 2 * pairs.distinct().count() == 2 * pairs.count() == links > 0
