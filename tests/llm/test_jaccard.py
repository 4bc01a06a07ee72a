import random
import re
from collections import defaultdict

import numpy as np
import pytest

from hirelake.llm import jaccard_join
from hirelake.llm.components import connected_components
from hirelake.llm.jaccard_join import Inverted, counted_below, drop_near_copies, heap_merge, jaccard_components, required


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if o and 100 * o >= 80 * (len(a) + len(sets[j]) - o):
                parent[root(j)] = root(i)
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(rows):
        if sets[k]:
            least[root(k)] = min(least[root(k)], i)
    return sorted((i, len(sets[k]), least[root(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(10):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 12, 40, 120, 170, 300]))]
        for _ in range(rng.choice([2, 5, 30])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 28))):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append((len(out), " ".join(w)))
    shared = [rng.choice(words) for _ in range(60)]
    for _ in range(60):
        out.append((len(out), " ".join([rng.choice(words) for _ in range(rng.randint(0, 40))] + shared + [rng.choice(words) for _ in range(rng.randint(0, 80))])))
    return out + [(100000, None), (100001, ""), (100002, "  \n"), (100003, "One two"), (100004, "one  TWO"), (100004, "one  TWO")]


@pytest.mark.parametrize("most", [250_000, 1500])
def test_components_match_brute_force(spark, rows, most):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    assert sorted(tuple(r) for r in jaccard_components(df, block_shingles=most).collect()) == brute(rows)


def test_one_of_each_component_stays(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in drop_near_copies(df).collect()} == {c for _, _, c in brute(rows)}
    assert jaccard_components(df.limit(0)).count() == 0


def test_search_equals_counting():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(200)]
    index = Inverted(sets)
    for q in sets:
        want = [k for k, s in enumerate(sets) if len(np.intersect1d(q, s)) >= required(len(q), len(s))]
        assert index.search(q).tolist() == want


def test_heap_merge_counts_every_list():
    rng = np.random.default_rng(6)
    lists = [np.unique(rng.integers(0, 300, rng.integers(0, 200)).astype(np.int32)) for _ in range(40)]
    for step in (1, 7, 4096):
        parts = list(heap_merge(lists, step))
        docs, counts = (np.concatenate(x) for x in zip(*parts))
        want = np.unique(np.concatenate(lists), return_counts=True)
        assert (docs == want[0]).all() and (counts == want[1]).all()


def test_counted_part_falls_with_size():
    shares = [int(counted_below(n)) for n in range(1, 3000)]
    assert shares == sorted(shares, reverse=True) and shares[-1] > 0.2 * 2**64


def test_flushes_and_other_ids(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FLUSH", 300)
    kept = [(i, t) for i, t in rows if i < 30000]
    df = spark.createDataFrame(kept, "doc_id smallint, text string")
    assert sorted(tuple(r) for r in jaccard_components(df).collect()) == brute(kept)
    named = spark.createDataFrame([(f"{i:06}", t) for i, t in kept], "doc_id string, text string")
    assert sorted((int(a), n, int(c)) for a, n, c in jaccard_components(named).collect()) == brute(kept)


def test_null_ids_and_long_texts(spark):
    long = " ".join(f"w{i % 70000}" for i in range(300_000))
    df = spark.createDataFrame([(None, long), (None, long + " x"), (None, "a b c d e f"), (5, long), (6, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = {tuple(r) for r in jaccard_components(df).collect()}
    assert got == {(None, 70000, 5), (None, 70001, 5), (5, 70000, 5), (None, 2, 6), (6, 2, 6), (None, 0, None)}


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    labels = {r.node: r.label for r in connected_components(edges).collect()}
    assert {labels[i] for i in range(61)} == {0} and labels[101] == 100


def test_sets_that_come_twice(spark, rows, monkeypatch):
    """Repeated rows in one task, and the same sets from several tasks, as after the split of a hot id."""
    few = rows[:40]
    many = few + few[:3] * 20
    table = spark.createDataFrame(many, "doc_id long, text string")
    want = brute(many)
    assert sorted(map(tuple, jaccard_components(table).collect())) == want
    plain = jaccard_join._full_sets

    def twice(batches):
        batches = list(batches)
        yield from plain(iter(batches))
        yield from plain(iter(batches))

    monkeypatch.setattr(jaccard_join, "_full_sets", twice)
    assert sorted(map(tuple, jaccard_components(table).collect())) == want
