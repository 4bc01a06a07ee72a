import random
from collections import Counter

import pytest

from hirelake.llm.suffix_dedup import LENGTH, intervals, joined_spans, remove_repeats


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[a : a + LENGTH] for _, b in texts for a in range(len(b) - LENGTH + 1))
    out = []
    for i, b in texts:
        cover = bytearray(len(b))
        for a in range(len(b) - LENGTH + 1):
            if seen[b[a : a + LENGTH]] > 1:
                cover[a : a + LENGTH] = b"\1" * LENGTH
        spans, last = [], 0
        for k, c in enumerate(cover):
            if c and not last:
                spans.append([k, k + 1])
            elif c:
                spans[-1][1] = k + 1
            last = c
        out.append((i, len(b), tuple(map(tuple, spans)), bytes(x for x, c in zip(b, cover) if not c)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = [piece(n) for n in (190, 199, 200, 201, 260, 330, 500, 1200)]
    out = []
    for i in range(120):
        t = "".join(piece(rng.randint(0, 150)) + rng.choice(shared)[rng.randint(0, 20) :][: rng.randint(150, 1300)] for _ in range(rng.randint(0, 4)))
        out.append((i, t + piece(rng.randint(0, 50))))
    out += [(1000, "a" * 199), (1001, "a" * 200), (1002, "a" * 350), (1003, "ab" * 300), (1004, None), (1005, ""), (1006, shared[-1]), (1007, shared[-1]), (1008, "xyz " * 90), (1009, piece(90) + "xyz " * 60)]
    return out


@pytest.mark.parametrize("frequent", [50_000, 3])
def test_matches_brute_force(spark, rows, frequent):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in remove_repeats(df, frequent=frequent).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_intervals_are_those_of_the_tree():
    # Suffixes of a sorted array with these common prefixes of neighbours.
    assert sorted(intervals([3, 1, 2])) == [(1, 0, 3), (2, 2, 3), (3, 0, 1)]
    import numpy as np

    assert joined_spans(np.array([[5, 9], [0, 2], [8, 12], [2, 3]])).tolist() == [[0, 3], [5, 12]]
