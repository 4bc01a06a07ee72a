import hashlib
import re

from hirelake.llm import exact_dedup
from hirelake.llm.exact_dedup import drop_exact_copies, exact_groups

ROWS = [(1, "a b", 1), (1, "a b", 1), (None, None, 3), (2, "", 4), (3, "ab", 5), (3, " ab  ", 6), (4, "x" * 300, 7), (5, "x" * 299 + " x", 8), (6, "x" * 301, 9), (7, "é\n🙂" * 90, 10), (8, "é🙂" * 90, 11)]
SCHEMA = "doc_id long, text string, keep_id int"  # a clashing name


def test_groups_match_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    got = exact_groups(df, block_chars=16).collect()
    assert len(got) == len(ROWS)
    for r in got:
        peers = [x for x in ROWS if hashlib.sha256(norm(x[1]).encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(peers)
        best = max(len(x[1] or "") for x in peers)
        assert r.keep_id == min((x[0] for x in peers if len(x[1] or "") == best), key=lambda i: (i is not None, i))
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted({r.text_sha256 for r in got})


def test_block_size_does_not_matter(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    a, b = (sorted(map(str, exact_groups(df, block_chars=k).collect())) for k in (7, 4096))
    assert a == b


def test_drop_keeps_one_of_each(spark):
    out = drop_exact_copies(spark.createDataFrame(ROWS, SCHEMA), block_chars=16)
    assert out.columns == ["doc_id", "text", "keep_id"]
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect()) == [(False, 0), (True, 3), (True, 5), (True, 6), (True, 7)]


def test_names_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RANGE_ROWS", 3)
    df = spark.createDataFrame([(k, "ab" * (k % 7) + "c" * (k % 3) * 600) for k in range(60)], "key long, norm string")
    a, b = ({r.key: (r.n_blocks, r.name) for r in exact_dedup.text_names(d, 16).collect()} for d in (df.repartition(7), df.coalesce(1)))
    assert a == b and all((a[i] == a[j]) == (x == y) for i, x in df.collect() for j, y in df.collect())


def test_long_texts_of_many_default_blocks(spark):
    long = "abcdefg " * 40_000
    rows = [(1, long, {"k": 1}), (2, long + " ", {"k": 2}), (3, long + "x", {}), (3, long + "x", {"k": 3}), (3, long + "x", {}), (4, long[:-2] + "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _digest map<string, int>")
    assert sorted(r.doc_id for r in drop_exact_copies(df).collect()) == [2, 3, 4]
    assert sorted((r.doc_id, r.group_size) for r in exact_groups(df).collect()) == [(1, 2), (2, 2), (3, 3), (3, 3), (3, 3), (4, 1)]


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
