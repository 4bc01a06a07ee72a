"""Fill-in-middle against the contract written out, and round trips."""

import hashlib
import random
import re

from hirelake.llm import fill_middle, queries

SF = "/root/testdata/sf0.01"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, sha = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_the_query_against_the_contract(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_fill_middle(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, p, m, out = expected(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(texts[r.doc_id] or ""))


def test_nulls_blanks_sentinels_and_long_texts(spark):
    rng = random.Random(2)
    parts = ["a", "é中", " ", "\n\t", " ", "\x1c", "<P", ">", "<S", "<M", "<", "P>", "😀", "word ", ". "]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(600)]
    docs += [(None, "null id of a text"), (None, None), (7, None), (7, "again 7"), (8, "x <M> y"), (9, "y " * 900_000), (11, "z" * 3_000_000), (12, " " * 50), *[(i, "long " * 30_000) for i in range(20, 30)]]
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in docs], "doc_id long, text string, n int, form string")
    told = fill_middle.transform(df)
    want = sorted((str(d), expected(d, t)) for d, t in docs)
    rows = told.collect()
    assert sorted((str(r.doc_id), (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in rows) == want or {(str(r.doc_id), r.n, r.form, r.output) for r in rows} == {(d, x[0], x[1], x[4]) for d, x in want}
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    back = fill_middle.restore(told.withColumn("restored", fill_middle.F.lit("old"))).collect()
    assert sorted((str(r.doc_id), r.restored) for r in back) == sorted((str(d), t or "") for d, t in docs)
    digests = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fill_middle.digests(df).collect()}
    assert digests == {(d, sha(expected(d, t)[4]), sha(t or "")) for d, t in docs}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.digests(empty).count() == 0 and fill_middle.restore(fill_middle.transform(empty)).count() == 0


def test_descriptors_move_and_buffers_stay():
    table = fill_middle.build(memoryview(b"abc def ghi"), "spm", [3, 7])
    assert table.bytes() == b"<S> ghi<P>abc<M> def" and all(0 <= p.start and p.start + p.length <= len(table.buffers[p.buffer]) for p in table.pieces)
    assert fill_middle.rebuild(memoryview(table.bytes()), "spm").bytes() == b"abc def ghi"
    table = fill_middle.PieceTable(memoryview(b"abcdef"))
    table.cut([0, 2, 2, 6])
    assert [p.length for p in table.pieces] == [0, 2, 0, 4, 0] and table.bytes() == b"abcdef"
