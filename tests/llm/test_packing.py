"""Packing: every id in one piece, windows full, plans by least squares, texts tokenised as the library does it."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from hirelake.llm import packing, queries

SF = "/root/testdata/sf0.01"


def library_ids(texts):
    full = Tokenizer.from_file(queries.word_tokenizer())
    return [[*full.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]


def hold_against_library(docs, pieces):
    """``docs``: (doc_id, text), ids may repeat only with equal texts; ``pieces``: rows of pack."""
    ids = dict(zip([d for d, _ in docs], library_ids([t for _, t in docs])))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    copies = {d: sum(x == d for x, _ in docs) for d, _ in docs}
    for d, parts in by_doc.items():
        covered = np.zeros(len(ids[d]), int)
        for a, n in parts:
            covered[a : a + n] += 1
        assert (covered == copies[d]).all()
    assert set(by_doc) == set(ids)
    for parts in by_sequence.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    return by_sequence


@pytest.fixture(scope="module")
def packed(spark):
    return queries.op13_packing(spark, SF).collect()


def test_the_query_packs_every_id_of_the_table_once(spark, packed):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sequences = hold_against_library(docs, packed)
    assert sum(sum(n for _, n in s) != 2048 for s in sequences.values()) <= 11  # only the last ids
    cut = len(packed) - len(docs) - sum(p.length == 2048 and p.start % 2048 == 0 for p in packed)
    whole = sum(p.start % 2048 == 0 and p.start + p.length == p.doc_tokens for p in packed)
    assert whole > 0.85 * len(docs), (whole, cut)  # most tails are not cut: combinations took them


def test_nulls_empty_long_and_repeated_texts(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x" * 9000), (5, "wörter und don't <|endoftext|> ÉTÉ, été   中文 '' 123."), (6, "word " * 5000), (7, "\t\n ")]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, row string, block int")
    hold_against_library(docs, packing.pack(df, queries.word_tokenizer()).collect())


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), queries.word_tokenizer()).count() == 0


def test_equal_lengths_over_many_tasks(spark):
    docs = [(i, "one two three four five six seven " * (7 + 40 * (i % 3 == 0))) for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(13)
    sequences = hold_against_library(docs, packing.pack(df, queries.word_tokenizer()).collect())
    assert sorted(sequences) == list(range(len(sequences)))


def test_sequences_hold_their_ids(spark):
    docs = [(i, "alpha beta, gamma " * (i * 13 % 900)) for i in range(60)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), queries.word_tokenizer(), with_ids=True)
    rows = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(pieces).collect()}
    ids = dict(zip([d for d, _ in docs], library_ids([t for _, t in docs])))
    for p in pieces.collect():
        assert rows[p.sequence_id][p.offset : p.offset + p.length] == ids[p.doc_id][p.start : p.start + p.length]


def test_words_are_told_apart_as_the_library_does(spark):
    import pyarrow as pa

    texts = ["Hello, world!", "don't can't 's 'S we'll", "a" * 300 + ".", "Ünïcode ß ÿ İstanbul", "12ab cd34 x,y ...", "", " ", "a\x1cb c d e\x85f", "naïve; façade: ¿qué? (x) <|startoftext|>y", "ſ ﬁ Å ë"]
    encoder = packing.WordEncoder(queries.word_tokenizer())
    for _ in range(2):  # words fresh, then known
        ids, ends = encoder.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [x[:-1] for x in library_ids(texts)]


def test_least_squares_meets_the_conditions_of_a_minimum():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 3, (8, 30)).astype(float), rng.integers(0, 50, 8).astype(float)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6 * np.abs(b).max()).all() and np.abs(slope[x > 1e-9]).max(initial=0) <= 1e-6 * np.abs(b).max()


def test_plans_use_no_tail_twice_and_leave_enough_to_fill_up():
    rng = np.random.default_rng(2)
    for scale in (0, 1, 30, 10**6):
        lengths = np.minimum(2047, rng.geometric(0.002, 500))
        histogram = [0] * (packing.CLASSES + 1)
        for n in lengths.tolist():
            histogram[-(-n // 32)] += scale
        plan = packing.window_plan(histogram, int(lengths.sum()) * scale)
        used = [sum(parts.count(c) * times for parts, times in plan) for c in range(packing.CLASSES + 1)]
        assert all(u <= h for u, h in zip(used, histogram)) and all(sum(parts) == packing.CLASSES for parts, _ in plan)
        assert sum(times for _, times in plan) <= int(lengths.sum()) * scale // 2048
        if scale >= 30:
            assert sum(used) > 0.8 * sum(histogram)
