import random

import public_tokenizers
import pytest
import sentencepiece

from hirelake.llm import sentencepiece_codec
from hirelake.llm.sentencepiece_codec import decode, encode, encode_and_decode

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library(spark, library):
    rng = random.Random(3)
    texts = ["", " ", "  ", " " * 15, " " * 31, " " * 100 + "the", "▁x", "<unk>", "<s>", "<0x0A>", "a\x00b", "a" * 700, "ab" * 400, "é" * 600, "=====-----" * 30, "123456", "🙂", "héllo 🙂\n\tworld "]
    texts += ["".join(rng.choice("abcdefgh  \n\t01éñ漢🙂▁.,'AB") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    texts += ["".join(rng.choice(["the", "ing", " ", "  ", "on", "er", "re", "he", "in", "tion"]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decode(encode(df, PATH), PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(r.text)
        assert r.ids == ids, r.text
        assert r.decoded == library.decode(ids), r.text


def test_long_words_and_documents_equal_the_library(spark, library):
    import base64

    rng = random.Random(7)
    long = ["".join(rng.choice(a) for _ in range(n)) for a, n in (("abcdefghijklmnopqrstuvwxyz", 60_000), ("漢字仮名交文書日本語", 60_000), ("01 \n", 30_000), ("aAbB{}();=.\t", 40_000), ("▁ a", 20_000), ("=-", 30_000))]
    long += [base64.b64encode(rng.randbytes(60_000)).decode(), "thequickbrownfoxjumpsoverthelazydog" * 2000, "a" * 50_000, "ab" * 30_000 + "c", "internationalisation" * 1000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    for r in encode_and_decode(df, PATH).collect():
        ids = library.encode(r.text)
        assert r.ids == ids, r.text[:40]
        assert r.decoded == library.decode(ids)


def test_documents_equal_the_library_whatever_the_table_keeps(spark, library, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for kept in (100, 1_000_000):
        monkeypatch.setattr(sentencepiece_codec, "KEPT_CHARS", kept)
        for r in encode_and_decode(docs, PATH).collect():
            ids = library.encode(r.text or "")
            assert r.ids == ids and r.decoded == library.decode(ids)


def test_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a", "y"), (2, "a", "y")], "doc_id long, text string, ids string")
    rows = decode(encode(df, PATH), PATH).orderBy("doc_id").collect()
    assert [r.ids for r in rows][0] == [] and rows[0].decoded == "" and rows[1] == rows[2]
    assert encode(df.limit(0), PATH).count() == 0
    assert sorted(map(str, encode_and_decode(df, PATH).collect())) == sorted(map(str, rows))
