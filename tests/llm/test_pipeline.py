import random
import re
import uuid

import public_tokenizers
import sentencepiece
from test_jaccard import brute as components
from test_others import folded

import corpus_pipeline
from hirelake.llm import language_id
from hirelake.llm.decontamination import ERROR_RATE, best_match
from hirelake.llm.shared import shared_folder

ITEM = "Completely unlikely benchmark passage number one about violet turbines and hollow lanterns by the estuary."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(spark, docs, items):
    """(doc_id, ids, text) that stay, in plain loops; only the language model is the library's (tested by itself)."""
    model = language_id.fit(spark.createDataFrame(docs, SCHEMA))
    rejected = [r.rejected for r in language_id.predict(spark.createDataFrame(docs, SCHEMA).coalesce(1), model).collect()]
    docs = [d for d, r in zip(docs, rejected) if not r]
    groups = {}
    for d in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", d[1]), []).append(d)
    docs = [min(g, key=lambda d: (-len(d[1]), d[0])) for g in groups.values()]
    docs = [d for d in docs if dict((i, c) for i, _, c in components([x[:2] for x in docs]))[d[0]] == d[0]]
    clean = lambda t: all(best_match(folded(i), folded(t))[0] > int(len(folded(i)) * ERROR_RATE) for i in items)
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return sorted((d[0], pieces.encode(d[1]), pieces.decode(pieces.encode(d[1]))) for d in docs if clean(d[1]))


def written(spark, docs, items, folder):
    spark.createDataFrame(docs, SCHEMA).withColumnRenamed("n_chars", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) between 200 and 6000").orderBy("doc_id").limit(60).collect()
    docs = [(i, r.text, r.lang, r.source, len(r.text)) for i, r in enumerate(source)]
    for k in range(20):  # near and exact copies
        words = docs[k][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        docs += [(100 + k, " ".join(words), "en", "s", 1), (130 + k, docs[k][1].replace(" ", "  ", k % 3), "en", "s", 1)]
    docs += [(200, docs[0][1] + " ", "en", "s", 1), (201, None, None, None, None), (202, "### 12 !!", "en", "s", 9), (203, docs[40][1][:300] + " " + ITEM.upper() + " of the and", "en", "s", 1), (204, "", "en", "s", 0)]
    got = written(spark, docs, [(1, ITEM), (2, None)], tmp_path)
    want = brute(spark, docs, [ITEM])
    assert sorted((r.doc_id, list(r.ids), r.decoded) for r in got) == want
    assert {r.doc_id for r in got}.isdisjoint({201, 202, 203, 204}) and len(want) > 20
    assert all(r.n_tokens == len(r.ids) for r in got) and len(corpus_pipeline.STAGES) == 5


def test_empty_tables_and_repeated_rows(spark, tmp_path):
    assert written(spark, [], [], tmp_path / "a") == []
    text = "The old house stood at the end of the road and nobody had lived there for years. " * 4
    got = written(spark, [(1, text, "en", "s", 1)] * 3 + [(None, text + "x", "en", "s", 1)], [(1, ITEM)], tmp_path / "b")
    assert sorted(str(r.doc_id) for r in got) in (["1"], ["None"], ["1", "None"]) and len(got) <= 2


def test_input_under_the_checkpoint_folder_stays(spark):
    folder = f"{shared_folder(spark)}/input-{uuid.uuid4().hex}"
    text = "The old house stood at the end of the road and nobody had lived there for years. " * 4
    written(spark, [(1, text, "en", "s", 1), (2, text + "more", "en", "s", 1)], [(1, ITEM)], folder)
    assert spark.read.parquet(f"{folder}/documents.parquet").count() == 2 and spark.read.parquet(f"{folder}/benchmark.parquet").count() == 1
