import math
import random
from collections import Counter

import numpy as np

from hirelake.llm import language_id


def brute(text, model):
    """(language, cosine) by counting n-grams one at a time; n-grams fall into the model's dimensions by its rule."""
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    squeezed = "".join(c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " ")
    counts = Counter()
    for i, c in enumerate(squeezed):
        grams = [ord(c)] if c != " " else []
        if i >= 1:
            grams.append(ord(c) * 257 + ord(squeezed[i - 1]) + (1 << 20))
        if i >= 2:
            grams.append(ord(c) * 66049 + ord(squeezed[i - 1]) * 257 + ord(squeezed[i - 2]) + (1 << 21))
        for g in grams:
            counts[(g * int(language_id._MIX) % 2**32) >> 20] += 1
    weights = {d: math.log1p(n) * float(model.idf[d]) for d, n in counts.items()}
    size = math.sqrt(sum(w * w for w in weights.values()))
    cosines = [sum(w * float(c[d]) for d, w in weights.items()) / size for c in model.centroids]
    best = max(range(len(cosines)), key=lambda i: cosines[i])
    return model.languages[best], cosines[best]


def test_predictions_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(language_id.learned_rows(docs), centroids=3)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)
    rng = random.Random(1)
    texts = [r.text for r in docs.collect() if r.text and any(map(str.isalpha, r.text))][:80]
    texts += ["".join(rng.choice("abcdeé ß.1\nÀñ漢🙂") for _ in range(rng.randint(1, 40))) + "x" for _ in range(80)] + ["a", "A", "é é", "x" * 5000]
    rows = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        lang, cosine = brute(r.text, model)
        assert abs(r.score - max(0.0, min(1.0, cosine))) < 1e-4, r.text
        assert r.lang_pred == lang or abs(r.score - cosine) < 1e-5


def test_odd_rows(spark):
    rows = [(1, None, "en"), (1, "the and of", "en"), (1, "the and of", "en"), (None, "the and of", None), (2, "", "en"), (3, "der und das ist nicht ein Haus", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "lang as lang_pred", "1 as rejected")
    model = language_id.fit(df)
    got = language_id.predict(df, model).collect()
    assert len(got) == 6 and [r.lang_pred for r in got if not r.text] == ["und", "und"]
    assert {r.lang_pred for r in got if r.text == "the and of"} == {"en"} and {r.lang_pred for r in got if r.doc_id == 3} == {"de"}
    assert language_id.predict(df.limit(0), model).count() == 0
