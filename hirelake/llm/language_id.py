"""Language identification by nearest centroids of TF-IDF character n-grams.

A text becomes hashed counts of its character 1- to 3-grams (letters in lower case, runs of anything else as one blank), damped,
weighted by inverse document frequency and normalised. Each language is described by several centroids, found by
spherical k-means; a text takes the language of the centroid with the largest cosine. A text is rejected if its cosine falls
below what all but a stated share of that language's own texts of its length reach when they are held out.

The model is fitted on a bounded sample of the labelled rows (about ``per_language`` of each, chosen by a hash of the id) and has a
fixed size, so it travels with the tasks.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.shared import give_back, small_batches, staged

DIMENSIONS = 4096
UNKNOWN = "und"
SAMPLE_PARTITIONS = 8
#: Lengths in code points at which floors are set; between them they are interpolated by the logarithm. The last stands for whole texts.
LENGTHS = (5, 10, 20, 40, 80, 160, 320, 640, 1280)
_MIX = np.uint32(0x9E3779B1)
#: Code points of a text are counted in pieces of this length, which overlap so that no n-gram is lost.
PIECE = 1 << 18


@dataclass
class LanguageModel:
    languages: list  # language of each centroid
    centroids: np.ndarray  # centroids x DIMENSIONS, normalised
    floors: np.ndarray  # centroids x LENGTHS, least cosine accepted by each centroid at each length
    idf: np.ndarray


def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, else a blank."""
    table = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low[0])
    return table


def _grams(text: str, table: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams of the whole text; all zero if it has no letter."""
    counts = np.zeros(DIMENSIONS, np.int64)
    before = np.zeros(0, np.uint32)
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        kept = points < 0x10000
        low = np.where(kept, table[np.minimum(points, 0xFFFF)], 32)
        if not kept.all():
            for i in np.flatnonzero(~kept).tolist():
                if chr(points[i]).isalpha():
                    low[i] = ord(chr(points[i]).lower()[0])
        low = low.astype(np.uint32)
        joined = np.r_[before, low]
        joined = joined[np.r_[True, (joined[1:] != 32) | (joined[:-1] != 32)]]
        fresh = len(before)  # n-grams that lie in the part already counted are left out
        one, two, three = joined, joined[1:] * np.uint32(257) + joined[:-1] + np.uint32(1 << 20), None
        three = joined[2:] * np.uint32(66049) + joined[1:-1] * np.uint32(257) + joined[:-2] + np.uint32(1 << 21) if len(joined) > 2 else joined[:0]
        new1 = one[fresh:]
        grams = np.concatenate([new1[new1 != 32], two[max(0, fresh - 1) :], three[max(0, fresh - 2) :]])
        counts += np.bincount(((grams * _MIX) >> np.uint32(20)).astype(np.int64), minlength=DIMENSIONS)
        before = joined[-2:]
    return counts


def _vectors(texts: list, idf: np.ndarray | None, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised vectors (raw damped counts without ``idf``) and which texts have a letter."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    some = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        if text:
            counts = _grams(text, table)
            some[i] = any(c.isalpha() for c in text)
            out[i] = np.log1p(counts)
    if idf is not None:
        out *= idf
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out /= np.where(norm > 0, norm, 1)
    return out, some


def _kmeans(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out first centres; centres and each row's cosine with its own."""
    centres = [x.mean(axis=0)]
    near = x @ centres[0] / max(float(np.linalg.norm(centres[0])), 1e-9)
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argsort(near, kind="stable")[len(x) // 10])])  # far, but no outlier
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c, x @ c.T


def _floors(texts: list, idf: np.ndarray, table: np.ndarray, centroids: int, rounds: int, false_rejections: float) -> list:
    """For each of LENGTHS, the cosine that all but a share ``false_rejections`` of one language's texts, cut to that length, reach.

    The texts are scored in two halves, each with centroids of the other. With fewer than 1 / ``false_rejections`` texts the tail is
    not seen; the least cosine is then lowered in proportion. A length that no text has takes the floor of the length before it.
    """
    halves = [texts[0::2], texts[1::2]]
    fitted = []
    for half in halves:
        x, some = _vectors(half, idf, table)
        fitted.append(_kmeans(x[some], centroids, rounds)[0] if some.any() else None)
    floors = []
    for n in LENGTHS:
        last = n == LENGTHS[-1]
        best = []
        for half, c in zip(halves, fitted[::-1]):
            x, some = _vectors([t if last else t[:n] for t in half if len(t) >= (LENGTHS[-2] if last else n)], idf, table)
            if c is not None and some.any():
                best.append((x[some] @ c.T).max(axis=1))
        if not best:
            floors.append(floors[-1] if floors else 0.0)
            continue
        cos = np.sort(np.concatenate(best))
        at = int(len(cos) * false_rejections)
        floors.append(float(cos[at] if at else cos[0] * len(cos) * false_rejections))
    return floors


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000, centroids: int = 4, false_rejections: float = 0.01, rounds: int = 8) -> LanguageModel:
    """Fit on about ``per_language`` rows of each language, chosen by a hash of id; rows with a null language or text are left out.

    ``floors``: at each length, all but a share ``false_rejections`` of the language's own texts reach them when held out.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return LanguageModel([], np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, len(LENGTHS))), np.ones(DIMENSIONS, np.float32))
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, per_language / v))])
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    # The sample is bounded, so it fits a few partitions; the scan that draws it keeps all of its tasks.
    sample = staged(rows.filter(draw < F.element_at(share, F.col("lang"))).select("lang", "text").repartition(SAMPLE_PARTITIONS), "sample")
    table = _letters()

    def summed(batches):
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(1):
                total += _grams(text.as_py(), table) > 0
                n += 1
        yield pa.RecordBatch.from_pydict({"df": [total.tolist()], "n": [n]})

    df, n = np.zeros(DIMENSIONS), 0
    for r in sample.mapInArrow(summed, "df array<long>, n long").collect():  # a row of fixed size for each of a few partitions
        df, n = df + np.array(r["df"]), n + r["n"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def cluster(key, group):
        texts = sorted(group.column("text").to_pylist(), key=lambda t: zlib.crc32(t.encode("utf-8", "surrogatepass")))  # whatever order rows arrive in, near copies apart
        x, some = _vectors(texts, idf, table)
        x = x[some] if some.any() else x
        c, _ = _kmeans(x, centroids, rounds)
        floors = [_floors(texts, idf, table, centroids, rounds, false_rejections)] * len(c)
        return pa.table({"lang": [key[0].as_py()] * len(c), "floor": pa.array(floors, pa.list_(pa.float64())), "centroid": pa.array(list(c.astype(np.float32)), pa.list_(pa.float32()))})

    # A group is a bounded sample of one language.
    found = sample.groupBy("lang").applyInArrow(cluster, "lang string, floor array<double>, centroid array<float>").collect()
    found = sorted(found, key=lambda r: (r["lang"], r["centroid"]))
    return LanguageModel([r["lang"] for r in found], np.array([r["centroid"] for r in found], np.float32), np.array([r["floor"] for r in found]), idf)


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score (cosine, 0 to 1) and rejected.

    Whole texts are read. A null text or one without letters gives ``und``, score 0, rejected. A rejected text with letters
    still names its nearest language. Ties go to the language first in the alphabet. Columns of these names are replaced.
    Rows are independent; a model without languages answers ``und``.
    """
    small_batches(df.sparkSession)
    df = df.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    at, table = df.columns.index(text_col), _letters()

    def run(batches):
        for batch in batches:
            langs, scores, rejected = [], [], []
            for first in range(0, batch.num_rows, 256):
                x, some = _vectors(batch.column(at).slice(first, 256).to_pylist(), model.idf, table)
                some &= bool(model.languages)
                cos = x @ model.centroids.T if model.languages else np.zeros((len(x), 1))
                best = cos.argmax(axis=1)
                lengths = np.log([max(1, len(t.as_py() or "")) for t in batch.column(at).slice(first, 256)])
                top = np.clip(cos[np.arange(len(x)), best], 0, 1).astype(float)
                for i in range(len(x)):
                    langs.append(model.languages[best[i]] if some[i] else UNKNOWN)
                    scores.append(float(top[i]) if some[i] else 0.0)
                    rejected.append(not some[i] or bool(top[i] < np.interp(lengths[i], np.log(LENGTHS), model.floors[best[i]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])
        give_back()

    return df.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is not held out and never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return df.filter(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1)
