"""Nearest neighbours by product quantisation: short codes are scanned, what they put forward is scored exactly.

A unit vector is cut into parts; each part is replaced by the nearest of 256 centres of its own codebook, one byte. A query has a table of its
products with all centres, so the score of a row is a sum of one entry for each part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hirelake.operators.ranking import cosine, top_n_per_group
from hirelake.operators.tables import kept

#: Bytes of a code, centres of a part, rows that codebooks are fitted on and rounds of it.
PARTS, CENTRES, SAMPLE_ROWS, ROUNDS = 16, 256, 16_384, 12
#: Rows that are scored exactly for each row asked for, queries that are scanned at a time, rows of codes scored at once.
OVERSAMPLE, BLOCK_QUERIES, CHUNK = 6, 1_000, 2_048


@dataclass
class Codebooks:
    """``centres`` (part, centre, width); vectors have ``dims`` values, the last part is filled up with zeros."""

    centres: np.ndarray
    dims: int

    def cut(self, x: np.ndarray) -> np.ndarray:
        """(row, part, width) of unit vectors."""
        parts, _, width = self.centres.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def encode(self, x: np.ndarray) -> np.ndarray:
        cut = self.cut(x)
        near = [2 * cut[:, k] @ c.T - (c * c).sum(axis=1) for k, c in enumerate(self.centres)]
        return np.stack([s.argmax(axis=1) for s in near], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(self.centres)), np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(query, part, centre): products of the queries' parts with all centres."""
        return np.einsum("qpw,pcw->qpc", self.cut(q), self.centres).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a vector without length stays 0."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def fit_codebooks(df: DataFrame, column: str = "vector", id_col: str = "external_id", parts: int = PARTS, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks by k-means on a bounded sample: the ``sample_rows`` rows with the least hash of the id. Vectors have the length that most rows of the sample
    have. Parts start from the sample's first rows."""
    rows = df.filter(F.size(column) > 0).select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"), F.col(column).alias("v")).orderBy("h", "id").limit(sample_rows).collect()  # a bounded sample
    if not rows:
        return Codebooks(np.zeros((1, 1, 1)), 1)
    dims = Counter(len(r["v"]) for r in rows).most_common(1)[0][0]
    x = unit(np.array([r["v"] for r in rows if len(r["v"]) == dims], np.float64))
    parts = min(parts, dims)
    books = Codebooks(np.zeros((parts, min(CENTRES, len(x)), -(-dims // parts))), dims)
    cut = books.cut(x)
    for k in range(parts):
        c = cut[: books.centres.shape[1], k].copy()
        for _ in range(rounds):
            own = (2 * cut[:, k] @ c.T - (c * c).sum(axis=1)).argmax(axis=1)
            n = np.bincount(own, minlength=len(c))
            sums = np.stack([np.bincount(own, cut[:, k, w], len(c)) for w in range(c.shape[1])], axis=1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        books.centres[k] = c
    return books


def encode_vectors(df: DataFrame, books: Codebooks, column: str = "vector", id_col: str = "external_id") -> DataFrame:
    """id, code: the index of ``df``, a table to be stored. Rows without a vector, or with one of another length, are left out."""
    rows = df.filter(F.size(column) == books.dims).select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("v"))
    id_type = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = books.encode(unit(_matrix(batch.column(1), books.dims)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "code"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("code", T.BinaryType())]))


def candidates_of(codes: DataFrame, books: Codebooks, names: list, vectors: np.ndarray, pool: int, name_type: T.DataType) -> DataFrame:
    """query_id, id, score: for each query the ``pool`` rows with the highest sums of table entries. A task keeps ``pool`` rows of a query."""
    schema = T.StructType([T.StructField("query_id", name_type), T.StructField("id", codes.schema["id"].dataType), T.StructField("score", T.FloatType())])
    types, parts = (to_arrow_type(name_type), to_arrow_type(schema["id"].dataType)), len(books.centres)
    tables = books.tables(unit(vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids = np.zeros((len(names), 0), np.float32), np.zeros((len(names), 0), object)
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                part = batch.slice(first, CHUNK)
                code = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                scores = np.zeros((len(names), len(code)), np.float32)
                for k in range(parts):
                    scores += tables[:, k, code[:, k]]
                here = np.array(part.column(0).to_pylist(), object)
                both, known = np.concatenate([best, scores], axis=1), np.concatenate([ids, np.broadcast_to(here, scores.shape)], axis=1)
                if both.shape[1] > pool:
                    keep = np.argpartition(-both, pool - 1, axis=1)[:, :pool]
                    both, known = np.take_along_axis(both, keep, 1), np.take_along_axis(known, keep, 1)
                best, ids = both, known
        n = best.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x for x in names for _ in range(n)], types[0]), pa.array(ids.ravel().tolist(), types[1]), pa.array(best.ravel(), pa.float32())], names=schema.names)

    found = codes.mapInArrow(run, schema)
    return top_n_per_group(found, ["query_id"], [F.col("score").desc(), F.col("id")], pool)


def quantised_search(queries: DataFrame, df: DataFrame, codes: DataFrame, books: Codebooks, k: int, query_id: str, query_vector: str, id_col: str, column: str = "vector", oversample: int = OVERSAMPLE) -> DataFrame:
    """Approximate top ``k`` for each of a stated set of queries; ties by id. All codes are scanned, ``oversample * k`` rows of each query are scored
    exactly by the vectors of ``df``, which are joined by id. Rows without a code are never found; queries without a vector have no rows.

    Queries go to the tasks in blocks of about 1,000 (16 MB of tables); every block scans the codes once."""
    asked = queries.filter(F.size(query_vector) == books.dims).select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("_query"))
    blocks, found = max(1, -(-asked.count() // BLOCK_QUERIES)), None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()  # one block of a stated set
        if rows:
            part = candidates_of(codes, books, [r["query_id"] for r in rows], np.array([r["_query"] for r in rows], np.float64), oversample * k, asked.schema["query_id"].dataType)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = asked.crossJoin(codes.limit(0)).select("query_id", "id", F.lit(0.0).cast("float").alias("score"))
    full = df.select(F.col(id_col).alias("id"), F.col(column).alias("_vector"))
    scored = found.drop("score").distinct().join(full, "id").join(asked, "query_id").select("query_id", "id", cosine(F.col("_vector"), F.col("_query")).alias("score"))
    best = top_n_per_group(scored, ["query_id"], [F.round("score", 12).desc(), F.col("id")], k)
    return best.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), "score")


def index_vectors(df: DataFrame, column: str = "vector", id_col: str = "external_id", parts: int = PARTS) -> tuple[Codebooks, DataFrame]:
    """Codebooks, and codes as a table in the shared folder."""
    books = fit_codebooks(df, column, id_col, parts)
    return books, kept(encode_vectors(df, books, column, id_col), "codes")
