"""Nearest vectors of many queries: exact, by products of blocks of queries with blocks of different vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries and vectors in a block; a task holds a block of each, and the products of STRIP queries with the vectors.
QUERIES, VECTORS, STRIP = 2048, 16384, 128
#: More than what the order of adding up can change in a cosine.
SLACK = 1e-9
#: Squares of norms between which rounding is relative.
TINY, HUGE = 1e-200, 1e200


def vector_class(vector: Column) -> Column:
    """The same text for equal vectors, another for different ones."""
    numbers = F.transform(vector, lambda x: x.cast("double") + 0.0)  # no negative zeros
    return F.coalesce(F.md5(numbers.cast("string")), F.lit("none"))


def class_of(df: DataFrame, column: str) -> Column:
    """The class of the vectors in ``column``: the one that ``df`` has stored as ``<column>_class``, where there is such a column, else told of the vector."""
    return F.col(f"{column}_class") if f"{column}_class" in df.columns else vector_class(F.col(column))


def best_classes(queries: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """query, class, score: of the pairs of (query, vector) and (class, vector) at least those that are among the ``k`` best of their query, however
    ties are broken. ``score`` is that of ``ranking.cosine``, to the last bit. Both tables are read several times."""
    parts = [max(1, -(-df.count() // most)) for df, most in ((queries, QUERIES), (classes, VECTORS))]
    deal = lambda key, own, other: (F.pmod(F.xxhash64(key), F.lit(own)), F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
    (a, b), (d, e) = deal("query", *parts), deal("class", *reversed(parts))
    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    vector = F.col("vector").cast("array<double>").alias("vector")
    asked = queries.select("query", none(classes, "class"), vector, a.alias("a"), b.alias("b"))
    held = classes.select(none(queries, "query"), "class", vector, d.alias("b"), e.alias("a"))
    kind = T.StructType([queries.schema["query"], classes.schema["class"], T.StructField("score", T.DoubleType())])
    return asked.unionByName(held).groupBy("a", "b").applyInArrow(lambda rows: _best(rows, k), kind)


def _split(vectors: pa.ChunkedArray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], list[int]]:
    """By length: places, vectors and squares of norms, added up from the first number on; and the places of vectors that are null, have a null in
    them, or have a norm that is no number or beyond the usual."""
    array = vectors.combine_chunks()
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    lengths, out, odd = pc.list_value_length(array), {}, []
    odd += np.nonzero(np.asarray(array.is_null()))[0].tolist()
    for n in pc.unique(lengths.drop_null()).to_pylist():
        places = np.nonzero(np.asarray(pc.fill_null(pc.equal(lengths, n), False)))[0]
        flat = array.take(pa.array(places)).flatten()
        values = flat.to_numpy(zero_copy_only=False).reshape(len(places), n)
        broken = np.asarray(flat.is_null()).reshape(len(places), n).any(1)
        with np.errstate(all="ignore"):
            squares = _dots(values, values)
            fine = ~broken & ((values == 0).all(1) | ((squares > TINY) & (squares < HUGE)))
        out[n] = places[fine], values[fine], squares[fine]
        odd += places[~fine].tolist()
    return out, odd


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row products, added up from the first number on."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i] * y[:, i]
    return out


def _plain(x: list | None, y: list | None) -> float | None:
    """The cosine of two vectors of any kind."""
    if x is None or y is None or None in x or None in y:
        return 0.0
    dot = lambda p, q: sum((s * t for s, t in zip(p, q)), 0.0)
    size = math.sqrt(dot(x, x)) * math.sqrt(dot(y, y))
    if size == 0:
        return 0.0
    return dot(x, y) / size if len(x) == len(y) else None


def _best(rows: pa.Table, k: int) -> pa.Table:
    asked, held = rows.filter(pc.is_null(rows["class"])), rows.filter(pc.is_valid(rows["class"]))
    (qs, odd_q), (vs, odd_v) = _split(asked["vector"]), _split(held["vector"])
    found: list[tuple[np.ndarray, np.ndarray, list]] = []
    for n, (places, q, q2) in qs.items():
        others = odd_v + [int(p) for m, (own, _, _) in vs.items() if m != n for p in own]
        found += _each(asked, held, places.tolist(), others)
        if n not in vs or not len(places):
            continue
        at, v, v2 = vs[n]
        for start in range(0, len(q), STRIP):
            size = np.outer(np.sqrt(q2[start : start + STRIP]), np.sqrt(v2))
            near = np.divide(q[start : start + STRIP] @ v.T, size, out=np.zeros_like(size), where=size > 0)
            least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
            i, j = np.nonzero(near >= least[:, None] - SLACK)
            size = size[i, j]
            found.append((places[i + start], at[j], np.divide(_dots(q[i + start], v[j]), size, out=np.zeros(len(i)), where=size > 0)))
    found += _each(asked, held, odd_q, list(range(len(held))))
    take = lambda table, name, k: table[name].take(pa.array(np.concatenate([f[k] for f in found] or [[]]).astype("int64")))
    scores = pa.chunked_array([pa.array(f[2], pa.float64()) for f in found], pa.float64())
    return pa.table([take(asked, "query", 0), take(held, "class", 1), scores], ["query", "class", "score"])


def _each(asked: pa.Table, held: pa.Table, queries: list[int], classes: list[int]) -> list[tuple[np.ndarray, np.ndarray, list]]:
    """All pairs of some queries and vectors, one by one."""
    if not queries or not classes:
        return []
    vectors = held["vector"].take(pa.array(classes)).to_pylist()
    return [(np.full(len(classes), q), np.array(classes), [_plain(asked["vector"][q].as_py(), v) for v in vectors]) for q in queries]
