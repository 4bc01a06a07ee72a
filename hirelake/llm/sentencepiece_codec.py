"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct words of a slice of texts are laid out as one flat array of symbols. Each round finds for every
adjacent pair the rank of the piece it would form, takes the best rank of each word (a segmented minimum), merges all of that
word's leftmost non-overlapping pairs of that rank at once, and compacts the array, until no pair remains.

A text splits into words before each run of word marks that follows another character: no piece crosses that
border (checked when the model is read). Words split further wherever no piece can go across: what goes across two
characters is a piece of two or three of the characters there, or holds four of them in a row, so a look-up of these settles it. That keeps long
runs without blanks as short as other words.

Merging all equal pairs at once equals merging one at a time unless a merge creates a pair of the same or a better
rank next to another pending one. Parts in which that could have happened are merged again one pair at a time from a heap.

Word results are kept in a bounded table per task.
"""

from __future__ import annotations

import heapq
import re
from array import array
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.shared import give_back, small_batches

MARK = "▁"
#: Characters of words kept per task before the table starts anew; it bounds memory, not results.
KEPT_CHARS = 1_000_000
NO_RANK = np.int64(1) << 40


@dataclass
class PieceModel:
    """A BPE model as arrays. Pair keys are sorted: left id * size + right id."""

    size: int
    chars: np.ndarray
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    pair_ranks: np.ndarray
    surfaces: list
    dummy_prefix: bool
    letters: np.ndarray  # number of each character that pieces hold, else 0
    two: np.ndarray  # pieces of two characters, of three, and runs of four inside pieces, as sorted numbers
    three: np.ndarray
    four: np.ndarray


def read_model(path: str) -> PieceModel:
    """Read a ``.model`` file. Only BPE with byte fallback and plain (identity) normalisation is taken."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, trainer = proto.normalizer_spec, proto.trainer_spec
    if trainer.model_type != trainer.BPE or not trainer.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
    if any(p.type in (4, 5) for p in proto.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("a piece crosses a word border")
    scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
    order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
    size, byte_ids, surfaces = len(proto.pieces), np.zeros(256, np.int64), []
    for i, p in enumerate(proto.pieces):
        if p.type == 6:
            byte_ids[int(p.piece[3:-1], 16)] = i
            surfaces.append(bytes([int(p.piece[3:-1], 16)]))
        elif p.type == 1:
            surfaces.append(p.piece.replace(MARK, " ").encode())
        else:
            surfaces.append(trainer.unk_surface.encode() if p.type == 2 else b"")
    pairs = [
        (ids[p[:k]] * size + ids[p[k:]], i, order[scores[p]])
        for p, i in ids.items()
        for k in range(1, len(p))
        if p[:k] in ids and p[k:] in ids
    ]
    pairs.sort()
    chars = -1 - np.arange(0x110000, dtype=np.int32)
    for p, i in ids.items():
        if len(p) == 1:
            chars[ord(p)] = i
    a = np.array(pairs, dtype=np.int64).reshape(-1, 3)
    letters = np.zeros(0x110000, np.int16)
    held = sorted({ord(c) for p in ids if len(p) > 1 for c in p})
    if len(held) >= 1 << 15:
        raise ValueError("pieces hold too many different characters")
    letters[held] = np.arange(1, len(held) + 1)

    def numbered(parts: set) -> np.ndarray:
        points = np.array([[ord(c) for c in p] for p in parts], np.int64).reshape(len(parts), -1)
        return np.unique(_number([letters[x].astype(np.int64) for x in points.T])) if len(parts) else np.zeros(0, np.int64)

    two, three = ({p for p in ids if len(p) == n} for n in (2, 3))
    four = {p[k : k + 4] for p in ids for k in range(len(p) - 3)}
    return PieceModel(size, chars, byte_ids, a[:, 0].copy(), a[:, 1].copy(), a[:, 2].copy(), surfaces, norm.add_dummy_prefix, letters, numbered(two), numbered(three), numbered(four))


def _number(letters: list[np.ndarray]) -> np.ndarray:
    out = letters[0]
    for x in letters[1:]:
        out = out << 15 | x
    return out


def _held(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _joints(model: PieceModel, points: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Whether a piece could go across the border before each character, within its word."""
    n = len(points)
    x, inside = model.letters[points].astype(np.int64), np.zeros(n + 4, bool)
    for width, known in ((2, model.two), (3, model.three), (4, model.four)):
        if n < width:
            continue
        hit = _held(known, _number([x[k : n - width + 1 + k] for k in range(width)])) & (word[: n - width + 1] == word[width - 1 :])
        for k in range(1, width):
            inside[k : k + len(hit)] |= hit
    return inside[:n]


def _ranked(model: PieceModel, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and id of the piece that each pair forms, or ``NO_RANK``."""
    keys = left * model.size + right
    at = np.minimum(np.searchsorted(model.pair_keys, keys), len(model.pair_keys) - 1)
    found = (model.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
    return np.where(found, model.pair_ranks[at], NO_RANK), np.where(found, model.pair_ids[at], -1)


def _with_bytes(model: PieceModel, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unknown characters replaced by the ids of their UTF-8 bytes; the ids and the new counts per word."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, counts
    raw = [chr(-1 - x).encode("utf-8", "surrogatepass") for x in ids[odd].tolist()]
    widths = np.ones(len(ids), np.int64)
    widths[odd] = [len(r) for r in raw]
    out = np.repeat(ids, widths)
    out[out < 0] = model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    of = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(of, weights=widths, minlength=len(counts)).astype(np.int64)


def _one_at_a_time(model: PieceModel, symbols: list[int]) -> list[int]:
    """Merge the best pair, the leftmost of equal ones, until none is left."""
    n, size = len(symbols), model.size
    ids, nxt, prev = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    keys, ranks, merged = array("q", model.pair_keys.tobytes()), model.pair_ranks, model.pair_ids
    heap: list[tuple] = []

    def add(i: int) -> None:
        j = nxt[i]
        if j < n and ids[i] >= 0 and ids[j] >= 0:
            key = ids[i] * size + ids[j]
            at = bisect_left(keys, key)
            if at < len(keys) and keys[at] == key:
                heapq.heappush(heap, (int(ranks[at]), i, ids[i], j, ids[j], int(merged[at])))

    for i in range(n - 1):
        add(i)
    gone = [False] * n
    while heap:
        _, i, left, j, right, new = heapq.heappop(heap)
        if gone[i] or gone[j] or ids[i] != left or ids[j] != right or nxt[i] != j:
            continue
        ids[i], gone[j] = new, True
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        add(i)
        if prev[i] >= 0:
            add(prev[i])
    return [x for x, g in zip(ids, gone) if not g]


def merge_words(model: PieceModel, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in a row (word marks already in place of spaces), and their number for each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    symbols, of = model.chars[points].astype(np.int64), np.repeat(np.arange(len(words)), lengths)  # an unknown character: minus one less the code point
    first = ~_joints(model, points, of)
    part_of, begins = np.cumsum(first) - 1, np.flatnonzero(first)
    flat, part, n_parts = symbols, part_of, len(begins)
    done_ids, done_parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    last_rank = np.full(n_parts, -1, np.int64)
    many, again = np.zeros(n_parts, bool), np.zeros(n_parts, bool)
    while len(flat):
        rank, piece = _ranked(model, flat[:-1], flat[1:])
        rank = np.where(part[:-1] == part[1:], rank, NO_RANK)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        best = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)  # a part's last pair crosses into the next: NO_RANK
        here = part[starts]
        # After several merges at once, a pair of the same or a better rank may have come too late.
        late = many[here] & (best <= last_rank[here])
        again[here[late]] = True
        live = (best < NO_RANK) & ~late
        sizes = np.diff(np.r_[starts, len(flat)])
        ended = np.repeat(~live, sizes)
        if ended.any():
            done_ids.append(flat[ended])
            done_parts.append(part[ended])
        hit = np.r_[rank == np.repeat(best, sizes)[:-1], False] & ~ended
        # Of overlapping hits (a run of equal symbols) take every second from the left.
        at = np.arange(len(hit))
        run = at - np.maximum.accumulate(np.where(hit, -1, at))
        hit &= run % 2 == 1
        many[here] = np.add.reduceat(hit.astype(np.int64), starts) > 1
        last_rank[here] = best
        merged = flat.copy()
        merged[hit] = np.r_[piece, -1][hit]
        keep = ~ended & ~np.r_[False, hit[:-1]]
        flat, part = merged[keep], part[keep]
    ids, parts = np.concatenate(done_ids), np.concatenate(done_parts)
    if again.any():
        kept, ends = ~again[parts], np.r_[begins[1:], len(symbols)]
        extra = [(i, _one_at_a_time(model, symbols[begins[i] : ends[i]].tolist())) for i in np.flatnonzero(again).tolist()]
        ids = np.concatenate([ids[kept], *(np.array(x, np.int64) for _, x in extra)])
        parts = np.concatenate([parts[kept], *(np.full(len(x), i) for i, x in extra)])
    order = np.argsort(parts, kind="stable")
    return _with_bytes(model, ids[order], np.bincount(of[begins][parts], minlength=len(words)))


#: A word: a run of marks and what follows up to the next run.
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def encoder(model: PieceModel, text_col: int):
    """A function over Arrow batches that appends a list of token ids to each row."""

    def run(batches):
        table: dict[str, int] = {}
        kept = 0
        known, begins, counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            column, n, first = batch.column(text_col), batch.num_rows, 0
            width = max(1, int(1e6 * n / max(1, column.nbytes)))  # rows in about 1 MB
            while first < n:
                part = batch.slice(first, width)
                texts = part.column(text_col).to_pylist()
                first += width
                words: list[str] = []
                ends = [0]
                for text in texts:
                    if text:
                        words += WORD.findall((" " + text if model.dummy_prefix else text).replace(" ", MARK))
                    ends.append(len(words))
                if kept > KEPT_CHARS:
                    table.clear()
                    kept = 0
                    known, begins, counts = known[:0], begins[:0], counts[:0]
                fresh = [w for w in set(words) if w not in table]
                if fresh:
                    table.update(zip(fresh, range(len(table), len(table) + len(fresh))))
                    kept += sum(map(len, fresh))
                    ids, k = merge_words(model, fresh)
                    begins = np.r_[begins, len(known) + np.cumsum(k) - k]
                    known, counts = np.r_[known, ids.astype(np.int32)], np.r_[counts, k]
                at = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
                k = counts[at]
                total = np.r_[0, np.cumsum(k)]
                flat = known[np.repeat(begins[at] - total[:-1], k) + np.arange(total[-1])]
                ids = pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*batch.schema.names, "ids"])
        give_back()

    return run


def decoder(model: PieceModel, ids_col: int):
    """A function over Arrow batches that appends the text of each row's ids: surfaces joined, the one dummy space
    at the start dropped, bytes that form no valid UTF-8 shown as U+FFFD."""

    def run(batches):
        surfaces = model.surfaces
        for batch in batches:
            width = max(1, int(4e6 * batch.num_rows / max(1, batch.column(ids_col).nbytes)))  # rows with about a million ids
            for first in range(0, batch.num_rows, width):
                part = batch.slice(first, width)
                texts = []
                for ids in part.column(ids_col):
                    raw = b"".join(map(surfaces.__getitem__, ids.values.to_numpy().tolist()))
                    if model.dummy_prefix and raw[:1] == b" ":
                        raw = raw[1:]
                    texts.append(raw.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def encode(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int): the ids of each whole text, without begin or end ids.

    A null or empty text has no ids. Rows are independent, so ties, repeated rows and empty tables need no rule.
    An input column named ``ids`` or ``decoded`` is replaced.
    """
    small_batches(df.sparkSession)
    df = df.drop("ids")
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(encoder(read_model(model_path), df.columns.index(text_col)), schema)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the text of each row's ids. Null ids read as none."""
    small_batches(df.sparkSession)
    df = df.drop("decoded").withColumn(ids_col, F.coalesce(F.col(ids_col), F.array().cast("array<int>")))
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])
    return df.mapInArrow(decoder(read_model(model_path), df.columns.index(ids_col)), schema)


def encode_and_decode(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``decoded``, both in one pass over the rows, so that ids cross to Python workers and back once."""
    small_batches(df.sparkSession)
    df = df.drop("ids", "decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    model, at, width = read_model(model_path), df.columns.index(text_col), len(df.columns)
    into, back = encoder(model, at), decoder(model, width)
    return df.mapInArrow(lambda batches: back(into(batches)), schema)
