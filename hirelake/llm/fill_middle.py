"""Fill-in-middle transformation over a piece table.

A document is a list of descriptors (buffer, start, length) over two immutable buffers: the bytes of its text and those of the sentinels. Cutting
splits descriptors, an arrangement permutes them, the inverse permutation restores them; digests and texts are streamed from descriptors, which
are the only things that move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.shared import arrow_type, small_batches, utf8_slices

#: Sentinels before prefix, suffix and middle; shares in per cent of plain documents and of the suffix-first form.
SENTINELS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
PLAIN_FROM, SPM_BELOW, SEED = 50, 80, 42
SENTINEL_BUFFER = b"".join(SENTINELS.values())
#: Order of the parts of each form, with the sentinel before each.
FORMS = {"psm": [("P", "prefix"), ("S", "suffix"), ("M", "middle")], "spm": [("S", "suffix"), ("P", "prefix"), ("M", "middle")]}
PARTS = ("prefix", "middle", "suffix")


@dataclass(frozen=True)
class Piece:
    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over immutable buffers: 0 is the text, 1 holds the sentinels."""

    def __init__(self, text: memoryview):
        self.buffers, self.pieces = (text, memoryview(SENTINEL_BUFFER)), [Piece(0, 0, len(text))]

    def cut(self, places: list[int]) -> None:
        """Split the descriptors at byte ``places`` of the current document, in ascending order; a part may be empty."""
        out, at, rest = [], 0, list(places)
        for piece in self.pieces:
            start, end = piece.start, piece.start + piece.length
            while rest and at + end - start >= rest[0]:
                here = rest.pop(0) - at
                out.append(Piece(piece.buffer, start, here))
                start, at = start + here, at + here
            out.append(Piece(piece.buffer, start, end - start))
            at += end - start
        self.pieces = out

    def arrange(self, order: list[int], sentinels: list[str]) -> None:
        """Permute the descriptors and put one of a sentinel before each."""
        out = []
        for k, name in zip(order, sentinels):
            out += [Piece(1, SENTINEL_BUFFER.index(SENTINELS[name]), len(SENTINELS[name])), self.pieces[k]]
        self.pieces = out

    def chunks(self) -> Iterator[memoryview]:
        for p in self.pieces:
            yield self.buffers[p.buffer][p.start : p.start + p.length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for chunk in self.chunks():
            digest.update(chunk)
        return digest.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.chunks())


def build(text: memoryview, form: str, places: list[int]) -> PieceTable:
    """The document in its form, as descriptors."""
    table = PieceTable(text)
    if form != "plain":
        table.cut(places)
        table.arrange([PARTS.index(part) for _, part in FORMS[form]], [name for name, _ in FORMS[form]])
    return table


def rebuild(output: memoryview, form: str) -> PieceTable:
    """The text of a document in its form, as descriptors over ``output``: the sentinels tell where to cut, they are left out, and the parts
    go back by the inverse permutation."""
    table = PieceTable(output)
    if form != "plain":
        raw, places = bytes(output), []
        for name, _ in FORMS[form]:
            begin = raw.index(SENTINELS[name])
            places += [begin, begin + len(SENTINELS[name])]
        table.cut(places)
        parts = table.pieces[2::2]  # what follows each sentinel
        order = [PARTS.index(part) for _, part in FORMS[form]]
        table.pieces = [parts[order.index(k)] for k in range(3)]
    return table


def cuts(df: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``df`` with ``h``: the first four groups of eight digits of the SHA-256 of ``seed:id`` as integers. A null id reads as empty."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return df.withColumn("h", F.array(*[F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]))


def _ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the units of all texts of a run, and how many units each text has: a word with the blanks before it, or blanks at the end."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    last = np.zeros(len(data), bool)
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    follows = np.r_[white[1:], True] | last
    ends = np.flatnonzero((~white & follows) | (white & last)) + 1
    return ends, np.diff(np.searchsorted(ends, offsets, side="right"))


def _tables(column: pa.Array, hashes: list[list[int]]) -> Iterator[tuple[int, str, int | None, int | None, PieceTable]]:
    """n, form, code points of prefix and middle, and the piece table of every text of a column."""
    row = 0
    for first, last, data, offsets in utf8_slices(column):
        ends, counts = _ends(data, offsets)
        begins = np.searchsorted(ends, offsets[:-1], side="right")
        view = memoryview(data)
        leads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)] if len(data) else np.zeros(1, np.int64)
        for i in range(last - first):
            a, b, n, h = int(offsets[i]), int(offsets[i + 1]), int(counts[i]), hashes[row]
            row += 1
            text = view[a:b]
            raw = bytes(text)
            if not raw or h[2] % 100 >= PLAIN_FROM or any(s in raw for s in SENTINELS.values()):
                yield n, "plain", None, None, build(text, "plain", [])
                continue
            low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            place = lambda k: a if k == 0 else int(ends[begins[i] + k - 1])  # noqa: E731, B023
            x, y = place(low), place(high)
            form = "spm" if h[3] % 100 < SPM_BELOW else "psm"
            yield n, form, int(leads[x] - leads[a]), int(leads[y] - leads[x]), build(text, form, [x - a, y - a])


def _columns(df: DataFrame, text_col: str, id_col: str, seed: int) -> DataFrame:
    return cuts(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", seed)


def transform(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: every text cut into prefix, middle and suffix at borders of its units and written with
    sentinels, suffix first (``spm``) or prefix first (``psm``), or left as it is (``plain``).

    A unit is a word with the blanks before it; blanks at the end are one more. Plain are empty texts (a null reads as one), texts that hold
    a sentinel, and half of all others by the hash of their id. Equal ids are cut at the same unit numbers; a null id reads as empty. Rows are
    independent; whole texts are read, and further columns are left out.
    """
    small_batches(df.sparkSession)
    rows = _columns(df, text_col, id_col, seed)
    id_type = arrow_type(rows, "doc_id")
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string").fields])

    def run(batches):
        for batch in batches:
            told = list(zip(*((n, form, p, m, table.bytes()) for n, form, p, m, table in _tables(batch.column(1), batch.column(2).to_pylist())))) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            out = [pa.array(c, kind) for c, kind in zip(told, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), *out[:4], out[4].cast(pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``df`` with ``restored``: the text rebuilt from output and form. A null output reads as empty. A column of that name is replaced."""
    small_batches(df.sparkSession)
    df = df.drop("restored")
    schema = T.StructType([*df.schema.fields, T.StructField("restored", T.StringType())])
    at, by = df.columns.index(output_col), df.columns.index(form_col)

    def run(batches):
        for batch in batches:
            texts = [rebuild(memoryview((text or "").encode()), form).bytes() for text, form in zip(batch.column(at).to_pylist(), batch.column(by).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """As :func:`transform`, with the SHA-256 of the output and of what is rebuilt from it (``output_sha256``, ``restored_sha256``) instead of the
    output, so that no text leaves the Python worker."""
    small_batches(df.sparkSession)
    rows = _columns(df, text_col, id_col, seed)
    id_type = arrow_type(rows, "doc_id")
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string").fields])

    def run(batches):
        for batch in batches:
            told = []
            for n, form, prefix, middle, table in _tables(batch.column(1), batch.column(2).to_pylist()):
                back = rebuild(memoryview(table.bytes()), form)
                told.append((n, form, prefix, middle, table.sha256(), back.sha256()))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*told)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), *[pa.array(c, kind) for c, kind in zip(columns, kinds)]], names=schema.names)

    return rows.mapInArrow(run, schema)
