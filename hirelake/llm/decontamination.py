"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces. Wherever the item occurs in a document with at most k edits,
one piece occurs unchanged; so exact hits of all pieces (one automaton over the items) name every candidate place, and a
bit-parallel edit distance (Myers) around each decides.

Items are a stated query set. They travel with the tasks in blocks of bounded size; a larger benchmark takes several passes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.shared import give_back, small_batches

#: Edits allowed for each character of an item.
ERROR_RATE = 0.08
#: Code points of items that one pass takes.
BLOCK_CHARS = 2_000_000
SPACES = re.compile(r"\s+")
HIT = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("distance", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)
_HITS = pa.list_(pa.struct([("item_id", pa.string()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def folded(text: str) -> str:
    """Lower case, white space runs as one blank, none at the ends."""
    low = text.lower()
    if len(low) != len(text):  # a character that grows in lower case stays as it is
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return SPACES.sub(" ", low).strip()


def _origins(text: str) -> list[int]:
    """Where in ``text`` each character of ``folded(text)`` begins."""
    out, last = [], 0
    for m in SPACES.finditer(text):
        out.extend(range(last, m.start()))
        if m.start() and m.end() < len(text):
            out.append(m.start())
        last = m.end()
    out.extend(range(last, len(text)))
    return out


def scores(pattern: str, text: str) -> Iterator[int]:
    """For each end in ``text`` the distance of ``pattern`` to the nearest substring that ends there. Myers' bit vectors."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    vp, vn, score = full, 0, m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & full
        hn = vp & d0
        hp = (vn | ~(vp | d0)) & full
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        shifted = (hp << 1) & full
        vn = shifted & d0
        vp = ((hn << 1) | ~(shifted | d0)) & full
        yield score


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to ``pattern``; of equals the first end."""
    best, end = len(pattern), 0
    for j, score in enumerate(scores(pattern, text), 1):
        if score < best:
            best, end = score, j
    return best, end


def matches(pattern: str, text: str, budget: int) -> list[tuple[int, int]]:
    """(distance, end) of every occurrence within ``budget``: ends at most ``budget`` apart are of one, which has its least distance and that one's first end."""
    found: list[tuple[int, int]] = []
    last = -1
    for j, score in enumerate(scores(pattern, text), 1):
        if score <= budget:
            if found and j - last <= budget:
                found[-1] = min(found[-1], (score, j))
            else:
                found.append((score, j))
            last = j
    return found


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget`` + 1 pieces of nearly equal length."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Matcher:
    def __init__(self, items: list[tuple[str, str]], rate: float):
        self.items = [(i, f) for i, t in items if (f := folded(t or ""))]
        self.budgets = [int(len(t) * rate) for _, t in self.items]
        self.pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t) in enumerate(self.items):
            for at, piece in pieces_of(t, self.budgets[k]):
                self.pieces[piece].append((k, at))

    def ready(self) -> "Matcher":
        """Build the automaton, in the task that uses it."""
        self.automaton = ahocorasick.Automaton()
        for piece in self.pieces:
            self.automaton.add_word(piece, piece)
        if self.pieces:
            self.automaton.make_automaton()
        return self

    def hits(self, text: str) -> list[dict]:
        """The occurrences of each item within its budget, by item order, then place; ends that lie at most the budget apart are of one occurrence."""
        if not self.pieces or not text:
            return []
        low = folded(text)
        begins = defaultdict(set)
        for last, piece in self.automaton.iter(low):
            for k, at in self.pieces[piece]:
                begins[k].add(last - len(piece) + 1 - at)
        found, origins = [], None
        for k in sorted(begins):
            item_id, item = self.items[k]
            budget = self.budgets[k]
            for a, b in _windows(begins[k], budget, len(item), len(low)):
                for distance, end in matches(item, low[a:b], budget):
                    _, back = best_match(item[::-1], low[max(a, a + end - len(item) - budget) : a + end][::-1])
                    origins = origins or _origins(text)
                    found.append({"item_id": item_id, "distance": distance, "start": origins[a + end - back], "end": origins[a + end - 1] + 1})
        return found


def _windows(begins: set[int], budget: int, size: int, most: int):
    """Ranges that hold every occurrence which begins within ``budget`` of one of ``begins``; overlapping ones joined."""
    start = stop = None
    for b in sorted(begins):
        lo, hi = max(0, b - budget), min(most, b + size + budget)
        if start is None:
            start, stop = lo, hi
        elif lo <= stop:
            stop = max(stop, hi)
        else:
            yield start, stop
            start, stop = lo, hi
    if start is not None:
        yield start, stop


def find_leaks(df: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", text_col: str = "text", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``df`` with ``hits``: for each occurrence of an item in the whole text, its id, distance and span in code points.

    An item matches with up to ``rate`` edits per character after folding of case and white space. Items that are null
    or empty match nothing; one shorter than ``1 / rate`` characters has no budget and matches as it is, wherever it stands; items that repeat are each reported. A null text has no hits. Rows are independent. A
    column named ``hits`` is replaced.
    """
    small_batches(df.sparkSession)
    df = df.drop("hits")
    asked = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = asked.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField("hits", T.ArrayType(HIT))])
    out = df
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        matcher = Matcher(sorted((r["i"] or "", r["t"] or "") for r in part.collect()), rate)  # about block_chars of items

        def run(batches, matcher=matcher, first=block == 0):
            matcher.ready()
            for batch in batches:
                texts = batch.column(at)
                rows = [matcher.hits(texts[k].as_py()) for k in range(batch.num_rows)]
                columns = batch.columns
                if not first:
                    rows = [a + b for a, b in zip(columns[-1].to_pylist(), rows)]
                    columns = columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _HITS)], names=schema.names)
            give_back()

        out = out.mapInArrow(run, schema)
    return out
