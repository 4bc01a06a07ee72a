"""Packing token sequences into windows, with window fillings chosen by non-negative least squares.

Full windows of a document stand alone. What is left of each document, its tail, has a class: its length in units of 32 tokens, rounded up. All
combinations of at most four classes that fill a window are enumerated; non-negative least squares says how often each should be used to meet
the histogram of classes, rounded down to whole numbers. Tails take their places in these windows by rank within their class. Tails that no
combination uses are packed greedily: laid end to end, they first fill up what rounding has left open in the windows, then windows of their
own, and the last few tokens go to sequences whose lengths are powers of two. So nothing is padded, and only the greedily packed tails are cut.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.shared import arrow_type, give_back, small_batches, staged

#: Tokens of a window and of a unit of length, parts of a combination, the id that ends a document.
WINDOW, UNIT, DEPTH, END_ID = 2048, 32, 4, 1
CLASSES = WINDOW // UNIT
#: Words whose ids a worker process keeps, characters of text that it takes at a time, words that it encodes at a time.
KEPT_WORDS, SLICE_CHARS, ENCODED_WORDS = 600_000, 4_000_000, 4_000
#: Positions of the greedy order in a bucket of the interval join, and windows whose open places are summed in one task.
BUCKET, BLOCK = 4096, 8192
#: Words that lower-casing and the tokenizer's own splitting treat alike wherever they stand: letters of Latin-1, then marks without apostrophes.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


class Lists:
    """Lists of ids, one behind the other."""

    def __init__(self):
        self.ids, self.begins, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.begins = np.r_[self.begins, len(self.ids) + np.cumsum(counts) - counts]
        self.ids, self.counts = np.r_[self.ids, ids.astype(np.int32)], np.r_[self.counts, counts]

    def joined(self, at: np.ndarray) -> np.ndarray:
        """The ids of the lists ``at``."""
        counts = self.counts[at]
        total = np.r_[0, np.cumsum(counts)]
        return self.ids[np.repeat(self.begins[at] - total[:-1], counts) + np.arange(total[-1])]


class WordEncoder:
    """Ids of texts by the library's tokenizer, word by word: its own splitting never joins what white space separates.

    Words of Latin letters, and marks behind them, are given to it in long lines and told apart by the ids that end a word; all other words one by one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.ends = np.zeros(self.full.get_vocab_size(), bool)
        self.ends[[i for word, i in self.full.get_vocab().items() if word.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.table: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.words, self.bases = Lists(), Lists()

    def _learn_bases(self, bases: list[str]) -> None:
        """Ids of lower-case words and of marks, each one piece of the tokenizer's splitting."""
        for first in range(0, len(bases), ENCODED_WORDS):
            some = bases[first : first + ENCODED_WORDS]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            self.bases.add(ids, np.diff(np.r_[-1, np.flatnonzero(self.ends[ids])]))

    def learn(self, words: list[str]) -> None:
        simple, other, parts = [], [], []
        for w in words:
            m = SIMPLE.fullmatch(w)
            if m:
                simple.append(w)
                parts += m.groups()
            else:
                other.append(w)
        parts = [x.lower() for x in parts]
        fresh = [x for x in dict.fromkeys(parts) if x and x not in self.stems]
        self.stems.update(zip(fresh, range(len(self.stems), len(self.stems) + len(fresh))))
        self._learn_bases(fresh)
        at = np.fromiter((self.stems[x] for x in parts if x), np.int64)
        of = np.flatnonzero(np.fromiter(map(bool, parts), bool, len(parts))) // 2
        self.words.add(self.bases.joined(at), np.bincount(of, self.bases.counts[at], len(simple)).astype(np.int64))
        for first in range(0, len(other), ENCODED_WORDS):
            each = [e.ids for e in self.full.encode_batch_fast(other[first : first + ENCODED_WORDS], add_special_tokens=False)]
            self.words.add(np.array([i for x in each for i in x], np.int64), np.fromiter(map(len, each), np.int64, len(each)))
        self.table.update(zip(simple + other, range(len(self.table), len(self.table) + len(words))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text ends)."""
        lists = pc.ascii_split_whitespace(texts)
        places = lists.flatten().dictionary_encode()
        words = places.dictionary.to_pylist()
        if len(self.table) > KEPT_WORDS:
            self.clear()
        fresh = [w for w in words if w not in self.table]
        if fresh:
            self.learn(fresh)
        at = np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))[places.indices.to_numpy(zero_copy_only=False)]
        total = np.r_[0, np.cumsum(self.words.counts[at])]
        offsets = lists.offsets.to_numpy(zero_copy_only=False)
        return self.words.joined(at), total[offsets[1:] - offsets[0]]


@cache
def _encoder(path: str) -> WordEncoder:
    """One for each worker process: words that it knows serve its later tasks too."""
    return WordEncoder(path)


TOKENS = "doc_tokens long, crcs array<long>, windows array<binary>, windows_before long, tail_length int, class int, rank long, tail_crc long, tail binary"


def tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each document: its number of ids with the end id, checksums of its full windows (and their ids), and its tail: length, class,
    rank among the tails of that class in its task (``block``), checksum and ids (little-endian, 32 bits)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small_batches(rows.sparkSession)
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(TOKENS).fields])
    id_type = arrow_type(rows, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ranks, before = _encoder(path), [0] * (CLASSES + 1), 0
        for batch in batches:
            first = 0
            while first < batch.num_rows:
                rows = max(1, min(batch.num_rows - first, SLICE_CHARS * batch.num_rows // max(1, batch.nbytes)))
                part = batch.slice(first, rows)
                first += rows
                ids, ends = encoder.encode(part.column(1))
                out, begin = [], 0
                for end in ends.tolist():
                    own = np.r_[ids[begin:end], END_ID].astype("<u4")
                    begin, full = end, len(own) // WINDOW
                    whole = [own[k * WINDOW : (k + 1) * WINDOW].tobytes() for k in range(full)]
                    tail = own[full * WINDOW :].tobytes()
                    kind = -(-len(tail) // (4 * UNIT))
                    out.append((len(own), [zlib.crc32(x) for x in whole], whole if with_ids else None, before, len(tail) // 4, kind, ranks[kind], zlib.crc32(tail), tail))
                    ranks[kind] += 1
                    before += full
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(id_type), *[pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]], names=schema.names)
        give_back()

    return rows.mapInArrow(run, schema).withColumn("block", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())


@cache
def combinations(total: int = CLASSES, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All falling sequences of at most ``depth`` classes that add up to ``total``, short ones first."""
    def grow(rest: int, most: int, left: int) -> Iterator[tuple[int, ...]]:
        if rest == 0:
            yield ()
        elif left:
            for part in range(min(rest, most), -(-rest // left) - 1, -1):
                for more in grow(rest - part, part, left - 1):
                    yield (part, *more)

    return sorted(grow(total, total, depth), key=lambda x: (len(x), x))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """x >= 0 that minimises the length of a x - b, by the active-set method of Lawson and Hanson; at most as many values are positive as ``a`` has rows."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    least = 1e-10 * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= least:
            break
        free[best] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (z <= 1e-12)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x += step * (z - x)
            free &= x > 1e-12
            x[~free] = 0.0
        x = z
    return x


def window_plan(histogram: list[int], total_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, how often) for tails counted by class (index 0: none). Never more windows than ``total_tokens`` fill, so that what the
    combinations leave open can be filled up by the tails that they leave over."""
    combos = combinations()
    a = np.zeros((CLASSES, len(combos)))
    for j, parts in enumerate(combos):
        for part in parts:
            a[part - 1, j] += 1
    x = nnls(a, np.array(histogram[1:], float))
    left, plan = list(histogram), []
    for j in np.argsort(-x, kind="stable").tolist():
        times = min([int(x[j] + 1e-6), *(left[c] // combos[j].count(c) for c in set(combos[j]))])
        if times:
            plan.append((combos[j], times))
            for c in combos[j]:
                left[c] -= times
    over = sum(times for _, times in plan) - total_tokens // WINDOW
    for k in sorted(range(len(plan)), key=lambda k: -len(plan[k][0])):
        less = max(0, min(over, plan[k][1]))
        plan[k], over = (plan[k][0], plan[k][1] - less), over - less
    return [p for p in plan if p[1]]


def _ranges(plan: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple], list[int]]:
    """(class, first rank, rank behind the last, first sequence, places a sequence has for the class, its first slot, slots of the sequence), and how many tails of each class are used."""
    used, out, sequence = [0] * (CLASSES + 1), [], 0
    for parts, times in plan:
        for c in sorted(set(parts), reverse=True):
            n = parts.count(c)
            out.append((c, used[c], used[c] + n * times, sequence, n, parts.index(c), len(parts)))
            used[c] += n * times
        sequence += times
    return out, used


def _sum_before(df: DataFrame, size: str, block: str, order: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``size`` over all rows before, by ``block`` and then ``order``. Blocks are summed on their own, then carried on."""
    sums = df.groupBy(block).agg(F.sum(size).alias("_sum"))
    behind = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    carried = sums.select(block, F.coalesce(F.sum("_sum").over(behind), F.lit(0)).alias("_carried"))
    own = Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_own", F.coalesce(F.sum(size).over(own), F.lit(0))).join(carried, block).withColumn(name, F.col("_own") + F.col("_carried")).drop("_own", "_carried")


def _powers(rest: int) -> list[tuple[int, int]]:
    """Lengths that are powers of two and add up to ``rest``, as (begin, end)."""
    out, at = [], 0
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out.append((at, at + (1 << bit)))
            at += 1 << bit
    return out


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids``: little-endian, 32 bits): one row for each piece of a document.

    A document is the ids of its whole text (a null reads as empty) and the end id, so that each has one id at least. Every id lies in exactly
    one piece, pieces of a sequence lie without gaps, and every sequence has 2048 ids or, for the last few ids of the table, a power of
    two. Ids of documents are carried only, so null and repeated ones need no rule; an empty table has no pieces; further columns are left out.

    To the driver go a count for each of 64 classes and a few sums.
    """
    told = staged(tokens(df, path, id_col, text_col, with_ids), "packing-tokens")
    spark, c = told.sparkSession, F.col
    tails = told.filter("class > 0")
    counts = staged(tails.groupBy("class", "block").agg(F.count("*").alias("n"), F.sum("tail_length").alias("tokens")), "packing-counts")
    by_class = {r["class"]: r for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()}  # at most 64 rows
    histogram = [by_class[k]["n"] if k in by_class else 0 for k in range(CLASSES + 1)]
    total = sum(r["tokens"] for r in by_class.values())
    plan = window_plan(histogram, total)
    ranges, used = _ranges(plan)
    filled = sum(times for _, times in plan)

    # Ranks in a class go on from block to block; a row is greedy if its rank is behind the last place of its class.
    behind = Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("class", "block", "n", F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("first"))
    last_place = F.element_at(F.array(*[F.lit(u) for u in used]), c("class") + 1)
    cut = {r["class"]: (r["block"], r["rank"]) for r in starts.withColumn("rank", last_place - c("first")).filter("rank >= 0 and rank < n").select("class", "block", "rank").collect()}  # at most 64 rows
    border = lambda i: F.element_at(F.array(*[F.lit(cut[k][i] if k in cut else (1 << 31) - 1).cast("long") for k in range(CLASSES + 1)]), c("class") + 1)
    greedy = (c("block") > border(0)) | ((c("block") == border(0)) & (c("rank") >= border(1)))

    schema = "_class int, low long, high long, sequence long, places int, slot int, slots int"
    places = F.broadcast(spark.createDataFrame(ranges, schema))  # at most four rows for each of at most 64 combinations
    narrow = tails.filter(~greedy).select("doc_id", "doc_tokens", "class", "block", "rank", "tail_length", "tail_crc", *(["tail"] if with_ids else []))
    ranked = narrow.join(starts.select("class", "block", "first"), ["class", "block"]).withColumn("rank", c("rank") + c("first"))
    sat = ranked.join(places, (c("class") == c("_class")) & (c("rank") >= c("low")) & (c("rank") < c("high")))
    nth = c("rank") - c("low")
    sat = sat.withColumn("sequence_id", c("sequence") + F.floor(nth / c("places"))).withColumn("slot", c("slot") + F.pmod(nth, c("places").cast("long")).cast("int"))
    so_far = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sat = sat.withColumn("offset", F.coalesce(F.sum("tail_length").over(so_far), F.lit(0)))
    keep = ["doc_id", "doc_tokens", "tail_length", "tail_crc", "sequence_id", "offset", "slot", "slots"] + (["tail"] if with_ids else [])
    sat = staged(sat.select(*keep), "packing-windows")

    # What is open at the end of each of these windows, as intervals of the greedy order.
    open_ = sat.filter(c("slot") == c("slots") - 1).select("sequence_id", (c("offset") + c("tail_length")).alias("at")).withColumn("room", F.lit(WINDOW) - c("at")).filter("room > 0")
    open_ = _sum_before(open_.withColumn("seq_block", F.floor(c("sequence_id") / BLOCK)), "room", "seq_block", "sequence_id", "low").withColumn("high", c("low") + c("room"))
    open_tokens = filled * WINDOW - (sat.agg(F.sum("tail_length")).first()[0] or 0)
    loose = tails.filter(greedy).select("row", "block", "doc_id", "doc_tokens", "tail_length", "tail")
    loose = staged(_sum_before(loose, "tail_length", "block", "row", "begin").withColumn("end", c("begin") + c("tail_length")), "packing-loose")
    rest = total - filled * WINDOW  # greedy tokens that the open places do not take
    own_windows = rest // WINDOW
    into = lambda d, low, high: d.withColumn("bucket", F.explode(F.sequence(F.floor(low / BUCKET), F.floor((high - 1) / BUCKET))))
    asked = into(loose.select("row", "begin", "end").filter(c("begin") < open_tokens), c("begin"), F.least(c("end"), F.lit(open_tokens)))
    offered = into(open_, c("low"), c("high")).select("bucket", "sequence_id", "at", "low", "high")
    met = asked.join(offered, "bucket").filter((c("low") < c("end")) & (c("begin") < c("high")) & (F.floor(F.greatest("low", "begin") / BUCKET) == c("bucket")))
    cells = met.select("row", F.greatest("low", "begin").alias("from"), F.least("high", "end").alias("to"), "sequence_id", c("at").alias("_at"), "low")
    cells = cells.select("row", "from", "to", "sequence_id", (c("_at") + c("from") - c("low")).alias("offset"))

    # The rest of the greedy order: windows of its own, then powers of two.
    borders = [(filled + own_windows + i, open_tokens + own_windows * WINDOW + a, open_tokens + own_windows * WINDOW + b) for i, (a, b) in enumerate(_powers(rest % WINDOW))]
    cell = lambda s, low, high: F.struct(s.cast("long").alias("sequence_id"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    here = F.greatest(c("begin"), F.lit(open_tokens)) - open_tokens
    until = F.least(c("end"), F.lit(open_tokens + own_windows * WINDOW)) - open_tokens
    number = lambda at: F.floor(at / WINDOW)
    whole = F.when(here < until, F.transform(F.sequence(number(here), number(until - 1)), lambda k: cell(filled + k, open_tokens + k * WINDOW, open_tokens + (k + 1) * WINDOW)))
    none = F.filter(F.array(cell(F.lit(0), F.lit(0), F.lit(0))), lambda x: F.lit(False))
    small = F.filter(F.array(*[cell(F.lit(s), F.lit(a), F.lit(b)) for s, a, b in borders]), lambda x: (x["low"] < c("end")) & (c("begin") < x["high"])) if borders else none
    more = loose.filter(c("end") > open_tokens).select("row", "begin", "end", F.explode(F.concat(F.coalesce(whole, none), small)).alias("x"))
    more = more.select("row", F.greatest("begin", "x.low").alias("from"), F.least("end", "x.high").alias("to"), "x.sequence_id", (F.greatest("begin", "x.low") - c("x.low")).alias("offset"))

    pieces = cells.unionByName(more).join(loose, "row").withColumn("_from", (c("from") - c("begin")).cast("int")).withColumn("length", c("to") - c("from"))
    ids = F.substring("tail", c("_from") * 4 + 1, (c("length") * 4).cast("int"))
    extra = lambda col: [col.alias("ids")] if with_ids else []
    cut_up = pieces.select("doc_id", (c("doc_tokens") - c("tail_length") + c("_from")).alias("start"), "length", F.crc32(ids).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *extra(ids))
    seated = sat.select("doc_id", (c("doc_tokens") - c("tail_length")).alias("start"), c("tail_length").cast("long").alias("length"), c("tail_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *(extra(c("tail")) if with_ids else []))

    # Full windows of long documents.
    by_block = told.groupBy("block").agg(F.sum(F.size("crcs")).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task that read documents
    firsts = by_block.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    base = filled + own_windows + len(borders)
    long_ = told.filter(F.size("crcs") > 0).select("doc_id", "doc_tokens", "block", "windows_before", F.arrays_zip("crcs", "windows").alias("each") if with_ids else c("crcs").alias("each")).join(firsts, "block")
    full = long_.select("doc_id", "doc_tokens", (F.lit(base) + c("first") + c("windows_before")).alias("_first"), F.posexplode("each").alias("_k", "_x"))
    full = full.select("doc_id", (c("_k") * F.lit(WINDOW)).cast("long").alias("start"), F.lit(WINDOW).cast("long").alias("length"), (c("_x.crcs") if with_ids else c("_x")).alias("ids_crc32"), "doc_tokens", (c("_first") + c("_k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(extra(c("_x.windows")) if with_ids else []))
    return full.unionByName(seated).unionByName(cut_up)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids: the ids of each sequence (little-endian, 32 bits) from pieces with ``ids``; at most a window to a row."""
    put = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(put, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
