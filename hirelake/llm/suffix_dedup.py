"""Removal of long byte strings that occur more than once, from a distributed sparse suffix array.

A string of ``LENGTH`` bytes always holds an anchor: the ``GRAM`` bytes whose hash is least among all in the string. Equal strings
have equal anchors at equal places, so only suffixes that begin at anchors are compared, and only with those of the same anchor.

1. Anchors of all texts are sent by hash of the anchor, with hashes of their surroundings (everything a string around that
   anchor can touch). An anchor met once is dropped. Equal surroundings settle an anchor at once: all strings around
   it repeat. Those that repeat within a task are settled there and sent once.
2. What is left are anchors whose surroundings differ but may share a string: the edges of shared passages. Their surroundings are sent as
   bytes and sorted by what follows the anchor: an enhanced suffix array. A stack scan of its common-prefix lengths
   lists the intervals of the tree; in each, members are compared by what precedes the anchor. Where extensions to the left differ the
   interval is a maximal repeat, and every member is marked as far as its nearest kin reaches, not only neighbours in
   the array.
3. Marks of a text are joined, and the marked bytes taken out. A text of which there are copies repeats as a whole.

Anchors so frequent that they would burden one task are settled by grouping 128-bit hashes of the single strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.shared import arrow_type, discard, give_back, parts_for, small_batches, staged, text_or_empty, utf8_slices

LENGTH = 200
GRAM = 32
#: Distinct surroundings of one anchor that one task compares.
FREQUENT = 50_000
#: Anchors that a task holds before it sends them, and bytes of text whose anchors share a bucket.
FLUSH = 700_000
BUCKET_BYTES = 16 << 20
_NONE = np.uint64(2**64 - 1)
_RNG = np.random.default_rng(20240202)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _slides(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours, from running picks within blocks."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    full = np.concatenate([x, np.full(-len(x) % width, x[-1], x.dtype)]).reshape(-1, width)
    ahead = pick.accumulate(full, axis=1).ravel()
    back = pick.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


class Rolling:
    """Hashes of any substring of a buffer in constant time."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def read(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(self.up) < n:
            size = max(n, (1 << 20) + 4096)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _STEP)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BACK)], dtype=np.uint64)
        self.sums = np.empty(n, np.uint64)
        self.sums[0] = 0
        np.cumsum(_BYTE[data] * self.up[: n - 1], dtype=np.uint64, out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[b] - self.sums[a]) * self.down[a])


def anchors(rolling: Rolling, data: np.ndarray, offsets: np.ndarray):
    """(text, place, anchor hash, hash of surroundings, left and right half hashes) of all anchors in a run of texts."""
    size = LENGTH - GRAM
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(np.uint32), empty.astype(np.uint32)
    rolling.read(data)
    lengths = np.diff(offsets)
    of = np.repeat(np.arange(len(lengths)), lengths)
    n = len(data) - GRAM + 1
    at = np.arange(n)
    h = rolling.of(at, at + GRAM)
    h[at + GRAM > offsets[of[:n] + 1]] = _NONE
    least = _slides(h, size + 1, np.minimum)
    pad = np.zeros(size, np.uint64)
    p = np.flatnonzero((_slides(np.concatenate([pad, least, pad]), size + 1, np.maximum) == h) & (h != _NONE) & (lengths[of[:n]] >= LENGTH))
    text = of[p]
    begin, end = offsets[text], offsets[text + 1]
    lo, hi = np.maximum(begin, p - size), np.minimum(end, p + LENGTH)
    around = rolling.of(lo, hi) ^ _mixed(((p - lo) * 1024 + (hi - p)).astype(np.uint64))
    half = size // 2
    # A string around the anchor holds this much before it or that much after it. Zero: the text has not that much.
    left = np.where(p - begin >= half, rolling.of(np.maximum(p - half, 0), p + GRAM), np.uint64(0))
    right = np.where(end - p >= GRAM + half, rolling.of(p, np.minimum(p + GRAM + half, len(data))), np.uint64(0))
    return text, p - begin, h[p], around, (left >> np.uint64(32)).astype(np.uint32), (right >> np.uint64(32)).astype(np.uint32)


def _bytes_of(*arrays) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


ENTRY = np.dtype([("h", "u8"), ("c", "u8"), ("l", "u4"), ("r", "u4"), ("doc", "i4"), ("at", "i4")])
#: ``at`` of an entry that stands for several, settled where they met, is negative.
SETTLED = np.int32(-(2**31))
HEAD = "kind int, id {id}, fp binary, n_bytes long, bucket int, entries binary, docs binary, spans binary"


def _span_rows(entries: np.ndarray, docs: list[bytes], sizes: np.ndarray):
    """(fp, spans) of settled entries: everything a string around the anchor touches."""
    order = np.argsort(entries["doc"], kind="stable")
    e = entries[order]
    lo = np.maximum(0, e["at"] - (LENGTH - GRAM))
    hi = np.minimum(sizes[e["doc"]], e["at"] + LENGTH)
    spans = np.stack([lo, hi], axis=1).astype(np.int32)
    cuts = np.flatnonzero(np.r_[True, e["doc"][1:] != e["doc"][:-1]]).tolist() + [len(e)] if len(e) else [0]
    pairs = list(zip(cuts, cuts[1:]))
    return [docs[e["doc"][a]] for a, _ in pairs], [spans[a:b].tobytes() for a, b in pairs]


def _heads(n_buckets: int, id_type: pa.DataType):
    """Kind 0: a row's text digest and length; kind 1: anchors of one bucket; kind 2: spans settled in this task."""
    schema = pa.schema([("kind", pa.int32()), ("id", id_type), ("fp", pa.binary()), ("n_bytes", pa.int64()), ("bucket", pa.int32()), ("entries", pa.binary()), ("docs", pa.binary()), ("spans", pa.binary())])

    def rows(kind, many, **given):
        columns = [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(many, f.type) for f in schema]
        columns[0] = pa.array(np.full(many, kind, np.int32))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        rolling, seen, docs, sizes, parts, weight = Rolling(), set(), [], [], [], 0

        def flush():
            if parts:
                e = np.concatenate(parts)
                e = e[np.lexsort((e["c"], e["h"]))]
                start = np.flatnonzero(np.r_[True, (e["h"][1:] != e["h"][:-1]) | (e["c"][1:] != e["c"][:-1])])
                size = np.diff(np.r_[start, len(e)])
                settled = e[np.repeat(size > 1, size)]
                if len(settled):
                    fps, spans = _span_rows(settled, docs, np.array(sizes, np.int64))
                    yield rows(2, len(fps), fp=fps, spans=spans)
                e = e[start]
                e["at"][size > 1] |= SETTLED
                bucket = (e["h"] >> np.uint64(5)) % np.uint64(n_buckets)
                order = np.argsort(bucket, kind="stable")
                e, bucket = e[order], bucket[order]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() + [len(e)]
                sent = []
                for a, b in zip(cuts, cuts[1:]):
                    used, doc = np.unique(e["doc"][a:b], return_inverse=True)
                    part = e[a:b].copy()
                    part["doc"] = doc
                    sent.append((int(bucket[a]), part.tobytes(), b"".join(docs[k] + sizes[k].to_bytes(4, "little") for k in used)))
                yield rows(1, len(sent), bucket=[s[0] for s in sent], entries=[s[1] for s in sent], docs=[s[2] for s in sent])
            seen.clear()
            docs.clear()
            sizes.clear()
            parts.clear()
            give_back()

        for batch in batches:
            for first, last, data, offsets in utf8_slices(batch.column(1)):
                raw, ends = data.tobytes(), offsets.tolist()
                fps = [hashlib.md5(raw[a:b]).digest() for a, b in zip(ends, ends[1:])]
                fresh = np.zeros(len(fps), np.int64) - 1
                for k, f in enumerate(fps):
                    if f not in seen:
                        seen.add(f)
                        fresh[k] = len(docs)
                        docs.append(f)
                        sizes.append(ends[k + 1] - ends[k])
                text, at, h, c, left, right = anchors(rolling, data, offsets)
                keep = fresh[text] >= 0
                e = np.zeros(int(keep.sum()), ENTRY)
                lengths = np.diff(offsets)
                for name, values in (("h", h), ("c", c), ("l", left), ("r", right), ("doc", fresh[text]), ("at", at)):
                    e[name] = values[keep]
                if len(e):
                    parts.append(e)
                    weight += len(e)
                yield rows(0, len(fps), id=batch.column(0).slice(first, last - first), fp=fps, n_bytes=lengths)
                if weight > FLUSH:
                    yield from flush()
                    weight = 0
        yield from flush()

    return run


def _shared_by(keys: list[np.ndarray]) -> np.ndarray:
    """Whether an entry's combined key occurs again."""
    order = np.lexsort(keys)
    same = np.ones(len(order) - 1, bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.zeros(len(order), bool)
    out[order] = np.r_[same, False] | np.r_[False, same]
    return out


def _settle(frequent: int):
    """For one bucket of anchors: spans settled by equal surroundings, and anchors whose bytes must be compared."""

    def run(table: pa.Table) -> pa.Table:
        parts, docs, sizes = [], [], []
        for raw, names in zip(table.column("entries").to_pylist(), table.column("docs").to_pylist()):
            e = np.frombuffer(raw, ENTRY).copy()
            e["doc"] += len(docs)
            docs += [names[i : i + 16] for i in range(0, len(names), 20)]
            sizes += [int.from_bytes(names[i + 16 : i + 20], "little") for i in range(0, len(names), 20)]
            parts.append(e)
        e = np.concatenate(parts)
        e = e[np.lexsort((e["c"], e["h"]))]
        settled = e["at"] < 0
        e["at"] &= ~SETTLED
        alike = np.r_[False, (e["h"][1:] == e["h"][:-1]) & (e["c"][1:] == e["c"][:-1])]
        start = np.flatnonzero(~alike)
        size = np.diff(np.r_[start, len(e)])
        repeats = np.maximum.reduceat(settled, start) | (size > 1)
        fps, spans = _span_rows(e[np.repeat(repeats, size) & ~settled], docs, np.array(sizes, np.int64))
        # One of each surroundings; open ones are those met once.
        one, is_open = e[start], ~repeats
        some = np.zeros(len(one), bool)
        if len(one) > 1:
            kin = np.zeros(len(one), bool)
            for side in ("l", "r"):
                known = np.flatnonzero(one[side] != 0)
                if len(known) > 1:
                    kin[known] |= _shared_by([one[side][known], one["h"][known]])
            # Kept: entries that share a half with another, in groups where at least one of those is open.
            _, group, n = np.unique(one["h"], return_inverse=True, return_counts=True)
            wanted = np.bincount(group, weights=kin & is_open, minlength=len(n)) > 0
            some = kin & wanted[group]
        ask, ask_open = one[some], is_open[some]
        hot = np.zeros(len(ask), bool)
        if len(ask):
            _, group, n = np.unique(ask["h"], return_inverse=True, return_counts=True)
            hot = n[group] > frequent
        order = np.argsort(ask["doc"], kind="stable")
        ask, flags = ask[order], (ask_open[order] * 1 + hot[order] * 2).astype(np.int32)
        cuts = np.flatnonzero(np.r_[True, ask["doc"][1:] != ask["doc"][:-1]]).tolist() + [len(ask)] if len(ask) else [0]
        pairs = list(zip(cuts, cuts[1:]))
        blobs = [np.rec.fromarrays([ask["h"][a:b], ask["at"][a:b], flags[a:b]], dtype=ASK).tobytes() for a, b in pairs]
        give_back()
        return pa.table({
            "fp": pa.array(fps + [docs[ask["doc"][a]] for a, _ in pairs], pa.binary()),
            "spans": pa.array(spans + [None] * len(pairs), pa.binary()),
            "asks": pa.array([None] * len(fps) + blobs, pa.binary()),
        })

    return run


ASK = np.dtype([("h", "u8"), ("at", "i4"), ("flags", "i4")])
PLACE = np.dtype([("h", "u8"), ("at", "i4"), ("open", "i4"), ("doc", "i4"), ("left", "i4"), ("right", "i4")])
SENT = "bucket int, places binary, around binary, docs binary, fp binary, w1 long, w2 long, start int"


def _surroundings(n_buckets: int):
    """Bytes around the anchors asked for, by bucket; for frequent ones a row for each string around them."""
    size = LENGTH - GRAM
    schema = pa.schema([("bucket", pa.int32()), ("places", pa.binary()), ("around", pa.binary()), ("docs", pa.binary()), ("fp", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64()), ("start", pa.int32())])

    def run(batches):
        for batch in batches:
            docs, places, around, hot = [], [], [], []
            for fp, text, blobs in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                asks = np.frombuffer(b"".join(blobs), ASK)
                plain = asks[asks["flags"] < 2]
                padded = np.concatenate([np.zeros(size, np.uint8), np.frombuffer(raw, np.uint8) + np.uint8(1), np.zeros(LENGTH, np.uint8)])
                if len(plain):
                    e = np.zeros(len(plain), PLACE)
                    e["h"], e["at"], e["open"], e["doc"] = plain["h"], plain["at"], plain["flags"] & 1, len(docs)
                    e["left"], e["right"] = np.minimum(plain["at"], size), np.minimum(len(raw) - plain["at"], LENGTH)
                    places.append(e)
                    around.append(padded[plain["at"][:, None] + np.arange(size + LENGTH)])
                    docs.append(fp)
                for at in asks["at"][asks["flags"] >= 2].tolist():
                    for a in range(max(0, at - size), min(at, len(raw) - LENGTH) + 1):
                        w = hashlib.md5(raw[a : a + LENGTH]).digest()
                        hot.append((fp, int.from_bytes(w[:8], "big", signed=True), int.from_bytes(w[8:], "big", signed=True), a))
            if places:
                e, rows = np.concatenate(places), np.concatenate(around)
                bucket = (e["h"] >> np.uint64(5)) % np.uint64(n_buckets)
                order = np.argsort(bucket, kind="stable")
                e, rows, bucket = e[order], rows[order], bucket[order]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() + [len(e)]
                sent = []
                for a, b in zip(cuts, cuts[1:]):
                    used, doc = np.unique(e["doc"][a:b], return_inverse=True)
                    part = e[a:b].copy()
                    part["doc"] = doc
                    sent.append((int(bucket[a]), part.tobytes(), rows[a:b].tobytes(), b"".join(docs[k] for k in used)))
                columns = [pa.array(x, t) for x, t in zip(zip(*sent), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(sent), f.type) for f in list(schema)[4:])], schema=schema)
            if hot:
                columns = [pa.array(x, f.type) for x, f in zip(zip(*hot), list(schema)[4:])]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(hot), f.type) for f in list(schema)[:4]), *columns], schema=schema)

    return run


def _common(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the next, not beyond what either has."""
    if len(rows) < 2:
        return np.zeros(0, np.int64)
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))


def intervals(common: list[int]):
    """(length, first, last) of every interval of suffixes that share a prefix longer than what they share with their
    surroundings: a stack scan of the common-prefix lengths of neighbours."""
    stack: list[tuple[int, int]] = []
    for i, c in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > c:
            length, first = stack.pop()
            yield length, first, i
        if not stack or stack[-1][0] < c:
            if c >= 0:
                stack.append((c, first))


def maximal_repeats(right: np.ndarray, left: np.ndarray, n_right: np.ndarray, n_left: np.ndarray, least: int = LENGTH):
    """(members, bytes to the left of each, bytes to the right) for every maximal repeat of at least ``least`` bytes around one anchor.

    ``right`` and ``left`` hold what follows the anchor's begin and, reversed, what precedes it.
    """
    order = np.argsort(np.ascontiguousarray(right).view(f"S{right.shape[1]}").ravel(), kind="stable")
    by_left = np.argsort(np.ascontiguousarray(left).view(f"S{left.shape[1]}").ravel(), kind="stable")
    rank = np.empty(len(by_left), np.int64)
    rank[by_left] = np.arange(len(by_left))
    common = _common(right[order], n_right[order])
    for length, first, last in intervals(common.tolist()):
        if length + left.shape[1] < least:
            continue
        members = order[first : last + 1]
        members = members[np.argsort(rank[members], kind="stable")]
        shared = _common(left[members], n_left[members])
        reach = np.maximum(np.r_[shared, 0], np.r_[0, shared])  # to the nearest kin on either side
        hit = reach + length >= least
        if hit.any():
            yield members[hit], reach[hit], length


def _compare(table: pa.Table) -> pa.Table:
    """For one bucket: spans of open anchors, from the maximal repeats among all surroundings of the same anchor."""
    parts, rows, docs = [], [], []
    size = LENGTH - GRAM
    for raw, around, names in zip(*(table.column(c).to_pylist() for c in ("places", "around", "docs"))):
        e = np.frombuffer(raw, PLACE).copy()
        e["doc"] += len(docs)
        docs += [names[i : i + 16] for i in range(0, len(names), 16)]
        parts.append(e)
        rows.append(np.frombuffer(around, np.uint8).reshape(-1, size + LENGTH))
    e, around = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(e["h"], kind="stable")
    e, around = e[order], around[order]
    left, right = around[:, size - 1 :: -1][:, :size], around[:, size:]
    cuts = np.flatnonzero(np.r_[True, e["h"][1:] != e["h"][:-1]])
    many = np.diff(np.r_[cuts, len(e)])
    found_doc, found = [], []

    def mark(i, reach, length):
        keep = e["open"][i] == 1
        i, reach, length = i[keep], reach[keep], np.broadcast_to(length, len(i))[keep]
        found_doc.append(e["doc"][i])
        found.append(np.stack([e["at"][i] - reach, e["at"][i] + length], axis=1))

    pair = cuts[many == 2]
    if len(pair):  # two surroundings: one interval
        both = np.stack([pair, pair + 1], axis=1)
        lengths = [np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)]
        for k, (side, name) in enumerate(((right, "right"), (left, "left"))):
            differ = side[both[:, 0]] != side[both[:, 1]]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), side.shape[1])
            lengths[k] = np.minimum(first, np.minimum(e[name][both[:, 0]], e[name][both[:, 1]]))
        hit = lengths[0] + lengths[1] >= LENGTH
        for k in (0, 1):
            mark(both[hit, k], lengths[1][hit], lengths[0][hit])
    for a, n in zip(cuts[many > 2].tolist(), many[many > 2].tolist()):
        b = a + n
        for members, reach, length in maximal_repeats(right[a:b], left[a:b], e["right"][a:b], e["left"][a:b]):
            mark(a + members, reach, length)
    doc = np.concatenate(found_doc) if found_doc else np.zeros(0, np.int64)
    spans = np.concatenate(found).astype(np.int32) if found else np.zeros((0, 2), np.int32)
    order = np.argsort(doc, kind="stable")
    doc, spans = doc[order], spans[order]
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]).tolist() + [len(doc)] if len(doc) else [0]
    pairs = list(zip(cuts, cuts[1:]))
    del around, left, right, rows
    give_back()
    return pa.table({"fp": pa.array([docs[doc[a]] for a, _ in pairs], pa.binary()), "spans": pa.array([spans[a:b].tobytes() for a, b in pairs], pa.binary())})


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal runs covered by (begin, end) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    cut = np.flatnonzero(np.r_[True, spans[1:, 0] > ends[:-1]])
    return np.stack([spans[cut, 0], ends[np.r_[cut[1:] - 1, len(spans) - 1]]], axis=1)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _removed():
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            sizes, lists, kept = [], [], []
            for text, whole, blobs in zip(*(c.to_pylist() for c in batch.columns[1:])):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if whole and len(raw) >= LENGTH:
                    spans = np.array([[0, len(raw)]])
                else:
                    spans = joined_spans(np.frombuffer(b"".join(blobs or []), np.int32).reshape(-1, 2))
                rest, last = [], 0
                for a, b in spans.tolist():
                    rest.append(raw[last:a])
                    last = b
                rest.append(raw[last:])
                sizes.append(len(raw))
                lists.append([{"start": a, "end": b} for a, b in spans.tolist()])
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(lists, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])
        give_back()

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: id, n_bytes, spans (maximal removed runs of the UTF-8 bytes), kept (what remains, as bytes).

    Removed is every byte covered by a string of ``LENGTH`` bytes that also begins elsewhere, in the same text or another; strings are judged
    on the input and never cross texts. A null text counts as empty. Rows that repeat a text repeat all of it (from
    ``LENGTH`` bytes on). Ids may repeat or be null; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    n_buckets = parts_for(rows, F.octet_length("text"), BUCKET_BYTES)
    told = staged(rows.mapInArrow(_heads(n_buckets, arrow_type(rows, "id")), HEAD.format(id=rows.schema["id"].dataType.simpleString())), "anchors")
    texts = staged(told.filter("kind = 0").groupBy("fp").agg(F.count("*").alias("copies"), F.min("id").alias("rep"), F.first("n_bytes").alias("n_bytes")).filter(F.col("n_bytes") >= LENGTH), "texts")
    settled = staged(told.filter("kind = 1").groupBy("bucket").applyInArrow(_settle(frequent), "fp binary, spans binary, asks binary"), "settled")
    # Of a text at most one list for each bucket is gathered.
    asks = settled.filter("asks is not null").groupBy("fp").agg(F.collect_list("asks").alias("asks"))
    asks = staged(asks.join(texts.select("fp", "rep"), "fp"), "asks")
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    wanted = rows.join(asks, rows["id"].eqNullSafe(asks["rep"])).filter(digest == F.col("fp")).select("fp", "text", "asks")
    sent = staged(wanted.mapInArrow(_surroundings(n_buckets), SENT), "surroundings")
    compared = sent.filter("bucket is not null").select("bucket", "places", "around", "docs").groupBy("bucket").applyInArrow(_compare, "fp binary, spans binary")
    windows = sent.filter("w1 is not null").select("fp", "w1", "w2", "start").distinct()
    repeated = staged(windows.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2"), "repeated")
    # A span is two four-byte numbers, least byte first.
    four = lambda c: F.concat(*[F.substring(F.lpad(F.hex(c), 8, "0"), k, 2) for k in (7, 5, 3, 1)])
    frequent_spans = windows.join(repeated, ["w1", "w2"]).select("fp", F.unhex(F.concat(four(F.col("start")), four(F.col("start") + LENGTH))).alias("spans"))
    spans = told.filter("kind = 2").select("fp", "spans").unionByName(settled.filter("spans is not null").select("fp", "spans")).unionByName(compared).unionByName(frequent_spans)
    single = texts.filter("copies = 1").select("fp")
    marks = spans.join(single, "fp", "left_semi").groupBy("fp").agg(F.collect_list("spans").alias("marks")).withColumn("whole", F.lit(False))
    whole = texts.filter("copies > 1").select("fp", F.lit(None).cast("array<binary>").alias("marks"), F.lit(True).alias("whole"))
    marks = staged(marks.unionByName(whole), "marks")
    discard(told, settled, asks, sent, texts, repeated)
    out = rows.withColumn("fp", digest).join(marks, "fp", "left").select("id", "text", "whole", "marks").mapInArrow(_removed(), T.StructType([rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", SPANS), T.StructField("kept", T.BinaryType())]))
    return out.withColumnRenamed("id", id_col)
