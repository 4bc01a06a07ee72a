"""N-gram Jaccard join by T-occurrence search.

Every text becomes a set of word shingles; texts link when the Jaccard similarity of their sets reaches a threshold. Equal sets
form a class and are joined as one. The rest narrows in exact steps:

1. Shared-shingle filter. To link, a set must share at least ``threshold`` of its shingles with one other, so at least a
   known number of those whose hash lies in a fixed part of the hash space. All sets' shingles in such a part are counted;
   a class too few of whose shingles occur in any other class can link to nothing. Shingles are sent packed by hash bucket;
   one that repeats within a run of a task is counted there and sent once, so a frequent one costs each run one entry.
2. Candidate groups. For the classes left, all shingles are counted. A linked pair shares one of the rarest
   ``n - T + 1`` of either set (those in no other class fill that prefix first). Each inverted list of prefix shingles ties its members
   to its most central member, and connected components of these ties are groups that no link crosses.
3. T-occurrence search (DivideSkip) inside groups: the longest inverted lists are set aside, the short ones merged by a heap to count
   occurrences, and documents that reach the rest of the required overlap are probed in the long lists by binary search.
   Groups are cut in blocks that fit a task. In a first round each group's most central set is searched in all its blocks; a set that hangs
   together with it needs no search of its own, as in the second round every other set is searched in all blocks.
4. Links are closed to components.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.components import connected_components
from hirelake.llm.shared import arrow_type, discard, give_back, parts_for, small_batches, staged, staged_alone, utf8_slices
from hirelake.llm.shingles import Shingler, fingerprint

#: Percent of the union that the intersection has to reach.
PERCENT = 80
#: Packed entries that a task holds before it sends them.
FLUSH = 1_000_000
#: Bytes of text whose shingles share a bucket, and packed entries in a bucket of the second count.
BUCKET_BYTES, BUCKET_ENTRIES = 16 << 20, 1_000_000
#: Shingles in a block of a group, and in a task that takes blocks.
BLOCK_SHINGLES, TASK_SHINGLES = 250_000, 500_000
#: Entries of a list that a step of the heap-merge takes at most.
STEP = 4096


def required(n: int, m, percent: int = PERCENT):
    """Least overlap of sets of sizes n and m (numbers or arrays) whose Jaccard similarity reaches the threshold."""
    return -((-percent * (n + m)) // (100 + percent))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Least overlap of a set of size n with any set that it links to."""
    return -((-percent * n) // 100)


def counted_below(n: int, percent: int = PERCENT) -> np.uint64:
    """The hash up to which shingles of a set of n are counted: the share that a linked set may lack, and two standard deviations or
    more of what happens to lie there. It falls with n; small sets are counted whole."""
    share = min(1.0, (100 - percent) / 100 + 2 / max(n, 1) ** 0.5)
    return np.uint64(min(2**64 - 1, int(share * 2**32) << 32))


def _pack(tokens: np.ndarray, owners: np.ndarray, n_buckets: int):
    """(bucket, tokens, owners) by ascending token."""
    buckets = (tokens >> np.uint64(3)) % np.uint64(n_buckets)
    order = np.lexsort((tokens, buckets))
    tokens, owners, buckets = tokens[order], owners[order], buckets[order]
    cuts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]).tolist() + [len(buckets)]
    for a, b in zip(cuts, cuts[1:]):
        yield int(buckets[a]), tokens[a:b], owners[a:b]


HEAD = [("kind", T.IntegerType()), ("id", None), ("mark", T.LongType()), ("fp", T.StringType()), ("short", T.LongType()), ("n", T.LongType()), ("need", T.LongType()), ("bucket", T.IntegerType()), ("tokens", T.BinaryType()), ("owners", T.BinaryType())]


def _heads(n_buckets: int, percent: int, id_type: pa.DataType):
    """Rows of kind 0: a text's class; kind 1: packed shingles of one bucket; kind 2: shared shingles counted here.

    An owner is the class's even number, plus one if the shingle is counted; owner 0 stands for several.
    """
    long, binary = pa.int64(), pa.binary()
    schema = pa.schema([("kind", pa.int32()), ("id", id_type), ("mark", long), ("fp", pa.string()), ("short", long), ("n", long), ("need", long), ("bucket", pa.int32()), ("tokens", binary), ("owners", binary)])

    def rows(kind, many, **given):
        columns = [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(many, f.type) for f in schema]
        columns[0] = pa.array(np.full(many, kind, np.int32))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        shingler, seen, tokens, owners, weight = Shingler(), set(), [], [], 0

        def flush():
            if tokens:
                t, o = np.concatenate(tokens), np.concatenate(owners)
                tokens.clear()
                owners.clear()
                order = np.argsort(t)
                t, o = t[order], o[order]
                del order
                start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                size = np.diff(np.r_[start, len(t)])
                repeated = np.repeat(size > 1, size)
                who, many = np.unique(o[repeated & (o & 1 == 1)] - 1, return_counts=True)
                if len(who):
                    yield rows(2, len(who), short=who, n=many)
                # One entry stands for all that repeat here: owner 0, which counts as two.
                o[repeated] = 0
                sent = list(_pack(t[start], o[start], n_buckets))
                yield rows(1, len(sent), bucket=[s[0] for s in sent], tokens=[s[1].tobytes() for s in sent], owners=[s[2].tobytes() for s in sent])
            seen.clear()
            give_back()

        for batch in batches:
            ids, marks = batch.column(0), batch.column(2)
            for first, last, data, offsets in utf8_slices(batch.column(1)):
                fps, shorts, ns, needs = [], [], [], []
                for s in shingler.sets(data, offsets):
                    n, fp = len(s), fingerprint(s)
                    short = (int(fp[:16], 16) - 2**63) & ~1 or 2
                    counted = int(np.searchsorted(s, counted_below(n, percent), side="right"))
                    fps.append(fp)
                    shorts.append(short)
                    ns.append(n)
                    needs.append(counted - (n - least_overlap(n, percent)))
                    if n and short not in seen:
                        seen.add(short)
                        # Sent is also what smaller sets that it may link to count.
                        send = s[: int(np.searchsorted(s, counted_below(least_overlap(n, percent), percent), side="right"))]
                        owner = np.full(len(send), short, np.int64)
                        owner[:counted] += 1
                        tokens.append(send.copy())
                        owners.append(owner)
                        weight += len(send)
                        if weight > FLUSH:
                            yield from flush()
                            weight = 0
                yield rows(0, last - first, id=ids.slice(first, last - first), mark=marks.slice(first, last - first), fp=fps, short=shorts, n=ns, need=needs)
        yield from flush()

    return run


def _sorted_entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and owners of a bucket's messages, by token, then owner."""
    t = np.frombuffer(b"".join(x.as_buffer() for x in table.column("tokens")), np.uint64)
    o = np.frombuffer(b"".join(x.as_buffer() for x in table.column("owners")), np.int64)
    order = np.lexsort((o, t))
    return t[order], o[order]


def _by_destination(owners: np.ndarray, n_buckets: int, *values: np.ndarray) -> list[tuple]:
    """(destination, packed owners, packed values ...): what belongs to an owner goes to the owner's bucket, in one row for each bucket."""
    to = (owners >> 1) % n_buckets
    order = np.lexsort((owners, to))
    to, cols = to[order], [x[order] for x in (owners, *values)]
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]).tolist() + [len(to)] if len(to) else [0]
    return [(int(to[a]), *(x[a:b].tobytes() for x in cols)) for a, b in zip(cuts, cuts[1:])]


def _packed_table(rows: list[tuple], *names: str) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, pa.int32() if n == "dest" else pa.binary()) for n, c in zip(names, columns)})


def _shared_counts(n_buckets: int):
    """For one bucket: how many of each class's counted shingles occur in another class, packed by the class's own bucket."""

    def run(table: pa.Table) -> pa.Table:
        t, o = _sorted_entries(table)
        once = np.r_[True, (t[1:] != t[:-1]) | (o[1:] != o[:-1])] | (o == 0)
        t, o = t[once], o[once]
        start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        size = np.diff(np.r_[start, len(t)])
        who, many = np.unique(o[np.repeat(size > 1, size) & (o & 1 == 1)] - 1, return_counts=True)
        out = _packed_table(_by_destination(who, n_buckets, many.astype(np.int64)), "dest", "shorts", "many")
        give_back()
        return out

    return run


def _summed(table: pa.Table) -> pa.Table:
    """One row for each class of a bucket: its shared shingles over all buckets of shingles."""
    short, many = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("shorts", "many"))
    who, at = np.unique(short, return_inverse=True)
    return pa.table({"short": who, "shared": np.bincount(at, weights=many, minlength=len(who)).astype(np.int64)})


def _full_sets(batches):
    """Sets of the texts that still have the fingerprint asked for; of rows in a row with one class, the first."""
    shingler, last_class = Shingler(), None
    for batch in batches:
        for first, last, data, offsets in utf8_slices(batch.column(1)):
            sets = shingler.sets(data, offsets)
            classes, fps = (batch.column(k).slice(first, last - first).to_pylist() for k in (0, 2))
            keep = []
            for c, f, s in zip(classes, fps, sets):
                if c != last_class and fingerprint(s) == f:
                    keep.append((c, s))
                    last_class = c
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in keep], pa.int64()), pa.array([len(s) for _, s in keep], pa.int64()), pa.array([s.tobytes() for _, s in keep], pa.binary())], names=["class", "n", "tokens"])
    give_back()


def _bucketed(n_buckets: int):
    """(class, tokens) to packed rows for each bucket."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)]
                owners = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])
                sent = list(_pack(np.concatenate(sets), owners, n_buckets)) if len(owners) else []
                yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in sent], pa.int32()), pa.array([s[1].tobytes() for s in sent], pa.binary()), pa.array([s[2].tobytes() for s in sent], pa.binary())], names=["bucket", "tokens", "owners"])
        give_back()

    return run


def _frequencies(n_buckets: int):
    """For one bucket: classes' shingles that occur in other classes, with the number of classes that have them, packed by the class's own bucket."""

    def run(table: pa.Table) -> pa.Table:
        t, o = _sorted_entries(table)
        start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        size = np.diff(np.r_[start, len(t)])
        many = np.repeat(size, size)
        shared = many > 1
        out = _packed_table(_by_destination(o[shared], n_buckets, t[shared], many[shared].astype(np.int64)), "dest", "classes", "tokens", "many")
        give_back()
        return out

    return run


def _prefixes(percent: int):
    """For the classes of one bucket: prefix shingles that others have too, and how much of the class is its own."""

    def run(packed: pa.Table, sizes: pa.Table) -> pa.Table:
        c, t, m = (np.frombuffer(b"".join(packed.column(x).to_pylist()), k) for x, k in (("classes", np.int64), ("tokens", np.uint64), ("many", np.int64)))
        size = dict(zip(sizes.column("class").to_pylist(), sizes.column("n").to_pylist()))
        order = np.lexsort((t, m, c))
        c, t = c[order], t[order]
        cuts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]).tolist() + [len(c)] if len(c) else [0]
        who, own, tokens, counts = [], [], [t[:0]], []
        for a, b in zip(cuts, cuts[1:]):
            n = size[int(c[a])]
            alone = n - (b - a)  # shingles of no other class fill the prefix first
            take = n - least_overlap(n, percent) + 1 - alone
            if take > 0:
                tokens.append(t[a : min(b, a + take)])
                who.append(int(c[a]))
                own.append(alone / n)
                counts.append(len(tokens[-1]))
        out = pa.table({"token": np.concatenate(tokens).view(np.int64), "class": np.repeat(np.array(who, np.int64), counts), "own": np.repeat(np.array(own, float), counts)})
        give_back()
        return out

    return run


def heap_merge(lists: list[np.ndarray], step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, number of lists that hold each) over ascending lists, in ascending order.

    A heap keeps the lists by their next document. The list at its top sets a frontier, ``step`` entries on; every list that begins
    before it gives up what lies before it, these runs are counted, and the lists go back with what follows.
    """
    heap = [(int(x[0]), k, 0) for k, x in enumerate(lists) if len(x)]
    heapq.heapify(heap)
    while heap:
        _, k, at = heap[0]
        frontier = int(lists[k][min(at + step, len(lists[k])) - 1])
        runs = []
        while heap and heap[0][0] <= frontier:
            _, k, at = heap[0]
            end = at + int(np.searchsorted(lists[k][at:], frontier, side="right"))
            runs.append(lists[k][at:end])
            if end < len(lists[k]):
                heapq.heapreplace(heap, (int(lists[k][end]), k, end))
            else:
                heapq.heappop(heap)
        yield np.unique(np.concatenate(runs), return_counts=True)


class Inverted:
    """Inverted lists over sets; searches by T-occurrence with DivideSkip."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        self.start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        self.tokens = flat[self.start]
        self.size = np.diff(np.r_[self.start, len(flat)])

    def _list(self, k: int) -> np.ndarray:
        return self.owner[self.start[k] : self.start[k] + self.size[k]]

    def search(self, query: np.ndarray) -> np.ndarray:
        """Sets that link to ``query`` (itself too, if it is among them)."""
        n = len(query)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        least = least_overlap(n, self.percent)
        if len(at) < least:
            return np.zeros(0, np.int64)
        at = at[np.argsort(self.size[at], kind="stable")]
        # Set aside the longest lists, fewer than the overlap; the more, the longer they are.
        longest = int(self.size[at[-1]])
        aside = min(least - 1, int(least / (0.01 * np.log2(longest + 1) + 1)))
        short, long = at[: len(at) - aside].tolist(), at[len(at) - aside :].tolist()
        some, found = [], []
        for docs, counts in heap_merge([self._list(k) for k in short]):
            need = required(n, self.sizes[docs], self.percent)
            reach = (counts + len(long) >= need) & (np.minimum(self.sizes[docs], n) >= need)
            some.append(docs[reach])
            found.append(counts[reach])
        some, found = np.concatenate(some).astype(np.int64), np.concatenate(found)
        need = required(n, self.sizes[some], self.percent)
        # Probe the candidates in the long lists; the shortest of these first, dropping those out of reach.
        for left, k in zip(range(len(long) - 1, -1, -1), long):
            if not len(some):
                break
            docs = self._list(k)
            p = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
            found = found + (docs[p] == some)
            reach = found + left >= need
            if not reach.all():
                some, found, need = some[reach], found[reach], need[reach]
        return some[found >= need]


def block_links(classes: list[int], sets: list[np.ndarray], asks: np.ndarray, central: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges between the sets that ask and those that do not, as far as they join what is not joined yet; ``central`` ones are one already."""
    rows, edges, parent = np.flatnonzero(~asks).tolist(), [], {}
    if not rows:
        return edges

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    index = Inverted([sets[i] for i in rows], percent)
    for q in np.flatnonzero(asks).tolist():
        for y in index.search(sets[q]).tolist():
            i = rows[y]
            a, b = top(classes[q]), top(-1 if central[i] else classes[i])
            if a != b:
                parent[b] = a
                edges.append((classes[q], classes[i]))
    return edges


def _task_links(percent: int):
    """Links of the blocks that a task takes, one block after the other."""

    def run(table: pa.Table) -> pa.Table:
        group, block, chunk, classes = (table.column(c).to_numpy() for c in ("group", "block", "chunk", "class"))
        asks, central = (np.array(table.column(c).to_pylist(), bool) for c in ("ask", "central"))
        tokens, edges = table.column("tokens"), []
        order = np.lexsort((classes, chunk, block, group))
        cuts = np.flatnonzero(np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in (group, block, chunk)], axis=0)]).tolist() + [len(order)]
        for a, b in zip(cuts, cuts[1:]):
            at = order[a:b]
            sets = [np.frombuffer(tokens[i].as_buffer(), np.uint64) for i in at.tolist()]
            edges += block_links(classes[at].tolist(), sets, asks[at], central[at], percent)
        give_back()
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return run


def _searched(rows: DataFrame, asks: DataFrame, percent: int, each: int, tag: str) -> DataFrame:
    """Links between ``rows`` and ``asks`` (group, block, chunk, class, n, tokens, central) of the same group, block and chunk."""
    both = rows.withColumn("ask", F.lit(False)).unionByName(asks.withColumn("ask", F.lit(True)))
    tasks = parts_for(both, "n", each)
    dealt = both.withColumn("task", F.pmod(F.xxhash64("group", "block", "chunk"), F.lit(tasks)).cast("int"))
    return staged(dealt.groupBy("task").applyInArrow(_task_links(percent), "a long, b long"), tag)


def group_links(members: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """Edges that span the components of the links among ``members`` (group, class, own, n, tokens); no link crosses groups."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    pieces = lambda total: F.ceil(total * 2 / block_shingles).cast("int")
    groups = staged(members.groupBy("group").agg(F.min(F.struct("own", "class")).alias("c"), pieces(F.sum("n")).alias("blocks")).select("group", F.col("c.class").alias("centre"), "blocks"), "groups")
    in_blocks = members.join(groups.select("group", "blocks"), "group").withColumn("block", share("blocks"))
    centres = members.join(groups, (members["group"] == groups["group"]) & (members["class"] == groups["centre"])).select(members["group"], "class", "n", "tokens", spread("blocks").alias("block"))
    shape = lambda d, chunk, central: d.select("group", "block", chunk.cast("int").alias("chunk"), "class", "n", "tokens", central.alias("central"))
    first = _searched(shape(in_blocks, F.lit(0), F.lit(False)), shape(centres, F.lit(0), F.lit(False)), percent, 2 * block_shingles, "first-links")
    # Second round: sets that do not hang together with the centre are searched in all blocks of their group.
    joined = staged(first.select(F.col("b").alias("class")).unionByName(groups.select(F.col("centre").alias("class"))).distinct(), "central")
    asking = members.join(joined, "class", "left_anti")
    chunks = staged(asking.groupBy("group").agg(pieces(F.sum("n")).alias("chunks")), "chunks")
    told = in_blocks.join(chunks, "group").join(joined.withColumn("central", F.lit(True)), "class", "left")
    rows = told.select("*", spread("chunks").alias("chunk")).transform(lambda d: shape(d, F.col("chunk"), F.coalesce("central", F.lit(False))))
    asks = asking.join(chunks, "group").join(groups.select("group", "blocks"), "group").withColumn("chunk", share("chunks")).select("*", spread("blocks").alias("block"))
    second = _searched(rows, shape(asks, F.col("chunk"), F.lit(False)), percent, 2 * block_shingles, "second-links")
    return first.unionByName(second)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Words are runs of anything but ASCII white space, A-Z in lower case; a set holds the distinct shingles of five words, or the
    whole sequence as one if there are fewer. Texts without words (or null) have an empty set, link with nothing and keep
    their own id. Texts with equal sets link. Repeated rows come back as often as they came; null ids count as
    larger than all others. Other columns are ignored. ``percent`` should be at least 75, else the filter sees no difference.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    n_buckets = parts_for(rows, F.octet_length("text"), BUCKET_BYTES)
    schema = T.StructType([T.StructField(n, k or rows.schema["id"].dataType) for n, k in HEAD])
    told = staged(rows.mapInArrow(_heads(n_buckets, percent, arrow_type(rows, "id")), schema), "told")
    packed = told.filter("kind = 1").select("bucket", "tokens", "owners").groupBy("bucket").applyInArrow(_shared_counts(n_buckets), "dest int, shorts binary, many binary")
    there = packed.groupBy("dest").applyInArrow(_summed, "short long, shared long")
    shared = staged(told.filter("kind = 2").select("short", F.col("n").alias("shared")).unionByName(there).groupBy("short").agg(F.sum("shared").alias("shared")), "shared")
    heads = staged(told.filter("kind = 0").select("id", "mark", "fp", "short", "n", "need"), "heads")
    discard(told)
    first_row = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark"))
    classes = staged(
        heads.filter("n > 0").groupBy("fp").agg(first_row.alias("row"), F.first("short").alias("short"), F.first("n").alias("n"), F.first("need").alias("need"))
        .select("fp", F.col("row.id").alias("rep"), F.col("row.mark").alias("mark"), "short", "n", "need", F.monotonically_increasing_id().alias("class")),
        "classes",
    )
    # A class may link only if enough of its counted shingles occur elsewhere.
    left = classes.join(shared, "short", "left").filter(F.coalesce("shared", F.lit(0)) >= F.col("need")).select("rep", "mark", "fp", "class")
    left = staged(left, "survivors").withColumnRenamed("mark", "_mark")
    # Texts are read again rather than kept as sets; by a merge join whatever the number of survivors.
    texts = rows.hint("merge").join(left, rows["id"].eqNullSafe(F.col("rep")) & (rows["mark"] == F.col("_mark")))
    sets = staged(texts.select("class", "text", "fp").mapInArrow(_full_sets, "class long, n long, tokens binary"), "sets")
    # Rows that repeat id and text meet in one task, unless a hot id was split; only then are whole sets dealt out again.
    if not sets.groupBy("class").count().filter("count > 1").isEmpty():
        once = staged(sets.dropDuplicates(["class"]), "sets")
        discard(sets)
        sets = once
    n_buckets = parts_for(sets, "n", BUCKET_ENTRIES)
    packed = sets.select("class", "tokens").mapInArrow(_bucketed(n_buckets), "bucket int, tokens binary, owners binary")
    freq = packed.groupBy("bucket").applyInArrow(_frequencies(n_buckets), "dest int, classes binary, tokens binary, many binary")
    sizes = sets.select(F.pmod(F.shiftright("class", 1), F.lit(n_buckets)).cast("int").alias("dest"), "class", "n")
    prefix = freq.groupBy("dest").cogroup(sizes.groupBy("dest")).applyInArrow(_prefixes(percent), "token long, class long, own double")
    prefix = staged(prefix, "prefixes")
    lists = staged(prefix.groupBy("token").agg(F.min(F.struct("own", "class")).alias("centre"), F.count("*").alias("many")).filter("many > 1").select("token", F.col("centre.class").alias("centre")), "lists")
    ties = prefix.join(lists, "token").filter("class <> centre").select(F.col("class").alias("a"), F.col("centre").alias("b"))
    groups = connected_components(ties)
    own = prefix.groupBy("class").agg(F.first("own").alias("own"))
    members = sets.join(groups.select(F.col("node").alias("class"), F.col("label").alias("group")), "class").join(own, "class")
    members = staged(members.select("group", "class", "own", "n", "tokens"), "members")
    discard(prefix, lists, sets, groups)
    labels = connected_components(group_links(members, percent, block_shingles))
    named = classes.join(labels, F.col("class") == F.col("node"), "left").select("fp", "rep", F.coalesce("label", "class").alias("label"))
    named = staged(named, "named")
    smallest = staged(named.groupBy("label").agg(F.min("rep").alias("component_id")), "smallest")
    of = staged(named.join(smallest, "label").select("fp", "component_id"), "of")
    discard(members, left, classes, labels, named, smallest, shared)
    linked = heads.filter("n > 0").join(of, "fp").select("id", F.col("n").alias("n_shingles"), "component_id")
    alone = heads.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("id", id_col)


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component, with their columns as they are.

    If ids repeat, an id's rows stay if one of them is its component's smallest. Rows with a null id stay.
    """
    def found():
        told = jaccard_components(df.select(id_col, text_col), id_col, text_col, percent)
        stays = F.max((F.col(id_col) == F.col("component_id")).cast("int"))
        return told.groupBy(id_col).agg(stays.alias("stays")).filter("stays = 0").select(F.col(id_col).alias("gone_id"))

    gone = staged_alone(df.sparkSession, found, "gone")
    return df.join(gone, df[id_col] == gone["gone_id"], "left_anti")
