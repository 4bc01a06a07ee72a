"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate, ties by the audit's letters.

Every edit of a conversation is written into one integer: cost in its high digits, below it octal digits for the audit, three to a row (at most
two insertions before the row, then what becomes of the row) and two at the end, filled up with zeros. Digits follow the letters' order, a row's
own letter ends its three digits, so no entry of a row begins another, and the smallest integer is the cheapest audit that is least in ASCII.
The minimum over a graph of (row, state of the role pattern) therefore decides everything; a layer of it is four integers.

Layers are kept only as far as their integers differ: once all four agree on a row, its edits are final and leave for the digest or the output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.shared import small_batches

#: White space, ends of a sentence, prices of the edits.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Digits of the letters, in their order; 0 stands for none.
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = {d: letter for letter, d in DIGITS.items()}
#: States of the role pattern ``(s?(ua)+)?``: nothing yet, after s, after u, after a. The first and the last may end it.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
FINAL = (START, ASSISTANT)
#: What edits cost at most that make up for standing in the first state instead of the second: whatever may follow the second may follow the first
#: after an insertion, or if a first turn of the system is deleted. A state that costs more than that above another is in no cheapest audit.
INSTEAD = {
    (ASSISTANT, START): DELETE, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): INSERT, (USER, START): INSERT + DELETE, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT,
    (START, SYSTEM): 0, (START, USER): INSERT, (START, ASSISTANT): 0, (SYSTEM, START): 2 * INSERT, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 2 * INSERT,
}
NAMES = {"u": "user", "a": "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")


def expected(state: int) -> str:
    """The initial that an inserted turn, or one with a new role, has in ``state``: no other is legal there."""
    return "a" if state == USER else "u"


def inserted(state: int) -> Iterator[tuple[int, int, list[int]]]:
    """(state, cost, digits) after no, one and two inserted turns. Three would pass through a state twice."""
    cost, digits = 0, []
    for k in range(3):
        yield state, cost, list(digits)
        state, cost = STEP[state, expected(state)], cost + INSERT
        digits.append(DIGITS["I"])


@cache
def row_edges(initial: str, fault: str) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, word) of a row with this role initial and fault: of equal ends the cheapest, then the least word."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for begin in range(4):
        for state, cost, digits in inserted(begin):
            ways = [("D", state, DELETE)]
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault == "truncated" else 0
                if (state, initial) in STEP:
                    ways.append(("K", STEP[state, initial], more))
                ways.append(("R", STEP[state, expected(state)], REROLE + more))
            for letter, to, price in ways:
                word = int("".join(map(str, [*digits, DIGITS[letter]])).ljust(3, "0"), 8)
                best[begin, to] = min(best.get((begin, to), (1 << 60, 0)), (cost + price, word))
    return [(begin, to, cost, word) for (begin, to), (cost, word) in best.items()]


@cache
def last_edges() -> list[tuple[int, int, int]]:
    """(from, cost, word) of the insertions after the last row that end the pattern."""
    found = [(begin, cost, int("".join(map(str, digits)).ljust(2, "0"), 8)) for begin in range(4) for state, cost, digits in inserted(begin) if state in FINAL]
    return [min((x for x in found if x[0] == begin), key=lambda x: x[1:]) for begin in range(4)]


class Repair:
    """One conversation, fed row by row in order. ``put(place, letter, role, text)`` is called for every edit, in order, as soon as it is final."""

    def __init__(self, put: Callable[[str, str, str], None]):
        self.put, self.state, self.audit, self.cost = put, START, [], 0
        self.layer, self.bits, self.waiting = [0, None, None, None], 0, []
        self.seen, self.turns, self.least, self.most, self.last = set(), 0, None, None, None
        self.count, self.illegal, self.before = dict.fromkeys(FAULTS, 0), 0, None

    def feed(self, turn: int | None, role: str, text: str, blank: bool, ended: bool) -> None:
        said = f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")
        key = hashlib.md5(said).digest() if len(said) > 64 else said
        fault = "blank" if blank else "duplicate" if key in self.seen else "" if ended else "truncated"
        self.seen.add(key)
        self.count[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None:
            self.turns += turn != self.last
            self.least, self.most, self.last = (turn if self.least is None else self.least), turn, turn
        self.bits += 9
        layer: list[int | None] = [None] * 4
        for begin, to, cost, word in row_edges(initial, fault):
            if self.layer[begin] is not None:
                value = (self.layer[begin] << 9) + (cost << self.bits) + word
                if layer[to] is None or value < layer[to]:
                    layer[to] = value
        costs = [None if v is None else v >> self.bits for v in layer]
        for (here, there), most in INSTEAD.items():
            if costs[here] is not None and costs[there] is not None and costs[there] > costs[here] + most:
                layer[there] = None
        self.layer = layer
        self.waiting.append((role, text))
        self._settle()

    def _settle(self) -> None:
        """Edits of the first rows that all states agree on are final."""
        done = 0
        while done < len(self.waiting):
            words = {(value >> self.bits - 9) & 511 for value in self.layer if value is not None}
            if len(words) > 1:
                break
            word = words.pop()
            self.bits -= 9
            costs = [None if v is None else v >> self.bits + 9 for v in self.layer]
            self.layer = [None if v is None else (v & (1 << self.bits) - 1) + (k << self.bits) for v, k in zip(self.layer, costs)]
            self._tell(f"{word:03o}", self.waiting[done])
            done += 1
        del self.waiting[:done]

    def _tell(self, word: str, row: tuple[str, str] | None) -> None:
        for digit in word:
            if digit == "0":
                continue
            letter = LETTERS[int(digit)]
            self.audit.append(letter)
            role, text = ("", "") if letter == "I" else row
            if letter in "IR":
                role = NAMES[expected(self.state)]
            if letter != "D":
                self.state = STEP[self.state, role[:1]]
            self.put(letter, role, text)

    def end(self) -> None:
        value = min((self.layer[begin] << 6) + (cost << self.bits + 6) + word for begin, cost, word in last_edges() if self.layer[begin] is not None)
        self.bits += 6
        self.cost = value >> self.bits
        for row in self.waiting:
            self.bits -= 9
            self._tell(f"{(value >> self.bits) & 511:03o}", row)
        self._tell(f"{value & 63:02o}", None)

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def damage(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged as crc32(``conv_id:turn``) % 20 says: 0 drops the row (``gone``), 1 empties the text, 2 takes
    its sentence ends, 3 repeats the row, 4 makes it the user's. A null reads as one space, in the key too; the turn itself stays null."""
    one = lambda col: F.coalesce(F.col(col).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", one(conv_id), one(turn)).cast("binary")) % 20
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), one(role).alias("role"), one(text).alias("text"), kind.alias("kind"))
    said = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    who = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", who.alias("role"), said.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _in_order(df: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order: by turn, nulls first, rows of one turn by role and text."""
    gone = F.col("gone") if "gone" in df.columns else F.lit(False)
    tail = F.rtrim("text", F.lit(WHITE))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce(gone, F.lit(False)).alias("gone"))
    rows = rows.withColumn("blank", tail == "").withColumn("ended", F.substring(tail, -1, 1).isin(*ENDS))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], begin: Callable, finish: Callable, flush: Callable) -> Iterator[pa.RecordBatch]:
    """Feed sorted rows to one ``Repair`` after the other; ``flush`` gives what is ready after every batch."""
    current, name = None, None
    for batch in batches:
        for conv_id, turn, role, text, gone, blank, ended in zip(*(column.to_pylist() for column in batch.columns)):
            if current is None or conv_id != name:
                if current is not None:
                    current.end()
                    finish(name, current)
                current, name = begin(conv_id), conv_id
            if not gone:
                current.feed(turn, role, text, blank, ended)
        yield from flush()
    if current is not None:
        current.end()
        finish(name, current)
    yield from flush()


def repair_report(df: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conversation of ``df``
    (conv_id, turn, role, text and, as :func:`damage` gives it, ``gone``).

    Rows stand by turn, nulls first; equal turns by role and text. A null role or text reads as one space, null ids form one conversation, a
    role without a legal initial has to be given a new one or deleted. Conversations whose rows are all gone have zeros, no audit and the digest
    of an empty text. Further columns are ignored. Conversations are spread by id and streamed in order: a task holds the 64 bytes or less of
    each row that tell duplicates, the audit, and the rows on whose edits nothing is decided yet, but not the conversation's texts.
    """
    small_batches(df.sparkSession)
    kind = df.schema["conv_id"].dataType
    fields = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches):
        ready: list[tuple] = []
        ids: list = []
        digests: list = []

        def begin(_):
            digest, first = hashlib.sha256(), [True]

            def put(letter: str, role: str, text: str) -> None:
                if letter != "D":
                    digest.update((("" if first[0] else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
                    first[0] = False

            digests[:] = [digest]
            return Repair(put)

        def finish(name, r: Repair) -> None:
            ids.append(name)
            ready.append((r.gaps, r.count["blank"], r.count["duplicate"], r.count["truncated"], r.illegal, r.cost, "".join(r.audit), digests[0].hexdigest()))

        def flush():
            if ready:
                columns = [list(x) for x in zip(*ready)]
                arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(c, pa.string()) for c in columns[6:]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *arrays], names=["conv_id", *[f.split()[0] for f in fields.split(", ")]])
                ready.clear()
                ids.clear()

        yield from _conversations(batches, begin, finish, flush)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    return _in_order(df).mapInArrow(run, f"conv_id {kind.simpleString()}, {fields}")


def repaired_turns(df: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the edits of each conversation in order, deleted rows included (edit D); otherwise as
    :func:`repair_report`. The repaired conversation is what has another edit, in the order of ``place``."""
    small_batches(df.sparkSession)
    kind = df.schema["conv_id"].dataType

    def run(batches):
        ready: list[tuple] = []

        def begin(name):
            place = [0]

            def put(letter: str, role: str, text: str) -> None:
                ready.append((name, place[0], letter, role, text))
                place[0] += 1

            return Repair(put)

        def flush():
            if ready:
                columns = [list(x) for x in zip(*ready)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]], names=["conv_id", "place", "edit", "role", "text"])
                ready.clear()

        yield from _conversations(batches, begin, lambda name, r: None, flush)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    return _in_order(df).mapInArrow(run, f"conv_id {kind.simpleString()}, place long, edit string, role string, text string")
