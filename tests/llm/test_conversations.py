"""Conversation repair against all edit strings of short conversations and a recursion over suffixes of longer ones."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

from hirelake.llm import conversations, queries

SF = "/root/testdata/sf0.01"
PATTERN = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def outcomes(letters, rows, faults):
    """(cost, repaired rows) of an edit string under every choice of roles."""
    if not letters:
        if not rows:
            yield 0, []
        return
    head, rest = letters[0], letters[1:]
    if head == "I":
        for cost, out in outcomes(rest, rows, faults):
            for role in ("user", "assistant"):
                yield cost + 3, [(role, ""), *out]
    elif rows:
        (role, text), fault = rows[0], faults[0]
        if head != "D" and fault in ("blank", "duplicate"):
            return
        more = 3 * (fault == "truncated")
        for cost, out in outcomes(rest, rows[1:], faults[1:]):
            if head == "D":
                yield cost + 4, out
            elif head == "K":
                yield cost + more, [(role, text), *out]
            else:
                for new in ("user", "assistant"):
                    yield cost + 3 + more, [(new, text), *out]


def by_all_strings(rows):
    faults = faults_of(rows)
    best = None
    for n in range(len(rows), 2 * len(rows) + 3):
        for letters in itertools.product("DIKR", repeat=n):
            for cost, out in outcomes(letters, rows, faults):
                if PATTERN.fullmatch("".join(r[:1] for r, _ in out)) and (best is None or (cost, letters) < best[:2]):
                    best = (cost, letters, out)
    return best[0], "".join(best[1]), best[2]


def by_suffixes(rows):
    """(cost, audit, repaired rows): a recursion that compares audits as strings."""
    faults = faults_of(rows)
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in legal:
                    found += [(c + 3, "I" + a, ((role, ""), *out)) for c, a, out in best(i, legal[state, role[0]], inserts + 1)]
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            found += [(c + 4, "D" + a, out) for c, a, out in best(i + 1, state, 0)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for letter, new, price in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                    if (state, new[:1]) in legal:
                        found += [(c + price + more, letter + a, ((new, text), *out)) for c, a, out in best(i + 1, legal[state, new[:1]], 0)]
        return [min(found, key=lambda x: x[:2])] if found else []

    return best(0, "", 0)[0]


def damaged(rows):
    """Rows (conv_id, turn, role, text) as the contract damages them, for each conversation in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        kept = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def expected(rows):
    turns, said = {r[0] for r in rows} - {None}, [(r[1], r[2]) for r in rows]
    faults = faults_of(said)
    cost, audit, out = by_suffixes(said)
    initials = [r[:1] for r, _ in said]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }


def repaired(rows):
    out = []
    r = conversations.Repair(lambda letter, role, text: out.append((letter, role, text)))
    for role, text in rows:
        bare = text.strip(WHITE)
        r.feed(None, role, text, not bare, bare[-1:] in (".", "!", "?"))
    r.end()
    assert "".join(x[0] for x in out) == "".join(r.audit)
    return r.cost, "".join(r.audit), [x[1:] for x in out if x[0] != "D"]


def test_short_conversations_against_all_edit_strings():
    rows = [(role, text) for role in ("user", "assistant", "system", " ") for text in ("a.", "b", "")]
    assert repaired([]) == (0, "", [])
    for n in (1, 2):
        for said in itertools.product(rows, repeat=n):
            assert repaired(list(said)) == by_all_strings(list(said)), said


def test_long_conversations_against_strings_of_suffixes():
    rng = random.Random(3)
    for n in [*range(3, 60)] * 4:
        roles = rng.choice([("user", "assistant"), ("user",), ("user", "assistant", "system", "tool", ""), ("assistant",)])
        said = [(rng.choice(roles), rng.choice(["", "x", f"{rng.randrange(9)}.", f"{i}!", f"{i}?", f"{i}"])) for i in range(n)]
        cost, audit, out = by_suffixes(said)
        assert repaired(said) == (cost, audit, list(out))


def test_undecided_rows_are_few_and_numbers_stay_short():
    rng = random.Random(4)
    r, most = conversations.Repair(lambda *x: None), 0
    for i in range(20_000):
        r.feed(i, rng.choice(["user", "assistant"]), f"{i}.", False, True)
        most = max(most, len(r.waiting))
    assert most < 200
    r.end()
    assert len(r.audit) >= 20_000


def test_the_query_against_the_contract(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: r.asDict() for r in queries.op11_conversation_repair(spark, SF).collect()}
    want = damaged(rows)
    assert set(got) == set(want)
    for conv, said in want.items():
        for name, value in expected(said).items():
            assert got[conv][name] == value, (conv, name)


def test_nulls_ties_repeats_and_rows_that_are_all_gone(spark):
    rng = random.Random(6)
    pick = lambda *x: rng.choice(x)
    rows = [(pick(1, 2, 3, None, *range(10, 60)), pick(None, 0, 0, 1, 2, 5), pick("user", "assistant", "system", None, "", "tool"), pick(None, "", "a.", "a.", "b", "c! ", " \t\n")) for _ in range(600)]
    gone = next(i for i in range(1000, 5000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "x."))
    df = spark.createDataFrame([(*r, "x", True, 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, gone boolean, place int")
    broken = conversations.damage(df)
    got = {r.conv_id: r.asDict() for r in conversations.repair_report(broken).collect()}
    want = damaged(rows)
    assert set(got) == set(want) and got[gone]["audit"] == "" and got[gone]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    for conv, said in want.items():
        for name, value in expected(said).items():
            assert got[conv][name] == value, (conv, name)
    turns = {}
    for t in sorted(conversations.repaired_turns(broken).collect(), key=lambda t: t.place):
        turns.setdefault(t.conv_id, []).append(t)
    for conv, edits in turns.items():
        assert "".join(t.edit for t in edits) == got[conv]["audit"] and [t.place for t in edits] == list(range(len(edits)))
        told = "\n".join(f"{t.role}:{t.text}" for t in edits if t.edit != "D")
        assert hashlib.sha256(told.encode()).hexdigest() == got[conv]["repaired_sha256"]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair_report(conversations.damage(empty)).count() == 0 and conversations.repaired_turns(empty).count() == 0
