import base64
import gzip
import random
import urllib.parse

import pytest

from hirelake.llm import language_id, sharding, url_filter, warc
from hirelake.llm.decontamination import Matcher, best_match, find_leaks, folded, matches, pieces_of, scores
from hirelake.llm.secret_scan import find_secrets, spans_of


def distance_by_table(p, t):
    prev = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        cur = [i]
        for j in range(1, len(t) + 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (p[i - 1] != t[j - 1])))
        prev = cur
    return min(prev), prev.index(min(prev))


def test_edit_distance_equals_table():
    rng = random.Random(5)
    for _ in range(300):
        p, t = ("".join(rng.choice("ab c") for _ in range(rng.randint(lo, hi))) for lo, hi in ((1, 80), (0, 60)))
        assert best_match(p, t) == distance_by_table(p, t)


def test_items_side_by_side_are_each_found():
    rng = random.Random(3)
    item = "the quick brown fox jumps over the lazy dog near a quiet river bank"
    edited = item.replace("brown", "brwn").replace("river", "rivver")
    matcher = Matcher([("a", item), ("b", "zz"), ("c", item[10:50])], 0.08).ready()
    for copies in ([item, item], [item, edited, item], [edited] * 4, [item + item], ["x", item, "y z", edited, "q"]):
        text = " ".join(copies)
        n = text.count("lazy")
        for name, size in (("a", len(item)), ("c", 40)):
            hits = [h for h in matcher.hits(text) if h["item_id"] == name]
            assert len(hits) == n, (name, copies)
            assert all(abs(h["end"] - h["start"] - size) <= 8 for h in hits) and all(x["end"] <= y["start"] + 6 for x, y in zip(hits, hits[1:]))
    assert [(h["start"], h["end"]) for h in matcher.hits("zzz zz") if h["item_id"] == "b"] == [(0, 2), (1, 3), (4, 6)]
    for _ in range(200):  # every end within the budget belongs to an occurrence that is told
        p, t = ("".join(rng.choice("ab") for _ in range(n)) for n in (6, 40))
        ends = [j for j, s in enumerate(scores(p, t), 1) if s <= 1]
        told = matches(p, t, 1)
        runs = sum(j - i > 1 for i, j in zip([-9, *ends], ends))
        assert len(told) == runs and {j for _, j in told} <= set(ends)


def test_leaks_with_edits_are_found_and_only_those(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(40)) for k in range(6)] + [(90, None), (91, ""), (92, "  ")]
    docs, want = [], {}
    for i in range(40):
        t = text(60)
        if i % 3 == 0:
            item = items[i % 6][1]
            k = int(len(folded(item)) * 0.05)
            leak = list(item.upper().replace(" ", "\n  "))
            for _ in range(k if i % 2 else 0):
                leak[rng.randrange(len(leak))] = "Z"
            t = text(30) + " " + "".join(leak) + " " + t
        docs.append((i, t, "old"))
        f = folded(t)
        want[i] = {str(j) for j, q in items if q and q.strip() and distance_by_table(folded(q), f)[0] <= int(len(folded(q)) * 0.05)}
    docs += [(100, None, ""), (101, "", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, hits string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    for block in (2_000_000, 100):
        got = {r.doc_id: r.hits for r in find_leaks(df, asked, rate=0.05, block_chars=block).collect()}
        for i in range(40):
            assert {h.item_id for h in got[i]} == want[i]
            for h in got[i]:
                assert best_match(folded(items[int(h.item_id)][1]), folded(docs[i][1][h.start : h.end]))[0] == h.distance
        assert got[100] == [] and got[101] == []
    assert "".join(p for _, p in pieces_of("abcdefg", 2)) == "abcdefg"


def test_every_occurrence_is_told_and_odd_tables_pass(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    docs = [(1, f"{item} and then, after a long pause for breath, {item.upper()}, {'filler ' * 60000} {item.replace('quick', 'quack')}"), (1, "none"), (1, "none"), (None, item)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(7, item), (7, item), (8, "zz")], "item_id long, text string")
    got = [(r.doc_id, [(h.item_id, h.distance) for h in r.hits]) for r in find_leaks(df, asked).collect()]
    assert got == [(1, [("7", 0), ("7", 0), ("7", 1)] * 2), (1, []), (1, []), (None, [("7", 0)] * 2)]
    assert [len(r.hits) for r in find_leaks(df, asked.limit(0)).collect()] == [0] * 4 and find_leaks(df.limit(0), asked).count() == 0


S = "password=hunter2hunter"
B = base64.b64encode(S.encode()).decode()


@pytest.mark.parametrize(
    "text,base,deeper",
    [
        (S, [(0, "assign", 22)], []),
        ("token: short", [], []),
        ('ToKeN" : "abcdefgh', [(0, "assign", 18)], []),
        ("paſſword=abcdefghij", [], []),  # letters outside ASCII do not match
        ("AKIA" + "A" * 12 + " AKIAB", [(0, "access", 16)], []),
        ("a" * 31 + " " + "b" * 32, [(32, "hex", 64)], []),
        ("é " + B + " z", [], [(2, "assign", 34)]),
        ("x " + base64.b64encode(gzip.compress(S.encode(), mtime=0)).decode(), [], [(2, "assign", None)]),
        (urllib.parse.quote(S, safe=""), [], [(0, "assign", 24)]),
        ("pass\\u0077ord=abcdefgh1", [], [(0, "assign", 23)]),
        ("q=" + urllib.parse.quote(base64.b64encode(B.encode()).decode()), [], [(2, "assign", None)]),
        ("", [], []),
    ],
)
def test_secret_layers(text, base, deeper):
    got_base, spans = spans_of(text)
    assert got_base == base
    more = [s for s in spans if s not in base]
    assert [(a, k) for a, k, _ in more] == [(a, k) for a, k, _ in deeper]
    assert all(e is None or e == m[2] for m, (_, _, e) in zip(more, deeper))
    assert all(0 <= a < b <= len(text) for a, _, b in spans)


def test_secret_cycle_ends():
    text = "%2525252525" * 50
    assert spans_of(text) == ([], [])


@pytest.mark.parametrize("run", [B, urllib.parse.quote(S, safe=""), base64.b64encode(gzip.compress(S.encode(), mtime=0)).decode(), base64.b64encode(B.encode()).decode()])
def test_every_place_of_a_repeated_run_is_reported(run):
    text = f"one {run} two\n{run} three\n{run}"
    places = [i for i in range(len(text)) if text.startswith(run, i)]
    assert spans_of(text) == ([], [(i, "assign", i + len(run)) for i in places])


def test_secret_table(spark):
    df = spark.createDataFrame([(1, S, 0), (1, S, 0), (None, None, 1)], "doc_id long, text string, spans int")
    rows = find_secrets(df).collect()
    assert len(rows) == 3 and sorted(len(r.base) for r in rows) == [0, 1, 1]
    assert find_secrets(df.limit(0)).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("example.org", "/en/", "allow"), ("com", "/fr/", "allow"), ("a.b.com", "/fr/x", "block"), ("com", "", "block")]


def test_urls_match_brute_force(spark):
    rng = random.Random(1)
    hosts = ["example.org", "www.example.org", "x.org", "com", "b.com", "a.b.com", "z.a.b.com", "notexample.org", "EXAMPLE.org", "", "a..b.com", "net"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/es/a?b', '/en/12', '/en/2', '/fr/', '/fr/xy', '/es', '#/fr/'])}" for _ in range(400)] + [None, "", "nohost", "a://b://c/d", "http://x.org/\n/es/"]
    df = spark.createDataFrame([(i // 2 if i % 9 else None, u, "x") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string")
    got = sorted(map(str, url_filter.judge_urls(df, url_filter.rules_table(spark, RULES), "page_id", "url", partitions=7).collect()))
    want = []
    for r in df.collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        cut = min([k for k in (rest.find(x) for x in "/?#") if k >= 0], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([k for k in (tail.find(x) for x in "?#") if k >= 0], default=len(tail))]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit) if fit else (0, 0, None, "allow")
        want.append((r.page_id, host, path, best[2], best[3]))
    assert got == sorted(f"Row(page_id={a!r}, host={h!r}, path={p!r}, rule={r!r}, verdict={v!r})" for a, h, p, r, v in want)
    assert url_filter.judge_urls(df.limit(0), url_filter.rules_table(spark, RULES), "page_id", "url").count() == 0


@pytest.mark.parametrize("compressed", [True, False])
def test_warc_round_trip(spark, tmp_path, compressed):
    pages = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e\r\nX: y", "a\r\n\r\nWARC/1.1\r\nb"), (None, "http://f", "<p>é</p>"), (7, "http://g", "x"), (7, "http://g", "x"), (8, "u", "x"), (9, "v", "long " * 400_000)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, digest int")
    path = str(tmp_path / "w")
    warc.write_archive(df, path, compressed=compressed)
    records = warc.read_archive(spark, path)
    assert records.count() == 3 * len(pages)
    captures = warc.assemble(records)
    texts = {r.response.block for r in captures.collect() if r.response.type == "response"}
    assert texts == {p[2] or "" for p in pages}
    assert all(r.request and r.metadata for r in captures.collect())
    told = {(r.page_id, r.record_type, r.refers_to_page, r.payload_bytes, r.copies) for r in warc.resolve_revisits(captures).collect()}
    assert told == {("1", "response", None, 9, 1), ("2", "revisit", "1", 9, 1), (None, "revisit", "1", 9, 1), ("3", "response", None, 0, 1), ("4", "revisit", "3", 0, 1), ("5", "response", None, 16, 1), ("7", "response", None, 1, 2), ("8", "revisit", "7", 1, 1), ("9", "response", None, 2_000_000, 1)}


def test_captures_come_together_in_any_direction(spark, tmp_path):
    def record(kind, name, *others, block=b"b"):
        head = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + name.encode(), *(b"WARC-Concurrent-To: " + o.encode() for o in others), b"Content-Length: %d" % len(block)]
        return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n")

    raw = record("response", "p1", "q1") + record("request", "q1") + record("metadata", "m1", "q1")  # response to request, metadata to request
    raw += record("request", "q2", "p2", "m2") + record("metadata", "m2") + record("response", "p2")  # one header for each
    raw += record("response", "p3") + record("request", "q3", "p3") + record("metadata", "m3", "q3")  # a chain
    raw += record("request", "q4", "gone") + record("warcinfo", "w5") + record("response", "p6") * 2 + record("metadata", "m6", "p6")
    (tmp_path / "a.warc.gz").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(record("metadata", "m9", "q1", block=b"x" * (17 << 20)))
    got = {r.capture_id: r for r in warc.assemble(warc.read_archive(spark, str(tmp_path))).collect()}
    name = lambda r: r and r.record_id
    assert {k: (name(r.request), name(r.response), name(r.metadata), r.copies) for k, r in got.items()} == {
        "p1": ("q1", "p1", "m9", 1), "p2": ("q2", "p2", "m2", 1), "p3": ("q3", "p3", "m3", 1), "q4": ("q4", None, None, 1), "w5": (None, None, None, 1), "p6": (None, "p6", "m6", 2),
    }
    none = warc.read_archive(spark, str(tmp_path)).limit(0)
    assert warc.assemble(none).count() == 0


def test_warc_long_payloads_one_member_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    pages = [(1, "http://a", "x" * (17 << 20) + "é"), (2, "http://b", "y")] + [(k, f"http://{k}", f"page {k}") for k in range(3, 40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archive(df, str(tmp_path / "w"))
    files = sorted((tmp_path / "w").glob("part=*/*.txt"))
    assert len(files) > 5
    heads = [gzip.decompress(f.read_bytes()) for f in files]  # whole and valid, to the last byte
    assert sum(h.count(b"WARC/1.1\r\n") for h in heads) == 3 * len(pages)
    got = {r.page_id: r.payload_bytes for r in warc.resolve_revisits(warc.assemble(warc.read_archive(spark, str(tmp_path / "w")))).collect()}
    assert got == {str(i): len(h.encode()) for i, _, h in pages}
    empty = str(tmp_path / "e")
    warc.write_archive(df.limit(0), empty)


def test_warc_skips_what_is_no_record():
    good = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    found = list(warc.records_in(b"junk\r\n\r\n" + good + b"WARC/1.0\r\nContent-Length: 99\r\n\r\ncut"))
    assert [b for _, b in found] == [b"hi"]
    assert len(list(warc.records_in(gzip.compress(good) + gzip.compress(good)))) == 2


@pytest.mark.parametrize("limit", [10**6, 700, 60])
def test_shards_fit(spark, limit):
    rng = random.Random(7)
    rows = [(i, "é" * rng.randint(0, 30), "s") for i in range(300)] + [(1000, "x" * 25, "s")] * 12 + [(None, None, "s"), (1001, "y" * 500, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.assign_shards(df, limit).collect()
    assert len(got) == len(rows)
    sums, counts = {}, {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.n_bytes
        counts[r.shard] = counts.get(r.shard, 0) + 1
    for r in got:
        assert (r.shard_bytes, r.shard_rows) == (sums[r.shard], counts[r.shard])
        assert r.shard_bytes <= limit or r.shard_rows == 1
    # Only oversized buckets split: a shard's sibling and itself do not fit together.
    for name in sums:
        if "/" not in name and name:
            assert sum(v for k, v in sums.items() if k.startswith(name[:-1])) > limit
    assert sharding.assign_shards(df.limit(0), limit).count() == 0


def test_written_shards_are_those_of_the_directory(spark, tmp_path):
    rows = [(i, "é" * (i % 30), "s", 1) for i in range(300)] + [(1000, "x" * 25, "s", k) for k in range(90)] + [(1000, "z" * 7, "s", 0)] * 40 + [(None, None, "s", 2), (None, "n" * 50, "s", 3), (1001, "y" * 500, "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, each int").repartition(5)
    path = str(tmp_path / "shards")
    told = {r.shard: (r.shard_bytes, r.shard_rows) for r in sharding.write_shards(df, path, 200).collect()}
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").schema("doc_id long, text string, each int, shard string").parquet(path).collect()
    assert sorted((str(r.doc_id), r.text or "", r.each) for r in back) == sorted((str(i), t or "", e) for i, t, _, e in rows)
    sums = {}
    for r in back:
        b, n = sums.get(r.shard, (0, 0))
        sums[r.shard] = b + len((r.text or "").encode()), n + 1
    assert sums == told and all(b <= 200 or n == 1 for b, n in sums.values())
    sharding.write_shards(df.limit(0), str(tmp_path / "none"), 200)


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(language_id.learned_rows(docs))
    rows = language_id.predict(docs.withColumn("score", docs.n_chars), model).withColumn("held", language_id.held_out()).filter("held").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert sum(r.rejected for r in rows) == 0 and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, "12 !!"), (3, ""), (4, "Привет мир как дела"), (5, "und das ist nicht " * 60000)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].rejected and got[5].lang_pred == "de"
    assert language_id.predict(odd, language_id.fit(odd.withColumn("lang", odd.text).limit(0))).filter("lang_pred <> 'und'").count() == 0


UNLEARNED = {
    "it": "Il governo ha annunciato ieri una nuova legge che riguarda il lavoro e le pensioni dei cittadini",
    "fi": "Hallitus ilmoitti eilen uudesta laista joka koskee kansalaisten työtä ja eläkkeitä",
    "tr": "Hükümet dün vatandaşların çalışma ve emeklilik haklarını ilgilendiren yeni bir yasa açıkladı",
    "pl": "Rząd ogłosił wczoraj nową ustawę dotyczącą pracy i emerytur obywateli",
    "vi": "Chính phủ hôm qua đã công bố một đạo luật mới liên quan đến việc làm và lương hưu",
}


def test_unlearned_languages_in_latin_letters_are_rejected_and_held_out_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.fit(language_id.learned_rows(docs))
    odd = spark.createDataFrame([(k, (t + " ") * n) for k, t in UNLEARNED.items() for n in (1, 5)], "doc_id string, text string")
    got = language_id.predict(odd, model).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in got if not r.rejected] == []
    held = language_id.predict(docs.filter(language_id.held_out()), model).collect()
    print("held-out", len(held), "rejected", sum(r.rejected for r in held), "right", sum(r.lang_pred == r.lang for r in held))
    assert sum(r.rejected for r in held) <= 0.02 * len(held)


def test_counting_in_pieces_equals_counting_at_once(monkeypatch):
    table = language_id._letters()
    text = "Ein  kleiner Text, über 12 Dinge; naïve 🙂 Ωmega" * 9
    whole = language_id._grams(text, table)
    monkeypatch.setattr(language_id, "PIECE", 5)
    assert (language_id._grams(text, table) == whole).all()
