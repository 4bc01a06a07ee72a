import base64
import gzip
import random
import re
import time
import tracemalloc
import urllib.parse
import zlib

import pytest

from hirelake.llm import secret_scan
from hirelake.llm.secret_scan import find_secrets, scan, spans_of

S = "password=hunter2hunter"
B = base64.b64encode(S.encode()).decode()
LONG = ("header, nothing to see here at all. " * 4 + S + ", and a tail of some length that follows it. ") * 2


def b64(raw):
    return base64.b64encode(raw if isinstance(raw, bytes) else raw.encode()).decode()


def wrapped(run, width, end="\n"):
    return end.join(run[i : i + width] for i in range(0, len(run), width))


@pytest.mark.parametrize(
    "text",
    [
        "path/" + B, "x" + B, "ab" + B, "abc" + B, "key_" + B, wrapped(b64(LONG), 76), wrapped(b64(LONG), 64, "\r\n  "), '"' + wrapped(b64(LONG), 64, "\\n") + '"',
        wrapped(b64(gzip.compress(LONG.encode())), 24), b64(gzip.compress(b"nothing") + gzip.compress(S.encode())), b64(zlib.compress(S.encode())), b64(gzip.compress(gzip.compress(S.encode()))),
        b64(gzip.compress(B.encode())), b64(b64(b64(S))), urllib.parse.quote(urllib.parse.quote(urllib.parse.quote(S, safe=""), safe=""), safe=""), "pass%77ord%3Dhunter2hunter", "pass%%377ord=hunter2hunter",
        "".join(f"\\u{ord(c):04x}" for c in S), "".join(f"&#{ord(c)};" for c in S), "".join(f"&#x{ord(c):x};" for c in S), "".join(f"\\x{ord(c):02x}" for c in S), "".join(f"\\u{{{ord(c):x}}}" for c in S),
        "\\ud83d\\ude00 pass\\u0077ord=hunter2hunter", "see a/" + b64(gzip.compress(S.encode())), b64("é ünï " + S), "data:text/plain;base64," + B + "&x=1",
    ],
)
def test_every_layer_is_reached(text):
    for around in ("", "é, "):
        base, spans = spans_of(around + text + around)
        more = [x for x in spans if x not in base]
        assert [k for _, k, _ in more if k == "assign"], text
        assert all(len(around) <= a < b <= len(around + text) for a, _, b in more)


def escaped(raw, form):
    return "".join(form.format(b) for b in raw)


@pytest.mark.parametrize(
    "text",
    [
        urllib.parse.quote(gzip.compress(S.encode()), safe=""), urllib.parse.quote_plus(gzip.compress(S.encode())), urllib.parse.quote(urllib.parse.quote(zlib.compress(S.encode()))), escaped(gzip.compress(S.encode()), "%{:02x}"),
        escaped(gzip.compress(S.encode()), "\\x{:02x}"), escaped(zlib.compress(S.encode()), "\\u{:04x}"), escaped(gzip.compress(B.encode()), "&#{};"), escaped(gzip.compress(gzip.compress(S.encode())), "&#x{:x};"),
        repr(gzip.compress(S.encode()))[2:-1], b64(urllib.parse.quote(gzip.compress(S.encode()))), escaped(gzip.compress(b"nothing") + gzip.compress(S.encode()), "\\x{:02X}"),
    ],
)
def test_compressed_bytes_behind_escapes(text):
    for around in ("", "é, "):
        base, spans = spans_of(around + text + around)
        more = [x for x in spans if x not in base and x[1] == "assign"]
        assert more and all(len(around) <= a < b <= len(around + text) for a, _, b in more), text


def test_escaped_bytes_that_only_begin_as_compressed():
    for text in ("%1f%8b%08" * 2000, "\\x1f\\x8b\\x08" * 2000, "x^ %41" * 3000, "%78%01%00%ff%ff%00%00" * 500, "%1f%8b%08"):
        assert spans_of(text)[1] == []


def plain_layers(cells):
    """One step below a list of (character, start, stop), stepping through it: URL and Unicode escapes, then base64 at four alignments."""
    text, out, letters = "".join(c for c, _, _ in cells), [], "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for lead, digits, least in (("%", 2, 3), ("\\x", 2, 4), ("\\u", 4, 6)):
        fresh, i = [], 0
        while i < len(cells):
            code = text[i + len(lead) : i + len(lead) + digits]
            if text.startswith(lead, i) and len(code) == digits and all(c in "0123456789abcdefABCDEF" for c in code):
                fresh.append((chr(int(code, 16)), cells[i][1], cells[i + least - 1][2]))
                i += least
            else:
                fresh.append(cells[i])
                i += 1
        out.append(fresh)
    i = 0
    while i < len(cells):
        j = i
        while j < len(cells) and text[j] in letters:
            j += 1
        for shift in range(4) if j - i >= 16 else ():
            bits = "".join(f"{letters.index(c):06b}" for c in text[i + shift : j])
            row = []
            for k in range(0, len(bits) - 7, 8):
                c, first, last = int(bits[k : k + 8], 2), i + shift + k // 6, i + shift + (k + 7) // 6
                if c in b"\t\n\r" or 32 <= c < 127:
                    row.append((chr(c), cells[first][1], cells[last][2]))
                    continue
                out.append(row)
                row = []
            out.append(row)
        i = max(j, i + 1)
    return [x for x in out if len(x) >= 12 and x != cells]


def test_added_spans_equal_brute_force():
    rng = random.Random(8)
    forms = [lambda t: urllib.parse.quote(t, safe=""), lambda t: escaped(t.encode(), "\\x{:02x}"), lambda t: escaped(t.encode(), "\\u{:04x}"), lambda t: base64.b64encode(t.encode()).decode().rstrip("=")]
    some = 0
    for _ in range(300):
        inner = rng.choice([S, "token: " + "k" * rng.randint(7, 12), "AKIA" + "Z9" * rng.randint(5, 8), "0123456789abcdef" * 2]) + rng.choice(["", " and more", ", x"])
        for _ in range(rng.randint(1, 3)):
            inner = rng.choice(["", "see ", "a/"]) + rng.choice(forms)(inner) + rng.choice(["", ", end", "!"])
        found, work, seen = set(), [[(c, i, i + 1) for i, c in enumerate(inner)]], []
        while work:
            for cells in plain_layers(work.pop()):
                if cells not in seen:
                    seen.append(cells)
                    work.append(cells)
                    found |= {(cells[a][1], kind, cells[b - 1][2]) for a, kind, b in brute("".join(c for c, _, _ in cells))}
        base, spans = spans_of(inner)
        assert set(spans) == found | set(base), inner
        some += len(found - set(base)) > 0
    assert some > 200


def test_one_place_for_a_whole_unpacked_layer():
    bomb = b64(gzip.compress(b"a" * 8_000_000 + b" " + S.encode()))
    tracemalloc.start()
    _, spans = spans_of(bomb)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (0, "assign", len(bomb)) in spans and peak < 100_000_000


def test_secret_across_pieces_of_an_unpacked_layer(monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE_BYTES", 64)
    rng = random.Random(3)
    for n in range(0, 130, 7):
        raw = ("".join(rng.choice("xyz ,") for _ in range(n)) + ", " + S + "é," + "q" * n + "," + B).encode()
        _, spans = spans_of(b64(gzip.compress(raw[:40]) + gzip.compress(raw[40:])))
        assert [k for _, k, _ in spans if k == "assign"] == ["assign"]
        assert "".join(secret_scan._texts_in(secret_scan._unpacked(iter([gzip.compress(raw)])))) == raw.decode("latin-1")


def test_cycles_end():
    # The shortest stream that a loop could follow: layers that come back to themselves.
    for text in ("%2525252525" * 50, "V" * 5000, "A" * 5000, "%25" * 3000, "&#38;" * 500 + "#97;"):
        assert [k for _, k, _ in spans_of(text)[1]] in ([], ["hex"])


@pytest.mark.parametrize("text", ["a" * 1_000_000 + "%41", "x9_" * 350_000, "%41" * 330_000, "abcdef0123456789/" * 60_000, ("f" * 76 + "\n") * 13_000, "token " * 170_000, "A" * 15 + (" " + "A" * 15) * 60_000, "%25" * 330_000])
def test_a_megabyte_takes_no_longer_than_its_length(text):
    began = time.process_time()
    spans_of(text)
    assert time.process_time() - began < 4


def brute(text):
    """Base spans by stepping through the text, without the scanner's patterns."""
    found, word = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    def assign(i):
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if low.startswith(name, i):
                j = i + len(name)
                j += text[j : j + 1] in ('"', "'") and j < len(text)
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "=") or j >= len(text):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ('"', "'") and j < len(text)
                k = j
                while k < len(text) and text[k] in word:
                    k += 1
                if k > j:
                    return j, k
        return None

    i = 0
    while i < len(text):
        if hit := assign(i):
            if hit[1] - hit[0] >= 8:
                found.append((i, "assign", hit[1]))
            i = hit[1]
        else:
            i += 1
    for kind, least, begin, chars in (("access", 16, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")), ("hex", 32, "", set("0123456789abcdef"))):
        i = 0
        while i < len(text):
            k = i
            while text.startswith(begin, i) and k < len(text) and text[k] in chars:
                k += 1
            if k - i >= least:
                found.append((i, kind, k))
            i = max(k, i + 1)
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda x: (x[0], order.index(x[1]), x[2]))


def test_base_spans_equal_brute_force(spark):
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rng = random.Random(2)
    bits = ["password", "Token", "api_key", "apikey", "secret", "=", ":", " ", "  ", '"', "'", "abcdefgh", "1234567890abcdef", "AKIA", "AKIAABCDEFGH1234", "\n", "é", "ſ", "K", "x", "0" * 31, "-"]
    docs += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    assert sum(map(bool, map(brute, docs))) > 100
    for t in docs:
        assert spans_of(t)[0] == brute(t), t
    assert re.fullmatch(secret_scan.ASSIGN, "paſſword=abcdefghij") is None and scan("") == []


def test_every_span_of_documents_is_kept(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in find_secrets(df).collect()}
    for r in df.collect():
        assert [tuple(x) for x in got[r.doc_id].spans] == [(k, a, b) for a, k, b in spans_of(r.text or "")[1]]
