"""Secret scans with a recursive decoding worklist.

Each text is the first layer. URL escapes, Unicode escapes, base64 and compressed bytes inside any of them are unwrapped into further layers;
each layer is scanned and unwrapped in turn, until no layer is new. A set of the layers seen, each at its place, ends cycles; equal
layers at different places all count. Every finding carries a span of the original text: escapes and base64 map character by character, a
compressed layer maps to the base64 run that held it, or to what its compressed bytes are written as in escapes.

What is searched for, and every encoding, is written in ASCII; so bytes that are no ASCII text part a decoded run into layers, and compressed
bytes are read as Latin-1.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hirelake.llm.shared import give_back, small_batches

#: Kinds in their order, with patterns; only ASCII letters match in either case.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8

#: One or more URL escapes; a percent sign that is itself escaped, however often, counts as one.
URL_RUN = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
URL_ESCAPE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
UNICODE_RUN = re.compile(r"\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[Xx][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
PADDING = re.compile(r"(?:=|%(?:25)*3[Dd]|\\u003[Dd]|\\x3[Dd]|&#61;){0,2}")
#: A run at the end of a line, and lines that hold nothing else; breaks may be escaped.
WRAPPED_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[\t\x20]*+(?:\r?\n|\\r\\n|\\n)[\t\x20]*+[A-Za-z0-9+/_-]++)++")
WRAPPED_PART = re.compile(r"(?:\\r\\n|\\n|[\s]+)+|[A-Za-z0-9+/_-]+")
#: Decoded bytes that can hold a secret or a further layer: the shortest is an assignment of eight characters.
READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
COMPRESSED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: Bytes as they stand between escapes: escaped or as the character itself. Groups: in hexadecimal, decimal, by a letter, itself.
URL_BYTE = re.compile(r"%(?:25)*(?P<hex>[0-9A-Fa-f]{2})|(?P<own>[!-$&-~])")
UNICODE_BYTE = re.compile(
    r"(?:\\x|\\u00|\\U000000)(?P<hex>[0-9A-Fa-f]{2})|\\u\{0*(?P<hex2>[0-9A-Fa-f]{1,2})\}|&#[Xx]0*(?P<hex3>[0-9A-Fa-f]{1,2});|&#0*(?P<dec>[0-9]{1,3});|\\(?P<short>[abfnrtv0\\'\"/])|(?P<own>[^\\\u0100-\U0010ffff])"
)
SHORT = {"0": 0, "a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}


def _written(code: int) -> str:
    """A pattern of a byte in Unicode escapes."""
    h = "".join(f"[{d}{d.upper()}]" for d in f"{code:02x}")
    least = h if code > 15 else f"[{code:x}{code:X}]"
    named = "".join(rf"|\\{k}" for k, v in SHORT.items() if v == code)
    return rf"(?:\\x{h}|\\u00{h}|\\U000000{h}|\\u\{{0*{least}\}}|&#[Xx]0*{least};|&#0*{code};|{re.escape(chr(code))}{named})"


#: How compressed bytes begin in URL and in Unicode escapes.
URL_PACKED = re.compile(r"%(?:25)*1[Ff]%(?:25)*8[Bb]%(?:25)*08|(?:x|%(?:25)*78)(?:%(?:25)*(?:01|5[Ee]|9[Cc]|[Dd][Aa])|\^)")
UNICODE_PACKED = re.compile("".join(_written(x) for x in (0x1F, 0x8B, 0x08)) + "|" + _written(0x78) + "(?:" + "|".join(_written(x) for x in (0x01, 0x5E, 0x9C, 0xDA)) + ")")
#: No secret and no encoded run goes across one of these; an unpacked stream is cut only there.
BORDER = re.compile(rb"[^A-Za-z0-9+/_.=\"':\x20%\\&#;{}\r\n\t-]")
#: Bytes unpacked at a time.
PIECE_BYTES = 1 << 20


def scan(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every base match, leftmost and non-overlapping per kind."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_VALUE:
            found.append((m.start(), "assign", m.end()))
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def _one_place(begin: int, end: int, n: int) -> np.ndarray:
    """Places of ``n`` characters that all stand for the same run, held as one."""
    return np.broadcast_to(np.array([[begin], [end]], np.int64), (2, n))


def _is_one(at: np.ndarray) -> bool:
    return at.strides[1] == 0


def _replaced(layer: str, base: np.ndarray, found: Iterator[tuple[int, int, str, list[int], list[int]]]) -> tuple[str, np.ndarray]:
    """``layer`` with parts replaced; found: begin, end, new characters, and where in the layer the source of each begins and stops."""
    if _is_one(base):
        parts, last = [], 0
        for begin, end, fresh, _, _ in found:
            parts += [layer[last:begin], fresh]
            last = end
        text = "".join([*parts, layer[last:]])
        return text, _one_place(base[0, 0], base[1, 0], len(text))
    parts, starts, stops, last = [], [], [], 0
    for begin, end, fresh, at, to in found:
        parts += [layer[last:begin], fresh]
        starts += [np.arange(last, begin), np.array(at, np.int64)]
        stops += [np.arange(last, begin), np.array(to, np.int64) - 1]
        last = end
    parts.append(layer[last:])
    rest = np.arange(last, len(layer))
    return "".join(parts), np.stack([base[0, np.concatenate([*starts, rest])], base[1, np.concatenate([*stops, rest])]])


def _url_escapes(layer: str) -> Iterator[tuple[int, int, str, list[int], list[int]]]:
    for m in URL_RUN.finditer(layer):
        each = list(URL_ESCAPE.finditer(layer, m.start(), m.end()))
        raw = bytes(int(e.group(1), 16) for e in each)
        text, at, to, k = raw.decode("utf-8", "replace"), [], [], 0
        for c in text:
            at.append(each[min(k, len(each) - 1)].start())
            k += 1 if c == "\ufffd" else len(c.encode())
            to.append(each[min(k, len(each)) - 1].end())
        yield m.start(), m.end(), text, at, to


def _unicode_escapes(layer: str) -> Iterator[tuple[int, int, str, list[int], list[int]]]:
    for m in UNICODE_RUN.finditer(layer):
        s = m.group()
        if s[0] == "&":
            code = int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
        elif len(s) == 12:  # two halves of one character
            code = 0x10000 + ((int(s[2:6], 16) & 0x3FF) << 10) + (int(s[8:], 16) & 0x3FF)
        else:
            code = int(s[2:].strip("{}"), 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            yield m.start(), m.end(), chr(code), [m.start()], [m.end()]


def _members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What the gzip members (or zlib streams) at the beginning of a stream of bytes hold, a piece at a time. Ends where they end or break."""
    unpack, rest, full = None, b"", False
    for chunk in chunks:
        rest += chunk
        while rest or full:
            if unpack is None:
                if len(rest) < 3:
                    break
                if not COMPRESSED.match(rest):
                    return
                unpack = zlib.decompressobj(47)
            try:
                out = unpack.decompress(rest, PIECE_BYTES)
            except zlib.error:
                return
            full = len(out) == PIECE_BYTES and not unpack.eof  # more may wait inside
            rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            unpack = None if unpack.eof else unpack
            if out:
                yield out


def _unpacked(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """As ``_members``, and again while what comes out is compressed itself; a stream that holds itself (known by its first piece) ends."""
    seen, out = set(), _members(chunks)
    while True:
        head = b""
        for piece in out:
            head += piece
            if len(head) >= 3:
                break
        if not COMPRESSED.match(head):
            return chain([head] if head else [], out)
        digest = hashlib.sha1(head).digest()
        if digest in seen:
            return iter(())
        seen.add(digest)
        out = _members(chain([head], out))


def _texts_in(chunks: Iterator[bytes]) -> Iterator[str]:
    """A stream of bytes in layers, cut where nothing goes across."""
    held = bytearray()
    for piece in chunks:
        border = BORDER.search(piece[::-1])
        cut = len(piece) - border.start() if border else 0
        if cut:
            yield (held + piece[:cut]).decode("latin-1")
            held = bytearray(piece[cut:])
        else:
            held += piece
    if held:
        yield held.decode("latin-1")


def _base64_layers(run: str, at: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Layers inside a run of base64 characters, whichever of its first four characters the encoding begins with. at: places of the run's characters."""
    whole = run.replace("-", "+").replace("_", "/")
    for shift in range(4):
        body = whole[shift:]
        body = body[: len(body) - (len(body) % 4 == 1)]
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
        for m in READABLE.finditer(raw):
            text = m.group().decode("ascii")
            if _is_one(at):
                yield text, at[:, : len(text)]
                continue
            k = np.arange(m.start(), m.end())  # three bytes come from four characters
            yield text, np.stack([at[0, shift + k * 4 // 3], at[1, np.minimum(shift + (k * 4 + 3) // 3, len(run) - 1)]])
        for m in COMPRESSED.finditer(raw):
            for text in _texts_in(_unpacked(raw[k : k + PIECE_BYTES] for k in range(m.start(), len(raw), PIECE_BYTES))):
                yield text, _one_place(at[0, 0], at[1, -1], len(text))


def _bytes_from(layer: str, start: int, unit: re.Pattern, plus: str) -> Iterator[tuple[int, int]]:
    """Each byte that is written from ``start`` on, and where it ends. plus: what a plus sign of its own stands for."""
    while m := unit.match(layer, start):
        kind, told = m.lastgroup, m.group(m.lastgroup)
        start = m.end()
        if kind == "own":
            code = ord(plus if told == "+" else told)
        elif kind == "short":
            code = SHORT.get(told, ord(told))
        else:
            code = int(told, 10 if kind == "dec" else 16)
        if code > 255:
            return
        yield code, start


def _packed_run(units: Iterator[tuple[int, int]]) -> tuple[bytes, int]:
    """The compressed members (or streams) that the bytes begin with, and where the last of them ends or breaks; nothing if nothing comes out of them."""
    data, ends, some = bytearray(), [], False
    unpack, begin = None, 0
    for code, end in units:
        data.append(code)
        ends.append(end)
        if unpack is None:
            if len(data) - begin < 3:
                continue
            if not COMPRESSED.match(data, begin):
                break
            unpack, fresh = zlib.decompressobj(47), bytes(data[begin:])
        else:
            fresh = bytes((code,))
        try:
            while fresh:
                some = bool(unpack.decompress(fresh, PIECE_BYTES)) or some
                fresh = b"" if unpack.eof else unpack.unconsumed_tail
        except zlib.error:
            break
        if unpack.eof:
            unpack, begin = None, len(data)
    else:
        begin = len(data) if unpack is not None else begin  # cut off
    if unpack is not None:
        begin = len(data)
    return (bytes(data[:begin]), ends[begin - 1]) if some and begin else (b"", 0)


def _packed_layers(layer: str, base: np.ndarray, heads: re.Pattern, unit: re.Pattern) -> Iterator[tuple[str, np.ndarray]]:
    """Layers of compressed bytes that are written in escapes. A plus sign is one or, as in forms, a blank."""
    at = 0
    while head := heads.search(layer, at):
        at = head.end()
        for plus in "+ " if unit is URL_BYTE else "+":
            data, end = _packed_run(_bytes_from(layer, head.start(), unit, plus))
            for text in _texts_in(_unpacked(data[k : k + PIECE_BYTES] for k in range(0, len(data), PIECE_BYTES))) if data else ():
                yield text, _one_place(base[0, head.start()], base[1, end - 1], len(text))


def _key(layer: str, at: np.ndarray) -> bytes:
    """A layer's content and place. A cycle comes back to the same place: only compressed layers grow, and their characters all
    stand for the run that held them."""
    digest = hashlib.sha1(layer.encode("utf-8", "surrogatepass"))
    digest.update(np.ascontiguousarray(at[:, :1] if (at == at[:, :1]).all() else at, np.int64).tobytes())
    return digest.digest()


def _layers(layer: str, base: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """The layers one step below."""
    if "%" in layer and URL_RUN.search(layer):
        yield _replaced(layer, base, _url_escapes(layer))
        yield from _packed_layers(layer, base, URL_PACKED, URL_BYTE)
    if ("\\" in layer or "&#" in layer) and UNICODE_RUN.search(layer):
        yield _replaced(layer, base, _unicode_escapes(layer))
        yield from _packed_layers(layer, base, UNICODE_PACKED, UNICODE_BYTE)

    def places(parts: list[tuple[int, int]]) -> np.ndarray:
        """Of the characters of a run; the last goes on over the padding."""
        if _is_one(base):
            return base[:, : sum(b - a for a, b in parts)]
        out = base[:, np.concatenate([np.arange(a, b) for a, b in parts])]
        out[1, -1] = base[1, PADDING.match(layer, parts[-1][1]).end() - 1]
        return out

    for m in BASE64_RUN.finditer(layer):
        yield from _base64_layers(m.group(), places([m.span()]))
    if "\n" in layer or "\\n" in layer:
        for m in WRAPPED_RUN.finditer(layer):
            run = [(x.start(), x.end()) for x in WRAPPED_PART.finditer(layer, m.start(), m.end()) if layer[x.start()] not in "\\ \t\r\n"]
            yield from _base64_layers("".join(layer[a:b] for a, b in run), places(run))


def unwrapped(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """(layer, places) for every layer below ``text``: where in ``text`` the source of each of the layer's characters begins and stops."""
    if "%" not in text and "\\" not in text and "&#" not in text and not BASE64_RUN.search(text):
        return
    whole = np.arange(len(text))
    seen, work = set(), [(text, np.stack([whole, whole + 1]))]
    while work:
        layer, base = work.pop()
        for inner, at in _layers(layer, base):
            key = _key(inner, at)
            if key not in seen:
                seen.add(key)
                yield inner, at
                work.append((inner, at))


def spans_of(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans (base ones and those found in deeper layers), by start, kind, end."""
    order = {k: i for i, k in enumerate(KINDS)}
    by = lambda x: (x[0], order[x[1]], x[2])
    base = sorted(scan(text), key=by)
    more = set()
    for layer, at in unwrapped(text):
        for start, kind, end in scan(layer):
            more.add((int(at[0, start]), kind, int(at[1, end - 1])))
    return base, sorted(more | set(base), key=by) if more else base


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base and all spans as lists of (kind, start, end) in code points, end exclusive.

    Whole texts are scanned; a null text counts as empty and gives empty lists. Rows are independent: ids may repeat
    or be null, other columns are ignored, an empty table gives an empty result.
    """
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    small_batches(df.sparkSession)
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("base", span), T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            base, full = [], []
            texts = batch.column(1)
            for k in range(batch.num_rows):
                b, s = spans_of(texts[k].as_py() or "")
                base.append([{"kind": x, "start": a, "end": z} for a, x, z in b])
                full.append([{"kind": x, "start": a, "end": z} for a, x, z in s])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(full, kind)], names=["id", "base", "spans"])
        give_back()

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
