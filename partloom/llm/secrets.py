"""Secrets in texts and in what is encoded inside them.

The text is scanned, and every run in it that is URL-encoded, written in Unicode escapes or character references, or
base64 is unwrapped into layers of its own, until nothing new comes up. Bytes become text whatever they hold, and each
compressed stream in them is a layer too. Base64 is read from each of its four alignments, so that a value behind other
characters of the alphabet (a path, a name) is met, and also over line ends. A content is scanned once in a document;
what it holds, with all layers inside it, is reported at each place of the text where it is encoded. Wrapped base64 is
reported as a whole where its lines alone don't hold the same.

Defined results: a null text is empty and has no spans; repeated rows each get a row; texts of any length are read whole;
an empty table gives an empty result. What unpacks to more than `largest` bytes is read in pieces of that size, which
overlap by what the longest secret across their edge may take.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in their order.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # shorter runs fail, and no later start in one is longer
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]?[0-9A-Fa-f]+;")
#: What the shortest secret takes in base64.
_SHORTEST = 16
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{{_SHORTEST},}}={{0,2}}")
#: Base64 that goes on over whole lines.
_WRAPPED = re.compile(rf"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{_SHORTEST},}}+(?:[ \t]*+\r?\n[ \t>#*]*+[A-Za-z0-9+/_-]++(?=={{0,2}}[ \t]*+(?:[\r\n"'<>`,;)]|\Z)))+={{0,2}}""")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/_-]+")
_STANDARD = str.maketrans("-_", "+/")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
#: Bytes that the pieces of a large stream share: a secret, or a layer inside, up to that long is met whole.
OVERLAP = 1 << 20
_EDGE = re.compile(r"[\s\"'<>`]")
Span = tuple[int, int, int]  # start, kind's number, end


def scan(text: str) -> list[Span]:
    """Each kind's leftmost matches that don't overlap, without those that are too short."""
    found = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api_key", "apikey")):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _runs(text: str, sign: re.Pattern) -> Iterator[tuple[int, int]]:
    """The runs without white space or quotes that hold the sign."""
    end = 0
    edges = None
    for m in sign.finditer(text):
        if m.start() < end:
            continue
        if edges is None:
            edges = [-1, *(e.start() for e in _EDGE.finditer(text)), len(text)]
        i = bisect_left(edges, m.start())
        start, end = edges[i - 1] + 1, edges[i]
        yield start, end


def _unescape(run: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code is None:
            return html.unescape(m[0])
        return chr(int(code, 16)) if int(code, 16) < 0x110000 else m[0]

    text = _ESCAPE.sub(one, run)
    # Two escapes may be the halves of one character.
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _read(raw: memoryview, piece: int) -> Iterator[bytes | int]:
    """What the compressed streams at the start of raw unpack to, one after the other, in parts of `piece` bytes at most,
    and at the end the number of bytes they take. A damaged stream ends where the damage is met."""
    rest = raw
    while m := _PACKED.match(rest):
        by_zlib = m[0][:1] in b"\x1f\x78"
        tool = bz2.BZ2Decompressor() if m[0][:1] == b"B" else lzma.LZMADecompressor() if m[0][:1] == b"\xfd" else zlib.decompressobj(47)
        given: bytes | memoryview = rest
        try:
            while True:
                part = tool.decompress(given, piece)
                if part:
                    yield part
                given = tool.unconsumed_tail if by_zlib else b""
                if tool.eof or not part:
                    break
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            break
        if not tool.eof:  # cut off
            rest = rest[len(rest) :]
            break
        rest = tool.unused_data.lstrip(b"\0")
    yield len(raw) - len(rest)


def _unpack(raw: memoryview, largest: int, ends: list[int]) -> Iterator[bytes]:
    """The unpacked streams as one, or if that is larger than `largest`, in pieces of that size that overlap by `OVERLAP`.
    ends gets the number of bytes of raw that they take, at least 1."""
    now = bytearray()
    for part in _read(raw, 1 << 20):
        if isinstance(part, int):
            ends.append(max(1, part))
            continue
        now += part
        if len(now) > largest:
            yield bytes(now)
            del now[: max(1, len(now) - min(OVERLAP, largest // 2))]
    if now:
        yield bytes(now)


def _contents(raw: bytes, largest: int) -> Iterator[str]:
    """The bytes as text, and what the compressed streams in them unpack to, stream in stream."""

    def inside(raw: bytes) -> Iterator[bytes]:
        end = 0
        for m in _PACKED.finditer(raw):
            if m.start() >= end:
                ends: list[int] = []
                yield from _unpack(memoryview(raw)[m.start() :], largest, ends)
                if ends[-1] > 1:
                    end = m.start() + ends[-1]

    yield raw.decode("utf-8", "replace")
    yield from _wide(raw)
    seen = {_digest(raw)}
    work = [inside(raw)]
    while work:  # one stream's pieces at a time, however many there are
        if (piece := next(work[-1], None)) is None:
            work.pop()
        elif (d := _digest(piece)) not in seen:
            seen.add(d)
            yield piece.decode("utf-8", "replace")
            yield from _wide(piece)
            work.append(inside(piece))


def _wide(raw: bytes) -> Iterator[str]:
    """The bytes as UTF-16, if every other one is mostly null."""
    for name, high in (("utf-16-le", raw[1::2]), ("utf-16-be", raw[::2])):
        if len(raw) > 3 and 2 * high.count(0) > len(high):
            yield raw.decode(name, "replace")


def _digest(x: bytes | str) -> bytes:
    return hashlib.blake2b(x if isinstance(x, bytes) else x.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _from_base64(run: str, largest: int) -> Iterator[str]:
    body = run.translate(_STANDARD)
    for at in range(min(4, len(body) - _SHORTEST + 1)):
        part = body[at : len(body) - ((len(body) - at) % 4 == 1)]
        yield from _contents(base64.b64decode(part + "=" * (-len(part) % 4)), largest)


def layers(text: str, largest: int) -> Iterator[tuple[int, int, str]]:
    """start, end, content of what is encoded in the text, one level deep."""
    if "%" in text:
        for s, e in _runs(text, _PERCENT):
            yield from ((s, e, inner) for inner in _contents(unquote_to_bytes(text[s:e]), largest))
    if "\\" in text or "&#" in text:
        for s, e in _runs(text, _ESCAPE):
            inner = _unescape(text[s:e])
            yield s, e, inner
            if inner.isascii():
                continue
            try:
                raw = inner.encode("latin-1")
            except UnicodeEncodeError:
                continue
            yield from ((s, e, deeper) for deeper in _contents(raw, largest))
    for m in _BASE64.finditer(text):
        yield from ((m.start(), m.end(), inner) for inner in _from_base64(m[0].rstrip("="), largest))
    for m in _WRAPPED.finditer(text):
        yield from ((m.start(), m.end(), inner) for inner in _from_base64(_NOT_BASE64.sub("", m[0]), largest))


def find(text: str | None, largest: int = 1 << 26) -> tuple[list[Span], list[Span]]:
    """The spans in the text itself, and all spans with those of every layer inside it, in order, each once."""
    text = text or ""
    base = scan(text)
    held: dict[bytes, set[tuple[int, str]]] = {}  # kinds and secrets of each content, by its digest
    outer: dict[bytes, set[bytes]] = {}

    def enter(content: str, d: bytes) -> Iterator[tuple[int, int, str]]:
        held[d] = {(kind, content[s:e]) for s, kind, e in scan(content)}
        return layers(content, largest)

    top = []
    for s, e, inner in layers(text, largest):
        d = _digest(inner)
        top.append((s, e, d))
        work = [] if d in held else [(d, enter(inner, d))]
        while work:  # the contents on the way down are the only ones held
            around, rest = work[-1]
            if (found := next(rest, None)) is None:
                work.pop()
                continue
            d = _digest(found[2])
            outer.setdefault(d, set()).add(around)
            if d not in held:
                work.append((d, enter(found[2], d)))
    # What a content holds goes to those around it until none learns more, so cycles end and lose nothing.
    work = [d for d, found in held.items() if found]
    while work:
        content = work.pop()
        for around in outer.get(content, ()):
            if not held[content] <= held[around]:
                held[around] |= held[content]
                work.append(around)
    of_run: dict[tuple[int, int], set[tuple[int, str]]] = {}
    for s, e, inner in top:
        if held[inner]:
            of_run.setdefault((s, e), set()).update(held[inner])
    runs = sorted(of_run)
    for m in _WRAPPED.finditer(text):
        if m.span() in of_run:
            for s, e in runs[bisect_left(runs, (m.start(), 0)) : bisect_left(runs, (m.end(), 0))]:
                if (s, e) != m.span() and e <= m.end():
                    of_run[m.span()] = of_run[m.span()] - of_run[s, e]
    return base, sorted({*base, *((s, kind, e) for (s, e), found in of_run.items() for kind, _ in found)})


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secrets(docs: DataFrame, largest: int = 1 << 26) -> DataFrame:
    """doc_id, counts and spans for every row of docs. spans: kind, start, stop, in_text (false: from a layer inside)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t, largest) for t in batch.column(1).to_pylist()]
            known = [set(b) for b, _ in found]
            count = lambda k: pa.array([sum(x[1] == k for x in b) for b, _ in found], pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), count(0), count(1), count(2),
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()),
                    pa.array([[{"kind": KINDS[k], "start": s, "stop": e, "in_text": (s, k, e) in b} for s, k, e in every] for b, (_, every) in zip(known, found, strict=True)], _SPANS),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<kind:string,start:int,stop:int,in_text:boolean>>"
    )


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("in_text", pa.bool_())]))
