"""Secrets in whole texts, also inside nested encodings.

Each text is the first layer of a worklist. A layer is scanned, then unwrapped: percent escapes, Unicode escapes, base64,
and gzip, zlib, bz2 or zstd within it. What comes out is a new layer unless one with the same content and place was seen,
so the list ends at a fixpoint even for encodings that lead back to themselves. The worklist is a stack of generators,
so at any time one layer of each depth is held, and compressed data is unpacked as a stream, in windows of WINDOW
characters that overlap by OVERLAP: memory doesn't grow with what a layer unpacks to, time grows in proportion. Each layer
knows by runs which interval of the layer above its characters come from, so spans found inside point to the part of the
original text that encodes them; all that comes out of one base64 or compressed blob points to the blob.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsmith.llm.common import column_slices, require, small_batches

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
#: An escape of an escape character counts as what it ends up as, so that a chain of them is one step.
_ESCAPES = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+|(?:\\(?:u005[cC]|x5[cC])*u[0-9A-Fa-f]{4})+|\\(?:u005[cC]|x5[cC])*(?:u\{[0-9A-Fa-f]{1,6}\}|x[0-9A-Fa-f]{2})|&(?:#0{0,4}38;|#[xX]0{0,4}26;)*#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
_PERCENT, _UNICODE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})"), re.compile(r"\\(?:u005[cC]|x5[cC])*u([0-9A-Fa-f]{4})")
_PERCENT_CHAIN = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})")
_PACKED = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]{16,}+)*+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)?+={0,2}")
#: In bytes: UTF-8 text of 12 characters or more (no span is shorter), and how compressed data begins.
_READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}+")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
#: The value of a hexadecimal digit's byte, 255 for other bytes.
_HEX_VALUE = np.full(256, 255, np.uint8)
for _digits in (b"0123456789abcdef", b"0123456789ABCDEF"):
    _HEX_VALUE[list(_digits)] = range(16)
#: Unpacked data is read in pieces of so many bytes and scanned in windows of so many characters, with so many of the one before.
PIECE, WINDOW, OVERLAP = 1 << 20, 1 << 22, 1 << 16

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    low = text.lower()
    some = any(name in low for name in ("passw", "secret", "token", "api"))
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8] if some else []
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Blob:
    """Where a layer lies of which all characters come from one interval of the original text."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.start, self.end


class Runs:
    """Where a layer lies that was unescaped from the layer `above` (None: the original text).

    Of the run that holds character i, the character comes from `width` characters of the layer above, from
    `source + stride * (i - first)` on.
    """

    def __init__(self, above: Runs | None):
        self.above, self.first, self.source, self.stride, self.width = above, array("q"), array("q"), array("b"), array("q")

    def add(self, first: int, source: int, stride: int, width: int) -> None:
        for a, v in ((self.first, first), (self.source, source), (self.stride, stride), (self.width, width)):
            a.append(v)

    def span(self, start: int, end: int) -> tuple[int, int]:
        at = self
        while at is not None:
            a, b = bisect_right(at.first, start) - 1, bisect_right(at.first, end - 1) - 1
            start, end = at.source[a] + at.stride[a] * (start - at.first[a]), at.source[b] + at.stride[b] * (end - 1 - at.first[b]) + at.width[b]
            at = at.above
        return start, end


Place = Blob | Runs | None


def _span(place: Place, start: int, end: int) -> tuple[int, int]:
    return place.span(start, end) if place is not None else (start, end)


def _unescape(run: str) -> str | None:
    """The text that a run of escapes stands for, or None. Bytes that aren't UTF-8 become replacement characters."""
    try:
        if run[0] == "%":
            return bytes.fromhex("".join(_PERCENT.findall(run))).decode("utf-8", "replace")
        if run[0] == "&":
            code = run[run.rindex("#") + 1 : -1]
            return chr(int(code[1:], 16) if code[0] in "xX" else int(code))
        if run[-1] == "}":
            return chr(int(run[run.rindex("{") + 1 : -1], 16))
        if run[-3] == "x":
            return chr(int(run[-2:], 16))
        return bytes.fromhex("".join(_UNICODE.findall(run))).decode("utf-16-be", "replace")
    except (ValueError, OverflowError):
        return None


def _unquoted(text: str) -> str | None:
    """The text with all percent escapes undone, or None if it has none."""
    data = np.frombuffer(_PERCENT_CHAIN.sub("%", text).encode("utf-8", "surrogatepass"), np.uint8)
    value = _HEX_VALUE[data]
    at = np.flatnonzero((data[:-2] == 37) & (value[1:-1] < 16) & (value[2:] < 16))
    if len(at) == 0:
        return None
    out, keep = data.copy(), np.ones(len(data), bool)
    out[at] = value[at + 1] * 16 + value[at + 2]
    keep[at + 1], keep[at + 2] = False, False
    return out[keep].tobytes().decode("utf-8", "replace")


def _unescaped(text: str, place: Place) -> tuple[str, Place] | None:
    """The layer that a layer's escapes stand for, or None if it has none."""
    if isinstance(place, Blob) and "%" in text and (plain := _unquoted(text)) is not None:
        return plain, place  # all of it has one place, so no runs are needed
    if "%" not in text and "\\" not in text and "&#" not in text:
        return None
    parts: list[str] = []
    runs, size, done = Runs(place if isinstance(place, Runs) else None), 0, 0
    for m in _ESCAPES.finditer(text):
        if (plain := _unescape(m[0])) is None:
            continue
        if m.start() > done:
            parts.append(text[done : m.start()])
            runs.add(size, done, 1, 1)
            size += m.start() - done
        parts.append(plain)
        n = m.end() - m.start()
        if m[0][0] == "%" and len(plain) * 3 == n:  # a character for each escape
            runs.add(size, m.start(), 3, 3)
        else:
            runs.add(size, m.start(), 0, n)
        size += len(plain)
        done = m.end()
    if not done:
        return None
    if done < len(text):
        parts.append(text[done:])
        runs.add(size, done, 1, 1)
    return "".join(parts), place if isinstance(place, Blob) else runs


def _kind(data: bytes) -> str | None:
    """How data that begins so is compressed."""
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:3] == b"BZh":
        return "bz2"
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    return "zlib" if len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0 else None


class _Source:
    """A file of chunks, for readers of files."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.rest = chunks, b""

    def read(self, size: int) -> bytes:
        data = self.rest or next(self.chunks, b"")
        self.rest = data[size:]
        return data[:size]


def _inflate(kind: str, chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What comes out of compressed chunks, in pieces; all members that follow each other; until an error or the end."""
    if kind == "zstd":
        reader = zstandard.ZstdDecompressor().stream_reader(_Source(chunks), read_across_frames=True)
        try:
            while piece := reader.read(PIECE):
                yield piece
        except zstandard.ZstdError:
            pass
        return
    member, pending = None, b""
    for chunk in chunks:
        data, more = pending + chunk, True
        pending = b""
        while more:
            if member is None:
                if kind != "zlib" and len(data) < 4:  # whether another member follows isn't known yet
                    pending = data
                    break
                if _kind(data) != kind:
                    return
                member = bz2.BZ2Decompressor() if kind == "bz2" else zlib.decompressobj(31 if kind == "gzip" else 15)
            try:
                piece = member.decompress(data, PIECE)
            except (OSError, zlib.error):
                return
            if piece:
                yield piece
            if member.eof:
                if kind == "zlib":
                    return
                data, member = member.unused_data, None
            elif kind == "bz2":
                data, more = b"", not member.needs_input
            else:
                data = member.unconsumed_tail
                more = bool(data) or len(piece) == PIECE


def _windows(data: bytes) -> Iterator[str]:
    """The text of compressed data in overlapping windows, compressed any number of times over; none if it doesn't unpack."""
    chunks: Iterator[bytes] = iter([data])
    seen, opened = set(), False
    while True:
        first, ended = bytearray(), True
        for c in chunks:
            first += c
            if len(first) >= WINDOW:
                ended = False
                break
        head = bytes(first)
        if ended:
            if (digest := hashlib.blake2b(head, digest_size=16).digest()) in seen:  # unpacks to what was unpacked before
                return
            seen.add(digest)
            chunks = iter(())
        if (kind := _kind(head)) is None:
            break
        inner = _inflate(kind, chain([head], chunks))
        if not (piece := next(inner, b"")):
            break
        opened, chunks = True, chain([piece], inner)
    if not opened:
        return
    decoder, before = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for chunk in chain([head], chunks):
        before += decoder.decode(chunk)
        if len(before) >= WINDOW:
            yield before
            before = before[-OVERLAP:]
    yield before


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and (text.isprintable() or sum(c.isprintable() or c in "\n\r\t" for c in text) >= 0.95 * len(text)) else None


def _opened(data: bytes) -> Iterator[str] | None:
    """The text of bytes that are compressed or readable, in windows."""
    if _kind(data) and (first := next(windows := _windows(data), None)):
        return chain([first], windows)
    return None if (text := _readable(data)) is None else iter([text])


def _decoded(run: str) -> Iterator[tuple[Iterator[str], int, int]]:
    """What base64 says and the characters that say it: the whole run, or else what is readable or opens in any alignment.

    A blob may follow a path or a name whose characters base64 also has, and be followed by more of them.
    """
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 != 1 and (plain := _opened(base64.b64decode(body + "=" * (-len(body) % 4)))) is not None:
        yield plain, 0, len(run)
        return
    for k in range(4):
        n = len(body) - k
        if n < 16:
            break
        some = body[k : k + n - (n % 4 == 1)]
        data = base64.b64decode(some + "=" * (-len(some) % 4))
        until = lambda b, n=len(data): len(run) if b == n else k + -(-8 * b // 6)  # noqa: B023, E731
        for m in _READABLE.finditer(data):
            yield iter([m[0].decode("utf-8", "replace")]), k + 8 * m.start() // 6, until(m.end())
        for m in _MAGIC.finditer(data):
            yield _windows(data[m.start() :]), k + 8 * m.start() // 6, len(run)


def _layers(text: str, place: Place) -> Iterator[tuple[str, Place]]:
    """What a layer unwraps to, each with its place."""
    for m in _PACKED.finditer(text):
        for windows, a, b in _decoded(m[0]):
            blob = Blob(*_span(place, m.start() + a, m.start() + b))
            yield from ((w, blob) for w in windows)
    for m in _WRAPPED.finditer(text):
        if "\n" not in m[0]:
            continue
        lines = [(x.start(), x.end()) for x in re.finditer(r"\S+", m[0])]
        first = [0]
        for a, b in lines:
            first.append(first[-1] + b - a)
        at = lambda i: m.start() + lines[k := bisect_right(first, i) - 1][0] + i - first[k]  # noqa: B023, E731
        for windows, a, b in _decoded("".join(m[0].split())):
            blob = Blob(*_span(place, at(a), at(b - 1) + 1))
            yield from ((w, blob) for w in windows)
    last = [_unescaped(text, place)]
    text = place = None  # the layer below is all that is still needed
    if last[0] is not None:
        yield last.pop()


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and all spans, each by start and then kind."""
    if not text:
        return [], []

    def key(text: str, place: Place) -> bytes:
        return hashlib.blake2b(text.encode("utf-8", "surrogatepass") + repr(_span(place, 0, len(text))).encode(), digest_size=16).digest()

    base = base_spans(text)
    found, seen, work = set(base), {key(text, None)}, [_layers(text, None)]
    while work:
        layer, place = next(work[-1], (None, None))
        if layer is None:
            work.pop()
            continue
        if not layer or (digest := key(layer, place)) in seen:
            continue
        seen.add(digest)
        for s, kind, e in base_spans(layer):
            a, b = _span(place, s, e)
            found.add((a, kind, b))
        work.append(_layers(layer, place))
    return base, sorted(found)


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None) -> str | None:
    """The text with every span, or run of overlapping spans, replaced by a mark of its first kind."""
    spans = find_spans(text)[1]
    if not spans:
        return text
    out, done, end, kind = [], 0, -1, 0
    start = 0
    for s, k, e in spans:
        if s >= end:
            if end >= 0:
                out += (text[done:start], f"[{KINDS[kind]} removed]")
                done = end
            start, kind, end = s, k, e
        end = max(end, e)
    return "".join([*out, text[done:start], f"[{KINDS[kind]} removed]", text[end:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in column_slices(batches):
        cols: list[list] = [[], [], [], [], []]
        for text in part["text"]:
            base, every = find_spans(text)
            kinds = [k for _, k, _ in base]
            for c, x in zip(cols, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(render(base).encode()).hexdigest(), render(every)), strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part["doc_id"], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row for each row.

    The counts and the digest are of the base spans of the text itself; `spans` has these and those inside encodings. A
    null or empty text has none. A text of any length is scanned whole, and all that its layers unpack to. Null doc_id and
    repeated rows stay as they are; other columns are ignored; an empty table gives no rows.
    """
    require(docs, "doc_id", "text")
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns with secrets in `text` replaced, and n_chars, if there, made to fit.

    A null or empty text stays. Texts of any length are taken whole; repeated rows and rows without other values stay as
    they are; an empty table gives no rows. What overlaps becomes one mark, of the kind that begins first.
    """
    require(docs, "text")
    at = small_batches(docs).columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array(map(redact, batch.column(at).to_pylist()), batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
