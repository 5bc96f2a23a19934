"""Secret scans: a worklist unwraps URL, Unicode, base64 and compressed layers until nothing new appears, scans
each layer, and maps what it finds back to the text."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

# The kinds of the contract, in its order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
ONE_CODE = re.compile(rb"%([0-9A-Fa-f]{2})|" + ESCAPE.pattern.encode())
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
LINE_END = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]*={0,2})")
MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
#: Readable stretches of decoded bytes; a shorter one holds no secret and no layer with one.
READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
LEVELS = 8  # of URL and Unicode escapes are unwrapped one at a time; what is nested deeper, in one pass
WINDOW, OVERLAP = 4 << 20, 256 << 10  # inflated data beyond a window is scanned window by window

Span = tuple[str, int, int]


class Layer:
    """A text and, for each of its code points, where it begins and ends in the document."""

    def __init__(self, text: str, begin: np.ndarray, end: np.ndarray):
        self.text, self.begin, self.end = text, begin, end

    def mark(self) -> bytes:
        """A hash of the text and its places."""
        h = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for places in (self.begin, self.end):
            h.update(np.ascontiguousarray(places[:1] if places.strides == (0,) else places))
        return h.digest()


def scan(text: str) -> list[Span]:
    """The base spans of a text: leftmost, non-overlapping within each kind."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _replaced(layer: Layer, found: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer:
    """The layer with stretches replaced: (start, end, new text, the part of the stretch each new code point has)."""
    parts, begins, ends, at = [], [], [], 0
    for a, b, new, where in found:
        parts += [layer.text[at:a], new]
        begins += [layer.begin[at:a], np.array([layer.begin[a + i] for i, _ in where], dtype=np.int64)]
        ends += [layer.end[at:a], np.array([layer.end[a + j - 1] for _, j in where], dtype=np.int64)]
        at = b
    return Layer("".join([*parts, layer.text[at:]]), np.concatenate([*begins, layer.begin[at:]]), np.concatenate([*ends, layer.end[at:]]))


def _percent(layer: Layer) -> list[Layer]:
    found = []
    for m in PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        new, where, at = raw.decode("utf-8", "replace"), [], 0
        if "\ufffd" in new:
            new = raw.decode("latin-1")
        for c in new:
            size = 1 if len(new) == len(raw) else len(c.encode())
            where.append((at, at + 3 * size))
            at += 3 * size
        found.append((m.start(), m.end(), new, where))
    return [_replaced(layer, found)] if found else []


def _escapes(layer: Layer) -> list[Layer]:
    found = []
    for m in ESCAPE.finditer(layer.text):
        code = int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            found.append((m.start(), m.end(), chr(code), [(0, m.end() - m.start())]))
    return [_replaced(layer, found)] if found else []


def _all_codes(layer: Layer) -> Layer:
    """The layer with URL and Unicode escapes decoded until none is left, also those that decoding makes, in one pass.

    What is decoded takes the place of the last bytes of its code, and the search goes on a little before it, so a
    nest costs time in proportion to its length. The result has a code point for each byte of UTF-8.
    """
    raw = layer.text.encode("utf-8", "surrogatepass")
    sizes = 1 if len(raw) == len(layer.text) else np.array([len(c.encode("utf-8", "surrogatepass")) for c in layer.text])
    buf, begin, end = bytearray(raw), np.repeat(layer.begin, sizes), np.repeat(layer.end, sizes)
    longest = 10  # characters of a code
    w = r = 0  # buf[:w] is done, buf[r:] is to be searched
    at = 0  # where to search
    while m := ONE_CODE.search(buf, max(r, at)):
        a, b = m.span()
        code = next(int(g, 10 if i == 6 else 16) for i, g in enumerate(m.groups()) if g is not None)
        if m[1] is None and (code >= 0x110000 or 0xD800 <= code < 0xE000):
            at = a + 1
            continue
        new = bytes([code]) if m[1] is not None else chr(code).encode()
        first, last = begin[a], end[b - 1]
        buf[w : w + a - r], begin[w : w + a - r], end[w : w + a - r] = buf[r:a], begin[r:a], end[r:a]
        w += a - r
        back = min(w, longest)
        r = b - len(new) - back
        buf[r : r + back], begin[r : r + back], end[r : r + back] = buf[w - back : w], begin[w - back : w], end[w - back : w]
        w -= back
        buf[b - len(new) : b] = new
        begin[b - len(new) : b], end[b - len(new) : b] = first, last
        at = r
    keep = np.concatenate([np.arange(w), np.arange(r, len(buf))])
    return Layer((buf[:w] + buf[r:]).decode("latin-1"), begin[keep], end[keep])


def _inflated(chunks: Iterator[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """What zlib or gzip data hold, in pieces of `size` bytes at most; gzip members follow one another. Damaged or cut
    data give what can be read."""
    d = zlib.decompressobj(47)
    for chunk in chunks:
        while chunk:
            try:
                out = d.decompress(chunk, size)
            except zlib.error:
                return
            if out:
                yield out
            chunk = d.unconsumed_tail
            if d.eof:
                chunk = d.unused_data
                if chunk[:2] not in MAGIC:
                    return
                d = zlib.decompressobj(47)


def _opened(raw: bytes) -> Iterator[bytes]:
    """Bytes freed from all compressed layers around them, in windows that overlap; no windows if nothing comes out.

    A level that fits a window is opened whole, however many there are, until one was seen before (data may inflate
    to themselves). A larger one is read as a stream of pieces, and so is what it holds.
    """
    seen: set[bytes] = set()
    while raw[:2] in MAGIC:
        mark = hashlib.blake2b(raw, digest_size=16).digest()
        if mark in seen:
            return
        seen.add(mark)
        stream = _inflated(iter([raw]))
        held = b""
        for piece in stream:
            held += piece
            if len(held) > WINDOW:
                yield from _windows(_streamed(held, stream))
                return
        if not held:
            return
        raw = held
    yield raw


def _streamed(held: bytes, stream: Iterator[bytes]) -> Iterator[bytes]:
    """The pieces of a stream whose beginning is held already, inflated again while they begin as compressed data do."""
    def whole(held=held, stream=stream):
        yield held
        yield from stream

    pieces, marks = whole(), set()
    while held[:2] in MAGIC:
        pieces = _inflated(pieces)
        held = next(pieces, b"")
        mark = hashlib.blake2b(held, digest_size=16).digest()
        if mark in marks:
            return
        marks.add(mark)

        def whole(held=held, stream=pieces):
            yield held
            yield from stream

        pieces = whole()
    yield from pieces


def _windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    held = b""
    for piece in pieces:
        held += piece
        while len(held) >= WINDOW:
            yield held[:WINDOW]
            held = held[WINDOW - OVERLAP :]
    yield held


def _stretches(text: str) -> Iterator[tuple[str, np.ndarray | int]]:
    """(characters, where they stand): base64 stretches of a text, and those that go over lines of equal length.

    The place is the first one of a stretch without line breaks, else the places of all characters.
    """
    body, places, width, reach = "", [], 0, -1

    def lines():
        return (body, np.concatenate(places)) if len(places) > 1 else None

    for m in BASE64.finditer(text):
        yield m[0], m.start()
        if m.start() < reach:
            continue  # a line of a stretch that is taken already
        body, places, width, reach = m[0], [np.arange(*m.span())], m.end() - m.start(), m.end()
        while not body.endswith("=") and (more := LINE_END.match(text, reach)) and 0 < len(more[1].rstrip("=")) <= width:
            body += more[1]
            places.append(np.arange(*more.span(1)))
            reach = more.end()
            if len(more[1]) < width:
                break
        if found := lines():
            yield found


def _base64(layer: Layer) -> Iterator[Layer]:
    """A layer for each readable part of what base64 stretches hold, or compressed data in them."""
    for chars, at in _stretches(layer.text):
        body = chars.rstrip("=").replace("-", "+").replace("_", "/")
        body = body[: len(body) - (len(body) % 4 == 1)]
        try:
            raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        if raw[:2] in MAGIC:  # each code point comes from the whole stretch
            n = len(chars) - 1
            a, b = int(layer.begin[at if isinstance(at, int) else at[0]]), int(layer.end[at + n if isinstance(at, int) else at[n]])
            for window in _opened(raw):
                for m in READABLE.finditer(window):
                    yield Layer(m[0].decode("ascii"), np.broadcast_to(np.int64(a), len(m[0])), np.broadcast_to(np.int64(b), len(m[0])))
            continue
        for m in READABLE.finditer(raw):
            first = np.arange(*m.span(), dtype=np.int64)
            x, y = first * 4 // 3, np.minimum(((first + 1) * 4 + 2) // 3 - 1, len(body) - 1)
            x, y = (x + at, y + at) if isinstance(at, int) else (at[x], at[y])
            yield Layer(m[0].decode("ascii"), layer.begin[x], layer.end[y])


def all_spans(text: str, base: list[Span] | None = None) -> set[Span]:
    """Base spans and those of every layer below, in code points of the text.

    A worklist holds layers still to be unwrapped. URL and Unicode escapes make a new layer of the whole text, since a
    secret may stand half in them; base64 and compressed stretches make layers of their own, one for each readable
    part. A layer that was seen before, with the same places in the document, isn't entered again, so cycles end;
    of what was seen only hashes are kept. Of compressed data a window is held at a time, so their size has no bound;
    an encoded stretch that stands across the edge of a window and is longer than the overlap is read up to the edge.
    """
    spans = set(scan(text) if base is None else base)
    at = np.arange(len(text) + 1, dtype=np.int64)
    work = [(Layer(text, at[:-1], at[1:]), 0)]
    seen = {work[0][0].mark()}
    while work:
        layer, level = work.pop()
        if "%" in layer.text or "\\" in layer.text or "&#" in layer.text:
            if level < LEVELS:
                below = [(x, level + 1) for x in _percent(layer) + _escapes(layer)]
            else:
                below = [(_all_codes(layer), 0)]
        else:
            below = []
        for x, n in chain(below, ((x, 0) for x in _base64(layer))):
            if x.text and (key := x.mark()) not in seen:
                seen.add(key)
                spans.update((k, int(x.begin[a]), int(x.end[b - 1])) for k, a, b in scan(x.text))
                work.append((x, n))
    return spans


def joined(spans) -> str:
    """kind:start:end by start, then kind in the order of KINDS, then end."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): a row for each row of docs.

    The counts and `base` are of the spans found in the text itself; `spans` has those of decoded layers too, mapped
    to the stretch of the text they came from. Null and empty texts have no spans: zeros and empty strings. Very long
    texts are scanned whole. Repeated rows give repeated results; an empty table gives none. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = kept.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            base, every = [], []
            for value in batch.column("text"):
                text = value.as_py()
                own = scan(text)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in own))
                base.append(joined(own))
                every.append(joined(all_spans(text, own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(base, pa.string()), pa.array(every, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return kept.mapInArrow(run, schema)
