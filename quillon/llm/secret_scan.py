"""Secret scans with a recursive decoding worklist."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: The kinds of secrets in order, their patterns, the group that is measured and its least length.
KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: The same matches as the hex pattern's long ones: a run of 32 or more is always a whole run.
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
URL, PERCENT = re.compile(r"[A-Za-z0-9._~+=:;,@&/?#\[\]!$'()*%-]+"), re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
WORD, RUN = re.compile(r"\S+"), re.compile(r"[A-Za-z0-9+/_-]+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Whether a text can hold any layer at all; most hold none.
MAY_HOLD = re.compile(r"%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f{]|&#[0-9x]|[A-Za-z0-9+/_-]{16,}")
#: A line break, also an escaped one, within base64; and base64 over several lines.
BREAK = re.compile(r"[ \t]*(?:\r?\n|\r|(?:\\r)?\\n)[ \t]*")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{4,}}+(?:{BREAK.pattern}[A-Za-z0-9+/_-]{{4,}}+)*+{BREAK.pattern}[A-Za-z0-9+/_-]+={{0,2}}|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{4,}}+(?:{BREAK.pattern}[A-Za-z0-9+/_-]{{4,}}+)++={{0,2}}")
LINE = re.compile(rb"[ \t]*[A-Za-z0-9+/_-]{4,}\s*")
#: Decompressed streams are scanned in pieces of about so many bytes, which have so many in common.
PIECE, OVERLAP = 8 << 20, 64 << 10


def found(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of all matches in one layer."""
    out = [(m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(KINDS[:2]) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out + [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]


class Layer:
    """A decoded text with the range of the whole text that each of its characters comes from."""

    __slots__ = ("depth", "ends", "starts", "stop", "text")

    def __init__(self, text: str, starts: np.ndarray | Whole | None, ends: np.ndarray | Whole | None, depth: int, stop: int):
        self.text, self.starts, self.ends, self.depth, self.stop = text, starts, ends, depth, stop  # what begins at stop or later is in the next piece too


def holding(runs: re.Pattern, sign: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """The runs that hold a sign: each is searched once, so long ones cost no more than their length."""
    if sign.search(text):
        for m in runs.finditer(text):
            if sign.search(text, *m.span()):
                yield m.span()


def decoded(own: str, signs: Iterator[tuple[int, int, list[tuple[str, int, int]]]]) -> tuple[str, np.ndarray, np.ndarray]:
    """own with its signs (start, end, decoded characters with their ranges) replaced, and the range of each character."""
    text, starts, ends, at = [], [], [], 0
    for a, b, made in signs:
        text.append(own[at:a])
        starts.append(np.arange(at, a))
        ends.append(np.arange(at + 1, a + 1))
        text += [x for x, _, _ in made]
        starts.append(np.array([x for _, x, _ in made]))
        ends.append(np.array([x for _, _, x in made]))
        at = b
    text.append(own[at:])
    starts.append(np.arange(at, len(own)))
    ends.append(np.arange(at + 1, len(own) + 1))
    return "".join(text), np.concatenate(starts), np.concatenate(ends)


def percent_signs(own: str) -> Iterator[tuple]:
    for m in PERCENT.finditer(own):
        raw, made, i = unquote_to_bytes(m[0]), [], 0
        while i < len(raw):  # one UTF-8 character, or one byte that isn't part of one
            size = next((n for n in (1, 2, 3, 4) if _utf8(raw[i : i + n], n)), 0)
            made.append((raw[i : i + size].decode() if size else chr(raw[i]), m.start() + 3 * i, m.start() + 3 * (i + max(1, size))))
            i += max(1, size)
        yield m.start(), m.end(), made


def _utf8(raw: bytes, n: int) -> bool:
    try:
        return len(raw) == n and len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def escape_signs(own: str) -> Iterator[tuple]:
    for m in ESCAPES.finditer(own):
        code = int(m[m.lastindex], 10 if m.lastindex == 5 else 16)
        x = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        yield m.start(), m.end(), [(x, m.start(), m.end())]


#: Where a compressed stream may begin, apart from zlib's two bytes, which are tried at the beginning and after / - _ only.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00")


def is_zlib(raw: bytes, at: int) -> bool:
    return len(raw) > at + 2 and raw[at] & 15 == 8 and raw[at] >> 4 <= 7 and (raw[at] << 8 | raw[at + 1]) % 31 == 0


def inflate(raw: bytes, at: int = 0, ends: list[int] | None = None) -> Iterator[bytes]:
    """The content of the gzip, zlib, bzip2 or xz stream at this place, all members of it, in parts; where it is broken,
    what comes before. Bytes are fed one by one, as an error loses what the same call had decompressed. ends: takes the
    end of each whole member."""
    while at < len(raw):
        if raw.startswith(b"\x1f\x8b", at) or is_zlib(raw, at):
            d = zlib.decompressobj(47)
        elif raw.startswith(b"BZh", at):
            d = bz2.BZ2Decompressor()
        elif raw.startswith(b"\xfd7zXZ\x00", at):
            d = lzma.LZMADecompressor()
        else:
            return
        try:
            while at < len(raw) and not d.eof:
                yield d.decompress(raw[at : at + 1], PIECE)
                at += 1
                while not d.eof and not getattr(d, "needs_input", True):
                    yield d.decompress(b"", PIECE)
        except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError):
            return
        if d.eof and ends is not None:
            ends.append(at)
        while raw.startswith(b"\0", at):  # padding between members
            at += 1


def cut(text: bytes) -> int:
    """From where on a piece is repeated in the next one: OVERLAP bytes, more where this would part a run or wrapped base64."""
    at = len(text) - OVERLAP
    while at > 0 and not text[at - 1 : at].isspace():
        at = max(text.rfind(x, 0, at) for x in (b"\n", b" ", b"\t", b"\r")) + 1
    while at > 0 and LINE.fullmatch(text, line := text.rfind(b"\n", 0, at - 1) + 1, at):
        at = line
    return at


def unpacked(raw: bytes, at: int, ends: list[int]) -> Iterator[tuple[bytes, int]]:
    """Pieces of what is in a stream, each with the place from which on the next one repeats it."""
    held, size, least = [], 0, PIECE
    for x in inflate(raw, at, ends):
        held.append(x)
        size += len(x)
        if size >= least:
            text = b"".join(held)
            if at := cut(text):
                yield text, at
                text = text[at:]
            held, size, least = [text], len(text), len(text) + PIECE
    if size:
        yield b"".join(held), size


def views(raw: bytes, end: int) -> Iterator[tuple[str, np.ndarray | range, int]]:
    """Bytes as text, the byte of each character, and the character that `end` is. Secrets are ASCII, so bytes as
    characters show them in UTF-8 and all encodings like it; units of two bytes, without zeros, those in UTF-16 and UTF-32."""
    yield raw.decode("latin-1"), range(len(raw)), end
    if raw.count(0) >= 8:  # the shortest secret has more
        for order in "<>":
            for at in (0, 1):
                units = np.frombuffer(raw, f"{order}u2", (len(raw) - at) // 2, at).astype(np.uint16)
                kept = np.flatnonzero(units)
                units = units[kept]
                units[(units >= 0xD800) & (units < 0xE000)] = 0xFFFD
                kept = at + 2 * kept + (order == ">")
                yield units.astype("<u2").tobytes().decode("utf-16-le"), kept, int(np.searchsorted(kept, end))


class Whole:
    """A map that gives all characters the same place."""

    def __init__(self, place: int):
        self.place = place

    def __getitem__(self, _: int) -> int:
        return self.place

    def within(self, places) -> Whole:
        return Whole(places[self.place])


def packed_layers(raw: bytes, size: int, starts: tuple[int, ...] = (0,)) -> Iterator[tuple]:
    """What the compressed streams in raw hold, in pieces; zlib's are tried at `starts`. size: of the encoded part."""
    ends = [0]
    for at in sorted({*(m.start() for m in MAGIC.finditer(raw)), *(x for x in starts if is_zlib(raw, x))}):
        first = None
        if at < ends[-1]:  # in a stream that was whole
            continue
        for piece, end in unpacked(raw, at, ends):
            seen: set[str] = set()
            for text, _, stop in views(piece, end):
                own = {text[a:b] for a, _, b in found(text)}
                if not seen or own - seen:  # once for what both views show
                    yield text, Whole(0), Whole(size - 1), stop
                seen |= own
            if piece != raw:  # a stream of itself ends
                yield from packed_layers(piece, size)
            if first is None:
                first = piece
            elif first and (MAGIC.match(first) or is_zlib(first, 0)):  # a stream over several pieces
                yield from packed_layers(b"".join(inflate(raw, at)), size)
                first = b""


def base64_layers(own: str) -> Iterator[tuple]:
    """base64 in either alphabet, padded or not, wrapped or not, from each of the four alignments, as it may be glued to
    what comes before; and compressed streams in it."""
    runs = [m.span() for m in RUN.finditer(BREAK.sub(lambda m: " " * len(m[0]), own))]
    body = "".join([own[a:b] for a, b in runs])
    plain = body.replace("-", "+").replace("_", "/")
    if len(body) < 16:
        return
    place = np.concatenate([np.arange(a, b) for a, b in runs])
    glued = [m.end() for m in re.finditer("[/_-]", body)] + list(accumulate(b - a for a, b in runs[:-1]))
    for k in range(4):
        part = plain[k:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        for text, at, _ in views(raw, len(raw)):
            if text:
                at = np.asarray(at)
                first = k + at // 3 * 4 + at % 3
                yield text, place[first], place[first + 1], len(text)
        yield from packed_layers(raw, len(own), (0, *((x - k) // 4 * 3 for x in glued if x > k and (x - k) % 4 == 0)))


def url_layers(own: str) -> Iterator[tuple]:
    text, starts, ends = decoded(own, percent_signs(own))
    yield text, starts, ends - 1, len(text)
    yield from packed_layers(unquote_to_bytes(own), len(own))


def escape_layers(own: str) -> Iterator[tuple]:
    text, starts, ends = decoded(own, escape_signs(own))
    yield text, starts, ends - 1, len(text)
    yield from packed_layers(text.encode("latin-1", "replace"), len(own))


def layers(text: str) -> Iterator[Layer]:
    """All decoded layers of a text, worked off until none unwraps any further. A layer whose text was already seen at
    the same place isn't unwrapped again, so cycles end."""
    seen: set[tuple[int, int, bytes]] = set()
    work = [Layer(text, None, None, 0, len(text))]
    while work:
        layer = work.pop()
        own = layer.text
        if not (MAY_HOLD.search(own) or WRAPPED.search(own)):
            continue
        parts = [(*x, url_layers) for x in holding(URL, PERCENT, own)]
        # neighbouring escapes, with the characters of a word around them, are one part
        parts += [(*x, escape_layers) for x in holding(WORD, ESCAPES, own)]
        wrapped = [(m.start(), m.end(), base64_layers) for m in WRAPPED.finditer(own)]
        begins = [x[0] for x in wrapped]
        alone = ((m.start(), m.end(), base64_layers) for m in BASE64.finditer(own))
        parts += wrapped + [x for x in alone if not (i := bisect_right(begins, x[0])) or wrapped[i - 1][1] < x[1]]
        for a, b, decode in parts:
            if a >= layer.stop:
                continue
            for new, starts, lasts, stop in decode(own[a:b]):
                if not new or new == own[a:b]:
                    continue
                if isinstance(starts, Whole):
                    starts, lasts = Whole(a + starts.place), Whole(a + lasts.place)
                    if layer.depth:
                        starts, ends = starts.within(layer.starts), lasts.within(layer.ends)
                    else:
                        ends = Whole(lasts.place + 1)
                elif layer.depth:
                    if isinstance(layer.starts, Whole):
                        starts, ends = layer.starts, layer.ends
                    else:
                        starts, ends = layer.starts[starts + a], layer.ends[lasts + a]
                else:
                    starts, ends = (starts + a).astype(np.int32), (lasts + (a + 1)).astype(np.int32)
                key = (int(starts[0]), int(ends[-1]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).digest())
                if key in seen:
                    continue
                seen.add(key)
                work.append(made := Layer(new, starts, ends, layer.depth + 1, stop))
                yield made


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[tuple[int, int, int, int, str]]]:
    """Base spans, all spans (start, kind's place, end) in the whole text, and what decoded layers held: (start, kind's place, end, depth, match)."""
    text = text or ""
    base = sorted(found(text))
    inner, placed = [], set()
    if MAY_HOLD.search(text) or WRAPPED.search(text):
        for layer in layers(text):
            own = [(int(layer.starts[a]), k, int(layer.ends[b - 1]), layer.depth, layer.text[a:b]) for a, k, b in found(layer.text) if a < layer.stop]
            # views of the same bytes show the same match at the same place; a compressed layer has one place for all
            inner += own if isinstance(layer.starts, Whole) else [x for x in own if x not in placed]
            placed.update(own)
    inner.sort()
    return base, sorted({*base, *((a, k, b) for a, k, b, _, _ in inner)}), inner


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, decoded array<struct<kind:string,start:int,end:int,depth:int,match:string>>"
DECODED = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32()), ("match", pa.string())]))


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, bases, alls, inners = ([], [], []), [], [], []
        for text in b["text"].to_pylist():
            base, spans, inner = scan(text)
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in base))
            bases.append(joined(base))
            alls.append(joined(spans))
            inners.append([{"kind": KINDS[k][0], "start": a, "end": e, "depth": d, "match": m} for a, k, e, d, m in inner])
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(bases, pa.string()), pa.array(alls, pa.string()), pa.array(inners, DECODED)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "decoded"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in each row's whole text: counts of base matches by kind, base_spans, spans (base ones and those of decoded
    layers, mapped to the whole text), and decoded: what the layers held, with depth and match.

    Each row is scanned in its own: no shuffle. Spans are code points, end exclusive. Null text is empty: no spans.
    Null doc_id is kept. Layers: percent encoding, Unicode escapes and character references, base64 (wrapped or glued
    to other characters, too), and gzip, zlib, bzip2 or xz streams inside any of these, nested in any order. Streams are
    read to their end or first error, in pieces. A span from a compressed layer covers the whole encoded part.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan_batches, SCHEMA)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", F.size("decoded").cast("long").alias("n_decoded"))
