"""Secret scans with a recursive decoding worklist.

A text's base spans come from three patterns. Then a worklist unwraps nested encodings: percent
escapes and Unicode escapes are undone character by character, base64 runs and the compressed data
in them as whole blobs. Each layer is scanned like the text and goes back on the list until nothing
new appears; a layer whose content was seen in the same document is not unwrapped again, which
ends all cycles. Each layer carries, for every character, the span of the text it came from, so
that findings in any depth map to code point spans of the text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import lean

#: The kinds in the order in which they sort, each with its pattern, the group that is measured and its least length.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
UNICODE_ONE = re.compile(r"\\[uUx]([0-9A-Fa-f]+)")
#: A run of either base64 alphabet that is long enough to hold a secret.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Characters of the alphabets that also join words and paths, and how base64 of compressed data begins behind one.
JOINER, PACKED = re.compile(r"[+/_-]"), re.compile(r"(?<=[+/_-])(?:H4sI|e[JANF]|Qlpo|[/_]Td6)")
#: Runs on lines that follow each other, blanks around the breaks allowed, and the run of one line.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)+={0,2}")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
#: Characters that a run over several lines needs.
LEAST = 16
#: Bytes that decompressors take and give at a time.
FEED, PIECE = 1 << 16, 1 << 20
#: Bytes up to which a decompressed layer is scanned as one text; longer ones go piece by piece.
LAYER_BYTES = 32 << 20
#: Where a long layer may be cut: after a character or a single space that no pattern and no encoding can contain there.
CUT = re.compile(r"(?<=[^\s:=])\x20(?=[^\s:=])|[^A-Za-z0-9+/_=%\\.:\"'\s-]")


@dataclass(frozen=True)
class Layer:
    """A decoded text; start[i] and end[i] are the span of the document that character i came from."""

    text: str
    start: np.ndarray
    end: np.ndarray


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns: leftmost, non-overlapping per kind, too short ones dropped."""
    found = []
    for kind in KINDS:
        pattern, group, least = PATTERNS[kind]
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


def _texts(raw: bytes) -> Iterator[str]:
    """Bytes as text: UTF-8, or else a character for each byte; also both kinds of UTF-16 if there are null bytes."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    if text:
        yield text
    if b"\0" in raw:
        yield raw.decode("utf-16-le", "replace")
        yield raw.decode("utf-16-be", "replace")


def _clean(raw: bytes) -> bool:
    """Whether bytes are UTF-8 without other control characters than white space."""
    try:
        return not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", raw.decode("utf-8"))
    except UnicodeDecodeError:
        return False


def _decompressor(head: bytes):
    """A decompressor for data of the usual formats, by their first bytes."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces of the decompressed data of a stream, member after member; damaged data ends it."""
    data = b""
    while True:
        while len(data) < 6 and (more := next(chunks, b"")):
            data = (data + more).lstrip(b"\0")  # members may be padded
        if (d := _decompressor(data)) is None:
            return
        while not d.eof:
            try:
                out = d.decompress(data, PIECE)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return
            data = getattr(d, "unconsumed_tail", b"")
            if out:
                yield out
            elif not data and not d.eof and not (data := next(chunks, b"")):
                return
        data = d.unused_data.lstrip(b"\0")


def _fed(raw: bytes) -> Iterator[bytes]:
    return (raw[at : at + FEED] for at in range(0, len(raw), FEED))


def _innermost(raw: bytes) -> tuple[bytes | None, Callable[[], Iterator[bytes]]]:
    """What is left of compressed data when nothing inflates any more: the bytes if they are few, and a way to read them from the start.

    Data that comes again, as of files that inflate to themselves, ends the loop.
    """
    whole, read, seen = raw, lambda: _fed(raw), {hashlib.sha256(raw).digest()}
    while True:
        digest, n, held = hashlib.sha256(), 0, []
        for piece in _inflated(read()):
            digest.update(piece)
            n += len(piece)
            held.append(piece)
            if n > LAYER_BYTES:
                held.clear()
        if not n or digest.digest() in seen:
            return whole, read
        seen.add(digest.digest())
        if n <= LAYER_BYTES:
            whole = b"".join(held)
            read = lambda whole=whole: _fed(whole)
        else:
            whole, read = None, lambda read=read: _inflated(read())


def _long_texts(read: Callable[[], Iterator[bytes]]) -> Iterator[str]:
    """A long layer as texts of about LAYER_BYTES, cut where no secret and no encoded run can lie across; without such a place they get longer."""
    wide = any(b"\0" in chunk for chunk in read())
    for kind in ("utf-8", "utf-16-le", "utf-16-be") if wide else ("utf-8",):
        decoder, held = codecs.getincrementaldecoder(kind)("replace"), ""
        for chunk in read():
            new = decoder.decode(chunk)
            held += new
            if len(held) >= LAYER_BYTES:
                cut = 0
                for m in CUT.finditer(held, max(0, len(held) - len(new) - 2)):
                    cut = m.end()
                if cut:
                    yield held[:cut]
                    held = held[cut:]
        if held := held + decoder.decode(b"", True):
            yield held


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every run of the pattern decoded; decode gives (text, first, last) pieces, offsets within the run."""
    text, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        pieces = decode(m.group())
        if pieces is None:
            continue
        text.append(layer.text[at : m.start()])
        starts.append(layer.start[at : m.start()])
        ends.append(layer.end[at : m.start()])
        for piece, first, last in pieces:
            text.append(piece)
            starts.append(np.full(len(piece), layer.start[m.start() + first]))
            ends.append(np.full(len(piece), layer.end[m.start() + last - 1]))
        at = m.end()
    if not at:
        return None
    text.append(layer.text[at:])
    starts.append(layer.start[at:])
    ends.append(layer.end[at:])
    return Layer("".join(text), np.concatenate(starts), np.concatenate(ends))


def _percent(run: str):
    raw = bytes.fromhex(run.replace("%", ""))
    out, at = [], 0
    for ch in raw.decode("utf-8", "surrogateescape"):
        bad = "\udc80" <= ch <= "\udcff"
        width = 3 * (1 if bad else len(ch.encode()))
        out.append(("\ufffd" if bad else ch, at, at + width))
        at += width
    return out


def _unicode(run: str):
    parts = [(int(m.group(1), 16), m.start(), m.end()) for m in UNICODE_ONE.finditer(run)]
    out, i = [], 0
    while i < len(parts):
        code, first, last = parts[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(parts) and 0xDC00 <= parts[i + 1][0] < 0xE000:
            code, last, i = 0x10000 + ((code - 0xD800) << 10) + parts[i + 1][0] - 0xDC00, parts[i + 1][2], i + 1
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            code = 0xFFFD
        out.append((chr(code), first, last))
        i += 1
    return out


def _lines(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, run) of what base64 over several lines may be, its breaks left out.

    That is all lines that follow each other, and, as words may stand on the lines before and after,
    lines of one width with a shorter last one, without it if it does not fill the last four
    characters, and with a shorter first one.
    """
    for m in WRAPPED.finditer(text) if "\n" in text else ():
        if m.end() - m.start() < LEAST:
            continue
        at = [(x.start(), x.end()) for x in RUN.finditer(text, m.start(), m.end())]
        widths, n = [b - a for a, b in at], len(at)
        picked, i = {(0, n): None}, 0
        while i < n:
            j = i + 1
            while j < n and widths[j] == widths[i]:
                j += 1
            short = j < n and widths[j] < widths[i]
            picked[i, j + short] = None
            if i == 1:
                picked[0, j + short] = None
            if short and (sum(widths[i : j + 1]) + (m.end() - at[-1][1] if j == n - 1 else 0)) % 4:
                picked[i, j] = None
            i = j
        for i, j in picked:
            if j - i > 1 and sum(widths[i:j]) >= LEAST:
                yield at[i][0], m.end() if j == n else at[j - 1][1], "".join(text[a:b] for a, b in at[i:j])


def _decoded(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    run = run[: len(run) - (len(run) % 4 == 1)]  # a single character holds no byte
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _begun(run: str) -> Iterator[int]:
    """Where in a run base64 may begin: at its start; if a path or a word is joined before it, at each
    alignment that a joiner gives, as what is cut off by that is a byte or two; and where compressed data begins.
    """
    yield 0
    if (raw := _decoded(run)) is not None and (_clean(raw) or _decompressor(raw) is not None):
        return  # nothing is joined before it
    joined = {m.end() % 4 for m in JOINER.finditer(run)} - {0}
    yield from sorted(a for a in joined if len(run) - a >= LEAST)
    for m in PACKED.finditer(run):
        if m.start() > 3 and _decompressor(_decoded(run[m.start() : m.start() + 64]) or b"") is not None:
            yield m.start()


def _blobs(layer: Layer) -> Iterator[Layer]:
    """What base64 runs hold, each as a layer whose characters all come from the whole run, or the part that is decoded."""
    runs = ((m.start() + at, m.end(), m.group()[at:]) for m in BASE64.finditer(layer.text) for at in _begun(m.group()))
    for start, end, run in chain(runs, _lines(layer.text)):
        if (raw := _decoded(run)) is None:
            continue
        whole, read = _innermost(raw)
        if whole is raw and start and ESCAPED.match(layer.text, start - 1) and not _clean(raw):
            continue  # its first two digits are an escape's; the run without them comes once that is undone
        for text in _long_texts(read) if whole is None else _texts(whole):
            n = len(text)
            yield Layer(text, np.broadcast_to(layer.start[start], n), np.broadcast_to(layer.end[end - 1], n))


def unwrapped(layer: Layer) -> Iterator[Layer]:
    for pattern, mark, decode in ((PERCENT, "%", _percent), (UNICODE, "\\", _unicode)):
        if mark in layer.text and (new := _replaced(layer, pattern, decode)) is not None:
            yield new
    yield from _blobs(layer)


def find_secrets(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, sorted by start, kind and end; a null text has none."""
    text = text or ""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(scan(text), key=order)
    if not ("%" in text or "\\" in text or BASE64.search(text) or next(_lines(text), None)):
        return base, base
    places = np.arange(len(text), dtype=np.int64)
    work, seen, spans = [Layer(text, places, places + 1)], {hashlib.sha256(text.encode("utf-8", "replace")).digest()}, set(base)
    while work:
        for new in unwrapped(work.pop()):
            digest = hashlib.sha256(new.text.encode("utf-8", "replace")).digest()
            spans.update((kind, int(new.start[a:b].min()), int(new.end[a:b].max())) for kind, a, b in scan(new.text))
            if digest not in seen:
                seen.add(digest)
                work.append(new)
    return base, sorted(spans, key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each maximal union of overlapping spans replaced by a mark naming its first kind."""
    if not spans:
        return text
    out, at, last, mark = [], 0, -1, ""
    for kind, a, b in spans:
        if a < last:
            last = max(last, b)
            continue
        if last >= 0:
            out.append(mark)
            at = last
        out.append(text[at:a])
        mark, last = f"[{kind}]", b
    return "".join([*out, mark, text[last:]])


def _scanned(batches: Iterator[pa.RecordBatch], text: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            texts = batch.column(text).to_pylist()
            found = [find_secrets(t) for t in texts]
            out = {c: batch.column(c) for c in keep}
            for kind in KINDS:
                out[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64())
            out["base_sha256"] = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found])
            out["spans"] = pa.array([joined(spans) for _, spans in found])
            out["redacted"] = pa.array([redacted(t, spans) for t, (_, spans) in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(out)


def scan_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without `text`, plus n_assign, n_access, n_hex and base_sha256 of the base spans, all spans, and the redacted text.

    A null text counts as empty and stays null when redacted. Whole texts are scanned whatever their
    length, layer by layer; decompressed layers of more than LAYER_BYTES bytes go piece by piece. Repeated rows
    are scanned each; an empty table gives an empty result. Columns of docs that have the name of a new
    column are replaced.
    """
    new = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"]
    keep = [c for c in docs.columns if c not in new and c != text]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    fields += [f"{c} {'long' if c[:2] == 'n_' else 'string'}" for c in new]
    return docs.select(*[F.col(f"`{c}`") for c in [*keep, text]]).mapInArrow(lean(lambda it: _scanned(it, text, keep)), ", ".join(fields))
