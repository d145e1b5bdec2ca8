"""Secret scans by a recursive decoding worklist.

Every text is scanned as it is. Then layers are unwrapped: percent-encoded and
Unicode-escaped characters and letters set apart by NULs (UTF-16) turn the whole
layer into its decoded form, base64 tokens and the gzip, zlib, bzip2 or xz data in
them become layers of their own. Lines of base64 are one token together and one
each; what has ``+ / _ -`` or a line break in it may be a path or a prefix and a token
behind it, and is decoded at all four shifts. Each new layer is scanned again and may hold
further ones, until the worklist is empty. A layer equal to one that it came from is
a cycle and is dropped; a layer met at two places is scanned once and its findings
are placed at both. Findings are mapped back through all layers to the code points
of the original text that they came from; what lies in compressed data maps to the
whole of that data.

All rules are about ASCII characters, so layers are bytes, whatever their encoding:
no layer is refused for bytes that are no text. In the text itself a code point above
255 counts as one byte that no rule knows.

Kinds and their rules are fixed values, see ``KINDS``. Spans of the text itself
stay as they are; those of deeper layers are added, the same span of a kind once.

Defined results: a null text is an empty one. Texts are scanned whole, whatever
their length. Repeated rows give equal rows, an empty table an empty result. All
streams of compressed data that follow each other are one layer. Layers of more than
``LAYER`` bytes are unpacked to a nameless file in the temporary folder of the task
and scanned there like all others; ``skipped_layers`` keeps its name and counts them,
but none is skipped. A full disk ends the task with an error. ``layers`` counts those
that read as text or hold a secret or a further layer; what base64 makes of plain words
is none. Only the id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cropline.llm.common import column

# Kind, pattern, group whose length counts, least length. ASCII letters only.
KINDS = (
    (
        "assign",
        re.compile(
            rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.IGNORECASE,
        ),
        2,
        6,
    ),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(rb"[0-9a-f]{24,}"), 0, 24),
)
ORDER = {kind[0]: n for n, kind in enumerate(KINDS)}
# Bytes of a layer held in memory, of a step in unpacking, and of the first one.
LAYER, CHUNK, FIRST = 64 << 20, 1 << 20, 1 << 12
# Runs are matched without a way back, so that long ones take no memory.
_PERCENT = re.compile(rb"(?:%[0-9A-Fa-f]{2})++")
_ESCAPE = re.compile(rb"(?:\\u[0-9A-Fa-f]{4})++|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
# Letters and NULs in turn, of either byte order.
_WIDE = re.compile(rb"(?:[^\x00]\x00){6,}+|(?:\x00[^\x00]){6,}+")
_BASE64 = re.compile(rb"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{16,})={0,2}")
# What may part a token, and its shorter first and last lines.
_BREAK = re.compile(rb"\r?\n[\x20\t]*")
_BEFORE = re.compile(rb"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{1,15})\r?\n[\x20\t]*\Z")
_AFTER = re.compile(rb"\r?\n[\x20\t]*([A-Za-z0-9+/_-]{1,15})={0,2}(?![A-Za-z0-9+/_-])")
# How zlib data begins in base64.
_ZLIB = re.compile(rb"e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r])")
_ZLIB_PIECE = re.compile(rb"[+/_-]e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r])")
# What a layer must have to hold a secret or a further layer, tried on short ones first.
_LIVE = re.compile(
    rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx]|[A-Za-z0-9+/_-]{16}"
    rb"|[^\x00]\x00[^\x00]\x00|\x00[^\x00]\x00[^\x00]|\x1f\x8b\x08|BZh|\xfd7zXZ"
)
_SHORT = 4096
_STANDARD = bytes.maketrans(b"-_", b"+/")
_READABLE = bytes([9, 10, 13, *range(32, 127)])
_UNKNOWN = b"?"

Span = tuple[str, int, int]
# Where characters from start to end of a layer come from in its parent.
Place = Callable[[int, int], tuple[int, int]]
Data = bytes | mmap.mmap
Machine = Any  # what zlib.decompressobj, bz2 and lzma give


def _named(layer: Data) -> bool:
    """Whether a name of the kind ``assign`` may be in a layer: cheaper than its pattern."""
    for at in range(0, len(layer), CHUNK):
        low = layer[at : at + CHUNK + 8].lower()
        if any(name in low for name in (b"passw", b"secret", b"token", b"api")):
            return True
    return False


def scan(layer: Data) -> list[Span]:
    """Spans of a layer itself, by start and then kind."""
    found = []
    for kind, pattern, group, least in KINDS:
        if kind == "assign" and not _named(layer):
            continue
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(layer) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]], s[2]))


class _Sink:
    """Collects a layer: bytes up to ``LAYER``, beyond that a mapped file without a name."""

    def __init__(self) -> None:
        self.pieces: list[bytes] = []
        self.file, self.size = None, 0

    def write(self, piece: bytes) -> None:
        self.size += len(piece)
        if not self.file and self.size > LAYER:
            self.file = tempfile.TemporaryFile()
            self.file.writelines(self.pieces)
            self.pieces = []
        if self.file:
            self.file.write(piece)
        else:
            self.pieces.append(piece)

    def copy(self, layer: Data, start: int, end: int) -> None:
        for at in range(start, end, CHUNK):
            self.write(layer[at : min(at + CHUNK, end)])

    def done(self) -> Data:
        if not self.file:
            return b"".join(self.pieces)
        with self.file:
            self.file.flush()
            return mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)


def _replaced(layer: Data, pattern: re.Pattern, decode: Callable[[bytes], bytes]) -> tuple[Data, Place] | None:
    """The layer with all matches decoded, and where its characters come from."""
    sink = _Sink()
    # Decoded stretches: start and end in the result, start and end in the layer.
    a, b, c, d = array("Q"), array("Q"), array("Q"), array("Q")
    at = 0
    for match in pattern.finditer(layer):
        sink.copy(layer, at, match.start())
        begin = sink.size
        # A multiple of the length of each code that comes in runs.
        for start in range(match.start(), match.end(), CHUNK // 6 * 6):
            sink.write(decode(layer[start : min(start + CHUNK // 6 * 6, match.end())]))
        at = match.end()
        for ends, end in zip((a, b, c, d), (begin, sink.size, match.start(), at)):
            ends.append(end)
    if not a:
        return None
    sink.copy(layer, at, len(layer))

    def place(start: int, end: int) -> tuple[int, int]:
        # Stretches of two characters for one count by character, other decoded ones whole.
        n = bisect_right(b, start)
        if n < len(a) and a[n] <= start:
            begin = c[n] + 2 * (start - a[n]) if d[n] - c[n] == 2 * (b[n] - a[n]) else c[n]
        else:
            begin = start + (d[n - 1] - b[n - 1] if n else 0)
        n = bisect_left(b, end)
        if n < len(a) and a[n] < end:
            return begin, (c[n] + 2 * (end - a[n]) if d[n] - c[n] == 2 * (b[n] - a[n]) else d[n])
        n = bisect_right(b, end)
        return begin, end + (d[n - 1] - b[n - 1] if n else 0)

    return sink.done(), place


def _percent(token: bytes) -> bytes:
    return binascii.unhexlify(token.replace(b"%", b""))


def _escape(token: bytes) -> bytes:
    if token[1:2] == b"u" and token[2:3] != b"{":
        numbers = [int(x, 16) for x in token.split(b"\\u")[1:]]
    else:
        numbers = [int(token[3:-1] if token[2:3] == b"{" else token[2:], 16)]
    return b"".join(bytes([n]) if n < 256 else _UNKNOWN for n in numbers)


def _narrow(token: bytes) -> bytes:
    return token[token[0] == 0 :: 2]


def _machine(head: bytes) -> Machine | None:
    """What unpacks a stream of these first six bytes."""
    if head[:3] == b"\x1f\x8b\x08" or (len(head) > 2 and head[0] == 0x78 and not head[1] & 32 and (head[0] << 8 | head[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflated(machine: Machine, data: Data, at: int, sink: _Sink) -> int | None:
    """Writes the contents of a stream as far as it is whole; returns its end if it has one."""
    fed, step = at, FIRST
    while not machine.eof:
        piece = getattr(machine, "unconsumed_tail", b"")
        if not piece and getattr(machine, "needs_input", True):
            piece = data[fed : fed + step]
            fed, step = fed + len(piece), CHUNK
            if not piece:
                if hasattr(machine, "flush"):
                    sink.write(machine.flush())
                break
        try:
            plain = machine.decompress(piece, CHUNK)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return None
        sink.write(plain)
    return fed - len(machine.unused_data) if machine.eof else None


def _unpacked(data: Data, at: int) -> tuple[Data, int | None, bool]:
    """Contents of the streams that follow each other from a place on, their end if they have one, and whether they are above the bound."""
    sink, end = _Sink(), at
    while machine := _machine(data[end : end + 6]):
        stop = _inflated(machine, data, end, sink)
        if stop is None:
            return sink.done(), None, sink.size > LAYER
        end = stop
        # Zeros may fill up the place between streams.
        while data[end : end + 1] == b"\x00":
            end += 1
    return sink.done(), end, sink.size > LAYER


def _packed(layer: Data) -> Iterator[tuple[Data, Place, bool]]:
    """Contents of the compressed data in a layer, as in ``_layers``."""
    # zlib has a mark of two bytes only, which counts where a layer begins.
    starts = [0] if layer[:1] == b"x" else []
    for mark in (b"\x1f\x8b\x08", b"BZh", b"\xfd7zXZ\x00"):
        start = layer.find(mark)
        while start >= 0:
            starts.append(start)
            start = layer.find(mark, start + 1)
    done = 0
    for start in sorted(starts):
        if start < done:
            continue
        plain, end, large = _unpacked(layer, start)
        if plain:
            # Further streams may begin behind the mark of a broken one, which counts to the end.
            done, end = (start + 1, len(layer)) if end is None else (end, end)
            # One past the end of the layer: with what fills it up.
            stretch = start, end + (end == len(layer))
            yield plain, lambda start, end, stretch=stretch: stretch, large


class _Token:
    """A base64 token: the stretches of a layer it is made of, in order, and its end with what fills it up."""

    def __init__(self, stretches: list[tuple[int, int]], stop: int, shifts: int = 1) -> None:
        self.stretches, self.stop, self.shifts = stretches, stop, shifts
        self.starts = [0]
        for start, end in stretches:
            self.starts.append(self.starts[-1] + end - start)

    def at(self, n: int) -> int:
        """Where a character of the token stands in the layer."""
        stretch = min(bisect_right(self.starts, n), len(self.stretches)) - 1
        return self.stretches[stretch][0] + n - self.starts[stretch]

    def place(self, shift: int, size: int) -> Place:
        """Where bytes come from that are decoded from the character ``shift`` on. Four characters stand for three."""
        return lambda start, end: (
            self.at(shift + start * 4 // 3),
            self.stop if end > size else self.at(shift - (-end * 4 // 3) - 1) + 1,
        )

    def pieces(self, layer: Data) -> Iterator[int]:
        """Characters at which zlib data may start after a separator or a line break."""
        for n, (start, end) in enumerate(self.stretches):
            if n and _ZLIB.match(layer, start, end):
                yield self.starts[n]
            for match in _ZLIB_PIECE.finditer(layer, start, end):
                yield self.starts[n] + match.start() + 1 - start


def _joined(layer: Data, lines: list[tuple[int, int]], stop: int) -> Iterator[_Token]:
    """Tokens of runs that only line breaks part: all in one, and each by itself."""
    whole, end = list(lines), lines[-1][1]
    if before := _BEFORE.search(layer[max(0, lines[0][0] - 64) : lines[0][0]]):
        shift = max(0, lines[0][0] - 64)
        whole.insert(0, (before.start(1) + shift, before.end(1) + shift))
    if stop == end and (after := _AFTER.match(layer, end)):
        whole.append(after.span(1))
    if len(whole) > 1:
        yield _Token(whole, after.end() if whole[-1][1] > end else stop, 4)
    for start, end in lines:
        parted = any(layer.find(c, start, end) >= 0 for c in (b"+", b"/", b"_", b"-"))
        yield _Token([(start, end)], stop if end == lines[-1][1] else end, 4 if parted and len(whole) == 1 else 1)


def _tokens(layer: Data) -> Iterator[_Token]:
    """All base64 tokens. Those that may have something before them are decoded at each of four shifts."""
    lines: list[tuple[int, int]] = []
    stop = 0
    for match in _BASE64.finditer(layer):
        start, end = match.span(1)
        if lines and not (stop == lines[-1][1] and _BREAK.fullmatch(layer, stop, start)):
            yield from _joined(layer, lines, stop)
            lines = []
        lines.append((start, end))
        stop = match.end()
    if lines:
        yield from _joined(layer, lines, stop)


def _plain(layer: Data, token: _Token, skip: int) -> Data:
    """The bytes of a token without its first ``skip`` characters. One too many at the end stands for no byte."""
    sink, rest = _Sink(), b""
    for start, end in token.stretches:
        start, skip = min(start + skip, end), max(0, skip - (end - start))
        for at in range(start, end, CHUNK):
            piece = rest + layer[at : min(at + CHUNK, end)].translate(_STANDARD)
            whole = len(piece) & ~3
            sink.write(binascii.a2b_base64(piece[:whole]))
            rest = piece[whole:]
    if len(rest) > 1:
        sink.write(binascii.a2b_base64(rest + b"=" * (4 - len(rest))))
    return sink.done()


def _layers(layer: Data) -> Iterator[tuple[Data, Place, bool]]:
    """Layers directly below one, and whether they are above the bound."""
    for mark, pattern, decode in ((b"%", _PERCENT, _percent), (b"\\", _ESCAPE, _escape), (b"\x00", _WIDE, _narrow)):
        if layer.find(mark) >= 0 and (found := _replaced(layer, pattern, decode)):
            yield *found, len(found[0]) > LAYER
    yield from _packed(layer)
    for token in _tokens(layer):
        starts: list[list[int]] = [[], [], [], []]
        if token.shifts > 1:
            for start in token.pieces(layer):
                starts[start % 4].append(start)
        for shift in range(token.shifts):
            data = _plain(layer, token, shift)
            place = token.place(shift, len(data))
            yield data, place, len(data) > LAYER
            for start in starts[shift]:
                at = (start - shift) // 4 * 3
                plain, end, large = _unpacked(data, at)
                if at and plain:
                    end = len(data) if end is None else end
                    stretch = place(at, end + (end == len(data)))
                    yield plain, lambda start, end, stretch=stretch: stretch, large


def _mark(layer: Data) -> bytes:
    return hashlib.blake2b(layer, digest_size=16).digest()


def _readable(layer: bytes) -> bool:
    """Whether nine characters of ten are printable."""
    odd = layer.translate(None, _READABLE)
    plain = len(layer) - len(odd)
    if not odd.isascii():
        try:
            odd = odd.decode()
        except UnicodeDecodeError:
            return False
        return plain + sum(map(str.isprintable, odd)) >= 0.9 * (plain + len(odd))
    return plain >= 0.9 * len(layer)


class _Layer:
    """A layer in work: its place in the one above, what is below it, what was found.

    Found are spans, and the places of layers under their marks.
    """

    def __init__(self, layer: Data, mark: bytes, place: Place | None) -> None:
        self.mark, self.place, self.size = mark, place, len(layer)
        self.found: set[tuple[str | bytes, int, int]] = set(scan(layer))
        self.inner = _layers(layer)
        self.counts = len(self.found) > 0 or len(layer) > LAYER or _readable(layer)
        self.cycle = False


def find_secrets(text: str) -> tuple[list[Span], list[Span], int, int]:
    """Spans of the text itself, spans of all layers, number of layers, layers above the bound."""
    whole = text.encode("latin-1", "replace")
    top = _Layer(whole, _mark(whole), None)
    base = sorted(top.found, key=lambda s: (s[1], ORDER[s[0]], s[2]))
    skipped = 0
    # What is below a layer does not depend on its place, so each is unwrapped once.
    below: dict[bytes, set[tuple[str | bytes, int, int]]] = {}
    work, above = [top], {top.mark}
    while work:
        last = work[-1]
        deeper, place, large = next(last.inner, (b"", None, False))
        skipped += large
        if deeper:
            if len(deeper) < _SHORT and not _LIVE.search(deeper) and not _machine(deeper[:6]):
                if _readable(deeper):
                    last.found.add((_mark(deeper), *place(0, len(deeper))))
                    last.counts = True
                continue
            mark = _mark(deeper)
            if mark in above:
                # What is found below these depends on the layers above them.
                for layer in work:
                    layer.cycle = True
            elif mark in below:
                last.found.update((kind, *place(start, end)) for kind, start, end in below[mark])
            else:
                work.append(_Layer(deeper, mark, place))
                above.add(mark)
        elif place is None:
            work.pop()
            above.remove(last.mark)
            if not work:
                break
            if last.counts or last.found:
                last.found.add((last.mark, 0, last.size))
            if not last.cycle:
                below[last.mark] = last.found
            work[-1].found.update((kind, *last.place(start, end)) for kind, start, end in last.found)
    # A span may end past the text where data fills up its layer.
    spans = {(kind, start, min(end, len(text))) for kind, start, end in top.found if isinstance(kind, str)}
    layers = sum(isinstance(kind, bytes) for kind, _, _ in top.found)
    return base, sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2])), layers, skipped


def shown(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``_id``, counts ``n_assign``, ``n_access``, ``n_hex``
    and ``base`` (spans of the text itself), ``spans`` (of all layers), ``layers``,
    ``skipped_layers``."""
    texts = docs.select(
        column(id_column).alias("_id"), F.coalesce(column(text_column).cast("string"), F.lit("")).alias("_text")
    )
    kind = texts.schema["_id"].dataType.simpleString()
    names = [k[0] for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_secrets(value.as_py()) for value in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in f[0]) for f in found], pa.int64()) for k in names]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *counts,
                    pa.array([shown(f[0]) for f in found], pa.string()),
                    pa.array([shown(f[1]) for f in found], pa.string()),
                    pa.array([f[2] for f in found], pa.int64()),
                    pa.array([f[3] for f in found], pa.int64()),
                ],
                ["_id", *[f"n_{k}" for k in names], "base", "spans", "layers", "skipped_layers"],
            )

    counts = ", ".join(f"n_{k} bigint" for k in names)
    return texts.mapInArrow(run, f"_id {kind}, {counts}, base string, spans string, layers bigint, skipped_layers bigint")
