"""SentencePiece encoding and decoding of merge-type (BPE) models.

Encoding fills a prefix table: for each prefix of a word the last token of its
encoding. That token is unique, so the table needs one entry a prefix. Candidates
are the pieces that end there, found by an Aho-Corasick automaton over all pieces;
the right one is the one whose pair with the last token of the shorter prefix is
compatible, i.e. merging the two pieces' text gives these two tokens again. The ids
of the whole word are then read backwards from its end.

Texts are first cut where no piece can reach across, which is checked against the
whole vocabulary, and the ids of the parts are kept in a table of at most
``KEPT`` parts. Characters without a piece become byte pieces.

Defined results: a null text is an empty one and has no ids but the begin and end
ids. Texts are encoded whole, however long. Repeated rows give equal rows, an empty
table an empty result. Only the id and text columns are read. The model's file is
read by the driver and sent to the tasks; its size bounds what is sent.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from cropline.llm.common import column

SPACE = "▁"
KEPT = 400_000
PAIRS = 1_000_000
SLICE = 256
_LOW = 1 << 60


def simulate(text: str, ranks: dict[str, int]) -> list[str]:
    """Merge the best adjacent pair, the first of equal ones, until none is a piece."""
    parts = list(text)
    while len(parts) > 1:
        found = [ranks.get(a + b, _LOW) for a, b in zip(parts, parts[1:])]
        best = min(found)
        if best == _LOW:
            break
        at = found.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@dataclass
class Codec:
    """Encoder and decoder of one model."""

    pieces: list[str]
    scores: list[float]
    kinds: list[str]
    begin: int
    end: int
    dummy_prefix: bool
    ids: dict[str, int] = field(init=False)

    @classmethod
    def load(cls, model: bytes) -> Codec:
        """Read a model. Refuses what the method does not cover."""
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = range(library.get_piece_size())
        kinds = [
            "control" if library.is_control(i) else "unknown" if library.is_unknown(i)
            else "byte" if library.is_byte(i) else "unused" if library.is_unused(i) else "piece"
            for i in size
        ]
        codec = cls(
            [library.id_to_piece(i) for i in size],
            [library.get_score(i) for i in size],
            kinds,
            library.bos_id(),
            library.eos_id(),
            library.encode("a", out_type=str)[0].startswith(SPACE),
        )
        if kinds.count("byte") != 256 or "unused" in kinds:
            raise ValueError("needs a merge-type model with byte pieces and without unused ones")
        for probe in ("", " ", "  a  b ", "a\nb\tc", "ｆ　x", "é é ﬁ", "▁x▁", "\r\n\x00", "A​B \U0001f600"):
            if codec.encode(probe) != library.encode(probe, add_bos=True, add_eos=True):
                raise ValueError("the model changes texts before it cuts them, or is not of merge type")
        return codec

    def __post_init__(self) -> None:
        own = [i for i, kind in enumerate(self.kinds) if kind == "piece"]
        self.ids = {self.pieces[i]: i for i in own}
        order = {score: n for n, score in enumerate(sorted({self.scores[i] for i in own}, reverse=True))}
        self.ranks = {self.pieces[i]: order[self.scores[i]] for i in own if len(self.pieces[i]) > 1}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, kind in enumerate(self.kinds) if kind == "byte"}
        self.single = {c for p in self.ids for c in p}
        self.automaton = ahocorasick.Automaton()
        # Characters inside pieces are the least tokens, whether or not they are pieces themselves.
        for token in dict.fromkeys([*self.ids, *sorted(self.single)]):
            self.automaton.add_word(token, token)
        self.automaton.make_automaton()
        self.cut = self._cutter()
        self.pairs: dict[str, dict[str, bool]] = {}
        self.known_pairs = 0
        self.kept: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}

    def _cutter(self) -> re.Pattern:
        """Pattern of the parts of a text, which no piece reaches out of.

        A part is spaces with letters and digits, or spaces with other characters.
        Characters that some piece joins to the other class are moved to it.
        """
        moved: set[str] = set()
        for _ in range(8):
            other = "".join(re.escape(c) for c in ["_", *sorted(moved)])
            pattern = re.compile(f"{SPACE}*(?:[^\\W{other}]+|(?:[^\\w{SPACE}]+|[{other}]+)+)|{SPACE}+")
            wrong = [p for p in self.ids if pattern.findall(p) != [p]]
            if not wrong:
                return pattern
            moved |= {c for p in wrong for c in p if c.isalnum() and not c.isascii()}
        pattern = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)
        if all(pattern.findall(p) == [p] for p in self.ids):
            return pattern
        return re.compile(".+", re.DOTALL)

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the two tokens' text leaves just these two; with no left
        one, whether merging the right one's text leaves it whole."""
        if self.known_pairs >= PAIRS:
            self.pairs.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        fits = simulate(left + right, self.ranks) == ([left, right] if left else [right])
        self.pairs.setdefault(left, {})[right] = fits
        return fits

    def part(self, text: str) -> list[str]:
        """Tokens of a part of a text, by the prefix table."""
        size = len(text)
        last: list[str | None] = [None] * (size + 1)
        last[0] = ""
        pairs, compatible, nothing = self.pairs, self.compatible, {}
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                start = end - len(token)
                before = last[start]
                if before is None:
                    # A character outside all pieces stands alone; a known one has had its turn.
                    if text[start - 1] in self.single:
                        continue
                    before = last[start] = text[start - 1]
                fits = pairs.get(before, nothing).get(token)
                if fits or (fits is None and compatible(before, token)):
                    last[end] = token
        tokens, at = [], size
        while at:
            token = last[at] or text[at - 1]
            tokens.append(token)
            at -= len(token)
        tokens.reverse()
        return tokens

    def _ids(self, tokens: Iterable[str]) -> Iterator[int]:
        for token in tokens:
            found = self.ids.get(token)
            if found is None:
                yield from (self.bytes[b] for b in token.encode())
            else:
                yield found

    def packed(self, text: str) -> tuple[bytes, bytes]:
        """Ids with begin and end, as little-endian words, and the decoded text."""
        shown = (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)
        parts = self.cut.findall(shown)
        found = list(map(self.kept.get, parts))
        if None in found:
            found = [self._keep(part) if ids is None else ids for part, ids in zip(parts, found)]
        first, last = np.array([self.begin, self.end], "<u4").reshape(2, 1)
        # The parts of ``odd`` are those whose ids do not decode to their own text.
        if self.odd:
            raw = "".join([self.odd.get(part, part) for part in parts])
        else:
            raw = shown
        raw = raw.replace(SPACE, " ")
        return b"".join([first.tobytes(), *found, last.tobytes()]), (raw[1:] if self.dummy_prefix else raw).encode()

    def _keep(self, part: str) -> bytes:
        """Encode a part, decode its ids, and keep both if it is short."""
        known = self.kept.get(part)
        if known is not None:
            return known
        ids = list(self._ids(self.part(part)))
        packed, decoded = np.array(ids, "<u4").tobytes(), self.surface(ids)
        if decoded != part.replace(SPACE, " ").encode():
            self.odd[part] = decoded.decode(errors="replace")
        if len(part) <= 64:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[part] = packed
        return packed

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text)[0], "<u4").tolist()

    def surface(self, ids: Iterable[int]) -> bytes:
        """What ids stand for, first space included; control ids for nothing."""
        out = bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == "byte":
                out.append(int(self.pieces[i][3:5], 16))
            elif kind == "unknown":
                out += " ⁇ ".encode()
            elif kind == "piece":
                out += self.pieces[i].replace(SPACE, " ").encode()
        return bytes(out)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids. Bytes that are no character become U+FFFD, each of its own."""
        shown = [i for i in ids if self.kinds[i] != "control"]
        raw, out = self.surface(shown), []
        if self.dummy_prefix and shown and self.kinds[shown[0]] == "piece" and raw.startswith(b" "):
            raw = raw[1:]
        while raw:
            try:
                out.append(raw.decode())
                break
            except UnicodeDecodeError as error:
                out.append(raw[: error.start].decode() + "\ufffd")
                raw = raw[error.start + 1 :]
        return "".join(out)


def _codec(box: dict) -> Codec:
    """The codec of a broadcast model. A worker process reads a broadcast value once and keeps
    it, so the codec is kept there: all tasks that the process runs share its tables."""
    if "codec" not in box:
        box["codec"] = Codec.load(box["model"])
    return box["codec"]


def encode_texts(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(_id, ids, decoded)``: packed ids of every text, and the bytes they decode to."""
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast({"model": file.read()})
    texts = docs.select(
        column(id_column).alias("_id"), F.coalesce(column(text_column).cast("string"), F.lit("")).alias("_text")
    )
    kind = texts.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for whole in batches:
            # Results are larger than texts, so they leave in small batches.
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows = [codec.packed(value.as_py()) for value in batch.column(1)]
                ids, decoded = (pa.array([r[i] for r in rows], pa.binary()) for i in range(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], ["_id", "ids", "decoded"])

    return texts.mapInArrow(run, f"_id {kind}, ids binary, decoded binary")
