"""SentencePiece encoding and decoding of merge-type models, exact by backtracking.

A text is cut where no piece can reach across: before every run of word marks and, if no piece holds both, between
letters and other characters (both are checked against the model). A cut part is encoded once per worker. Inside a part, an Aho-Corasick automaton finds the longest piece at every character; the
encoder takes the longest one whose pair with the piece before it survives re-merging, falls back to shorter
prefixes, and steps back where none fits, remembering failed positions in a bitfield. A sequence whose neighbours
all survive re-merging is the one that merging the whole part gives.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from formgrain.llm import common

MARK = "▁"
CACHED_PARTS = 150_000
CACHED_PAIRS = 1 << 18
LONGEST_CACHED = 48
NEVER = float("inf")
SLICE_BYTES = 2 << 20

# The library puts one replacement character for every byte it cannot read; "replace" puts one for several.
codecs.register_error("replace_each_byte", lambda e: ("\ufffd", e.start + 1))


class Parts(dict):
    """Ids of a cut part; the first CACHED_PARTS different short ones are remembered."""

    def __init__(self, encode: Callable[[str], str]):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> str:
        ids = self.encode(part)
        if len(self) < CACHED_PARTS and len(part) <= LONGEST_CACHED:
            self[part] = ids
        return ids


class Model:
    """Pieces and ranks of a model file, with the encoder and the decoder."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = model.eos_id()
        self.ranks: dict[str, float] = {}
        self.ids: dict[str, str] = {}
        self.bytes = [""] * 256
        self.surfaces: dict[str, bytes] = {}
        automaton = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value], self.surfaces[str(i)] = str(i), bytes([value])
            elif model.is_unknown(i):
                self.surfaces[str(i)] = " ⁇ ".encode()
            elif model.is_control(i):
                self.surfaces[str(i)] = b""
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} goes on after a word mark")
                self.ranks[piece], self.ids[piece] = -model.get_score(i), str(i)
                self.surfaces[str(i)] = piece.replace(MARK, " ").encode()
                automaton.add_word(piece, len(piece))
        automaton.make_automaton()
        characters = "".join(sorted(re.escape(p) for p in self.ranks if len(p) == 1))
        self.runs = re.compile(f"([{characters}]+)|([^{characters}]+)").findall
        met = {a + b for p in self.ranks for a, b in zip(p, p[1:], strict=False)}
        letters = "".join(sorted(re.escape(p) for p in self.ranks if len(p) == 1 and p.isalpha()))
        mixed = re.compile(f"[{letters}][^{letters}{MARK}]|[^{letters}{MARK}][{letters}]").fullmatch
        self.cut = re.compile(f"{MARK}+[^{MARK}]*" if any(map(mixed, met)) else f"{MARK}*[{letters}]+|{MARK}*[^{letters}{MARK}]+|{MARK}+").findall
        self.automaton = automaton
        self.longest = max(map(len, self.ranks))
        self.parts = Parts(self.encode_part)
        self.prefixes: dict[str, str] = {}
        self.histories: dict[str, list[tuple[float, str, str]]] = {}
        self.survives = lru_cache(CACHED_PAIRS)(self._survives)

    def merges(self, text: str) -> list[tuple[float, str, str]]:
        """Merging by rank, leftmost first among equals: before the first and after each merge, its rank with the first
        and the last symbol. A text that is no single piece at the end has none."""
        symbols = list(text)
        ranks = [self.ranks.get(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        steps = [(NEVER, symbols[0], symbols[-1])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                return []
            k = ranks.index(best)
            symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = self.ranks.get(symbols[k - 1] + symbols[k], NEVER)
            if k < len(ranks):
                ranks[k] = self.ranks.get(symbols[k] + symbols[k + 1], NEVER)
            steps.append((best, symbols[0], symbols[-1]))
        return steps

    def history(self, piece: str) -> list[tuple[float, str, str]]:
        steps = self.histories.get(piece)
        if steps is None:
            steps = self.histories[piece] = self.merges(piece)
        return steps

    def _survives(self, left: str, right: str) -> bool:
        """Does re-merging the two pieces side by side give the two pieces? An empty left one: does it give the right one?

        Both merge on their own, always the better rank first, until a pair across the border would go before either.
        """
        b = self.history(right)
        if not left or not b:
            return bool(b)
        a = self.history(left)
        i = j = 0
        while a:
            of_a = a[i + 1][0] if i + 1 < len(a) else NEVER
            of_b = b[j + 1][0] if j + 1 < len(b) else NEVER
            across = self.ranks.get(a[i][2] + b[j][1], NEVER)
            if across < of_a and across <= of_b:
                return False
            if of_a == of_b == NEVER:
                return True
            if of_a <= of_b:
                i += 1
            else:
                j += 1
        return False

    def shorter(self, piece: str) -> str:
        """The longest piece that is a true prefix of ``piece``, or nothing."""
        if piece not in self.prefixes:
            self.prefixes[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ranks), "")
        return self.prefixes[piece]

    def backtracked(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all pieces."""
        longest, survives, taken, at, last = self.automaton.iter_long, self.survives, [], 0, ""
        # Most texts are what the longest pieces make of them, one after the other, in one pass of the automaton.
        for end, _ in longest(text):
            piece = text[at:end + 1]
            if not survives(last, piece):
                break
            taken.append(piece)
            at, last = end + 1, piece
        else:
            return taken
        # The automaton sees no more than the longest piece can reach, so each step costs the same however long the text is.
        first = lambda at: text[at:at + next(longest(text[at:at + self.longest]))[1]]
        failed = bytearray((len(text) >> 3) + 1)
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and survives(last, piece):
                taken.append(piece)
                if end == len(text):
                    return taken
                at, last, piece = end, piece, first(end)
                continue
            piece = self.shorter(piece)
            while not piece:
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= len(piece)
                last = taken[-1] if taken else ""
                piece = self.shorter(piece)

    def encode_part(self, part: str) -> str:
        """Decimal ids of a part, joined by one space; characters without a piece become bytes."""
        ids: list[str] = []
        for known, unknown in self.runs(part):
            if known:
                ids += map(self.ids.__getitem__, self.backtracked(known))
            else:
                ids += [self.bytes[b] for b in unknown.encode()]
        return " ".join(ids)

    def encode(self, text: str, end: bool = True) -> str:
        """Decimal ids joined by one space, as the library gives them."""
        parts: list[str] = []
        if text:
            marked = MARK + text.replace(" ", MARK)
            parts = list(map(self.parts.__getitem__, self.cut(marked)))
        if end:
            parts.append(str(self.end))
        return " ".join(parts)

    def decode(self, ids: str) -> bytes:
        """UTF-8 of the text of decimal ids; what isn't UTF-8 becomes replacement characters."""
        known = ids.split()
        while known and not self.surfaces[known[0]]:
            known = known[1:]
        text = b"".join(map(self.surfaces.__getitem__, known))
        text = text[1:] if text[:1] == b" " and self.surfaces[known[0]] != " ⁇ ".encode() else text
        return text.decode("utf-8", "replace_each_byte").encode()


@lru_cache(2)
def model_of(path: str) -> Model:
    return Model(path)


def coded(batches: Iterator[pa.RecordBatch], path: str, end: bool) -> Iterator[pa.RecordBatch]:
    model = model_of(path)
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        for a, b in common.byte_slices(texts, SLICE_BYTES):
            ids = [model.encode(t.decode("utf-8", "replace"), end) for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array([x.count(" ") + bool(x) for x in ids], pa.int64()),
                pa.array(ids, pa.large_string()).cast(pa.string()), pa.array([model.decode(x) for x in ids], pa.binary()).cast(pa.string()),
            ], names=["doc_id", "n_tokens", "ids", "decoded"])


def encode_and_decode(documents: DataFrame, path: str, end: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (decimal, joined by one space) and decoded (the text of these ids).

    ``path``: a BPE model file of sentencepiece, at the same place on every worker. Null and empty texts have the end
    id alone, and decode to an empty text. Whole texts are coded, whatever their length; repeated rows and null
    doc_ids are coded like any others; other columns are ignored; an empty table gives an empty result. No shuffle.
    """
    common.on_workers(documents.sparkSession)
    return common.texts_of(documents).mapInArrow(lambda b: coded(b, path, end), "doc_id long, n_tokens long, ids string, decoded string")
