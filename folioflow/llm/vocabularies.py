"""More encoders of the kind of ``bytebpe``: texts are cut into pieces that the vocabulary encodes one by one.

``WordEncoder`` is for vocabularies with a normaliser and a pattern that drops blanks, ``SentenceEncoder`` for
sentencepiece models whose pieces hold a blank at their beginning alone, ``PlainEncoder`` for byte-level ones that take the
strings of special tokens as ordinary text. The ids are the library's; numpy finds the pieces, and each distinct
piece is encoded once while it is kept.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from itertools import chain

import numpy as np

from folioflow.llm.bytebpe import CONTRACTIONS, LETTER, NUMBER, OTHER, SPACE, PieceEncoder
from folioflow.llm.words import run_hashes

BLANK = "▁"


class PlainEncoder(PieceEncoder):
    """A byte-level vocabulary; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.marks = None

    def byte_lengths(self) -> np.ndarray:
        """Bytes of every id: a byte-level entry has a character for each."""
        out = np.zeros(self.library.get_vocab_size(), dtype=np.int64)
        for entry, number in self.library.get_vocab().items():
            out[number] = len(entry)
        return out


class WordEncoder(PieceEncoder):
    """A vocabulary whose normaliser works on characters and whose pattern keeps letters, single digits and other marks, and drops blanks."""

    def __init__(self, path: str):
        super().__init__(path)
        added = self.library.get_added_tokens_decoder().values()
        self.literal = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        if self.added:  # the longest first, as the library matches them
            self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        #: Code point -> what the normaliser makes of it alone + 1; 0 not met yet, 1 << 31 for those that depend on their neighbours.
        self.made = np.zeros(0x110000, dtype=np.uint32)

    def _alone(self, char: str) -> int:
        code = ord(char)
        apart = unicodedata.category(char)[0] == "M" or 0x1100 <= code < 0x1200 or 0x11000 <= code < 0x1F000 or code >= 0x32000
        made = self.library.normalizer.normalize_str("a" + char)
        return 1 << 31 if apart or len(made) != 2 or made[0] != "a" else ord(made[1]) + 1

    def normal(self, texts: list[str]) -> list[str]:
        """The texts as the library's normaliser leaves them, but for runs of blanks, which stay."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        made = self.made[points]
        if not made.all():
            for point in np.unique(points[made == 0]).tolist():
                self.made[point] = self._alone(chr(point))
            made = self.made[points]
        odd = np.concatenate([[0], np.cumsum(made == 1 << 31)])
        joined = np.where(made == 1 << 31, 0x20, made - 1).astype("<u4").tobytes().decode("utf-32-le")
        hard = odd[ends] > odd[ends - sizes]
        return [self.library.normalizer.normalize_str(t) if h else joined[b - a : b] for t, h, a, b in zip(texts, hard.tolist(), sizes.tolist(), ends.tolist(), strict=True)]

    def _classify(self, points: np.ndarray) -> np.ndarray:
        kinds = self.classes[points]
        if not kinds.all():
            split = self.library.pre_tokenizer.pre_tokenize_str
            for point in np.unique(points[kinds == 0]).tolist():
                char = chr(point)
                self.classes[point] = SPACE if not split(char) else LETTER if len(split("a" + char)) == 1 else NUMBER if len(split(char + char)) == 2 else OTHER
            kinds = self.classes[points]
        return kinds

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        kinds = self._classify(points)
        starts = first | (kinds == NUMBER)
        starts[1:] |= kinds[1:] != kinds[:-1]
        marks = np.flatnonzero((points == 0x27) & starts)
        owner = np.cumsum(first)
        for ending in CONTRACTIONS:
            at = marks[marks + len(ending) < len(points)]
            at = at[owner[at] == owner[at + len(ending)]]
            for k, char in enumerate(ending, 1):
                at = at[points[at + k] == ord(char)]
            starts[at + 1] = False
            after = at + len(ending) + 1
            after = after[after < len(points)]
            starts[after] |= kinds[after] == LETTER
        return starts

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        blank = self._classify(np.fromiter((ord(p[0]) for p in pieces), dtype=np.uint32, count=len(pieces))) == SPACE
        whole = [p for p, b in zip(pieces, blank.tolist(), strict=True) if not b]
        # A blank before it, which the pattern drops, lets many words go to the library in one text.
        counts, ids = super()._encode_pieces([f" {p}" if p.isalpha() else p for p in whole])
        normal = self.library.normalizer.normalize_str
        altered = [k for k, p in enumerate(whole) if not p.isascii() and normal(p) != p]
        if altered:  # pieces that the normaliser would alter when they stand alone go past it
            lists = np.split(ids, np.cumsum(counts)[:-1])
            for k in altered:
                lists[k] = np.array(self._past(whole[k]), dtype=self.dtype)
            counts, ids = np.fromiter(map(len, lists), dtype=np.int32, count=len(lists)), np.concatenate(lists)
        out = np.zeros(len(pieces), dtype=np.int32)
        out[~blank] = counts
        return out, ids

    def _past(self, piece: str) -> list[int]:
        (shown, _), *more = self.library.pre_tokenizer.pre_tokenize_str(piece)
        return [token.id for part in (shown, *[m[0] for m in more]) for token in self.library.model.tokenize(part)]

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return super()._encode_plain(self.normal(texts))


class SentenceEncoder(PieceEncoder):
    """A sentencepiece model none of whose pieces has a blank after another character; every text must begin with a blank.

    Such a text falls apart before each run of blanks, and its parts are encoded independently. A part whose
    bytes the model does not give back gets no ids, so that it shows in the sum of the bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        if any(re.search(f"[^{BLANK}]{BLANK}", e) for e in entries):
            raise ValueError(f"{path}: pieces with a blank inside are not supported")
        self.bytes = [bytes([int(e[3:5], 16)]) if self.library.is_byte(k) else e.replace(BLANK, " ").encode() for k, e in enumerate(entries)]
        self.marks = None
        self.dtype = np.dtype("<u2") if len(entries) <= 1 << 16 else np.dtype("<u4")
        self._empty()

    def byte_lengths(self) -> np.ndarray:
        return np.fromiter(map(len, self.bytes), dtype=np.int64, count=len(self.bytes))

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        blank = points == 0x20
        starts = first.copy()
        starts[1:] |= blank[1:] & ~blank[:-1]
        return starts

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.library.encode([p[1:] for p in pieces], num_threads=1)  # the library sets a blank before each
        lists = [x or [self.library.piece_to_id(BLANK)] for x in lists]
        lists = [x if b"".join([self.bytes[k] for k in x]) == p.encode() else [] for p, x in zip(pieces, lists, strict=True)]
        counts = np.fromiter(map(len, lists), dtype=np.int32, count=len(lists))
        return counts, np.fromiter(chain.from_iterable(lists), dtype=self.dtype, count=int(counts.sum()))


@dataclass
class Cut:
    """The pieces of some texts: 64-bit keys, places in ``joined``, and where each text's begin (one more at the end)."""

    keys: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    joined: str
    bounds: np.ndarray

    def strings(self, which: np.ndarray) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.begin[which].tolist(), self.stop[which].tolist(), strict=True)]


def cut(encoder: PieceEncoder, texts: list[str]) -> Cut:
    """The pieces of texts without added tokens."""
    if isinstance(encoder, WordEncoder):
        texts = encoder.normal(texts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends, joined = np.cumsum(sizes), "".join(texts)
    if not joined:
        nothing = np.zeros(0, dtype=np.int64)
        return Cut(nothing.astype(np.uint64), nothing, nothing, "", np.zeros(len(texts) + 1, dtype=np.int64))
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    first = np.zeros(len(joined), dtype=bool)
    first[(ends - sizes)[sizes > 0]] = True
    begin = np.flatnonzero(encoder._starts(points, first))
    stop = np.append(begin[1:], len(joined))
    return Cut(run_hashes(points, begin, stop), begin, stop, joined, np.searchsorted(begin, np.concatenate(([0], ends))))


def encoder_for(path: str) -> PieceEncoder:
    """This worker's encoder for a vocabulary file, that treats strings of special tokens as the library does by default."""
    if path.endswith(".model"):
        return kept(SentenceEncoder, path)
    if (PieceEncoder, path) not in _KEPT:
        plain = PieceEncoder(path)
        _KEPT[PieceEncoder, path] = plain if plain.library.normalizer is None else WordEncoder(path)
    return _KEPT[PieceEncoder, path]


_KEPT: dict[tuple, PieceEncoder] = {}


def kept(kind: type[PieceEncoder], path: str) -> PieceEncoder:
    """This worker's encoder of a kind for a vocabulary; kept between tasks."""
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = kind(path)
    return _KEPT[kind, path]
