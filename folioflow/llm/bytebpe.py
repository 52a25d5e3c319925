"""Byte-level BPE encoding of many texts at once, with ids by the ``tokenizers`` library.

A byte-level BPE vocabulary splits a text into pieces by one fixed pattern and encodes every piece on
its own, so the ids of a text are the ids of its pieces in order. Pieces repeat. Here numpy finds the
pieces of a whole chunk of texts, the library encodes each distinct piece once, and the ids are
gathered. The classes of code points (letter, number, space, other) are asked from the library too, so
both agree on any Unicode version. Strings of the vocabulary's added tokens are cut out first and get
their ids, as the library gives them; a vocabulary whose added tokens are matched in any other way than
literally is left to the library for the texts that hold one.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from folioflow.llm.common import ragged
from folioflow.llm.words import run_hashes

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
#: Endings that the byte-level pattern splits off after an apostrophe (fixed values of that pattern).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct pieces kept in a worker before its table is emptied.
CACHE_PIECES = 1_500_000
#: Words joined into one text for the library.
WORDS_AT_ONCE = 500


class PieceEncoder:
    """Encodes lists of texts as the library does without added special tokens; keeps the ids of pieces that it has met."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.added = {token.content: number for number, token in added.items()}
        self.literal = len(added) < 2 and not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.marks = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.classes = np.zeros(0x110000, dtype=np.uint8)
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.offsets = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(0, dtype=self.dtype)

    def _classify(self, points: np.ndarray) -> np.ndarray:
        kinds = self.classes[points]
        if not kinds.all():
            split = self.library.pre_tokenizer.pre_tokenize_str
            for point in np.unique(points[kinds == 0]):
                char = chr(point)
                joins = [kind for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(before + char)) == 1]
                self.classes[point] = joins[0] if joins else SPACE
            kinds = self.classes[points]
        return kinds

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mask of piece starts. ``first``: mask of the first code point of each text."""
        n = len(points)
        kinds = self._classify(points)
        ws = kinds == SPACE
        run = first.copy()
        run[1:] |= kinds[1:] != kinds[:-1]
        after_blank = np.zeros(n, dtype=bool)
        after_blank[1:] = (points[:-1] == 0x20) & ~first[1:]
        before_word = np.zeros(n, dtype=bool)
        before_word[:-1] = ~ws[1:] & ~first[1:]
        starts = first | (ws & (run | before_word)) | (~ws & run & ~after_blank)
        marks = np.flatnonzero((points == 0x27) & starts)
        if len(marks):
            owner = np.cumsum(first)
            for ending in CONTRACTIONS:
                size = len(ending) + 1
                at = marks[marks + size <= n]
                at = at[owner[at] == owner[at + size - 1]]
                for k, char in enumerate(ending, 1):
                    at = at[points[at + k] == ord(char)]
                starts[at + 1] = False
                nxt = at + size
                nxt = nxt[nxt < n]
                starts[nxt] |= kinds[nxt] == LETTER
        return starts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (one more at the end). Null counts as empty."""
        texts = [t or "" for t in texts]
        marked = [k for k, t in enumerate(texts) if self.marks is not None and self.marks.search(t)]
        if not marked:
            return self._encode_plain(texts)
        # A marked text is cut at its added tokens: plain parts at even places, tokens at odd ones.
        marked_set = set(marked)
        parts = [self._parts(t) if k in marked_set else [t] for k, t in enumerate(texts)]
        flat = list(chain.from_iterable(parts))
        tokens = [self.added.get(p) if isinstance(p, str) else p for p in flat]
        ids, bounds = self._encode_plain([p if token is None else "" for p, token in zip(flat, tokens, strict=True)])
        pieces = [np.array(np.atleast_1d(token), dtype=self.dtype) if token is not None else ids[a:b] for token, a, b in zip(tokens, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        last = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))) - 1
        return np.concatenate(pieces), np.concatenate([[0], ends[last]])

    def _parts(self, text: str) -> list:
        """A text cut at its added tokens, or the ids of the whole text."""
        return self.marks.split(text) if self.literal else [self.library.encode(text, add_special_tokens=False).ids]

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts without added tokens."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return np.zeros(0, dtype=self.dtype), np.zeros(len(texts) + 1, dtype=np.int64)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        first = np.zeros(total, dtype=bool)
        first[(ends - sizes)[sizes > 0]] = True
        begin = np.flatnonzero(self._starts(points, first))
        stop = np.append(begin[1:], total)
        keys = run_hashes(points, begin, stop)
        distinct, where, which = np.unique(keys, return_index=True, return_inverse=True)
        slot = self._slots(distinct, where, begin, stop, joined)
        slot = slot[which]
        counts = self.counts[slot].astype(np.int64)
        ids = self.flat[ragged(self.offsets[slot], counts)]
        bounds = np.zeros(len(begin) + 1, dtype=np.int64)
        np.cumsum(counts, out=bounds[1:])
        at = np.searchsorted(begin, np.concatenate(([0], ends)))
        return ids, bounds[at]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids. Blank-and-letters pieces go to the library many in one text."""
        words = [k for k, p in enumerate(pieces) if p[0] == " " and p[1:].isalpha()]
        lists: list = [None] * len(pieces)
        groups = [words[k : k + WORDS_AT_ONCE] for k in range(0, len(words), WORDS_AT_ONCE)]
        for group, found in zip(groups, self.library.encode_batch(["".join([pieces[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids, owner = found.ids, np.asarray(found.word_ids)
            cuts = np.flatnonzero(np.diff(owner, prepend=-1)).tolist() + [len(ids)]
            if len(cuts) == len(group) + 1:  # else the library cuts one of them further, and they go one by one
                for k, a, b in zip(group, cuts, cuts[1:], strict=False):
                    lists[k] = ids[a:b]
        rest = [k for k, ids in enumerate(lists) if ids is None]
        for k, found in zip(rest, self.library.encode_batch([pieces[k] for k in rest], add_special_tokens=False), strict=True):
            lists[k] = found.ids
        counts = np.fromiter(map(len, lists), dtype=np.int32, count=len(lists))
        return counts, np.fromiter(chain.from_iterable(lists), dtype=self.dtype, count=int(counts.sum()))

    def _slots(self, distinct, where, begin, stop, joined) -> np.ndarray:
        """The table's rows of the distinct pieces, after those not met before have been encoded."""
        if len(self.keys) + len(distinct) > CACHE_PIECES:
            self._empty()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            pieces = [joined[a:b] for a, b in zip(begin[where[new]].tolist(), stop[where[new]].tolist(), strict=True)]
            counts, ids = self._encode_pieces(pieces)
            offsets = len(self.flat) + np.cumsum(counts, dtype=np.int64) - counts
            self.flat = np.concatenate([self.flat, ids])
            self.keys, self.offsets, self.counts = (np.insert(a, at[new], b) for a, b in ((self.keys, distinct[new]), (self.offsets, offsets), (self.counts, counts)))
            at = np.searchsorted(self.keys, distinct)
        return at


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a vocabulary file; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
