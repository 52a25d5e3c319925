"""Words and character windows of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

from folioflow.llm.common import ragged

#: Code point -> 1 letter, 2 other word character, 3 anything else, 0 not met yet.
_KINDS = np.zeros(0x110000, dtype=np.uint8)
LETTER, DIGIT = 1, 2


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by one blank, and the text number of every code point."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    joined = " ".join(texts) + " "
    return np.frombuffer(joined.encode("utf-32-le"), dtype="<u4"), np.repeat(np.arange(len(texts)), sizes)


def kinds(points: np.ndarray) -> np.ndarray:
    """LETTER, DIGIT or 3 for every code point."""
    found = _KINDS[points]
    if not found.all():
        for point in np.unique(points[found == 0]).tolist():
            char = chr(point)
            _KINDS[point] = LETTER if char.isalpha() else DIGIT if char.isalnum() else 3
        found = _KINDS[points]
    return found


def place_hashes(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A 64-bit scramble of each code point together with its place in its run. Sums of them tell runs apart."""
    return mix64((points.astype(np.uint64) + np.uint64(1)) | (places.astype(np.uint64) << np.uint64(21)))


def run_sums(points: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the place hashes of all runs begin..stop, and where each run begins in them (one more at the end).

    Code points are scrambled together with their places before they are added, so a collision has no
    algebraic cause: words of any length collide with a probability near 2^-64 a pair.
    """
    length = stop - begin
    cuts = np.concatenate([[0], np.cumsum(length)])
    at = ragged(begin, length)
    sums = np.zeros(len(at) + 1, dtype=np.uint64)
    np.cumsum(place_hashes(points[at], at - np.repeat(begin, length)), out=sums[1:])
    return sums, cuts


def run_hashes(points: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs begin..stop."""
    sums, cuts = run_sums(points, begin, stop)
    return mix64(sums[cuts[1:]] - sums[cuts[:-1]] + mix64((stop - begin).astype(np.uint64)))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the maximal runs where ``inside`` holds, and the places after them. The last place must be outside."""
    edge = np.diff(inside.astype(np.int8), prepend=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(points: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and 64-bit hashes of the maximal runs where ``inside`` holds. The last code point must be outside."""
    begin, stop = runs(inside)
    return begin, run_hashes(points, begin, stop)
