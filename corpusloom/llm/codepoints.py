"""Vectorised reading of texts: code points of many texts at once, hashed trigrams and counts by text."""

from __future__ import annotations

import numpy as np

SPACE = 32
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point, whether it is a letter; made once in each worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts, a space before and after each, and where each begins and the last ends."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return points, np.concatenate([[0], np.cumsum(sizes)])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of the values between neighbouring bounds (each part has one value at least)."""
    return np.add.reduceat(values, bounds[:-1], axis=0) if len(bounds) > 1 else values[:0]


def trigrams(points: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed letter trigrams: the number of the text of each, its hash, and how many letters each text has.

    Anything that is no letter is a blank, and a trigram has a letter in its middle.
    """
    is_letter = letters()[points]
    c = np.where(is_letter, points, 0).astype(np.uint32)
    middle = np.flatnonzero(is_letter[1:-1]) + 1
    h = c[middle - 1] * np.uint32(0x9E3779B1) ^ c[middle] * np.uint32(0x85EBCA77) ^ c[middle + 1] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    owner = np.searchsorted(bounds, middle, side="right") - 1
    return owner, (h >> np.uint32(32 - bits)).astype(np.int64), np.bincount(owner, minlength=len(bounds) - 1)


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def marks(points: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit mark of each character and its place in the word that begins at the start before it."""
    begins = np.zeros(len(points), np.int64)
    begins[start] = np.diff(np.concatenate([[0], start]))
    place = (np.arange(len(points)) - np.cumsum(begins)).astype(np.uint64)
    return mix(points.astype(np.uint64) + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def word_keys(points: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word (a run without blanks) begins, and its 64-bit hash."""
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(start):
        return start, np.zeros(0, np.uint64)
    return start, mix(np.add.reduceat(np.where(blank, np.uint64(0), marks(points, start)), start))
