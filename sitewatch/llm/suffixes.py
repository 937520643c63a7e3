"""Sparse suffixes of byte strings, as columns of numbers.

Two equal 50-byte strings hold the same smallest 12-byte gram at the same place,
so it is enough to sort the suffixes that start at such grams. A suffix is
ordered by its tokens: first the gram it starts with, then its whole
surroundings, 38 bytes to the left (as far as a 50-byte string around the gram
can reach) and 50 to the right. Tokens are 64-bit hashes; any order of tokens
sorts equal beginnings next to each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

LENGTH = 50
GRAM = 12
REACH = LENGTH - GRAM
#: Bytes of a long text handled at a time, and of texts gathered for one step.
SEGMENT = 1 << 20
STEP = 2 << 20
MARGIN = REACH + LENGTH

HALF = REACH // 2


def covering(start: int, stop: int) -> list[int]:
    """Offsets of grams that together cover [start, stop)."""
    return [*range(start, stop - GRAM, GRAM), stop - GRAM]


AROUND = covering(-REACH, 0) + covering(0, LENGTH)
BEFORE, AFTER = covering(-HALF, GRAM), covering(0, GRAM + HALF)

_RANDOM = np.random.default_rng(20240611)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(int(_BASE), 1 << k, 1 << 64)) for k in range(GRAM.bit_length() - 1)]
_ODD = _RANDOM.integers(1, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MOST = np.uint64((1 << 64) - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """One hash for each of the len(data) - GRAM + 1 grams.

    Widths double up to the largest power of two in GRAM; two overlapping runs
    of that width make up the rest.
    """
    h, width = _BYTES[data], 1
    for base in _POWERS:
        h = h[:-width] * base + h[width:]
        width *= 2
    rest = GRAM - width
    return mixed(h[:-rest] * _BASE + h[rest:] if rest else h)


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """best() over every run of ``width`` neighbours."""
    done = 1
    out = a
    while 2 * done <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return best(out[:-rest], out[rest:]) if rest else out


class Piece(NamedTuple):
    """A stretch of a text with margins, of which places [low, high) count."""

    owner: int
    start: int
    data: bytes
    low: int
    high: int


def pieces(texts: list[bytes]) -> Iterator[list[Piece]]:
    """Stretches of all texts, gathered into steps of about ``STEP`` bytes."""
    held, size = [], 0
    for owner, text in enumerate(texts):
        for begin in range(0, max(len(text), 1), SEGMENT):
            start = max(0, begin - MARGIN)
            data = text[start : begin + SEGMENT + MARGIN]
            if len(data) < LENGTH:
                continue
            held.append(Piece(owner, start, data, begin - start, begin - start + SEGMENT))
            size += len(data)
            if size >= STEP:
                yield held
                held, size = [], 0
    if held:
        yield held


class Stream:
    """Pieces laid end to end, with the bounds of each."""

    def __init__(self, held: list[Piece]):
        self.pieces = held
        lengths = np.array([len(p.data) for p in held])
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.data = np.frombuffer(b"".join(p.data for p in held), dtype=np.uint8)
        self.grams = gram_hashes(self.data)

    def owner_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def combined(self, places: np.ndarray, offsets: list[int], left, right, seed: int) -> np.ndarray:
        """Hash of the bytes [place - left, place + right), by grams at offsets.

        Offsets beyond the bounds are moved onto them.
        """
        h = np.full(len(places), seed, dtype=np.uint64)
        for k, offset in enumerate(offsets):
            at = places + np.clip(offset, -left, right - GRAM)
            h += self.grams[at] * _ODD[(k + seed) % len(_ODD)]
            h ^= h >> np.uint64(29)
            h *= _ODD[(k + 7 * seed + 11) % len(_ODD)]
        return mixed(h)


class Suffixes(NamedTuple):
    """Columns: piece and place in it, tokens, and two halves of the surroundings.

    A 50-byte string around the gram holds the half before or the half after it;
    where a half does not exist it is 0.
    """

    owner: np.ndarray
    place: np.ndarray
    one: np.ndarray
    two: np.ndarray
    before: np.ndarray
    after: np.ndarray


def anchors(stream: Stream) -> Suffixes:
    """The sparse suffixes of all pieces, in order."""
    grams = stream.grams.copy()
    n = len(grams)
    for end in stream.ends[:-1]:
        grams[max(0, end - GRAM + 1) : end] = _MOST
    lowest = _sliding(grams, REACH + 1, np.minimum)
    for end in stream.ends[:-1]:
        lowest[max(0, end - LENGTH + 1) : end] = 0
    padded = np.zeros(n + REACH, dtype=np.uint64)
    padded[REACH : REACH + len(lowest)] = lowest
    chosen = np.flatnonzero(_sliding(padded, REACH + 1, np.maximum)[:n] == grams)
    chosen = chosen[grams[chosen] != _MOST]
    owner = stream.owner_of(chosen)
    local = chosen - stream.starts[owner]
    low = np.array([p.low for p in stream.pieces])[owner]
    high = np.array([p.high for p in stream.pieces])[owner]
    keep = (local >= low) & (local < high)
    chosen, owner, local = chosen[keep], owner[keep], local[keep]
    left = np.minimum(local, REACH)
    right = np.minimum(stream.ends[owner] - chosen, LENGTH)
    one = mixed(grams[chosen] * _ODD[0])
    two = stream.combined(chosen, AROUND, left, right, 1)
    two = mixed(two + left.astype(np.uint64) * _ODD[1] + right.astype(np.uint64) * _ODD[2])
    before = np.where(left >= HALF, stream.combined(chosen, BEFORE, left, right, 4), 0)
    after = np.where(right >= GRAM + HALF, stream.combined(chosen, AFTER, left, right, 5), 0)
    return Suffixes(owner, local, one, two, before, after)


def window_tokens(stream: Stream, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tokens that stand for the whole 50-byte string at each place."""
    offsets = covering(0, LENGTH)
    return (
        stream.combined(places, offsets, 0, LENGTH, 2),
        stream.combined(places, offsets, 0, LENGTH, 3),
    )
