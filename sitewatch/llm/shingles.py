"""Sets of word n-grams as sorted 64-bit numbers, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

WORDS = 5
#: Bytes of text gathered for one step.
STEP = 1 << 20

_RANDOM = np.random.default_rng(7130211)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(1 << 40, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A-Z in lower case, white space as a blank; and whether a byte is white space.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[9:14] = 32
_IS_SPACE = _PLAIN == 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class _Powers:
    """Powers of a number modulo 2**64, as many as were ever needed."""

    def __init__(self, base: int):
        self.base, self.held = np.uint64(base), np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.held):
            run = np.full(n, self.base, dtype=np.uint64)
            run[0] = 1
            self.held = np.multiply.accumulate(run)
        return self.held[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


class Sets(NamedTuple):
    """The n-gram sets of some texts: text k has grams[bounds[k]:bounds[k + 1]], sorted."""

    grams: np.ndarray
    bounds: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)


def gram_sets(texts: list[bytes], words: int = WORDS) -> Sets:
    """Distinct ``words``-grams; of fewer words the whole sequence; of none, none.

    Texts are laid end to end with white space made one blank. The hash of any
    stretch comes from running sums of byte values times powers of the base.
    """
    count = len(texts)
    data = _PLAIN[np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    blank = data == 32
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return Sets(np.zeros(0, np.uint64), np.zeros(count + 1, np.int64))
    owner = np.searchsorted(text_ends, starts, side="right")
    # Only one blank after each word stays.
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    place = np.cumsum(keep) - 1
    data = data[keep]
    starts = place[starts]
    ends = np.append(starts[1:] - 1, len(data) - int(data[-1] == 32))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _UP(len(data)), out=sums[1:])
    per_text = np.bincount(owner, minlength=count)
    text_first = np.cumsum(per_text) - per_text
    nth = np.arange(len(starts)) - text_first[owner]
    left = per_text[owner] - nth
    begin = np.flatnonzero((left >= words) | ((nth == 0) & (left > 0)))
    last = begin + np.minimum(words, per_text[owner[begin]]) - 1
    a, b = starts[begin], ends[last]
    grams = (sums[b] - sums[a]) * _DOWN(len(data))[a]
    grams = mixed(grams + (b - a).astype(np.uint64) * np.uint64(_BASE))
    whose = owner[begin]
    order = np.lexsort((grams, whose))
    grams, whose = grams[order], whose[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (whose[1:] != whose[:-1])
    grams, whose = grams[new], whose[new]
    bounds = np.zeros(count + 1, dtype=np.int64)
    np.cumsum(np.bincount(whose, minlength=count), out=bounds[1:])
    return Sets(grams, bounds)


def steps(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts) of about ``STEP`` bytes together."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= STEP:
            yield begin, texts[begin : k + 1]
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


# --- Blocks of a set ---

#: Sets of fewer grams are cut into single grams.
SMALLEST_BLOCKED = 64
BLOCKS_PER_SIZE = 0.7


def size_class(sizes: np.ndarray) -> np.ndarray:
    """floor(log2(size)), exact for sizes of 1 and more."""
    return np.frexp(sizes.astype(np.float64))[1].astype(np.int64) - 1


def most_different(size: np.ndarray, partner: np.ndarray) -> np.ndarray:
    """How many grams two sets of these sizes may differ by at a Jaccard of 0.8."""
    return (size + partner) // 9


class Keys(NamedTuple):
    """Block keys: the text, the key, the block's number of grams, the size class."""

    owner: np.ndarray
    key: np.ndarray
    grams: np.ndarray
    level: np.ndarray


def block_keys(sets: Sets) -> Keys:
    """One key for every non-empty block of every set, at the levels it meets others.

    Texts meet at the size class of the larger one; a set that may have a
    partner in the next class is cut for that one too.
    """
    sizes = sets.sizes()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own = size_class(np.maximum(sizes, 1))
    out = []
    for up in (0, 1):
        level = own + up
        meets = sizes >= 4
        if up:
            meets &= (5 * sizes) // 4 >= (1 << np.minimum(level, 62))
        chosen = np.flatnonzero(meets[owner])
        if not len(chosen):
            continue
        who, gram = owner[chosen], sets.grams[chosen]
        at = level[who]
        blocks = np.where(
            (1 << at) >= SMALLEST_BLOCKED, (BLOCKS_PER_SIZE * (1 << at)).astype(np.uint64), 0
        ).astype(np.uint64)
        spread = mixed(gram + np.uint64(0x1234567))
        block = np.where(blocks > 0, spread % np.maximum(blocks, np.uint64(1)), spread)
        order = np.lexsort((block, who))
        who, block, gram, at = who[order], block[order], gram[order], at[order]
        new = np.ones(len(who), dtype=bool)
        new[1:] = (who[1:] != who[:-1]) | (block[1:] != block[:-1])
        begins = np.flatnonzero(new)
        # A sum of mixed grams does not depend on their order.
        content = np.add.reduceat(mixed(gram * np.uint64(3) + np.uint64(1)), begins)
        number = np.diff(np.append(begins, len(who)))
        key = mixed(content + block[begins] * np.uint64(0x9E3779B97F4A7C15) + at[begins].astype(np.uint64))
        out.append(Keys(who[begins], key, number, at[begins]))
    if not out:
        return Keys(*(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64)))
    return Keys(*(np.concatenate(c) for c in zip(*out)))


def prefix_keys(sets: Sets, keys: Keys) -> np.ndarray:
    """Places of the keys that a set must show to meet every partner.

    Two sets that differ by at most d grams differ in at most d blocks, so in a
    common order of all keys their first d + 1 share one. The order is large
    blocks first, which few unlike texts share, then the key itself.
    """
    sizes = sets.sizes()
    size = sizes[keys.owner]
    order = np.lexsort((keys.key, -keys.grams, keys.level, keys.owner))
    who, at = keys.owner[order], keys.level[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (who[1:] != who[:-1]) | (at[1:] != at[:-1])
    begins = np.flatnonzero(new)
    nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    largest = np.minimum((5 * size) // 4, (2 << keys.level) - 1)
    return order[nth <= most_different(size, largest)[order]]


# --- Parity maps: a lower bound of the difference of two sets ---


def map_bits(size: int) -> int:
    """Bits of the parity map of a set: the power of two at or above its size, at least 64."""
    return max(64, 1 << max(size - 1, 0).bit_length())


def parity_map(grams: np.ndarray) -> bytes:
    """Bit k is the parity of the number of grams that fall on k.

    A gram in one of two sets only flips one bit, so two sets differ by at least
    as many grams as their maps differ in bits.
    """
    bits = map_bits(len(grams))
    counts = np.bincount(mixed(grams + np.uint64(77)) % np.uint64(bits), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(maps: np.ndarray, length: int) -> np.ndarray:
    """Maps (rows of bytes) brought down to ``length`` bytes by xor."""
    while maps.shape[1] > length:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps
