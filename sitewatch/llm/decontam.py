"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit verification.

The CGK walk reads a text with a pointer that stays or moves on by random bits
chosen for (step, character). Two texts walked with the same bits tend to fall
into step again after an edit, so their edit distance shows as Hamming distance
between the characters read. A key samples some of the steps; a stretch with few
edits gives an equal key with a known chance, and keys are drawn again, with
other bits, from every word of an item. Walks read short stretches, so they are
seeds: the item-sized window appears in the verification. How long the walks are,
how many are drawn, and whether two keys must meet at places that agree or one will
do, depends on the item: of ``RUNGS``, an item takes the first
on which edited copies of items with as many words, ``MOST_EDITS`` of their
characters changed at random, meet keys enough with the chance ``RECALL``. That is tried
out when the index is built; the last rung is taken by what meets it on none.
A walk is first read as far as its ``EARLY``-th sampled step; only where the key so far
begins a key of some item is it read on, which loses none.

A key that meets fixes an item-sized window: the item's length from where the
item then begins, and a slack to both sides. The item is cut into parts of up to 64
characters; where the distances of the parts to the nearest stretches around their
places add up to more than ``MOST_EDITS`` allows, no stretch of the window can be
near enough, and the window is left out, which loses none. The rest is compared
exactly, by the edit distance between the item and the best stretch of the window;
a document is contaminated if that is at most a fifth of the item.

The benchmark is indexed in blocks of bounded size, each sent to all tasks; all
documents are read once per block and never shuffled. Case of A-Z and kinds of
white space do not count.

Defined cases: a NULL or empty text has no hits; an item with a NULL text, or of blanks
only, is not searched; an item of fewer than ``SHORTEST`` bytes is too short to be told
after edits and is searched verbatim, between the edges of words, in a column of its
own, ``short_hits``: a word or two is no evidence against a document. Equal items are
reported each; repeated rows are searched alike; empty tables give no hits; other
columns pass through, those named ``hits`` and ``short_hits`` are replaced. An item
with a NULL id is reported as NULL.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm.common import add_columns, table
from sitewatch.session import at_scope_end, result_only

SHORTEST = 40
#: Share of an item's characters that may differ.
MOST_EDITS = 0.2
#: Least chance that an item with so many edits at random places meets a key.
RECALL = 0.99
#: (steps of a walk, steps that a key samples, walks, whether they start at all characters but blanks,
#: keys that must meet).
RUNGS = (
    (24, 16, 3, False, 2),
    (16, 12, 3, False, 2),
    (24, 16, 3, False, 1),
    (16, 12, 6, False, 2),
    (16, 12, 3, False, 1),
    (16, 12, 6, False, 1),
    (12, 9, 5, False, 1),
    (12, 9, 5, True, 1),
)
#: Edited copies that a rung is tried on; it may miss half of what ``RECALL`` allows.
TRIED = 600
#: From this byte of a word on, walks start at every character.
LONG_WORD = 24
STEPS = max(rung[0] for rung in RUNGS)
#: Sampled steps after which a walk goes on only if an item's key begins alike.
EARLY = 9
#: Bytes of items in one index.
BLOCK_BYTES = 8 << 20
#: Word starts that are walked at a time.
TILE = 1 << 17
#: Places in a filter for each of its keys, and the most leading bits that tell them apart.
FILTER_SHARE, FILTER_BITS = 32, 22
#: Rows that are expanded at a time, and windows that are compared at a time.
MOST_ROWS, MOST_WINDOWS = 1 << 20, 1 << 12
#: Characters of a part of an item, one bit each.
PART = 64

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[9:14] = 32

HITS = "array<struct<item_id: long, start: int, end: int, distance: int>>"
HIT = pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())])


class Walk:
    """One choice of random bits, sampled steps and key weights."""

    def __init__(self, seed: int, steps: int, sampled: int):
        random = np.random.default_rng(90017 + seed)
        self.moves = random.integers(0, 2, (steps, 256)).astype(np.int64)
        self.sampled = sorted(random.choice(steps, sampled, replace=False).tolist())
        self.weights = random.integers(1, 1 << 63, (steps, 256), dtype=np.uint64)

        self.early = self.sampled[min(EARLY, sampled) - 1] + 1

    def _read(self, data: np.ndarray, at: np.ndarray, key: np.ndarray, steps: range) -> None:
        """Read on, in place; data goes on STEPS characters beyond all places."""
        # No place is outside; clipping spares the check.
        for step in steps:
            read = data.take(at, mode="clip")
            if step in self.sampled:
                key += self.weights[step].take(read, mode="clip")
            at += self.moves[step].take(read, mode="clip")

    def begun(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the walks from ``places`` are after the early steps, and their keys so far."""
        at, key = places.copy(), np.zeros(len(places), dtype=np.uint64)
        self._read(data, at, key, range(self.early))
        return at, key

    def ended(self, data: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of walks that were begun, and their ends."""
        at, key = at.copy(), key.copy()
        self._read(data, at, key, range(self.early, self.sampled[-1] + 1))
        key ^= key >> np.uint64(33)
        key *= np.uint64(0xFF51AFD7ED558CCD)
        return key ^ (key >> np.uint64(33)), at

    def keys(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the walks that begin at ``places``, and their ends."""
        return self.ended(data, *self.begun(data, places))



def _walks() -> list[list[Walk]]:
    """The walks of each rung; rungs of one length share theirs."""
    return [[Walk(100 * steps + n, steps, sampled) for n in range(walks)] for steps, sampled, walks, *_ in RUNGS]


WALKS = _walks()


def plain(text: str) -> np.ndarray:
    """One byte for every character."""
    return symbols(_PLAIN[np.frombuffer(text.encode(), dtype=np.uint8)])[0]


def symbols(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte for every character of UTF-8, hashed beyond ASCII, and the bytes they begin at."""
    starts = np.flatnonzero(data & 0xC0 != 0x80)
    out = data[starts]
    wide = np.flatnonzero(out >= 0xC0)
    if len(wide):
        value, more = out[wide], np.ones(len(wide), dtype=bool)
        for k in (1, 2, 3):
            following = data[np.minimum(starts[wide] + k, len(data) - 1)]
            more &= (following & 0xC0 == 0x80) & (starts[wide] + k < len(data))
            value = np.where(more, value * np.uint8(31) + following, value)
        out[wide] = value | 0x80
    return out, starts


def runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... ``sizes[0]`` of them, then those of first[1] and so on."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def walk_starts(data: np.ndarray, every: bool = False, edges: np.ndarray | None = None) -> np.ndarray:
    """Where walks begin: at words, in long words also at later characters, or at all but blanks.

    ``edges`` are places where a text begins, so that a word does not go on over them.
    """
    if every:
        return np.flatnonzero(data != 32)
    word = data != 32
    first = word.copy()
    first[1:] &= ~word[:-1]
    if edges is not None:
        first[edges] = word[edges]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    sizes = np.flatnonzero(last) + 1 - starts
    long = sizes > LONG_WORD
    if not long.any():
        return starts
    inner = runs(starts[long] + LONG_WORD, sizes[long] - LONG_WORD)
    return np.sort(np.concatenate([starts, inner]))


def padded(datas: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other with blanks that walks can run over, and where each begins."""
    blanks = np.full(STEPS + 1, 32, np.uint8)
    begins = np.cumsum([0] + [len(d) + len(blanks) for d in datas])[:-1]
    return np.concatenate([part for d in datas for part in (d, blanks)]), begins


def _filter(keys: np.ndarray) -> np.ndarray:
    """A bit for every value of the leading bits, set where a key has it; as many as the keys ask for."""
    bits = min(FILTER_BITS, (FILTER_SHARE * len(keys)).bit_length())
    out = np.zeros(1 << bits, dtype=bool)
    out[_leading(keys, out)] = True
    return out


def _leading(keys: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """The places of keys in a filter."""
    # By way of 63 bits, as a filter of one place leaves none.
    return ((keys >> np.uint64(1)) >> np.uint64(64 - len(filter_).bit_length())).view(np.int64)


def _may_have(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter leaves each key possible."""
    return filter_.take(_leading(keys, filter_), mode="clip")


def item_keys(walk: Walk, datas: list[np.ndarray], every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place of the text, offset, early key) of the walks that stay inside the texts."""
    data, begins = padded(datas)
    starts = walk_starts(data, every)
    owner = np.searchsorted(begins, starts, side="right") - 1
    sizes = np.array([len(d) for d in datas])
    at, early = walk.begun(data, starts)
    key, end = walk.ended(data, at, early)
    inside = end <= begins[owner] + sizes[owner]
    return key[inside], owner[inside], (starts - begins[owner])[inside], early[inside]


def edited(text: str, edits: int, random: np.random.Generator) -> str:
    """``text`` after ``edits`` changes of characters at random places."""
    chars = list(text)
    letters = [*text, *"abcdefghijklmnopqrstuvwxyz "]
    for kind, place, letter in zip(random.integers(0, 3, edits), random.random(edits), random.integers(0, len(letters), edits)):
        at = int(place * len(chars))
        chars[at : at + (kind != 1)] = [] if kind == 2 else [letters[letter]]
    return "".join(chars)


def slack_of(sizes: np.ndarray) -> np.ndarray:
    """Characters to both sides of where an item begins, by a key, in which it may begin."""
    return (sizes * MOST_EDITS).astype(np.int64) + 8


def agreeing(group: np.ndarray, place: np.ndarray, step: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, place rounded down to ``step``, keys that agree) of matches.

    Matches are of an item with a text (``group``), by one of its keys, which has it begin
    at ``place``; those less than a step apart agree. Each key counts once a place.
    """
    place = place - place % step
    order = np.lexsort((key, place, group))
    group, place, step, key = group[order], place[order], step[order], key[order]
    new = np.ones(len(group), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (place[1:] != place[:-1]) | (key[1:] != key[:-1])
    group, place, step = group[new], place[new], step[new]
    first = np.ones(len(group), dtype=bool)
    first[1:] = (group[1:] != group[:-1]) | (place[1:] != place[:-1])
    begins = np.flatnonzero(first)
    counts = np.diff(np.append(begins, len(group)))
    group, place, step = group[begins], place[begins], step[begins]
    # Neighbouring places are neighbours here, too.
    beside = (group[1:] == group[:-1]) & (place[1:] - place[:-1] == step[:-1])
    total = counts.copy()
    total[1:][beside] += counts[:-1][beside]
    total[:-1][beside] += counts[1:][beside]
    return group, place, total


def recall(texts: list[str], rung: int, edits: float, copies: int = TRIED) -> float:
    """Share of edited copies of ``texts`` that meet keys enough of their text on a rung."""
    random = np.random.default_rng(7)
    whose = np.arange(copies) % len(texts)
    tried = [plain(edited(texts[k], int(len(texts[k]) * edits), random)) for k in whose]
    data, begins = padded(tried)
    _, _, _, every, needed = RUNGS[rung]
    starts = walk_starts(data, every)
    owner = np.searchsorted(begins, starts, side="right") - 1
    mixer = np.uint64(0x9E3779B97F4A7C15)
    datas = [plain(t) for t in texts]
    slack = slack_of(np.array([len(d) for d in datas], dtype=np.int64))
    found: list[list[np.ndarray]] = [[], [], []]
    for number, walk in enumerate(WALKS[rung]):
        key, item, offset, _ = item_keys(walk, datas, every)
        key = key ^ item.astype(np.uint64) * mixer
        order = np.argsort(key, kind="stable")
        key, offset = key[order], offset[order]
        own = walk.keys(data, starts)[0] ^ whose[owner].astype(np.uint64) * mixer
        low = np.searchsorted(key, own, side="left")
        times = np.searchsorted(key, own, side="right") - low
        at = offset[runs(low, times)]
        copy, start = np.repeat(owner, times), np.repeat(starts, times)
        for column, values in zip(found, (copy, start - begins[copy] - at, at * len(WALKS[rung]) + number)):
            column.append(values)
    copy, place, key = (np.concatenate(c) for c in found)
    # Places may lie before the text; what counts is how far they are apart.
    far = int(slack.max()) + max(map(len, datas))
    group, _, total = agreeing(copy, place + far, slack[whose[copy]] // 2 + 1, key)
    met = np.zeros(copies, dtype=bool)
    met[group[total >= needed]] = True
    return float(met.mean())


def rungs_of(texts: list[str]) -> np.ndarray:
    """The rung of each text: the first that reaches the recall with texts of as many walk starts."""
    classes: dict[int, list[int]] = {}
    for k, text in enumerate(texts):
        classes.setdefault(int(4 * math.log2(max(1, len(walk_starts(plain(text)))))), []).append(k)
    out = np.zeros(len(texts), dtype=np.int64)
    for members in classes.values():
        some = [texts[k] for k in members[:: max(1, len(members) // 50)]]
        for rung in range(len(RUNGS)):
            out[members] = rung
            if recall(some, rung, MOST_EDITS) >= 1 - (1 - RECALL) / 2:
                break
    return out


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of some columns, each once."""
    order = np.lexsort(columns)
    columns = tuple(c[order] for c in columns)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return tuple(c[new] for c in columns)


class Verbatim:
    """Short items, found as they are between the edges of words."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids: dict[str, list[int | None]] = {}
        for i, text in items:
            one = " ".join(_flat(text).split())
            if one:
                self.ids.setdefault(one, []).append(i)
        self.machine = None
        if self.ids:
            self.machine = ahocorasick.Automaton()
            for one in self.ids:
                self.machine.add_word(one, one)
            self.machine.make_automaton()

    def found(self, text: str) -> list[int | None]:
        """The items in a text, in order, each once; white space is one blank."""
        if self.machine is None or not text:
            return []
        flat = " ".join(_flat(text).split())
        here = set()
        for last, one in self.machine.iter(flat):
            first = last + 1 - len(one)
            before, after = flat[first - 1 : first] if first else "", flat[last + 1 : last + 2]
            if not (_joins(before) and _joins(one[0])) and not (_joins(after) and _joins(one[-1])):
                here.add(one)
        ids = [i for one in here for i in self.ids[one]]
        return sorted(ids, key=lambda i: (i is None, i or 0))


def _flat(text: str) -> str:
    return _PLAIN[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes().decode()


def _joins(character: str) -> bool:
    return character.isalnum() or character == "_"


class Index:
    """Keys of the words of some items."""

    def __init__(self, items: list[tuple[int, str]]):
        known = [(i, t) for i, t in items if t is not None and len(t.encode()) >= SHORTEST]
        self.short = Verbatim([(i, t) for i, t in items if t is not None and len(t.encode()) < SHORTEST])
        self.ids = [i for i, _ in known]
        self.texts = [_flat(t) for _, t in known]
        datas = [plain(t) for t in self.texts]
        self.data, self.begins = padded(datas) if known else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
        self.sizes = np.array([len(d) for d in datas], dtype=np.int64)
        self.most = (self.sizes * MOST_EDITS).astype(np.int64)
        self.slack = slack_of(self.sizes)
        rung_of = rungs_of(self.texts)
        self.needed = np.array([RUNGS[r][4] for r in rung_of], dtype=np.int64)
        self.tables = []
        # A walk is read once for all rungs that share it.
        sharing: dict[tuple[int, bool, int], list[int]] = {}
        for rung, (steps, _, walks, every, _) in enumerate(RUNGS):
            for n in range(walks):
                sharing.setdefault((steps, every, n), []).append(rung)
        for (_, every, n), alike in sharing.items():
            members = np.flatnonzero(np.isin(rung_of, alike))
            if len(members):
                walk = WALKS[alike[0]][n]
                key, owner, offset, early = item_keys(walk, [datas[k] for k in members], every)
                order = np.argsort(key, kind="stable")
                filters = _filter(early), _filter(key)
                self.tables.append((walk, every, *filters, key[order], members[owner[order]], offset[order]))

    def meets(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (document, item, place near an item's first character) that keys enough of the documents point to.

        The places are rounded down by at most half the slack, which windows allow for.
        """
        edges = bounds[:-1][np.diff(bounds) > 0]
        places: dict[bool, np.ndarray] = {}
        low_edge = int(self.sizes.max())
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for number_of, (walk, every, begins_alike, near, key, item, offset) in enumerate(self.tables):
            if every not in places:
                places[every] = walk_starts(data, every, edges)
            for begin in range(0, len(places[every]), TILE):
                at = places[every][begin : begin + TILE]
                reached, early = walk.begun(data, at)
                maybe = np.flatnonzero(_may_have(begins_alike, early))
                keys, _ = walk.ended(data, reached[maybe], early[maybe])
                met = _may_have(near, keys)
                maybe, keys = maybe[met], keys[met]
                low = np.searchsorted(key, keys, side="left")
                number = np.searchsorted(key, keys, side="right") - low
                at, low, number = at[maybe[number > 0]], low[number > 0], number[number > 0]
                for a, b in pieces(number):
                    rows = runs(low[a:b], number[a:b])
                    owner = np.repeat(np.searchsorted(bounds, at[a:b], side="right") - 1, number[a:b])
                    first = np.repeat(at[a:b], number[a:b]) - offset[rows] + low_edge
                    which = item[rows]
                    first -= first % (self.slack[which] // 2 + 1)
                    # Where one key will do, keys need not be told apart.
                    which_key = np.where(self.needed[which] > 1, offset[rows] * len(self.tables) + number_of, 0)
                    out.append((owner * len(self.ids) + which, first, which_key))
                    held += len(first)
                    if held > 2 * MOST_ROWS:
                        out = [_distinct(*(np.concatenate(c) for c in zip(*out)))]
                        held = 2 * len(out[0][0])
        if not out:
            return np.zeros((0, 3), dtype=np.int64)
        whose, first, which_key = (np.concatenate(c) for c in zip(*out))
        step = self.slack[whose % len(self.ids)] // 2 + 1
        whose, first, total = agreeing(whose, first, step, which_key)
        ok = total >= self.needed[whose % len(self.ids)]
        return np.column_stack([whose // len(self.ids), whose % len(self.ids), first - low_edge])[ok]

    def near_enough(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which rows have a window where the parts of the item are near enough in all."""
        out = np.zeros(len(rows), dtype=bool)
        if not len(rows):
            return out
        # Windows reach over both ends of the data.
        blank = np.zeros(int(self.sizes.max() + 3 * self.slack.max()) + 3, dtype=np.uint8)
        data = np.concatenate([blank, data, blank])
        rows = rows + np.array([0, 0, len(blank)])
        order = np.argsort(self.sizes[rows[:, 1]], kind="stable")
        for a in range(0, len(rows), MOST_WINDOWS):
            left = order[a : a + MOST_WINDOWS]
            parts = -(-self.sizes[rows[left, 1]] // PART)
            edits = np.zeros(len(left), dtype=np.int64)
            for k in range(int(parts.max())):
                more = k < parts
                edits[more] += self.part_edits(data, rows[left[more]], k, parts[more])
                keep = edits <= self.most[rows[left, 1]]
                left, parts, edits = left[keep], parts[keep], edits[keep]
                if not len(left):
                    break
            out[left] = True
        return out

    def part_edits(self, data: np.ndarray, rows: np.ndarray, part: int, parts: np.ndarray) -> np.ndarray:
        """Edit distances of a part of the rows' items to the nearest stretches around its place."""
        if not len(rows):
            return np.zeros(0, dtype=np.int64)
        sizes, slack = self.sizes[rows[:, 1]], self.slack[rows[:, 1]]
        begin = sizes * part // parts
        size = sizes * (part + 1) // parts - begin
        items, first, which = np.unique(rows[:, 1], return_index=True, return_inverse=True)
        equal = np.zeros((len(items), 256), dtype=np.uint64)
        for k in range(PART):
            has = np.flatnonzero(k < size[first])
            equal[has, self.data[self.begins[items[has]] + begin[first[has]] + k]] |= np.uint64(1 << k)
        equal, base = equal.ravel(), which.ravel() * 256
        low = rows[:, 2] + begin - slack
        columns = size + 2 * slack + slack // 2
        top, one = (size - 1).astype(np.uint64), np.uint64(1)
        at = low.copy()
        up, down = np.full(len(rows), ~np.uint64(0)), np.zeros(len(rows), dtype=np.uint64)
        score = size.copy()
        best = size.copy()
        for column in range(int(columns.max())):
            # Windows end inside the data.
            eq = equal.take(base + data.take(at, mode="clip"), mode="clip")
            # The longest window may end beyond the shorter ones, whose places then stay.
            at += column + 1 < columns
            across = eq | down
            level = (((eq & up) + up) ^ up) | eq
            plus = down | ~(level | up)
            minus = up & level
            score += ((plus >> top) & one).view(np.int64)
            score -= ((minus >> top) & one).view(np.int64)
            plus <<= one
            minus <<= one
            up = minus | ~(across | plus)
            down = plus & across
            np.minimum(best, score, out=best)
        return best


def pieces(sizes: np.ndarray):
    """Runs [a, b) whose sizes add up to about ``MOST_ROWS`` at most, or of one."""
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        before = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + MOST_ROWS, side="right")))
        yield a, b
        a = b


def best_stretch(item: str, window: str) -> tuple[int, int]:
    """(edit distance of the item to the nearest stretch of the window, its end).

    Bit-parallel dynamic programming over columns; the stretch may begin anywhere.
    """
    at = window.find(item)
    if at >= 0:
        return 0, at + len(item)
    size = len(item)
    whole, top = (1 << size) - 1, 1 << (size - 1)
    equal: dict[str, int] = {}
    for k, c in enumerate(item):
        equal[c] = equal.get(c, 0) | 1 << k
    up, down, score = whole, 0, size
    best, end = size, 0
    for k, c in enumerate(window):
        eq = equal.get(c, 0)
        across = eq | down
        level = (((eq & up) + up) ^ up) | eq
        plus = down | (~(level | up) & whole)
        minus = up & level
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & whole, (minus << 1) & whole
        up = minus | (~(across | plus) & whole)
        down = plus & across
        if score < best:
            best, end = score, k + 1
    return best, end


def _hits(index: Index, data: np.ndarray, starts: np.ndarray, begin: int, end: int, rows: np.ndarray) -> list[dict]:
    """Verified hits of a document, characters [begin, end), from rows (document, item, first character)."""
    found = []
    for item in np.unique(rows[:, 1]).tolist():
        size, slack = int(index.sizes[item]), int(index.slack[item])
        reached = last = -math.inf
        for first in np.unique(rows[rows[:, 1] == item, 2]).tolist():
            if first < reached - slack:
                continue
            low, high = max(begin, first - 2 * slack), min(end, first + size + 2 * slack)
            window = data[starts[low] : starts[high]].tobytes().decode("utf-8", "ignore") if low < high else ""
            distance, stop = best_stretch(index.texts[item], window)
            if distance <= index.most[item]:
                reached = first + size
                stop += low - begin
                if stop == last:
                    continue
                last = stop
                found.append({"item_id": index.ids[item], "start": max(low - begin, stop - size), "end": stop, "distance": distance})
    return found


def _free(name: str, docs: DataFrame) -> str:
    """A name that no column has."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def search(docs: DataFrame, items: list[tuple[int, str]], text: str = "text", more: bool = False) -> DataFrame:
    """Add ``hits`` of one block of items; ``more`` appends to those that are there."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(items))
    at_scope_end(shared.destroy)
    names = (_free("hits", docs), _free("short_hits", docs)) if more else ("hits", "short_hits")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        short = shared.value.short
        texts = batch.column(text).to_pylist() if short.machine else [""] * batch.num_rows
        verbatim = pa.array([short.found(t or "") for t in texts], type=pa.list_(pa.int64()))
        column = batch.column(text).cast(pa.large_binary()).fill_null(b"")
        out: list[list[dict]] = [[] for _ in range(len(column))]
        index = shared.value
        if index.ids and len(column):
            bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
            for first, last in _stretches(bounds):
                _search_stretch(index, raw, bounds[first : last + 1], out, first)
        return [pa.array(out, type=pa.list_(HIT)), verbatim]

    kinds = ((HITS, pa.list_(HIT)), ("array<long>", pa.list_(pa.int64())))
    found = add_columns(docs, dict(zip(names, kinds)), run)
    if not more:
        return found
    joined = {kept: F.concat(kept, added) for kept, added in zip(("hits", "short_hits"), names)}
    return found.withColumns(joined).drop(*names)


def _stretches(bounds: np.ndarray, size: int = 8 << 20):
    """Runs [first, last) of documents of about ``size`` bytes."""
    first = 0
    for k in range(1, len(bounds)):
        if bounds[k] - bounds[first] >= size or k == len(bounds) - 1:
            yield first, k
            first = k


def _search_stretch(index: Index, raw: np.ndarray, bounds: np.ndarray, out: list, first: int) -> None:
    begin, end = int(bounds[0]), int(bounds[-1])
    if end <= begin:
        return
    # Blanks at the end let walks run over it; the first byte of a text begins a word.
    data = np.concatenate([_PLAIN[raw[begin:end]], np.full(STEPS + 1, 32, np.uint8)])
    chars, starts = symbols(data)
    edges = np.searchsorted(starts, bounds - begin)
    rows = index.meets(chars, edges)
    rows = rows[index.near_enough(chars, rows)]
    for k in np.unique(rows[:, 0]).tolist():
        out[first + k] = _hits(index, data, starts, int(edges[k]), int(edges[k + 1]), rows[rows[:, 0] == k])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Add ``hits``: array of (item_id, start, end, distance), places in code points, and
    ``short_hits``: the ids of the short items that stand in the text."""
    size = benchmark.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = docs
    for k in range(blocks):
        rows = benchmark.filter(block == k).select("item_id", "text").collect()
        found = search(found, [(r["item_id"], r["text"]) for r in rows], text, more=k > 0)
    return found


@result_only
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"]))).alias("item_ids"),
        F.size("hits").cast("long").alias("n_hits"),
        F.array_min(F.transform("hits", lambda h: h["distance"])).alias("least_distance"),
        "short_hits",
    )
