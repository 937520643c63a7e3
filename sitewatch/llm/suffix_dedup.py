"""Suffix-array dedup: remove bytes that a document shares with an earlier one.

Every byte that lies in a 50-byte string which also starts in a document of
smaller id is removed. Ways and means:

1. Sparse suffixes (see ``suffixes``) are cut into buckets by splitters: keys
   (token 1, token 2, id) sampled from whole documents. A key that many documents
   share takes part in several splitters and so spreads over several buckets.
2. A bucket sorts its suffixes by multikey quicksort: by the first token, and only
   runs of equal tokens by the next. Where a run goes on from a bucket before,
   the smallest id has been sent ahead by the task that read it, so buckets
   compare across their boundaries without waiting for each other.
3. Suffixes equal in both tokens share their whole surroundings: all but those
   of the smallest id are covered. Where surroundings agree on a half only, which
   happens at the ends of a shared passage, the smallest of each kind asks
   for its bytes, and a second sort compares its 50-byte strings one by one.
   For first tokens that fill buckets of their own, those strings are compared by a join.
4. Covered places meet their texts again, by parts of the rows.

Defined cases: a NULL text is empty; texts under 50 bytes lose nothing; strings
that repeat only inside one document stay; a NULL id counts as larger than all
others. Rows with equal ids, and all rows with a NULL id, are documents of their own,
none of them smaller than another: they lose nothing to each other, and each loses
what its own text shares with smaller ids. Such rows are told apart by a 64-bit hash of
the text, and rows that agree in id and text are sorted as one. An empty table gives
an empty table. Equal strings are found by hashes of 96 bits and more. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm import suffixes as S
from sitewatch.llm.common import bounded_batches, for_every_row, lean, slices, table, told_apart
from sitewatch.session import result_only, saved

#: Bytes of text per bucket of suffixes and per part of documents.
BUCKET_BYTES, PART_BYTES = 12 << 20, 12 << 20
LEAST_BUCKETS = 24
#: Bytes of whole documents that the splitters are sampled from, and keys kept.
SAMPLE_BYTES, SAMPLE_KEYS = 8 << 20, 200_000
#: Suffixes that a task holds before it hands them on.
HELD = 700_000
#: Bytes kept of each token and half.
ONE, TWO, SIDE = 5, 7, 3
NO_ID = np.iinfo(np.int64).max
COVERED, ASKED, HOT = 1, 2, 3


# --- Packing columns of numbers ---


def _cut(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _uncut(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _low(values: np.ndarray, width: int) -> np.ndarray:
    return values & np.uint64((1 << (8 * width)) - 1)


def _side(values: np.ndarray) -> np.ndarray:
    """Low bytes of halves; 0 is kept for no half, so a real half that is cut to it becomes 1."""
    low = _low(values, SIDE)
    return np.where((values != 0) & (low == 0), np.uint64(1), low)


def _steps(values: np.ndarray) -> bytes:
    """Differences, byte plane by byte plane, compressed."""
    steps = np.diff(values.astype("<i8"), prepend=np.int64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unsteps(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.cumsum(planes.reshape(8, -1).T.copy().view("<i8").ravel())


def _pack_places(doc: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return _steps(doc), _steps(row), _steps(place)


# --- Splitters ---


class Splitters:
    """Sorted keys (token 1, token 2, id); bucket b holds keys from the b-th on."""

    def __init__(self, keys: np.ndarray):
        self.one, self.two, self.doc = keys[:, 0].copy(), keys[:, 1].copy(), keys[:, 2].astype(np.int64)
        shared, times = np.unique(self.one, return_counts=True)
        self.shared = shared
        self.hot = shared[times > 1]
        classes: dict[tuple[int, int], list[int]] = {}
        for k, key in enumerate(zip(self.one.tolist(), self.two.tolist())):
            classes.setdefault(key, []).append(k)
        #: token pairs that a boundary runs through, and the buckets they go on in
        self.onward = {key: range(ks[0] + 1, ks[-1] + 2) for key, ks in classes.items()}

    def bucket_of(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.one, one, side="left")
        high = np.searchsorted(self.one, one, side="right")
        out = low.copy()
        tied = np.flatnonzero(low < high)
        k = 0
        while len(tied):
            at = low[tied] + k
            tied, at = tied[at < high[tied]], at[at < high[tied]]
            behind = (self.two[at] < two[tied]) | ((self.two[at] == two[tied]) & (self.doc[at] <= doc[tied]))
            out[tied] += behind
            k += 1
        return out


def _documents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, batch.column(2).to_numpy(), [t.encode() if t else b"" for t in batch.column(1).to_pylist()]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns (one, two, before, after, id, row, place) of all suffixes, step by step."""
    for batch in slices(batches):
        ids, rows, texts = _documents(batch)
        for held in S.pieces(texts):
            found = S.anchors(S.Stream(held))
            owner = np.array([p.owner for p in held])[found.owner]
            start = np.array([p.start for p in held])[found.owner]
            yield (
                _low(found.one, ONE),
                _low(found.two, TWO),
                _side(found.before),
                _side(found.after),
                ids[owner],
                rows[owner],
                found.place + start,
            )


def sample_splitters(docs: DataFrame, total: int, buckets: int) -> Splitters:
    """Quantiles of the keys of a sample of whole documents, of bounded size."""
    share = min(1.0, SAMPLE_BYTES / max(total, 1))
    # Rows that agree in id and text come as one, so no heap of them is drawn whole.
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.lit(math.ceil(share * 1e6)))
    thin = max(1, math.ceil(share * total / 20 / SAMPLE_KEYS))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two, _, _, doc, _, _ in _suffixes(batches):
            chosen = slice(None, None, thin)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one[chosen].astype(np.int64)), pa.array(two[chosen].astype(np.int64)), pa.array(doc[chosen])],
                names=["one", "two", "doc"],
            )

    got = drawn.mapInArrow(keys, "one long, two long, doc long").toArrow()
    columns = [got.column(k).to_numpy() for k in range(3)]
    order = np.lexsort(columns[::-1])
    n = len(order)
    cuts = order[[n * b // buckets for b in range(1, buckets)]] if n >= buckets else order[:0]
    return Splitters(np.column_stack([c[cuts].astype(np.uint64) for c in columns]).reshape(-1, 3))


# --- First sort: suffixes ---

SUFFIX_ROWS = (
    "bucket int, ahead boolean, one binary, two binary, before binary, after binary, "
    "docs binary, rows binary, places binary"
)
PLACE_ROWS = "part int, kind int, docs binary, rows binary, places binary"


def _suffix_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_()] + [pa.binary()] * 7
    names = ["bucket", "ahead", "one", "two", "before", "after", "docs", "rows", "places"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _runs(*sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its run, number of its run) for sorted columns."""
    first = np.ones(len(sorted_keys[0]), dtype=bool)
    if len(first):
        first[1:] = False
        for key in sorted_keys:
            first[1:] |= key[1:] != key[:-1]
    return first, np.cumsum(first) - 1


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """Order by the first key; runs of equals, and only those, by the next keys."""
    order = np.argsort(keys[0], kind="quicksort")
    if len(keys) == 1 or not len(order):
        return order
    _, run = _runs(keys[0][order])
    tied = np.flatnonzero(np.bincount(run)[run] > 1)
    inner = order[tied]
    again = multikey_order(*(k[inner] for k in keys[1:]))
    again = again[np.argsort(run[tied][again], kind="stable")]
    order[tied] = inner[again]
    return order


def _part_of(doc: np.ndarray, row: np.ndarray, parts: int) -> np.ndarray:
    one = doc ^ row
    return (one ^ (one >> 17)) % parts


def part_column(doc: Column, row: Column, parts: int) -> Column:
    one = F.coalesce(doc, F.lit(int(NO_ID))).bitwiseXOR(row)
    return F.pmod(one.bitwiseXOR(F.shiftright(one, 17)), F.lit(parts)).cast("int")


def _place_rows(doc, row, place, kind: np.ndarray, parts: int) -> Iterator[tuple]:
    part = _part_of(doc, row, parts)
    order = np.lexsort((place, row, doc, kind, part))
    first, _ = _runs(part[order], kind[order])
    for rows in np.split(order, np.flatnonzero(first)[1:]):
        if len(rows):
            yield (int(part[rows[0]]), int(kind[rows[0]]), *_pack_places(doc[rows], row[rows], place[rows]))


def _place_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 3
    columns = list(zip(*rows)) or [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "kind", "docs", "rows", "places"])


def _half_shared(half: np.ndarray, one: np.ndarray, surroundings: np.ndarray) -> np.ndarray:
    """Whether the first token and a half occur in two surroundings or more."""
    order = multikey_order(one, half, surroundings)
    _, run = _runs(one[order], half[order])
    kinds, _ = _runs(one[order], half[order], surroundings[order])
    out = np.zeros(len(order), dtype=bool)
    out[order] = np.bincount(run, weights=kinds)[run] > 1
    return out & (half != 0)


def first_sort(docs: DataFrame, splitters: Splitters, parts: int) -> DataFrame:
    """Rows (part, kind, docs, rows, places): covered suffixes and those that ask."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            one, two, before, after, doc, row, place = (np.concatenate(c) for c in zip(*held))
            bucket = splitters.bucket_of(one, two, doc)
            order = np.argsort(bucket, kind="stable")
            first, _ = _runs(bucket[order])
            for rows in np.split(order, np.flatnonzero(first)[1:]):
                yield _suffix_batch(
                    [
                        (
                            int(bucket[rows[0]]),
                            False,
                            _cut(one[rows], ONE),
                            _cut(two[rows], TWO),
                            _cut(before[rows], SIDE),
                            _cut(after[rows], SIDE),
                            *_pack_places(doc[rows], row[rows], place[rows]),
                        )
                    ]
                )
            near = np.flatnonzero(np.isin(one, splitters.shared))
            smallest: dict[tuple[int, int], int] = {}
            for a, b, d in zip(one[near].tolist(), two[near].tolist(), doc[near].tolist()):
                if (a, b) in splitters.onward and d < smallest.get((a, b), NO_ID):
                    smallest[a, b] = d
            none = np.zeros(1, dtype=np.int64)
            ahead = [
                (b, True, _cut(np.array([k[0]], "u8"), ONE), _cut(np.array([k[1]], "u8"), TWO), b"", b"", *_pack_places(np.array([d]), none, none))
                for k, d in smallest.items()
                for b in splitters.onward[k]
            ]
            if ahead:
                yield _suffix_batch(ahead)

        for columns in _suffixes(batches):
            held.append(columns)
            count += len(columns[0])
            if count >= HELD:
                yield from hand_on()
                held.clear()
                count = 0
        if count:
            yield from hand_on()

    def sort(group: pa.Table) -> pa.Table:
        own = group.filter(pa.compute.invert(group["ahead"])).to_pylist()
        if not own:
            return _place_table([])
        one = np.concatenate([_uncut(r["one"], ONE) for r in own])
        two = np.concatenate([_uncut(r["two"], TWO) for r in own])
        before = np.concatenate([_uncut(r["before"], SIDE) for r in own])
        after = np.concatenate([_uncut(r["after"], SIDE) for r in own])
        doc, row, place = (np.concatenate([_unsteps(r[c]) for r in own]) for c in ("docs", "rows", "places"))
        order = multikey_order(one, two, doc)
        one, two, before, after, doc, row, place = (c[order] for c in (one, two, before, after, doc, row, place))
        first, run = _runs(one, two)
        smallest = doc[first]
        begins = {key: k for k, key in enumerate(zip(one[first].tolist(), two[first].tolist())) if key in splitters.onward}
        for r in group.filter(group["ahead"]).to_pylist():
            key = (int(_uncut(r["one"], ONE)[0]), int(_uncut(r["two"], TWO)[0]))
            if key in begins:
                smallest[begins[key]] = min(smallest[begins[key]], int(_unsteps(r["docs"])[0]))
        covered = doc > smallest[run]
        asks = _half_shared(before, one, run) | _half_shared(after, one, run) | np.isin(one, splitters.shared)
        asks &= ~covered
        kind = np.where(covered, COVERED, np.where(np.isin(one, splitters.hot), HOT, ASKED))
        told = covered | asks
        return _place_table(list(_place_rows(doc[told], row[told], place[told], kind[told], parts)))

    dealt = docs.mapInArrow(lean(deal), SUFFIX_ROWS)
    return dealt.groupBy("bucket").applyInArrow(lean(sort), PLACE_ROWS)


# --- Second sort: the strings around suffixes that ask ---

ASKING_ROWS = "bucket int, bytes binary, sizes binary, docs binary, rows binary, places binary"
ASKING_NAMES = ["bucket", "bytes", "sizes", "docs", "rows", "places"]
ASKING_KINDS = [pa.int32()] + [pa.binary()] * 5


def _by_document(places: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Sorted places of each document, by its id and row."""
    if not places.num_rows:
        return {}
    doc, row, place = (
        np.concatenate([_unsteps(d) for d in places[c].to_pylist()]) for c in ("docs", "rows", "places")
    )
    order = np.lexsort((place, row, doc))
    first, _ = _runs(doc[order], row[order])
    return {
        (int(doc[rows[0]]), int(row[rows[0]])): place[rows] for rows in np.split(order, np.flatnonzero(first)[1:])
    }


def _texts(part: pa.Table) -> Iterator[tuple[tuple[int, int], bytes]]:
    for doc, row, text in zip(*(part[c].to_pylist() for c in ("doc_id", "row", "text"))):
        yield (NO_ID if doc is None else doc, row), text.encode() if text else b""


def second_sort(parted: DataFrame, asked: DataFrame, buckets: int, parts: int) -> DataFrame:
    """Rows (part, kind, docs, rows, places) of 50-byte strings that an earlier document has.

    A task takes the surroundings of each asking suffix to the bucket of its
    gram. There the strings that begin j bytes before the gram are sorted, for
    each j. ``kind`` is ASKED: places are string starts.
    """

    def ask(part: pa.Table, places: pa.Table) -> pa.Table:
        wanted = _by_document(places)
        around, sizes, docs, numbers, at = [], [], [], [], []
        for who, text in _texts(part):
            for place in wanted.get(who, ()):
                left, right = min(place, S.REACH), min(len(text) - place, S.LENGTH)
                bytes_ = text[place - left : place + right]
                around.append(b"\0" * (S.REACH - left) + bytes_ + b"\0" * (S.LENGTH - right))
                sizes.append((left, right))
                docs.append(who[0])
                numbers.append(who[1])
                at.append(place)
        if not docs:
            return pa.table([pa.array([], t) for t in ASKING_KINDS], names=ASKING_NAMES)
        flat = np.frombuffer(b"".join(around), dtype=np.uint8)
        gram = S.gram_hashes(flat)[np.arange(len(docs)) * (S.REACH + S.LENGTH) + S.REACH]
        bucket = (gram >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        first, _ = _runs(bucket[order])
        rows = []
        sizes_ = np.array(sizes, np.uint8)
        docs_, rows_, at_ = (np.array(c, np.int64) for c in (docs, numbers, at))
        block = flat.reshape(-1, S.REACH + S.LENGTH)
        for k in np.split(order, np.flatnonzero(first)[1:]):
            rows.append(
                (
                    int(bucket[k[0]]),
                    zstandard.compress(block[k].tobytes(), 3),
                    sizes_[k].tobytes(),
                    *_pack_places(docs_[k], rows_[k], at_[k]),
                )
            )
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), ASKING_KINDS)], names=ASKING_NAMES)

    def compare(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        flat = np.frombuffer(b"".join(zstandard.decompress(r["bytes"]) for r in rows), dtype=np.uint8)
        sizes = np.concatenate([np.frombuffer(r["sizes"], np.uint8).reshape(-1, 2) for r in rows]).astype(np.int64)
        doc, row, place = (np.concatenate([_unsteps(r[c]) for r in rows]) for c in ("docs", "rows", "places"))
        width = S.REACH + S.LENGTH
        stream = S.Stream([S.Piece(0, 0, flat.tobytes(), 0, 0)])
        found_doc, found_row, found_place = [], [], []
        for j in range(S.REACH + 1):
            has = np.flatnonzero((sizes[:, 0] >= j) & (sizes[:, 1] >= S.LENGTH - j))
            if not len(has):
                continue
            one, two = S.window_tokens(stream, has * width + S.REACH - j)
            order = multikey_order(one, two, doc[has])
            first, run = _runs(one[order], two[order])
            ids = doc[has][order]
            later = ids > ids[first][run]
            found_doc.append(ids[later])
            found_row.append(row[has][order][later])
            found_place.append(place[has][order][later] - j)
        doc, row, place = (np.concatenate(c) for c in (found_doc, found_row, found_place))
        return _place_table(list(_place_rows(doc, row, place, np.full(len(doc), ASKED), parts)))

    asking = (
        parted.groupBy("part")
        .cogroup(asked.groupBy("part"))
        .applyInArrow(ask, ASKING_ROWS)
    )
    return asking.groupBy("bucket").applyInArrow(lean(compare), PLACE_ROWS)


def hot_strings(parted: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
    """As ``second_sort``, for grams too frequent for one bucket.

    The smallest id of each string is aggregated before the shuffle, and the
    strings meet it in a join that Spark may split at frequent keys.
    """

    def ask(part: pa.Table, places: pa.Table) -> pa.Table:
        wanted = _by_document(places)
        out: list[list] = [[], [], [], [], []]
        for who, text in _texts(part):
            asked_places = wanted.get(who)
            if asked_places is None:
                continue
            starts = np.unique((asked_places[:, None] - np.arange(S.REACH + 1)).ravel())
            starts = starts[(starts >= 0) & (starts + S.LENGTH <= len(text))]
            if not len(starts):
                continue
            one, two = S.window_tokens(S.Stream([S.Piece(0, 0, text, 0, 0)]), starts)
            mine = (np.full(len(starts), who[0]), np.full(len(starts), who[1]))
            for column, values in zip(out, (one.view(np.int64), two.view(np.int64), *mine, starts)):
                column.append(values)
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["one", "two", "doc", "row", "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row, place = (batch.column(k).to_numpy() for k in range(3))
            rows = list(_place_rows(doc, row, place, np.full(len(doc), ASKED), parts))
            yield from _place_table(rows).to_batches()

    strings = saved(
        parted.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(
            ask, "one long, two long, doc long, row long, place long"
        )
    )
    least = saved(
        strings.groupBy("one", "two")
        .agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
        .filter(F.col("least") < F.col("most"))
        .drop("most")
    )
    later = strings.join(least, ["one", "two"]).filter(F.col("doc") > F.col("least"))
    return later.select("doc", "row", "place").mapInArrow(pack, PLACE_ROWS)


# --- Removal ---


def removed_runs(covered: np.ndarray, strings: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes of a text."""
    starts = np.concatenate([np.maximum(covered - S.REACH, 0), strings])
    ends = np.concatenate([np.minimum(covered + S.LENGTH, size), strings + S.LENGTH])
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return list(zip(starts[new].tolist(), np.concatenate([reach[new[1:] - 1], reach[-1:]]).tolist()))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, kept binary, removed array of (start, end))."""
    docs = bounded_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    alike, docs = told_apart(docs, "doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(total / BUCKET_BYTES))
    parts = max(LEAST_BUCKETS, math.ceil(total / PART_BYTES)) | 1
    splitters = sample_splitters(docs, total, buckets)
    places = saved(first_sort(docs, splitters, parts))
    part = part_column(F.col("doc_id"), F.col("row"), parts)
    parted = docs.withColumn("part", part)
    found = places.filter(F.col("kind") == COVERED).unionByName(
        second_sort(parted, places.filter(F.col("kind") == ASKED), buckets, parts)
    )
    if len(splitters.hot):
        found = found.unionByName(hot_strings(parted, places.filter(F.col("kind") == HOT), parts))
    run = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def finish(part: pa.Table, rows: pa.Table) -> pa.Table:
        kinds = rows["kind"].to_numpy()
        covered = _by_document(rows.filter(pa.array(kinds == COVERED)))
        strings = _by_document(rows.filter(pa.array(kinds == ASKED)))
        none = np.zeros(0, dtype=np.int64)
        sizes, kept, removed = [], [], []
        for who, text in _texts(part):
            runs = removed_runs(covered.get(who, none), strings.get(who, none), len(text))
            bounds = [0, *(x for r in runs for x in r), len(text)]
            sizes.append(len(text))
            kept.append(b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2])))
            removed.append([{"start": a, "end": b} for a, b in runs])
        return pa.table(
            [part["doc_id"], part["row"], pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(run))],
            names=["doc_id", "row", "n_bytes", "kept", "removed"],
        )

    done = (
        parted.groupBy("part")
        .cogroup(found.groupBy("part"))
        .applyInArrow(
            finish, "doc_id long, row long, n_bytes long, kept binary, removed array<struct<start: long, end: long>>"
        )
    )
    return for_every_row(alike, done, "doc_id")


@result_only
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
