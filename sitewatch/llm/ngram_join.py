"""N-gram Jaccard join as a blocked sparse product of documents by n-grams.

Documents are the rows of an incidence matrix, hashed n-grams its columns; the
product of the matrix with its transpose holds the overlap of every two documents.
It is computed where the sizes leave a link possible, and nowhere else:

1. Columns are cut into hash blocks, finer for larger documents. Two documents at a
   Jaccard of 0.8 differ by at most d = (|x| + |y|) / 9 grams, hence in no more blocks
   than that; so of the d + 1 blocks that each shows, in a common order, one is equal
   in both. A key is the fingerprint of a block; only rows that share one meet.
2. Rows that meet are held against the sizes and against parity maps, a lower bound of
   the difference, which discards most of what is left.
3. The others are multiplied: a row against a tile of rows, column block by column
   block. Overlaps add up over the blocks, and a pair goes as soon as its overlap so far
   and all that it still has cannot reach 0.8.

Equal sets are one row from the start (two 64-bit sums). The product is taken three
times, each time after the links of the last were contracted into components: of each
key's documents with its first one; of those in keys that still hold several components
with the one that is in most of these keys, as the text is that others were copied
from; and of all that share a key across components still. A key of two documents is
settled by the first. So a large group of near
copies is not multiplied pair by pair, and no component is missed: two rows that
link share a key, and in that key they are of one component or meet. The links
given are those that span the components; with ``all_links`` every pair that shares a
key is multiplied, every link is given with its overlap, and links are counted.

No key, row or tile gathers without bound: members of a key that crowd a task meet the
first of that task; a key of very many documents is cut into tiles, every two of which
are a group; a row that very many others meet travels once for each tile of them.

Defined cases: a NULL or empty text, or one of blanks, has an empty set and is linked
with nothing; fewer than five words are one gram. Every row is a document: rows with
equal or NULL ids are linked by their own texts, and the component's id is the smallest
that any of its rows has (NULL if none has one). An empty table gives an empty table.
Columns other than the id and the text are not read. Grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm import shingles as G
from sitewatch.llm.common import (
    bounded_batches,
    for_every_row,
    lean,
    salted_left_join,
    slices,
    table,
    told_apart,
)
from sitewatch.llm.components import components
from sitewatch.session import result_only, saved, scratch

#: Block keys that a task holds before it hands them on, and per bucket.
HELD, BUCKET_KEYS = 200_000, 250_000
#: About how many key bytes a text of one byte gives; sets the number of buckets.
KEYS_PER_BYTE = 1 / 18
LEAST_BUCKETS = 24
#: Members of one key in one task beyond which they are paired there.
CROWD = 850
KEYS, FACTS, MEMBERS = 0, 1, 2
#: Documents in a tile, pairs looked at at a time, and bytes of maps compared at a time.
TILE, PAIRS, MAP_BYTES = 512, 500_000, 1 << 22
#: Blocks of columns in the product, as leading bits of a gram; grams multiplied at a time.
GRAM_BITS, GRAMS = 3, 500_000
#: Members of keys, and bytes of rows, for each group of a task.
BUCKET_MEMBERS, BUCKET_BYTES = 60_000, 12 << 20


def least_overlap(size_a, size_b):
    """The overlap from which on 100 * overlap >= 80 * union."""
    return -(-80 * (size_a + size_b) // 180)


# --- One pass over the texts ---

PASS_ROWS = "bucket int, kind int, first binary, second binary, facts array<struct<doc_id: long, n: long, one: long, two: long, map: binary>>"
FACT = pa.struct(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("map", pa.binary())]
)
PASS_SCHEMA = pa.schema(
    [
        ("bucket", pa.int32()),
        ("kind", pa.int32()),
        ("first", pa.binary()),
        ("second", pa.binary()),
        ("facts", pa.list_(FACT)),
    ]
)
BLOCK_ROWS = (
    "key long, doc long, centre long, "
    "facts array<struct<doc_id: long, n: long, one: long, two: long, map: binary>>"
)
BLOCK_SCHEMA = pa.schema(
    [("key", pa.int64()), ("doc", pa.int64()), ("centre", pa.int64()), ("facts", pa.list_(FACT))]
)


def _row(bucket: int, kind: int, first: np.ndarray | None, second: np.ndarray | None, facts: list | None) -> pa.RecordBatch:
    values = (
        bucket,
        kind,
        None if first is None else first.tobytes(),
        None if second is None else second.tobytes(),
        facts,
    )
    return pa.RecordBatch.from_arrays(
        [pa.array([v], f.type) for v, f in zip(values, PASS_SCHEMA)], schema=PASS_SCHEMA
    )


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for key in sorted_keys:
            new[1:] |= key[1:] != key[:-1]
    return new


def _stars(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, doc, first doc of the key, members of the key), sorted, without repeats."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = _starts(key, doc)
    key, doc = key[new], doc[new]
    first = _starts(key)
    run = np.cumsum(first) - 1
    return key, doc, doc[first][run], np.bincount(run, minlength=1)[run]


def _hand_on(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of the keys that a task has gathered; of equal sets one document."""
    key, doc, same = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((doc, same, key))
    key, doc, same = key[order], doc[order], same[order]
    one_each = _starts(key, same)
    key, doc, first, members = _stars(key[one_each], doc[one_each])
    crowd = members > CROWD
    if crowd.any():
        # A member of a crowd meets the first of this task; that one goes on.
        inner = crowd & (doc != first)
        for begin in range(0, int(inner.sum()), 50_000):
            rows = np.flatnonzero(inner)[begin : begin + 50_000]
            pairs = np.column_stack([doc[rows], first[rows]])
            yield _row((begin // 50_000 + int(key[rows[0]] % np.uint64(buckets))) % buckets, MEMBERS, key[rows], pairs, None)
        key, doc = key[~inner], doc[~inner]
    bucket = ((key >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    begins = np.flatnonzero(_starts(bucket[order]))
    for rows in np.split(order, begins[1:]):
        if len(rows):
            yield _row(int(bucket[rows[0]]), KEYS, key[rows], doc[rows], None)


def _one_pass(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of block keys and of facts about documents, dealt to buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in slices(batches):
            ids = batch.column(0).to_numpy().astype(np.int64)
            texts = [t.encode() if t else b"" for t in batch.column(1).to_pylist()]
            for begin, step in G.steps(texts):
                sets = G.gram_sets(step)
                sizes, bounds = sets.sizes(), sets.bounds
                sums = []
                for seed in (1, 2):
                    total = np.zeros(len(sets.grams) + 1, dtype=np.uint64)
                    np.cumsum(G.mixed(sets.grams * np.uint64(2 * seed + 1) + np.uint64(seed)), out=total[1:])
                    sums.append(total[bounds[1:]] - total[bounds[:-1]])
                own = ids[begin : begin + len(step)]
                keys = G.block_keys(sets)
                chosen = G.prefix_keys(sets, keys)
                owner = keys.owner[chosen]
                held.append((keys.key[chosen], own[owner], sums[0][owner] ^ sums[1][owner]))
                count += len(chosen)
                facts = [
                    {"doc_id": d, "n": n, "one": a, "two": b, "map": G.parity_map(sets.grams[s:e]) if n else b""}
                    for d, n, a, b, s, e in zip(
                        own.tolist(),
                        sizes.tolist(),
                        sums[0].view(np.int64).tolist(),
                        sums[1].view(np.int64).tolist(),
                        bounds[:-1].tolist(),
                        bounds[1:].tolist(),
                    )
                ]
                yield _row(int(own[0]) % buckets, FACTS, None, None, facts)
                if count >= HELD:
                    yield from _hand_on(held, buckets)
                    held, count = [], 0
        if held:
            yield from _hand_on(held, buckets)

    return docs.mapInArrow(lean(run), PASS_ROWS)


def _blocks(dealt: DataFrame) -> DataFrame:
    """Rows (key, doc, centre) of keys that several documents show, and the facts."""

    def gather(group: pa.Table) -> pa.Table:
        kinds = group["kind"].to_numpy()
        firsts, seconds = group["first"].to_pylist(), group["second"].to_pylist()
        out: list[list[np.ndarray]] = [[], [], []]
        keys = [k for k in range(len(kinds)) if kinds[k] == KEYS]
        if keys:
            key, doc, first, members = _stars(
                np.concatenate([np.frombuffer(firsts[k], np.uint64) for k in keys]),
                np.concatenate([np.frombuffer(seconds[k], np.int64) for k in keys]),
            )
            several = members > 1
            for column, values in zip(out, (key[several], doc[several], first[several])):
                column.append(values)
        for k in np.flatnonzero(kinds == MEMBERS):
            pairs = np.frombuffer(seconds[k], np.int64).reshape(-1, 2)
            key = np.frombuffer(firsts[k], np.uint64)
            for column, values in zip(out, (key, pairs[:, 0], pairs[:, 1])):
                column.append(values)
            # The centre is a member too, also if no other task shows its key.
            for column, values in zip(out, (key, pairs[:, 1], pairs[:, 1])):
                column.append(values)
        facts = group.filter(pa.array(kinds == FACTS))["facts"].combine_chunks()
        n = sum(len(c) for c in out[0])
        columns = [np.concatenate(c).view(np.int64) if c else np.zeros(0, np.int64) for c in out]
        arrays = [pa.concat_arrays([pa.array(c, pa.int64()), pa.nulls(len(facts), pa.int64())]) for c in columns]
        listed = pa.concat_arrays([pa.nulls(n, pa.list_(FACT)), facts.cast(pa.list_(FACT))])
        return pa.Table.from_arrays([*arrays, listed], schema=BLOCK_SCHEMA)

    return dealt.groupBy("bucket").applyInArrow(lean(gather), BLOCK_ROWS)


# --- Candidates: rows that share a key and may reach the bound ---


def _dealt_keys(members: DataFrame, buckets: int) -> DataFrame:
    """Members (key, doc, component, n, map) dealt to groups of bounded size.

    Small keys share a bucket. A key of more than ``TILE`` documents is cut into tiles by
    a hash of the document, and every two tiles are a group of their own.
    """
    # A written table of few keys joins without a shuffle of the members and their maps.
    sizes = saved(members.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > TILE))
    joined = salted_left_join(members, sizes, ["key"], F.col("doc"))
    small = F.col("_size").isNull()
    tiles = F.when(small, F.lit(1)).otherwise(F.ceil(F.col("_size") / F.lit(TILE // 2))).cast("int")
    # Beyond all buckets of small keys: a group for every two tiles.
    two = F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))
    bucket = F.when(small, F.pmod(F.xxhash64("key"), F.lit(buckets))).otherwise(
        F.lit(buckets) + F.pmod(two, F.lit(1 << 61))
    )
    return (
        joined.withColumn("tile", F.pmod(F.xxhash64("doc"), tiles).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .select(bucket.alias("bucket"), "key", "tile", "other", "doc", "component", "n", "map")
    )


def _pairs_in(
    key: np.ndarray, doc: np.ndarray, part: np.ndarray, n: np.ndarray, tile: np.ndarray, other: np.ndarray, across: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows, sorted by (key, n), that share a key; some ``PAIRS`` at a time.

    Partners of a row are those after it, up to five quarters of its size.
    """
    run = np.cumsum(_starts(key)) - 1
    wide = int(n.max(initial=0)) + 2
    flat = run * wide + n
    begin = np.arange(len(key)) + 1
    end = np.searchsorted(flat, run * wide + np.minimum(5 * n // 4, wide - 1), side="right")
    counts = np.maximum(end - begin, 0)
    step = np.cumsum(counts) // PAIRS
    for rows in np.split(np.arange(len(key)), np.flatnonzero(np.diff(step)) + 1) if len(key) else ():
        i = np.repeat(rows, counts[rows])
        j = begin[i] + np.arange(len(i)) - np.repeat(np.cumsum(counts[rows]) - counts[rows], counts[rows])
        keep = doc[i] != doc[j]
        if across:
            keep &= part[i] != part[j]
        # In a group of two tiles, pairs inside one belong to that tile's own group.
        keep &= (tile[i] != tile[j]) | (tile[i] == other[i])
        if keep.any():
            yield i[keep], j[keep]


class _Maps:
    """Parity maps of documents, stacked by length."""

    def __init__(self, maps: list[bytes]):
        self.length = np.array([len(m) for m in maps], dtype=np.int64)
        self.place = np.zeros(len(maps), dtype=np.int64)
        self.stacks: dict[int, np.ndarray] = {}
        for length in np.unique(self.length).tolist():
            mine = np.flatnonzero(self.length == length)
            self.place[mine] = np.arange(len(mine))
            self.stacks[length] = np.frombuffer(b"".join([maps[k] for k in mine]), np.uint8).reshape(len(mine), length)

    def allow(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Whether sizes within five quarters, and maps, leave a link possible."""
        ok = (np.minimum(n_a, n_b) > 0) & (5 * np.minimum(n_a, n_b) >= 4 * np.maximum(n_a, n_b))
        most = G.most_different(n_a, n_b)
        low, high = np.minimum(self.length[a], self.length[b]), np.maximum(self.length[a], self.length[b])
        for short in np.unique(low[ok]).tolist():
            for long in (short, 2 * short):
                rows = np.flatnonzero(ok & (low == short) & (high == long))
                step = max(1, MAP_BYTES // long)
                for begin in range(0, len(rows), step):
                    mine = rows[begin : begin + step]
                    first = self.length[a[mine]] == short
                    x, y = np.where(first, a[mine], b[mine]), np.where(first, b[mine], a[mine])
                    one = self.stacks[short][self.place[x]]
                    two = G.folded(self.stacks[long][self.place[y]], short)
                    ok[mine] = np.bitwise_count((one ^ two).view(np.uint64)).sum(axis=1) <= most[mine]
        return ok


def candidates(members: DataFrame, across: bool = True) -> DataFrame:
    """Pairs (a, b), a < b, that share a key and that sizes and maps allow.

    ``members``: (key, doc, component, n, map). With ``across`` only pairs of different
    components. A task takes many keys at once.
    """

    def run(group: pa.Table) -> pa.Table:
        columns = [group[c].to_numpy() for c in ("key", "doc", "component", "n", "tile", "other")]
        order = np.lexsort((columns[1], columns[3], columns[0]))
        key, doc, part, n, tile, other = (c[order] for c in columns)
        names, first, of_row = np.unique(doc, return_index=True, return_inverse=True)
        maps = _Maps(group["map"].take(pa.array(order[first])).to_pylist())
        size = n[first]
        found = []
        for i, j in _pairs_in(key, doc, part, n, tile, other, across):
            a, b = np.minimum(of_row[i], of_row[j]), np.maximum(of_row[i], of_row[j])
            one = np.unique(a * len(names) + b)
            a, b = one // len(names), one % len(names)
            found.append(one[maps.allow(a, b, size[a], size[b])])
        one = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        count = max(1, len(names))
        return pa.table([pa.array(names[one // count]), pa.array(names[one % count])], names=["a", "b"])

    buckets = max(LEAST_BUCKETS, members.count() // BUCKET_MEMBERS + 1)
    return _dealt_keys(members, buckets).groupBy("bucket").applyInArrow(lean(run), "a long, b long").distinct()


# --- A row against tiles of rows ---


def _met(pairs: DataFrame, rows: DataFrame, payload: str, size: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairs (a, b), dealt to buckets: each centre's row once for each of
    its tiles, (bucket, centre, tile, n, payload), and (bucket, centre, tile, doc, n, payload).

    The centre of a pair is the one with more pairs. ``rows`` is (doc, n, payload), and
    ``size`` the bytes of a payload.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
    # Only rows with very many pairs have more than one tile.
    heavy = saved(ends.groupBy("doc").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") > TILE))
    for one, other in (("a", "b"), ("b", "a")):
        known = heavy.select(F.col("doc").alias(one), F.col("d").alias(f"d_{one}"))
        pairs = salted_left_join(pairs, known, [one], F.col(other))
    d_a, d_b = (F.coalesce(f"d_{x}", F.lit(1)) for x in ("a", "b"))
    told = saved(
        pairs.select(
            F.when(d_b > d_a, F.col("b")).otherwise(F.col("a")).alias("centre"),
            F.when(d_b > d_a, F.col("a")).otherwise(F.col("b")).alias("doc"),
            F.ceil(F.greatest(d_a, d_b) / F.lit(TILE)).cast("long").alias("tiles"),
        ).withColumn("tile", F.pmod(F.xxhash64("doc"), F.col("tiles")))
    )
    total = told.join(rows.select("doc", size.alias("size")), "doc").agg(F.sum("size").cast("long")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES + 1)
    bucket = F.pmod(F.xxhash64("centre", "tile"), F.lit(buckets)).alias("bucket")
    centres = told.select("centre", "tile").distinct().join(rows.withColumnRenamed("doc", "centre"), "centre")
    others = told.join(rows, "doc")
    # Both sides read the same tables; new names of columns tell them apart.
    return tuple(
        side.select(bucket, *(F.col(c).alias(c) for c in columns))
        for side, columns in (
            (centres, ("centre", "tile", "n", payload)),
            (others, ("centre", "tile", "doc", "n", payload)),
        )
    )


def possible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (a, b) that the sizes and parity maps of ``facts`` (doc, n, map) allow."""

    def compare(centre_rows: pa.Table, other_rows: pa.Table) -> pa.Table:
        place = {k: i for i, k in enumerate(zip(centre_rows["centre"].to_pylist(), centre_rows["tile"].to_pylist()))}
        keys = zip(other_rows["centre"].to_pylist(), other_rows["tile"].to_pylist())
        a = np.array([place[k] for k in keys], dtype=np.int64)
        b = np.arange(len(a)) + len(place)
        n = np.concatenate([centre_rows["n"].to_numpy(), other_rows["n"].to_numpy()])
        maps = _Maps(centre_rows["map"].to_pylist() + other_rows["map"].to_pylist())
        ok = maps.allow(a, b, n[a], n[b])
        centre, doc = (other_rows[c].to_numpy()[ok] for c in ("centre", "doc"))
        return pa.table([pa.array(np.minimum(centre, doc)), pa.array(np.maximum(centre, doc))], names=["a", "b"])

    centres, others = _met(pairs, facts, "map", F.col("n") / 4 + 64)
    return centres.groupBy("bucket").cogroup(others.groupBy("bucket")).applyInArrow(lean(compare), "a long, b long")


def incidence(docs: DataFrame) -> DataFrame:
    """Rows (doc, n, grams) of the incidence matrix: the document's columns, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.encode() if t else b"" for t in batch.column(1).to_pylist()]
            for begin, step in G.steps(texts):
                sets = G.gram_sets(step)
                grams = [sets.grams[s:e].tobytes() for s, e in zip(sets.bounds[:-1], sets.bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(step)), pa.array(sets.sizes()), pa.array(grams, pa.binary())],
                    names=["doc", "n", "grams"],
                )

    return docs.mapInArrow(lean(run), "doc long, n long, grams binary")


def overlaps(
    columns: np.ndarray, block: np.ndarray, owner: np.ndarray, row: np.ndarray, size: np.ndarray, partner: np.ndarray
) -> np.ndarray:
    """Overlaps of pairs, added up column block by column block; -1 for one that was discarded.

    ``row``: the centres' columns, sorted. ``columns``: those of the others, each with its
    ``block`` and the number of its pair. ``size`` and ``partner``: of the pairs' two rows.
    """
    overlap, left = np.zeros(len(size), dtype=np.int64), size.copy()
    needed = least_overlap(size, partner)
    alive = np.minimum(size, partner) >= needed
    for k in range(1 << GRAM_BITS):
        mine = np.flatnonzero((block == k) & alive[owner])
        at = np.searchsorted(row, columns[mine])
        hit = row[np.minimum(at, len(row) - 1)] == columns[mine]
        overlap += np.bincount(owner[mine[hit]], minlength=len(size))
        left -= np.bincount(owner[mine], minlength=len(size))
        alive &= overlap + left >= needed
    return np.where(alive, overlap, -1)


def product(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b, overlap): of the pairs (a, b) those whose overlap makes a link."""

    def multiply(centre_rows: pa.Table, other_rows: pa.Table) -> pa.Table:
        # The centres of a bucket make one long row; a salt tells their columns apart.
        place = {k: i for i, k in enumerate(zip(centre_rows["centre"].to_pylist(), centre_rows["tile"].to_pylist()))}
        salts = G.mixed(np.arange(1, len(place) + 1, dtype=np.uint64))
        held = [np.frombuffer(g, np.uint64) for g in centre_rows["grams"].to_pylist()]
        partner = centre_rows["n"].to_numpy()
        row = np.sort(np.concatenate([g ^ salt for g, salt in zip(held, salts)])) if held else np.zeros(0, np.uint64)
        size = other_rows["n"].to_numpy()
        found = [np.zeros((0, 3), dtype=np.int64)]
        step = np.cumsum(size) // GRAMS
        bounds = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(size)]
        for begin, end in zip(bounds[:-1], bounds[1:]):
            if begin == end or not len(row):
                continue
            tile = other_rows.slice(begin, end - begin)
            centre, doc = (tile[c].to_numpy() for c in ("centre", "doc"))
            who = np.array([place[k] for k in zip(centre.tolist(), tile["tile"].to_pylist())], dtype=np.int64)
            columns = np.frombuffer(b"".join(tile["grams"].to_pylist()), np.uint64)
            owner = np.repeat(np.arange(end - begin), size[begin:end])
            block = columns >> np.uint64(64 - GRAM_BITS)
            counts = overlaps(columns ^ salts[who][owner], block, owner, row, size[begin:end], partner[who])
            ok = counts > 0
            found.append(np.column_stack([np.minimum(centre, doc)[ok], np.maximum(centre, doc)[ok], counts[ok]]))
        out = np.vstack(found)
        return pa.table([pa.array(out[:, k], pa.int64()) for k in range(3)], names=["a", "b", "overlap"])

    centres, others = _met(pairs, rows, "grams", 8 * F.col("n") + 64)
    return (
        centres.groupBy("bucket")
        .cogroup(others.groupBy("bucket"))
        .applyInArrow(lean(multiply), "a long, b long, overlap long")
    )


# --- The join ---


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", all_links: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, component_id), and links (a, b, overlap) between different sets.

    The links span the components. With ``all_links`` they are all there are, and the
    rows have ``n_links`` as well: how many different sets a row's set is linked with.
    In the links a set is named by one of its documents: by the id, if the document has
    one of its own, else by a hash.
    """
    with scratch() as scope:
        docs = bounded_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        alike, once = told_apart(docs, "doc_id", "text")
        own = F.when(F.col("row") == 0, F.col("doc_id")).otherwise(F.xxhash64("row", "doc_id"))
        once = once.withColumn("doc", own)
        nodes, links = _joined(once.select("doc", "text"), all_links)
        links = saved(links, scope.outer)
        if alike is None:
            # Documents are named by their ids, so the smallest name is the smallest id.
            return saved(nodes.withColumnsRenamed({"doc": "doc_id", "label": "component_id"}), scope.outer), links
        rows = saved(nodes.join(once.select("doc", "doc_id", "row"), "doc"))
        least = rows.groupBy("label").agg(F.min("doc_id").alias("_least"))
        renamed = least.filter(~F.col("_least").eqNullSafe(F.col("label"))).withColumn("_renamed", F.lit(True))
        told = salted_left_join(rows, renamed, ["label"], F.col("doc")).withColumn(
            "component_id", F.when(F.col("_renamed"), F.col("_least")).otherwise(F.col("label"))
        )
        columns = ["doc_id", "row", "n_shingles", "component_id", *(["n_links"] if all_links else [])]
        return saved(for_every_row(alike, told.select(*columns), "doc_id"), scope.outer), links


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, doc, component) of the keys that hold several components and more than two members.

    The first stars connect a key's members, so where there are two these have met.
    """
    known = labels.select(F.col("u").alias("doc"), F.col("v").alias("_label"))
    placed = saved(
        members.join(known, "doc", "left").select("key", "doc", F.coalesce("_label", "doc").alias("component"))
    )
    open_ = (
        placed.groupBy("key")
        .agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("_size"))
        .filter((F.col("_low") < F.col("_high")) & (F.col("_size") > 2))
        .select("key")
    )
    return saved(placed.join(saved(open_), "key", "left_semi"))


def _second_stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each key's documents with the one that is in most of the keys."""
    degree = members.groupBy("doc").agg(F.count(F.lit(1)).alias("_keys"))
    best = F.struct("_keys", (-F.col("doc")).alias("_first"), "component")
    centres = saved(members.join(degree, "doc").groupBy("key").agg(F.max(best).alias("_best")))
    # A key may be in very many documents.
    met = salted_left_join(members, centres, ["key"], F.col("doc"))
    centre = -F.col("_best._first")
    pairs = met.filter((F.col("_best.component") != F.col("component")) & (centre != F.col("doc")))
    return pairs.select(F.least(centre, "doc").alias("a"), F.greatest(centre, "doc").alias("b")).distinct()


def _joined(docs: DataFrame, all_links: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc, n_shingles, label) of documents (doc, text), and links (a, b, overlap)."""
    total = docs.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(total * KEYS_PER_BYTE / BUCKET_KEYS) + 1)
    blocks = saved(_blocks(_one_pass(docs, buckets)))
    told = saved(blocks.select(F.inline("facts")).withColumnRenamed("doc_id", "doc"))
    same = (
        told.filter(F.col("n") > 0)
        .groupBy("one", "two")
        .agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
        .drop("copies")
    )
    facts = saved(
        salted_left_join(told, same, ["one", "two"], F.col("doc"))
        .withColumn("first", F.when(F.col("n") > 0, F.coalesce("first", "doc")).otherwise(F.col("doc")))
        .select("doc", "n", "map", "first")
    )
    copies = facts.filter(F.col("first") != F.col("doc")).select("doc", "first")
    sets = facts.filter(F.col("first") == F.col("doc")).select("doc", "n", "map")

    def named(rows: DataFrame, column: str) -> DataFrame:
        """Documents of equal sets under the name of the first."""
        known = copies.select(F.col("doc").alias(column), F.col("first").alias("_first"))
        return rows.join(known, column, "left").withColumn(column, F.coalesce("_first", column)).drop("_first")

    def multiplied(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        return saved(product(pairs, saved(incidence(docs.join(needed, "doc", "left_semi")))))

    def labels_of(edges: DataFrame) -> DataFrame:
        return components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))

    def joined_up(labels: DataFrame, links: DataFrame) -> DataFrame:
        known = labels.select(F.col("u").alias("a"), F.col("v").alias("b"))
        return labels_of(known.union(links.select("a", "b")))

    in_blocks = blocks.filter(F.col("facts").isNull()).select("key", "doc", "centre")
    members = saved(named(in_blocks.select("key", "doc"), "doc").distinct())
    if all_links:
        whole = members.withColumn("component", F.col("doc")).join(sets, "doc")
        links = multiplied(saved(candidates(saved(whole), across=False)))
        labels = labels_of(links)
    else:
        stars = in_blocks.filter(F.col("doc") != F.col("centre"))
        stars = stars.select(F.col("centre").alias("a"), F.col("doc").alias("b")).distinct()
        stars = named(named(stars, "a"), "b").filter(F.col("a") != F.col("b"))
        stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        tried = saved(possible(saved(stars), sets))
        links = multiplied(tried)
        labels = labels_of(links)
        members = _open_members(members, labels)
        met = saved(_second_stars(members).join(tried, ["a", "b"], "left_anti"))
        again = saved(possible(met, sets))
        second = multiplied(again)
        labels = joined_up(labels, second)
        members = _open_members(members.select("key", "doc"), labels)
        rest = saved(members.join(sets, "doc"))
        # What was met twice and found impossible is no candidate either.
        untried = candidates(rest).join(tried.union(again), ["a", "b"], "left_anti")
        third = multiplied(saved(untried))
        links = links.union(second).union(third)
        labels = joined_up(labels, third)

    nodes = facts.join(labels.select(F.col("u").alias("first"), F.col("v").alias("_label")), "first", "left")
    columns = ["doc", F.col("n").alias("n_shingles"), F.coalesce("_label", "first").alias("label")]
    if all_links:
        degree = links.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(
            F.count(F.lit(1)).alias("n_links")
        )
        nodes = nodes.join(degree, "first", "left")
        columns.append(F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    # Labels start at the first of equal sets, so they are the smallest names.
    return nodes.select(*columns), links


@result_only
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))[0]
