"""Merkle manifest of a dataset as a content-addressed graph.

Rows become leaves, hashed from their columns. Leaves are ranked within their tree
(here a language), and every two neighbours hash to their parent until one node is
left; the trees' roots are hashed together in the same way. Nodes are stored as
records that lead from a digest to children: a record spans ``BITS`` levels, so it
holds up to 2**BITS children, and the nodes between are hashed again when it is read.

A proof is found by descent from the root. A request names a digest; its record is
looked up by that digest, the next digit of the rank selects a child, and the children
that are not selected are collected as one segment of the path. Requests that share a
prefix of the rank go down together, as one, so the top is asked for once and the
number of lookups is that of the records. At the leaves the segments, found from the
root down, are put in reverse, which gives the siblings from the leaf up.

Equal digests are one record. Records and requests carry a shelf as well, drawn from
their place, so that a digest which a large share of the table repeats is stored once
on each shelf and no task looks up all of its requests.

Ranks come from a range sort: tasks number their rows, the counts of the tasks carry
the numbers on. Nothing but the root and the largest tree's size reaches the driver.

Defined cases: NULL columns hash as ``-``; a NULL tree name is a tree of its own, the
first. A NULL id ranks first in its tree and is never tampered with; equal ids rank by
their leaf, and equal leaves are equal nodes, each with its own place. An empty table
gives an empty table. Texts of any length are hashed whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.llm.common import let, table
from sitewatch.session import result_only, saved

#: Levels of the tree that one record spans.
BITS = 6
#: Equal records are kept once on each shelf.
SHELVES = 256
#: What a leaf is hashed from, in order, and which rows are tampered with.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_SHARE = 7

RESULT_DDL = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def encoded(value: Column) -> Column:
    """``-`` for NULL, else the bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(F.concat(*(encoded(v) for v in values)))


def tree_name(column: Column) -> Column:
    """Text that is never NULL and sorts NULL first, then by bytes."""
    return F.coalesce(F.concat(F.lit("v"), column), F.lit(""))


# --- Ranks ---


def _numbered(rows: DataFrame) -> DataFrame:
    """Sorted rows with their task and their number within task and tree."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    place = rows.columns.index("tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, number = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            numbers = []
            for name in batch.column(place).to_pylist():
                number = number + 1 if name == tree else 0
                tree = name
                numbers.append(number)
            added = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], names=[*batch.schema.names, "part", "number"]
            )

    return rows.mapInArrow(run, f"{ddl}, part int, number long")


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``index``, the place within ``tree`` from 0, and ``size``, the tree's rows."""
    sorting = [F.asc_nulls_first(c) for c in ("tree", *order)]
    numbered = saved(_numbered(rows.repartitionByRange(*sorting).sortWithinPartitions(*sorting)))
    counts = numbered.groupBy("tree", "part").agg((F.max("number") + 1).alias("n"))
    # One row per task and tree.
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "tree",
        "part",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(tree).alias("size"),
    )
    joined = numbered.join(offsets, ["tree", "part"])
    return joined.withColumn("index", F.col("before") + F.col("number")).drop("part", "number", "before")


# --- Records ---


def _parents(nodes: Column) -> Column:
    """Digests of every two neighbours; the last may stand alone."""

    def parent(i: Column) -> Column:
        return digest(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), parent)


def _levels(children: Column, height: Column) -> Column:
    """The nodes of a record level by level, its children first."""

    def higher(levels: Column, _: Column) -> Column:
        return F.concat(levels, F.array(_parents(F.element_at(levels, -1))))

    first = F.array(children).cast("array<array<string>>")
    return F.when(height == 0, first).otherwise(F.aggregate(F.sequence(F.lit(1), height), first, higher))


def _segment(levels: Column, height: Column, child: Column) -> Column:
    """The nodes beside the way from a child up to its record: (left, digest or NULL)."""

    def beside(level: Column) -> Column:
        way = F.floor(child / F.pow(F.lit(2), level)).cast("int")
        return F.struct(
            (way % 2 == 1).alias("left"),
            F.get(F.element_at(levels, level + 1), way.bitwiseXOR(F.lit(1))).alias("digest"),
        )

    none = F.array().cast("array<struct<left:boolean,digest:string>>")
    return F.when(height == 0, none).otherwise(F.transform(F.sequence(F.lit(0), height - 1), beside))


def _bit_length(size: Column) -> Column:
    """Levels above ``size`` nodes: how often they are halved, rounding up, until one is left."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def _depth(size: Column) -> Column:
    """Levels of records above ``size`` nodes."""
    return F.ceil(_bit_length(size) / F.lit(BITS)).cast("int")


def _shelf(tree: Column, segment: Column) -> Column:
    return F.pmod(F.xxhash64(tree, segment), F.lit(SHELVES)).cast("int")


@dataclass(frozen=True)
class Dag:
    """Digest-to-children records by level, the leaves' payloads, and the trees' roots."""

    store: tuple[DataFrame, ...]  # shelf, digest, height, children
    members: DataFrame  # tree, segment, payloads in order of the leaves
    roots: DataFrame  # tree, size, digest


def build(leaves: DataFrame) -> Dag:
    """Of rows (tree, size, index, digest, payload)."""
    segment = F.floor(F.col("index") / 2**BITS).cast("long").alias("segment")
    # At most 2**BITS rows a group.
    members = saved(
        leaves.groupBy("tree", segment).agg(
            F.max("size").alias("size"),
            F.sort_array(F.collect_list(F.struct("index", "digest", "payload"))).alias("nodes"),
        )
    )
    largest = members.agg(F.max("size")).first()[0] or 0
    depth = -(-max(0, largest - 1).bit_length() // BITS)
    grouped = members.withColumn("children", F.col("nodes.digest"))
    roots = [members.filter("size = 1").select("tree", "size", F.col("nodes")[0]["digest"].alias("digest"))]
    store = []
    for _ in range(depth):
        height = F.least(F.lit(BITS), _bit_length(F.col("size")))
        level = saved(
            grouped.filter("size > 1")
            .withColumn("height", height)
            .withColumn("digest", F.element_at(F.element_at(_levels(F.col("children"), F.col("height")), -1), 1))
            .select("tree", "segment", "size", "height", "digest", "children")
        )
        shelf = _shelf(F.col("tree"), F.col("segment")).alias("shelf")
        store.append(saved(level.select(shelf, "digest", "height", "children").dropDuplicates(["shelf", "digest"])))
        nodes = level.select(
            "tree",
            F.ceil(F.col("size") / F.lit(2**BITS)).cast("long").alias("size"),
            F.col("segment").alias("index"),
            "digest",
        )
        roots.append(nodes.filter("size = 1").select("tree", "size", "digest"))
        grouped = (
            nodes.filter("size > 1")
            .groupBy("tree", segment)
            .agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("index", "digest"))).alias("nodes"))
            .withColumn("children", F.col("nodes.digest"))
        )
    tops = roots[0]
    for more in roots[1:]:
        tops = tops.unionByName(more)
    sizes = members.filter("segment = 0").select("tree", "size")
    payloads = members.select("tree", "segment", F.col("nodes.payload").alias("payloads"))
    return Dag(tuple(store), payloads, saved(tops.drop("size").join(sizes, "tree")))


# --- Descent ---


def descend(dag: Dag, requests: DataFrame) -> DataFrame:
    """Every leaf under the requested roots: (tree, top, digest, path, payload).

    Requests are (tree, size, digest, path) with ``path`` the segments collected so
    far, from the root down; ``top`` is the digest that was asked for.
    """
    asked = requests.select(
        "tree",
        F.col("digest").alias("top"),
        "digest",
        F.lit(0).cast("long").alias("segment"),
        _depth(F.col("size")).alias("level"),
        "path",
    )
    for level in range(len(dag.store), 0, -1):
        shelf = _shelf(F.col("tree"), F.col("segment"))
        opened = (
            asked.filter(F.col("level") == level)
            .withColumn("shelf", shelf)
            .join(dag.store[level - 1], ["shelf", "digest"])
        )
        waiting = asked.filter(F.col("level") < level)
        if level == 1:
            return _leaves(dag, opened.drop("shelf", "level"), waiting.drop("level"))
        child = _selected(opened, F.col("children")).select(
            "tree",
            "top",
            F.col("s.child").alias("digest"),
            (F.col("segment") * 2**BITS + F.col("s.digit")).alias("segment"),
            F.lit(level - 1).alias("level"),
            F.concat("path", F.array("s.beside")).alias("path"),
        )
        asked = saved(waiting.unionByName(child))
    return _leaves(dag, None, asked.drop("level"))


def _selected(opened: DataFrame, others: Column) -> DataFrame:
    """A row per digit: the child it selects, the children it does not, and ``others``' entry."""
    levels, height = _levels(F.col("children"), F.col("height")), F.col("height")

    def select(all_levels: Column) -> Column:
        digits = F.sequence(F.lit(0), F.size("children") - 1)
        return F.transform(
            digits,
            lambda d: F.struct(
                d.alias("digit"),
                F.get("children", d).alias("child"),
                F.get(others, d).alias("other"),
                _segment(all_levels, height, d).alias("beside"),
            ),
        )

    return opened.withColumn("s", F.explode(let(levels, select)))


def _leaves(dag: Dag, opened: DataFrame | None, single: DataFrame) -> DataFrame:
    """The last digit: requests meet the payloads of their segment, then fall apart into leaves."""
    # A tree of one leaf has no record: its root is the leaf.
    alone = single.withColumns({"height": F.lit(0), "children": F.array("digest")})
    if opened is not None:
        alone = opened.unionByName(alone, allowMissingColumns=True)
    met = alone.join(dag.members, ["tree", "segment"])
    return _selected(met, F.col("payloads")).select(
        "tree",
        "top",
        F.col("s.child").alias("digest"),
        F.concat("path", F.array("s.beside")).alias("path"),
        F.col("s.other").alias("payload"),
    )


def siblings(path: Column) -> Column:
    """Path segments, found from the root down, as (left, digest) from the leaf up."""
    return F.flatten(F.reverse(path))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def up(node: Column, beside: Column) -> Column:
        other = F.coalesce(beside["digest"], F.lit(""))
        return digest(F.when(beside["left"], F.concat(other, node)).otherwise(F.concat(node, other)))

    return F.aggregate(proof, leaf, up)


@dataclass(frozen=True)
class Manifest:
    """The root, and every row with its leaf, its tree's root and its proof."""

    root: str | None
    proofs: DataFrame  # payload, leaf, subroot, proof


def manifest(leaves: DataFrame, order: Sequence[str]) -> Manifest:
    """Of rows (tree, digest, payload, row) and the columns that rank them in a tree.

    ``row``, a column that differs in every row, is the last of the order and lets the
    range sort cut a heap of equal rows.
    """
    forest = build(ranked(leaves, [*order, "digest", "row"]))
    # One row per tree; ranked by name in one tree of its own.
    tops = forest.roots.select(
        F.lit("").alias("tree"), "digest", F.struct("tree", "size").alias("payload"), F.col("tree").alias("name")
    )
    crown = build(ranked(tops, ["name"]))
    first = crown.roots.first()
    path = F.array().cast("array<array<struct<left:boolean,digest:string>>>")
    trees = descend(crown, crown.roots.withColumn("path", path))
    requests = trees.select("payload.tree", "payload.size", "digest", "path")
    found = descend(forest, saved(requests)).select(
        "payload", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), siblings(F.col("path")).alias("proof")
    )
    return Manifest(first["digest"] if first else None, found)


def tampered(column: Column) -> Column:
    """The number plus one, as far as it is there; beyond 64 bits, too."""
    return column.cast("decimal(20,0)") + F.lit(1).cast("decimal(20,0)")


@result_only
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = {c: F.col(c) for c in LEAF_COLUMNS}
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_SHARE == 0
    changed = leaf_of([tampered(v) if c == "n_chars" else v for c, v in values.items()])
    # Ranks need several passes; texts are read in this one only.
    leaves = saved(
        docs.select(
            tree_name(F.col("lang")).alias("tree"),
            leaf_of(list(values.values())).alias("digest"),
            F.struct("doc_id", F.when(struck, changed).alias("tampered")).alias("payload"),
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
        )
    )
    told = manifest(leaves, ["doc_id"])
    if told.root is None:
        return spark.createDataFrame([], RESULT_DDL)
    others = F.filter("proof", lambda s: s["digest"].isNotNull())
    folded = fold(F.coalesce("payload.tampered", "leaf"), F.col("proof"))
    return told.proofs.select(
        "payload.doc_id",
        "leaf",
        "subroot",
        F.lit(told.root).alias("root"),
        digest(F.array_join(F.transform(others, lambda s: s["digest"]), "")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
