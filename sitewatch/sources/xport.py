"""Reader for SAS transport files (version 5), split into ranges of observations.

Observations have one fixed length, so a file divides into ranges that tasks
read on their own: open, seek, read, decode. ``read_transport`` reads a folder of
any number of files in two stages: tasks read every header once, and the ranges that
follow from them are packed by bytes, so that a task reads a large range or many
small files. ``spark.read.format("sas_transport")`` is the same decoder as a plain
source, for which the driver reads the headers of a few files.
Files are reached through ``pyarrow.fs``, which covers local paths and the
object stores and HDFS a cluster would use.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sitewatch.functions.ordered import running_total
from sitewatch.session import saved

# Fixed values of the published transport format.
RECORD = 80
LIBRARY_MARK = b"HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!"
MEMBER_MARK = b"HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!"
NAMESTR_MARK = b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!"
OBS_MARK = b"HEADER RECORD*******OBS     HEADER RECORD!!!!!!!"
NAMESTR_COUNT_AT = 54
MISSING_CODES = b"._ABCDEFGHIJKLMNOPQRSTUVWXYZ"

DEFAULT_RANGE_BYTES = 64 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
HEADER_THREADS = 16
#: What opening a file costs, as bytes read; bounds the files that one task opens.
OPEN_BYTES = 256 * 1024
#: Leading hex digits of a path's hash that cut the packing order into pieces.
PIECE_DIGITS = 3

HEADERS_DDL = (
    "path string, start long, width long, n_obs long, "
    "variables array<struct<name:string,is_text:boolean,length:int,offset:int>>"
)


@dataclass(frozen=True)
class Variable:
    name: str
    is_text: bool
    length: int
    offset: int


@dataclass(frozen=True)
class Layout:
    """Where the observations of one file lie, and how one is laid out."""

    variables: tuple[Variable, ...]
    start: int
    width: int
    n_obs: int


@dataclass
class ObservationRange(InputPartition):
    path: str
    layout: Layout
    first: int
    count: int


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a plain local path, and the path within it."""
    parts = urlparse(path)
    if parts.scheme == "file":
        return pafs.LocalFileSystem(), unquote(parts.path)
    if len(parts.scheme) > 1:
        # Hadoop's name of the object store, as Spark lists it, is not Arrow's.
        return pafs.FileSystem.from_uri("s3" + path[3:] if parts.scheme == "s3a" else path)
    return pafs.LocalFileSystem(), path


def is_folder(path: str) -> bool:
    fs, inner = _file_system(path)
    return fs.get_file_info(inner).type == pafs.FileType.Directory


def list_files(path: str) -> list[str]:
    """The file itself, or every transport file below a folder, in name order."""
    if not is_folder(path):
        return [path]
    path = path.rstrip("/")
    fs, inner = _file_system(path)
    prefix = path.removesuffix(inner)
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    files = sorted(f.path for f in found if f.is_file and f.path.lower().endswith(".xpt"))
    if not files:
        raise ValueError(f"no transport files in {path}")
    return [prefix + f for f in files]


def read_layouts(paths: list[str]) -> list[Layout]:
    with ThreadPool(HEADER_THREADS) as pool:
        return pool.map(read_layout, paths)


def read_layout(path: str, size: int | None = None) -> Layout:
    fs, inner = _file_system(path)
    if size is None:
        size = fs.get_file_info(inner).size
    with fs.open_input_file(inner) as file:
        if not file.read(RECORD).startswith(LIBRARY_MARK):
            raise ValueError(f"{path}: not a version 5 transport file")
        file.seek(3 * RECORD)
        member = file.read(RECORD)
        if not member.startswith(MEMBER_MARK):
            raise ValueError(f"{path}: member header expected")
        namestr_size = int(member[-6:-2])
        file.seek(7 * RECORD)
        header = file.read(RECORD)
        if not header.startswith(NAMESTR_MARK):
            raise ValueError(f"{path}: variable header expected")
        n_variables = int(header[NAMESTR_COUNT_AT : NAMESTR_COUNT_AT + 4])
        # Descriptors are padded as a whole to full records.
        block = math.ceil(n_variables * namestr_size / RECORD) * RECORD
        described = file.read(block)
        if not file.read(RECORD).startswith(OBS_MARK):
            raise ValueError(f"{path}: observation header expected")
        variables = tuple(
            _variable(described[i * namestr_size : (i + 1) * namestr_size])
            for i in range(n_variables)
        )
        width = sum(v.length for v in variables)
        start = 8 * RECORD + block + RECORD
        tail_at = max(start, size - RECORD)
        file.seek(tail_at)
        tail = file.read(size - tail_at)
    return Layout(variables, start, width, _count_observations(size - start, width, tail))


def _variable(namestr: bytes) -> Variable:
    def short(at: int) -> int:
        return int.from_bytes(namestr[at : at + 2], "big")

    return Variable(
        name=namestr[8:16].decode("latin1").strip(),
        is_text=short(0) == 2,
        length=short(4),
        offset=int.from_bytes(namestr[84:88], "big"),
    )


def _count_observations(size: int, width: int, tail: bytes) -> int:
    """Whole observations, less blank ones that only fill the last record."""
    if width == 0:
        return 0
    count = size // width
    blanks = len(tail) - len(tail.rstrip(b" "))
    unused = size - count * width
    # A last record that is blank throughout would not have been written.
    padding = min(blanks, RECORD - 1)
    return count - max(0, padding - unused) // width


def decode_numbers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """IBM hexadecimal floats of 2 to 8 bytes, one per row: values and missing flags."""
    rows, width = raw.shape
    full = np.zeros((rows, 8), dtype=np.uint8)
    full[:, :width] = raw
    bits = full.view(">u8").ravel().astype(np.uint64)
    fraction = (bits & np.uint64((1 << 56) - 1)).astype(np.float64)
    power = ((bits >> np.uint64(56)) & np.uint64(127)).astype(np.int32)
    # value = fraction / 16**14 * 16**(power - 64)
    values = np.ldexp(fraction, 4 * (power - 64) - 56)
    values[bits >> np.uint64(63) == 1] *= -1
    coded = np.isin(raw[:, 0], np.frombuffer(MISSING_CODES, dtype=np.uint8))
    return values, coded & ~raw[:, 1:].any(axis=1)


def decode_text(raw: np.ndarray) -> pa.Array:
    """Latin-1 text of one fixed width, one value per row, as UTF-8."""
    rows, width = raw.shape
    flat = raw.ravel()
    high = flat >= 128
    if high.any():
        # Such a character takes two bytes.
        ends = np.cumsum(1 + high.astype(np.int64))
        starts = ends - 1 - high
        out = np.empty(ends[-1], dtype=np.uint8)
        out[starts] = np.where(high, 0xC0 | flat >> 6, flat)
        out[ends[high] - 1] = 0x80 | flat[high] & 0x3F
        offsets = np.concatenate([[0], ends[width - 1 :: width]])
    else:
        out, offsets = flat, np.arange(rows + 1) * width
    text = pa.StringArray.from_buffers(
        rows, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out))
    )
    return text if flat.all() else pc.utf8_rtrim(text, characters="\0")


def decode_observations(buffer: bytes, layout: Layout, names: list[str]) -> pa.RecordBatch:
    """Columns ``names``; one the file lacks is all missing."""
    grid = np.frombuffer(buffer, dtype=np.uint8).reshape(-1, layout.width)
    known = {v.name: v for v in layout.variables}
    columns = []
    for name in names:
        v = known.get(name)
        if v is None:
            columns.append(pa.nulls(len(grid)))
            continue
        raw = np.ascontiguousarray(grid[:, v.offset : v.offset + v.length])
        if v.is_text:
            columns.append(decode_text(raw))
        else:
            values, missing = decode_numbers(raw)
            columns.append(pa.array(values, pa.float64(), mask=missing))
    return pa.RecordBatch.from_arrays(columns, names=names)


def decode_range(
    path: str, layout: Layout, first: int, count: int, types: pa.Schema
) -> Iterator[pa.RecordBatch]:
    fs, inner = _file_system(path)
    with fs.open_input_file(inner) as file:
        file.seek(layout.start + first * layout.width)
        step = max(1, BATCH_BYTES // max(1, layout.width))
        for done in range(0, count, step):
            n = min(step, count - done)
            batch = decode_observations(file.read(n * layout.width), layout, types.names)
            yield batch.cast(types)


# --- Folders of any number of files ---


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row per transport file at or below ``path``: where its observations lie, and how.

    Spark lists the files; each is opened once, by a task that takes many.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[xX][pP][tT]")
        .load(path)
        .select("path", "length")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                layout = read_layout(file, size)
                variables = [vars(v) for v in layout.variables]
                rows.append((file, layout.start, layout.width, layout.n_obs, variables))
            names = ("path", "start", "width", "n_obs", "variables")
            yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows], schema=HEADERS)

    return files.mapInArrow(run, HEADERS_DDL)


HEADERS = pa.schema(
    [
        ("path", pa.string()),
        ("start", pa.int64()),
        ("width", pa.int64()),
        ("n_obs", pa.int64()),
        (
            "variables",
            pa.list_(
                pa.struct(
                    [("name", pa.string()), ("is_text", pa.bool_()), ("length", pa.int32()), ("offset", pa.int32())]
                )
            ),
        ),
    ]
)


def column_union(headers: DataFrame) -> T.StructType:
    """All columns of all files, in order of first sight by path."""
    seen = headers.select("path", F.posexplode("variables").alias("place", "v"))
    first = F.struct("path", "place")
    columns = (
        seen.groupBy("v.name")
        .agg(
            F.min(first).alias("first"),
            F.min_by("v.is_text", first).alias("is_text"),
            F.count_distinct("v.is_text").alias("kinds"),
        )
        .orderBy("first")
        .collect()
    )
    for c in columns:
        if c["kinds"] > 1:
            other = seen.filter((F.col("v.name") == c["name"]) & (F.col("v.is_text") != c["is_text"]))
            path = other.agg(F.min("path")).first()[0]
            raise ValueError(f"{path}: {c['name']} has another type than in earlier files")
    return T.StructType(
        [T.StructField(c["name"], T.StringType() if c["is_text"] else T.DoubleType()) for c in columns]
    )


def packed_ranges(headers: DataFrame, range_bytes: int = DEFAULT_RANGE_BYTES) -> DataFrame:
    """Ranges of observations, as many to a partition as ``range_bytes`` and the cost of opening allow."""
    step = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / F.greatest("width", F.lit(1)))).cast("long")
    count = F.least(step, F.col("n_obs") - F.col("first"))
    ranges = saved(
        headers.filter("n_obs > 0")
        .withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_obs") - 1, step)))
        .withColumn("count", count)
        .withColumn("cost", F.col("count") * F.col("width") + OPEN_BYTES)
        .withColumn("piece", F.substring(F.md5("path"), 1, PIECE_DIGITS))
    )
    total = ranges.agg(F.sum("cost")).first()[0] or 0
    # Whole numbers: full enough for a bin, and no bin over its limit by more than one range.
    bins = max(1, -(-total // (range_bytes + OPEN_BYTES)))
    summed = running_total(ranges, [], "piece", ["path", "first"], F.col("cost"), "upto")
    number = F.floor((F.col("upto") - F.col("cost")) / F.lit(range_bytes + OPEN_BYTES)).cast("int")
    return summed.withColumn("bin", number).repartitionById(bins, "bin").drop("piece", "cost", "upto", "bin")


def read_ranges(ranges: DataFrame, schema: T.StructType) -> DataFrame:
    """The observations of every range."""
    types = pa.schema(
        [(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.float64()) for f in schema.fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                variables = tuple(Variable(**v) for v in row["variables"])
                layout = Layout(variables, row["start"], row["width"], row["n_obs"])
                yield from decode_range(row["path"], layout, row["first"], row["count"], types)

    return ranges.mapInArrow(run, schema)


def read_transport(spark: SparkSession, path: str, range_bytes: int = DEFAULT_RANGE_BYTES) -> DataFrame:
    """All files at or below ``path``; a column that a file lacks is all missing there."""
    headers = saved(read_headers(spark, path))
    schema = column_union(headers)
    if not schema.fields:
        raise ValueError(f"no transport files in {path}")
    return read_ranges(packed_ranges(headers, range_bytes), schema)


# --- The same as a plain source ---


class TransportReader(DataSourceReader):
    def __init__(self, schema: T.StructType, files: list[str], range_bytes: int):
        self.schema = schema
        self.files = files
        self.range_bytes = range_bytes

    def partitions(self) -> list[ObservationRange]:
        ranges = []
        for path, layout in zip(self.files, read_layouts(self.files)):
            step = max(1, self.range_bytes // max(1, layout.width))
            # A file without observations keeps one empty range: Spark asks for one at least.
            ranges += [
                ObservationRange(path, layout, first, min(step, layout.n_obs - first))
                for first in range(0, max(1, layout.n_obs), step)
            ]
        return ranges

    def read(self, partition: ObservationRange) -> Iterator[pa.RecordBatch]:
        layout = partition.layout
        types = pa.schema(
            [
                (f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.float64())
                for f in self.schema.fields
            ]
        )
        yield from decode_range(partition.path, layout, partition.first, partition.count, types)


class TransportSource(DataSource):
    """``spark.read.format("sas_transport").load(path)``; path is a file or a folder."""

    @classmethod
    def name(cls) -> str:
        return "sas_transport"

    def _files(self) -> list[str]:
        return list_files(self.options["path"])

    def schema(self) -> T.StructType:
        """All columns of all files, in order of first sight."""
        kinds: dict[str, bool] = {}
        files = self._files()
        for path, layout in zip(files, read_layouts(files)):
            for v in layout.variables:
                if kinds.setdefault(v.name, v.is_text) != v.is_text:
                    raise ValueError(f"{path}: {v.name} has another type than in earlier files")
        return T.StructType(
            [
                T.StructField(name, T.StringType() if is_text else T.DoubleType())
                for name, is_text in kinds.items()
            ]
        )

    def reader(self, schema: T.StructType) -> TransportReader:
        range_bytes = int(self.options.get("rangeBytes", DEFAULT_RANGE_BYTES))
        return TransportReader(schema, self._files(), range_bytes)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TransportSource)
