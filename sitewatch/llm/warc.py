"""WARC archives: written by tasks, read back by byte ranges.

Writing: every record is a gzip member of its own; a task writes one file under
an attempt's name and renames it when it is whole, so a lost task leaves no half
archive behind. Records with equal payloads of at least ``SHORTEST`` bytes are
written once, at the smallest id; the others revisit it.

Reading: a task gets a byte range. It looks for the gzip magic, takes a
candidate only if it decodes to a WARC header, and owns the records that start
inside its range, following the last one beyond the end. Ranges need no index.
Archives of other writers are read too: any record type, any record id, headers in
any case, with or without digests, several records in a member.

Nothing is lost in silence: a record whose header is whole and whose content is not
comes back with ``intact`` false and the reason in ``damage``; bytes of a file that no
record accounts for, as those of a broken header, are rows of ``lost_bytes``.

Folders may be on any file system that Arrow opens by URI (file, hdfs, s3, gs).

Defined cases: a NULL payload is empty; a NULL URL is an empty header; a record
with a NULL id is named by its place, comes back with a NULL page id and answers for
no other; repeated rows are records of their own (all rows of the smallest id and url
answer); an empty table writes nothing and reads nothing; columns other than those
named are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.llm.common import bounded_batches, rows_to_batches, salted_left_join, table
from sitewatch.session import result_only, saved, shared_folder

SHORTEST = 100
RANGE_BYTES = 16 * 1024 * 1024
#: Rows of a group of equal payloads meet its first record under so many keys.
SALTS = 16
MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 13
#: Decoded bytes by which a candidate is judged.
HEAD = 1 << 12
BLOCK = 1 << 20
WRITTEN = pa.schema([("path", pa.string()), ("length", pa.int64()), ("records", pa.int64())])
WRITTEN_DDL = "path string, length long, records long"
READ = pa.schema(
    [
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("place", pa.int32()),
        ("end", pa.int64()),
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("uri", pa.string()),
        ("date", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.string()),
        ("refers_to_page", pa.int64()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("intact", pa.bool_()),
        ("damage", pa.string()),
    ]
)
READ_DDL = (
    "path string, offset long, place int, end long, record_id string, page_id long, uri string, date string, "
    "record_type string, refers_to string, refers_to_page long, payload binary, payload_bytes long, "
    "payload_digest string, intact boolean, damage string"
)
PAGE_URN = re.compile(r"<urn:page:(-?\d+)>")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


def _names() -> dict[str, Column]:
    return {
        "page_id": F.col("page_id"),
        # Never NULL, for joins.
        "key": F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        "url": F.coalesce("url", F.lit("")),
    }


def with_revisits(pages: DataFrame) -> DataFrame:
    """Rows (page_id, key, url, digest, length, refers_to) of (page_id, url, html).

    Groups are counted before the shuffle; only groups of two or more are met
    again, under ``SALTS`` keys each, by rows without payload.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    narrow = saved(
        pages.select(
            *(c.alias(name) for name, c in _names().items()),
            F.sha2(payload, 256).alias("digest"),
            F.octet_length(payload).cast("long").alias("length"),
        )
    )
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    groups = (
        narrow.filter(F.col("length") >= SHORTEST)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(named).alias("_first"))
        .filter((F.col("_n") > 1) & F.col("_first").isNotNull())
    )
    joined = salted_left_join(narrow, groups.drop("_n"), ["digest"], F.struct("key", "url"), SALTS)
    same = F.col("page_id").eqNullSafe(F.col("_first.page_id")) & (F.col("url") == F.col("_first.url"))
    again = F.col("_first").isNotNull() & ~same
    return joined.select(
        "page_id", "key", "url", "digest", "length", F.when(again, F.col("_first.page_id")).alias("refers_to")
    )


def _record(urn: str, url: str, date: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{urn}>",
        f"WARC-Date: {date}",
        "Content-Type: text/html",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    return packer.compress(text) + packer.flush()


def write_archives(pages: DataFrame, folder: str, date: datetime | None = None) -> DataFrame:
    """Write (page_id, url, html) below ``folder``; rows (path, length, records).

    ``date`` is when the pages were taken; now, if it is not known.
    """
    taken = (date or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    facts = with_revisits(pages).select("key", "url", "digest", "refers_to")
    rows = pages.select(
        *(c.alias(name) for name, c in _names().items()), F.coalesce(F.col("html"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2("html", 256))
    ready = rows.join(facts.dropDuplicates(["key", "url", "digest"]), ["key", "url", "digest"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = _open(folder)
        name = f"{base}/part-{context.partitionId():06d}.warc.gz"
        held = f"{name}.{context.taskAttemptId()}"
        out, count, size = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(held)
                page = row["page_id"]
                urn = f"urn:row:{context.partitionId()}-{count}" if page is None else f"urn:page:{page}"
                member = _record(
                    urn, row["url"], taken, row["html"].encode(), row["digest"], row["refers_to"]
                )
                out.write(member)
                count, size = count + 1, size + len(member)
        if out is not None:
            out.close()
            fs.move(held, name)
            path = f"{folder}/part-{context.partitionId():06d}.warc.gz"
            yield from rows_to_batches(iter([(path, size, count)]), WRITTEN)

    columns = ("page_id", "url", "html", "digest", "refers_to")
    return saved(bounded_batches(ready).select(*columns).mapInArrow(write, WRITTEN_DDL))


def _header(text: bytes) -> dict[str, str]:
    """Named fields, names in lower case; a folded line goes on the one before."""
    fields: dict[str, str] = {}
    last = None
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            fields[last] = value.strip()
    return fields


class _Blocks:
    """Reads of a file at any place, a block of it held at a time."""

    def __init__(self, handle):
        self.handle, self.begin, self.block = handle, 0, b""

    def at(self, place: int, length: int) -> bytes:
        inside = place - self.begin
        if not 0 <= inside <= len(self.block) - length:
            self.handle.seek(place)
            self.block, self.begin, inside = self.handle.read(max(BLOCK, length)), place, 0
        return self.block[inside : inside + length]


class _Member:
    """One gzip member from ``start`` on, decoded as far as it is asked for."""

    def __init__(self, blocks: _Blocks, start: int):
        self.blocks, self.place = blocks, start
        self.unpack = zlib.decompressobj(31)

    def more(self, most: int = 0) -> bytes:
        """The next bytes, ``most`` of them at most."""
        chunk = self.unpack.unconsumed_tail
        if not chunk:
            chunk = self.blocks.at(self.place, CHUNK)
            if not chunk:
                raise zlib.error("the file ends inside a member")
            self.place += len(chunk)
        data = self.unpack.decompress(chunk, most)
        if self.unpack.eof:
            self.place -= len(self.unpack.unused_data)
        return data

    def whole(self, begun: bytes) -> bytes:
        parts = [begun]
        while not self.unpack.eof:
            parts.append(self.more())
        return b"".join(parts)


def _candidates(blocks: _Blocks, start: int, stop: int) -> Iterator[int]:
    """Offsets in [start, stop) where the gzip magic stands."""
    place = start
    while place < stop:
        chunk = blocks.at(place, CHUNK + len(MAGIC) - 1)
        at = chunk.find(MAGIC)
        while 0 <= at < min(CHUNK, stop - place):
            yield place + at
            at = chunk.find(MAGIC, at + 1)
        place += CHUNK


def records_in(handle, start: int, stop: int) -> Iterator[tuple[int, int, bytes, str | None]]:
    """(offset, end, text, damage) of the members with records that start in [start, stop).

    ``end`` is where the next member may begin. Of a member that breaks off, ``text`` is
    what could be decoded, and the search goes on inside it.
    """
    blocks, place = _Blocks(handle), start
    while place < stop:
        for offset in _candidates(blocks, place, stop):
            member, text = _Member(blocks, offset), b""
            try:
                while len(text) < 7 and not member.unpack.eof:
                    text += member.more(HEAD)
            except zlib.error:
                pass
            if not text.startswith(b"WARC/1."):
                continue
            damage = None
            try:
                text = member.whole(text)
            except zlib.error as error:
                damage = str(error)
            # A whole member ends where the next begins; a broken one hides no other.
            place = member.place if damage is None else offset + len(MAGIC)
            yield offset, member.place, text, damage
            break
        else:
            return


def _split(text: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(fields, content, damage) of the records in a member, one as a rule."""
    while text:
        head, mark, rest = text.partition(b"\r\n\r\n")
        fields = _header(head)
        length = fields.get("content-length", "")
        if not mark or not length.isdigit():
            yield fields, rest, "the header breaks off" if not mark else "no content length"
            return
        content = rest[: int(length)]
        yield fields, content, None if len(content) == int(length) else "content shorter than told"
        text = rest[int(length) :].lstrip(b"\r\n")
        if text and not text.startswith(b"WARC/1."):
            return


def _differs(told: str, content: bytes) -> bool:
    """Whether a digest as told, in hex or base 32, is known to be another than the content's."""
    kind, _, value = told.partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return False
    found = hashlib.new(kind.lower(), content).digest()
    if value.lower() == found.hex():
        return False
    try:
        return base64.b32decode(value.upper() + "=" * (-len(value) % 8)) != found
    except binascii.Error:
        return True


def _page(value: str | None) -> int | None:
    named = PAGE_URN.fullmatch(value or "")
    return int(named[1]) if named else None


def _told(fields: dict[str, str], content: bytes, damage: str | None, payloads: bool) -> tuple:
    """Columns from ``record_id`` on."""
    kind = fields.get("warc-type")
    named = fields.get("warc-payload-digest", "")
    revisit = kind == "revisit"
    http = fields.get("content-type", "").lower().startswith("application/http")
    if damage is None and _differs(fields.get("warc-block-digest", ""), content):
        damage = "another block digest than told"
    if damage is None and not revisit and not http and _differs(named, content):
        damage = "another payload digest than told"
    if revisit:
        size = fields.get("x-payload-length", "")
        length, digest = int(size) if size.isdigit() else None, named.removeprefix("sha256:") or None
    else:
        length, digest = len(content), hashlib.sha256(content).hexdigest()
    identity, target = fields.get("warc-record-id"), fields.get("warc-refers-to")
    return (
        identity,
        _page(identity),
        fields.get("warc-target-uri", ""),
        fields.get("warc-date"),
        kind,
        target,
        _page(target),
        content if payloads and not revisit and damage is None else None,
        length if damage is None else None,
        digest if damage is None else None,
        damage is None,
        damage,
    )


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Records of archives (path, length); ``payloads=False`` leaves those NULL.

    The payload of a record is its block; ``payload_digest`` is the SHA-256 of that, or of
    a revisit what the record tells. ``place`` counts the records of one member.
    """
    ranges = files.filter(F.col("length") > 0).select(
        "path",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"),
        "length",
    )
    spread = ranges.withColumn("stop", F.least(F.col("start") + range_bytes, F.col("length"))).repartition(
        "path", "start"
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in batch.to_pylist():
                fs, path = _open(part["path"])
                with fs.open_input_file(path) as handle:
                    for offset, end, text, broken in records_in(handle, part["start"], part["stop"]):
                        for place, (fields, content, damage) in enumerate(_split(text)):
                            yield (part["path"], offset, place, end, *_told(fields, content, broken or damage, payloads))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows_to_batches(rows(batches), READ, 200)

    return spread.select("path", "start", "stop").mapInArrow(read, READ_DDL)


def lost_bytes(files: DataFrame, records: DataFrame) -> DataFrame:
    """Stretches (path, start, end) of the files that no intact record accounts for."""
    known = records.filter("intact").select("path", "offset", "end").distinct()
    edges = known.unionByName(files.select("path", F.col("length").alias("offset"), F.col("length").alias("end")))
    # Rows of one file: as many as it has records.
    before = Window.partitionBy("path").orderBy("offset", "end").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.max("end").over(before), F.lit(0).cast("long"))
    return edges.withColumn("start", start).filter(F.col("start") < F.col("offset")).select("path", "start", F.col("offset").alias("end"))


@result_only
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), shared_folder(spark))
    return read_archives(files, payloads=False).select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to_page").alias("refers_to"),
    )
