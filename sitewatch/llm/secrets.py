"""Secret scans: fixed forms, and strings that pass a battery of randomness tests.

Three forms are found by pattern (assignments, access keys, hex runs). Beyond
them, every run of 20 or more key characters is given the smallest alphabet that
holds it, and tested against uniform random strings over that alphabet: chi-squared
for the use of the letters, Wald-Wolfowitz runs above and below the middle,
and lag-one serial correlation, joined by Fisher's method into one p value.

Random strings have p values spread evenly over 0..1; words and names pile up
near 0. So, within a class of alphabet and length, the upper half tells how many
are random, and the lowest bar is taken at which no more than ``MOST_FALSE`` of
the strings above it are expected to be something else. Strings of one length
class never set the bar of another, since short ones prove less. The counts
behind the bars cover all texts, each distinct string once, so that copies of one
do not set the bar of the others: one pass counts (class, p), one scans.

Defined cases: a NULL text is empty; an empty text has no spans; places count
code points, end exclusive; repeated rows are scanned alike; an empty table
gives an empty table. Every class is counted with ``PRIOR`` random strings added to it,
spread evenly as theory has them: they weigh nothing in a class of thousands, and in a
class of a few strings, which cannot tell its share of random ones, they hold the bar
low until enough others speak against it. Other columns pass through; one named
``spans`` is replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm.common import add_columns, bounded_batches, rows_to_batches, slices, table
from sitewatch.session import result_only

#: The three forms, their kinds in order, and the shortest length each.
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
SHORTEST_ASSIGN, SHORTEST_ACCESS = 12, 18

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Alphabets from the smallest on, each in the order of its values.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (
    ("hex", DIGITS + "abcdef"),
    ("upper hex", DIGITS + "ABCDEF"),
    ("lower", LOWER),
    ("base32", UPPER + "234567"),
    ("base36", LOWER + DIGITS),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", UPPER + LOWER + DIGITS + "+/-_"),
)
PLACES = [(name, {c: i for i, c in enumerate(letters)}) for name, letters in ALPHABETS]
MOST_FALSE = 0.05
BINS = 50
#: Random strings that each class is credited with.
PRIOR = 40
#: Distinct strings that a task holds before it hands them on.
MOST_HELD = 50_000
#: Never accept below this p value, however few other strings there are.
LOWEST_BIN = 1


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def alphabet_of(token: str) -> tuple[str, dict[str, int]]:
    used = set(token)
    for name, places in PLACES:
        if used <= places.keys():
            return name, places
    raise ValueError("not a candidate")


def battery(token: str) -> tuple[str, float]:
    """The alphabet of a candidate and its joint p value as a random string."""
    body = token.rstrip("=")
    name, places = alphabet_of(body)
    values = [places[c] for c in body]
    n, k = len(values), len(places)
    expected = n / k
    counts = Counter(values)
    chi = sum((c - expected) ** 2 for c in counts.values()) / expected
    chi += (k - len(counts)) * expected
    f = k - 1
    z = ((chi / f) ** (1 / 3) - (1 - 2 / (9 * f))) / math.sqrt(2 / (9 * f))
    uniform = _upper(z)
    above = [2 * v >= k for v in values]
    high = sum(above)
    low = n - high
    if high and low:
        runs = 1 + sum(a != b for a, b in zip(above, above[1:]))
        mean = 2 * high * low / n + 1
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        in_runs = 2 * _upper(abs(runs - mean) / spread)
    else:
        in_runs = 2.0 ** (1 - n)
    middle = sum(values) / n
    around = [v - middle for v in values]
    total = sum(a * a for a in around)
    if total > 0:
        lagged = sum(a * b for a, b in zip(around, around[1:])) / total
        serial = 2 * _upper(abs(lagged) * math.sqrt(n))
    else:
        serial = 2.0 ** (1 - n)
    half = -sum(math.log(max(min(p, 1.0), 1e-300)) for p in (uniform, in_runs, serial))
    return name, math.exp(-half) * (1 + half + half * half / 2)


def length_class(token: str) -> int:
    return int(2 * math.log2(len(token.rstrip("="))))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, place of the kind, end) of the three fixed forms."""
    spans = [
        (m.start(), 0, m.end())
        for m in ASSIGN.finditer(text)
        if m.end(1) - m.start(1) >= SHORTEST_ASSIGN
    ]
    if "AKIA" in text:
        spans += [
            (m.start(), 1, m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= SHORTEST_ACCESS
        ]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def candidates(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Runs of key characters that no base span holds."""
    # Both lists rise, so one walk along them does: of the spans that begin no later
    # than a run, the one that reaches furthest holds it, or none does.
    spans = sorted((start, end) for start, _, end in base)
    place, reach = 0, -1
    for m in CANDIDATE.finditer(text):
        while place < len(spans) and spans[place][0] <= m.start():
            reach = max(reach, spans[place][1])
            place += 1
        if m.end() > reach:
            yield m.start(), m.end(), m.group()


def bars(counts: dict[tuple[str, int], list[int]]) -> dict[tuple[str, int], int]:
    """The lowest accepted bin of each (alphabet, length class).

    Random strings are even over the bins, so the upper half tells how many there are
    in all. The bar is the lowest at which what is accepted beyond their share is at most
    ``MOST_FALSE`` of it.
    """
    out = {}
    for key, seen in counts.items():
        used = [n + PRIOR / BINS for n in seen]
        even = min(sum(used), 2 * sum(used[BINS // 2 :]))
        out[key] = BINS
        for low in range(LOWEST_BIN, BINS):
            accepted = sum(used[low:])
            if accepted - even * (1 - low / BINS) <= MOST_FALSE * accepted:
                out[key] = low
                break
    return out


def _bin(p: float) -> int:
    return min(BINS - 1, int(p * BINS))


def count_classes(docs: DataFrame, text: str = "text") -> dict[tuple[str, int], list[int]]:
    """How many distinct candidates of all texts fall into each (class, bin)."""
    schema = pa.schema([("name", pa.string()), ("size", pa.int32()), ("bin", pa.int32()), ("token", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[str, int, int]] = {}
        for batch in slices(batches):
            for value in batch.column(0).to_pylist():
                value = value or ""
                for _, _, token in candidates(value, base_spans(value)):
                    body = hashlib.blake2b(token.rstrip("=").encode(), digest_size=8).digest()
                    known = int.from_bytes(body, "big", signed=True)
                    if known not in seen:
                        name, p = battery(token)
                        seen[known] = name, length_class(token), _bin(p)
            if len(seen) >= MOST_HELD:
                yield from rows_to_batches(((*key, known) for known, key in seen.items()), schema)
                seen = {}
        yield from rows_to_batches(((*key, known) for known, key in seen.items()), schema)

    counted = (
        bounded_batches(docs)
        .select(text)
        .mapInArrow(count, "name string, size int, bin int, token long")
        .groupBy("name", "size", "bin")
        .agg(F.count_distinct("token").alias("n"))
    )
    out: dict[tuple[str, int], list[int]] = {}
    # At most alphabets x length classes x bins rows.
    for row in counted.collect():
        out.setdefault((row["name"], row["size"]), [0] * BINS)[row["bin"]] = row["n"]
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans``, an array of (kind, start, end, p)."""
    lowest = bars(count_classes(docs, text))
    kind = "array<struct<kind: string, start: int, end: int, p: double>>"
    element = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
    )

    def find(batch: pa.RecordBatch) -> list[pa.Array]:
        found = []
        for value in batch.column(text).to_pylist():
            value = value or ""
            base = base_spans(value)
            spans = [(start, place, end, None) for start, place, end in base]
            for start, end, token in candidates(value, base):
                name, p = battery(token)
                if _bin(p) >= lowest.get((name, length_class(token)), BINS):
                    spans.append((start, 3, end, p))
            spans.sort(key=lambda s: s[:3])
            found.append([{"kind": KINDS[k], "start": s, "end": e, "p": p} for s, k, e, p in spans])
        return [pa.array(found, type=element)]

    return add_columns(docs, {"spans": (kind, element)}, find)


@result_only
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        number("random").alias("n_random"),
    )
