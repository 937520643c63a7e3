"""Toxicity: a weighted pattern grammar over clauses.

Five small transducers read the words of a clause in step: insult, threat,
target, negation and reported speech. Their composition is one machine whose
states are the tuples of theirs; it weighs what the first two emit by the state
of the others, so "idiot" counts for less after "not" or inside "she said", for more beside
"you", and a threat counts only with someone it is meant for. Matched clauses
are scored, not single words, and a document's score is a logistic function of
its matched clauses.

The fixed word lists below hold for any corpus. The insult transducer also takes words and stems
learned from labelled rows, weighted by log odds, and the logistic
function is fitted on them. Both use at most ``SAMPLE`` labelled rows, drawn by a
hash of the id: this is the bound on what the driver and every task hold of the
labels. Scoring reads each text once and shuffles nothing.

Defined cases: a NULL or empty text has no clauses and gets the score of a text
without matches; NULL labels are left out; of several labels for an id the
highest holds; without labels the fixed lists and ``PRIOR`` decide; repeated rows score alike;
an empty table gives an empty table. Other columns pass through; those named like the added ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm.common import add_columns, bounded_batches, rows_to_batches, slices, table
from sitewatch.session import result_only

SAMPLE = 20_000
#: Learned entries: at least this G-squared, at most so many, stems of these lengths.
LEAST_G2 = 24.0
MOST_ENTRIES = 4_096
STEMS = (4, 5, 6)
#: Weights of (intercept, log of summed scores, highest score) without labels.
PRIOR = (-2.0, 2.0, 0.5)

TOKEN = re.compile(r"\w+")
CLAUSE = re.compile(r"[.!?;:\n]+")
#: Words of the four classes in four languages, and insults with a weight of 2.
INSULTS = frozenset(
    "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile "
    "idiota imbécil estúpido idiotin dummkopf abschaum connard crétin ordure".split()
)
THREATS = frozenset(
    "kill hurt destroy burn beat shoot stab die töten umbringen verletzen tuer frapper matar herir".split()
)
TARGETS = frozenset(
    "you your youre u he she they them him her dich du euch sie toi vous te tu usted ustedes vosotros".split()
)
NEGATIONS = frozenset("not never no nobody isn aren wasn don nicht kein keine pas jamais ne nunca".split())
REPORTS = frozenset(
    "said says say wrote writes called claimed reported quoted sagte schrieb berichtete dit écrit "
    "dijo escribió informó".split()
)
SEED_WEIGHT = 2.0
THREAT_WEIGHT = 3.0

# --- The transducers ---
# A transducer is (first state, step); step(state, symbol) gives the next state
# and what it emits for this symbol. Symbols: I insult, T threat, Y target,
# N negation, R report, . any other word.


def _insult(state: int, symbol: str) -> tuple[int, float]:
    """Emits 1 for an insult, a little more for each further one in the clause."""
    return (min(state + 1, 2), 1.0 + 0.25 * state) if symbol == "I" else (state, 0.0)


def _threat(state: int, symbol: str) -> tuple[int, float]:
    """0: nothing, 1: target seen, 2-4: threat waits for its target."""
    if symbol == "T":
        return (1, 1.0) if state == 1 else (4, 0.0)
    if symbol == "Y":
        return (1, 1.0) if state > 1 else (1, 0.0)
    return (state - 1 if state > 2 else 0 if state == 2 else state), 0.0


def _target(state: int, symbol: str) -> tuple[int, float]:
    return (1, 1.0) if symbol == "Y" else (state, 1.5 if state else 1.0)


def _negation(state: int, symbol: str) -> tuple[int, float]:
    """In force for the three words after a negation."""
    return (3, 1.0) if symbol == "N" else (max(state - 1, 0), 0.25 if state else 1.0)


def _report(state: int, symbol: str) -> tuple[int, float]:
    return (1, 1.0) if symbol == "R" else (state, 0.5 if state else 1.0)


MACHINES = (_insult, _threat, _target, _negation, _report)
SYMBOLS = "ITYNR."


def compose() -> dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], float, float]]:
    """All reachable states: (state, symbol) -> next, insult weight, threat weight."""
    first = (0,) * len(MACHINES)
    machine, waiting, seen = {}, [first], {first}
    while waiting:
        state = waiting.pop()
        for symbol in SYMBOLS:
            steps = [step(s, symbol) for step, s in zip(MACHINES, state)]
            following = tuple(s for s, _ in steps)
            insult, threat, target, negation, report = (w for _, w in steps)
            machine[state, symbol] = (
                following,
                insult * target * negation * report,
                threat * negation * report,
            )
            if following not in seen:
                seen.add(following)
                waiting.append(following)
    return machine


GRAMMAR = compose()
START = (0,) * len(MACHINES)


@dataclass
class Lexicon:
    """Weights of insult words and stems; the rest of the grammar is fixed."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.known: dict[str, tuple[str, float]] = {}

    def symbol(self, token: str) -> tuple[str, float]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[token] = self._symbol(token)
        return found

    def _symbol(self, token: str) -> tuple[str, float]:
        weight = max(
            [self.words.get(token, 0.0), SEED_WEIGHT if token in INSULTS else 0.0]
            + [self.stems.get(token[:n], 0.0) for n in STEMS if len(token) >= n]
        )
        if weight > 0:
            return "I", weight
        for symbol, words in (("T", THREATS), ("N", NEGATIONS), ("R", REPORTS), ("Y", TARGETS)):
            if token in words:
                return symbol, THREAT_WEIGHT if symbol == "T" else 0.0
        return ".", 0.0


def clause_score(tokens: list[str], lexicon: Lexicon) -> float:
    """What the composed machine emits over one clause."""
    state, score = START, 0.0
    for token in tokens:
        symbol, weight = lexicon.symbol(token)
        state, insult, threat = GRAMMAR[state, symbol]
        if symbol == "I":
            score += weight * insult
        score += THREAT_WEIGHT * threat
    return score


def matched_clauses(text: str, lexicon: Lexicon) -> list[tuple[str, float]]:
    """Clauses with a score above 0, in order."""
    low = text.lower()
    symbol = lexicon.symbol
    if not any(symbol(token)[1] for token in TOKEN.findall(low)):
        return []
    scored = ((clause, clause_score(TOKEN.findall(clause), lexicon)) for clause in CLAUSE.split(low))
    return [(clause, score) for clause, score in scored if score > 0]


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float]:
    scores = [score for _, score in matched_clauses(text or "", lexicon)]
    return math.log1p(sum(scores)), max(scores, default=0.0)


def probability(x: tuple[float, float], beta: tuple[float, ...]) -> float:
    z = beta[0] + beta[1] * x[0] + beta[2] * x[1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# --- Learning ---


def held_out(key: Column) -> Column:
    """True for the fifth of the ids from which no label is learned."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of at most ``SAMPLE`` labelled ids that are not held out."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("_toxic"))
    )
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # Bounded by SAMPLE rows of two numbers.
    return bounded_batches(docs).select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "_toxic")


def _count_entries(rows: DataFrame) -> DataFrame:
    """(entry, stem, toxic, clean): in how many texts a word or stem occurs."""
    schema = pa.schema(
        [("entry", pa.string()), ("stem", pa.bool_()), ("toxic", pa.int64()), ("clean", pa.int64())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("_toxic").to_pylist()):
                words = set(TOKEN.findall((text or "").lower()))
                stems = {word[:n] for word in words for n in STEMS if len(word) > n}
                seen[toxic].update((w, False) for w in words)
                seen[toxic].update((s, True) for s in stems)
            for entry in seen[0].keys() | seen[1].keys():
                yield (*entry, seen[1][entry], seen[0][entry])

        for batch in slices(batches):
            yield from rows_to_batches(rows_of(batch), schema, 50_000)

    return (
        rows.filter(F.col("_toxic").isin(0, 1))
        .mapInArrow(count, "entry string, stem boolean, toxic long, clean long")
        .groupBy("entry", "stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and stems that tell toxic texts from the rest, by log odds."""
    totals = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon()
    seen = F.col("toxic") + F.col("clean")
    share = bad / (bad + good)

    def part(n: Column, p: float) -> Column:
        return F.when(n > 0, 2 * n * F.log(n / (seen * p))).otherwise(0.0)

    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    entries = (
        _count_entries(rows)
        .withColumn("g2", part(F.col("toxic"), share) + part(F.col("clean"), 1 - share))
        .withColumn("weight", odds)
        .filter((F.col("g2") >= LEAST_G2) & (F.col("weight") > 1.5))
        .orderBy(F.desc("g2"), "entry", "stem")
        .limit(MOST_ENTRIES)
        .collect()
    )
    return Lexicon(
        {r["entry"]: r["weight"] for r in entries if not r["stem"]},
        {r["entry"]: r["weight"] for r in entries if r["stem"]},
    )


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a ridge on the slopes."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    ridge = np.diag([1e-6] + [penalty] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - y) + ridge @ beta
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


@dataclass
class Model:
    lexicon: Lexicon
    beta: tuple[float, ...] = PRIOR


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels).persist()
    lexicon = learn_lexicon(rows)
    schema = pa.schema([("id", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("toxic", pa.int32())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts, toxic = (batch.column(c).to_pylist() for c in ("doc_id", "text", "_toxic"))
            yield from rows_to_batches(
                ((i, *features(t, lexicon), y) for i, t, y in zip(ids, texts, toxic)), schema
            )

    measured = rows.filter(F.col("_toxic").isin(0, 1)).mapInArrow(measure, "id long, a double, b double, toxic int")
    # Three numbers for each of at most SAMPLE ids, however many rows an id has.
    got = measured.groupBy("id").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.max("toxic").alias("toxic"))
    got = got.orderBy("id").toPandas()
    rows.unpersist()
    if got["toxic"].nunique() < 2:
        return Model(lexicon)
    return Model(lexicon, fit(got[["a", "b"]].to_numpy(), got["toxic"].to_numpy(dtype=float)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score``, ``n_clauses`` and ``worst_clause``."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        scores, counts, worst = [], [], []
        for value in batch.column(text).to_pylist():
            clauses = matched_clauses(value or "", model.lexicon)
            total = math.log1p(sum(s for _, s in clauses))
            top = max(clauses, key=lambda c: c[1], default=(None, 0.0))
            scores.append(probability((total, top[1]), model.beta))
            counts.append(len(clauses))
            worst.append(top[0])
        return [pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(worst, pa.string())]

    added = {
        "score": ("double", pa.float64()),
        "n_clauses": ("int", pa.int32()),
        "worst_clause": ("string", pa.string()),
    }
    return add_columns(docs, added, run)


@result_only
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_clauses",
    )
