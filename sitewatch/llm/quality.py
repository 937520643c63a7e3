"""Quality rules, line first: clean the lines, then judge what is left.

Each line is held against rules for punctuation, navigation and boilerplate.
Failing lines are removed; a document that loses more than ``MOST_LOST`` of the
characters in its words is rejected. Base counts of the whole text come along.
Only DataFrame functions are used and nothing is shuffled: every count is an
array expression over the row's own words and lines.

Defined cases: a NULL text counts as empty; an empty text fails the base rule
(fewer than ``FEWEST_WORDS`` words) and is not kept; repeated rows are judged
alike; an empty table gives an empty table; other columns pass through. Equal
8-word windows are found by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm.common import WORD, let, table, text_or_empty

FEWEST_WORDS = 20
MOST_REPEATED_PERCENT = 30
WINDOW = 8
MOST_LOST = 0.6
#: Characters that count as symbols, and white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Phrases that mark a line as boilerplate, in any case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "privacy policy",
    "cookie policy",
    "terms of use",
    "terms of service",
    "lorem ipsum",
    "enable javascript",
    "click here to",
    "subscribe to our",
)
#: A line without an end mark must have this many words.
SHORT_LINE = 3
#: This many separators make a line a menu.
MENU_MARKS = 3
#: A line whose symbols exceed this share of its characters is no prose.
MOST_SYMBOLS = 0.1


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(_without(text, characters))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more."""

    def of_windows(hashes: Column) -> Column:
        def covered(places: Column) -> Column:
            steps = F.transform(
                places,
                lambda p, k: F.least(
                    F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))
                ),
            )
            return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

        def same(p: Column, other: Column) -> Column:
            return F.coalesce(p["h"] == other["h"], F.lit(False))

        def repeated(pairs: Column) -> Column:
            twice = F.filter(
                pairs,
                lambda p, k: same(p, F.get(pairs, k + 1)) | same(p, F.get(pairs, k - 1)),
            )
            return F.sort_array(F.transform(twice, lambda p: p["i"]))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            let(let(pairs, repeated), covered)
        )

    def of_words(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(w, i, WINDOW)),
        )
        return F.when(F.size(w) < WINDOW + 1, 0).otherwise(let(windows, of_windows))

    return let(words, of_words)


def line_fails(line: Column) -> Column:
    """True where a line with words breaks a rule."""
    low = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | low.contains(phrase)
    menu = _count_of(line, "|»›•") >= MENU_MARKS
    ended = F.rtrim(line).rlike("[.!?:;…\"'”’)\\]]$")
    short = ~ended & (F.size(F.split(F.trim(line), "[ \\t]+")) < SHORT_LINE)
    symbols = _count_of(line, SYMBOLS) > MOST_SYMBOLS * F.length(line)
    return boilerplate | menu | short | symbols


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts, ``cleaned_text``, ``lost_share``, ``base_failed``, ``kept``."""
    whole = text_or_empty(text)
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = df.withColumns({"_words": words_of(whole), "_lines": lines}).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(_without(whole, SPACES)).cast("long"),
            "n_symbols": _count_of(whole, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
            "cleaned_text": F.array_join(F.filter(F.col("_lines"), lambda x: ~line_fails(x)), "\n"),
        }
    )
    left = F.length(_without(F.col("cleaned_text"), SPACES))
    return (
        counted.drop("_words", "_lines")
        .withColumn(
            "base_failed",
            (F.col("n_words") < FEWEST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
        )
        .withColumn(
            "lost_share",
            F.when(F.col("word_chars") > 0, 1.0 - left / F.col("word_chars")).otherwise(0.0),
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= MOST_LOST))
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "lost_share",
    )
