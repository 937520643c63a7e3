"""Text clean-up and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space in Unicode.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def blank_to_null(text: Column) -> Column:
    """Strip white space at both ends; nothing left means missing."""
    return F.nullif(F.btrim(text, F.lit(WHITE_SPACE)), F.lit(""))


def title_case(text: Column) -> Column:
    """Capital after any character that is not a letter, small letters elsewhere."""
    runs = F.regexp_extract_all(
        text, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1)
    )
    return F.array_join(F.transform(runs, F.initcap), "")


def starts_with_any_case(text: Column, prefix: str) -> Column:
    return text.ilike(prefix + "%")


def text_sql(value: str) -> str:
    """A Python text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
