"""Column expressions on text that the operators share.  Flags and classes are ASCII, so SQL engines agree on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Pieces between white space, without empty ones."""
    return F.array_remove(F.split(text, r"[ \t\n\r\f\x0B]+"), "")


def words(text: Column) -> Column:
    """Lower-case ASCII words of letters, digits and underscores."""
    return F.array_remove(F.split(F.lower(text), r"[^A-Za-z0-9_]+"), "")


def holds(low: Column, word: str) -> Column:
    """`word` (small letters) is among words(): it is searched without splitting the text, and its borders only where it occurs."""
    return low.contains(word) & low.rlike(f"{word}(?<![A-Za-z0-9_]{word})(?![A-Za-z0-9_])")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def truncated(text: Column, n: int) -> Column:
    """At most n characters, the last three of them dots where something was cut off."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 3)), F.lit("..."))).otherwise(text)


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, 2, 1 << 30)))


def score(present: Column, total: Column) -> Column:
    """Percentage, half to even; 0 of nothing is 0."""
    return F.when(total == 0, F.lit(0)).otherwise(F.bround(F.lit(100.0) * present / total, 0)).cast("int")
