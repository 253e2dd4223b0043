"""String helpers shared by the other column functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every Unicode white-space character; the plain SQL trim only knows the blank.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# The same as a class for regular expressions, and the end of a word: both much
# faster than Java's Unicode mode.
SPACE = "[" + "".join(rf"\u{ord(c):04x}" for c in WHITESPACE) + "]"
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"


def strip(col: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def null_to_blank(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs as a substring."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
