"""Text-to-value expressions. None of them throws on dirty input, also under ANSI mode."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words a boolean text column may hold, and those that mean 1.
BOOL_WORDS = ("true", "false", "0", "1", "yes", "no", "y", "n")
TRUE_WORDS = ("true", "1", "yes", "y")

INT_PATTERN = r"^[+-]?[0-9]+$"
DECIMAL_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NUMBER_PATTERN = r"^(?i)\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)\s*$"
SPACES = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    """Text without outer white space.

    Trimming blanks is cheap; trimming a set of characters copies the text and is done only where
    another kind of white space is left at an end.
    """
    t = F.trim(c)
    others = [s for s in SPACES if s != " "]
    left_over = F.left(t, F.lit(1)).isin(*others) | F.right(t, F.lit(1)).isin(*others)
    return F.when(left_over, F.trim(t, F.lit(SPACES))).otherwise(t)


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_bool(c: Column) -> Column:
    return F.lower(c).isin(*BOOL_WORDS)


def bool_to_bit(c: Column) -> Column:
    return F.when(is_bool(c), F.lower(c).isin(*TRUE_WORDS).cast("tinyint"))


def is_int(c: Column) -> Column:
    return c.rlike(INT_PATTERN)


def is_decimal_not_int(c: Column) -> Column:
    return c.rlike(DECIMAL_PATTERN) & ~is_int(c)


def to_int(c: Column, kind: str) -> Column:
    """Integer or NULL. A failed ``try_cast`` costs an exception per value, so the pattern goes first."""
    return F.when(is_int(c), c.try_cast(kind))


def fits_int32(c: Column) -> Column:
    """True for an integer text whose absolute value is at most 2,147,483,647."""
    n = to_int(c, "bigint")
    return n.isNotNull() & (n >= -2147483647) & (n <= 2147483647)


def to_number(c: Column) -> Column:
    """Double, or NULL where the text is not a number; outer blanks are allowed, NaN counts as missing."""
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def number_or_zero(c: Column, text: bool = True) -> Column:
    """Double with 0 for missing or unreadable values; ``text=False`` for columns that are numbers already."""
    if text:
        return F.coalesce(to_number(c), F.lit(0.0))
    n = c.cast("double")
    return F.when(n.isNull() | F.isnan(n), 0.0).otherwise(n)


def first_truthy(*options: Column) -> Column:
    """First option that is neither NULL nor an empty string."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


def plain_number(c: Column) -> Column:
    """A number as text without exponent or trailing zeros, at most six decimals."""
    return F.regexp_replace(c.try_cast("decimal(38,6)").cast("string"), r"\.?0+$", "")


def literal_bigints(numbers: Sequence[int]) -> Column:
    """An array literal from one JSON text, which the optimizer folds; a call per element would be slow."""
    return F.from_json(F.lit(json.dumps(list(numbers))), "array<bigint>")
