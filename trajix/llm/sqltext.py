"""Column expressions on texts that several native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space and the controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone; the quick path is for texts of ASCII, where lower() does just that."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK_RUN), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body, or a lambda in it, uses it."""
    return F.transform(F.array(value), body)[0]


def hash_128(c: Column) -> list[Column]:
    """Two independent 64-bit hashes; together they stand for the value."""
    return [F.xxhash64(F.lit(1), c), F.xxhash64(F.lit(2), c)]
