"""Column expressions that the native operators share."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. lower() does just that, and faster, where every character is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+, which is Java's \\S+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
