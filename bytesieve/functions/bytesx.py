"""Byte-string expressions.

Search and prefix tests run straight on BINARY columns.  Spark has no binary
``replace`` or ``split``, so those go through ISO-8859-1 text, where one byte
is one character in both directions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def blob(value: bytes) -> Column:
    """A BINARY literal."""
    return F.lit(bytearray(value))


def has(data: Column, pattern: bytes) -> Column:
    """True where ``pattern`` occurs in the BINARY column."""
    return F.contains(data, blob(pattern))


def has_at(data: Column, pattern: bytes, offset: int = 0) -> Column:
    """True where ``pattern`` sits exactly at ``offset``."""
    if offset == 0:
        return F.startswith(data, blob(pattern))
    return F.substring(data, offset + 1, len(pattern)) == blob(pattern)


def first_signature(data: Column, signatures: Iterable, default: str) -> Column:
    """Code of the first matching signature: one code-generated CASE, no join."""
    branches = [(has_at(data, s.pattern, s.offset), s.file_type) for s in signatures]
    out = F.lit(default)
    for cond, code in reversed(branches):
        out = F.when(cond, F.lit(code)).otherwise(out)
    return out


def latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def from_latin1(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def latin1_lit(value: bytes) -> Column:
    return F.lit(value.decode("latin-1"))


def remove_all(text: Column, pattern: bytes) -> Column:
    """Drop every non-overlapping occurrence, left to right, in one pass."""
    return F.replace(text, latin1_lit(pattern), F.lit(""))


def byte_at(data: Column, offset: int) -> Column:
    """Unsigned value of one byte (0 past the end)."""
    return F.conv(F.hex(F.substring(data, offset + 1, 1)), 16, 10).cast("long")


def le_uint(data: Column, offset: int, width: int) -> Column:
    """Little-endian unsigned integer of ``width`` bytes."""
    out = byte_at(data, offset)
    for i in range(1, width):
        out = out + byte_at(data, offset + i) * F.lit(256 ** i)
    return out


def byte_values(text: Column) -> Column:
    """Byte values of latin-1 text as ARRAY<INT>, one pass over the text."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))
