"""Name, size and percentage text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def file_extension(path: Column) -> Column:
    """Lower-case text after the last dot of the name; '' for dotfiles."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def one_decimal(x: Column) -> Column:
    """Fixed one-decimal text, ties to even."""
    return F.format_string("%.1f", F.bround(x, 1))


def percent_text(share: Column) -> Column:
    return F.concat(one_decimal(share * 100), F.lit("%"))


def size_text(nbytes: Column) -> Column:
    kb, mb, gb = 1024, 1024 ** 2, 1024 ** 3
    return (
        F.when(nbytes >= gb, F.concat(one_decimal(nbytes / gb), F.lit(" GB")))
        .when(nbytes >= mb, F.concat(one_decimal(nbytes / mb), F.lit(" MB")))
        .when(nbytes >= kb, F.concat(one_decimal(nbytes / kb), F.lit(" KB")))
        .otherwise(F.concat(nbytes.cast("string"), F.lit(" B")))
    )


def eta_text(secs: Column) -> Column:
    h, m, s = F.floor(secs / 3600), F.floor(secs % 3600 / 60), secs % 60
    return (
        F.when(secs == 0, F.lit("Unknown"))
        .when(h > 0, F.format_string("%02d:%02d:%02d", h.cast("long"), m.cast("long"), s.cast("long")))
        .otherwise(F.format_string("%02d:%02d", m.cast("long"), s.cast("long")))
    )
