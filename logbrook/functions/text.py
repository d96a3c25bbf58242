"""Small column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last extension with its dot, or empty; a leading dot starts a name, not an extension."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.when(suffix(path) != "", F.substr(name, F.lit(1), F.length(name) - F.length(suffix(path)))).otherwise(name)


def human_size(size: Column) -> Column:
    """One decimal, ties to even."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit("B")))
        .when(size < 1024 * 1024, F.format_string("%.1fKB", F.bround(size / F.lit(1024.0), 1)))
        .otherwise(F.format_string("%.1fMB", F.bround(size / F.lit(1024.0 * 1024.0), 1)))
    )


def iso_from_millis(ms: Column) -> Column:
    """RFC 3339 in UTC, with a fraction only where there is one."""
    micros = (ms % 1000).cast("int") * 1000
    whole = F.date_format(F.timestamp_seconds(F.floor(ms / 1000)), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(micros > 0, F.format_string(".%06d", micros)).otherwise(F.lit("")), F.lit("+00:00"))
