"""String, hashing, canonical-text and time expressions (all native columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS_HASH = "0" * 64


def canonical_key(col: Column) -> Column:
    """Upper case with dashes as underscores: one spelling per engine or type."""
    return F.upper(F.translate(col, "-", "_"))


def file_name(path: Column) -> Column:
    """Last path component, either slash."""
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def shorten(col: Column, width: int) -> Column:
    """Cut to `width` characters and mark the cut."""
    return F.when(F.length(col) > width, F.concat(F.substring(col, 1, width), F.lit("..."))).otherwise(col)


def size_text(size: Column) -> Column:
    """Bytes as B, KB or MB."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(F.format_string("%.1f", size / 1024.0), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", size / (1024.0 * 1024.0)), F.lit(" MB")))
    )


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def lf_sha256(col: Column) -> Column:
    """Hash that ignores the platform's line ends."""
    return sha256(F.regexp_replace(col, "\r\n?", "\n"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Sorted keys, no blanks, nulls printed: the text every fingerprint hashes."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def trimmed_or_null(col: Column) -> Column:
    cleaned = F.trim(col)
    return F.when(cleaned != "", cleaned)


def safe_id(col: Column) -> Column:
    """Readable prefix of 48 safe characters plus 10 hash digits, so no two names collide."""
    cleaned = F.substring(F.regexp_replace(col, "[^A-Za-z0-9_-]", "_"), 1, 48)
    return F.concat(cleaned, F.lit("_"), F.substring(sha256(col), 1, 10))


def is_sha256(col: Column) -> Column:
    return col.rlike("^[0-9a-fA-F]{64}$")


def is_safe_path(path: Column) -> Column:
    """Relative, inside its root: not empty, no parent step, no absolute or drive prefix."""
    return F.coalesce(
        (path != "") & ~F.contains(path, F.lit("..")) & ~path.rlike(r"^[/\\]") & ~path.rlike("^[a-zA-Z]:"),
        F.lit(False),
    )


def mentions_any(col: Column, words: Sequence[str]) -> Column:
    """Case-insensitive: does the whole text contain one of the fixed words?"""
    return F.coalesce(F.lower(col).rlike("|".join(words)), F.lit(False))


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def parse_time(col: Column, formats: Sequence[str] = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss",
                                                      "yyyy-MM-dd'T'HH:mm:ss")) -> Column:
    """First of the formats that fits, else NULL."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats])


def first_present(named: Sequence[tuple[str, Column]], fallback: str) -> tuple[Column, Column]:
    """(value, which source won) over columns in order of preference."""
    value = F.coalesce(*[c for _, c in named])
    tag = F.lit(fallback)
    for name, col in reversed(named):
        tag = F.when(col.isNotNull(), F.lit(name)).otherwise(tag)
    return value, tag
