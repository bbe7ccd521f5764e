"""Open JSON documents: path reads with fallbacks, flags, and unparsable text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_text(doc: Column, paths: Sequence[str]) -> Column:
    """First path that holds a non-empty value, as text."""
    found = [F.get_json_object(doc, p) for p in paths]
    return F.coalesce(*[F.when(c != "", c) for c in found])


def path_double(doc: Column, paths: Sequence[str]) -> Column:
    return path_text(doc, paths).try_cast("double")


def or_raw(doc: Column) -> Column:
    """The document itself when it parses, else {"raw": text}."""
    wrapped = F.to_json(F.struct(doc.alias("raw")))
    parsed = F.try_parse_json(doc)
    return F.when(doc.isNull(), F.lit("{}")).when(parsed.isNull(), wrapped).otherwise(doc)


def any_flag(doc: Column, prefixes: Sequence[str] = ("has_", "is_")) -> Column:
    """Is any top-level boolean true whose key starts with one of the prefixes?"""
    fields = F.from_json(doc, "map<string,string>")
    start = "^(" + "|".join(prefixes) + ")"
    hits = F.map_filter(fields, lambda k, v: F.lower(k).rlike(start) & (v == "true"))
    return F.coalesce(F.size(F.map_keys(hits)) > 0, F.lit(False))
