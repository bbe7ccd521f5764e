"""License scan over intake notes and `source_license` texts: a positional rare-token index."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pieces, whole_text

# Word separators on texts whose A-Z have not been lowered yet.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


class Template(NamedTuple):
    """A licence text: its words, the phrases that must stand unchanged, and whether it is a base phrase."""
    label: str
    text: str
    mandatory: tuple[str, ...] = ()
    base: bool = False


# Base phrases with their labels, then names and opening notices of public licences.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("agpl", "affero general public license"),
    Template("lgpl", "lesser general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("gpl-2.0", "general public license version 2"),
    Template("gpl-3.0", "general public license version 3"),
    Template("mpl", "mozilla public license"),
    Template("isc", "isc license"),
    Template("bsd", "bsd license"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by", "cc by 4 0"),
    Template("cc-by-sa", "cc by sa 4 0"),
    Template("cc-by-nc", "cc by nc 4 0"),
    Template("cc0", "cc0 1 0 universal"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
             ("permission is hereby granted free of charge",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("with or without fee",)),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
             ("apache license version 2 0",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
             ("free software", "gnu general public license")),
    Template("proprietary", "all rights reserved"),
)


def _lowered(word: Column) -> Column:
    """Lower-cased word; one whose length in bytes changes (a non-ASCII capital) is left as it is."""
    low = F.lower(word)
    return F.when(F.octet_length(low) == F.octet_length(word), low).otherwise(word)


def document_frequency(evidence: DataFrame, vocabulary: Sequence[str], text_col: str = "intake_notes") -> tuple[int, dict[str, int]]:
    """(records, records with each licence word), over all records. At most one number per licence word reaches the driver."""
    known = F.array(*[F.lit(w) for w in sorted(vocabulary)])
    words = pieces(whole_text(F.col(text_col)), SEPARATORS)
    seen = F.array_intersect(F.transform(words, _lowered), known)
    rows = evidence.select(F.explode(F.array_append(seen, F.lit(""))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    df = {row["word"]: row["n"] for row in rows}
    return df.pop("", 0), df


def rare_words(template: Template, idf: Mapping[str, float], most: int) -> list[tuple[str, int]]:
    """The `most` highest-IDF words, with their offsets, among those that must stand (ties: the earlier word)."""
    words = template.text.split()
    order = sorted(must_stand(template), key=lambda i: (-idf[words[i]], i))
    return [(words[i], i) for i in sorted(order[:most])]


def _phrase_places(words: list[str], phrase: str) -> list[int]:
    """Offsets of the words of a key phrase inside its template."""
    p = phrase.split()
    at = next(i for i in range(len(words)) if words[i:i + len(p)] == p)
    return list(range(at, at + len(p)))


def must_stand(template: Template) -> list[int]:
    """Offsets of the words without which a start never counts: those of the key phrases, or all."""
    words = template.text.split()
    return sorted({i for p in template.mandatory for i in _phrase_places(words, p)}) if template.mandatory else list(range(len(words)))


def _starts(word: str, offset: int) -> Column:
    """Starts that the postings of one rare word point to."""
    return F.transform(F.filter(F.col("__hits"), lambda x: x["w"] == word), lambda x: x["i"] - offset)


def license_scan(evidence: DataFrame, id_col: str = "evidence_id", text_col: str = "intake_notes", templates: Sequence[Template] = TEMPLATES,
                 rare: int = 2, agreement: float = 0.8) -> DataFrame:
    """Licence labels of every intake record.

    The index holds, for each template, the postings (offsets) of its `rare`
    words with the highest IDF among those of its key phrases (of all, without
    key phrases), the IDF being counted over all records. Each of these words
    that a record holds is looked up: its places, shifted by its posting, are
    where the template may start. These lists are intersected; as all the words
    must stand, no start that counts is missed, and a record without one of
    them has no start. A start counts when the share of template words at their
    relative place reaches `agreement` and every key phrase stands unchanged.
    Short templates without key phrases must stand unchanged as a whole.

    All work on a record is one projection, so nothing is shuffled but the
    word counts. Returns one row per input row: `id_col`, n_words, n_base
    (places of base phrases), first_word, last_word (their smallest and
    largest start), base_labels, labels, score (best agreement, 0 to 1).
    Extra columns are ignored.

    Null or empty text: no words, no labels, score 0. Null ids stay; repeated
    rows give repeated rows. Letters A-Z are lowered, no others.
    """
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    n, df = document_frequency(evidence, vocabulary, text_col)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary}
    anchors = [rare_words(t, idf, rare) for t in templates]
    looked_up = F.array(*[F.lit(w) for w in sorted({w for a in anchors for w, _ in a})])

    words = F.col("__words")
    df_words = evidence.select(F.col(id_col), F.transform(pieces(whole_text(F.col(text_col)), SEPARATORS), _lowered).alias("__words"))
    posted = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(looked_up, x["w"]))
    none = F.array().cast("array<struct<w:string,i:int>>")
    hits = df_words.withColumn("__hits", F.when(F.arrays_overlap(words, looked_up), posted).otherwise(none))

    def found(t: Template, rare_at: list[tuple[str, int]]) -> Column:
        """Places (start, share) where the template stands."""
        text = t.text.split()
        fixed = must_stand(t)
        least = agreement if t.mandatory else 1.0
        literal = F.array(*[F.lit(w) for w in text])
        shifted = [_starts(w, o) for w, o in rare_at]
        starts = F.filter(F.array_distinct(reduce(F.array_intersect, shifted)), lambda s: (s >= 0) & (s < F.size(words)))

        def judged(s: Column) -> Column:
            here = F.slice(words, s + 1, len(text))
            return let(F.transform(literal, lambda w, k: F.get(here, k) == w), lambda same: F.struct(
                s.alias("start"),
                (F.size(F.filter(same, lambda x: F.coalesce(x, F.lit(False)))) / F.lit(float(len(text)))).alias("share"),
                F.forall(F.array(*[F.lit(i) for i in fixed]), lambda k: F.coalesce(F.get(same, k), F.lit(False))).alias("phrases")))

        return F.filter(F.transform(starts, judged), lambda x: x["phrases"] & (x["share"] >= least))

    empty = F.array().cast("array<struct<start:int,share:double,phrases:boolean>>")
    some = F.size("__hits") > 0
    out = hits.withColumns({f"__t{k}": F.when(some, found(t, a)).otherwise(empty) for k, (t, a) in enumerate(zip(templates, anchors, strict=True))})
    names = [f"__t{k}" for k in range(len(templates))]
    base = [(t, c) for t, c in zip(templates, names, strict=True) if t.base]
    every = F.concat(*[F.transform(c, lambda x: x["start"]) for _, c in base])

    def joined(chosen: Sequence[tuple[Template, str]]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.when(F.size(c) > 0, F.array(F.lit(t.label))).otherwise(F.array().cast("array<string>"))
                                                                     for t, c in chosen]))), ",")

    best = F.array_max(F.transform(F.concat(*names), lambda x: x["share"]))
    return out.select(
        F.col(id_col), F.size(words).cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(list(zip(templates, names, strict=True))).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"))
