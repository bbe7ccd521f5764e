"""Cross-parsing against plain substring search, and held-out accuracy."""

import random

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from samples import SMALL

from proofmill.llm import queries
from proofmill.llm.cross_parsing import _tables, joined, language_of, phrase_counts, suffix_automaton, verdicts


def model(texts):
    """texts: {label: pieces}."""
    tables = [_tables(pd.DataFrame({"label": k, "all_bytes": 1000, "place": range(len(v)), "piece": v})) for k, v in sorted(texts.items())]
    return joined([next(t.itertuples(index=False)) for t in tables])


def test_automaton_reads_exactly_the_substrings():
    random.seed(2)
    text = bytes(random.choice(b"abc") for _ in range(120))
    nexts = suffix_automaton(text)
    assert len(nexts) < 2 * len(text)
    for _ in range(2000):
        n, at = random.randint(1, 9), random.randrange(110)
        probe = text[at:at + n] if random.random() < 0.5 else bytes(random.choice(b"abcd") for _ in range(n))
        state = 0
        for b in probe:
            state = nexts[state].get(b, -1) if state >= 0 else -1
        assert (state >= 0) == (probe in text)


def test_phrases_equal_plain_parse():
    """Several automata at once; texts empty, longer than a segment, with bytes that no language has; pieces are not joined across their border."""
    random.seed(3)
    draw = lambda letters, n: bytes(random.choice(letters) for _ in range(n))
    learnt = {"a": [draw(b"abcd ", 300), draw(b"ab ", 50)], "b": [draw(b"bcde ", 200)], "c": ["é è ç".encode() * 20]}
    texts = [b"", b"a", b"zzz", draw(b"abcde ", 77), draw(b"abcdexyz ", 2500), "déjà été ça".encode(), learnt["a"][0][100:250] + learnt["b"][0][:60], b"\0a\0", learnt["a"][0][-5:] + learnt["a"][1][:5]]
    got = phrase_counts(model(learnt), texts)
    want = [[brute.cross_parse(t.replace(b"\0", b"\1"), b"\0".join(learnt[k]), 1024) for k in sorted(learnt)] for t in texts]
    assert got.tolist() == want


def test_verdict_is_the_fewest_weighted_phrases():
    learnt = {"x": [b"the cat sat on the mat " * 3], "y": [b"der hund lag auf dem bett " * 3]}
    a = model(learnt)
    label, score = verdicts(a, [b" the mat ", b" dem hund ", b"q"])
    assert label == ["x", "y", "x"] and (score[:2] > 0.9).all() and (score <= 1).all() and (score > 0).all()
    assert np.isclose(score[2], 1 / (1 + 2.0 ** -abs(a.bits[0] - a.bits[1])))


def test_odd_records(spark, records):
    rows = language_of(records).collect()
    assert len(rows) == records.count()
    want = {r.evidence_id: r.intake_notes for r in records.collect()}
    for r in rows:
        assert 0 <= r.score <= 1
        blank = not any(c.isalpha() for c in want.get(r.evidence_id) or "") if r.evidence_id is not None else None
        assert blank is None or (r.language == "und") == blank
    assert language_of(records.limit(0)).count() == 0
    none = language_of(records.withColumn("language", F.lit(None).cast("string")))
    assert {(r.language, r.score) for r in none.collect()} == {("und", 0.0)}
    with pytest.raises(ValueError):
        language_of(records, most_languages=1)


def test_label_of_a_held_out_record_is_not_seen(spark):
    """A text whose own label is wrong is still judged by the others."""
    import zlib
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:40]
    held = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1)
    rows = [(i, "the quick brown fox jumps over the lazy dog", "en") if k % 2 else (i, "der schnelle braune fuchs springt über den faulen hund", "de") for k, i in enumerate(ids)]
    rows.append((held, "the lazy fox", "de"))
    got = {r.evidence_id: r for r in language_of(spark.createDataFrame(rows, "evidence_id long, intake_notes string, language string")).collect()}
    assert got[held].held_out and got[held].language == "en"
    assert not any(got[i].held_out for i in ids)


def test_holdout_of_query(spark):
    """Every language is found in nearly all held-out documents, and in nearly all that carry its label."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = queries.op13_language(spark, SMALL).where("held_out").join(docs.where("lang is not null"), "doc_id").collect()
    assert len(rows) > 30
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang]
        assert sum(r.lang_pred == lang for r in mine) >= 0.9 * len(mine) - 1
    assert sum(r.lang_pred == r.lang for r in rows) > 0.95 * len(rows)
