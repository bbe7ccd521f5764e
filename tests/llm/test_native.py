"""License scan, personal data, quality rules, containment search against plain Python."""

import hashlib

import brute
import pytest
from samples import SMALL, passage
from pyspark.sql import functions as F

from proofmill.llm import queries as Q
from proofmill.llm.containment import containment_search
from proofmill.llm.license_scan import license_scan
from proofmill.llm.personal_data import personal_data, redacted
from proofmill.llm.quality_rules import kept_records, quality_rules, quality_thresholds, quality_measures, with_base


def texts(spark, *values):
    return spark.createDataFrame([(i, t, "en", "upload") for i, t in enumerate(values)], "evidence_id long, intake_notes string, language string, source_platform string")


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_license_query(spark):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in Q.op1_license_scan(spark, SMALL).collect()}
    assert got == {i: brute.license_base(t) for i, t in documents(spark).items()}


def test_license_labels(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files"
    df = texts(spark, "MIT License. see the MIT-License", notice, notice.replace("hereby", "gladly"), "The GNU General Public License, Version 3", "MİT license", "mitlicense apache", None, "")
    got = {r.evidence_id: r for r in license_scan(df).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].labels, got[0].score) == (2, 0, 4, "mit", 1.0)
    assert got[1].labels == "mit" and got[1].base_labels == "" and 0.9 < got[1].score < 1  # one word differs, the key phrase stands
    assert got[2].labels == "" and got[2].score == 0.0
    assert got[3].labels == "gpl,gpl-3.0" and got[3].base_labels == "gpl"
    assert all(got[i].n_base == 0 and got[i].first_word is None for i in (4, 5, 6, 7))
    assert (got[6].n_words, got[7].n_words) == (0, 0)


def test_license_notice_cut_outside_key_phrase(spark):
    """The words cut off are the rarest of the notice; what is left has 16 of its 20 words and the key phrase."""
    rest = "permission is hereby granted free of charge to any person obtaining a copy of this software"
    row = license_scan(texts(spark, rest, "x " + rest + " only")).collect()
    assert [(r.labels, r.score) for r in row] == [("mit", 0.8)] * 2


def test_license_words_apart(spark):
    """Rare words of a template that stand, but not at their relative places, give no start; one that does is found among many."""
    noise = "mozilla license public mozilla mozilla public x license public license mozilla "
    got = license_scan(texts(spark, noise * 50, noise * 50 + "mozilla public license " + noise, "public license mozilla")).collect()
    assert [(r.labels, r.score) for r in got] == [("", 0.0), ("mpl", 1.0), ("", 0.0)]


def test_license_rows(records, empty):
    assert license_scan(records).count() == records.count() and license_scan(empty).count() == 0


def test_personal_query(spark):
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in Q.op4_personal_data(spark, SMALL).collect()}
    assert got == {i: brute.personal_base(t) for i, t in documents(spark).items()}


ODD = ("a@b.c_d@e.f", "x@y.z.", "é a@b.co ü 1.2.3.4", "999.1.1.1 1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111112", "+1 (262) 555-3752.", "+12 34", "\U0001F600 x@y.de", "..@a.b",
       "a@b.c@d.e", "0" * 40, "1.1.1.256", "00001.2.3.4", "+1+2025550123456")


def test_personal_edges(spark):
    got = {r.evidence_id: r.spans for r in personal_data(texts(spark, *ODD)).collect()}
    for i, t in enumerate(ODD):
        base = [s for s in got[i] if s["base"]]
        digest = hashlib.sha256(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base).encode()).hexdigest()
        assert digest == brute.personal_base(t)[4], t


def test_personal_method_spans(spark):
    df = texts(spark, "account DE89370400440532013000 is open", "DE89370400440532013001", "ssn 123-45-6789", "part 123-45-6789", None)
    got = {r.evidence_id: [(s["kind"], s["start"], s["end"]) for s in r.spans] for r in personal_data(df).collect()}
    assert got == {0: [("iban", 8, 30)], 1: [], 2: [("ssn", 4, 15)], 3: [], 4: []}


def test_many_spans_and_long_runs(spark):
    many, run = "mail a@b.cd " * 3000, "a" * 200_000 + "1" * 200_000
    got = {r.evidence_id: r.spans for r in personal_data(texts(spark, many, run)).collect()}
    assert [s["start"] for s in got[0]] == [5 + 12 * i for i in range(3000)] and got[1] == []


def test_redaction(spark, records, empty):
    df = texts(spark, "ü write a@b.cd or +1 262 555 3752!", "none", None, "x@y.zz")
    assert [r.intake_notes for r in redacted(df).orderBy("evidence_id").collect()] == ["ü write [EMAIL] or [PHONE]!", "none", None, "[EMAIL]"]
    assert redacted(records).columns == records.columns and redacted(records).count() == records.count()
    assert redacted(empty).count() == 0


def test_quality_query(spark):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.op5_quality_rules(spark, SMALL).collect()}
    assert got == {i: brute.quality_base(t) for i, t in documents(spark).items()}


def test_quality_records(records, empty):
    got = quality_rules(records).collect()
    assert len(got) == records.count()
    for r in got:
        if r.n_words == 0:
            assert r.base_failed and not r.kept
        assert r.kept == (not r.base_failed and r.failed_rules == "")
    kept = kept_records(records)
    assert kept.columns == records.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules(empty).count() == 0 and kept_records(empty).count() == 0


def test_thresholds_follow_the_group(spark):
    """Symbols are usual on one platform and not on the other: the fence differs, a fixed cutoff would not."""
    rows = [(i, passage(40, i).replace(" ", "# " if i % 2 else " "), "en", "code" if i % 2 else "mail") for i in range(600)]
    rows += [(9001, passage(40, 7).replace(" ", "# "), "en", "mail"), (9002, passage(40, 7).replace(" ", "# "), "en", "code")]
    df = spark.createDataFrame(rows, "evidence_id long, intake_notes string, language string, source_platform string")
    got = {r.evidence_id: r for r in quality_rules(df).collect()}
    assert not got[9001].kept and got[9001].failed_rules == "symbol_share" and got[9002].kept
    assert sum(r.kept for r in got.values()) >= 600
    measured = with_base(quality_measures(df)).drop("intake_notes")
    exact = measured.where("source_platform = 'code'").agg(F.percentile("symbol_share", 0.75)).first()[0]
    fence = quality_thresholds(measured).where("__from = 'code'").first()
    assert abs(fence["__hi_symbol_share"] - (exact + 6 * 0.01)) < 0.02 * exact + 0.03


def test_containment_query(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in Q.op8_containment_search(spark, SMALL).collect()}
    assert got and got == brute.contained(documents(spark).items(), items)


def test_containment_cases(spark, records, empty):
    item, short = passage(12, 1), "two words"
    changed = item.split()
    changed[11] = "other"
    far = item.split()
    far[5] = "other"
    notes = texts(spark, passage(4000, 2, 3) + " " + item.upper() + "! " + passage(50, 4), "x " + " ".join(changed), "x " + " ".join(far), short, None, "")
    refs = spark.createDataFrame([(1, item), (1, item), (2, short), (3, None), (None, passage(30, 17, 5))], "reference_id long, reference_text string")
    got = {(r.evidence_id, r.reference_id, r.n_shingles, r.n_shared) for r in containment_search(notes, refs).collect()}
    assert got == {(0, 1, 8, 8), (1, 1, 8, 7), (3, 2, 1, 1)}  # an item of two words is one run of its own length
    whole = spark.createDataFrame([(1, passage(60))], "reference_id long, reference_text string")
    assert {r.evidence_id for r in containment_search(records, whole).collect()} == {1, 2, 3, None}
    assert containment_search(empty, refs).count() == 0 and containment_search(records, refs.limit(0)).count() == 0


def test_containment_of_short_and_unspaced_items(spark):
    """Items of one to four words, and passages in scripts without blanks, inside longer texts and alone."""
    notes = [(1, "a b four word item here c d"), (2, "four word item there"), (3, "the end"), (4, "End. The"), (5, "今日は天気がとても良いですね、散歩しましょう"), (6, "天気がとても良いです"),
             (7, "天気 とても"), (8, "สวัสดีครับผมชื่อ"), (9, ""), (10, None), (11, "ab cd"), (12, "xab cd"), (13, "one two three four five six")]
    items = [("w4", "Four word, item here"), ("w1", "END"), ("w2", "the end"), ("ja", "天気がとても良いです"), ("ja2", "天気"), ("th", "สวัสดีครับ"), ("none", " .. "), ("null", None),
             ("ab", "ab"), ("w5", "one two three four five"), ("w3", "two three four")]
    got = containment_search(spark.createDataFrame(notes, "evidence_id long, intake_notes string"), spark.createDataFrame(items, "reference_id string, reference_text string"))
    pairs = [(r.evidence_id, r.reference_id, r.n_shingles, r.n_shared) for r in got.collect()]
    want = brute.contained(notes, items)
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert {(1, "w4", 1, 1), (5, "ja2", 1, 1), (3, "w2", 1, 1), (11, "ab", 1, 1)} <= want and not any(p[0] in (9, 10, 12) for p in want)
    with pytest.raises(ValueError):
        containment_search(spark.createDataFrame(notes, "doc_id long, intake_notes string"), spark.createDataFrame(items, "doc_id string, reference_text string"), "doc_id", reference_id_col="doc_id")
