"""Periodic runs against a plain enumeration."""

import random

import brute
import numpy as np
from samples import SMALL, passage

from proofmill.llm import queries
from proofmill.llm.periodic_runs import COVER, PERIOD, SYNC, CoverIndex, periodic_runs, runs_of


def test_cover_synchronises_every_pair():
    for a in range(PERIOD):
        for d in range(PERIOD):
            s = SYNC[a, d]
            assert s < PERIOD and (a + s) % PERIOD in COVER and (a + d + s) % PERIOD in COVER


def test_shared_words_of_suffixes():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 3, 400)
    codes = np.concatenate((base, base[:300], np.zeros(200, int), [9]))
    index, n = CoverIndex(codes), len(codes)
    a, b = rng.integers(0, n, 3000), rng.integers(0, n, 3000)
    a, b = a[a != b], b[a != b]
    want = [next(k for k in range(n) if codes[x + k] != codes[y + k]) if max(x, y) < n - 1 else 0 for x, y in
            ((x, y) for x, y in zip(a.tolist(), b.tolist())) if max(x, y) < n - 1]
    inner = np.maximum(a, b) < n - 1
    assert index.shared(a[inner], b[inner]).tolist() == want


def test_runs_equal_plain_enumeration():
    random.seed(7)
    texts = []
    for _ in range(250):
        n, kinds = random.randint(0, 220), random.choice([1, 2, 3, 6, 80])
        w = [random.randrange(kinds) for _ in range(n)]
        if n > 20 and random.random() < 0.6:
            a = random.randrange(n)
            p = random.randint(1, max(1, (n - a) // 3))
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        texts.append(w)
    for least in (2, 12):
        got = runs_of([np.array(w, np.int64) for w in texts], least)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [brute.runs(w, least) for w in texts]


def test_long_runs_and_nested_ones():
    one = runs_of([np.zeros(50_000, np.int64)])[0]
    assert one.tolist() == [[0, 50_000, 1]]
    word = [[0], [0, 1]]
    while len(word[-1]) < 900:
        word.append(word[-1] + word[-2])
    assert [tuple(r) for r in runs_of([np.array(word[-1])])[0].tolist()] == brute.runs(word[-1])


def test_records(spark, records):
    extra = spark.createDataFrame([(20, "x " * 40, "en", "mail"), (21, passage(9) + " " + "a b\tc\n" * 30 + passage(8, 4), "en", "mail"), (22, "ä ö " * 6, None, None)],
                                  "evidence_id long, intake_notes string, language string, source_platform string")
    rows = records.unionByName(extra, allowMissingColumns=True)
    got = periodic_runs(rows).collect()
    want = []
    for r in rows.select("evidence_id", "intake_notes").collect():
        w = brute.words_of(r.intake_notes)
        found = brute.runs(w) if len(w) < 2000 else None
        want.append((r.evidence_id, len(w), found, brute.without_runs(w, found) if found is not None else None))
    key = lambda t: (str(t[0]), t[1], str(t[2]))
    seen = [(r.evidence_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) if r.n_words < 2000 else (r.evidence_id, r.n_words, None, None) for r in got]
    assert sorted(seen, key=key) == sorted(want, key=key)
    assert [x[2] for x in seen if x[0] == 20] == [[(0, 40, 1)]]
    assert periodic_runs(rows.limit(0)).count() == 0


def test_query(spark):
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    planted = 0
    for doc_id, text in docs:
        w = brute.planted_tail(doc_id, text)
        if len(w) > 1500:
            continue
        found, r = brute.runs(w), rows[doc_id]
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        planted += bool(found)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r.collapsed_sha256 == brute.sha(brute.without_runs(w, found))
    assert planted > 10
