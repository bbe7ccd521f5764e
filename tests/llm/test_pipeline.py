"""The pipeline's stages against plain Python on their own inputs."""

import re

import brute
import corpus_pipeline as P
from samples import SMALL
from pyspark.sql import functions as F


def groups(rows):
    """Smallest ids of groups of near-equal texts, five-word shingles."""
    def sets(t):
        w = brute.words_of(brute.low(t))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    have, parent = {i: sets(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(have)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = have[a], have[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i for i in ids if find(i) == i}


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("__id", F.lit("clash"))
    columns = docs.columns
    kept = P.quality(spark, docs, SMALL).cache()
    assert kept.columns == columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids <= {r.doc_id for r in docs.collect() if not brute.quality_base(r.text)[5]} and len(ids) > 100
    one = P.near_duplicates(spark, kept, SMALL).cache()
    assert one.columns == columns
    assert {r.doc_id for r in one.collect()} == groups([(r.doc_id, r.text) for r in kept.collect()])
    clean = P.decontamination(spark, one, SMALL).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = {d for d, *_ in brute.contained([(r.doc_id, r.text) for r in one.collect()], items)}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - found
    safe = P.personal_data(spark, clean, SMALL).cache()
    assert safe.columns == columns and safe.count() == clean.count()
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in safe.collect():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text) and r.n_chars == len(r.text)
        if "[" not in r.text:
            assert r.text == before[r.doc_id]
    mixed = P.mixing(spark, safe, SMALL)
    assert mixed.columns == [*columns, "weight", "probability"] and 0 < mixed.count() < safe.count()


def test_decontamination_goes_by_text(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(i, t, "en", "s", len(t)) for i, t in ((None, item), (None, "clean one"), (7, item), (7, "clean two"), (8, "clean three"))]
    kept = P.decontamination(spark, spark.createDataFrame(rows, schema), SMALL)
    assert sorted(r.text for r in kept.collect()) == ["clean one", "clean three", "clean two"]


def test_odd_and_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.limit(30).unionByName(docs.limit(30)).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (None, "", None, "s", 0), (5, None, "en", None, 0)], docs.schema))
    for rows in (odd, docs.limit(0)):
        out = rows
        for _, stage in P.STAGES:
            out = stage(spark, out, SMALL)
        assert out.count() <= rows.count()


def test_run(spark):
    out = P.run(spark, SMALL)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "weight", "probability"] and out.count() > 0
