"""Near duplicates, repeated passages, models and mixing against plain Python, held-out data and invariants."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from samples import SMALL, passage
from pyspark.sql import functions as F

from proofmill import session
from proofmill.llm import context_tree as C
from proofmill.llm import queries as Q
from proofmill.llm import trusted_text as T
from proofmill.llm.mixing import fit_mixture, mixture
from proofmill.llm.near_duplicates import near_duplicates, representatives, superminhash
from proofmill.llm.repeated_passages import repeated_passages
from proofmill.llm.toxicity import fit_toxicity, fit_weights, toxicity
from proofmill.llm.trusted_text import SYMBOLS, train, trusted_text_quality


def documents(spark, where=SMALL):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{where}/documents.parquet").collect()}


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b, c = np.unique(pool[:1000]), np.unique(pool[100:1100]), pool[:1]
    s = superminhash([a, b, c], 160)
    assert s.shape == (3, 160) and (s < 160 << 40).all()
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.12
    assert (superminhash([a], 160)[0] == s[0]).all()


def test_near_query(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op3_near_duplicates(spark, SMALL).collect()}
    assert got == brute.near_groups(documents(spark).items())


def test_near_records(records, empty):
    rows = near_duplicates(records, shingle=2).collect()
    assert len(rows) == records.count()
    by = defaultdict(list)
    for r in rows:
        by[r.evidence_id].append((r.n_shingles, r.component_id, r.kept))
    assert all(by[i][0][1] == 1 for i in (1, 2, 3)) and by[1][0][2] and not by[2][0][2]
    assert by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)] and by[6] == [(0, 6, True)] and by[7] == [(1, 7, True)] * 2
    assert sorted(by[None], key=str) == [(0, None, True), (60, 1, False)]
    left = representatives(records, shingle=2)
    assert left.columns == records.columns
    assert sorted((r.evidence_id for r in left.collect()), key=str) == sorted([1, 4, 5, 6, 7, None, 8, 9, 10, 12], key=str)
    assert near_duplicates(empty).count() == 0 and representatives(empty).count() == 0


def test_large_group_of_near_copies(spark):
    """Copies of one text, each with its own changes: few pairs are compared, one group results."""
    base = passage(120).split()
    rows = []
    for i in range(400):
        words = list(base)
        for k in range(3):
            words[(i * 7 + k * 37) % 120] = f"w{i}x{k}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "evidence_id long, intake_notes string")
    want = brute.near_groups(rows)
    got = {r.evidence_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle=2).collect()}
    assert got == want


def test_repeat_query(spark):
    rows = documents(spark)
    want = dict(zip(rows, brute.repeats(rows.values()), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op2_repeated_passages(spark, SMALL).collect()} == want


def test_repeat_cases(spark, records, empty):
    p, q = passage(90, 4), passage(80, 11, 7)
    cases = ["x" * 399, "x" * 400, "x" * 401, "x" * 1000, passage(30) + p + "ä1", "other " + p + "ä2", p[3:], q[:399] + "!", q[:399] + "?", q[:400], "Ö" * 250 + q, None, "", "ab" * 600, "zz" + q[5:450]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "evidence_id long, intake_notes string")
    got = {r.evidence_id: r for r in repeated_passages(df).collect()}
    for i, (size, gone, spans, digest) in enumerate(brute.repeats(cases)):
        r = got[i]
        assert (r.n_bytes, sum(s["end"] - s["start"] for s in r.removed), len(r.removed)) == (size, gone, spans), i
        assert hashlib.sha256(bytes(r.kept_bytes)).hexdigest() == digest
    assert repeated_passages(records).count() == records.count() and repeated_passages(empty).count() == 0


@pytest.mark.parametrize("width", [20, 64])
def test_repeat_widths(spark, width):
    rng = np.random.default_rng(width)
    texts = ["".join("ab"[b] for b in rng.integers(0, 2, int(n))) for n in rng.integers(0, 400, 40)] + ["a" * 100, "ab" * 90]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "evidence_id long, intake_notes string")
    got = {r.evidence_id: hashlib.sha256(bytes(r.kept_bytes)).hexdigest() for r in repeated_passages(df, width=width).collect()}
    assert got == {i: x[3] for i, x in enumerate(brute.repeats(texts, width))}


def test_context_tree_base(spark):
    rows = documents(spark)
    got = {r.doc_id: r for r in Q.op6_context_tree(spark, SMALL).collect()}
    tokens = {i: [*brute.words_of(brute.low(t)), None] for i, t in rows.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in rows}
    c = Counter(w for i in rows if not held[i] for w in tokens[i])
    n = sum(c.values())
    for i, words in tokens.items():
        r = got[i]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words), sum(c[w] > 0 for w in words), n)
        assert abs(r.base_score - base) < 1e-6


def tree_scores(train_texts, texts):
    """Context-tree weighting by recursion over all nodes, in plain Python."""
    d = C.DEPTH
    counts = Counter()

    def decisions(text):
        data = [0] * d + list(text.lower().encode()) + [0]
        for k in range(d, len(data)):
            u = 1
            for j in range(7, -1, -1):
                bit = data[k] >> j & 1
                yield tuple(data[k - d:k]), u, bit
                u = u * 2 + bit

    for t in train_texts:
        for ctx, u, bit in decisions(t):
            for m in range(d + 1):
                counts[ctx[d - m:], u, bit] += 1
    kids = defaultdict(set)
    for ctx, u, _ in counts:
        if ctx:
            kids[ctx[1:], u].add(ctx)
    lg = math.lgamma

    def kt(ctx, u):
        a, b = counts[ctx, u, 0], counts[ctx, u, 1]
        return lg(a + 0.5) + lg(b + 0.5) - 2 * lg(0.5) - lg(a + b + 1)

    memo = {}

    def weighted(ctx, u):
        if (ctx, u) not in memo:
            own = kt(ctx, u)
            if len(ctx) == d:
                memo[ctx, u] = own, 1.0
            else:
                below = sum(weighted(x, u)[0] for x in kids[ctx, u])
                top = max(own, below)
                total = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
                memo[ctx, u] = total, math.exp(own - top) / (math.exp(own - top) + math.exp(below - top))
        return memo[ctx, u]

    def p_one(ctx, u):
        p = 0.5
        for m in range(d, -1, -1):
            c = ctx[d - m:]
            a, b = counts[c, u, 0], counts[c, u, 1]
            share = weighted(c, u)[1] if a + b else 0.5
            p = share * (b + 0.5) / (a + b + 1) + (1 - share) * p
        return p

    return [sum(math.log10(p_one(c, u) if bit else 1 - p_one(c, u)) for c, u, bit in decisions(t)) for t in texts]


def test_context_tree_equals_recursion(spark):
    texts = ["abracadabra", "abracadabra cadabra", "Äb ab", "", "zzz", "the cat sat on the mat", "the dog sat"]
    ids = list(range(20, 20 + len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "evidence_id long, intake_notes string")
    learn = [t for i, t in zip(ids, texts) if zlib.crc32(str(i).encode()) % 10]
    got = {r.evidence_id: r.score for r in C.context_tree_scores(df).collect()}
    assert np.allclose([got[i] for i in ids], tree_scores(learn, texts), atol=1e-6)


def test_context_tree_sees_long_words(spark):
    """What follows "abc" depends on the bytes four to six before: three bytes of context cannot tell, six can."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(("pqrabcx", "stuabcy")[b] for b in rng.integers(0, 2, 60))) for i in range(60)]
    df = spark.createDataFrame(rows, "evidence_id long, intake_notes string")
    # one bit a word of seven letters and a blank is left to guess
    assert np.mean([r.bits_per_byte for r in C.context_tree_scores(df).collect() if r.held_out]) < 0.2


def test_context_tree_packs_what_it_sends(spark, monkeypatch):
    """Texts and counts are written packed; unpacked, the first steps took a third more than the texts."""
    rng = np.random.default_rng(8)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, int(n))) for n in rng.integers(2, 9, 3000)]
    rows = [(i, " ".join(words[k] for k in np.minimum(rng.zipf(1.2, 400), 3000) - 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "evidence_id long, intake_notes string").coalesce(2)
    sizes, real = [], C.cut

    def cut(step):
        out = real(step)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(C, "cut", cut)
    assert C.context_tree_scores(df).count() == 400
    assert sum(sizes[:2]) < 1.1 * sum(len(t) for _, t in rows)


def test_context_tree_chunks_agree(spark, monkeypatch):
    """However texts are cut into chunks, and whatever order their rows come in, scores are the same; a count that is looked up equals one that is computed."""
    rows = [(i, passage(40, i, 1 + i % 3) if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "evidence_id long, intake_notes string")
    want = {r.evidence_id: r[1:] for r in C.context_tree_scores(df.coalesce(1)).collect()}
    got = {r.evidence_id: r[1:] for r in C.context_tree_scores(df.repartition(5)).collect()}
    assert want.keys() == got.keys() and all(np.allclose(np.array(got[i], float), np.array(want[i], float), atol=1e-7) for i in want)
    n0, n1 = np.array([0.0, 1, 4095, 4096, 5000, 3]), np.array([1.0, 7, 0, 0, 9000, 4092])
    assert np.allclose(C._counted(n0, n1), C._own(n0, n1, np.log), rtol=1e-12)
    x = np.array([0, 1, 255, 256, (1 << 56) - 1])
    assert (C.unpacked(C.packed(x)) == x).all() and not len(C.unpacked(C.packed(x[:0])))


def test_context_tree_records(records, empty):
    rows = C.context_tree_scores(records).collect()
    assert len(rows) == records.count() and all(r.score < 0 and r.n_tokens >= 1 for r in rows)
    assert C.context_tree_scores(empty).count() == 0


def test_toxicity_holdout(spark):
    """Most held-out toxic texts are found and no clean one is, on the middle tables; on the smallest the few training labels are learnt."""
    for sf, least in (("sf0.01", 0.6), ("sf0.1", 0.85)):
        rows = Q.op7_toxicity(spark, f"/root/testdata/{sf}").collect()
        labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").collect()}
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
        toxic = [p for t, p in held if t == 1]
        assert sum(toxic) >= least * len(toxic) and len(toxic) >= 6
        assert sum(p for t, p in held if t == 0) <= 0.005 * len(held)
    rows = {r.doc_id: r for r in Q.op7_toxicity(spark, SMALL).collect()}
    learnt = [rows[r.doc_id].predicted for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect() if r.doc_id in rows and not rows[r.doc_id].held_out]
    assert sum(learnt) >= 0.9 * len(learnt) > 0


def test_identity_terms_are_neutral():
    """Toxic texts name one group far more often; only with the penalty do swapped sentences score alike. Columns: 30 words, scum, two groups."""
    rng = np.random.default_rng(1)
    rows, labels, swaps = [], [], []
    for k in range(600):
        bad = k % 3 == 0
        group = 31 if rng.random() < (0.8 if bad else 0.1) else 32
        rows.append(np.unique([*rng.integers(0, 30, 8), group, *([30] if bad and rng.random() < 0.7 else [])]))
        labels.append(float(bad))
        swaps.append((k, group, 63 - group))
    gap = {}
    for penalty in (0.0, 5.0):
        w, _ = fit_weights(np.array([len(r) for r in rows]), np.concatenate(rows), np.array(labels), np.ones(33), swaps, penalty, 1e-5, 300)
        gap[penalty] = abs(w[31] - w[32])
        assert w[30] > 1.5
    assert gap[0.0] > 2.0 and gap[5.0] < 0.2 * gap[0.0]


def test_neutral_mentions_through_the_operator(spark):
    """A group that toxic texts name far more often: its neutral mentions score like those of the others, insults still score high."""
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for k in range(900):
        bad = k % 3 == 0
        group = "muslim" if rng.random() < (0.8 if bad else 0.1) else "christian"
        rows.append((k, " ".join([*rng.choice(plain, 10), group, *(["scum"] if bad else [])])))
        labels.append((k, int(bad)))
    probes = [(10_000 + i, f"a {g} neighbour {plain[i]}") for i, g in enumerate(["muslim", "christian"] * 10)] + [(20_000 + i, f"{plain[i]} scum") for i in range(20)]
    df = spark.createDataFrame(rows + probes, "evidence_id long, intake_notes string")
    known = spark.createDataFrame(labels, "evidence_id long, toxic int")
    got = {p: {r.evidence_id: r.score for r in toxicity(df, known, penalty=p).collect()} for p in (0.0, 20.0)}
    mean = lambda p, odd: np.mean([got[p][10_000 + i] for i in range(odd, 20, 2)])
    assert abs(mean(20.0, 0) - mean(20.0, 1)) < 0.5 * abs(mean(0.0, 0) - mean(0.0, 1))
    assert all(got[20.0][10_000 + i] < 0.5 for i in range(20)) and all(got[20.0][20_000 + i] > 0.5 for i in range(20))


def test_toxicity_records(spark, records, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (10, 0)], "evidence_id long, toxic int")
    rows = toxicity(records, labels).collect()
    assert len(rows) == records.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity(records, labels.limit(0)).collect()} == {0.5}
    assert toxicity(empty, labels).count() == 0
    model = fit_toxicity(records, labels, rounds=5)
    assert len(model.weights) == 1 << 20 and np.isfinite(model.weights).all()


def test_kneser_ney_sums_to_one(spark):
    df = spark.createDataFrame([("the cat sat on the mat",), ("the dog sat",), ("",)], "text string")
    p = np.exp2(train(df).astype(float)).reshape(-1, SYMBOLS).sum(axis=1)
    assert np.allclose(p, 1.0, atol=1e-4)


def test_trusted_text(spark, records, empty):
    rng = np.random.default_rng(2)
    rows = [(i, passage(50, i), "en") for i in range(200)] + [(1000 + i, "".join(chr(97 + v) for v in rng.integers(0, 26, 300)), "en") for i in range(20)]
    rows += [(2000, None, "en"), (2001, passage(50, 3), None), (None, passage(40, 2), "en")]
    df = spark.createDataFrame(rows, "evidence_id long, intake_notes string, language string")
    trusted = spark.range(0, 100).withColumnRenamed("id", "evidence_id")
    got = {r.evidence_id: r for r in trusted_text_quality(df, trusted).collect()}
    assert all(got[i].kept for i in range(200)) and not any(got[1000 + i].kept for i in range(20))
    assert got[2000].n_symbols == 1 and got[2001].kept and len(got) == len(rows)
    assert trusted_text_quality(records, trusted).count() == records.count()
    assert all(r.kept for r in trusted_text_quality(records, trusted.limit(0)).collect())
    assert trusted_text_quality(empty, trusted).count() == 0


def test_trusted_text_word_order(spark):
    """Shuffled words of a trusted text spell the same but read worse: only the order of words can tell."""
    rng = np.random.default_rng(3)
    rows, pool = [], [passage(12, i * 12) for i in range(60)]
    for i in range(300):
        words = " ".join(pool[k] for k in rng.integers(0, 60, 6))
        rows.append((i, words, "en"))
        rows.append((1000 + i, " ".join(rng.permutation(words.split())), "en"))
    df = spark.createDataFrame(rows, "evidence_id long, intake_notes string, language string")
    got = {r.evidence_id: r for r in trusted_text_quality(df, spark.range(0, 200).withColumnRenamed("id", "evidence_id")).collect()}
    assert np.mean([got[i].kept for i in range(200, 300)]) > 0.95 and np.mean([got[1000 + i].kept for i in range(300)]) < 0.05


def test_word_model_leaves_a_text_out(spark):
    """A trusted text's score equals its score under a model that never saw it, but for the discounts, which are held fixed."""
    texts = [" ".join(f"w{(i * j + j * j) % 7}" for j in range(12 + i)) for i in range(12)]

    def table(rows):
        model = T.word_model(spark.createDataFrame([(t,) for t in rows], "text string"))
        found = {(r.kind, r.key): [r.n, r.total, r.k1, r.k2, r.k3] for r in model.rows.collect()}
        return (lambda kind, keys: np.array([found.get((kind, k), [0] * 5) for k in keys.tolist()], float).T), model

    look, model = table(texts)
    for k in (0, 5, 11):
        other, without = table(texts[:k] + texts[k + 1:])
        g = T.word_grams([texts[k].encode()])
        spelled = np.full(len(g.w), -20.0)
        mine = T.word_bits(g, spelled, np.array([True]), look, model.whole, model.discounts)
        assert np.allclose(mine, T.word_bits(g, spelled, np.array([False]), other, without.whole, model.discounts))


def test_packed_counts_equal_counts_as_rows(spark, monkeypatch):
    """Numbered words, packed runs, several chunks, and frequent words dealt into parts tell the same as one row per run; nothing but the result stays on disk."""
    monkeypatch.setattr(T, "CHUNK_BYTES", 600)
    monkeypatch.setattr(T, "PART_BITS", 2)
    rows = [(str(i), " ".join(f"w{(i * j + j * j) % (5 + i % 9)}" for j in range(3 + i)), "en", i % 3 > 0) for i in range(40)]
    rows += [("a", "", "en", True), ("b", "never seen w1 w2 before", "en", False), ("c", " \t ", "en", False), ("d", "w1 w2 w3", "en", True), ("d", "w1 w2 w3", "en", True)]
    docs = spark.createDataFrame(rows, "id string, text string, language string, trusted boolean").repartition(3, "id").localCheckpoint()
    spelling = train(docs.where("trusted"))
    before = set(session.STEPS)
    scored = T.perplexities(docs, spelling)
    assert len(set(session.STEPS) - before) == 1
    got = sorted((r.id, round(r.bits, 9)) for r in scored.collect())

    model = T.word_model(docs.where("trusted"))
    found = {(r.kind, r.key): [r.n, r.total, r.k1, r.k2, r.k3] for r in model.rows.collect()}
    look = lambda kind, keys: np.array([found.get((kind, k), [0] * 5) for k in keys.tolist()], float).T
    want = []
    for i, text, _, trusted in rows:
        g = T.word_grams([text.encode()])
        spelled, further, n = T._spelled([text.encode()], spelling, np.array([len(g.w)]))
        bits = T.word_bits(g, spelled, np.array([trusted]), look, model.whole, model.discounts).sum() + further[0]
        want.append((i, round(-bits / n[0], 9)))
    assert got == sorted(want)


def shares(rows, column):
    have = defaultdict(float)
    for r in rows:
        have[r[column]] += (r["n_tokens"] or 0) * r["probability"]
    total = sum(have.values())
    return {k: v / total for k, v in have.items()}


def test_mixture_query(spark):
    rows = Q.op10_mixture(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 < r.probability <= 1 for r in rows if r.n_tokens)
    for c in ("lang", "source", "topic"):
        have = defaultdict(float)
        for r in rows:
            have[r[c]] += r.n_tokens
        total = sum(have.values())
        want = {k: (v / total) ** 0.7 for k, v in have.items()}
        scale = sum(want.values())
        got, full = shares(rows, c), {k for k in have if all(r.probability == 1 for r in rows if r[c] == k)}
        assert all(abs(got[k] - want[k] / scale) < 0.01 for k in have if k not in full)


MIXED = {("p", "x", "a"): 500, ("p", "y", "a"): 300, ("p", "x", "b"): 20, ("q", "x", "a"): 90, ("q", "y", "b"): 30, ("q", "y", "c"): 8, ("r", "y", "a"): 40, ("r", "x", "c"): 12}


def mixed(spark, cells=MIXED):
    rows = [(n, *c, 1) for c, n in cells.items()]
    return spark.createDataFrame(rows, "n long, source_platform string, language string, topic string, one int") \
        .selectExpr("explode(sequence(1, n)) as i", "*").selectExpr("hash(*) as evidence_id", "source_platform", "language", "topic", "1L as n_tokens")


@pytest.mark.parametrize("topics", [{"a": 0.8, "b": 0.12, "c": 0.08}, {"a": 0.5, "b": 0.15, "c": 0.35}])
def test_mixture_equals_plain_raking(spark, topics):
    """The second targets ask for far more of c than there is: it is taken whole, the others share the rest."""
    shares_of = [{"p": 0.6, "q": 0.25, "r": 0.15}, {"x": 0.55, "y": 0.45}, topics]
    want = brute.raked(MIXED, shares_of, 0.3)
    got = mixture(mixed(spark), dict(zip(("source_platform", "language", "topic"), shares_of)), share=0.3, close=1e-7, rounds=300, strict=True)
    found = {(r.source_platform, r.language, r.topic): r.p for r in got.groupBy("source_platform", "language", "topic").agg(F.max("probability").alias("p")).collect()}
    assert found.keys() == want.keys() and all(abs(found[c] - want[c]) < 1e-3 for c in want)
    if topics["c"] > 0.1:
        assert found["q", "y", "c"] == found["r", "x", "c"] == 1.0


def test_mixture_says_what_cannot_be_met(spark):
    """Platform q has topic b only, but b shall not be taken: both cannot hold. A target of 0 takes nothing."""
    cells = {("p", "x", "a"): 600, ("q", "x", "b"): 400}
    targets = {"source_platform": {"p": 0.5, "q": 0.5}, "topic": {"a": 1.0, "b": 0.0}}
    fit = fit_mixture(mixed(spark, cells), targets, rounds=3)
    assert not fit.converged and fit.gaps["platform"] > 0.9 and fit.gaps["language"] > 0.4
    with pytest.raises(ValueError, match="not met after 3 rounds"):
        mixture(mixed(spark, cells), targets, rounds=3, strict=True)
    with pytest.warns(UserWarning, match="platform 1.0000"):
        rows = mixture(mixed(spark, cells), targets, rounds=3)
    assert {r.topic for r in rows.where("sampled").select("topic").distinct().collect()} == {"a"}


def test_mixture_targets(spark, empty):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold", "en" if i % 2 else None, "a" if i % 5 else "b", 10 + i % 7) for i in range(3000)]
                               + [(None, "hot", "en", "a", None), (7, "gone", "xx", "c", 0)], "evidence_id long, source_platform string, language string, topic string, n_tokens long")
    rows = mixture(df, {"source_platform": {"hot": 0.5, "cold": 0.5}, "language": {"en": 0.3, "": 0.7}}, share=0.2).collect()
    assert len(rows) == 3002
    by = shares(rows, "source_platform")
    assert abs(by["hot"] - 0.5) < 1e-3 and abs(shares(rows, "language")["en"] - 0.3) < 1e-3
    assert [r.probability for r in rows if r.source_platform == "gone"] == [0.0]
    drawn = sum(r.n_tokens or 0 for r in rows if r.sampled)
    assert abs(drawn / sum(r.n_tokens or 0 for r in rows) - 0.2) < 0.03
    assert {r.evidence_id for r in rows if r.sampled} == {r.evidence_id for r in mixture(df.repartition(7), {"source_platform": {"hot": 0.5, "cold": 0.5}, "language": {"en": 0.3, "": 0.7}}, share=0.2).collect() if r.sampled}
    assert mixture(empty.withColumn("n_tokens", F.lit(1))).count() == 0


def test_trusted_text_in_turns(spark, monkeypatch):
    """Chunks sent and answered in turns, runs counted by parts of the buckets: the same numbers to the last bit."""
    from proofmill import session

    words = [f"w{k}" for k in range(60)]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(300)] + ["", "  new  words here"]
    docs = session.cut(spark.createDataFrame([(str(k), t, "de" if k % 3 else "en", k % 4 == 1) for k, t in enumerate(texts)], "id string, text string, language string, trusted boolean").repartition(3))
    spelling = np.full(SYMBOLS ** T.ORDER, -6, np.float32)
    monkeypatch.setattr(T, "CHUNK_BYTES", 1_000)
    monkeypatch.setattr(T, "PART_BITS", 6)  # frequent words are counted in parts
    found = []
    for most in (1 << 40, 0):
        monkeypatch.setattr(T, "TURNS_FROM", most)
        scored = T.perplexities(docs, spelling)
        found.append(sorted(tuple(r) for r in scored.collect()))
    assert len(found[0]) == len(texts) and found[0] == found[1]


def test_distinct_places():
    x = np.array([5, 3, 5, 9, 3, 3])
    first, group = T._distinct(x)
    assert x[first].tolist() == [3, 5, 9] and group.tolist() == [1, 0, 1, 2, 0, 0]
    first, group = T._distinct(np.zeros(0, np.int64))
    assert len(first) == len(group) == 0
