"""Language-model scores of intake notes: context-tree weighting over binary-decomposed bytes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bytehash import _LOWER, batches, word_hashes
from .common import whole_text

DEPTH = 6
TOP = 3  # contexts of up to TOP bytes are nodes in Spark rows; those beyond are summed in the task that holds their last TOP bytes
CHUNK_BYTES = 20 << 20
BUCKETS = 1024
SCALE = 1 << 30  # logarithms return to the chunks as whole numbers of this fraction, so a byte's is off by 4.7e-10 at most
TEXT, WORD, GRAM = 0, 1, 2
END = 1  # key of the end token among word hashes


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts): for every byte and the end of each text, the byte with the DEPTH bytes before it; 0 stands before and behind a text.

    A code has the TOP bytes next to the predicted one first, so that codes of one such context stand together, then the bytes before, then the predicted one.
    """
    buf = _LOWER[np.frombuffer(b"".join(b"\0" * DEPTH + t + b"\0" for t in texts), np.uint8)]
    code = np.zeros(len(buf) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        code <<= 8
        code |= buf[k:len(buf) - DEPTH + k]
    sizes = np.array([len(t) for t in texts])
    inside = np.ones(len(buf), bool)
    ends = np.cumsum(sizes + DEPTH + 1)
    for k in range(DEPTH):
        inside[ends - 1 - k] = False
    code = code[inside[:len(code)]]
    return (code >> 8 & (1 << 8 * TOP) - 1) << 32 | code >> 32 << 8 | code & 255, sizes + 1


def numbered(most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Number runs of about `most` bytes of text; a chunk never leaves its partition."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for pdf in frames:
            for first, texts in batches(pdf["text"].tolist()):
                n = sum(map(len, texts))
                if size and size + n > most:
                    chunk, size = chunk + 1, 0
                size += n
                yield pdf.iloc[first:first + len(texts)].assign(chunk=chunk)
    return run


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, their counts added up. Empties the list, so that the parts need no memory beside the result."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    del order
    new = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on, all their lowest bytes first, then the next ones, compressed."""
    return zlib.compress(x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _bucket(context):
    """Bucket of a context's last TOP bytes (numbers, or a column)."""
    spread = context * 2654435761
    return (spread >> 16 & (BUCKETS - 1)) if isinstance(context, np.ndarray) else F.shiftright(spread, 16).bitwiseAND(BUCKETS - 1)


def _codes(row) -> np.ndarray:
    return unpacked(row.codes)


def _words(row) -> np.ndarray:
    return np.frombuffer(row.codes, np.uint64)


def _dealt(chunk: int, kind: int, key: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """One row per bucket with its keys, in order, and their counts. Words are dealt by their first bits, contexts by their last TOP bytes."""
    if kind == WORD:
        bucket, codes = (key >> np.uint64(54)).astype(np.int64), lambda a, b: key[a:b].tobytes()
    else:
        bucket = _bucket(key >> 32)
        order = np.argsort(bucket.astype(np.uint16), kind="stable")
        bucket, key, n = bucket[order], key[order], n[order]
        codes = lambda a, b: packed(key[a:b])
    bounds = np.concatenate((np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)])).tolist()
    runs = list(pairwise(bounds))
    return pd.DataFrame({"chunk": chunk, "kind": kind, "bucket": bucket[bounds[:-1]], "size": np.diff(bounds), "codes": [codes(a, b) for a, b in runs],
                         "counts": [packed(n[a:b]) for a, b in runs], "ids": None, "learn": None, "sizes": None})


TALLY = "chunk long, kind int, bucket int, size long, codes binary, counts binary, ids array<string>, learn array<boolean>, sizes array<long>"


def _tallied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of each chunk, compressed, and its distinct keys with their counts in training texts (0 where only held-out texts have one).

    Counts of a chunk's runs are merged here, so a chunk sends a key once.
    """
    open_: dict[int, list] = {WORD: [], GRAM: []}
    current = None

    def flush() -> Iterator[pd.DataFrame]:
        for kind, parts in open_.items():
            if parts:
                yield _dealt(current, kind, *_merged(parts))
                open_[kind] = []

    for pdf in numbered(CHUNK_BYTES)(frames):  # each of one chunk
        chunk = int(pdf["chunk"].iat[0])
        if chunk != current:
            yield from flush()
            current = chunk
        learn, texts = pdf["learn"].to_numpy(bool), [t.encode() for t in pdf["text"]]
        yield pd.DataFrame({"chunk": [chunk], "kind": TEXT, "bucket": 0, "size": 0, "codes": [zlib.compress(_LOWER[np.frombuffer(b"".join(texts), np.uint8)].tobytes(), 3)],
                            "counts": None, "ids": [pdf["id"].tolist()], "learn": [learn.tolist()], "sizes": [[len(t) for t in texts]]})
        words, n_words = word_hashes(texts)
        codes, n_codes = grams(texts)
        for kind, keys, used in ((WORD, np.concatenate((words, np.full(len(texts), END, np.uint64))), np.concatenate((np.repeat(learn, n_words), learn))),
                                 (GRAM, codes, np.repeat(learn, n_codes))):
            key, n = np.unique(keys[used], return_counts=True)
            other = np.unique(keys[~used])
            open_[kind].append((np.concatenate((key, other)), np.concatenate((n, np.zeros(len(other), np.int64)))))
            if sum(len(k) for k, _ in open_[kind]) > 1_000_000 + 1.25 * len(open_[kind][0][0]):
                open_[kind] = [_merged(open_[kind])]
    yield from flush()


def log_gamma(x, log=F.log):
    """ln of the gamma function for x >= 0.5 (a column, or numbers with their own log): Stirling's series behind a shift by 8."""
    y = x + 8.0
    series = (y - 0.5) * log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    return series - log(product)


def _own(n0, n1, log=F.log):
    """ln of a node's Krichevsky-Trofimov probability."""
    return log_gamma(n0 + 0.5, log) + log_gamma(n1 + 0.5, log) - 1.1447298858494002 - log_gamma(n0 + n1 + 1.0, log)


FEW = np.arange(1 << 12)
HALF, ONE = log_gamma(FEW + 0.5, np.log), log_gamma(FEW + 1.0, np.log)


def _counted(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """_own() of counts; the gamma function of small ones is looked up."""
    total = n0 + n1
    few = np.minimum(total, len(FEW) - 1).astype(np.int64)
    out = HALF[np.minimum(n0, few).astype(np.int64)] + HALF[np.minimum(n1, few).astype(np.int64)] - 1.1447298858494002 - ONE[few]
    many = np.flatnonzero(total >= len(FEW))
    out[many] = _own(n0[many], n1[many], np.log)
    return out


class Level(NamedTuple):
    """Nodes of one depth for one of a byte's eight decisions, by key (context and the bits before, with a leading 1)."""
    key: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    pw: np.ndarray
    share: np.ndarray


def _decision(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, bit) of the k-th decision of the predicted byte."""
    b = code & 255
    return code >> 8 << 8 | 1 << k | b >> 8 - k, b >> 7 - k & 1


def _mask(depth: int) -> int:
    """Bits of a key that its node of this depth, TOP at least, has too."""
    return (1 << 8 * TOP) - 1 << 32 | (1 << 8 * (depth - TOP + 1)) - 1


def lower_levels(code: np.ndarray, n: np.ndarray, k: int) -> list[Level]:
    """Nodes of depths DEPTH to TOP, deepest first. `code` holds all codes of a context's last TOP bytes, or none."""
    key, bit = _decision(code, k)
    key, at = np.unique(key, return_inverse=True)
    n0, n1 = np.bincount(at, n * (bit == 0.0), len(key)), np.bincount(at, n * (bit == 1.0), len(key))
    out = [Level(key, n0, n1, _counted(n0, n1), np.ones(len(key)))]
    for depth in range(DEPTH - 1, TOP - 1, -1):
        key, at = np.unique(out[-1].key & _mask(depth), return_inverse=True)
        n0, n1, below = (np.bincount(at, x, len(key)) for x in (out[-1].n0, out[-1].n1, out[-1].pw))
        own = _counted(n0, n1)
        out.append(Level(key, n0, n1, np.logaddexp(own, below) - np.log(2), 1 / (1 + np.exp(np.minimum(700.0, below - own)))))
    return out


def _at(have: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of `keys` among sorted `have`, whether they are there)."""
    if not len(have):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return at, have[at] == keys


def _whole(frames: Iterator[pd.DataFrame], most: int = 500_000) -> Iterator[list]:
    """Runs of rows, sorted by bucket, that hold whole buckets and about `most` keys."""
    run, size = [], 0
    for pdf in frames:
        for row in pdf.itertuples(index=False):
            if size > most and row.bucket != run[-1].bucket:
                yield run
                run, size = [], 0
            run.append(row)
            size += row.size
    if run:
        yield run


def _learnt(run: list, keys: Callable = _codes, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of some rows, with their counts added up; rows stay packed but for about `most` keys."""
    parts, size = [], 0
    for row in run:
        parts.append((keys(row), unpacked(row.counts)))
        size += row.size
        if size > most:
            parts, size = [_merged(parts)], 0
    return _merged(parts)


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the words of every row over all rows, in the order of its words; n and v: training tokens and distinct ones of the buckets."""
    for run in _whole(frames):
        key, n = _learnt(run, _words)
        for first in range(0, len(run), 2000):
            part = run[first:first + 2000]
            out = pd.DataFrame({"chunk": [r.chunk for r in part], "bucket": [r.bucket for r in part], "values": [packed(n[np.searchsorted(key, _words(r))]) for r in part], "n": 0, "v": 0})
            if not first:
                out.loc[0, ["n", "v"]] = int(n.sum()), int((n > 0).sum())
            yield out


def _middle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of depth TOP: (c, u, n0, n1, pw); those that only held-out texts ask for have no counts."""
    for run in _whole(frames):
        code, n = _learnt(run)
        for k in range(8):
            level = lower_levels(code[n > 0], n[n > 0], k)[-1]
            asked = np.unique(_decision(code, k)[0] & _mask(TOP))
            at, there = _at(level.key, asked)
            values = {c: (np.where(there, getattr(level, c)[at], 0.0) if len(level.key) else np.zeros(len(asked))) for c in ("n0", "n1", "pw")}
            yield pd.DataFrame({"c": asked >> 32, "u": (asked & 255).astype(np.int32), **values})


def _valued(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """-log10 probability of the predicted byte of every code of every chunk, in parts of SCALE: eight decisions, each mixed over all depths."""
    for run in _whole(frames):
        rows = [r for r in run if r.codes is not None]
        if not rows:
            continue
        upper = [r for r in run if r.codes is None]
        have = np.concatenate([int(r.key) << 32 | np.asarray(r.us, np.int64) for r in upper])
        order = np.argsort(have)
        have, base, left = have[order], *(np.concatenate([np.asarray(getattr(r, c), float) for r in upper])[order] for c in ("ps", "rests"))
        code, n = _learnt(rows)
        total = np.zeros(len(code))
        for k in range(8):
            key, bit = _decision(code, k)
            p = np.full(len(code), 0.5)
            for depth, level in zip(range(DEPTH, TOP - 1, -1), lower_levels(code[n > 0], n[n > 0], k), strict=True):
                at, there = _at(level.key, key & _mask(depth))
                share, own = np.full(len(p), 0.5), np.full(len(p), 0.5)
                at = at[there]
                share[there], own[there] = level.share[at], (level.n1[at] + 0.5) / (level.n0[at] + level.n1[at] + 1)
                p = share * own + (1 - share) * p
            at = np.searchsorted(have, key & _mask(TOP))
            p = base[at] + left[at] * p
            total += np.log10(np.where(bit == 1, p, 1 - p))
        total = np.rint(-total * SCALE).astype(np.int64)
        for first in range(0, len(rows), 2000):
            part = rows[first:first + 2000]
            yield pd.DataFrame({"chunk": [r.chunk for r in part], "bucket": [r.bucket for r in part], "codes": [r.codes for r in part],
                                "values": [packed(total[np.searchsorted(code, _codes(r))]) for r in part]})


def upper_levels(middle: DataFrame) -> DataFrame:
    """(c, u, p, rest): for every node of depth TOP, what the depths before TOP give to the probability of a 1, and the weight they leave to the others.

    A node holds the counts of one binary decision in one context. Its
    weighted probability is half its Krichevsky-Trofimov estimate and half
    the product of its children's; the share of its own estimate in that sum
    is its weight when it predicts.
    """
    own = _own(F.col("n0"), F.col("n1"))
    estimate = ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)).alias("p")
    # sums of logarithms as decimals: the same whatever order the rows come in
    nodes = middle.where(F.col("n0") + F.col("n1") > 0).withColumn("pw", F.col("pw").cast("decimal(38,12)"))
    levels = []
    for depth in range(TOP - 1, -1, -1):
        up = nodes.groupBy(F.col("c").bitwiseAND((1 << 8 * depth) - 1).alias("c"), "u").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").cast("double").alias("below")).withColumn("kt", own)
        more = F.greatest("kt", "below")
        pw = more + F.log1p(F.exp(-F.abs(F.col("kt") - F.col("below")))) - 0.6931471805599453
        nodes = cut(up.withColumns({"pw": pw.cast("decimal(38,12)"), "share": 1 / (1 + F.exp(F.least(F.lit(700.0), F.col("below") - F.col("kt"))))}))
        levels.insert(0, nodes.select("c", "u", "share", estimate))
    rows = middle.select("c", "u")
    for depth, nodes in enumerate(levels):
        named = nodes.select(F.col("c").alias(f"c{depth}"), "u", F.col("share").alias(f"s{depth}"), F.col("p").alias(f"p{depth}"))
        named = F.broadcast(named) if depth < 2 else named  # at most 255 nodes in each of 256 contexts
        rows = rows.withColumn(f"c{depth}", F.col("c").bitwiseAND((1 << 8 * depth) - 1)).join(named, [f"c{depth}", "u"], "left")
    p, rest = F.lit(0.0), F.lit(1.0)
    for depth in range(TOP - 1, -1, -1):
        share = F.coalesce(f"s{depth}", F.lit(0.5))
        p, rest = share * F.coalesce(f"p{depth}", F.lit(0.5)) + (1 - share) * p, (1 - share) * rest
    return rows.select("c", "u", p.alias("p"), rest.alias("rest"))


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def gram_values(grams: DataFrame) -> DataFrame:
    """(chunk, bucket, codes, values) for packed rows (chunk, bucket, size, codes, counts): what they predict, learnt from all of them."""
    middle = cut(_by_bucket(grams.select("bucket", "size", "codes", "counts")).mapInPandas(_middle, "c long, u int, n0 double, n1 double, pw double"))
    upper = upper_levels(middle).groupBy(F.col("c").alias("key")).agg(F.collect_list(F.struct("u", "p", "rest")).alias("x"))  # at most 255 in each
    both = grams.select("chunk", "bucket", "size", "codes", "counts").unionByName(upper.select(
        F.lit(-1).cast("long").alias("chunk"), _bucket(F.col("key")).cast("int").alias("bucket"), F.lit(0).cast("long").alias("size"),
        "key", F.col("x.u").alias("us"), F.col("x.p").alias("ps"), F.col("x.rest").alias("rests")), allowMissingColumns=True)
    return _by_bucket(both).mapInPandas(_valued, "chunk long, bucket int, codes binary, values binary")


def _texts(row) -> list[bytes]:
    data = zlib.decompress(row.codes)
    return [data[a:b] for a, b in pairwise(np.cumsum([0, *row.sizes]).tolist())]


def _scored(total: int, distinct: int):
    below = total + 0.1 * (distinct + 1)

    def run(part: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("bucket")
        words, packs = table[table["kind"] == WORD], table[table["kind"] == GRAM]
        rows = list(part.itertuples(index=False))
        # the chunk's distinct words stand in the order in which their counts were sent
        word = np.unique(np.concatenate([np.array([END], np.uint64), *(np.unique(word_hashes(_texts(row))[0]) for row in rows)]))
        counts = np.concatenate([unpacked(v) for v in words["values"]])
        code = np.concatenate([_codes(r) for r in packs.itertuples(index=False)])
        order = np.argsort(code)
        code, value = code[order], np.concatenate([unpacked(v) for v in packs["values"]])[order]
        end, out = counts[np.searchsorted(word, np.uint64(END))], []
        del table, words, packs, order
        for row in rows:
            texts = _texts(row)
            hashes, n_words = word_hashes(texts)
            owner = np.repeat(np.arange(len(texts)), n_words)
            c = counts[np.searchsorted(word, hashes)]
            codes, n_codes = grams(texts)
            order = np.argsort(codes)
            found = np.empty(len(codes), np.int64)
            found[order] = value[np.searchsorted(code, codes[order])]  # in order, as a search for each place alone is slow in a large table
            score = np.add.reduceat(found, np.cumsum(n_codes) - n_codes) / -SCALE
            base = np.bincount(owner, np.log10((c + 0.1) / below), len(texts)) + np.log10((end + 0.1) / below)
            known = np.bincount(owner, c > 0, len(texts)) + (end > 0)
            out.append(pd.DataFrame({"id": row.ids, "held_out": ~np.asarray(row.learn, bool), "n_tokens": n_words + 1,
                                     "n_known": known.astype(np.int64), "n_bytes": [len(t) for t in texts], "base_score": base, "score": score}))
        return pd.concat(out)
    return run


def context_tree_scores(evidence: DataFrame, id_col: str = "evidence_id", text_col: str = "intake_notes", folds: int = 10) -> DataFrame:
    """Context-tree-weighting score of every record, learnt from the records whose crc32(id as text) mod `folds` is not 0.

    Texts (A-Z lowered) are bytes and one end. A byte is eight binary
    decisions; each has a tree of contexts of 0 to 6 bytes whose nodes hold
    Krichevsky-Trofimov counts, and the prediction mixes all depths by their
    posterior weights (no tuning). Counts are gathered over all training
    texts as distinct keys per chunk of text, contexts packed by their last
    three bytes, and added up by key; scores return to the chunks the same
    way, so neither counts nor texts ever meet in one task or on the driver,
    and a chunk is bounded by its bytes.

    Returns `id_col`, held_out, n_tokens (words and the end), n_known,
    train_tokens, base_score (unigram baseline, log10), score (log10
    probability of the text), bits_per_byte (of text and end).

    Null or empty text: the end alone. Null ids count as empty text in the
    fold rule. Repeated rows give repeated rows; extra columns are ignored.
    An empty training part leaves every decision at one half.
    """
    id_type = evidence.schema[id_col].dataType
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    docs = evidence.select(F.col(id_col).cast("string").alias("id"), whole_text(F.col(text_col)).alias("text"), (F.crc32(name) % folds != 0).alias("learn"))
    tallies = cut(docs.mapInPandas(_tallied, TALLY))
    of_kind = lambda kind: tallies.where(F.col("kind") == kind)
    words = cut(_by_bucket(of_kind(WORD).select("chunk", "bucket", "size", "codes", "counts")).mapInPandas(_summed, "chunk long, bucket int, values binary, n long, v long"))
    sums = words.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    tables = words.select("chunk", F.lit(WORD).alias("kind"), "bucket", F.lit(None).cast("binary").alias("codes"), "values").unionByName(
        gram_values(of_kind(GRAM)).withColumn("kind", F.lit(GRAM)))
    texts = of_kind(TEXT).select("chunk", "codes", "ids", "learn", "sizes")
    out = texts.groupBy("chunk").cogroup(tables.groupBy("chunk")).applyInPandas(
        _scored(sums["n"] or 0, sums["v"] or 0), "id string, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double")
    return out.select(F.col("id").cast(id_type).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(sums["n"] or 0).cast("long").alias("train_tokens"),
                      "base_score", "score", (-F.col("score") * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
