"""Repeated passages in intake notes: prefix-free parsing into phrases, compared through their dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bytehash import Rolling, batches, mix
from .common import bit_filter, keyed, may_hold, whole_text

TRIGGER, BLOCK = 24, 25


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` keys, by doubling."""
    have = 1
    low = keys
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[:len(low) - (width - have)], low[width - have:]) if have < width else low


def phrases(texts: list[bytes], width: int) -> tuple[np.ndarray, ...] | None:
    """Parse of a batch: (text, first, last, trigger, core, content) of every phrase.

    The trigger of a window of `width` bytes is the leftmost place, in its
    first half, with the lowest rolling hash; a phrase holds the windows
    first .. last (starts) of one trigger. Equal windows have their trigger
    at the same place, so they lie in phrases with the same `core` (hash of
    the half window behind the trigger). `content` hashes the whole phrase,
    from its first window's start to its last window's end.
    """
    half = width // 2
    sizes = np.array([len(t) for t in texts])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if len(buf) < width:
        return None
    rolling = Rolling(buf)
    key = rolling.windows(min(TRIGGER, half))[:len(buf) - half + 1]
    key = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
    trigger = (_lowest(key, half) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - width + 1, 0))
    if not len(owner):
        return None
    counts = np.maximum(sizes - width + 1, 0)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    t = trigger[at]
    new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.concatenate((new[1:], [len(t)])) - 1
    first_at, last_at, trig, doc = at[new], at[last], t[new], owner[new]
    core = rolling.slices(trig, trig + half)
    content = mix(rolling.slices(first_at, last_at + width) ^ mix((trig - first_at).astype(np.uint64) << np.uint64(32) | (last_at - first_at).astype(np.uint64)))
    return doc, first_at - begins[doc], last_at - begins[doc], trig - begins[doc], core.view(np.int64), content.view(np.int64)


def _parsed(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
            for first, texts in batches(pdf["text"].tolist()):
                if (found := phrases(texts, width)) is not None:
                    doc, a, b, t, core, content = found
                    yield pd.DataFrame({"k1": k1[first + doc], "k2": k2[first + doc], "place": a << 24 | (b - a) << 12 | (t - a), "core": core, "content": content})
    return run


def _opened(width: int, block: int):
    """Hashes of what all windows of a block of `block` starts have in common, for every block of every opened phrase."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                rolling = Rolling(np.frombuffer(row.text.encode(), np.uint8))
                place = np.asarray(row.place, np.int64)
                a, last, t = place >> 24, place >> 12 & 0xFFF, place & 0xFFF
                lo, hi = (t - last) // block, t // block  # blocks of t - start
                n = hi - lo + 1
                which = np.repeat(np.arange(len(a)), n)
                q = lo[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = a[which] + t[which]
                yield pd.DataFrame({"k1": row.k1, "k2": row.k2, "place": place[which], "core": np.asarray(row.core, np.int64)[which], "single": np.asarray(row.single, bool)[which],
                                    "block": q.astype(np.int32), "hash": rolling.slices(at - q * block, at + width - (q + 1) * block).view(np.int64)})
    return run


def _windows(width: int, block: int):
    """Hashes of all windows of the blocks that are still in question."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                rolling = Rolling(np.frombuffer(row.text.encode(), np.uint8))
                place, q = np.asarray(row.place, np.int64), np.asarray(row.block, np.int64)
                a, last, t = place >> 24, place >> 12 & 0xFFF, place & 0xFFF
                lo, hi = np.maximum(t - last, q * block), np.minimum(t, (q + 1) * block - 1)
                n = hi - lo + 1
                which = np.repeat(np.arange(len(a)), n)
                back = lo[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = a[which] + t[which] - back
                yield pd.DataFrame({"k1": row.k1, "k2": row.k2, "single": np.asarray(row.single, bool)[which], "at": at,
                                    "core": np.asarray(row.core, np.int64)[which], "hash": rolling.slices(at, at + width).view(np.int64)})
    return run


def _without(pdf_iter: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdf_iter:
        spans, kept, sizes = [], [], []
        for text, froms, tos in zip(pdf["text"].tolist(), pdf["froms"].tolist(), pdf["tos"].tolist(), strict=True):
            data = text.encode() if isinstance(text, str) else b""
            sizes.append(len(data))
            if froms is None or not len(froms):
                spans.append([])
                kept.append(data)
                continue
            order = np.argsort(np.asarray(froms), kind="stable")
            begin, end = np.asarray(froms, np.int64)[order], np.maximum.accumulate(np.asarray(tos, np.int64)[order])
            new = np.concatenate(([True], begin[1:] > end[:-1]))
            begin, end = begin[new], end[np.concatenate((np.flatnonzero(new)[1:], [len(new)])) - 1]
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(begin, end, strict=True)])
            kept.append(b"".join(data[s:e] for s, e in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True)))
        yield pd.DataFrame({"id": pdf["id"].to_numpy(), "n_bytes": sizes, "removed": spans, "kept_bytes": kept})


def repeated_passages(evidence: DataFrame, id_col: str = "evidence_id", text_col: str = "intake_notes", width: int = 400) -> DataFrame:
    """Every record without the bytes covered by a `width`-byte string that starts anywhere else too.

    Prefix-free parsing: rolling-hash triggers cut each text into overlapping
    phrases, the dictionary holds each distinct phrase once with its count,
    the parse is the list of phrases per text. Two equal strings have the
    same trigger, so only dictionary phrases with the same core can share
    one. A phrase that occurs twice is repeated throughout, whatever its
    number of copies. Only phrases that occur once but share their core with
    another are opened: first by blocks of starts, then one window hash per
    start, counted over the dictionary. What a full suffix order of
    dictionary and parse would tell beyond this (the order of unequal
    strings) is not needed and not built. Texts are shuffled only where a
    bitmap of bounded size says that they may have such a phrase.

    Returns one row per input row: `id_col`, n_bytes, removed
    (array of start, end in bytes, maximal runs), kept_bytes (binary, as a
    cut may fall inside a character). Strings are judged on the input; they
    never cross records. Null or empty text: no bytes. Texts shorter than
    `width` keep all. Repeated rows count as other places, so their texts
    go entirely when `width` long. Null ids and extra columns do not matter.
    """
    docs = keyed(evidence.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    id_type = docs.schema["id"].dataType
    block = min(BLOCK, width // 2)
    long = docs.where(F.octet_length("text") >= width).select("k1", "k2", "text")
    parse = cut(long.mapInPandas(_parsed(width), "k1 long, k2 long, place long, core long, content long"))
    # a core that several phrases have, and whether these differ
    cores = cut(parse.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("c1"), F.max("content").alias("c2")).where("n > 1")
                .select("core", (F.col("c1") != F.col("c2")).alias("differ")))  # written, so that the join's hot cores can be split
    shared = cut(parse.join(cores, "core"))
    differ = shared.where("differ")
    dictionary = cut(differ.groupBy("core", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "place")).alias("x")))
    a, last = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(0xFFF)
    repeated = shared.where("not differ").select("k1", "k2", "place").unionByName(
        differ.join(dictionary.where("copies > 1").select("core", "content"), ["core", "content"], "left_semi").select("k1", "k2", "place"))
    whole = repeated.select("k1", "k2", a.alias("from"), (a + last + width).alias("to")).distinct()

    # one place of every dictionary phrase whose core has several phrases: blocks of starts first, then the starts of blocks that agree
    listed = lambda df, *cols: df.groupBy("k1", "k2").agg(*[F.collect_list(c).alias(c) for c in cols])  # noqa: E731  bounded by the text's length
    one = dictionary.select("x.*", "core", (F.col("copies") == 1).alias("single"))
    near = may_hold(long, bit_filter(one)).where("__may").drop("__may")
    texts = cut(near.join(listed(one, "place", "core", "single"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]))
    blocks = cut(texts.mapInPandas(_opened(width, block), "k1 long, k2 long, place long, core long, single boolean, block int, hash long"))
    alike = blocks.groupBy("core", "block", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core", "block", "hash")
    open_ = listed(blocks.join(alike, ["core", "block", "hash"], "left_semi"), "place", "core", "single", "block")
    windows = cut(texts.select("k1", "k2", "text").join(open_, ["k1", "k2"]).mapInPandas(
        _windows(width, block), "k1 long, k2 long, single boolean, at long, core long, hash long"))
    twice = windows.groupBy("core", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core", "hash")
    parts = windows.where("single").join(twice, ["core", "hash"], "left_semi").select("k1", "k2", F.col("at").alias("from"), (F.col("at") + width).alias("to"))

    spans = cut(whole.unionByName(parts))
    gone = spans.groupBy("k1", "k2").agg(F.collect_list("from").alias("froms"), F.collect_list("to").alias("tos"))
    marked = may_hold(docs.withColumn("id", F.col("id").cast("string")), bit_filter(spans))
    cuts = marked.where("__may").join(gone, ["k1", "k2"], "left").select("id", "text", "froms", "tos")
    made = cuts.mapInPandas(_without, "id string, n_bytes long, removed array<struct<start:long,end:long>>, kept_bytes binary")
    text = whole_text(F.col("text"))
    same = marked.where("not __may").select("id", F.octet_length(text).cast("long").alias("n_bytes"),
                                            F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"), text.cast("binary").alias("kept_bytes"))
    return made.unionByName(same).select(F.col("id").cast(id_type).alias(id_col), "n_bytes", "removed", "kept_bytes")
