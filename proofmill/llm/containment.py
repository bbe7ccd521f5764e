"""Reference passages inside intake notes: size-partitioned MinHash containment search, verified on exact shingles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import keyed, let, pieces, shingle_hashes, sized, steps, whole_text

# Words: letters and digits of any script; case and punctuation do not count.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


# Scripts that are written without blanks: each of their characters is a word.
UNSPACED = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]"


def plain_words(text: Column) -> Column:
    spaced = F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    return pieces(F.lower(whole_text(spaced)), SEPARATORS)


def shingle_texts(words: Column, n: int) -> Column:
    """Distinct runs of n words as text."""
    return let(words, lambda w: F.array_distinct(F.transform(steps(F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i + 1, n), " "))))


def _leader(hashes: str, permutation: int) -> Column:
    """The shingle with the lowest rank in a permutation."""
    return F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, F.lit(permutation)).alias("rank"), h.alias("h"))))["h"]


def reference_index(references: DataFrame, n: int, permutations: int) -> DataFrame:
    """MinHash sketches of the references: rows (h, r1, r2, size_class, weight).

    h is the shingle with the lowest rank in a permutation, weight the number
    of permutations it leads; size_class is the power of two that holds the
    reference's number of shingles.
    """
    hashed = references.select("r1", "r2", F.array_distinct(shingle_hashes(plain_words(F.col("__text")), n)).alias("hs")).where(F.size("hs") > 0)
    lead = [_leader("hs", i) for i in range(permutations)]
    return hashed.select("r1", "r2", F.ceil(F.log2(F.size("hs").cast("double"))).cast("int").alias("size_class"), F.explode(F.array(*lead)).alias("h")) \
        .groupBy("h", "r1", "r2", "size_class").agg(F.count(F.lit(1)).alias("weight"))


def _short_matches(words: DataFrame, references: DataFrame, n: int) -> DataFrame:
    """(k1, k2, r1, r2, __ref) of records that hold a reference of fewer than `n` words as a run of its own length.

    Such a reference is one shingle. Only the lengths that occur among the
    references are looked up, at most n - 1; a hash proposes, the words decide.
    """
    short = cut(references.select("r1", "r2", "__ref", plain_words(F.col("__text")).alias("run")).withColumn("width", F.size("run")).where(F.col("width").between(1, n - 1)))
    widths = sorted(r["width"] for r in short.select("width").distinct().collect())  # fewer than n
    parts = []
    for width in widths:
        mine = short.where(F.col("width") == width).select("r1", "r2", "__ref", "run", F.element_at(shingle_hashes(F.col("run"), width), 1).alias("h"))
        index, _ = sized(mine)
        runs = words.select("k1", "k2", "w", F.explode(F.array_distinct(shingle_hashes(F.col("w"), width))).alias("h"))
        padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
        parts.append(runs.join(index, "h").where(F.contains(padded(F.col("w")), padded(F.col("run")))).select("k1", "k2", "r1", "r2", "__ref").distinct())
    return reduce(DataFrame.unionByName, parts) if parts else short.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "r1", "r2", "__ref").where("false")


def containment_search(evidence: DataFrame, references: DataFrame, id_col: str = "evidence_id", text_col: str = "intake_notes",
                       reference_id_col: str = "reference_id", reference_text_col: str = "reference_text", n: int = 5, threshold: float = 0.8,
                       permutations: int = 24, least_hits: int = 5) -> DataFrame:
    """Records that hold at least `threshold` of a reference's distinct n-word shingles.

    A long text shares a tiny Jaccard similarity with a short passage, so the
    sketch is taken of the passage only, in partitions by its size: a record
    that contains a share c of a passage holds the leading shingle of each
    permutation with probability c. Records look up their shingles among
    these leaders; `least_hits` of `permutations` make a candidate (a true
    pair at 0.8 is missed with probability below 1e-8), but only in size
    classes that the record is large enough for. Candidates are verified on
    the texts of the shingles. The index is broadcast only where a count of
    its rows allows it; otherwise the lookup is a shuffled join.

    A passage of fewer than `n` words is one shingle of its own length, looked
    up exactly. Characters of scripts without blanks are words.

    Returns (id_col, reference_id_col, n_shingles, n_shared, containment), one
    row per distinct pair of texts. Texts and passages without words match
    nothing; null ids are reported as null; repeated rows are reported once;
    extra columns are ignored. The two id columns need different names.
    """
    if id_col == reference_id_col:
        raise ValueError(f"both ids would be called {id_col}; rename one")
    docs = keyed(evidence.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__id", "__text")
    refs = keyed(references.select(F.col(reference_id_col).alias("__id"), F.col(reference_text_col).alias("__text")), "__id", "__text") \
        .select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("__id").alias("__ref"), "__text").dropDuplicates(["r1", "r2"])
    index, _ = sized(reference_index(refs, n, permutations))

    words = docs.select("k1", "k2", plain_words(F.col("__text")).alias("w"))
    looked = words.select("k1", "k2", F.size("w").alias("n_words"), F.explode(shingle_hashes(F.col("w"), n)).alias("h")).join(index, "h")
    room = F.pow(F.lit(2.0), F.col("size_class") - 1) * threshold <= F.col("n_words")  # the class holds over 2^(class-1) shingles
    candidates = cut(looked.where(room).groupBy("k1", "k2", "r1", "r2").agg(F.sum("weight").alias("hits"))
                     .where(F.col("hits") >= least_hits).select("k1", "k2", "r1", "r2"))

    texts = docs.join(candidates.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    have = texts.select("k1", "k2", F.explode(shingle_texts(plain_words(F.col("__text")), n)).alias("shingle"))
    passages, _ = sized(refs.select("r1", "r2", "__ref", shingle_texts(plain_words(F.col("__text")), n).alias("__want")))
    want = candidates.join(passages, ["r1", "r2"]).select("k1", "k2", "r1", "r2", F.explode("__want").alias("shingle"))
    shared = want.join(have, ["k1", "k2", "shingle"]).groupBy("k1", "k2", "r1", "r2").agg(F.count(F.lit(1)).alias("n_shared"))
    named = shared.join(passages.select("r1", "r2", "__ref", F.size("__want").cast("long").alias("n_shingles")), ["r1", "r2"]) \
        .where(F.col("n_shared") >= threshold * F.col("n_shingles"))
    one = F.lit(1).cast("long")
    named = named.select("k1", "k2", "__ref", "n_shingles", "n_shared").unionByName(
        _short_matches(words, refs, n).select("k1", "k2", "__ref", one.alias("n_shingles"), one.alias("n_shared")))
    named = cut(named)
    ids = docs.select("k1", "k2", "__id").join(named.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").distinct()
    return named.join(ids, ["k1", "k2"]).select(F.col("__id").alias(id_col), F.col("__ref").alias(reference_id_col), "n_shingles", "n_shared",
                                                (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
