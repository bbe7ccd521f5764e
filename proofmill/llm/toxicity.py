"""Toxicity of intake notes: a logistic classifier that is indifferent to swapped identity terms."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import pieces, whole_text

# Terms of one line name people of one kind of group and may stand for one another in a sentence.
IDENTITY_TERMS = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("female", "male"), ("mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "brown"), ("african", "asian", "european", "american", "arab", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("deaf", "blind", "disabled"), ("old", "young"), ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"),
    ("frau", "mann"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("femme", "homme"), ("femmes", "hommes"), ("musulman", "chrétien", "juif"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("musulmán", "cristiano", "judío"),
)
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WEIGHT_BITS = 20


class Model(NamedTuple):
    """One weight for each of 2 ** WEIGHT_BITS hashes of terms, and the bias."""
    weights: np.ndarray
    bias: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def swapped(terms: set[str]) -> list[tuple[str, str]]:
    """(identity term, its stand-in) for each identity term of a text: the next of its line that the text lacks."""
    out = []
    for line in IDENTITY_TERMS:
        for k, term in enumerate(line):
            if term in terms:
                others = [x for x in (*line[k + 1:], *line[:k]) if x not in terms]
                if others:
                    out.append((term, others[0]))
    return out


def strength(n: int, positive: float, count: np.ndarray, count_positive: np.ndarray, unit: float = 5.0) -> np.ndarray:
    """How far a weight may be moved by its evidence: squared standard deviations between its labels and chance, in units of `unit`.

    A term seen once moves a little, one seen in many texts of one label
    freely; none is left out.
    """
    rate = min(max(positive / n, 1e-6), 1 - 1e-6) if n else 0.5
    z = (count_positive - count * rate) / np.sqrt(count * rate * (1 - rate) + 0.5)
    return (z / unit) ** 2


def fit_weights(sizes: np.ndarray, column: np.ndarray, labels: np.ndarray, scale: np.ndarray, swaps: list[tuple[int, int, int]], penalty: float, ridge: float,
                rounds: int) -> tuple[np.ndarray, float]:
    """(weight per column, bias) of a logistic regression on the columns each row has: `sizes` of the rows, their columns one after another.

    A column's weight is its scale times a free part. Loss: log loss + ridge *
    sum of squared free parts + penalty * mean squared change of the score
    under swaps (row, column taken out, column put in).
    """
    n, d = len(sizes), len(scale)

    def sums(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of each run of values; runs may be empty."""
        out = np.zeros(len(counts))
        some = np.flatnonzero(counts)
        if len(some):
            out[some] = np.add.reduceat(values, starts[some])
        return out

    row_starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)[np.argsort(column, kind="stable")]  # rows in the order of their columns
    column_counts = np.bincount(column, minlength=d)
    column_starts = np.cumsum(column_counts) - column_counts
    changed, plus, minus = (np.array(c, np.int64) for c in (zip(*swaps, strict=True) if swaps else ([], [], [])))
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    rate = float(np.clip(labels.mean(), 0.01, 0.99))
    w[d] = np.log(rate / (1 - rate))
    for step in range(1, rounds + 1):
        weight = w[:d] * scale
        score = sums(weight[column], row_starts, sizes) + w[d]
        error = (_sigmoid(score) - labels) / n
        grad = sums(error[owner], column_starts, column_counts)
        if len(swaps):
            change = np.bincount(changed, weight[minus] - weight[plus], n)[changed] * 2 * penalty / n
            grad += np.bincount(minus, change, d) - np.bincount(plus, change, d)
        grad = np.append(grad * scale + 2 * ridge * w[:d], error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return w[:d] * scale, float(w[d])


def terms_of(text: Column) -> Column:
    """Distinct terms of a text: runs of letters and digits, lower case."""
    return F.array_distinct(pieces(F.lower(whole_text(text)), SEPARATORS))


def slot_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(1 << WEIGHT_BITS)).cast("int")


def slots_of(terms: Column) -> Column:
    """Distinct places of a text's terms among the weights."""
    return F.array_sort(F.array_distinct(F.transform(terms, slot_of)))


def fit_toxicity(evidence: DataFrame, labels: DataFrame, id_col: str = "evidence_id", text_col: str = "intake_notes", label_col: str = "toxic",
                 most_labels: int = 20_000, penalty: float = 1.0, ridge: float = 2e-6, rounds: int = 200) -> Model:
    """Weights fitted on at most `most_labels` labelled records, those with the lowest hash of the id.

    Every term has a weight, by its hash; none is chosen or dropped. How far
    it may move follows from its counts by label, a Spark aggregate over
    these records. What reaches the driver is bounded by `most_labels`
    records and 2 ** WEIGHT_BITS counts.
    """
    spark = evidence.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.avg(F.col(label_col).cast("double")).alias("__y"))
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(most_labels)
    rows = cut(evidence.select(id_col, text_col).join(F.broadcast(sample), id_col).withColumn("terms", terms_of(F.col(text_col)))
               .select(slots_of(F.col("terms")).alias("slots"),
                       F.array_sort(F.array_intersect("terms", F.array(*[F.lit(t) for line in IDENTITY_TERMS for t in line]))).alias("identity"), F.col("__y").alias("y")))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).first()
    if not total["n"]:
        return Model(np.zeros(1 << WEIGHT_BITS), 0.0)
    counts = rows.select("y", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).cast("int").alias("c"), F.sum("y").cast("float").alias("cy")).toPandas()
    places = counts["slot"].to_numpy(np.int64)
    scale = np.zeros(1 << WEIGHT_BITS, np.float32)
    scale[places] = strength(total["n"], total["y"] or 0.0, counts["c"].to_numpy(float), counts["cy"].to_numpy(float))
    del counts, places
    names = sorted({t for line in IDENTITY_TERMS for t in line})
    found = spark.createDataFrame([(t,) for t in names], "t string").select("t", slot_of(F.col("t")).alias("slot")).collect()  # one row per identity term
    at = {r["t"]: r["slot"] for r in found}
    # a term that stands in for others may move by the penalty's pull, even where no text has it
    scale[list(at.values())] = np.maximum(scale[list(at.values())], 1.0)
    fitted = rows.orderBy("slots", "y").toPandas()  # the same sums whatever order the rows arrive in
    swaps = [(k, at[a], at[b]) for k, terms in enumerate(fitted["identity"]) for a, b in swapped(set(terms))]
    sizes, y = np.array([len(x) for x in fitted["slots"]], np.int64), fitted["y"].to_numpy(float)
    flat = np.concatenate([np.zeros(0, np.int32), *fitted["slots"]]).astype(np.int32)
    del fitted
    used = np.unique(np.concatenate([flat, np.array([p for _, a, b in swaps for p in (a, b)], np.int32)]))
    rank = np.zeros(1 << WEIGHT_BITS, np.int32)
    rank[used] = np.arange(len(used), dtype=np.int32)
    small, bias = fit_weights(sizes, rank[flat], y, scale[used].astype(float), [(k, int(rank[a]), int(rank[b])) for k, a, b in swaps], penalty, ridge, rounds)
    weights = np.zeros(1 << WEIGHT_BITS, np.float32)
    weights[used] = small
    return Model(weights, bias)


def score_toxicity(evidence: DataFrame, model: Model, id_col: str = "evidence_id", text_col: str = "intake_notes") -> DataFrame:
    """`id_col` and score (0 to 1) of every record; a text without terms gets the bias alone."""
    sent = evidence.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 4 MB

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias = sent.value
        for pdf in frames:
            sizes = np.array([len(x) for x in pdf["slots"]], np.int64)
            flat = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in pdf["slots"]]])
            z = np.bincount(np.repeat(np.arange(len(pdf)), sizes), weights[flat], len(pdf)) + bias
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "score": _sigmoid(z)})

    id_type = evidence.schema[id_col].dataType
    rows = evidence.select(F.col(id_col).cast("string").alias("id"), slots_of(terms_of(F.col(text_col))).alias("slots"))
    return rows.mapInPandas(run, "id string, score double").select(F.col("id").cast(id_type).alias(id_col), "score")


def toxicity(evidence: DataFrame, labels: DataFrame, id_col: str = "evidence_id", text_col: str = "intake_notes", label_col: str = "toxic", folds: int = 5,
             **fit) -> DataFrame:
    """Toxicity score of every record: `id_col`, held_out, score, predicted (1 if score >= 0.5).

    Records whose crc32(id as text) mod `folds` is 0 are held out: their labels
    are not read. In every labelled text with an identity term the term is
    swapped for another of its line, and the change of the score is penalised,
    so a neutral mention of a group does not raise it. Only the text is an
    input of the score.

    Null and empty texts get the score of the bias; null ids count as empty
    text in the fold rule; null labels are not read, several labels of one id
    are averaged; repeated rows give repeated rows; without any label the
    score is 0.5. Extra columns are ignored.
    """
    held = lambda df: F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0
    model = fit_toxicity(evidence, labels.where(~held(labels)).select(id_col, label_col), id_col, text_col, label_col, **fit)
    scored = score_toxicity(evidence, model, id_col, text_col)
    return scored.select(id_col, held(scored).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
