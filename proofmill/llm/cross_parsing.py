"""Language of intake notes by cross-parsing: phrases of a text that a language's labelled text holds, found with suffix automata."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import cut

SEGMENT, BATCH_BYTES, MOST_MODEL_BYTES = 1024, 1 << 22, 1 << 29
UNKNOWN = "und"


def letters_only(text: Column) -> Column:
    """Lower-case letters and marks, every run of other characters as one blank, blanks at both ends; null without any letter."""
    return F.when(text.rlike("\\p{L}"), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}]+", " ")), F.lit(" ")))


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts all suffixes of `data`: from state 0 it reads exactly the strings that occur in it."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in data:
        new, p = len(nexts), last
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and symbol not in nexts[p]:
            nexts[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][symbol]
            if length[q] > length[p] + 1:
                # q stands for longer strings too; a copy of it stands for those that end here
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(symbol) == q:
                    nexts[p][symbol] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return nexts


def _tables(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per language: the states of its automaton as arrays. Texts are kept apart by byte 0, which no query asks for."""
    data = b"\0".join(pdf.sort_values("place")["piece"].tolist())
    nexts = suffix_automaton(data)
    branching = [s for s, n in enumerate(nexts) if len(n) > 1 or not s]
    row = np.zeros(len(nexts), np.int32)
    row[branching] = np.arange(1, len(branching) + 1)
    dense = np.full((len(branching) + 1, 256), -1, np.int32)
    for k, s in enumerate(branching, 1):
        dense[k, list(nexts[s])] = list(nexts[s].values())
    only = [next(iter(n.items())) if len(n) == 1 and s else (0, -1) for s, n in enumerate(nexts)]
    used = np.flatnonzero((dense >= 0).any(0))
    used = used[used > 0]
    return pd.DataFrame({"label": pdf["label"].iloc[:1], "n_bytes": len(data), "all_bytes": pdf["all_bytes"].iloc[:1], "row": [row.tobytes()], "used": [used.astype(np.uint8).tobytes()],
                         "dense": [np.ascontiguousarray(dense[:, used]).tobytes()], "symbol": [np.array([o[0] for o in only], np.uint8).tobytes()],
                         "target": [np.array([o[1] for o in only], np.int32).tobytes()]})


class Automata(NamedTuple):
    """The automata of all languages in one numbering of states. A state has a row of `dense`, or (row 0) one symbol and target."""
    labels: list[str]
    bits: np.ndarray    # log2 of the bytes each was learnt from
    prior: np.ndarray   # bits that its share of all labelled bytes is worth
    roots: np.ndarray
    codes: np.ndarray   # byte -> column of dense; the last column is for bytes no language has
    row: np.ndarray
    dense: np.ndarray
    symbol: np.ndarray
    target: np.ndarray


def joined(models: list) -> Automata:
    """One numbering for the models' rows of `_tables`, ordered by label."""
    used = np.unique(np.concatenate([np.frombuffer(m.used, np.uint8) for m in models])) if models else np.zeros(0, np.uint8)
    codes = np.full(256, len(used), np.int64)
    codes[used] = np.arange(len(used))
    roots, row, dense, symbol, target, states, rows = [], [], [np.full((1, len(used) + 1), -1, np.int32)], [], [], 0, 1
    for m in models:
        own, mine = np.frombuffer(m.row, np.int32), np.frombuffer(m.used, np.uint8)
        table = np.frombuffer(m.dense, np.int32).reshape(-1, len(mine))[1:]
        wide = np.full((len(table), len(used) + 1), -1, np.int32)
        wide[:, codes[mine]] = np.where(table >= 0, table + states, -1)
        to = np.frombuffer(m.target, np.int32)
        roots.append(states)
        row.append(np.where(own > 0, own - 1 + rows, 0).astype(np.int32))
        dense.append(wide)
        # byte 0 parts texts, so its code is that of no byte of a query
        sym = np.frombuffer(m.symbol, np.uint8)
        symbol.append(np.where(sym > 0, codes[sym], -1).astype(np.int32))
        target.append(np.where(to >= 0, to + states, -1).astype(np.int32))
        states, rows = states + len(own), rows + len(table)
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
    share = np.array([max(m.all_bytes, 1) for m in models], float)
    return Automata([m.label for m in models], np.log2([max(m.n_bytes, 2) for m in models]), -np.log2(share / share.sum()), np.array(roots, np.int64), codes,
                    flat(row), np.concatenate(dense), flat(symbol), flat(target))


def phrase_counts(a: Automata, texts: list[bytes]) -> np.ndarray:
    """(text, language): phrases of the text, each the longest string from where the last one ended that the language's text holds.

    A byte that it does not hold at all is a phrase of its own. All segments
    of SEGMENT bytes of all texts step through all automata together; a
    phrase ends with its segment.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    per = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), per)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * SEGMENT
    width = np.minimum(SEGMENT, sizes[owner] - begin)
    order = np.argsort(-width, kind="stable")
    owner, begin, width = owner[order], begin[order] + (np.cumsum(sizes) - sizes)[owner[order]], width[order]
    data = a.codes[np.frombuffer(b"".join(texts), np.uint8)]
    columns, flat = a.dense.shape[1], a.dense.ravel()
    first = a.dense[a.row[a.roots]]  # (language, symbol): where a phrase goes that starts with the symbol
    root = a.roots.astype(np.int32)[None, :]
    state = np.repeat(root, len(owner), 0)
    count = np.zeros(state.shape, np.int32)
    live = np.searchsorted(-width, -np.arange(SEGMENT), side="left")  # segments longer than the step
    for step in range(int(width.max(initial=0))):
        n = int(live[step])
        symbol = data[begin[:n] + step]
        at = state[:n]
        to = np.maximum(flat[a.row[at].astype(np.int64) * columns + symbol[:, None]], np.where(a.symbol[at] == symbol[:, None], a.target[at], -1))
        ended = to < 0
        if ended.any():
            start = first[:, symbol].T
            alone = ended & (start < 0)
            count[:n] += (ended & (at != root)).astype(np.int32) + alone
            to = np.where(ended, np.where(alone, root, start), to)
        state[:n] = to
    count += state != root
    out = np.zeros((len(texts), len(a.labels)), np.int64)
    np.add.at(out, owner, count)
    return out


def verdicts(a: Automata, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Language with the fewest normalised phrases, and its share of belief.

    Phrases are weighted by the bits that name a place in the language's
    text, so a smaller text is no disadvantage; belief falls by half with each
    bit. Where phrases leave it open, the language with more labelled text is
    preferred, then the label that sorts first.
    """
    cost = phrase_counts(a, texts) * a.bits[None, :] + a.prior[None, :]
    best = cost.argmin(1)
    belief = np.exp2(np.maximum(cost.min(1)[:, None] - cost, -1000.0)).sum(1)
    return [a.labels[k] for k in best.tolist()], 1 / belief


def _judged(model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = model.value
        for pdf in frames:
            ids, held, texts, first = pdf["id"].to_numpy(), pdf["held_out"].to_numpy(), pdf["letters"].tolist(), 0
            while first < len(texts):
                end, size = first, 0
                while end < len(texts) and (end == first or size < BATCH_BYTES):
                    size += len(texts[end]) if texts[end] else 0
                    end += 1
                part = [t.encode() if isinstance(t, str) else None for t in texts[first:end]]
                known = [k for k, t in enumerate(part) if t is not None and a.labels]
                label, score = np.full(len(part), UNKNOWN, object), np.zeros(len(part))
                if known:
                    label[known], score[known] = verdicts(a, [part[k] for k in known])
                yield pd.DataFrame({"id": ids[first:end], "held_out": held[first:end], "language": label, "score": score})
                first = end
    return run


def labelled_sample(rows: DataFrame, sample_bytes: int, most_languages: int) -> DataFrame:
    """(label, all_bytes, place, piece): distinct texts of every label in hash order, up to `sample_bytes` bytes a label; the last one is cut there.

    `rows`: label, text. Copies of a text count once. Rows are thinned by
    hash before they are ordered, so that an ordered group is a few times
    `sample_bytes` whatever the table's size.
    """
    sizes = cut(rows.groupBy("label").agg(F.sum(F.octet_length("text")).alias("all_bytes")))
    if (n := sizes.count()) > most_languages:
        raise ValueError(f"{n} languages are labelled, most_languages is {most_languages}")
    span = float(1 << 40)
    share = F.lit(8.0 * sample_bytes * span) / F.greatest(F.col("all_bytes"), F.lit(1))
    thin = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(sizes), "label").where(F.pmod("h", F.lit(1 << 40)) <= share)  # at most most_languages rows
    texts = thin.withColumn("letters", letters_only(F.col("text"))).where("letters is not null").groupBy("label", "h").agg(F.first("letters").alias("letters"), F.first("all_bytes").alias("all_bytes"))
    before = F.sum(F.octet_length("letters")).over(W.partitionBy("label").orderBy("h").rowsBetween(W.unboundedPreceding, -1))
    placed = texts.withColumn("place", F.coalesce(before, F.lit(0))).where(F.col("place") < sample_bytes)
    left = (F.lit(sample_bytes) - F.col("place")).cast("int")
    return placed.select("label", "all_bytes", "place", F.substring(F.col("letters").cast("binary"), F.lit(1), left).alias("piece"))


def learnt(rows: DataFrame, sample_bytes: int, most_languages: int) -> Automata:
    """Automata of all labels of `rows` (label, text), each built in one task from its sample."""
    schema = "label string, n_bytes long, all_bytes long, row binary, used binary, dense binary, symbol binary, target binary"
    made = cut(labelled_sample(rows, sample_bytes, most_languages).groupBy("label").applyInPandas(_tables, schema))
    size = made.agg(F.sum(F.length("dense") + 3 * F.length("row"))).first()[0] or 0
    if size > MOST_MODEL_BYTES:
        raise ValueError(f"the automata take {size} bytes; lower sample_bytes")
    return joined(made.orderBy("label").collect())  # bounded by MOST_MODEL_BYTES


def language_of(evidence: DataFrame, id_col: str = "evidence_id", text_col: str = "intake_notes", label_col: str = "language", folds: int = 3, held_fold: int = 1,
                sample_bytes: int = 131_072, most_languages: int = 64) -> DataFrame:
    """Language of every record's notes: the one whose labelled text parses them into the fewest normalised phrases.

    The project's records name no language; the operator is general and
    takes any table of notes with a label column. It learns from records
    with a label whose crc32(id as text) mod `folds` is not `held_fold`: at
    most `sample_bytes` bytes of distinct texts a language, in hash order,
    become a suffix automaton. Letters only are compared (lower case, all
    else is a blank). The parse starts anew every 1,024 bytes. A prediction
    sees the notes alone.

    Returns one row per input row: `id_col`, held_out, language, score (0 to
    1, belief in the language against the others). Notes without a letter,
    and all notes if nothing is labelled, give `und` with score 0. A null id
    is in no fold: neither held out nor learnt from. A label that is null
    teaches nothing; a text labelled with two languages teaches both.
    Repeated rows give repeated rows, extra columns are ignored, an empty
    table gives an empty table. More than `most_languages` labels are an
    error, as the automata travel to every task.
    """
    spark, id_type = evidence.sparkSession, evidence.schema[id_col].dataType
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    rows = evidence.select(F.col(id_col).cast("string").alias("id"), fold.alias("fold"), F.col(label_col).cast(T.StringType()).alias("label"),
                           F.col(text_col).alias("text"))
    teach = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull() & (F.col("fold") != held_fold)).select("label", "text")
    model = spark.sparkContext.broadcast(learnt(teach, sample_bytes, most_languages))
    asked = rows.select("id", F.coalesce(F.col("fold") == held_fold, F.lit(False)).alias("held_out"), letters_only(F.col("text")).alias("letters"))
    made = asked.mapInPandas(_judged(model), "id string, held_out boolean, language string, score double")
    return made.select(F.col("id").cast(id_type).alias(id_col), "held_out", "language", "score")
