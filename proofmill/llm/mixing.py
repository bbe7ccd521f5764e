"""Mixing intake records to target weights: iterative proportional fitting over platform, language and topic, then sampling."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import BLANKS, pieces, sized, whole_text

WHOLE = 1e6  # the factor of a value of which everything is taken
MOST_VALUES = 10_000  # languages, and topics


class Fit(NamedTuple):
    """Raked factors; `gaps` is the greatest relative distance from the wanted margin by kind, `converged` whether all are close."""

    platforms: DataFrame  # platform, a
    language: dict[str, float]
    topic: dict[str, float]
    gaps: dict[str, float]
    converged: bool


def token_count(text: Column) -> Column:
    return F.size(pieces(whole_text(text), BLANKS)).cast("long")


def layout_topic(text: Column) -> Column:
    """A coarse topic for records that carry none: the layout of the text."""
    t = whole_text(text)
    return F.when(t.contains(" | "), "list").when(t.rlike("[0-9]{4}"), "figures").when(t.contains("\n"), "paragraphs").otherwise("note")


def _target(shares: Mapping[str, float] | None, have: dict[str, float], temper: float) -> dict[str, float]:
    """Wanted share of every value that has tokens; missing ones keep their tempered share. Sums to 1."""
    total = sum(have.values())
    raw = {k: (shares or {}).get(k, (v / total) ** temper) for k, v in have.items()}
    scale = sum(raw.values()) or 1.0
    return {k: v / scale for k, v in raw.items()}


def _supplied(want: dict[str, float], most: dict[str, float]) -> dict[str, float]:
    """Wanted shares that can be supplied: what a value lacks goes to the others, in proportion to their shares."""
    full: set[str] = set()
    while True:
        rest = sum(v for k, v in want.items() if k not in full)
        scale = (1.0 - sum(most[k] for k in full)) / rest if rest > 0 else 0.0
        short = {k for k, v in want.items() if k not in full and v * scale > most[k]}
        if not short:
            return {k: most[k] if k in full else v * scale for k, v in want.items()}
        full |= short


def _supplied_platforms(raw: DataFrame) -> DataFrame:
    """The same for platforms, which may be many: `want` and `whole` from raw and most, by one-row aggregates."""
    exact = lambda c: F.coalesce(F.sum(c.cast("decimal(38,18)")), F.lit(0))
    scale = 0.0
    while True:
        full = F.col("raw") * F.lit(scale) >= F.col("most")
        r = raw.agg(exact(F.when(full, F.col("most"))).alias("full"), exact(F.when(~full, F.col("raw"))).alias("rest")).first()
        again = max(scale, (1.0 - float(r["full"])) / float(r["rest"])) if r["rest"] else scale
        if again <= scale * (1 + 1e-12):
            return raw.select("platform", "cells", F.least(F.col("most"), F.col("raw") * F.lit(scale)).alias("want"), full.alias("whole"))
        scale = again


def _lookup(values: Mapping[str, float], key: Column) -> Column:
    """Value by key through a literal map (languages and topics only: short closed lists)."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv]), key) if values else F.lit(None).cast("double")


def _platform_factor(cells: Column, want: Column, whole: Column) -> Column:
    """a with sum(n * min(1, a * f)) = want. Newton's steps on that concave, piecewise linear sum end exactly, after as many steps as cells at most."""
    def step(a: Column) -> Column:
        parts = F.aggregate(cells, F.struct(F.lit(0.0).alias("full"), F.lit(0.0).alias("rest")), lambda s, x: F.struct(
            (s["full"] + F.when(a * x["f"] >= 1, x["n"]).otherwise(0.0)).alias("full"), (s["rest"] + F.when(a * x["f"] < 1, x["n"] * x["f"]).otherwise(0.0)).alias("rest")))
        return F.when(parts["rest"] > 0, F.try_divide(want - parts["full"], parts["rest"])).otherwise(F.lit(WHOLE))

    def walk(s: Column, _: Column) -> Column:
        new = F.when(s["done"], s["a"]).otherwise(F.least(F.lit(WHOLE), step(s["a"])))
        return F.struct(F.greatest(new, s["a"]).alias("a"), (s["done"] | (new <= s["a"])).alias("done"))

    start = F.struct(F.lit(0.0).alias("a"), F.lit(False).alias("done"))
    return F.when(whole, F.lit(WHOLE)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(cells)), start, walk)["a"])


def _factors(cells: DataFrame, language: Mapping[str, float], topic: Mapping[str, float], most: Mapping[str, Mapping[str, float]], rounds: int, close: float) -> Fit:
    """Raking: (platform, a), language factors b and topic factors c. A cell's probability is a * b * c, one at most.

    cells has one row per platform with its tokens by language and topic, so
    the platform step is solved inside the row. The other two steps need two
    numbers per language or topic, added up in a Spark aggregate: tokens
    expected, and those of cells that are taken whole, which the factor does
    not move. A value whose target is all it has starts as taken whole.
    """
    wants = {"l": language, "t": topic}
    factors = {kind: {k: 0.0 if v == 0 else WHOLE if v >= most[kind][k] * (1 - 1e-12) else 1.0 for k, v in want.items()} for kind, want in wants.items()}

    def placed() -> DataFrame:
        rows = cells.withColumn("cells", F.transform("cells", lambda x: F.struct(
            x["l"].alias("l"), x["t"].alias("t"), x["n"].alias("n"), (_lookup(factors["l"], x["l"]) * _lookup(factors["t"], x["t"])).alias("f"))))
        return rows.withColumn("a", _platform_factor(F.col("cells"), F.col("want"), F.col("whole")))

    def margin(kind: str) -> dict[str, tuple[float, float]]:
        cell = placed().select("a", F.explode("cells").alias("x"))
        p = F.col("a") * F.col("x.f")
        # decimals: the same sum in whatever order the rows come
        taken, full = F.col("x.n") * F.least(F.lit(1.0), p), F.when(p >= 1, F.col("x.n")).otherwise(0.0)
        found = cell.groupBy(F.col(f"x.{kind}").alias("k")).agg(*[F.sum(v.cast("decimal(30,14)")).alias(n) for v, n in ((taken, "s"), (full, "full"))]).collect()
        return {r["k"]: (float(r["s"]), float(r["full"])) for r in found}

    def distance(kind: str, have: dict[str, tuple[float, float]]) -> float:
        return max((abs(have[k][0] / want - 1) for k, want in wants[kind].items() if want > 0), default=0.0)

    gaps = {"l": float("inf"), "t": float("inf")}
    for _ in range(rounds):
        for kind, want in wants.items():
            have = margin(kind)
            gaps[kind] = distance(kind, have)
            for k, (taken, full) in have.items():
                if 0 < want[k] < most[kind][k] * (1 - 1e-12) and taken > 0:
                    moved = (want[k] - full) / (taken - full) if want[k] > full and taken > full else want[k] / taken
                    factors[kind][k] = min(WHOLE, factors[kind][k] * moved)
        if max(gaps.values()) < close:
            break
    gaps = {kind: distance(kind, margin(kind)) for kind in wants}
    reached = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["n"] * F.least(F.lit(1.0), F.col("a") * x["f"]))
    done = cut(placed().select("platform", "a", F.abs(F.try_divide(reached, F.col("want")) - 1).alias("off")))
    gaps = {"platform": done.agg(F.max("off")).first()[0] or 0.0, "language": gaps["l"], "topic": gaps["t"]}
    return Fit(done.select("platform", "a"), factors["l"], factors["t"], gaps, max(gaps.values()) < 2 * close)


def fit_mixture(evidence: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, source_col: str = "source_platform", language_col: str = "language",
                topic_col: str = "topic", tokens_col: str = "n_tokens", share: float = 0.3, temper: float = 0.7, rounds: int = 50, close: float = 1e-4) -> Fit:
    """Factors of platforms, languages and topics, and how near they come to the wanted margins. See `mixture`."""
    targets = targets or {}
    key = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (source_col, language_col, topic_col)}
    n = F.coalesce(F.col(tokens_col), F.lit(0)).cast("double")
    counted = cut(evidence.groupBy(key[source_col].alias("platform"), key[language_col].alias("l"), key[topic_col].alias("t")).agg(F.sum(n).alias("n")).where("n > 0"))

    def tokens(column: str, name: str) -> dict[str, float]:
        rows = counted.groupBy(column).agg(F.sum("n")).limit(MOST_VALUES + 1).collect()
        if len(rows) > MOST_VALUES:
            raise ValueError(f"{name} has more than {MOST_VALUES} values: its factors travel with the plan; rake such a column as the platform")
        return {r[0]: r[1] for r in rows}

    by = {"l": tokens("l", language_col), "t": tokens("t", topic_col)}
    total = sum(by["l"].values()) or 1.0
    # tokens as shares of the wanted sample, so that every margin sums to 1
    most = {kind: {k: v / (total * share) for k, v in have.items()} for kind, have in by.items()}
    language = _supplied(_target(targets.get(language_col), by["l"], temper), most["l"])
    topic = _supplied(_target(targets.get(topic_col), by["t"], temper), most["t"])
    platforms = counted.groupBy("platform").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("l", "t", (F.col("n") / F.lit(total * share)).alias("n")))).alias("cells"))
    wanted = _lookup(dict(targets.get(source_col, {})), F.col("platform"))
    raw = cut(platforms.select("platform", "cells", (F.col("n") / F.lit(total * share)).alias("most"), F.coalesce(wanted, F.pow(F.col("n") / total, F.lit(temper))).alias("raw")))
    return _factors(cut(_supplied_platforms(raw)), language, topic, most, rounds, close)


def mixture(evidence: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, id_col: str = "evidence_id", source_col: str = "source_platform",
            language_col: str = "language", topic_col: str = "topic", tokens_col: str = "n_tokens", share: float = 0.3, temper: float = 0.7, rounds: int = 50,
            close: float = 1e-4, seed: int = 7, strict: bool = False) -> DataFrame:
    """The input with weight, probability and sampled, so that the sampled tokens follow three target margins.

    targets names wanted shares by column ({column: {value: share}}); values
    without one keep their share of tokens raised to `temper`, which lifts
    small platforms and flattens a large one. A value with fewer tokens than
    its target asks for is taken whole, and what it lacks goes to the other
    values of its margin, in proportion to their targets. Token sums per
    (platform, language, topic) are raked until the expected sample, `share`
    of all tokens, meets the margins within `close` or `rounds` have passed.
    Margins that contradict each other cannot all be met: then a warning (with
    strict: an error) names the gap of each; `fit_mixture` returns them. A
    record's weight is the product of its three factors (WHOLE for one taken
    whole), its probability the weight, at most 1. A record is sampled if a
    hash of its id falls below its probability: the same records on every
    run, for any partitioning.

    Nulls of the three columns count as ''. Null or zero tokens: a record
    adds nothing and takes the weight of its cell; a platform, language or
    topic without any token has weight 0, and so has a value whose target is
    0. More than MOST_VALUES languages or topics are an error. Rows with one id fall together.
    Extra columns pass through; weight, probability and sampled are replaced.
    """
    key = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (source_col, language_col, topic_col)}
    fit = fit_mixture(evidence, targets, source_col, language_col, topic_col, tokens_col, share, temper, rounds, close)
    if not fit.converged:
        text = "targets are not met after %d rounds; greatest relative gap: %s" % (rounds, ", ".join(f"{k} {v:.4f}" for k, v in fit.gaps.items()))
        if strict:
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)
    factors, _ = sized(fit.platforms.select(F.col("platform").alias("__platform"), F.col("a").alias("__a")))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) / F.lit(float(1 << 53))
    weight = F.coalesce(F.col("__a") * _lookup(fit.language, key[language_col]) * _lookup(fit.topic, key[topic_col]), F.lit(0.0))
    out = evidence.withColumn("__platform", key[source_col]).join(factors, "__platform", "left")
    return out.withColumn("weight", weight).withColumn("probability", F.least(F.lit(1.0), F.col("weight"))) \
        .withColumn("sampled", u < F.col("probability")).drop("__platform", "__a")
