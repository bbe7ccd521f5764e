"""Quality rules for intake notes: measures of each text against thresholds learnt per language and platform."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import BLANKS, let, pieces, shingle_hashes, sized, steps, whole_text
from .sketch import merged, quantile_sketch, sketch_quantiles

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


class Rule(NamedTuple):
    """A measure, the sides that are judged, and the least spread that the fence assumes."""
    measure: str
    upper: bool
    lower: bool
    least_spread: float


# Spreads below these are taken for chance: a group of clean texts has none at all.
RULES = (
    Rule("symbol_share", True, False, 0.01),
    Rule("word_length", True, True, 0.5),
    Rule("duplicate_line_share", True, False, 0.05),
    Rule("repeat_share", True, False, 0.04),
)


def _covered(hashes: Column, width: int) -> Column:
    """Words inside windows whose hash occurs twice or more, the first included."""
    def spans(s: Column) -> Column:
        # s: sorted starts of repeated windows; each adds its width, less what the next one covers again
        return F.aggregate(F.transform(steps(F.size(s)), lambda k: F.least(F.lit(width), F.coalesce(F.get(s, k + 1) - F.get(s, k), F.lit(width)))),
                           F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(order, lambda o: F.transform(F.filter(F.transform(o, lambda x, k: F.struct(
            x["i"].alias("i"), (F.coalesce(F.get(o, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"]))
        return let(F.array_sort(again), spans)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeated(h)))


def quality_measures(evidence: DataFrame, text_col: str = "intake_notes", window: int = 8) -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and the shares that the rules judge.

    A column of the input with one of these names is replaced.
    """
    text = whole_text(F.col(text_col))
    blank = " \t\n\x0b\f\r"
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, blank, "")) > 0),
                lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")))
    measured = evidence.withColumns({
        "__words": pieces(text, BLANKS), "__lines": lines,
        "word_chars": F.length(F.translate(text, blank, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")})
    measured = measured.withColumns({
        "n_words": F.size("__words").cast("long"), "n_lines": F.col("__lines.n").cast("long"), "n_dup_lines": F.col("__lines.dup").cast("long"),
        "n_repeat_words": _covered(shingle_hashes(F.col("__words"), window), window)}).drop("__words", "__lines")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return measured.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "word_length": share("word_chars", "n_words"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")})


def quality_thresholds(measures: DataFrame, language_col: str = "language", source_col: str = "source_platform", reach: float = 6.0,
                       least_group: int = 200) -> DataFrame:
    """Fences per (language, platform), one row each: q25 - reach * spread and q75 + reach * spread.

    spread is the distance of the quartiles, at least the rule's `least_spread`.
    A platform with fewer than `least_group` texts of a language takes the
    merged sketch of the language, a language with fewer that of all texts.
    Texts that fail the fixed base rules do not count. Nulls are a group like any other.
    """
    key = {"__lang": F.coalesce(F.col(language_col), F.lit("")), "__from": F.coalesce(F.col(source_col), F.lit(""))}
    fine = quantile_sketch(measures.where("not base_failed").select(*[v.alias(k) for k, v in key.items()], *[r.measure for r in RULES]), list(key), [r.measure for r in RULES])
    fine = cut(fine)
    shares = {"q25": 0.25, "q75": 0.75}
    named = lambda df, p: df.select(*[c for c in df.columns if c not in ("total", "q25", "q75")], *[F.col(c).alias(f"{p}_{c}") for c in ("total", "q25", "q75")])
    one = named(sketch_quantiles(fine, ["__lang", "__from"], shares), "f")
    two = named(sketch_quantiles(merged(fine, ["__lang"]), ["__lang"], shares), "l")
    three = named(sketch_quantiles(merged(fine, []), [], shares), "a")
    level = one.join(two, ["__lang", "measure"]).join(F.broadcast(three), "measure")  # three: one row per rule
    pick = lambda q: F.when(F.col("f_total") >= least_group, F.col(f"f_{q}")).when(F.col("l_total") >= least_group, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    spread = F.greatest(pick("q75") - pick("q25"), F.create_map(*[F.lit(x) for r in RULES for x in (r.measure, r.least_spread)])[F.col("measure")])
    fences = level.select(*key, "measure", (pick("q75") + reach * spread).alias("hi"), (pick("q25") - reach * spread).alias("lo"))
    return fences.groupBy(*key).agg(*[F.max(F.when(F.col("measure") == r.measure, F.col(s))).alias(f"__{s}_{r.measure}") for r in RULES for s in ("lo", "hi")])


def with_base(measures: DataFrame) -> DataFrame:
    """Add base_failed, the fixed rule."""
    return measures.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def judge(measures: DataFrame, thresholds: DataFrame, language_col: str = "language", source_col: str = "source_platform") -> DataFrame:
    """Add kept and failed_rules by joining each text with the fences of its group; texts are not shuffled where the groups can be counted to be few."""
    keys = measures.withColumns({"__lang": F.coalesce(F.col(language_col), F.lit("")), "__from": F.coalesce(F.col(source_col), F.lit(""))})
    broken = []
    for r in RULES:
        v = F.col(r.measure)
        bad = (v > F.col(f"__hi_{r.measure}")) if r.upper else F.lit(False)
        if r.lower:
            bad = bad | (v < F.col(f"__lo_{r.measure}"))
        broken.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(r.measure)))
    fences, _ = sized(thresholds)
    out = keys.join(fences, ["__lang", "__from"], "left").withColumn("failed_rules", F.array_join(F.array(*broken), ","))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
    return out.drop("__lang", "__from", *[f"__{s}_{r.measure}" for r in RULES for s in ("lo", "hi")])


def quality_rules(evidence: DataFrame, id_col: str = "evidence_id", text_col: str = "intake_notes", language_col: str = "language",
                  source_col: str = "source_platform") -> DataFrame:
    """Measures and verdict of every intake record: `id_col`, the counts, the shares, base_failed, failed_rules, kept.

    Fixed rules come first (base_failed: fewer than 20 words, or over 30 % of
    words in repeated 8-word windows). The method's verdict then compares each
    share with fences learnt from mergeable quantile sketches per language and
    platform. Measures are written once, without texts, and joined with the
    fences; a platform with a third of all rows is only a hot key of that
    small join, which AQE splits.

    Null or empty text: zero counts, base_failed, not kept. Null ids,
    languages and platforms are kept as they are. Repeated rows give repeated
    rows; extra columns are ignored. An empty table gives an empty result.
    """
    measured = with_base(quality_measures(evidence.select(id_col, text_col, language_col, source_col), text_col)).drop(text_col)
    written = cut(measured)
    return judge(written, quality_thresholds(written, language_col, source_col), language_col, source_col)


def kept_records(evidence: DataFrame, text_col: str = "intake_notes", language_col: str = "language", source_col: str = "source_platform") -> DataFrame:
    """The intake records that pass, with their own columns only."""
    inner = evidence.select(F.struct("*").alias("__row"), F.col(text_col).alias("__text"), F.col(language_col).alias("__l"), F.col(source_col).alias("__s"))
    measured = with_base(quality_measures(inner, "__text"))
    fences = quality_thresholds(cut(measured.drop("__row", "__text")), "__l", "__s")
    return judge(measured, fences, "__l", "__s").where("kept").select("__row.*")
