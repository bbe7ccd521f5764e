"""Rule tables applied as columns: filters, applicability, dispatch, relations, assessments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_array(rows: Sequence[Mapping[str, object]]) -> Column:
    """A fixed rule table as one literal array of structs (explode it; no join, no broadcast)."""
    def lit(v: object) -> Column:
        if not isinstance(v, (list, tuple)):
            return F.lit(v)
        return F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<int>")
    return F.array(*[F.struct(*[lit(v).alias(k) for k, v in row.items()]) for row in rows])


def first_rule(cases: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    """Value of the first condition that holds."""
    out = F.lit(otherwise)
    for cond, value in reversed(cases):
        out = F.when(cond, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


# ---- filters -------------------------------------------------------------

class SearchSpec(NamedTuple):
    entity: str
    df: DataFrame
    key: str
    title: str
    text: tuple[str, ...]


def search(specs: Sequence[SearchSpec], term: str, per_entity: int, limit: int, snippet: int = 80) -> DataFrame:
    """Case-insensitive keyword hits over several entities, tagged, in a stated order."""
    out = None
    for s in specs:
        cond = F.lit(False)
        for c in (s.title, *s.text):
            cond = cond | F.col(c).ilike(f"%{term}%")
        body = F.col(s.text[0]) if s.text else F.col(s.title)
        hit = s.df.where(cond).select(
            F.lit(s.entity).alias("entity"), F.col(s.key).cast("long").alias("id"), F.col(s.title).alias("title"),
            F.substring(body, 1, snippet).alias("snippet")).orderBy("id").limit(per_entity)
        out = hit if out is None else out.unionByName(hit)
    return out.orderBy("entity", "id").limit(limit)


# Audit category -> event type prefixes.
AUDIT_CATEGORIES = {
    "EVIDENCE": ("EVIDENCE_",), "ANALYSIS": ("ANALYSIS_", "JOB_"), "FINDING": ("FINDING_",),
    "CASE": ("CASE_",), "REPORT": ("REPORT_",),
}


def audit_filter(df: DataFrame, category: str | None, limit: int | None = None) -> DataFrame:
    """Events of a category (literal prefixes; otherwise contains), newest first."""
    if category:
        prefixes = AUDIT_CATEGORIES.get(category.upper())
        if prefixes is None:
            cond = F.col("event_type").ilike(f"%{category}%")
        else:
            cond = F.lit(False)
            for p in prefixes:
                cond = cond | F.startswith(F.col("event_type"), F.lit(p))
        df = df.where(cond)
    df = df.orderBy(F.desc("timestamp"), F.desc("id"))
    return df if limit is None else df.limit(limit)


def applicability(items: DataFrame, engines: Sequence[Mapping[str, object]]) -> DataFrame:
    """Every item against every engine of a fixed list: applicable or not, and why.

    Engines carry engine, formats, min_dim, max_dim; items carry format and dim.
    """
    e = items.withColumn("e", F.explode(rule_array(engines)))
    reason = first_rule([
        (~F.array_contains(F.col("e.formats"), F.col("format")), "FORMAT_NOT_SUPPORTED"),
        (F.col("dim") < F.col("e.min_dim"), "BELOW_MINIMUM_SIZE"),
        (F.col("dim") > F.col("e.max_dim"), "ABOVE_MAXIMUM_SIZE"),
    ], "APPLICABLE")
    return e.withColumn("engine", F.col("e.engine")).withColumn("reason", reason) \
        .withColumn("applicable", F.col("reason") == "APPLICABLE").drop("e")


def dispatch(items: DataFrame, engines: Sequence[Mapping[str, object]]) -> DataFrame:
    """RUN or the reason to skip: missing prerequisite, then format, then target class.

    Engines carry engine, needs_prereq, jpeg_only, targets (empty = any); items carry format and target.
    """
    e = items.withColumn("e", F.explode(rule_array(engines)))
    decision = first_rule([
        (F.col("e.needs_prereq"), "SKIP (Prereq)"),
        (F.col("e.jpeg_only") & (F.col("format") != "JPEG"), "SKIP (Format)"),
        ((F.size("e.targets") > 0) & ~F.array_contains(F.col("e.targets"), F.col("target")), "SKIP (Target)"),
    ], "RUN")
    return e.withColumn("engine", F.col("e.engine")).withColumn("decision", decision).drop("e")


# Fixed values.
ACTIVE_DIRECTIONS = ("elevated", "suppressed", "present", "candidate")


def active_only(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("direction").isin(*ACTIVE_DIRECTIONS))


def due_rows(df: DataFrame, now: Column, limit: int) -> DataFrame:
    """Undispatched rows whose time has come, by id, with their next attempt delay."""
    from ..functions.numeric import backoff_seconds
    return (df.where(F.col("dispatched_at").isNull() & (F.col("next_attempt_at") <= now))
            .withColumn("attempt", F.col("attempt_count") + 1)
            .withColumn("delay_s", backoff_seconds(F.col("attempt")))
            .orderBy("id").limit(limit))


def visible_regions(regions: DataFrame, layers: Sequence[str], n: int) -> DataFrame:
    """The n strongest finite regions of the chosen layers."""
    ok = F.col("layer").isin(*layers)
    for c in ("x", "y"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return regions.where(ok).orderBy(F.desc("intensity"), "id").limit(n)


# ---- relations and assessments -------------------------------------------

# Evidence families of the five modalities.
FAMILY = {"ELA": "Compression", "JPEG_DCT": "Compression", "NOISE": "Residual",
          "COPY_MOVE": "Spatial Correspondence", "METADATA": "File Context"}

# Co-occurrence rules. None means any value.
RELATION_RULES = (
    {"a": "ELA", "a_type": None, "a_dir": None, "b": "JPEG_DCT", "b_dir": None,
     "relation": "CONTEXTUAL", "strength": "MODERATE"},
    {"a": "METADATA", "a_type": "SOFTWARE_SIGNATURE", "a_dir": "present", "b": "ELA", "b_dir": "elevated",
     "relation": "CONTEXTUAL", "strength": "MODERATE"},
    {"a": "COPY_MOVE", "a_type": None, "a_dir": "candidate", "b": "METADATA", "b_dir": "absent",
     "relation": "INDEPENDENT", "strength": "MODERATE"},
)
# Fixed values.
STRONG = ("strong", "HIGH", "high")


def latest_per_modality(obs: DataFrame, order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """One row per item; for each modality a struct of its latest observation or NULL.

    A conditional max_by, so it combines before the shuffle and a huge item stays cheap.
    """
    pos, row = F.struct(*order), F.struct(*carry)
    return obs.groupBy("item_id").agg(*[
        F.max_by(F.when(F.col("modality") == m, row), F.when(F.col("modality") == m, pos)).alias(m) for m in FAMILY])


def relations(latest: DataFrame) -> DataFrame:
    """Rule pairs that hold for an item's latest observations (needs type, direction, ref)."""
    hits = []
    for rule in RELATION_RULES:
        a, b = F.col(rule["a"]), F.col(rule["b"])
        cond = a.isNotNull() & b.isNotNull()
        for side, field, want in ((a, "observation_type", rule["a_type"]), (a, "direction", rule["a_dir"]),
                                  (b, "direction", rule["b_dir"])):
            if want is not None:
                cond = cond & (side[field] == want)
        hits.append(F.when(cond, F.struct(
            a["ref"].alias("obs_a"), b["ref"].alias("obs_b"), F.lit(rule["relation"]).alias("relation_type"),
            F.lit(rule["strength"]).alias("strength"))))
    return latest.select("item_id", F.explode(F.array_compact(F.array(*hits))).alias("r")) \
        .select("item_id", "r.*")


def assess(items: DataFrame, obs: DataFrame, strong_items: DataFrame | None = None) -> DataFrame:
    """Concern level per item from its distinct active evidence families.

    `items` (item_id) keeps items without observations; `strong_items`
    (item_id) are those with a relation of high strength.
    """
    fam = F.lit(None).cast("string")
    for modality, name in FAMILY.items():
        fam = F.when(F.col("modality") == modality, name).otherwise(fam)
    active = F.col("direction").isin(*ACTIVE_DIRECTIONS)
    short = {"Compression": "f_comp", "Residual": "f_res", "Spatial Correspondence": "f_spat", "File Context": "f_ctx"}
    per_item = obs.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("observations"),
        *[F.max(active & (fam == name)).alias(c) for name, c in short.items()])
    out = items.join(per_item, "item_id", "left")
    if strong_items is None:
        out = out.withColumn("strong", F.lit(False))
    else:
        flagged = strong_items.select("item_id").distinct().withColumn("strong", F.lit(True))
        out = out.join(flagged, "item_id", "left").withColumn("strong", F.coalesce("strong", F.lit(False)))
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in short.values()}
    n = sum((f.cast("int") for f in flags.values()), F.lit(0))
    level = first_rule([
        (F.col("observations").isNull(), "INSUFFICIENT_EVIDENCE"),
        (n == 0, "LOW_FORENSIC_CONCERN"),
        ((n == 1) & flags["f_ctx"], "LOW_FORENSIC_CONCERN"),
        (n == 1, "MODERATE_FORENSIC_CONCERN"),
        ((n == 2) & flags["f_comp"] & flags["f_ctx"], "MODERATE_FORENSIC_CONCERN"),
        ((n >= 3) | (flags["f_spat"] & (flags["f_comp"] | flags["f_res"]) & F.col("strong")), "HIGH_FORENSIC_CONCERN"),
    ], "ELEVATED_FORENSIC_CONCERN")
    return out.select("item_id", F.coalesce("observations", F.lit(0)).cast("long").alias("observations"),
                      n.cast("long").alias("families"), level.alias("level"))


# ---- findings ------------------------------------------------------------

RULE_VERSION = "1.0"
# Titles, and the modality whose observations support a finding.
FINDING_TITLES = {
    "CORR-META-001": "Metadata Editing History & Encoding Characteristics Alignment", "CORR-COMP-002": "Compression Consistency & Quantization Grid Correlation",
    "CORR-NOISE-003": "Sensor Noise Residual & High-Frequency Structure Analysis", "CORR-CLONE-004": "Copy-Move Keypoint Spatial Analysis (Baseline)",
    "CORR-CONFLICT-005": "Modality Conflict: JPEG/DCT Analysis Inapplicable to PNG Source",
    "CORR-CONFLICT-005-META-EMPTY": "Explanatory Notice: Complete Absence of EXIF Metadata",
}
CLUSTER_TITLE = "Duplicated Region Keypoint Clustering Identified"
SUPPORTING_MODALITY = {"CORR-META-001": "METADATA", "CORR-COMP-002": "ELA", "CORR-NOISE-003": "NOISE", "CORR-CLONE-004": "COPY_MOVE"}
# Finding rules (id, type). Severity and condition are in `findings`.
FINDING_TYPES = {
    "CORR-META-001": "CORRELATED_OBSERVATION", "CORR-COMP-002": "CORRELATED_OBSERVATION", "CORR-NOISE-003": "CORRELATED_OBSERVATION",
    "CORR-CLONE-004": "CORRELATED_OBSERVATION", "CORR-CONFLICT-005": "CONFLICT_DETECTED", "CORR-CONFLICT-005-META-EMPTY": "CONFLICT_DETECTED",
}


def findings(items: DataFrame, states: DataFrame) -> DataFrame:
    """All rules over one row per item: (item_id, rule_id, rule_version, finding_type, severity, title, analyses).

    `analyses` lists the refs of the supporting analyses; the supporting
    observations are rows of their own, see `finding_observations`.

    items: item_id, lossless (boolean). states: item_id and, per modality, a
    struct (completed, flagged, count, ref) of its analysis, NULL when not run.
    Every rule reads the same row, so the six rules cost one pass, not six.
    """
    meta, ela, noise, dct, clone = (F.col(m) for m in ("METADATA", "ELA", "NOISE", "JPEG_DCT", "COPY_MOVE"))
    joined = items.join(states, "item_id", "left")

    def on(c: Column, flag: str) -> Column:
        return F.coalesce(c[flag], F.lit(False))

    def hit(rule: str, cond: Column, severity: Column | str, *support: Column) -> Column:
        sev = severity if isinstance(severity, Column) else F.lit(severity)
        title = F.lit(FINDING_TITLES[rule])
        if rule == "CORR-CLONE-004":
            title = F.when(clone["count"] > 5, CLUSTER_TITLE).otherwise(title)
        refs = F.array_compact(F.array(*[c["ref"] for c in support])) if support else F.array().cast("array<string>")
        return F.when(cond, F.struct(F.lit(rule).alias("rule_id"), F.lit(RULE_VERSION).alias("rule_version"),
                                     F.lit(FINDING_TYPES[rule]).alias("finding_type"), sev.alias("severity"), title.alias("title"), refs.alias("analyses")))
    hits = F.array(
        hit("CORR-META-001", on(meta, "flagged"), "REVIEW_REQUIRED", meta, dct),
        hit("CORR-COMP-002", on(ela, "completed") & (on(ela, "flagged") | on(dct, "completed")), "CORRELATED_OBSERVATION", ela, dct),
        hit("CORR-NOISE-003", on(noise, "completed"), "OBSERVATION", noise),
        hit("CORR-CLONE-004", on(clone, "completed"), F.when(clone["count"] > 5, "REVIEW_REQUIRED").otherwise("OBSERVATION"), clone),
        hit("CORR-CONFLICT-005", F.col("lossless"), "INCONCLUSIVE"),
        hit("CORR-CONFLICT-005-META-EMPTY", on(meta, "completed") & ~on(meta, "flagged") & (meta["count"] == 0), "OBSERVATION", meta),
    )
    return joined.select("item_id", F.explode(F.array_compact(hits)).alias("f")).select("item_id", "f.*")


def finding_observations(found: DataFrame, observations: DataFrame, ref: str) -> DataFrame:
    """Every observation that supports a finding: (item_id, rule_id, ref), all of the rule's modality on the item.

    observations: item_id, modality and the column `ref`.
    """
    modality = F.element_at(F.create_map(*[F.lit(x) for kv in SUPPORTING_MODALITY.items() for x in kv]), F.col("rule_id"))
    return found.select("item_id", "rule_id", modality.alias("modality")).join(observations.select("item_id", "modality", ref), ["item_id", "modality"]) \
        .select("item_id", "rule_id", F.col(ref).alias("ref"))


# Which operation an engine speaks about.
ENGINE_OPERATION = {
    "ADJPEG": "JPEG_REENCODING", "NADJPEG": "JPEG_REENCODING", "JPEG_GHOST": "JPEG_REENCODING", "JPEG_QT": "JPEG_REENCODING",
    "JPEG_STRUCTURE": "JPEG_REENCODING", "JPEG_HUFFMAN": "JPEG_REENCODING", "JPEG_DCT": "JPEG_REENCODING",
    "ELA": "RECOMPRESSION_DIFFERENCE", "RESAMPLING": "RESIZING_OR_RESAMPLING", "BLOCKING_ARTIFACT": "BLOCK_BOUNDARY_PATTERN",
}
# Directions that count as a signal.
ELEVATED_DIRECTIONS = ("anomalous", "elevated", "high", "positive", "inconsistent")


def processing_signals(analyses: DataFrame) -> DataFrame:
    """Operation and indicator of every completed analysis with a known engine.

    analyses: item_id, analysis_id, engine, status, direction, document (JSON text).
    """
    from ..functions.jsonx import any_flag
    from ..functions.text import canonical_key
    table = F.create_map(*[F.lit(x) for pair in ENGINE_OPERATION.items() for x in pair])
    rows = analyses.where(F.lower("status").isin("completed", "complete")) \
        .withColumn("operation", F.element_at(table, canonical_key(F.col("engine")))).where("operation is not null")
    candidate = F.coalesce(F.lower(F.trim("direction")).isin(*ELEVATED_DIRECTIONS), F.lit(False)) | any_flag(F.col("document"))
    regions = F.coalesce(F.get_json_object("document", "$.candidate_region_count").try_cast("long") > 0, F.lit(False)) \
        | F.get_json_object("document", "$.candidate_regions[0]").isNotNull()  # a list with any entry
    candidate = candidate | ((F.col("operation") == "RESIZING_OR_RESAMPLING") & regions)
    return rows.select("item_id", "analysis_id", "engine", "operation", candidate.alias("candidate"))


def processing_sequences(signals: DataFrame) -> DataFrame:
    """Candidate operation sequences per item from the operations indicated on it."""
    has = signals.groupBy("item_id").agg(
        F.max(F.col("candidate") & (F.col("operation") == "JPEG_REENCODING")).alias("jpeg"),
        F.max(F.col("candidate") & (F.col("operation") == "RESIZING_OR_RESAMPLING")).alias("resize"), F.count(F.lit(1)).alias("signals"))
    steps = (F.when(F.col("jpeg") & F.col("resize"), F.array(F.lit("RESIZING_OR_RESAMPLING>JPEG_REENCODING"), F.lit("JPEG_REENCODING>RESIZING_OR_RESAMPLING")))
             .when(F.col("jpeg"), F.array(F.lit("UNOBSERVED_PRIOR_HISTORY>JPEG_REENCODING")))
             .when(F.col("resize"), F.array(F.lit("UNOBSERVED_PRIOR_HISTORY>RESIZING_OR_RESAMPLING>UNOBSERVED_LATER_HISTORY")))
             .otherwise(F.array(F.lit("NONE"))))
    ordering = F.when(F.col("jpeg") & F.col("resize"), "POSSIBLE_NOT_ESTABLISHED").when(F.col("jpeg") | F.col("resize"), "PARTIAL_HISTORY_ONLY").otherwise("NONE")
    return has.select("item_id", "signals", F.explode(steps).alias("sequence"), ordering.alias("ordering_status"))


def next_steps(cases: DataFrame, coverage_rows: DataFrame) -> DataFrame:
    """Recommendation rows per case.

    cases: case_id, unreviewed, items, cross_findings; coverage_rows: case_id, modality, pending, percentage.
    """
    def row(df: DataFrame, cond: Column, priority: Column | str, action: Column) -> DataFrame:
        p = priority if isinstance(priority, Column) else F.lit(priority)
        return df.where(cond).select("case_id", p.alias("priority"), action.alias("action"))

    review = row(cases, F.col("unreviewed") > 0, "HIGH", F.concat(F.lit("REVIEW "), F.col("unreviewed").cast("string")))
    batch = row(coverage_rows, F.col("pending") > 0, F.when(F.col("percentage") > 50, "MEDIUM").otherwise("HIGH"),
                F.concat(F.lit("RUN "), "modality", F.lit(" ON "), F.col("pending").cast("string")))
    cross = row(cases, (F.col("items") >= 2) & (F.col("cross_findings") == 0), "MEDIUM", F.lit("CROSS_ITEM_CORRELATION"))
    custody = row(cases, F.lit(True), "LOW", F.lit("REVERIFY_CUSTODY"))
    return review.unionByName(batch).unionByName(cross).unionByName(custody)


# ---- normalisation --------------------------------------------------------

class MeasureSpec(NamedTuple):
    """One modality: where its number is, which threshold counts, and what each side is called."""

    modality: str
    paths: tuple[str, ...]
    threshold: float
    at_or_above: str
    below: str


def normalise(analyses: DataFrame, specs: Sequence[MeasureSpec]) -> tuple[DataFrame, DataFrame]:
    """(observations, rejected rows) from JSON result documents by a declarative path map.

    analyses: item_id, analysis_id, modality, document. A document without a
    readable number goes to the reject table instead of failing the job.
    """
    from ..functions.jsonx import path_double, path_text
    value, raw, direction, known = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for s in specs:
        mine = F.col("modality") == s.modality
        number = path_double(F.col("document"), s.paths)
        value = F.when(mine, number).otherwise(value)
        raw = F.when(mine, path_text(F.col("document"), s.paths)).otherwise(raw)
        direction = F.when(mine, F.when(number >= s.threshold, s.at_or_above).otherwise(s.below)).otherwise(direction)
        known = known | mine
    read = analyses.withColumn("normalized_value", value).withColumn("raw_value", raw).withColumn("direction", direction).withColumn("known", known)
    good = read.where("known and normalized_value is not null").select("item_id", "analysis_id", "modality", "raw_value", "normalized_value", "direction")
    reason = F.when(~F.col("known"), "UNKNOWN_MODALITY").when(F.try_parse_json("document").isNull(), "UNPARSABLE").otherwise("NO_VALUE")
    bad = read.where("not known or normalized_value is null").select("item_id", "analysis_id", "modality", reason.alias("reason"))
    return good, bad
