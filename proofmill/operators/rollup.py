"""Roll-ups over cases, items, engines and labels. Children are aggregated before they are joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..functions.numeric import row_count
from .skew import Sequenced, quantiles



def case_overview(cases: DataFrame, items: DataFrame, analyses: DataFrame) -> DataFrame:
    """Counts, latest item and last activity per case.

    cases: case_id, opened; items: case_id, item_id, status, at; analyses:
    item_id, status, at. Analyses shrink to one row per item before they meet
    the items, so no join carries raw child rows.
    """
    per_item = analyses.groupBy("item_id").agg(
        row_count().alias("analyses"), F.count_if(F.col("status") == "COMPLETED").alias("completed"),
        F.count_if(F.col("status") == "FAILED").alias("failed"), F.max("at").alias("last_analysis"))
    per_case = items.join(per_item, "item_id", "left").groupBy("case_id").agg(
        row_count().alias("items"), F.sum("analyses").alias("analyses"), F.sum("completed").alias("completed"), F.sum("failed").alias("failed"),
        F.count_if(F.col("status") == "RUNNING").alias("running"), F.count_if(F.col("status") == "PENDING").alias("pending"),
        F.max_by("status", F.struct("at", "item_id")).alias("latest_status"),
        F.greatest(F.max("at"), F.max("last_analysis")).alias("__last"))
    counts = ["items", "analyses", "completed", "failed", "running", "pending"]
    return cases.join(per_case, "case_id", "left").select(
        "case_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], "latest_status",
        F.greatest("opened", "__last").alias("last_activity"))


def batch_progress(jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by state and percent finished (100 when there is nothing to do)."""
    s = F.upper(F.coalesce("status", F.lit("QUEUED")))
    names = ("QUEUED", "RUNNING", "COMPLETED", "FAILED")
    out = jobs.groupBy(*keys).agg(row_count().alias("total"), *[F.count_if(s == n).alias(n.lower()) for n in names])
    done = (F.col("completed") + F.col("failed")) / F.col("total") * 100.0
    return out.withColumn("progress", F.when(F.col("total") == 0, 100.0).otherwise(F.bround(done, 1)))


def coverage(items: DataFrame, done: DataFrame, modalities: Sequence[str], excluded: Column, excluded_modality: str) -> DataFrame:
    """Completed against applicable items per modality and overall (ROLLUP), excluded pairs left out.

    The grid is never built: one flag per modality is aggregated per item.
    items: item_id and what `excluded` reads; done: item_id, modality.
    """
    flags = done.groupBy("item_id").agg(*[F.max(F.col("modality") == m).alias(f"__{m}") for m in modalities])
    joined = items.select("item_id", excluded.alias("__x")).join(flags, "item_id", "left")
    aggs = []
    for m in modalities:
        fits = ~F.col("__x") if m == excluded_modality else F.lit(True)
        aggs += [F.count_if(fits).alias(f"a_{m}"), F.count_if(fits & F.coalesce(F.col(f"__{m}"), F.lit(False))).alias(f"c_{m}")]
    one = joined.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(m).alias("modality"), F.col(f"a_{m}").alias("applicable"), F.col(f"c_{m}").alias("completed")) for m in modalities])
    rows = one.select(F.explode(cells).alias("c")).select("c.*")
    out = rows.rollup("modality").agg(F.sum("applicable").alias("applicable"), F.sum("completed").alias("completed"))
    pct = F.when(F.col("applicable") == 0, 100.0).otherwise(F.bround(F.col("completed") / F.col("applicable") * 100.0, 1))
    return out.select(F.coalesce("modality", F.lit("OVERALL")).alias("modality"), "applicable", "completed",
                      (F.col("applicable") - F.col("completed")).alias("pending"), pct.alias("percentage"))


def scorecard(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Engine totals, rates and runtime distribution. NOT_APPLICABLE is its own state, never a negative.

    results: keys, status, runtime, iou (nullable).
    """
    s = F.col("status")
    base = results.groupBy(*keys).agg(
        row_count().alias("total"), F.count_if(s == "COMPLETED").alias("applied"), F.count_if(s == "NOT_APPLICABLE").alias("not_applicable"),
        F.count_if(s == "FAILED").alias("failed"), F.avg("runtime").alias("runtime_mean"), F.stddev_pop("runtime").alias("runtime_std"),
        F.min("runtime").alias("runtime_min"), F.max("runtime").alias("runtime_max"), F.avg("iou").alias("mean_iou"))
    q = quantiles(results, keys, "runtime", {"runtime_p50": 0.5, "runtime_p95": 0.95})
    tried = F.col("applied") + F.col("failed")
    return null_safe_join(base, q, list(keys), "left").withColumn("applicability_rate", F.try_divide(tried, F.col("total"))) \
        .withColumn("success_rate", F.try_divide(F.col("applied"), tried))


def label_cube(results: DataFrame, engine: str, label: str) -> DataFrame:
    """Counts by engine and truth label with all subtotals."""
    out = results.cube(engine, label).agg(row_count().alias("total"), F.count_if(F.col("status") == "COMPLETED").alias("applied"),
                                          F.count_if(F.col("status") == "FAILED").alias("failed"))
    return out.select(F.coalesce(F.col(engine).cast("string"), F.lit("ALL")).alias("engine"), F.coalesce(label, F.lit("ALL")).alias("label"),
                      "total", "applied", "failed")


def drift(base: DataFrame, changed: DataFrame, keys: Sequence[str], by: Sequence[str], value: str) -> DataFrame:
    """Mean absolute and relative change of paired measurements; relative is undefined near zero."""
    b = base.select(*keys, F.col(value).alias("__b"))
    pairs = changed.select(*keys, F.col(value).alias("__c")).join(b, list(keys))
    gap = F.abs(F.col("__c") - F.col("__b"))
    rel = F.when(F.abs("__b") > 1e-9, gap / F.abs("__b") * 100.0)
    return pairs.groupBy(*by).agg(row_count().alias("pairs"), F.avg(gap).alias("mean_absolute_change"), F.avg(rel).alias("mean_relative_change_pct"))


def against_all(probes: DataFrame, references: DataFrame, most: int = 10_000, blocks: int = 64, most_bytes: int = 64 << 20) -> DataFrame:
    """Every probe with every reference pattern.

    References are one row per source. Up to `most` of them, of `most_bytes`
    bytes of text in all (both measured), are sent to the probes; more are
    dealt in `blocks`, and a copy of each probe goes to every block, so no
    task meets all references.
    """
    size = F.octet_length(F.to_json(F.struct(*references.columns)))
    rows, total = references.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if rows <= most and total <= most_bytes:
        return probes.join(F.broadcast(references), how="cross")
    dealt = references.withColumn("__block", F.pmod(F.xxhash64("ref"), F.lit(blocks)))
    return probes.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "__block").drop("__block")


def separation(scores: DataFrame, threshold: float = 50.0, gap: float = 15.0) -> DataFrame:
    """Same-source against different-source scores: ranges, rates over the threshold, gap, verdict.

    scores: same (boolean), score.
    """
    same, score = F.col("same"), F.col("score")
    parts = []
    for name, cond in (("same", same), ("diff", ~same)):
        v = F.when(cond, score)
        parts += [F.count(v).alias(f"{name}_n"), F.avg(v).alias(f"{name}_mean"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"),
                  F.avg((v >= threshold).cast("double")).alias(f"{name}_rate")]
    out = scores.agg(*parts).withColumn("gap", F.col("same_min") - F.col("diff_max"))
    return out.withColumn("unambiguous", F.col("gap") > gap)


def manifest_rows(parts: dict[str, DataFrame], case: str, key: str) -> DataFrame:
    """Ordered entries of every case: (case, kind, ordinal, key). Row form, so a huge case is many rows, not one array."""
    out = None
    for kind, df in parts.items():
        rows = Sequenced(df.select(case, key), [case], [key]).ordinal("ordinal").select(case, F.lit(kind).alias("kind"), "ordinal", key)
        out = rows if out is None else out.unionByName(rows)
    return out


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct keys with the order value of their first occurrence."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first_seen"), row_count().alias("seen"))


def region_summary(regions: DataFrame, layers: Sequence[str], statuses: DataFrame) -> DataFrame:
    """Regions per layer of every item with the layer's availability.

    regions: item, layer, intensity; statuses: item, layer, status (AVAILABLE / INAPPLICABLE).
    Items come from `statuses`; layers without a status are NOT_RUN.
    """
    counted = regions.groupBy("item", "layer").agg(row_count().alias("n"), F.max("intensity").alias("peak"))
    items = statuses.select("item").distinct()
    grid = items.select("item", F.explode(F.array(*[F.lit(x) for x in layers])).alias("layer"))
    out = grid.join(statuses, ["item", "layer"], "left").join(counted, ["item", "layer"], "left")
    status = F.coalesce("status", F.lit("NOT_RUN"))
    return out.groupBy("item").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("regions"),
        F.count_if(status != "AVAILABLE").alias("unavailable_layers"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.col("layer"))))).alias("modalities_present"),
        F.max("peak").alias("peak_intensity"))


def density_grid(regions: DataFrame, size: int, layers: Sequence[str]) -> DataFrame:
    """Counts per cell of a size x size grid over centres in 0..1, in total and per layer, with one sample per cell."""
    def cell(c: str) -> Column:
        return F.floor(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(0.999999)) * size).cast("int")
    placed = regions.withColumn("row", cell("y")).withColumn("col", cell("x"))
    return placed.groupBy("row", "col").agg(
        row_count().alias("total"), *[F.count_if(F.col("layer") == x).alias(f"n_{x}") for x in layers], F.min("id").alias("sample_id"))


def tree_rows(levels: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """A provenance forest as rows: (item_id, node_id, parent_id, type, payload).

    levels: (type, DataFrame of item_id, node_id, parent_id and the columns of
    the node's document). Every child is a row of its own, so nothing is cut
    off and no array grows with an item; roots have no parent.
    """
    out = None
    for kind, df in levels:
        body = [c for c in df.columns if c not in ("item_id", "node_id", "parent_id")]
        rows = df.select("item_id", "node_id", F.col("parent_id").cast("string").alias("parent_id"), F.lit(kind).alias("type"),
                         F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("payload"))
        out = rows if out is None else out.unionByName(rows)
    return out


def report_rows(sections: dict[str, DataFrame], case: str, key: str) -> DataFrame:
    """A report as rows: (case, section, entry, payload), all records of every section, and one `summary` row per case with their numbers.

    A case without records in a section counts 0 there.
    """
    out, counts = None, None
    for name, df in sections.items():
        body = [c for c in df.columns if c not in (case, key)]
        rows = df.select(F.col(case), F.lit(name).alias("section"), F.col(key).cast("string").alias("entry"),
                         F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("payload"))
        n = df.groupBy(case).agg(row_count().alias("n")).select(F.col(case), F.lit(name).alias("section"), "n")
        out = rows if out is None else out.unionByName(rows)
        counts = n if counts is None else counts.unionByName(n)
    total = counts.groupBy(case).agg(*[F.coalesce(F.sum(F.when(F.col("section") == s, F.col("n"))), F.lit(0)).alias(s) for s in sections])
    summary = total.select(F.col(case), F.lit("summary").alias("section"), F.lit("").alias("entry"), F.to_json(F.struct(*sections)).alias("payload"))
    return out.unionByName(summary)
