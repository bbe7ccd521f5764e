"""A-35 .. A-38 and X-01 .. X-04: observation rules, findings, history, recommendations, measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import numeric as N
from ..functions.numeric import row_count
from ..operators import measures as M
from ..operators import rules as R
from ..sources import load
from .common import MODALITIES, OBS_DUCK, observations
from .joins_q import LATEST_SQL, RELATIONS_SQL, latest
from .registry import query, r
from .stats_q import rounded


FAMILY_SQL = f"""f as (select o_orderkey as item_id, count(x.item_id) as observations,
  coalesce(bool_or(act and modality in ('ELA', 'JPEG_DCT')), false) as comp, coalesce(bool_or(act and modality = 'NOISE'), false) as res,
  coalesce(bool_or(act and modality = 'COPY_MOVE'), false) as spat, coalesce(bool_or(act and modality = 'METADATA'), false) as ctx
  from orders left join (select *, direction in ('elevated', 'suppressed', 'present', 'candidate') as act from ({OBS_DUCK})) x on x.item_id = o_orderkey group by 1),
n as (select *, comp::integer + res::integer + spat::integer + ctx::integer as families from f)"""


def level_sql(strong: str) -> str:
    return f"""case when observations = 0 then 'INSUFFICIENT_EVIDENCE' when families = 0 or (families = 1 and ctx) then 'LOW_FORENSIC_CONCERN' when families = 1 then 'MODERATE_FORENSIC_CONCERN'
  when families = 2 and comp and ctx then 'MODERATE_FORENSIC_CONCERN' when families >= 3 or (spat and (comp or res) and {strong}) then 'HIGH_FORENSIC_CONCERN' else 'ELEVATED_FORENSIC_CONCERN' end"""


def assessed(spark, d, strong=None):
    items = load(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"))
    return R.assess(items, observations(spark, d), strong)


@query("a35_family_assessment", f"""with {FAMILY_SQL} select {level_sql('false')} as level, count(*) as items, sum(families)::bigint as families, round(count(*) / sum(count(*)) over (), 6) as share from n group by 1""")
def family_assessment(spark, d):
    """Items, active families and share per concern level (no rule of the table is of high strength)."""
    strong = R.relations(latest(spark, d)).where(F.col("strength").isin(*R.STRONG))
    levels = assessed(spark, d, strong).groupBy("level").agg(row_count().alias("items"), F.sum("families").alias("families"))
    every = F.sum("items").over(W.partitionBy())  # over at most five levels, not over items
    return levels.select("level", "items", "families", F.round(F.col("items") / every, 6).alias("share"))


@query("a35_strong_assessment", f"""with {FAMILY_SQL}, st as (select distinct item_id from ({OBS_DUCK}) where modality = 'COPY_MOVE' and l_tax >= 0.08)
select n.item_id, observations, families::bigint as families, {level_sql('st.item_id is not null')} as level from n left join st using (item_id)""")
def strong_assessment(spark, d):
    """Per item, with relations of high strength given by the caller."""
    strong = observations(spark, d).where("modality = 'COPY_MOVE' and l_tax >= 0.08").select("item_id")
    return assessed(spark, d, strong)


def analysis_states(spark, d):
    """Latest observation per modality as analysis state: completed, flagged, count, ref."""
    o = observations(spark, d)
    rows = o.withColumn("ref", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")) \
        .withColumn("completed", F.col("l_returnflag") != "A").withColumn("flagged", F.col("direction").isin("present", "elevated")) \
        .withColumn("count", F.floor(F.col("normalized_value") / 5).cast("long"))
    return R.latest_per_modality(rows, ["l_linenumber", "l_partkey", "l_suppkey"], ["completed", "flagged", "count", "ref"])


_S = f"""l as (select *, l_returnflag <> 'A' as completed, direction in ('present', 'elevated') as flagged, floor(normalized_value / 5)::bigint as cnt from ({LATEST_SQL})),
w as (select o_orderkey as item_id, o_orderpriority = '5-LOW' as lossless, {", ".join(
    f"max(ref) filter (where modality = '{m}') as {m}_ref, coalesce(bool_or(completed) filter (where modality = '{m}'), false) as {m}_done, coalesce(bool_or(flagged) filter (where modality = '{m}'), false) as {m}_flag, max(cnt) filter (where modality = '{m}') as {m}_n"
    for m in MODALITIES)} from orders left join l on l.item_id = o_orderkey group by 1, 2)"""
_RULES = [
    ("CORR-META-001", "CORRELATED_OBSERVATION", "'REVIEW_REQUIRED'", "METADATA_flag", "METADATA_ref, JPEG_DCT_ref"),
    ("CORR-COMP-002", "CORRELATED_OBSERVATION", "'CORRELATED_OBSERVATION'", "ELA_done and (ELA_flag or JPEG_DCT_done)", "ELA_ref, JPEG_DCT_ref"),
    ("CORR-NOISE-003", "CORRELATED_OBSERVATION", "'OBSERVATION'", "NOISE_done", "NOISE_ref"),
    ("CORR-CLONE-004", "CORRELATED_OBSERVATION", "case when COPY_MOVE_n > 5 then 'REVIEW_REQUIRED' else 'OBSERVATION' end", "COPY_MOVE_done", "COPY_MOVE_ref"),
    ("CORR-CONFLICT-005", "CONFLICT_DETECTED", "'INCONCLUSIVE'", "lossless", "null::varchar"),
    ("CORR-CONFLICT-005-META-EMPTY", "CONFLICT_DETECTED", "'OBSERVATION'", "METADATA_done and not METADATA_flag and METADATA_n = 0", "METADATA_ref"),
]


def title_sql(rule):
    title = f"'{R.FINDING_TITLES[rule]}'"
    return f"case when COPY_MOVE_n > 5 then '{R.CLUSTER_TITLE}' else {title} end" if rule == "CORR-CLONE-004" else title


@query("a36_rule_findings", f"with {_S} " + " union all ".join(
    f"select item_id, '{i}' as rule_id, '1.0' as rule_version, '{t}' as finding_type, {sev} as severity, {title_sql(i)} as title, concat_ws(',', {sup}) as analyses from w where {cond}" for i, t, sev, cond, sup in _RULES))
def rule_findings(spark, d):
    return found(spark, d).withColumn("analyses", F.array_join("analyses", ","))


def found(spark, d):
    items = load(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_orderpriority") == "5-LOW").alias("lossless"))
    return R.findings(items, analysis_states(spark, d))


@query("a36_finding_observations", f"with {_S}, f as (" + " union all ".join(
    f"select item_id, '{i}' as rule_id, '{R.SUPPORTING_MODALITY[i]}' as modality from w where {cond}" for i, _, _, cond, _ in _RULES if i in R.SUPPORTING_MODALITY) + f""")
select f.item_id, rule_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) as ref from f join ({OBS_DUCK}) o on o.item_id = f.item_id and o.modality = f.modality""")
def finding_observations(spark, d):
    o = observations(spark, d).withColumn("obs", F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")]))
    return R.finding_observations(found(spark, d), o, "obs")


ENGINES = ("adjpeg", "resampling", "ela", "jpeg-dct", "blocking-artifact", "histogram")
_K = "cast(json_extract_string(props, '$.k') as integer)"
SIGNALS_SQL = f"""s as (select user_id as item_id, event_id as analysis_id, list_extract(['{"', '".join(ENGINES)}'], (event_id % 6 + 1)::integer) as engine, {_K} as k, event_type, value from events),
t as (select item_id, analysis_id, engine, case event_id_op when 0 then 'JPEG_REENCODING' when 1 then 'RESIZING_OR_RESAMPLING' when 2 then 'RECOMPRESSION_DIFFERENCE' when 3 then 'JPEG_REENCODING' else 'BLOCK_BOUNDARY_PATTERN' end as operation,
  (value > 150 or k % 23 = 0 or (event_id_op = 1 and (k > 96 or k % 31 = 0))) as candidate from (select *, analysis_id % 6 as event_id_op from s) where event_id_op < 5 and event_type <> 'error')"""


def signals(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    doc = F.to_json(F.struct((k % 23 == 0).alias("has_trace"), (k % 2 == 0).alias("other_flag"), F.when(k > 96, 3).otherwise(0).alias("candidate_region_count"),
                            F.when(k % 31 == 0, F.array(F.lit("0,0,8,8"))).otherwise(F.array().cast("array<string>")).alias("candidate_regions")))
    e = load(spark, d, "events").select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("analysis_id"),
        F.element_at(F.array(*[F.lit(x) for x in ENGINES]), (F.col("event_id") % 6 + 1).cast("int")).alias("engine"),
        F.when(F.col("event_type") == "error", "failed").otherwise("Completed").alias("status"),
        F.when(F.col("value") > 150, " Elevated").otherwise("informational").alias("direction"), doc.alias("document"))
    return R.processing_signals(e)


@query("a37_processing_signals", f"with {SIGNALS_SQL} select operation, candidate, count(*) as n, sum(analysis_id)::bigint as id_sum from t group by 1, 2")
def processing_signals(spark, d):
    return signals(spark, d).groupBy("operation", "candidate").agg(row_count().alias("n"), F.sum("analysis_id").alias("id_sum"))


@query("a37_processing_sequences", f"""with {SIGNALS_SQL}, h as (select item_id, count(*) as signals, bool_or(candidate and operation = 'JPEG_REENCODING') as j, bool_or(candidate and operation = 'RESIZING_OR_RESAMPLING') as z from t group by 1)
select item_id, signals, unnest(case when j and z then ['RESIZING_OR_RESAMPLING>JPEG_REENCODING', 'JPEG_REENCODING>RESIZING_OR_RESAMPLING'] when j then ['UNOBSERVED_PRIOR_HISTORY>JPEG_REENCODING']
  when z then ['UNOBSERVED_PRIOR_HISTORY>RESIZING_OR_RESAMPLING>UNOBSERVED_LATER_HISTORY'] else ['NONE'] end) as sequence,
  case when j and z then 'POSSIBLE_NOT_ESTABLISHED' when j or z then 'PARTIAL_HISTORY_ONLY' else 'NONE' end as ordering_status from h""")
def processing_sequences(spark, d):
    return R.processing_sequences(signals(spark, d))


@query("a38_next_steps", f"""with c as (select o_custkey as case_id, count(*) as items, count(*) filter (where o_orderstatus in ('O', 'P')) as unreviewed, count(*) filter (where o_orderpriority = '1-URGENT') as cross_findings from orders group by 1),
o as (select o_custkey as case_id, modality, count(distinct item_id) filter (where l_returnflag = 'R') as done from ({OBS_DUCK}) join orders on item_id = o_orderkey group by 1, 2),
m as (select c.case_id, v.modality, items - coalesce(done, 0) as pending, round_even(coalesce(done, 0) / items * 100.0, 1) as percentage from c, (values {", ".join(f"('{m}')" for m in MODALITIES)}) v(modality) left join o on o.case_id = c.case_id and o.modality = v.modality)
select case_id, 'HIGH' as priority, concat('REVIEW ', unreviewed) as action from c where unreviewed > 0 union all
select case_id, case when percentage > 50 then 'MEDIUM' else 'HIGH' end, concat('RUN ', modality, ' ON ', pending) from m where pending > 0 union all
select case_id, 'MEDIUM', 'CROSS_ITEM_CORRELATION' from c where items >= 2 and cross_findings = 0 union all select case_id, 'LOW', 'REVERIFY_CUSTODY' from c""")
def next_steps(spark, d):
    orders = load(spark, d, "orders")
    cases = orders.groupBy(F.col("o_custkey").alias("case_id")).agg(
        row_count().alias("items"), F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("unreviewed"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("cross_findings"))
    done = observations(spark, d).where("l_returnflag = 'R'").groupBy("item_id").agg(*[F.max(F.col("modality") == m).cast("long").alias(m) for m in MODALITIES])
    per_case = orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("case_id")).join(done, "item_id") \
        .groupBy("case_id").agg(*[F.sum(m).alias(m) for m in MODALITIES])
    wide = cases.join(per_case, "case_id", "left").fillna(0, list(MODALITIES))
    long = wide.unpivot(["case_id", "items"], list(MODALITIES), "modality", "done")
    cov = long.select("case_id", "modality", (F.col("items") - F.col("done")).alias("pending"), F.bround(F.col("done") / F.col("items") * 100.0, 1).alias("percentage"))
    return R.next_steps(cases, cov)


# ---- measures and normalisation ----

@query("x01_measure_registry", f"""select engine, metric_name, count(*) as n, {r('sum(v)', 4)} as total from (
  select 'SIZE' as engine, 'p_size' as metric_name, p_size::double as v from part where p_type in ('LARGE', 'SMALL')
  union all select 'PRICE_DB', 'db', 20 * log10(255 / (p_retailprice / 1000 + 1e-6)) from part where p_type in ('LARGE', 'PROMO') and p_size >= 10) group by 1, 2""")
def measure_registry(spark, d):
    reg = M.Registry()
    reg.register(M.Measure("SIZE", "structure", ("LARGE", "SMALL"), lambda df: df.select("item_id", F.lit("p_size").alias("metric_name"), F.col("p_size").alias("normalized_value"))))
    reg.register(M.Measure("PRICE_DB", "noise", ("LARGE", "PROMO"),
                           lambda df: df.select("item_id", F.lit("db").alias("metric_name"), N.full_scale_db(F.col("p_retailprice") / 1000).alias("normalized_value")),
                           lambda: F.col("p_size") >= 10))
    items = load(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("format"), "p_size", "p_retailprice")
    return reg.run(items).groupBy("engine", "metric_name").agg(row_count().alias("n"), F.round(F.sum("normalized_value"), 4).alias("total"))


_ONE_SCAN = {f"M{i:02d}": (("SMALL", "LARGE", "PROMO", "ECONOMY", "STANDARD")[i % 5], ("MEDIUM", "LARGE", "SMALL")[i % 3], i) for i in range(23)}


@query("x01_one_scan", "select engine, count(*) as n, " + r("sum(v)", 4) + " as total from (" + " union all ".join(
    f"select '{k}' as engine, p_size * {i + 1} + p_retailprice / {i + 2} as v from part where p_type in ('{a}', '{b}') and p_size > {i}" for k, (a, b, i) in _ONE_SCAN.items()) + ") group by 1")
def one_scan(spark, d):
    """Twenty-three measures with formats and conditions of their own, compiled into one projection of one scan."""
    reg = M.Registry()
    for name, (a, b, i) in _ONE_SCAN.items():
        reg.register(M.Measure(name, "structure", (a, b), applicable=lambda i=i: F.col("p_size") > i, metrics={"v": F.col("p_size") * (i + 1) + F.col("p_retailprice") / (i + 2)}))
    items = load(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("format"), "p_size", "p_retailprice")
    return reg.run(items).groupBy("engine").agg(row_count().alias("n"), F.round(F.sum("normalized_value"), 4).alias("total"))


@query("x01_aggregates", f"""select item_id, engine, metric_name, {r('v', 4)} as value from (
  select l_orderkey as item_id, 'NOISE_LEVEL' as engine, 'mean' as metric_name, avg(l_quantity) as v from lineitem where l_returnflag in ('R', 'A') group by 1
  union all select l_orderkey, 'NOISE_LEVEL', 'peak', max(l_quantity) from lineitem where l_returnflag in ('R', 'A') group by 1
  union all select l_orderkey, 'COST', 'total', sum(l_extendedprice) from lineitem where l_returnflag in ('N') and l_quantity > 10 group by 1) where v is not null""")
def aggregate_measures(spark, d):
    """Measures over all rows of an item, in one aggregation."""
    reg = M.Registry()
    reg.register(M.Measure("NOISE_LEVEL", "noise", ("R", "A"), aggregates={"mean": (F.avg, F.col("l_quantity")), "peak": (F.max, F.col("l_quantity"))}))
    reg.register(M.Measure("COST", "structure", ("N",), applicable=lambda: F.col("l_quantity") > 10, aggregates={"total": (F.sum, F.col("l_extendedprice"))}))
    items = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("format"), "l_quantity", "l_extendedprice")
    return reg.run(items).select("item_id", "engine", "metric_name", F.round("normalized_value", 4).alias("value"))


@query("x02_custom_measure", f"select user_id, count(*) as n, {r('sum(value)', 4)} as total, {r('max(value)', 4)} as peak from events group by 1")
def custom_measure(spark, d):
    """A user function on pandas frames whose partial results are merged by key."""
    def partial(pdf):
        return pdf.groupby("user_id").agg(n=("value", "size"), total=("value", "sum"), peak=("value", "max")).reset_index()
    e = load(spark, d, "events").select("user_id", "value")
    parts = M.grouped_measure(e, ["user_id"], partial, "user_id long, n long, total double, peak double")
    return rounded(parts.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("peak").alias("peak")), 4)


_CROWD = "case when user_id % 10 < 6 then -1 else user_id end"


@query("x02_whole_key_measure", f"select {_CROWD} as sensor, count(*) as n, {r('median(value)')} as median, {r('mad(value)')} as spread from events group by 1")
def whole_key_measure(spark, d):
    """Median absolute deviation by user code: it does not merge from parts, and one key holds 60 % of the users."""
    def spread(frames):
        def median(value):
            found = M.order_statistics(frames, value, lambda n: ((n - 1) // 2, n // 2))
            return sum(found) / 2 if found else None
        middle = median(lambda pdf: pdf["value"].to_numpy(float))
        mad = None if middle is None else median(lambda pdf: abs(pdf["value"].to_numpy(float) - middle))
        return pd.DataFrame({"sensor": [frames.key[0]], "n": [frames.rows], "median": [middle], "spread": [mad]})
    e = load(spark, d, "events").select(F.expr(_CROWD).alias("sensor"), "value")
    return rounded(M.whole_key_measure(e, ["sensor"], spread, "sensor long, n long, median double, spread double", keep=True))


SPECS = (
    R.MeasureSpec("view", ("$.mean_error", "$.statistics.mean"), 50.0, "elevated", "informational"),
    R.MeasureSpec("click", ("$.band_statistics.high",), 20.0, "informational", "suppressed"),
    R.MeasureSpec("purchase", ("$.extracted_metadata.software_count",), 1.0, "present", "absent"),
)


def documents_of(spark, d):
    """Result documents built from events: two spellings of one path, a broken one, and unknown modalities."""
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    ela = F.when(k % 2 == 0, F.to_json(F.struct(v.alias("mean_error")))).otherwise(F.to_json(F.struct(F.struct(v.alias("mean")).alias("statistics"))))
    dct = F.when(k % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.struct(v.alias("high")).alias("band_statistics"))))
    meta = F.when(k % 7 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(F.struct((k % 3).alias("software_count")).alias("extracted_metadata"))))
    t = F.col("event_type")
    doc = F.when(t == "view", ela).when(t == "click", dct).when(t == "purchase", meta).otherwise(F.lit("{}"))
    return load(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("analysis_id"), t.alias("modality"), doc.alias("document"))


@query("x03_normalised_observations", f"""with e as (select *, {_K} as k from events)
select user_id as item_id, event_id as analysis_id, event_type as modality, case when event_type = 'purchase' then k % 3 else value end::double as normalized_value,
  case event_type when 'view' then case when value >= 50 then 'elevated' else 'informational' end when 'click' then case when value >= 20 then 'informational' else 'suppressed' end
    else case when k % 3 >= 1 then 'present' else 'absent' end end as direction
from e where event_type = 'view' or (event_type = 'click' and k % 5 <> 0) or (event_type = 'purchase' and k % 7 <> 0)""")
def normalised_observations(spark, d):
    good, _ = R.normalise(documents_of(spark, d), SPECS)
    return good.drop("raw_value")


@query("x03_rejected_documents", f"""with e as (select *, {_K} as k from events)
select event_type as modality, case when event_type in ('error', 'signup') then 'UNKNOWN_MODALITY' when event_type = 'click' then 'UNPARSABLE' else 'NO_VALUE' end as reason, count(*) as n
from e where event_type in ('error', 'signup') or (event_type = 'click' and k % 5 = 0) or (event_type = 'purchase' and k % 7 = 0) group by 1, 2""")
def rejected_documents(spark, d):
    _, bad = R.normalise(documents_of(spark, d), SPECS)
    return bad.groupBy("modality", "reason").agg(row_count().alias("n"))


@query("x04_metric_expressions", f"""with c as (select l_suppkey, count(*) filter (where l_returnflag = 'R' and l_linestatus = 'F') as tp, count(*) filter (where l_returnflag = 'R' and l_linestatus = 'O') as fp,
  count(*) filter (where l_returnflag <> 'R' and l_linestatus = 'F') as fn, avg((l_quantity - 25.5) ** 2) as mse from lineitem group by 1)
select l_suppkey, {r('tp / (tp + fp + fn)')} as iou, {r('2.0 * tp / (2 * tp + fp + fn)')} as f1, {r('10 * log10(2500 / mse)')} as psnr from c""")
def metric_expressions(spark, d):
    li = load(spark, d, "lineitem")
    p, t = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    c = li.groupBy("l_suppkey").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.avg(F.pow(F.col("l_quantity") - 25.5, 2)).alias("mse"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rounded(c.select("l_suppkey", N.iou(tp, fp, fn).alias("iou"), N.f1(tp, fp, fn).alias("f1"), N.psnr(F.col("mse"), 50.0).alias("psnr")))
