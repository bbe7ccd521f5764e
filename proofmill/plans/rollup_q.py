"""A-01 .. A-03, A-17 .. A-22, A-40 .. A-45: roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.numeric import row_count
from ..operators import rollup as U
from ..sources import load
from .common import MODALITIES, OBS_DUCK, observations
from .joins_q import label_means
from .registry import query, r



@query("a01_case_overview", """
with a as (select l_orderkey, count(*) as analyses, count(*) filter (where l_returnflag = 'R') as completed, count(*) filter (where l_returnflag = 'A') as failed, max(l_shipdate) as last_a from lineitem group by 1),
i as (select o_custkey, count(*) as items, sum(analyses)::bigint as analyses, sum(completed)::bigint as completed, sum(failed)::bigint as failed,
  count(*) filter (where o_orderstatus = 'P') as running, count(*) filter (where o_orderstatus = 'O') as pending,
  arg_max(case o_orderstatus when 'P' then 'RUNNING' when 'O' then 'PENDING' else 'COMPLETED' end, (o_orderdate, o_orderkey)) as latest_status, greatest(max(o_orderdate), max(last_a)) as last_at
  from orders left join a on l_orderkey = o_orderkey group by 1)
select c_custkey as case_id, coalesce(items, 0) as items, coalesce(analyses, 0) as analyses, coalesce(completed, 0) as completed, coalesce(failed, 0) as failed, coalesce(running, 0) as running,
  coalesce(pending, 0) as pending, latest_status, epoch_us(greatest(timestamp '1995-06-01', last_at)) as last_activity_us from customer left join i on o_custkey = c_custkey""")
def case_overview(spark, d):
    cases = load(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.lit("1995-06-01 00:00:00").cast("timestamp_ntz").alias("opened"))
    status = F.when(F.col("o_orderstatus") == "P", "RUNNING").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("COMPLETED")
    items = load(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item_id"), status.alias("status"), F.col("o_orderdate").alias("at"))
    state = F.when(F.col("l_returnflag") == "R", "COMPLETED").when(F.col("l_returnflag") == "A", "FAILED").otherwise("NOT_APPLICABLE")
    analyses = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), state.alias("status"), F.col("l_shipdate").alias("at"))
    out = U.case_overview(cases, items, analyses)
    return out.withColumn("last_activity_us", X.epoch_us(F.col("last_activity"))).drop("last_activity")


JOBS_SQL = "select o_custkey, case o_orderstatus when 'O' then null when 'P' then 'running' else case when o_orderpriority = '1-URGENT' then 'failed' else 'completed' end end as status from orders"


def jobs(spark, d):
    s = F.col("o_orderstatus")
    status = F.when(s == "P", "running").when((s == "F") & (F.col("o_orderpriority") == "1-URGENT"), "failed").when(s == "F", "completed")
    return load(spark, d, "orders").select("o_custkey", status.alias("status"))


@query("a02_batch_progress", f"""
select o_custkey, count(*) as total, count(*) filter (where status is null) as queued, count(*) filter (where status = 'running') as running,
  count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed,
  round_even(count(*) filter (where status in ('completed', 'failed')) / count(*) * 100.0, 1)::double as progress from ({JOBS_SQL}) group by 1""")
def batch_progress(spark, d):
    return U.batch_progress(jobs(spark, d), ["o_custkey"])


@query("a03_coverage", f"""
with m(modality) as (values {", ".join(f"('{m}')" for m in MODALITIES)}), done as (select distinct item_id, modality from ({OBS_DUCK}) where l_returnflag = 'R'),
g as (select m.modality, o_orderkey from orders, m where not (m.modality = 'JPEG_DCT' and o_orderpriority = '5-LOW')),
c as (select g.modality, count(*) as applicable, count(done.item_id) as completed from g left join done on done.item_id = o_orderkey and done.modality = g.modality group by rollup(g.modality))
select coalesce(modality, 'OVERALL') as modality, applicable, completed, applicable - completed as pending, round_even(completed / applicable * 100.0, 1)::double as percentage from c""")
def coverage(spark, d):
    items = load(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), "o_orderpriority")
    done = observations(spark, d).where("l_returnflag = 'R'").select("item_id", "modality")
    return U.coverage(items, done, MODALITIES, F.col("o_orderpriority") == "5-LOW", "JPEG_DCT")


RESULTS_SQL = """select l_suppkey % 23 as engine, case l_linestatus when 'O' then 'AUTHENTIC' else 'MANIPULATED' end as label,
  case l_returnflag when 'R' then 'COMPLETED' when 'A' then 'NOT_APPLICABLE' else 'FAILED' end as status, l_quantity as runtime,
  case when l_returnflag = 'R' and l_linenumber <= 3 then l_tax * 10 end as iou from lineitem"""


def engine_results(spark, d):
    flag = F.col("l_returnflag")
    status = F.when(flag == "R", "COMPLETED").when(flag == "A", "NOT_APPLICABLE").otherwise("FAILED")
    return load(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 23).alias("engine"), F.when(F.col("l_linestatus") == "O", "AUTHENTIC").otherwise("MANIPULATED").alias("label"), status.alias("status"),
        F.col("l_quantity").alias("runtime"), F.when((flag == "R") & (F.col("l_linenumber") <= 3), F.col("l_tax") * 10).alias("iou"))


@query("a17_engine_scorecard", f"""
with x as (select engine, count(*) as total, count(*) filter (where status = 'COMPLETED') as applied, count(*) filter (where status = 'NOT_APPLICABLE') as not_applicable,
  count(*) filter (where status = 'FAILED') as failed, {r('avg(runtime)', 4)} as runtime_mean, {r('stddev_pop(runtime)', 4)} as runtime_std, min(runtime) as runtime_min, max(runtime) as runtime_max,
  {r('avg(iou)')} as mean_iou, {r('median(runtime)', 4)} as runtime_p50, {r('quantile_cont(runtime, 0.95)', 4)} as runtime_p95 from ({RESULTS_SQL}) group by 1)
select *, {r('(applied + failed) / total')} as applicability_rate, {r('applied / (applied + failed)')} as success_rate from x""")
def engine_scorecard(spark, d):
    out = U.scorecard(engine_results(spark, d), ["engine"])
    return out.select(*[F.round(c, 4 if c.startswith("runtime") else 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("a18_label_cube", f"""
select coalesce(engine::varchar, 'ALL') as engine, coalesce(label, 'ALL') as label, count(*) as total, count(*) filter (where status = 'COMPLETED') as applied,
  count(*) filter (where status = 'FAILED') as failed from ({RESULTS_SQL}) group by cube (engine, label)""")
def label_cube(spark, d):
    return U.label_cube(engine_results(spark, d), "engine", "label")


@query("a18_label_pivot", f"""
select engine, count(*) filter (where label = 'AUTHENTIC') as authentic, count(*) filter (where label = 'MANIPULATED') as manipulated from ({RESULTS_SQL}) where status = 'COMPLETED' group by 1""")
def label_pivot(spark, d):
    out = engine_results(spark, d).where("status = 'COMPLETED'").groupBy("engine").pivot("label", ["AUTHENTIC", "MANIPULATED"]).count()
    return out.select("engine", F.coalesce("AUTHENTIC", F.lit(0)).cast("long").alias("authentic"), F.coalesce("MANIPULATED", F.lit(0)).cast("long").alias("manipulated"))


@query("a19_stratification", """
with p as (select p_type as format, case when p_size < 10 then 'UNDER_1MP' when p_size <= 30 then '1_TO_5MP' else 'OVER_5MP' end as band,
  case when p_retailprice is null then 'UNKNOWN' when p_brand = 'Brand#1' then 'NOT_PROVIDED' else 'KNOWN' end as history from part)
select coalesce(format, '-') as format, coalesce(band, '-') as band, coalesce(history, '-') as history, count(*) as n from p group by grouping sets ((format), (band), (history))""")
def stratification(spark, d):
    size = F.col("p_size")
    p = load(spark, d, "part").select(
        F.col("p_type").alias("format"), F.when(size < 10, "UNDER_1MP").when(size <= 30, "1_TO_5MP").otherwise("OVER_5MP").alias("band"),
        F.when(F.col("p_retailprice").isNull(), "UNKNOWN").when(F.col("p_brand") == "Brand#1", "NOT_PROVIDED").otherwise("KNOWN").alias("history"))
    out = p.groupingSets([[F.col("format")], [F.col("band")], [F.col("history")]], "format", "band", "history").agg(row_count().alias("n"))
    return out.select(*[F.coalesce(c, F.lit("-")).alias(c) for c in ("format", "band", "history")], "n")


@query("a20_false_alarms", """
select lang, count(*) as negatives, count(*) filter (where n_chars >= 2000) as alarms, count(*) filter (where n_chars >= 2000 and contains(lower(source), '1')) as alarms_with_keyword,
  count(*) filter (where n_chars >= 2000 and not contains(lower(source), '1')) as alarms_other from documents join labels using (doc_id) where toxic = 0 group by 1""")
def false_alarms(spark, d):
    j = load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(load(spark, d, "labels"), "doc_id").where("toxic = 0")
    alarm, named = F.col("n_chars") >= 2000, F.contains(F.lower("source"), F.lit("1"))
    return j.groupBy("lang").agg(row_count().alias("negatives"), F.count_if(alarm).alias("alarms"), F.count_if(alarm & named).alias("alarms_with_keyword"),
                                 F.count_if(alarm & ~named).alias("alarms_other"))


@query("a21_measurement_drift", f"""
with b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['price', 'quantity', 'discount']) as metric, unnest([l_extendedprice, l_quantity, l_discount]) as v from lineitem),
c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['price', 'quantity', 'discount']) as metric, unnest([l_extendedprice * (1 + l_tax), l_quantity + l_linenumber, l_discount + 0.01]) as v from lineitem where l_returnflag <> 'N')
select b.l_suppkey % 10 as engine, metric, count(*) as pairs, {r('avg(abs(c.v - b.v))')} as mean_absolute_change, {r('avg(case when abs(b.v) > 1e-9 then abs(c.v - b.v) / abs(b.v) * 100 end)', 4)} as mean_relative_change_pct
from b join c using (l_orderkey, l_linenumber, l_partkey, l_suppkey, metric) group by 1, 2""")
def measurement_drift(spark, d):
    li = load(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

    def long(df, price, quantity, discount):
        wide = df.select(*keys, price.alias("price"), quantity.alias("quantity"), discount.alias("discount"))
        return wide.unpivot(keys, ["price", "quantity", "discount"], "metric", "v").withColumn("engine", F.col("l_suppkey") % 10)
    base = long(li, F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount"))
    changed = long(li.where("l_returnflag <> 'N'"), F.col("l_extendedprice") * (1 + F.col("l_tax")), F.col("l_quantity") + F.col("l_linenumber"), F.col("l_discount") + 0.01)
    out = U.drift(base, changed, [*keys, "metric", "engine"], ["engine", "metric"], "v")
    return out.withColumn("mean_absolute_change", F.round("mean_absolute_change", 6)).withColumn("mean_relative_change_pct", F.round("mean_relative_change_pct", 4))


@query("a22_separation", f"""
with x as (select vec_id, label, unnest(embedding::double[]) as v, unnest(range(1, 65)) as pos from embeddings), ref as (select label, pos, avg(v) as m from x group by 1, 2),
s as (select x.vec_id, r.label as ref, x.label = r.label as same, corr(x.v, r.m) * 100 as score from x join ref r on x.pos = r.pos group by 1, 2, 3)
select count(*) filter (where same) as same_n, {r('avg(score) filter (where same)', 4)} as same_mean, {r('min(score) filter (where same)', 4)} as same_min, {r('max(score) filter (where same)', 4)} as same_max,
  {r('avg(case when score >= 20 then 1.0 else 0 end) filter (where same)')} as same_rate, count(*) filter (where not same) as diff_n, {r('avg(score) filter (where not same)', 4)} as diff_mean,
  {r('min(score) filter (where not same)', 4)} as diff_min, {r('max(score) filter (where not same)', 4)} as diff_max, {r('avg(case when score >= 20 then 1.0 else 0 end) filter (where not same)')} as diff_rate,
  {r('min(score) filter (where same) - max(score) filter (where not same)', 4)} as gap, min(score) filter (where same) - max(score) filter (where not same) > 15 as unambiguous from s""")
def separation(spark, d):
    """Every probe against the pattern of its own source and of every other one."""
    probe = load(spark, d, "embeddings").select("vec_id", "label", V.standardised(F.col("embedding")).alias("p"))
    refs = label_means(spark, d).select(F.col("label").alias("ref"), V.standardised(F.col("vec")).alias("k"))
    scores = U.against_all(probe, refs).select((F.col("ref") == F.col("label")).alias("same"), (V.dot(F.col("p"), F.col("k")) * 100).alias("score"))
    out = U.separation(scores, threshold=20.0)
    return out.select(*[F.round(c, 6 if c.endswith("rate") else 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


LAYERS = ["click", "error", "purchase", "signup", "view"]


@query("a39_region_summary", f"""
with i as (select distinct user_id from events), g as (select user_id, layer from i, (values {", ".join(f"('{x}')" for x in LAYERS)}) l(layer)),
s as (select user_id, event_type as layer, case when max(value) < 60 then 'INAPPLICABLE' else 'AVAILABLE' end as status from events group by 1, 2),
c as (select user_id, event_type as layer, count(*) as n, max(value) as peak from events where value >= 60 group by 1, 2)
select g.user_id as item, coalesce(sum(n), 0)::bigint as regions, count(*) filter (where coalesce(status, 'NOT_RUN') <> 'AVAILABLE') as unavailable_layers,
  coalesce(string_agg(case when n > 0 then g.layer end, ',' order by g.layer), '') as modalities_present, max(peak) as peak_intensity
from g left join s on g.user_id = s.user_id and g.layer = s.layer left join c on g.user_id = c.user_id and g.layer = c.layer group by 1""")
def region_summary(spark, d):
    e = load(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("layer"), F.col("value").alias("intensity"))
    statuses = e.groupBy("item", "layer").agg(F.when(F.max("intensity") < 60, "INAPPLICABLE").otherwise("AVAILABLE").alias("status"))
    return U.region_summary(e.where("intensity >= 60"), LAYERS, statuses)


@query("a40_density_grid", f"""
with e as (select event_id, event_type, floor(least(greatest(value / 200.0, 0), 0.999999) * 40)::integer as row, floor(least(greatest((epoch_us(ts) % 86400000000) / 86400000000.0, 0), 0.999999) * 40)::integer as col from events)
select row, col, count(*) as total, {", ".join(f"count(*) filter (where event_type = '{x}') as n_{x}" for x in LAYERS)}, min(event_id) as sample_id from e group by 1, 2""")
def density_grid(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("layer"), (F.pmod(us, F.lit(86_400_000_000)) / 86_400_000_000.0).alias("x"),
                                        (F.col("value") / 200.0).alias("y"))
    return U.density_grid(e, 40, LAYERS)


def case_parts(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return {
        "evidence": orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("entry")),
        "analysis": joined.select(F.col("o_custkey").alias("case_id"), F.format_string("%d-%d-%d-%d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("entry")),
        "finding": orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("P-"), F.col("o_orderkey").cast("string")).alias("entry")),
    }


@query("a41_case_manifest", """
with e as (select o_custkey as case_id, 'evidence' as kind, o_orderkey::varchar as entry from orders
  union all select o_custkey, 'analysis', concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) from lineitem join orders on l_orderkey = o_orderkey
  union all select o_custkey, 'finding', concat('P-', o_orderkey) from orders where o_orderstatus = 'P')
select *, row_number() over (partition by case_id, kind order by entry) as ordinal from e""")
def case_manifest(spark, d):
    return U.manifest_rows(case_parts(spark, d), "case_id", "entry")


@query("a41_case_rules", """
select o_custkey as case_id, l_returnflag as rule, count(*) as seen, min(l_orderkey) as first_item from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""")
def case_rules(spark, d):
    j = load(spark, d, "lineitem").join(load(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = U.first_seen(j.select(F.col("o_custkey").alias("case_id"), F.col("l_returnflag").alias("rule"), "l_orderkey"), ["case_id", "rule"], ["l_orderkey"])
    return out.select("case_id", "rule", "seen", F.col("first_seen.l_orderkey").alias("first_item"))


LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query("a42_provenance_tree", f"""
select o_orderkey as item_id, concat('ev-', o_orderkey) as node_id, null as parent_id, 'EVIDENCE' as type, concat('{{"status":"', o_orderstatus, '"}}') as payload from orders
union all select o_orderkey, concat('hash-', o_orderkey), concat('ev-', o_orderkey), 'HASH_SIGNATURE', concat('{{"sha256":"', sha256(o_orderkey::varchar), '"}}') from orders
union all select l_orderkey, concat('anl-', {LINE_ID}), concat('ev-', l_orderkey), 'ANALYSIS', concat('{{"line":', l_linenumber, ',"status":"', l_linestatus, '"}}') from lineitem
union all select l_orderkey, concat('obs-', {LINE_ID}), concat('anl-', {LINE_ID}), 'OBSERVATION', concat('{{"supplier":', l_suppkey, ',"flag":"', l_returnflag, '"}}') from lineitem
union all select l_orderkey, concat('art-', {LINE_ID}), concat('anl-', {LINE_ID}), 'ARTIFACT', concat('{{"part":', l_partkey, '}}') from lineitem where l_returnflag = 'R'""")
def provenance_tree(spark, d):
    """Every node of every item's tree as a row that names its parent."""
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    line = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    item, of = F.col("o_orderkey"), F.col("l_orderkey")
    return U.tree_rows([
        ("EVIDENCE", o.select(item.alias("item_id"), named("ev-", item).alias("node_id"), F.lit(None).alias("parent_id"), F.col("o_orderstatus").alias("status"))),
        ("HASH_SIGNATURE", o.select(item.alias("item_id"), named("hash-", item).alias("node_id"), named("ev-", item).alias("parent_id"),
                                    F.sha2(item.cast("string"), 256).alias("sha256"))),
        ("ANALYSIS", li.select(of.alias("item_id"), named("anl-", line).alias("node_id"), named("ev-", of).alias("parent_id"), F.col("l_linenumber").alias("line"),
                               F.col("l_linestatus").alias("status"))),
        ("OBSERVATION", li.select(of.alias("item_id"), named("obs-", line).alias("node_id"), named("anl-", line).alias("parent_id"), F.col("l_suppkey").alias("supplier"),
                                  F.col("l_returnflag").alias("flag"))),
        ("ARTIFACT", li.where("l_returnflag = 'R'").select(of.alias("item_id"), named("art-", line).alias("node_id"), named("anl-", line).alias("parent_id"),
                                                           F.col("l_partkey").alias("part")))])


@query("a43_report_payload", f"""
with rows as (select o_custkey as case_id, 'evidence' as section, o_orderkey::varchar as entry, concat('{{"status":"', o_orderstatus, '","priority":"', o_orderpriority, '"}}') as payload from orders
  union all select o_custkey, 'analyses', {LINE_ID}, concat('{{"item":', l_orderkey, ',"status":"', l_linestatus, '","flag":"', l_returnflag, '"}}') from lineitem join orders on l_orderkey = o_orderkey
  union all select o_custkey, 'findings', concat('P-', o_orderkey), concat('{{"item":', o_orderkey, ',"severity":"', o_orderpriority, '"}}') from orders where o_orderstatus = 'P'
  union all select user_id, 'custody', event_id::varchar, concat('{{"event":"', event_type, '"}}') from events
  union all select c_custkey, 'lineage', concat(c_custkey, '>', c_custkey + 1), concat('{{"parent":', case when c_custkey % 3 = 0 then c_custkey::varchar when c_custkey % 3 = 1 then (c_custkey + 1)::varchar else 'null' end, '}}') from customer)
select * from rows union all
select case_id, 'summary', '', concat('{{"evidence":', count(*) filter (where section = 'evidence'), ',"analyses":', count(*) filter (where section = 'analyses'), ',"findings":', count(*) filter (where section = 'findings'),
  ',"lineage":', count(*) filter (where section = 'lineage'), ',"custody":', count(*) filter (where section = 'custody'), '}}') from rows group by 1""")
def report_payload(spark, d):
    """Every case's report: its items, analyses, findings, lineage and custody events in full, and their numbers."""
    orders = load(spark, d, "orders").withColumnRenamed("o_custkey", "case_id")
    li = load(spark, d, "lineitem").join(orders.select("o_orderkey", "case_id"), F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("c_custkey")
    return U.report_rows({
        "evidence": orders.select("case_id", F.col("o_orderkey").alias("entry"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")),
        "analyses": li.select("case_id", F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("entry"),
                              F.col("l_orderkey").alias("item"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag")),
        "findings": orders.where("o_orderstatus = 'P'").select("case_id", F.concat(F.lit("P-"), F.col("o_orderkey").cast("string")).alias("entry"),
                                                              F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("severity")),
        "lineage": load(spark, d, "customer").select(k.alias("case_id"), F.concat_ws(">", k.cast("string"), (k + 1).cast("string")).alias("entry"),
                                                     F.when(k % 3 == 0, k).when(k % 3 == 1, k + 1).alias("parent")),
        "custody": load(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("entry"), F.col("event_type").alias("event"))}, "case_id", "entry")


@query("a44_duplicate_census", "select sha256(text) as digest, count(*) as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def duplicate_census(spark, d):
    return load(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(row_count().alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("a45_response_checks", """
select l_suppkey % 23 as engine, count(*) as n, count(*) filter (where (l_discount * 3 >= 0.15) = (l_linestatus = 'F')) as response_consistent,
  count(*) filter (where abs(l_quantity - 25) <= 15) as within_expected_scale from lineitem group by 1""")
def response_checks(spark, d):
    li = load(spark, d, "lineitem")
    consistent = (F.col("l_discount") * 3 >= 0.15) == (F.col("l_linestatus") == "F")
    return li.groupBy((F.col("l_suppkey") % 23).alias("engine")).agg(
        row_count().alias("n"), F.count_if(consistent).alias("response_consistent"), F.count_if(F.abs(F.col("l_quantity") - 25) <= 15).alias("within_expected_scale"))
