"""A-04 .. A-12, A-24, A-32 .. A-34, A-46, A-47: distribution statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import stats as S
from ..sources import load
from .registry import query, r


def rounded(df, digits=6, skip=()):
    """Round every double column."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


@query("a04_summary_statistics", f"""
select l_returnflag, l_linestatus, count(*) as n, {r('avg(l_extendedprice)', 4)} as mean, {r('stddev_pop(l_extendedprice)', 4)} as std, min(l_extendedprice) as min,
  max(l_extendedprice) as max, {", ".join(f"{r(f'quantile_cont(l_extendedprice, {p})', 4)} as {n}" for n, p in S.PERCENTILES.items())}
from lineitem group by 1, 2""")
def summary_statistics(spark, d):
    return rounded(S.describe_by(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), 4)


@query("a05_robust_statistics", f"""
select l_suppkey, {r('median(l_extendedprice)', 4)} as median, {r('mad(l_extendedprice)', 4)} as mad, {r('1.4826 * mad(l_extendedprice)', 4)} as scale
from lineitem group by 1""")
def robust_statistics(spark, d):
    return rounded(S.robust_by(load(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice"), 4)


HIST_SQL = """with b as (select l_returnflag, least(floor((l_extendedprice - 0) / 105000.0 * 256), 255)::integer as bin from lineitem where l_extendedprice between 0 and 105000),
h as (select l_returnflag, bin, count(*) as n from b group by 1, 2)"""


@query("a06_histogram", f"""{HIST_SQL} select l_returnflag, bin, n, {r('n / sum(n) over (partition by l_returnflag)')} as pdf,
  {r('sum(n) over (partition by l_returnflag order by bin) / sum(n) over (partition by l_returnflag)')} as cdf from h""")
def histogram(spark, d):
    return rounded(S.histogram(load(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0, 105000, 256))


@query("a06_trimmed_histogram", f"""with e as (select event_type, quantile_cont(value, 0.05) - 1 as lo, quantile_cont(value, 0.95) + 1 as hi from events group by 1),
b as (select event_type, least(floor((value - lo) / (hi - lo) * 128), 127)::integer as bin from events join e using (event_type) where value between lo and hi),
h as (select event_type, bin, count(*) as n from b group by 1, 2)
select event_type, bin, n, {r('n / sum(n) over (partition by event_type)')} as pdf, {r('sum(n) over (partition by event_type order by bin) / sum(n) over (partition by event_type)')} as cdf from h""")
def trimmed_histogram(spark, d):
    return rounded(S.trimmed_histogram(load(spark, d, "events").select("event_type", "value"), ["event_type"], "value"))


@query("a07_entropy", f"{HIST_SQL} select l_returnflag, {r('entropy(bin)')} as entropy from b group by 1")
def entropy(spark, d):
    hist = S.histogram(load(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0, 105000, 256)
    return rounded(S.entropy(hist, ["l_returnflag"]))


@query("a08_clipping", f"""
select p_brand, {r('count(*) filter (where p_size * 5 = 5) * 100.0 / count(*)')} as shadow_pct, {r('count(*) filter (where p_size * 5 = 250) * 100.0 / count(*)')} as highlight_pct,
  (max(p_size * 5) - min(p_size * 5))::bigint as dynamic_range, (max(p_size * 5) - min(p_size * 5) + 1 - count(distinct p_size))::bigint as comb_gaps from part group by 1""")
def clipping(spark, d):
    parts = load(spark, d, "part").select("p_brand", (F.col("p_size") * 5).alias("level"))
    return rounded(S.clipping(parts, ["p_brand"], "level", 5, 250))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "flat"]


@query("a09_correlation_matrix", f"""
select l_returnflag, 'l_quantity' as col_a, 'l_extendedprice' as col_b, {r('corr(l_quantity, l_extendedprice)')} as r from lineitem group by 1
union all select l_returnflag, 'l_quantity', 'l_discount', {r('corr(l_quantity, l_discount)')} from lineitem group by 1
union all select l_returnflag, 'l_extendedprice', 'l_discount', {r('corr(l_extendedprice, l_discount)')} from lineitem group by 1
union all select distinct l_returnflag, a, 'flat', 1.0::double from lineitem, (values ('l_quantity'), ('l_extendedprice'), ('l_discount')) t(a)""")
def correlation_matrix(spark, d):
    li = load(spark, d, "lineitem").withColumn("flat", F.lit(7.0))
    return rounded(S.correlation_matrix(li, ["l_returnflag"], MEASURES))


_ABC = "select l_linestatus, l_quantity as a, l_discount * 500 as b, l_tax * 600 as c from lineitem"


@query("a10_pair_differences", " union all ".join(
    f"select l_linestatus, '{n}' as pair, {r(f'avg({e})', 4)} as mean, {r(f'stddev_pop({e})', 4)} as std, {r(f'max({e})', 4)} as max from ({_ABC}) group by 1"
    for n, e in {"a_b": "abs(a - b)", "a_c": "abs(a - c)", "b_c": "abs(b - c)", "composite": "(abs(a - b) + abs(a - c) + abs(b - c)) / 3"}.items()))
def pair_differences(spark, d):
    li = load(spark, d, "lineitem").select("l_linestatus", F.col("l_quantity").alias("a"), (F.col("l_discount") * 500).alias("b"), (F.col("l_tax") * 600).alias("c"))
    return rounded(S.pair_differences(li, ["l_linestatus"], ["a", "b", "c"]), 4)


VERSIONS_SQL = "select l_returnflag, l_extendedprice / 1000 as a, l_extendedprice * (1 - l_discount) * (1 + case when l_returnflag = 'N' then l_discount / (1 - l_discount) else l_tax end) / 1000 as b from lineitem"


def versions(spark, d):
    """Each price and a recomputed one, in thousands; both agree (up to rounding) for flag N."""
    tax = F.when(F.col("l_returnflag") == "N", F.col("l_discount") / (1 - F.col("l_discount"))).otherwise(F.col("l_tax"))
    price = F.col("l_extendedprice")
    return load(spark, d, "lineitem").select("l_returnflag", (price / 1000).alias("a"), (price * (1 - F.col("l_discount")) * (1 + tax) / 1000).alias("b"))


@query("a11_error_summary", f"""with v as (select l_returnflag, abs(a - b) as diff from ({VERSIONS_SQL}))
select l_returnflag, count(*) as n, {r('avg(diff)')} as mean, {r('stddev_pop(diff)')} as std, {r('min(diff)')} as min, {r('max(diff)')} as max, {r('median(diff)')} as median,
  {r('quantile_cont(diff, 0.9)')} as p90, {r('quantile_cont(diff, 0.95)')} as p95, {r('quantile_cont(diff, 0.99)')} as p99,
  {r('100.0 * count(*) filter (where diff * 200 >= 255) / count(*)', 4)} as saturation_pct from v group by 1""")
def error_summary(spark, d):
    out = rounded(S.error_summary(versions(spark, d), ["l_returnflag"], "a", "b", gain=200.0))
    return out.withColumn("saturation_pct", F.round("saturation_pct", 4))


@query("a12_fidelity", f"""with v as (select l_returnflag, avg((a - b) ** 2) as mse from (select l_returnflag, a, case when l_returnflag = 'N' then a else b end as b from ({VERSIONS_SQL})) group by 1)
select l_returnflag, {r('mse')} as mse, mse = 0 as identical, case when mse > 0 then {r('10 * log10(255.0 * 255.0 / mse)')} end as psnr_finite,
  case when mse > 0 then {r('10 * log10(255.0 * 255.0 / mse)')} else 100.0 end as psnr_bench from v""")
def fidelity(spark, d):
    v = versions(spark, d).withColumn("b", F.when(F.col("l_returnflag") == "N", F.col("a")).otherwise(F.col("b")))
    m = v.groupBy("l_returnflag").agg(F.avg(F.pow(F.col("a") - F.col("b"), 2)).alias("mse"))
    strict = N.psnr(F.col("mse"), 255.0, "strict")
    return rounded(m.select("l_returnflag", "mse", (F.col("mse") == 0).alias("identical"),
                            F.when(strict < float("inf"), strict).alias("psnr_finite"), N.psnr(F.col("mse"), 255.0, "bench").alias("psnr_bench")))


@query("a24_suitability", f"""with v as (select user_id, least(value, 255) as level, value - floor(value) as residual from events),
s as (select user_id, avg(case when level <= 5 or level >= 250 then 1.0 else 0.0 end) as saturated_ratio, max(level) - min(level) as dynamic_range, var_pop(residual) as residual_variance from v group by 1),
i as (select *, round(least(greatest(greatest(0, 1 - saturated_ratio * 2) * 0.5 + least(1, dynamic_range / 128) * 0.3 + case when residual_variance > 0 then least(1, residual_variance / 0.5) else 0 end * 0.2, 0), 1), 4)::double as suitability from s)
select user_id, {r('saturated_ratio')} as saturated_ratio, {r('dynamic_range')} as dynamic_range, {r('residual_variance')} as residual_variance, suitability,
  case when suitability >= 0.5 then 'SUITABLE' when suitability >= 0.25 then 'MARGINAL' else 'UNSUITABLE' end as status from i""")
def suitability(spark, d):
    v = load(spark, d, "events").select("user_id", F.least("value", F.lit(255.0)).alias("level"), (F.col("value") - F.floor("value")).alias("residual"))
    return rounded(S.suitability(v, ["user_id"], "level", "residual"))


_STD = ", ".join(str(x) for x in S.STANDARD_TABLE)
TABLE_SQL = f"""with std as (select unnest(range(1, 65)) as pos, unnest([{_STD}]) as s),
refs as (select q, pos, greatest(1, least(255, floor((s * case when q < 50 then 5000.0 / q else 200.0 - 2 * q end + 50) / 100))) as v from std, range(1, 101) t(q)),
e as (select vec_id, unnest(embedding::double[]) as x, unnest(range(1, 65)) as pos from embeddings),
t as (select vec_id, pos, greatest(1, least(255, v + case when vec_id % 3 = 0 then 0 else floor(x * (vec_id % 3) * 8 + 0.5) end)) as v from e join refs using (pos) where q = vec_id % 100 + 1)"""


def quantization_tables(spark, d):
    """Each vector perturbs the table of quality vec_id mod 100 + 1."""
    refs = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in S.quality_tables()])
    base = F.element_at(refs, (F.col("vec_id") % 100 + 1).cast("int"))
    m = F.col("vec_id") % 3
    noise = F.zip_with("embedding", F.array_repeat(m, 64), lambda x, k: F.when(k == 0, 0.0).otherwise(F.floor(x.cast("double") * k * 8 + 0.5).cast("double")))
    table = F.zip_with(base, noise, lambda b, n: F.greatest(F.lit(1.0), F.least(F.lit(255.0), b + n)))
    return load(spark, d, "embeddings").select("vec_id", table.alias("t"))


@query("a32_table_statistics", f"""{TABLE_SQL},
s as (select vec_id, (max(v) filter (where pos = 1))::bigint as dc, avg(v) as mean, median(v) as median, var_pop(v) as variance, stddev_pop(v) as std, avg(v) filter (where pos > 1) as ac_mean,
  median(v) filter (where pos > 1) as ac_median, min(v)::bigint as min, max(v)::bigint as max from t group by 1),
m as (select vec_id, q, avg(abs(t.v - r.v)) as mad from t join refs r using (pos) group by 1, 2),
b as (select vec_id, arg_min(q, (mad, q)) as q, min(mad) as mad from m group by 1)
select vec_id, dc, {r('mean + 1e-9', 4)} as mean, {r('median + 1e-9', 4)} as median, {r('variance + 1e-9', 4)} as variance, {r('std + 1e-9', 4)} as std, {r('ac_mean + 1e-9', 4)} as ac_mean, {r('ac_median + 1e-9', 4)} as ac_median, min, max,
  case when mad <= 2.5 then q end as quality, {r('mad + 1e-9', 4)} as mad, case when mad <= 2.5 then 'ESTIMATED' else 'NOT_ESTIMATED' end as status,
  case when mad > 2.5 then 'NONE' when mad = 0 then 'HIGH' when mad < 1 then 'MODERATE' else 'LOW' end as confidence from s join b using (vec_id)""")
def table_statistics(spark, d):
    out = S.table_statistics(quantization_tables(spark, d), "vec_id", "t")
    # values are multiples of 1/4096: a nudge keeps both engines off exact halves
    return rounded(out.select(*[(F.col(c) + 1e-9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes]), 4)


@query("a33_fingerprint_census", """
with h as (select sha256(text) as digest, count(*) as items from documents group by 1), s as (select distinct sha256(text) as digest from documents where source in ('src1', 'src2', 'src3'))
select digest, items, case when s.digest is null then 'CUSTOM' else 'STANDARD' end as kind from h left join s using (digest)""")
def fingerprint_census(spark, d):
    docs = load(spark, d, "documents").select("source", F.sha2("text", 256).alias("digest"))
    return S.fingerprint_census(docs, "digest", docs.where(F.col("source").isin("src1", "src2", "src3")))


@query("a34_circular_statistics", f"""with a as (select user_id, (epoch_us(ts) % 86400000000) / 86400000000.0 * 360 as angle from events),
m as (select user_id, fmod(degrees(atan2(avg(sin(radians(angle))), avg(cos(radians(angle))))) + 360, 360) as mean_deg from a group by 1),
g as (select user_id, mean_deg, case when abs(angle - mean_deg) > 180 then 360 - abs(angle - mean_deg) else abs(angle - mean_deg) end as gap from a join m using (user_id)),
s as (select user_id, mean_deg, count(*) as n, sqrt(avg(gap * gap)) as spread_deg, avg(case when gap > 60 then 1.0 else 0.0 end) as divergent_share from g group by 1, 2)
select user_id, {r('mean_deg', 4)} as mean_deg, n, {r('spread_deg', 4)} as spread_deg, {r('divergent_share', 4)} as divergent_share,
  case when divergent_share > 0.4 then 'LIGHTING_DIRECTION_ANOMALY' when divergent_share > 0.2 then 'MODERATE_LIGHTING_VARIANCE' else 'LIGHTING_PHYSICS_CONSISTENT' end as verdict from s""")
def circular_statistics(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = load(spark, d, "events").select("user_id", (F.pmod(us, F.lit(86_400_000_000)) / 86_400_000_000.0 * 360.0).alias("angle"))
    return rounded(S.circular(e, ["user_id"], "angle", 60.0), 4)


@query("a46_scaling", f"""with e as (select l_returnflag, min(l_quantity) as lo, max(l_quantity) as hi from lineitem group by 1),
s as (select l_returnflag, (l_quantity - lo) / (hi - lo) * 255 as minmax, l_quantity / hi * 255 as max_scaled, least(greatest(l_quantity * 20, 0), 255) as gained from lineitem join e using (l_returnflag))
select l_returnflag, {r('avg(minmax)', 4)} as mean_minmax, {r('avg(max_scaled)', 4)} as mean_max_scaled, {r('avg(gained)', 4)} as mean_gained, {r('avg(case when gained >= 255 then 1.0 else 0.0 end)', 4)} as saturated from s group by 1""")
def scaling(spark, d):
    s = S.scaled(load(spark, d, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity", 20.0)
    return rounded(s.groupBy("l_returnflag").agg(F.avg("minmax").alias("mean_minmax"), F.avg("max_scaled").alias("mean_max_scaled"), F.avg("gained").alias("mean_gained"),
                                                 F.avg((F.col("gained") >= 255).cast("double")).alias("saturated")), 4)


@query("a47_energy_ratios", f"""with m as (select l_suppkey, avg(l_quantity) as m from lineitem group by 1), v as (select l_suppkey, l_quantity as s, l_quantity - m as r from lineitem join m using (l_suppkey))
select l_suppkey, {r('sum(r * r) / sum(s * s)')} as energy_ratio, {r('20 * log10(255 / (stddev_pop(r) + 1e-6))')} as full_scale_db from v group by 1""")
def energy_ratios(spark, d):
    li = load(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("s"))
    mean = li.groupBy("l_suppkey").agg(F.avg("s").alias("m"))
    return rounded(S.energy_ratios(li.join(mean, "l_suppkey").withColumn("r", F.col("s") - F.col("m")), ["l_suppkey"], "s", "r"))
