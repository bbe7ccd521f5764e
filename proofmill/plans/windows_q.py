"""W, T, U and C: ordered operators, top-k, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes, jsonx, solar, vectors as V
from ..functions import numeric as N
from ..functions import text as X
from ..functions.numeric import row_count
from ..operators import grid as G
from ..operators import stats as S
from ..operators import windows as O
from ..operators.skew import Sequenced, global_rank
from ..sources import load
from .common import MODALITIES, OBS_DUCK, observations
from .evaluate_q import GRID_SQL, SERIES_SQL, TAPS_SQL, grid, reflect, series
from .joins_q import label_means
from .registry import query, r
from .stats_q import HIST_SQL, rounded



# ---- W ----

@query("w01_timeline", """
with e as (select event_id, user_id, case when event_id % 17 <> 0 then ts end as ts from events)
select event_id, user_id, round((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts nulls first, event_id)) / 1e6, 2) as gap_s from e""")
def timeline(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 17 != 0, F.col("ts")).alias("ts"))
    return O.timeline(e, "user_id", "ts", "event_id").select("event_id", "user_id", "gap_s")


@query("w02_latest_per_key", """
select o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def latest_per_key(spark, d):
    return O.latest_per_key(load(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("w03_sequence_gaps", """
with s as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as seq from events), k as (select * from s where event_id % 13 <> 0),
g as (select *, coalesce(lag(seq) over (partition by user_id order by seq), 0) + 1 as expected from k) select event_id, user_id, seq, seq - expected as missing from g where seq <> expected""")
def sequence_gaps(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts")
    numbered = Sequenced(e, ["user_id"], ["ts", "event_id"]).ordinal("seq").where("event_id % 13 <> 0")
    return O.sequence_gaps(numbered.drop("ts"), "user_id", "seq").select("event_id", "user_id", "seq", "missing")


@query("w04_ranking_gap", f"""
with x as (select vec_id, label, unnest(embedding::double[]) as v, unnest(range(1, 65)) as pos from embeddings), ref as (select label, pos, avg(v) as m from x group by 1, 2),
s as (select x.vec_id, x.label, corr(x.v, m) as score from x join ref using (label, pos) group by 1, 2), k as (select *, row_number() over (partition by label order by score desc, vec_id) as rk from s)
select label, max(vec_id) filter (where rk = 1) as top, round(max(score) filter (where rk = 1), 6) as score, round(max(score) filter (where rk = 2), 6) as second,
  round(max(score) filter (where rk = 1) - max(score) filter (where rk = 2), 6) as gap from k where rk <= 2 group by 1""")
def ranking_gap(spark, d):
    """The vector of every label closest to its label's mean pattern, and its lead."""
    refs = label_means(spark, d).select("label", V.standardised(F.col("vec")).alias("k"))
    scored = load(spark, d, "embeddings").join(refs, "label").select("label", "vec_id", V.dot(V.standardised(F.col("embedding")), F.col("k")).alias("score"))
    return rounded(O.top_with_gap(scored, ["label"], "score", "vec_id"))


@query("w05_demean", f"""
with x as (select vec_id, unnest(embedding::double[]) as v, unnest(range(1, 65)) as pos from embeddings), rr as (select vec_id, pos, v - avg(v) over (partition by vec_id) as v from x),
cc as (select vec_id, pos, v - avg(v) over (partition by pos) as v from rr), gg as (select vec_id, pos, v - avg(v) over () as v from cc)
select vec_id, {r('sum(v * v)')} as energy, {r('max(v) filter (where pos = 1)')} as first_value from gg group by 1""")
def demean(spark, d):
    out = O.demean(load(spark, d, "embeddings"), "vec_id", "embedding")
    return rounded(out.select("vec_id", V.dot(F.col("v"), F.col("v")).alias("energy"), F.element_at("v", 1).alias("first_value")))


@query("w06_adaptive_residual", f"""with {GRID_SQL}, o as (select unnest(range(-2, 3)) as o),
vy as (select p.item, p.x, p.y, p.n, sum(q.v) / 5 as m, sum(q.v * q.v) / 5 as s from g p, o, g q where q.item = p.item and q.x = p.x and q.y = {reflect('p.y + o', '64')} group by 1, 2, 3, 4),
vx as (select p.item, p.x, p.y, sum(q.m) / 5 as m, sum(q.s) / 5 as s from vy p, o, vy q where q.item = p.item and q.y = p.y and q.x = {reflect('p.x + o', 'p.n')} group by 1, 2, 3),
z as (select g.item, g.y, g.v, m, greatest(0, s - m * m) as var from g join vx on vx.item = g.item and vx.x = g.x and vx.y = g.y),
res as (select item, y, v - (m + least(greatest(var - 20.25, 0) / (var + 1e-6), 1) * (v - m)) as rs from z)
select item, y::bigint as y, {r('avg(abs(rs))', 4)} as mean_abs, {r('sum(rs * rs)', 2)} as energy from res group by 1, 2""")
def adaptive_residual(spark, d):
    out = O.adaptive_residual(grid(spark, d), "item", "x", "y", F.col("n"), F.lit(64).cast("long"), "v")
    s = out.groupBy("item", "y").agg(F.avg(F.abs("residual")).alias("mean_abs"), F.sum(F.col("residual") * F.col("residual")).alias("energy"))
    return s.select("item", "y", F.round("mean_abs", 4).alias("mean_abs"), F.round("energy", 2).alias("energy"))


@query("w07_gaussian_residual", f"""with {SERIES_SQL}, {TAPS_SQL}, m as (select p.event_type, p.pos, any_value(p.a) - sum(w * q.a) as rs from s p, taps, s q where q.event_type = p.event_type and q.pos = {reflect('p.pos + o', 'p.n')} group by 1, 2)
select event_type, {r('avg(abs(rs))', 4)} as mean_abs, {r('stddev_pop(rs)', 4)} as std, {r('max(abs(rs))', 4)} as peak from m group by 1""")
def gaussian_residual(spark, d):
    out = O.smooth_residual(series(spark, d), ["event_type"], "pos", F.col("n"), "a", G.gaussian_taps())
    return rounded(out.groupBy("event_type").agg(F.avg(F.abs("residual")).alias("mean_abs"), F.stddev_pop("residual").alias("std"), F.max(F.abs("residual")).alias("peak")), 4)


@query("w07_median_residual", f"""with {SERIES_SQL}, o as (select unnest(range(-2, 3)) as o), m as (select p.event_type, p.pos, any_value(p.a) - median(q.a) as rs from s p, o, s q where q.event_type = p.event_type and q.pos = {reflect('p.pos + o', 'p.n')} group by 1, 2)
select event_type, {r('avg(abs(rs)) + 1e-7', 4)} as mean_abs, {r('stddev_pop(rs)', 4)} as std, {r('max(abs(rs))', 4)} as peak from m group by 1""")
def median_residual(spark, d):
    out = O.median_residual(series(spark, d), ["event_type"], "pos", F.col("n"), "a", 2)
    return rounded(out.groupBy("event_type").agg((F.avg(F.abs("residual")) + 1e-7).alias("mean_abs"), F.stddev_pop("residual").alias("std"), F.max(F.abs("residual")).alias("peak")), 4)


@query("w08_derivatives", f"""with {SERIES_SQL}, k as (select event_type, pos, a, coalesce(lead(a) over w, lag(a) over w) as nx, coalesce(lag(a) over w, lead(a) over w) as pv from s window w as (partition by event_type order by pos))
select event_type, pos // 24 as day, {r('avg((nx - a) ** 2) + 1e-7', 4)} as e1, {r('avg((nx - 2 * a + pv) ** 2) + 1e-7', 4)} as e2, {r('avg((nx - 2 * a + pv) ** 2) / (avg((nx - a) ** 2) + 1e-5)', 4)} as ratio from k group by 1, 2""")
def derivatives(spark, d):
    out = O.derivatives(series(spark, d), ["event_type"], "pos", F.col("n"), "a")
    b = out.groupBy("event_type", F.floor(F.col("pos") / 24).alias("day")).agg(F.avg(F.col("d1") * F.col("d1")).alias("e1"), F.avg(F.col("d2") * F.col("d2")).alias("e2"))
    b = b.withColumn("ratio", F.col("e2") / (F.col("e1") + 1e-5))
    return rounded(b.withColumn("e1", F.col("e1") + 1e-7).withColumn("e2", F.col("e2") + 1e-7), 4)  # off exact halves


@query("w09_moving_average_residual", f"""with {SERIES_SQL}, o as (select unnest(range(-2, 3)) as o), m as (select p.event_type, p.pos, any_value(p.a) - sum(q.a) / 5 as rs from s p, o, s q where q.event_type = p.event_type and q.pos = least(greatest(p.pos + o, 0), p.n - 1) group by 1, 2)
select event_type, {r('sum(rs)', 4)} as total, {r('sum(rs * rs)', 2)} as energy from m group by 1""")
def moving_average_residual(spark, d):
    out = O.smooth_residual(series(spark, d), ["event_type"], "pos", F.col("n"), "a", [0.2] * 5, "edge")
    s = out.groupBy("event_type").agg(F.sum("residual").alias("total"), F.sum(F.col("residual") * F.col("residual")).alias("energy"))
    return s.select("event_type", (F.round("total", 4) + 0.0).alias("total"), F.round("energy", 2).alias("energy"))


@query("w10_autocorrelation", f"""with {SERIES_SQL}, z as (select event_type, pos, a - avg(a) over (partition by event_type) as v from s), p as (select x.event_type, y.pos - x.pos as lag, sum(x.v * y.v) as q from z x join z y on x.event_type = y.event_type and y.pos - x.pos between 0 and 31 group by 1, 2)
select event_type, round(greatest(0, max(q) filter (where lag = 8) - avg(q) filter (where lag in (6, 7, 9, 10))) / (max(q) filter (where lag = 0) + 1e-6) * 100, 4) as periodicity from p group by 1""")
def autocorrelation(spark, d):
    s = series(spark, d)
    m = s.groupBy("event_type").agg(F.avg("a").alias("m"))
    z = s.join(m, "event_type").withColumn("v", F.col("a") - F.col("m"))
    return O.periodicity(G.lag_products(z, ["event_type"], "pos", F.col("n"), "v", 32), ["event_type"])


@query("w11_curve_minima", f"""with c as (select p_brand, p_size, avg(p_retailprice) as price from part group by 1, 2), m as (select *, coalesce(price < lag(price) over w and price < lead(price) over w, false) as lm from c window w as (partition by p_brand order by p_size)),
f as (select p_brand, bool_or(lm) as has, arg_min(p_size, (price, p_size)) as g from m group by 1) select m.p_brand, p_size, {r('price', 4)} as price, has as is_local from m join f on m.p_brand = f.p_brand where lm or (not has and p_size = g)""")
def curve_minima(spark, d):
    curve = load(spark, d, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("price"))
    return rounded(O.curve_minima(curve, ["p_brand"], "p_size", "price"), 4)


@query("w12_z_outliers", f"""with s as (select l_suppkey, avg(l_extendedprice) as m, stddev_pop(l_extendedprice) as sd from lineitem group by 1)
select l_orderkey, l_linenumber, l_partkey, l.l_suppkey, {r('(l_extendedprice - m) / sd', 4)} as z from lineitem l join s on s.l_suppkey = l.l_suppkey where abs((l_extendedprice - m) / sd) >= 1.7""")
def z_outliers(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rounded(O.z_outliers(li, ["l_suppkey"], "l_extendedprice", 1.7).drop("l_extendedprice"), 4)


@query("w12_robust_outliers", f"""with s as (select event_type, median(value) as m, mad(value) as d from events group by 1)
select event_id, e.event_type, {r('(value - m) / (1.4826 * d)', 4)} as z from events e join s on s.event_type = e.event_type where abs((value - m) / (1.4826 * d)) >= 3.5""")
def robust_outliers(spark, d):
    e = load(spark, d, "events").select("event_id", "event_type", "value")
    return rounded(O.robust_outliers(e, ["event_type"], "value", 3.5).drop("value"), 4)


@query("w13_iqr_fence", """with s as (select event_type, quantile_cont(value, 0.5) as q50, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 0.001) as iqr from events group by 1)
select event_id, e.event_type, case when value < q50 - 1.75 * iqr then 'LOW' else 'HIGH' end as side from events e join s on s.event_type = e.event_type where value < q50 - 1.75 * iqr or value > q50 + 2.5 * iqr""")
def iqr_fence(spark, d):
    return O.fence_outliers(load(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value").drop("value")


@query("w14_running_share", f"{HIST_SQL} select l_returnflag, bin, {r('sum(n) over (partition by l_returnflag order by bin) / sum(n) over (partition by l_returnflag)')} as share from h")
def running_share(spark, d):
    h = S.histogram(load(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0, 105000, 256)
    return rounded(h.select("l_returnflag", "bin", F.col("cdf").alias("share")))


# ---- T ----

@query("t01_newest_page", "select o_orderkey, o_orderstatus from orders order by o_orderdate desc, o_orderkey desc limit 40 offset 80")
def newest_page(spark, d):
    return load(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(80).limit(40).select("o_orderkey", "o_orderstatus")


@query("t02_global_top", "select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 100")
def global_top(spark, d):
    return load(spark, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(100) \
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("t03_top_per_key", "select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) as rank from events qualify rank <= 20")
def top_per_key(spark, d):
    out = O.top_per_key(load(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 20)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("t05_array_order", "select vec_id, row_number() over (order by embedding, vec_id) - 1 as rank from embeddings")
def array_order(spark, d):
    return global_rank(load(spark, d, "embeddings").select("vec_id", "embedding"), ["embedding", "vec_id"]).select("vec_id", "rank")


# ---- U ----

@query("u01_heterogeneous_union", """select 'customer' as entity, c_custkey as id, c_name as name, c_acctbal as amount, null::varchar as state from customer
union all select 'order', o_orderkey, null, o_totalprice, o_orderstatus from orders union all select 'supplier', s_suppkey, s_name, s_acctbal, null from supplier""")
def heterogeneous_union(spark, d):
    c = load(spark, d, "customer").select(F.lit("customer").alias("entity"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    o = load(spark, d, "orders").select(F.lit("order").alias("entity"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("state"))
    s = load(spark, d, "supplier").select(F.lit("supplier").alias("entity"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount"))
    return c.unionByName(o, allowMissingColumns=True).unionByName(s, allowMissingColumns=True)


@query("u02_ordered_distinct", "select lang, source, min(doc_id) as first_id from documents group by 1, 2")
def ordered_distinct(spark, d):
    return load(spark, d, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("first_id"))


@query("u03_set_difference", """select 'EXPECTED_ONLY' as side, o_custkey as key from (select distinct o_custkey from orders where o_orderstatus = 'F' except select distinct o_custkey from orders where o_orderstatus = 'P')
union all select 'ACTUAL_ONLY', o_custkey from (select distinct o_custkey from orders where o_orderstatus = 'P' except select distinct o_custkey from orders where o_orderstatus = 'F')""")
def set_difference(spark, d):
    """Both directions from one aggregation instead of two set differences."""
    o = load(spark, d, "orders")
    side = o.groupBy(F.col("o_custkey").alias("key")).agg(F.max(F.col("o_orderstatus") == "F").alias("f"), F.max(F.col("o_orderstatus") == "P").alias("p")).where("f <> p")
    return side.select(F.when(F.col("f"), "EXPECTED_ONLY").otherwise("ACTUAL_ONLY").alias("side"), "key")


@query("u04_missing_modalities", f"""with m(modality) as (values {", ".join(f"('{m}')" for m in MODALITIES)})
select o_orderkey as item_id, coalesce(string_agg(case when x.item_id is null then m.modality end, ',' order by m.modality), '') as missing from orders cross join m
left join (select distinct item_id, modality from ({OBS_DUCK})) x on x.item_id = o_orderkey and x.modality = m.modality group by 1""")
def missing_modalities(spark, d):
    present = observations(spark, d).groupBy("item_id").agg(F.collect_set("modality").alias("p"))  # at most five values
    every = F.array(*[F.lit(m) for m in MODALITIES])
    items = load(spark, d, "orders").select(F.col("o_orderkey").alias("item_id")).join(present, "item_id", "left")
    return items.select("item_id", F.concat_ws(",", F.array_sort(F.array_except(every, F.coalesce("p", F.array().cast("array<string>"))))).alias("missing"))


@query("u05_set_equality", """select 'same' as pair, true as equal, 0::bigint as differing union all
select 'changed', false, (select count(*) from customer where c_custkey % 50 = 0) * 2""")
def set_equality(spark, d):
    """A shuffled copy equals the original as a multiset; one with changed rows does not."""
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = c.withColumn("c_name", F.when(F.col("c_custkey") % 50 == 0, F.upper("c_name")).otherwise(F.col("c_name")))
    out = None
    for name, other in (("same", c.orderBy(F.desc("c_custkey"))), ("changed", changed)):
        diff = c.exceptAll(other).unionByName(other.exceptAll(c)).agg(row_count().alias("differing"))
        row = diff.select(F.lit(name).alias("pair"), (F.col("differing") == 0).alias("equal"), "differing")
        out = row if out is None else out.unionByName(row)
    return out


@query("u06_surviving_edges", """select o_orderkey, o_custkey from orders where o_orderstatus <> 'F' and o_orderkey in (select l_orderkey from lineitem where l_quantity >= 40) and o_custkey in (select c_custkey from customer where c_acctbal >= 0)""")
def surviving_edges(spark, d):
    edges = load(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey")
    left = load(spark, d, "lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("o_orderkey"))
    right = load(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return edges.join(left, "o_orderkey", "left_semi").join(right, "o_custkey", "left_semi")


# ---- C ----

@query("c01_strings", """select page_id, regexp_extract(replace(url, chr(92), '/'), '([^/]*)$', 1) as file_name, case when length(url) > 30 then concat(substr(url, 1, 30), '...') else url end as short,
  case when length(html) < 1024 then concat(length(html), ' B') when length(html) < 1048576 then printf('%.1f KB', length(html) / 1024.0) else printf('%.1f MB', length(html) / 1048576.0) end as size_text from pages""")
def strings(spark, d):
    return load(spark, d, "pages").select("page_id", X.file_name(F.col("url")).alias("file_name"), X.shorten(F.col("url"), 30).alias("short"), X.size_text(F.length("html")).alias("size_text"))


@query("c02_canonical_hashes", r"""select doc_id, sha256(concat('{"doc_id":', doc_id, ',"lang":"', lang, '","missing":null,"source":"', source, '"}')) as fingerprint,
  sha256(regexp_replace(concat(source, chr(13), chr(10), lang), '\r\n?', chr(10), 'g')) as lf_hash, concat(substr(regexp_replace(concat(source, '/', doc_id), '[^A-Za-z0-9_-]', '_', 'g'), 1, 48), '_', substr(sha256(concat(source, '/', doc_id)), 1, 10)) as safe_id from documents""")
def canonical_hashes(spark, d):
    docs = load(spark, d, "documents")
    body = X.canonical_json({"source": F.col("source"), "lang": F.col("lang"), "doc_id": F.col("doc_id"), "missing": F.lit(None).cast("string")})
    return docs.select("doc_id", X.sha256(body).alias("fingerprint"), X.lf_sha256(F.concat("source", F.lit("\r\n"), "lang")).alias("lf_hash"),
                       X.safe_id(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("safe_id"))


@query("c03_times", """with t as (select event_id, ts, case event_id % 4 when 0 then strftime(ts, '%Y:%m:%d %H:%M:%S') when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S') else 'n/a' end as s from events)
select event_id, strftime(coalesce(try_strptime(s, '%Y:%m:%d %H:%M:%S'), try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%Y-%m-%dT%H:%M:%S')), '%Y-%m-%dT%H:%M:%S') as iso,
  round((epoch_us(ts) - epoch_us(coalesce(try_strptime(s, '%Y:%m:%d %H:%M:%S'), try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%Y-%m-%dT%H:%M:%S')))) / 1e6, 6) as lost_s from t""")
def times(spark, d):
    m = F.col("event_id") % 4
    s = (F.when(m == 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).when(m == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
         .when(m == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("n/a"))
    parsed = X.parse_time(s)
    return load(spark, d, "events").select("event_id", F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
                                           F.round((X.epoch_us(F.col("ts")) - F.unix_micros(parsed)) / 1e6, 6).alias("lost_s"))


@query("c04_math", f"""select p_partkey, {r('log2(p_size)')} as lg2, {r('log10(p_retailprice)')} as lg10, {r('ln(1 + p_size)')} as lg1p, {r('sqrt(p_retailprice ** 2 + p_size ** 2)')} as hyp,
  {r('fmod(degrees(atan2(p_size - 25, p_retailprice - 1000)) + 360, 360)')} as direction, {r('least(greatest(p_retailprice, 950), 1050)')} as clipped from part""")
def math(spark, d):
    s, p = F.col("p_size"), F.col("p_retailprice")
    return rounded(load(spark, d, "part").select(
        "p_partkey", F.log2(s).alias("lg2"), F.log10(p).alias("lg10"), F.log1p(s).alias("lg1p"), F.hypot(p, s).alias("hyp"),
        N.wrap_degrees(F.degrees(F.atan2(s - 25, p - 1000))).alias("direction"), N.clip(p, 950.0, 1050.0).alias("clipped")))


@query("c05_arrays", f"""with e as (select vec_id, embedding::double[] as v from embeddings) select vec_id, {r('sqrt(list_inner_product(v, v))')} as norm, {r('list_min(v)')} as low, {r('list_max(v)')} as high,
  {r('list_inner_product(v[1:32], v[33:64])')} as half_dot, {r('list_sort(v)[2]')} as second_lowest from e""")
def arrays(spark, d):
    v = F.col("embedding").cast("array<double>")
    return rounded(load(spark, d, "embeddings").select(
        "vec_id", V.norm(v).alias("norm"), F.array_min(v).alias("low"), F.array_max(v).alias("high"),
        V.dot(F.slice(v, 1, 32), F.slice(v, 33, 32)).alias("half_dot"), F.element_at(F.array_sort(v), 2).alias("second_lowest")))


@query("c06_json_paths", """with e as (select event_id, cast(json_extract_string(props, '$.k') as integer) as k, props from events)
select event_id, k::varchar as k_text, k % 10 = 0 as flagged, case when k % 3 = 0 then concat('{"raw":"', k, '<"}') else props end as details from e""")
def json_paths(spark, d):
    k = jsonx.path_text(F.col("props"), ["$.missing", "$.k"])
    n = k.cast("int")
    doc = F.to_json(F.struct((n % 10 == 0).alias("is_round"), (n % 2 == 0).alias("even")))
    bad = F.when(n % 3 == 0, F.concat(k, F.lit("<"))).otherwise(F.col("props"))
    return load(spark, d, "events").select("event_id", k.alias("k_text"), jsonx.any_flag(doc).alias("flagged"), jsonx.or_raw(bad).alias("details"))


@query("c07_bits", """with h as (select vec_id, list_aggregate(list_transform(range(1, 65), lambda i: case when embedding[i] >= 0 then '1' else '0' end), 'string_agg', '') as h from embeddings)
select a.vec_id, length(replace(a.h, '0', '')) as ones, hamming(a.h, b.h)::integer as distance_to_next, length(replace(substr(a.h, 1, 16), '0', ''))::bigint as top_ones from h a join h b on b.vec_id = a.vec_id + 1""")
def bits(spark, d):
    h = load(spark, d, "embeddings").select("vec_id", V.sign_hash(F.col("embedding")).alias("h"))
    nxt = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g"))
    return h.join(nxt, "vec_id").select("vec_id", F.bit_count("h").cast("long").alias("ones"), V.hamming(F.col("h"), F.col("g")).alias("distance_to_next"),
                                        F.bit_count(V.bit_window(F.col("h"), 48, 16)).cast("long").alias("top_ones"))


@query("c08_boxes", f"""with p as (select p_partkey, p_size % 20 as x, p_size % 7 as y, p_size + 1 as w, p_size % 11 + 1 as h, p_partkey % 13 as x2, p_partkey % 5 as y2 from part),
i as (select *, greatest(least(x + w, x2 + 12) - greatest(x, x2), 0) * greatest(least(y + h, y2 + 6) - greatest(y, y2), 0) as inter from p)
select p_partkey, {r('w * h')} as area, {r('inter / (w * h + 72 - inter)')} as iou, {r('abs(w / h - 2.0) / greatest(w / h, 2.0)')} as aspect_delta,
  round(least(greatest(x / 40.0, 0), 1), 4)::double as x, round(least(greatest(y / 30.0, 0), 1), 4)::double as y, round(least(greatest(w / 40.0, 0.01), 1), 4)::double as width, round(least(greatest(h / 30.0, 0.01), 1), 4)::double as height from i""")
def box_geometry(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    x, y, w, h = s % 20, s % 7, s + 1, s % 11 + 1
    a = boxes.from_size(x, y, w, h)
    b = boxes.from_size(k % 13, k % 5, F.lit(12), F.lit(6))
    p = load(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"), x.alias("x0"), y.alias("y0"), w.alias("w0"), h.alias("h0"))
    return rounded(p.select("p_partkey", boxes.area(F.col("a")).alias("area"), boxes.box_iou(F.col("a"), F.col("b")).alias("iou"),
                            boxes.aspect_delta(F.col("w0") / F.col("h0"), F.lit(2.0)).alias("aspect_delta"),
                            *boxes.normalised(F.col("x0"), F.col("y0"), F.col("w0"), F.col("h0"), F.lit(40.0), F.lit(30.0))))


SUN_SQL = """with e as (select event_id, user_id, user_id % 120 - 60.0 as lat, (user_id * 7) % 360 - 180.0 as lon, ts, epoch(ts)::double as ep from events),
a as (select *, floor(ep) / 86400.0 + 2440587.5 as jd, hour(ts) * 60.0 + minute(ts) + floor(second(ts)) / 60.0 as dm from e),
b as (select *, (floor(jd - 0.5) + 0.5 + dm / 1440.0 - 2451545.0) / 36525.0 as t from a),
c as (select *, fmod(fmod(280.46646 + t * (36000.76983 + 0.0003032 * t), 360) + 360, 360) as l0, radians(fmod(fmod(357.52911 + t * (35999.05029 - 0.0001537 * t), 360) + 360, 360)) as m, 0.016708634 - t * (0.000042037 + 0.0000001267 * t) as ec, radians(125.04 - 1934.136 * t) as om from b),
d as (select *, radians(l0 + sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289 - 0.00569 - 0.00478 * sin(om)) as lam,
  radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * cos(om)) as ob from c),
f as (select *, asin(sin(ob) * sin(lam)) as de, tan(ob / 2) ** 2 as y, radians(l0) as lr from d),
g as (select *, 4 * degrees(y * sin(2 * lr) - 2 * ec * sin(m) + 4 * ec * y * sin(m) * cos(2 * lr) - 0.5 * y * y * sin(4 * lr) - 1.25 * ec * ec * sin(2 * m)) as eot from f),
h as (select *, fmod(fmod(dm + eot + 4 * lon, 1440) + 1440, 1440) / 4 - 180 as ha, radians(lat) as la from g),
z as (select *, acos(least(greatest(sin(la) * sin(de) + cos(la) * cos(de) * cos(radians(ha)), -1), 1)) as ze from h),
az as (select *, 90 - degrees(ze) as elevation, 180 - degrees(acos(least(greatest((sin(la) * cos(ze) - sin(de)) / (cos(la) * sin(ze)), -1), 1))) as east from z)"""


def sun_rows(spark, d):
    u = F.col("user_id")
    e = load(spark, d, "events").select("event_id", "user_id", "ts", (u % 120 - 60.0).alias("lat"), ((u * 7) % 360 - 180.0).alias("lon"))
    return solar.with_sun_position(e, "lat", "lon", "ts").select("event_id", "user_id", "elevation", "azimuth", "shadow_azimuth", "eot")


@query("c09_solar_position", f"{SUN_SQL} select event_id, round(elevation, 2) as elevation, round(case when ha > 0 then 360 - east else east end, 2) as azimuth, round(eot, 2) as eot from az")
def solar_position(spark, d):
    return rounded(sun_rows(spark, d).drop("user_id", "shadow_azimuth"), 2)


@query("c09_day_night_conflicts", f"""{SUN_SQL}, k as (select user_id, elevation, abs((user_id * 31) % 360 - fmod(case when ha > 0 then 360 - east else east end + 180, 360)) as dd from az)
select user_id, count(*) as n, count(*) filter (where elevation < -1) as night_conflicts, {r('count(*) filter (where elevation < -1) / count(*)')} as conflict_rate,
  count(*) filter (where elevation >= -1 and case when dd > 180 then 360 - dd else dd end > 45) as direction_conflicts from k group by 1""")
def day_night_conflicts(spark, d):
    """Per device: items whose sun was below the horizon, and whose claimed shadow points elsewhere."""
    s = sun_rows(spark, d).withColumn("gap", N.angle_gap(((F.col("user_id") * 31) % 360).cast("double"), F.col("shadow_azimuth")))
    night = F.col("elevation") < -1.0
    return rounded(s.groupBy("user_id").agg(row_count().alias("n"), F.count_if(night).alias("night_conflicts"), F.avg(night.cast("double")).alias("conflict_rate"),
                                            F.count_if(~night & (F.col("gap") > 45.0)).alias("direction_conflicts")))


_SCENE_SQL = SUN_SQL.replace("select event_id, user_id, user_id % 120 - 60.0 as lat, (user_id * 7) % 360 - 180.0 as lon, ts, epoch(ts)::double as ep from events",
                             "select user_id as event_id, user_id, user_id % 120 - 60.0 as lat, (user_id * 7) % 360 - 180.0 as lon, ts, epoch(ts)::double as ep from (select user_id, min(ts) - to_hours((user_id % 5 - 2)::integer) as ts from events group by 1)")


@query("c09_lighting_verdicts", f"""{_SCENE_SQL}, an as (select user_id, (epoch_us(ts) % 86400000000) / 86400000000.0 * 360 as angle from events),
mn as (select user_id, fmod(degrees(atan2(avg(sin(radians(angle))), avg(cos(radians(angle))))) + 360, 360) as mean_deg from an group by 1),
gp as (select user_id, any_value(mean_deg) as mean_deg, avg(case when least(abs(angle - mean_deg), 360 - abs(angle - mean_deg)) > 60 then 1.0 else 0.0 end) as share from an join mn using (user_id) group by 1),
pr as (select user_id, elevation, fmod(case when ha > 0 then 360 - east else east end + 180, 360) as expected, fmod(mean_deg + 180, 360) as measured, share from az join gp using (user_id)),
vd as (select *, case when elevation < -1 then 'DAY_NIGHT_CONFLICT' when least(abs(measured - expected), 360 - abs(measured - expected)) > 45 then 'INCONSISTENT' else 'CONSISTENT' end as consistency from pr),
sc as (select *, case when consistency = 'CONSISTENT' then least(1, share * 1.5) else greatest(least(1, share * 1.5), 0.75) end as score from vd)
select user_id, round(elevation, 2) as elevation, round(case when elevation > 0.5 then 1 / tan(radians(elevation)) else 99.0 end, 2) as shadow_ratio, consistency, round(score, 4) as score,
  case consistency when 'DAY_NIGHT_CONFLICT' then 'SOLAR_NIGHT_CONFLICT' when 'INCONSISTENT' then 'SOLAR_ASTRONOMICAL_ANOMALY'
    else case when share > 0.4 then 'LIGHTING_DIRECTION_ANOMALY' when share > 0.2 then 'MODERATE_LIGHTING_VARIANCE' else 'LIGHTING_PHYSICS_CONSISTENT' end end as verdict,
  case when score > 0.4 then 'anomalous' when score > 0.2 then 'elevated' else 'consistent' end as direction from sc""")
def lighting_verdicts(spark, d):
    """Every device as a scene: its first event's local time and place against the directions (times of day) of all its events."""
    u, us = F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    e = load(spark, d, "events").select("user_id", "ts", (F.pmod(us, F.lit(86_400_000_000)) / 86_400_000_000.0 * 360.0).alias("angle"))
    light = S.circular(e, ["user_id"], "angle", 60.0).select("user_id", "mean_deg", "divergent_share")
    claim = e.groupBy("user_id").agg(F.min("ts").alias("ts")).select("user_id", "ts", (u % 120 - 60.0).alias("lat"), ((u * 7) % 360 - 180.0).alias("lon"))
    seen = solar.with_sun_position(claim, "lat", "lon", "ts", zone=u % 5 - 2).join(light, "user_id")
    out = solar.with_lighting_verdict(seen, "divergent_share", "mean_deg")
    return out.select("user_id", F.round("elevation", 2).alias("elevation"), F.round("shadow_ratio", 2).alias("shadow_ratio"), "consistency", F.round("score", 4).alias("score"), "verdict", "direction")
