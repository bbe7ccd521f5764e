"""A-13 .. A-16, A-23, A-25 .. A-31: evaluation, reference patterns, grids and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation as P
from ..operators import evaluate as E
from ..operators import grid as G
from ..session import cut
from ..sources import load
from .registry import query, r
from .stats_q import rounded

# ---- stand-ins: events as dense series and as dense grids ----

SERIES_SQL = """bd as (select min(epoch_us(ts) // 3600000000) as lo, max(epoch_us(ts) // 3600000000) as hi from events),
gr as (select t.event_type, unnest(range(0, (hi - lo + 1)::bigint)) as pos, (hi - lo + 1)::bigint as n from (select distinct event_type from events) t, bd),
hr as (select event_type, epoch_us(ts) // 3600000000 - lo as pos, sum(value) as v, count(*) as c from events, bd group by 1, 2),
s as (select gr.event_type, gr.pos, gr.n, coalesce(v, 0)::double as a, coalesce(c, 0) * 50.0::double as b from gr left join hr on gr.event_type = hr.event_type and gr.pos = hr.pos)"""

GRID_SQL = """bd as (select min(epoch_us(ts) // 21600000000) as lo, max(epoch_us(ts) // 21600000000) as hi from events),
gr as (select t.event_type as item, y.y, x.x, (hi - lo + 1)::bigint as n from (select distinct event_type from events) t, bd, range(0, 64) y(y), (select unnest(range(0, (hi - lo + 1)::bigint)) as x from bd) x),
cl as (select event_type as item, user_id % 64 as y, epoch_us(ts) // 21600000000 - lo as x, sum(value) as v from events, bd group by 1, 2, 3),
g as (select gr.item, gr.y, gr.x, gr.n, coalesce(v, 0)::double as v from gr left join cl on gr.item = cl.item and gr.y = cl.y and gr.x = cl.x)"""


def _buckets(spark, d, width_us):
    """Events with their time bucket counted from the first one, the bucket count, and the event types."""
    e = load(spark, d, "events").withColumn("__t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / width_us))
    span = e.agg(F.min("__t").alias("lo"), F.max("__t").alias("hi"))  # one row
    return e.join(F.broadcast(span)).withColumn("pos", F.col("__t") - F.col("lo")), span, e.select("event_type").distinct()


def series(spark, d):
    """event_type, pos (hour), n (hours), a (value sum), b (50 per event); every hour present."""
    e, span, types = _buckets(spark, d, 3_600_000_000)
    grid = types.join(F.broadcast(span)).select("event_type", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hi") - F.col("lo"))).alias("pos"), (F.col("hi") - F.col("lo") + 1).alias("n"))
    sums = e.groupBy("event_type", "pos").agg(F.sum("value").alias("a"), (F.count(F.lit(1)) * 50.0).alias("b"))
    return grid.join(sums, ["event_type", "pos"], "left").fillna(0.0, ["a", "b"])


def grid(spark, d):
    """item (event type), y (user mod 64), x (six-hour bucket), n (width), v (value sum); every cell present."""
    e, span, types = _buckets(spark, d, 21_600_000_000)
    base = types.join(F.broadcast(span)).select(
        F.col("event_type").alias("item"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("y"), (F.col("hi") - F.col("lo") + 1).alias("n")) \
        .withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    sums = e.groupBy(F.col("event_type").alias("item"), (F.col("user_id") % 64).alias("y"), F.col("pos").alias("x")).agg(F.sum("value").alias("v"))
    return base.join(sums, ["item", "y", "x"], "left").fillna(0.0, ["v"])


_TAPS = ", ".join(repr(t) for t in G.gaussian_taps())
TAPS_SQL = f"taps as (select unnest(range(-5, 6)) as o, unnest([{_TAPS}]) as w)"


def reflect(expr, n):
    return f"case when {expr} < 0 then -({expr}) when {expr} >= {n} then 2 * ({n} - 1) - ({expr}) else {expr} end"


# ---- fidelity and detection ----

@query("a13_ssim_series", f"""with {SERIES_SQL}, {TAPS_SQL},
m as (select p.event_type, p.pos, sum(w * q.a) as ma, sum(w * q.b) as mb, sum(w * q.a * q.a) as aa, sum(w * q.b * q.b) as bb, sum(w * q.a * q.b) as ab
  from s p, taps, s q where q.event_type = p.event_type and q.pos = {reflect('p.pos + o', 'p.n')} group by 1, 2)
select event_type, {r('avg(((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (greatest(aa - ma * ma, 0) + greatest(bb - mb * mb, 0) + 58.5225)))')} as ssim from m group by 1""")
def ssim_series(spark, d):
    return rounded(G.ssim(series(spark, d), ["event_type"], [("pos", F.col("n"))], "a", "b"))


GRID_SSIM_SQL = f"""with {GRID_SQL}, {TAPS_SQL}, c as (select item, y, x, n, v as a, v * 0.5 as b from g),
py as (select p.item, p.y, p.x, p.n, sum(w * q.a) as a, sum(w * q.b) as b, sum(w * q.a * q.a) as aa, sum(w * q.b * q.b) as bb, sum(w * q.a * q.b) as ab
  from c p, taps, c q where q.item = p.item and q.x = p.x and q.y = {reflect('p.y + o', '64')} group by 1, 2, 3, 4),
m as (select p.item, p.y, p.x, sum(w * q.a) as ma, sum(w * q.b) as mb, sum(w * q.aa) as aa, sum(w * q.bb) as bb, sum(w * q.ab) as ab
  from py p, taps, py q where q.item = p.item and q.y = p.y and q.x = {reflect('p.x + o', 'p.n')} group by 1, 2, 3)
select item, {r('avg(((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (greatest(aa - ma * ma, 0) + greatest(bb - mb * mb, 0) + 58.5225)))')} as ssim from m group by 1"""


@query("a13_ssim_grid", GRID_SSIM_SQL)
def ssim_grid(spark, d):
    """The grid against its halved copy, both axes."""
    g = grid(spark, d).withColumn("half", F.col("v") * 0.5)
    return rounded(G.ssim(g, ["item"], [("y", F.lit(64).cast("long")), ("x", F.col("n"))], "v", "half"))


SCORED_SQL = """select lang, toxic, least(255, n_chars / 20.0) as s1, least(255, quality * 100 + n_chars % 100)::double as s2 from documents join labels using (doc_id)"""


def scored(spark, d):
    j = load(spark, d, "documents").select("doc_id", "lang", "n_chars").join(load(spark, d, "labels"), "doc_id")
    return j.select("lang", "toxic", F.least(F.lit(255.0), F.col("n_chars") / 20.0).alias("s1"),
                    F.least(F.lit(255), F.col("quality") * 100 + F.col("n_chars") % 100).cast("double").alias("s2"))


_CM = """count(*) filter (where p and t) as tp, count(*) filter (where p and not t) as fp, count(*) filter (where not p and t) as fn, count(*) filter (where not p and not t) as tn"""


def metric_sql(policy):
    e = "1.0" if policy == "strict" else "0.0"
    z = {"iou": ("tp", "tp + fp + fn", e), "precision": ("tp", "tp + fp", "0.0"), "recall": ("tp", "tp + fn", "0.0"), "f1": ("2.0 * tp", "2 * tp + fp + fn", e),
         "dice": ("2.0 * tp", "2 * tp + fp + fn", e), "fpr": ("fp", "fp + tn", "0.0"), "specificity": ("tn", "tn + fp", "0.0"), "accuracy": ("tp + tn", "tp + fp + fn + tn", "0.0")}
    return ", ".join(f"round(case when {den} <> 0 then ({num})::double / ({den}) else {dflt}::double end, 6) as {k}" for k, (num, den, dflt) in z.items())


@query("a14_confusion_matrix", f"select lang, {_CM} from (select lang, s1 >= 64 as p, toxic > 0 as t from ({SCORED_SQL})) group by 1")
def confusion_matrix(spark, d):
    return E.confusion(scored(spark, d), ["lang"], F.col("s1") >= 64, F.col("toxic") > 0)


@query("a15_detection_metrics", f"with c as (select lang, {_CM} from (select lang, s1 >= 240 as p, toxic > 0 as t from ({SCORED_SQL})) group by 1) select *, {metric_sql('strict')} from c")
def detection_metrics(spark, d):
    return rounded(E.detection_metrics(E.confusion(scored(spark, d), ["lang"], F.col("s1") >= 240, F.col("toxic") > 0)))


@query("a15_detection_metrics_bench", f"with c as (select lang, {_CM} from (select lang, s1 > 254.5 as p, toxic * 100 > 127 as t from ({SCORED_SQL})) group by 1) select *, {metric_sql('bench')} from c")
def detection_metrics_bench(spark, d):
    """The other counting policy, on labels scaled so that nothing is positive: the empty-mask rules apply."""
    from ..functions import numeric as N
    counts = E.confusion(scored(spark, d), ["lang"], N.positive(F.col("s1"), 254.5, "bench"), N.truth(F.col("toxic") * 100, "bench"))
    return rounded(E.detection_metrics(counts, "bench"))


@query("a16_threshold_sweep", f"""with x as (select unnest(['chars', 'mixed']) as method, unnest([s1, s2]) as s, toxic from ({SCORED_SQL})),
c as (select method, th::double as threshold, {_CM} from (select method, th, s >= th as p, toxic > 0 as t from x, (values (32), (64), (128)) h(th)) group by 1, 2) select *, {metric_sql('strict')} from c""")
def threshold_sweep(spark, d):
    s = scored(spark, d).withColumnsRenamed({"s1": "chars", "s2": "mixed"}).unpivot(["toxic"], ["chars", "mixed"], "method", "s")
    return rounded(E.threshold_sweep(s, ["method"], "s", "toxic", [32.0, 64.0, 128.0]))


# ---- reference patterns ----

@query("a23_reference_pattern", f"""with x as (select label, unnest(embedding::double[]) as w, unnest(range(0, 64)) as pos from embeddings),
k as (select label, pos, sum(w * (w + 0.5)) / (sum((w + 0.5) * (w + 0.5)) + 1e-6) as k from x group by 1, 2), c as (select label, pos, k - avg(k) over (partition by label) as k, stddev_pop(k) over (partition by label) as sd from k)
select label, pos, {r('k / sd')} as k from c""")
def reference_pattern(spark, d):
    x = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "w")).select(
        "label", F.col("pos").cast("long").alias("pos"), F.col("w").cast("double").alias("w"), (F.col("w").cast("double") + 0.5).alias("i"))
    return rounded(E.reference_pattern(x, "label", "pos", "w", "i"))


@query("a25_peak_to_energy", f"""with dd as (select event_type, user_id % 8 as grp, (epoch_us(ts) // 86400000000 - 19723) % 30 as pos, sum(value) as v from events group by 1, 2, 3),
ab as (select * from dd where event_type = 'view'), cd as (select * from dd where event_type = 'click'),
za as (select grp, sum(v) / 30 as m, sum(v * v) as q from ab group by 1), zc as (select grp, sum(v) / 30 as m, sum(v * v) as q from cd group by 1),
x as (select ab.grp, pos, v - m as v, sqrt(q - m * m * 30) as nn from ab join za on ab.grp = za.grp), y as (select cd.grp, pos, v - m as v, sqrt(q - m * m * 30) as nn from cd join zc on cd.grp = zc.grp),
l as (select x.grp, (x.pos - y.pos + 30) % 30 as lag, sum(x.v * y.v) / (any_value(x.nn) * any_value(y.nn) + 1e-12) as c from x join y on x.grp = y.grp group by 1, 2),
p as (select grp, (lag + 15) % 30 as spot, c from l), k as (select grp, arg_max(spot, (abs(c), -spot)) as ps, arg_max(c, (abs(c), -spot)) as pc from p group by 1)
select k.grp, {r('pc')} as peak, ps - 15 as offset, round(pc * pc / (select avg(c * c) from p where p.grp = k.grp and abs(spot - ps) > 5), 2) as pce from k""")
def peak_to_energy_q(spark, d):
    """Daily view sums against daily click sums of eight user groups, folded to 30 days."""
    day = F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000) - 19723, F.lit(30))
    e = load(spark, d, "events").groupBy("event_type", (F.col("user_id") % 8).alias("grp"), day.alias("pos")).agg(F.sum("value").alias("v"))
    lags = cut(P.series_correlation(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["grp"], "pos", "v", 30))
    return E.peak_to_energy(lags, ["grp"], 30).withColumn("peak", F.round("peak", 6))


@query("a25_pattern_peak", f"""with {GRID_SQL}, st as (select item, avg(v) as m, sqrt(sum((v - avg_v) ** 2)) as nn from (select *, avg(v) over (partition by item) as avg_v from g) group by 1),
x as (select item, y, x, n, v - m as v, nn from g join st using (item) where item <> 'click'), k as (select y, x, v - m as v, nn from g join st using (item) where item = 'click'),
l as (select x.item, (x.y - k.y + 64) % 64 as ly, (x.x - k.x + n) % n as lx, any_value(n) as n, sum(x.v * k.v) / (any_value(x.nn) * any_value(k.nn) + 1e-12) as c from x, k group by 1, 2, 3),
s as (select item, (ly + 32) % 64 as py, (lx + n // 2) % n as px, n, c from l), p as (select item, arg_max(struct_pack(py, px, c), (abs(c), -py, -px)) as b, any_value(n) as n from s group by 1)
select p.item, {r('b.c')} as peak, (b.py - 32)::bigint as offset_y, (b.px - n // 2)::bigint as offset_x,
  round(b.c ** 2 / (select avg(c * c) from s where s.item = p.item and not (abs(s.py - b.py) <= 5 and abs(s.px - b.px) <= 5)), 2) as pce from p""")
def pattern_peak_q(spark, d):
    """Activity planes (user class by six-hour bucket) of every event type against that of clicks."""
    g = cut(grid(spark, d))
    width = g.agg(F.max("n")).first()[0]
    mine, clicks = g.where("item <> 'click'"), g.where("item = 'click'").drop("item")
    theirs = mine.select("item").distinct().join(F.broadcast(clicks))  # 64 rows of cells for each event type
    surface = cut(P.pattern_correlation(mine, theirs, ["item"], "y", "x", "v", 64, width))
    return P.pattern_peak(surface, ["item"], 64, width).withColumn("peak", F.round("peak", 6))


# ---- grids ----

# sums of cents over 64 cells often end on an exact half: both sides are nudged off it
_BLOCK = ", ".join(["count(*) as cells"] + [f"round({e} + 1e-9, 4) as {n}" for n, e in (
    ("mean", "avg(v)"), ("var", "var_pop(v)"), ("mean_abs", "avg(abs(v))"), ("median", "median(v)"), ("mad", "mad(v)"))])


def nudged(df):
    return rounded(df.select(*[(F.col(c) + 1e-9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]), 4)




@query("a26_grid_blocks", f"""with {GRID_SQL} select item, (y // 8)::bigint as "by", (x // 8)::bigint as bx, {_BLOCK} from g group by 1, 2, 3""")
def grid_blocks(spark, d):
    return nudged(G.grid_blocks(grid(spark, d), "item", "x", "y", "v", 8))


@query("a26_grid_blocks_overlapping", f"""with {GRID_SQL} select item, "by", bx, {_BLOCK} from g, range(0, 16) a("by"), range(0, 1000) b(bx)
where y between "by" * 4 and "by" * 4 + 7 and x between bx * 4 and bx * 4 + 7 and bx * 4 < n group by 1, 2, 3""")
def grid_blocks_overlapping(spark, d):
    return nudged(G.grid_blocks(grid(spark, d), "item", "x", "y", "v", 8, 4))


EDGE_SQL = f"""with {GRID_SQL},
d as (select *, abs(v - lag(v) over wy) as by1, abs(lag(v) over wy - lag(v, 2) over wy) as by2, abs(lead(v) over wy - v) as by3,
  abs(v - lag(v) over wx) as bx1, abs(lag(v) over wx - lag(v, 2) over wx) as bx2, abs(lead(v) over wx - v) as bx3 from g
  window wy as (partition by item, x order by y), wx as (partition by item, y order by x)),
ey as (select item, y // 8 as a, x // 8 as o, by1 as b, 0.5 * (by2 + by3) as i from d where y % 8 = 0 and y > 0), ex as (select item, x // 8 as a, y // 8 as o, bx1 as b, 0.5 * (bx2 + bx3) as i from d where x % 8 = 0 and x > 0),
sh as (select item, a - 1 as "by", o as bx, greatest(b - i, 0) / 16 as h from ey union all select item, a, o, greatest(b - i, 0) / 16 from ey
  union all select item, o, a - 1, greatest(b - i, 0) / 16 from ex union all select item, o, a, greatest(b - i, 0) / 16 from ex),
raw as (select item, "by", bx, 0.5 * sum(h) as raw from sh group by 1, 2, 3),
act as (select item, y // 8 as "by", x // 8 as bx, avg(case when x % 8 > 0 then bx1 end) + avg(case when y % 8 > 0 then by1 end) as activity from d group by 1, 2, 3)"""


@query("a27_block_boundary", f"""{EDGE_SQL} select act.item, act."by"::bigint as "by", act.bx::bigint as bx, round(activity + 1e-9, 4) as activity, round(coalesce(raw, 0) + 1e-9, 4) as raw,
  round(coalesce(raw, 0) / (1 + 0.15 * activity) + 1e-9, 4) as strength from act left join raw on act.item = raw.item and act."by" = raw."by" and act.bx = raw.bx""")
def block_boundary(spark, d):
    blocks, _ = G.boundary_discontinuity(grid(spark, d), "item", "x", "y", "v")
    return nudged(blocks)


@query("a27_boundary_ratio", f"""{EDGE_SQL}, ry as (select item, avg(b) as edge_y, avg(i) as inner_y from ey group by 1), rx as (select item, avg(b) as edge_x, avg(i) as inner_x from ex group by 1)
select item, round(edge_y, 4) as edge_y, round(inner_y, 4) as inner_y, round(edge_x, 4) as edge_x, round(inner_x, 4) as inner_x, round(edge_y / greatest(inner_y, 1e-6), 4) as ratio_y,
  round(edge_x / greatest(inner_x, 1e-6), 4) as ratio_x from ry join rx using (item)""")
def boundary_ratio(spark, d):
    _, totals = G.boundary_discontinuity(grid(spark, d), "item", "x", "y", "v")
    return rounded(totals, 4)


@query("a28_phase_profile", f"""with {GRID_SQL}, d as (select item, x, y, abs(v - lead(v) over (partition by item, x order by y)) as dy, abs(v - lead(v) over (partition by item, y order by x)) as dx from g),
er as (select item, y % 8 as dr, avg(dy) as e from d where dy is not null group by 1, 2), ec as (select item, x % 8 as dc, avg(dx) as e from d where dx is not null group by 1, 2),
ph as (select er.item, dr, dc, (er.e + ec.e) / 2 as energy from er join ec using (item)), md as (select item, median(energy) as m from ph group by 1),
c as (select item, dr, dc, energy / greatest(m, 0.001) as contrast from ph join md using (item))
select item, round(max(contrast) filter (where dr = 0 and dc = 0), 4) as aligned_contrast, (arg_max(dr, (contrast, -dr, -dc)) filter (where dr + dc > 0))::bigint as best_dr,
  (arg_max(dc, (contrast, -dr, -dc)) filter (where dr + dc > 0))::bigint as best_dc, round(max(contrast) filter (where dr + dc > 0), 4) as best_contrast, max(contrast) filter (where dr + dc > 0) >= 1.1 as has_traces from c group by 1""")
def phase_profile(spark, d):
    return rounded(G.phase_profile(grid(spark, d), "item", "x", "y", "v", threshold=1.1), 4)


DCT_SQL = f"""with {GRID_SQL}, bs as (select k, i, cos((2 * i + 1) * k * pi() / 16) * case when k = 0 then sqrt(1 / 8.0) else 0.5 end as c from range(0, 8) a(k), range(0, 8) b(i)),
ext as (select item, max(x) as mx, max(y) as my from g group by 1),
px as (select item, unnest(range(x, case when x = mx then x - x % 8 + 8 else x + 1 end)) as x, y, my, v from g join ext using (item)),
pg as (select item, x, unnest(range(y, case when y = my then y - y % 8 + 8 else y + 1 end)) as y, v from px),
t1 as (select pg.item, y // 8 as by, x // 8 as bx, k as u, x % 8 as xx, sum((v - 128) * c) as s from pg join bs on i = y % 8 group by 1, 2, 3, 4, 5),
cf as (select t1.item, t1.by, t1.bx, u, k as w, sum(s * c) as c from t1 join bs on i = xx group by 1, 2, 3, 4, 5)"""


@query("a29_block_cosine", f"""{DCT_SQL} select item, count(*) filter (where u = 0 and w = 0) as blocks, round(avg(c) filter (where u + w = 0), 4) as dc_mean, round(stddev_pop(c) filter (where u + w = 0), 4) as dc_std,
  round(min(c) filter (where u + w = 0), 5) as dc_min, round(max(c) filter (where u + w = 0), 5) as dc_max, round(median(c) filter (where u + w = 0), 6) as dc_median,
  round(avg(c) filter (where u + w > 0), 4) as ac_mean, round(stddev_pop(c) filter (where u + w > 0), 4) as ac_std, round(avg(abs(c)) filter (where u + w > 0), 4) as ac_mean_abs,
  round(avg(case when abs(c) < 0.1 then 1.0 else 0.0 end) filter (where u + w > 0), 4) as zero_share, round(avg(abs(c)) filter (where u < 3 and w < 3 and u + w > 0), 4) as low_energy,
  round(avg(abs(c)) filter (where not (u < 3 and w < 3) and u + w < 9), 4) as mid_energy, round(avg(abs(c)) filter (where u + w >= 9), 4) as high_energy from cf group by 1""")
def block_cosine(spark, d):
    out = G.cosine_summary(G.block_cosine(grid(spark, d), "item", "x", "y", "v"), "item")
    digits = {"dc_min": 5, "dc_max": 5, "dc_median": 6}  # sums of cents over eight: exact
    return out.select("item", "blocks", *[F.round(c, digits.get(c, 4)).alias(c) for c in out.columns if c not in ("item", "blocks")])


FREQS = [k / 96.0 for k in range(1, 49)]


@query("a30_series_spectrum", f"""with {SERIES_SQL}, f as (select unnest([{", ".join(repr(x) for x in FREQS)}]::double[]) as freq),
p as (select event_type, freq, sum(a * cos(-2 * pi() * freq * pos)) ** 2 + sum(a * sin(-2 * pi() * freq * pos)) ** 2 as power from s, f group by 1, 2), b as (select * from p where freq between 0.125 and 0.5)
select event_type, round(arg_max(freq, (power, -freq)), 6) as peak_freq, round(max(power), 2) as peak_power, round(median(power), 2) as median_power,
  round(max(power) / (median(power) + 1e-7), 4) as strength, round(1 / arg_max(freq, (power, -freq)), 4) as period from b group by 1""")
def series_spectrum(spark, d):
    """Hourly value sums; hours without events add nothing and are not generated."""
    e, _, _ = _buckets(spark, d, 3_600_000_000)
    sums = e.groupBy("event_type", "pos").agg(F.sum("value").alias("a"))
    out = G.spectral_peak(G.periodogram(sums, ["event_type"], "pos", "a", FREQS), ["event_type"], 0.125, 0.5)
    digits = {"peak_freq": 6, "peak_power": 2, "median_power": 2, "strength": 4, "period": 4}
    return out.select("event_type", *[F.round(c, n).alias(c) for c, n in digits.items()])


SPECTRUM_SQL = f"""with {GRID_SQL}, r1 as (select g.item, g.y, k.k as u, sum(v * cos(2 * pi() * k.k * x / n)) as re, -sum(v * sin(2 * pi() * k.k * x / n)) as im, max(n) as n from g, (select unnest(range(0, hi - lo + 1)) as k from bd) k group by 1, 2, 3),
f2 as (select item, k.k as w, u, max(n) as n, sum(re * cos(2 * pi() * k.k * y / 64) + im * sin(2 * pi() * k.k * y / 64)) as re, sum(im * cos(2 * pi() * k.k * y / 64) - re * sin(2 * pi() * k.k * y / 64)) as im from r1, range(0, 64) k(k) group by 1, 2, 3),
sp as (select item, (w + 32) % 64 as v, (u + n // 2) % n as u, n, re * re + im * im as power from f2)"""


def spectrum(spark, d):
    return G.spectrum(grid(spark, d), "item", "x", "y", "v")


@query("a31_radial_energy", f"""{SPECTRUM_SQL}, t as (select item, sum(power) as total from sp group by 1),
p as (select item, power / (total + 1e-12) as p, sqrt((u - n / 2.0) ** 2 + (v - 32) ** 2) / (sqrt((n / 2.0) ** 2 + 1024) + 1e-12) as r from sp join t using (item))
select item, round(sum(case when r <= 0.15 then p else 0 end), 6) as low, round(sum(case when r > 0.15 and r <= 0.5 then p else 0 end), 6) as mid, round(sum(case when r > 0.5 and r <= 1 then p else 0 end), 6) as high,
  round(-sum(case when p > 0 then p * log2(p) else 0 end), 6) as entropy from p group by 1""")
def radial_energy(spark, d):
    return rounded(G.radial_energy(spectrum(spark, d), "item"))


def suppressed_sql(candidates, score, extra=""):
    """The strongest place that is not within two cells of a kept one, twenty times over. `candidates` gives cd(item, x, y, score)."""
    return f"""{candidates},
kp(item, k, kept) as (select distinct item, 0, []::struct(x bigint, y bigint)[] from cd
  union all select kp.item, kp.k + 1, list_append(any_value(kp.kept), arg_max(struct_pack(x := cd.x::bigint, y := cd.y::bigint), (cd.{score}, -cd.y, -cd.x)))
  from kp join cd on cd.item = kp.item where kp.k < 20 and len(list_filter(kp.kept, lambda s: abs(s.x - cd.x) <= 2 and abs(s.y - cd.y) <= 2)) = 0 group by kp.item, kp.k),
wn as (select item, unnest(kept) as s, generate_subscripts(kept, 1)::integer as rank from (select item, arg_max(kept, k) as kept from kp group by 1))"""


_WIDE = ", ".join(repr(t) for t in G.gaussian_taps(21, 5.0))
PEAK_SQL = suppressed_sql(f"""with recursive {SPECTRUM_SQL.removeprefix('with ')}, tp as (select unnest(range(-10, 11)) as o, unnest([{_WIDE}]) as w),
lg as (select item, u, v, n, ln(1 + sqrt(power)) as l from sp),
bv as (select p.item, p.u, p.v, p.n, any_value(p.l) as l, sum(w * q.l) as b from lg p, tp, lg q where q.item = p.item and q.u = p.u and q.v = {reflect('p.v + o', '64')} group by 1, 2, 3, 4),
bu as (select p.item, p.u, p.v, p.n, any_value(p.l) as l, sum(w * q.b) as b from bv p, tp, bv q where q.item = p.item and q.v = p.v and q.u = {reflect('p.u + o', 'p.n')} group by 1, 2, 3, 4),
df as (select item, u, v, round(l - b, 9) as diff, l from bu where sqrt((u - n / 2.0) ** 2 + (v - 32) ** 2) / (sqrt((n / 2.0) ** 2 + 1024) + 1e-12) >= 0.03),
sg as (select item, avg(diff) as m, stddev_pop(diff) as s from df group by 1),
hi as (select df.item, u, v, diff, round(diff / (s + 1e-6), 6) as prominence from df join sg using (item) where diff >= m + 1.5 * s),
cd as (select item, u as x, v as y, prominence from hi where not exists (select 1 from hi o where o.item = hi.item and abs(o.u - hi.u) <= 2 and abs(o.v - hi.v) <= 2 and o.diff > hi.diff))""", "prominence")


@query("a31_spectrum_peaks", f"{PEAK_SQL} select cd.item, cd.x::bigint as u, cd.y::bigint as v, round(cd.prominence, 4) as prominence, wn.rank from wn join cd on cd.item = wn.item and cd.x = wn.s.x and cd.y = wn.s.y")
def spectrum_peaks(spark, d):
    return rounded(G.spectrum_peaks(spectrum(spark, d), "item", sigmas=1.5), 4)


_STRONG = f"with recursive {GRID_SQL}, sd as (select item, avg(v) as m, stddev_pop(v) as sd from g group by 1), cd as (select g.item, g.x, g.y, g.v from g join sd using (item) where g.v >= m + 3.0 * sd)"


@query("t04_suppressed_peaks", f"{suppressed_sql(_STRONG, 'v')} select cd.item, cd.x::bigint as x, cd.y::bigint as y, cd.v, wn.rank from wn join cd on cd.item = wn.item and cd.x = wn.s.x and cd.y = wn.s.y")
def suppressed_peaks(spark, d):
    """Strongest cells of every grid with nothing stronger within two cells."""
    g = grid(spark, d)
    stat = g.groupBy("item").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    strong = g.join(stat, "item").where(F.col("v") >= F.col("m") + 3.0 * F.col("sd"))
    return G.suppress(strong, ["item"], "x", "y", "v", radius=2, limit=20)
