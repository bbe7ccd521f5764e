"""Series and grids as long tables (keys, position, value): filters, blocks, transforms, spectra.

A filter needs neighbours. Rows are cut into chunks along the filtered axis and
each chunk gets copies of the few rows around it (and mirrored rows at the
ends), so one shuffle of barely more than the data serves any small kernel.
Positions must be dense: 0 .. length-1 for every key.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.joins import null_safe_join
from ..functions.vectors import each_with
from ..session import cut
from .skew import quantiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package


def gaussian_taps(size: int = 11, sigma: float = 1.5) -> list[float]:
    x = np.arange(size) - (size - 1) / 2.0
    k = np.exp(-(x ** 2) / (2.0 * sigma * sigma))
    return [float(v) for v in k / k.sum()]


def haloed(df: DataFrame, keys: Sequence[str], pos: str, length: Column, radius: int, border: str, chunk: int) -> DataFrame:
    """Add (__chunk, __at, __home): every chunk sees `radius` more positions on both sides.

    Ends: `reflect` mirrors without repeating the edge, `edge` repeats it, `none` adds nothing.
    """
    p = F.col(pos)
    spots = [p]
    if border == "reflect":
        spots += [F.when((p >= 1) & (p <= radius), -p), F.when((p < length - 1) & (p >= length - 1 - radius), 2 * (length - 1) - p)]
    elif border == "edge":
        spots += [F.when(p == 0, F.lit(-k)) for k in range(1, radius + 1)]
        spots += [F.when(p == length - 1, p + k) for k in range(1, radius + 1)]
    wide = df.select("*", F.explode(F.array_compact(F.array(*[s.cast("long") for s in spots]))).alias("__at"))
    last = F.floor((length - 1) / chunk)
    # virtual positions beyond the ends belong to the first and last chunk
    home = F.least(F.greatest(F.floor(F.col("__at") / chunk), F.lit(0)), last)
    low = F.least(F.greatest(F.floor((F.col("__at") - radius) / chunk), F.lit(0)), last)
    high = F.least(F.greatest(F.floor((F.col("__at") + radius) / chunk), F.lit(0)), last)
    return wide.withColumn("__home", (home == F.floor(p / chunk)) & (F.col("__at") == p)) \
        .withColumn("__hc", home).withColumn("__chunk", F.explode(F.sequence(low, high))) \
        .withColumn("__home", F.col("__home") & (F.col("__chunk") == F.col("__hc"))).drop("__hc")


def convolve(df: DataFrame, keys: Sequence[str], pos: str, length: Column, taps: Sequence[float], values: Mapping[str, str],
             border: str = "reflect", chunk: int = 4096) -> DataFrame:
    """Weighted sum of the 2r+1 neighbours along `pos` for each `new -> old` column."""
    radius = len(taps) // 2
    spread = haloed(df, keys, pos, length, radius, border, chunk)
    w = W.partitionBy(*keys, "__chunk").orderBy("__at")
    olds = list(dict.fromkeys(values.values()))
    row = F.struct(*olds)
    around = [F.lag(row, radius - i).over(w) if i < radius else row if i == radius else F.lead(row, i - radius).over(w)
              for i in range(len(taps))]
    out = spread.select("*", *[c.alias(f"__n{i}") for i, c in enumerate(around)]).where("__home")
    for new, old in values.items():
        terms = [F.coalesce(F.col(f"__n{i}.{old}"), F.lit(0.0)) * w_i for i, w_i in enumerate(taps)]
        out = out.withColumn(new, sum(terms[1:], terms[0]))
    return out.drop("__at", "__home", "__chunk", *[f"__n{i}" for i in range(len(taps))])


def local_median(df: DataFrame, keys: Sequence[str], pos: str, length: Column, radius: int, value: str, new: str,
                 border: str = "reflect", chunk: int = 4096) -> DataFrame:
    """Median of the 2r+1 neighbours along `pos`."""
    spread = haloed(df, keys, pos, length, radius, border, chunk)
    w = W.partitionBy(*keys, "__chunk").orderBy("__at").rowsBetween(-radius, radius)
    around = F.array_sort(F.collect_list(value).over(w))
    return spread.withColumn("__w", around).where("__home").withColumn(new, array_median(F.col("__w"))) \
        .drop("__at", "__home", "__chunk", "__w")


def array_median(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    low = F.element_at(sorted_values, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(sorted_values, (F.floor(n / 2) + 1).cast("int"))
    return (low + high) / 2.0


def lag_products(df: DataFrame, keys: Sequence[str], pos: str, length: Column, value: str, lags: int, chunk: int = 4096) -> DataFrame:
    """Sum of v[t] * v[t+k] per key for k = 0 .. lags-1: (keys, lag, product)."""
    spread = haloed(df, keys, pos, length, lags - 1, "none", chunk)
    w = W.partitionBy(*keys, "__chunk").orderBy("__at")
    parts = [F.col(value) * (F.lead(value, k).over(w) if k else F.col(value)) for k in range(lags)]
    sums = spread.select(*keys, "__home", *[p.alias(f"__p{k}") for k, p in enumerate(parts)]).where("__home") \
        .groupBy(*keys).agg(*[F.sum(f"__p{k}").alias(f"__p{k}") for k in range(lags)])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.coalesce(F.col(f"__p{k}"), F.lit(0.0)).alias("product")) for k in range(lags)])
    return sums.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def ssim_map(mu_a: Column, mu_b: Column, aa: Column, bb: Column, ab: Column, data_range: float) -> Column:
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    va = F.greatest(aa - mu_a * mu_a, F.lit(0.0))
    vb = F.greatest(bb - mu_b * mu_b, F.lit(0.0))
    cov = ab - mu_a * mu_b
    return ((2.0 * mu_a * mu_b + c1) * (2.0 * cov + c2)) / ((mu_a * mu_a + mu_b * mu_b + c1) * (va + vb + c2))


def ssim(df: DataFrame, keys: Sequence[str], axes: Sequence[tuple[str, Column]], a: str, b: str, data_range: float = 255.0,
         chunk: int = 4096) -> DataFrame:
    """Mean structural similarity of two versions per key, over one axis or two.

    `axes`: (position column, length). The Gaussian window is separable, so
    every axis is one pass over local sums of a, b, aa, bb and ab.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    cols = {"__a": x, "__b": y, "__aa": x * x, "__bb": y * y, "__ab": x * y}
    lengths = [f"__len{i}" for i in range(len(axes))]
    out = df.select(*keys, *[p for p, _ in axes], *[n.alias(lengths[i]) for i, (_, n) in enumerate(axes)], *[c.alias(n) for n, c in cols.items()])
    taps = gaussian_taps()
    for i, (p, _) in enumerate(axes):
        others = [q for q, _ in axes if q != p]
        out = convolve(out, [*keys, *others], p, F.col(lengths[i]), taps, {n: n for n in cols}, "reflect", chunk)
    score = ssim_map(F.col("__a"), F.col("__b"), F.col("__aa"), F.col("__bb"), F.col("__ab"), data_range)
    return out.groupBy(*keys).agg(F.avg(score).alias("ssim"))


# ---- blocks ---------------------------------------------------------------

def grid_blocks(df: DataFrame, item: str, x: str, y: str, v: str, size: int, stride: int | None = None) -> DataFrame:
    """mean, var, median, mad, mean-abs of every block; overlapping when stride < size.

    A block holds at most size*size cells, so its values fit in one small array.
    """
    stride = stride or size

    def homes(c: str) -> Column:
        first = F.greatest(F.ceil((F.col(c) - size + 1) / stride), F.lit(0))
        return F.sequence(first, F.floor(F.col(c) / stride))
    if stride == size:
        placed = df.withColumn("bx", F.floor(F.col(x) / size)).withColumn("by", F.floor(F.col(y) / size))
    else:
        placed = df.withColumn("bx", F.explode(homes(x))).withColumn("by", F.explode(homes(y)))
    blocks = placed.groupBy(item, "by", "bx").agg(
        F.count(F.lit(1)).alias("cells"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.avg(F.abs(v)).alias("mean_abs"),
        F.array_sort(F.collect_list(v)).alias("__vs"))
    out = blocks.withColumn("median", array_median(F.col("__vs")))
    dev = F.array_sort(each_with(F.col("__vs"), F.col("median"), lambda e, m: F.abs(e - m)))
    return out.withColumn("__dv", dev).withColumn("mad", array_median(F.col("__dv"))).drop("__vs", "__dv")


def beside(df: DataFrame, item: str, axis: str, other: str, v: str, chunk: int = 4096) -> DataFrame:
    """Add __prev2, __prev, __next: the values before and after each cell along `axis`, null beyond the ends.

    Lines are worked on in chunks that see two cells more on both sides, so a long line is not one task.
    """
    last = df.groupBy(item).agg(F.max(axis).alias("__last"))
    sized = null_safe_join(df.select(item, axis, other, v), last, [item])
    spread = haloed(sized, [item, other], axis, F.col("__last") + 1, 2, "none", chunk)
    w = W.partitionBy(item, other, "__chunk").orderBy("__at")
    found = spread.select("*", F.lag(v, 2).over(w).alias("__prev2"), F.lag(v).over(w).alias("__prev"), F.lead(v).over(w).alias("__next"))
    return found.where("__home").drop("__at", "__home", "__chunk", "__last")


def boundary_discontinuity(df: DataFrame, item: str, x: str, y: str, v: str, size: int = 8) -> tuple[DataFrame, DataFrame]:
    """Block map and per-item ratios of steps on block borders against steps inside.

    All cells count, those of incomplete blocks at the right and lower border too.
    """
    cells, totals = None, None
    for axis, other in ((y, x), (x, y)):
        steps = beside(df, item, axis, other, v).select(item, x, y, F.col(axis).alias("__p"), F.abs(F.col(v) - F.col("__prev")).alias("__b"),
                                                        F.abs(F.col("__prev") - F.col("__prev2")).alias("__i1"), F.abs(F.col("__next") - F.col(v)).alias("__i2"))
        edge = steps.where((F.col("__p") % size == 0) & (F.col("__p") > 0)).withColumn("__in", 0.5 * (F.col("__i1") + F.col("__i2")))
        half = F.greatest(F.col("__b") - F.col("__in"), F.lit(0.0)) * 0.5 / size
        axis_block = F.floor(F.col("__p") / size)
        shares = edge.select(item, half.alias("half"), F.floor(F.col(other) / size).alias("__o"), F.explode(F.array(axis_block - 1, axis_block)).alias("__a"))
        named = shares.select(item, "half", *([F.col("__a").alias("by"), F.col("__o").alias("bx")] if axis == y else [F.col("__o").alias("by"), F.col("__a").alias("bx")]))
        cells = named if cells is None else cells.unionByName(named)
        ratio = edge.groupBy(item).agg(F.avg("__b").alias(f"edge_{axis}"), F.avg("__in").alias(f"inner_{axis}"))
        totals = ratio if totals is None else totals.join(ratio, item)
    block = [F.floor(F.col(y) / size).alias("by"), F.floor(F.col(x) / size).alias("bx")]
    sides = {c: beside(df, item, at, other, v).where(F.col(at) % size > 0).groupBy(item, *block).agg(F.avg(F.abs(F.col(v) - F.col("__prev"))).alias(c))
             for c, at, other in (("dx", x, y), ("dy", y, x))}
    activity = null_safe_join(sides["dx"], sides["dy"], [item, "by", "bx"]).select(item, "by", "bx", (F.col("dx") + F.col("dy")).alias("activity"))
    raw = cells.groupBy(item, "by", "bx").agg((0.5 * F.sum("half")).alias("raw"))
    blocks = activity.join(raw, [item, "by", "bx"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0))) \
        .withColumn("strength", F.col("raw") / (1.0 + 0.15 * F.col("activity")))
    for axis in (y, x):
        totals = totals.withColumn(f"ratio_{axis}", F.col(f"edge_{axis}") / F.greatest(F.col(f"inner_{axis}"), F.lit(1e-6)))
    return blocks, totals


def phase_profile(df: DataFrame, item: str, x: str, y: str, v: str, period: int = 8, threshold: float = 1.35) -> DataFrame:
    """Which (row, column) phase carries the strongest steps, the aligned phase aside."""
    step = F.abs(F.col(v) - F.col("__next"))
    rows = beside(df, item, y, x, v).where(step.isNotNull()).groupBy(item, (F.col(y) % period).alias("dr")).agg(F.avg(step).alias("e_row"))
    cols = beside(df, item, x, y, v).where(step.isNotNull()).groupBy(item, (F.col(x) % period).alias("dc")).agg(F.avg(step).alias("e_col"))
    # period * period rows per item
    phases = rows.join(cols, item).withColumn("energy", (F.col("e_row") + F.col("e_col")) / 2.0)
    base = phases.groupBy(item).agg(F.percentile("energy", 0.5).alias("median"))
    c = phases.join(base, item).withColumn("contrast", F.col("energy") / F.greatest(F.col("median"), F.lit(0.001)))
    free = (F.col("dr") != 0) | (F.col("dc") != 0)
    best = c.groupBy(item).agg(
        F.max(F.when(~free, F.col("contrast"))).alias("aligned_contrast"),
        F.max_by(F.struct("dr", "dc", "contrast"), F.when(free, F.struct(F.col("contrast"), -F.col("dr"), -F.col("dc")))).alias("b"))
    return best.select(item, "aligned_contrast", F.col("b.dr").alias("best_dr"), F.col("b.dc").alias("best_dc"), F.col("b.contrast").alias("best_contrast"),
                       (F.col("b.contrast") >= threshold).alias("has_traces"))


def _tiles(df: DataFrame, item: str, x: str, y: str, v: str, size: int) -> DataFrame:
    """size x size tiles as row-major arrays over the whole grid; beyond the right and lower border the edge value repeats."""
    last = df.groupBy(item).agg(F.max(x).alias("__x"), F.max(y).alias("__y"))
    cells = null_safe_join(df.select(item, F.col(x).alias("__cx"), F.col(y).alias("__cy"), F.col(v).cast("double").alias("__v")), last, [item])

    def reach(at: str, end: str) -> Column:
        """How far a cell's value reaches: its own place, or to the end of its tile where it is the last one."""
        return F.when(F.col(at) == F.col(end), F.col(at) - F.col(at) % size + size - 1).otherwise(F.col(at))

    spread = cells.withColumn("__px", F.explode(F.sequence("__cx", reach("__cx", "__x")))).withColumn("__py", F.explode(F.sequence("__cy", reach("__cy", "__y"))))
    return spread.groupBy(item, F.floor(F.col("__py") / size).alias("by"), F.floor(F.col("__px") / size).alias("bx")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("__py") % size * size + F.col("__px") % size).alias("i"), F.col("__v").alias("v")))).alias("c")) \
        .select(item, "by", "bx", F.col("c.v").alias("tile"))  # size * size values


def cosine_basis(n: int = 8) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.cos((2 * i + 1) * k * np.pi / (2 * n)) * np.sqrt(2.0 / n)
    basis[0] /= np.sqrt(2.0)
    return basis


def block_cosine(df: DataFrame, item: str, x: str, y: str, v: str, size: int = 8, shift: float = 128.0) -> DataFrame:
    """Orthonormal cosine transform of every block, border blocks edge-padded: (item, by, bx, coef array, row-major)."""
    b = cosine_basis(size)
    both = np.kron(b, b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not pdf.empty:
                t = np.array(pdf["tile"].tolist()) - shift
                yield pdf.drop(columns=["tile"]).assign(coef=list(t @ both.T))

    tiles = _tiles(df, item, x, y, v, size)
    kind = tiles.schema[item].dataType.simpleString()
    return tiles.mapInPandas(run, f"{item} {kind}, by long, bx long, coef array<double>")


def cosine_summary(coefs: DataFrame, item: str, size: int = 8) -> DataFrame:
    """DC and AC statistics, near-zero share and mean |coefficient| of the low, middle and high bands."""
    u = F.floor(F.col("pos") / size)
    w = F.col("pos") % size
    low = (u < 3) & (w < 3) & (F.col("pos") > 0)
    high = (u + w) >= 9
    flat = coefs.select(item, F.posexplode("coef").alias("pos", "c"))
    ac = F.when(F.col("pos") > 0, F.col("c"))
    dc = F.when(F.col("pos") == 0, F.col("c"))
    mag = F.abs(F.col("c"))
    moments = flat.groupBy(item).agg(
        F.count_if(F.col("pos") == 0).alias("blocks"), F.avg(dc).alias("dc_mean"), F.stddev_pop(dc).alias("dc_std"), F.min(dc).alias("dc_min"), F.max(dc).alias("dc_max"),
        F.avg(ac).alias("ac_mean"), F.stddev_pop(ac).alias("ac_std"),
        F.avg(F.abs(ac)).alias("ac_mean_abs"), F.avg((F.abs(ac) < 0.1).cast("double")).alias("zero_share"),
        F.avg(F.when(low, mag)).alias("low_energy"), F.avg(F.when(~low & ~high & (F.col("pos") > 0), mag)).alias("mid_energy"),
        F.avg(F.when(high, mag)).alias("high_energy"))
    middle = quantiles(coefs.select(item, F.col("coef")[0].alias("__dc")), [item], "__dc", {"dc_median": 0.5})
    return null_safe_join(moments, middle, [item], "left")


def periodogram(df: DataFrame, keys: Sequence[str], t: str, v: str, freqs: Sequence[float]) -> DataFrame:
    """Power at chosen frequencies. Zero values add nothing, so sparse series stay sparse."""
    angle = -2.0 * np.pi * F.col("freq") * F.col(t)
    spread = df.select(*keys, t, v, F.explode(F.array(*[F.lit(float(f)) for f in freqs])).alias("freq"))
    sums = spread.groupBy(*keys, "freq").agg(F.sum(F.col(v) * F.cos(angle)).alias("re"), F.sum(F.col(v) * F.sin(angle)).alias("im"))
    return sums.select(*keys, "freq", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def spectral_peak(power: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    """Strongest frequency in a band, its strength over the band's median, its period."""
    band = power.where((F.col("freq") >= low) & (F.col("freq") <= high))
    p = band.groupBy(*keys).agg(
        F.max_by("freq", F.struct(F.col("power"), -F.col("freq"))).alias("peak_freq"), F.max("power").alias("peak_power"),
        F.percentile("power", 0.5).alias("median_power"))  # one value per listed frequency
    return p.withColumn("strength", F.col("peak_power") / (F.col("median_power") + 1e-7)).withColumn("period", 1.0 / F.col("peak_freq"))


def spectrum(df: DataFrame, item: str, x: str, y: str, v: str) -> DataFrame:
    """Centred 2-D Fourier magnitude of every whole grid: (item, v, u, height, width, mag).

    A row pass, then a column pass; a task holds grid lines, never a grid.
    Positions must be dense. Nothing is subtracted first, so the centre holds the sum.
    """
    def lines(across: str, along: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    values = np.array([complex(c["re"], c["im"]) for c in row.line])
                    f = np.fft.fft(values)
                    yield pd.DataFrame({"item": row.item, across: getattr(row, across), along: np.arange(len(f)), "re": f.real, "im": f.imag})
        return run

    kind = df.schema[item].dataType.simpleString()
    cell = lambda at, re, im: F.array_sort(F.collect_list(F.struct(F.col(at).cast("long").alias("at"), re.alias("re"), im.alias("im")))).alias("line")
    rows = df.groupBy(F.col(item).alias("item"), F.col(y).cast("long").alias("y")).agg(cell(x, F.col(v).cast("double"), F.lit(0.0))) \
        .mapInPandas(lines("y", "u"), f"item {kind}, y long, u long, re double, im double")
    both = rows.groupBy("item", "u").agg(cell("y", F.col("re"), F.col("im"))).mapInPandas(lines("u", "v"), f"item {kind}, u long, v long, re double, im double")
    size = df.groupBy(F.col(item).alias("item")).agg((F.max(y) + 1).cast("long").alias("height"), (F.max(x) + 1).cast("long").alias("width"))
    placed = null_safe_join(both, size, ["item"])
    middle = lambda at, n: (F.col(at) + F.floor(F.col(n) / 2)) % F.col(n)
    return placed.select(F.col("item").alias(item), middle("v", "height").alias("v"), middle("u", "width").alias("u"), "height", "width",
                         F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("mag"))


def _radius() -> Column:
    """Distance from the spectrum's centre, 1 at a corner."""
    cy, cx = F.col("height") / 2.0, F.col("width") / 2.0
    return F.sqrt((F.col("u") - cx) * (F.col("u") - cx) + (F.col("v") - cy) * (F.col("v") - cy)) / (F.sqrt(cx * cx + cy * cy) + 1e-12)


def radial_energy(spec: DataFrame, item: str) -> DataFrame:
    """Energy shares of three radial bands and the spectral entropy of every grid."""
    power, r = F.col("mag") * F.col("mag"), _radius()
    total = spec.groupBy(item).agg(F.sum(power).alias("__t"))
    p = power / (F.col("__t") + 1e-12)
    share = lambda cond: F.sum(F.when(cond, p).otherwise(0.0))
    return null_safe_join(spec, total, [item]).groupBy(item).agg(
        share(r <= 0.15).alias("low"), share((r > 0.15) & (r <= 0.5)).alias("mid"), share((r > 0.5) & (r <= 1.0)).alias("high"),
        (-F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))).alias("entropy"))


def spectrum_peaks(spec: DataFrame, item: str, sigmas: float = 3.0, limit: int = 20) -> DataFrame:
    """Periodic peaks: log magnitude over its blurred background, 5 x 5 maxima at mean + `sigmas` deviations, strongest first."""
    taps = gaussian_taps(21, 5.0)
    level = spec.withColumn("__l", F.log1p("mag")).withColumn("__b", F.log1p("mag"))
    for pos, other, n in (("v", "u", "height"), ("u", "v", "width")):
        level = convolve(level, [item, other], pos, F.col(n), taps, {"__b": "__b"}, "reflect")
    far = _radius() >= 0.03
    # a real grid's spectrum is the same at opposite places: rounding makes that exact, so that ties fall by position
    diff = level.withColumn("diff", F.when(far, F.round(F.col("__l") - F.col("__b"), 9)).otherwise(0.0)).withColumn("far", far)
    diff = cut(diff.select(item, "v", "u", "mag", "diff", "far"))
    stat = diff.where("far").groupBy(item).agg(F.avg("diff").alias("__m"), F.stddev_pop("diff").alias("__s"))
    high = cut(null_safe_join(diff, stat, [item]).where((F.col("diff") >= F.col("__m") + sigmas * F.col("__s")) & F.col("far"))
               .withColumn("prominence", F.round(F.col("diff") / (F.col("__s") + 1e-6), 6)))
    # a stronger cell within two places is itself over the threshold, so maxima are found among the candidates
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if i or j])
    around = high.select(item, "v", "u", "diff", F.explode(near).alias("o")).select(
        item, F.col("v").alias("__v"), F.col("u").alias("__u"), (F.col("v") + F.col("o.i")).alias("v"), (F.col("u") + F.col("o.j")).alias("u"), F.col("diff").alias("__d"))
    beaten = around.join(high.select(item, "v", "u", "diff"), [item, "v", "u"]).where("diff > __d").select(item, F.col("__v").alias("v"), F.col("__u").alias("u"))
    return suppress(high.join(beaten, [item, "v", "u"], "left_anti"), [item], "u", "v", "prominence", radius=2, limit=limit)


def suppress(candidates: DataFrame, keys: Sequence[str], x: str, y: str, score: str, radius: int = 2, limit: int = 20) -> DataFrame:
    """Non-maximum suppression per key: strongest first, nothing within `radius` of a kept one, at most `limit`.

    The greedy order is resolved in parallel rounds: whatever nothing stronger
    overlaps is kept, what it overlaps is dropped, the rest goes on. Rows meet
    in cells, never key-wide, and the outcome equals the one-by-one loop.
    """
    rest = cut(candidates.select(*keys, x, y, score).distinct())
    kept = None
    side = radius + 1
    spot = F.struct(F.col(score), -F.col(y), -F.col(x))

    def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
        """Left rows with a right row within the radius, as (keys, x, y, own, other)."""
        near = F.array(F.lit(-1), F.lit(0), F.lit(1))
        a = left.select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"), spot.alias("__own"), F.explode(near).alias("__i"), F.lit(0).alias("__z")) \
            .withColumn("__j", F.explode(near)).withColumn("__cx", F.floor(F.col("__x") / side) + F.col("__i")) \
            .withColumn("__cy", F.floor(F.col("__y") / side) + F.col("__j"))
        b = right.select(*keys, F.col(x).alias("__x2"), F.col(y).alias("__y2"), spot.alias("__other"),
                         F.floor(F.col(x) / side).alias("__cx"), F.floor(F.col(y) / side).alias("__cy"))
        return a.join(b, [*keys, "__cx", "__cy"]).where(
            (F.abs(F.col("__x") - F.col("__x2")) <= radius) & (F.abs(F.col("__y") - F.col("__y2")) <= radius))

    while not rest.isEmpty():
        beaten = overlapping(rest, rest).where(F.col("__other") > F.col("__own")).select(*keys, F.col("__x").alias(x), F.col("__y").alias(y)).distinct()
        winners = cut(rest.join(beaten, [*keys, x, y], "left_anti"))
        gone = overlapping(rest, winners).select(*keys, F.col("__x").alias(x), F.col("__y").alias(y)).distinct()
        rest = cut(rest.join(gone, [*keys, x, y], "left_anti"))
        kept = winners if kept is None else kept.unionByName(winners)
    if kept is None:
        return rest
    w = W.partitionBy(*keys).orderBy(F.desc(score), y, x)
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
