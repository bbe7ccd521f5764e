"""Solar position by the published NOAA formulas, as staged native columns, and verdicts on claimed light.

The coefficients are fixed values of the NOAA solar calculator (Meeus,
Astronomical Algorithms, chapters 22 and 25).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clip1(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))


def with_sun_position(df: DataFrame, lat: str, lon: str, ts: str, zone: Column | None = None) -> DataFrame:
    """Add elevation, azimuth, shadow_azimuth, declination (degrees), eot (minutes) and shadow_ratio.

    Times are UTC, or local to `zone` (hours ahead of UTC). shadow_ratio is the
    length of a shadow over its object's height, 99 where the sun is lower
    than half a degree. Shared terms become columns of their own stage, so each is computed once
    instead of being repeated inside one huge expression.
    """
    sin, cos, rad, deg, c = F.sin, F.cos, F.radians, F.degrees, F.col
    when = c(ts) if zone is None else F.timestamp_micros(F.unix_micros(c(ts).cast("timestamp")) - F.round(zone * 3.6e9).cast("long"))
    out = df.withColumn("__when", when)
    when = c("__when")
    out = out.withColumn("__min", F.hour(when) * 60.0 + F.minute(when) + F.floor(F.second(when)) / 60.0)
    # Julian centuries since 2000; 2440587.5 is the Julian date of 1970-01-01
    julian = F.datediff(when, F.lit("1970-01-01").cast("date")) + 2440587.5 + c("__min") / 1440.0
    out = out.withColumn("__t", (julian - 2451545.0) / 36525.0)
    t = c("__t")
    out = out.withColumns({
        "__l0": F.pmod(280.46646 + t * (36000.76983 + 0.0003032 * t), F.lit(360.0)),
        "__m": rad(F.pmod(357.52911 + t * (35999.05029 - 0.0001537 * t), F.lit(360.0))),
        "__e": 0.016708634 - t * (0.000042037 + 0.0000001267 * t),
        "__node": rad(125.04 - 1934.136 * t),
    })
    m, e, node = c("__m"), c("__e"), c("__node")
    centre = (sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289)
    obliquity = 23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0 + 0.00256 * cos(node)
    out = out.withColumns({"__lon": rad(c("__l0") + centre - 0.00569 - 0.00478 * sin(node)), "__obl": rad(obliquity)})
    out = out.withColumns({"__dec": F.asin(sin("__obl") * sin("__lon")), "__y": F.pow(F.tan(c("__obl") / 2.0), 2), "__l": rad("__l0")})
    y, l0 = c("__y"), c("__l")
    out = out.withColumn("eot", 4.0 * deg(
        y * sin(2 * l0) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * l0) - 0.5 * y * y * sin(4 * l0) - 1.25 * e * e * sin(2 * m)))
    out = out.withColumn("__ha", F.pmod(c("__min") + c("eot") + 4.0 * c(lon), F.lit(1440.0)) / 4.0 - 180.0).withColumn("__lat", rad(lat))
    out = out.withColumn("__z", F.acos(_clip1(sin("__lat") * sin("__dec") + cos("__lat") * cos("__dec") * cos(rad("__ha")))))
    out = out.withColumn("__spread", cos("__lat") * sin("__z"))
    out = out.withColumn("__east", F.when(F.abs("__spread") > 0.0001, 180.0 - deg(F.acos(
        _clip1((sin("__lat") * cos("__z") - sin("__dec")) / c("__spread"))))))
    azimuth = (F.when(c("__east").isNull(), F.when(c(lat) > 0, 180.0).otherwise(0.0))
               .when(c("__ha") > 0, 360.0 - c("__east")).otherwise(c("__east")))
    out = out.withColumns({"elevation": 90.0 - deg("__z"), "azimuth": azimuth, "declination": deg("__dec")})
    out = out.withColumns({"shadow_azimuth": F.pmod(c("azimuth") + 180.0, F.lit(360.0)),
                           "shadow_ratio": F.when(c("elevation") > 0.5, 1.0 / F.tan(rad("elevation"))).otherwise(99.0)})
    return out.drop(*[n for n in out.columns if n.startswith("__")])


def with_lighting_verdict(df: DataFrame, divergent_share: str, light_deg: str | None = None, shadow_deg: str | None = None, tolerance: float = 45.0) -> DataFrame:
    """Add consistency, verdict, score and direction from the light in a scene and the sun at its claimed place and time.

    `df` carries elevation and shadow_azimuth (null where no place is known)
    and the share of patches whose light diverges from the scene's. Measured
    shadows are compared with the expected ones; without any, the mean light
    is, turned around. A claimed night in a lit scene outranks a wrong
    direction, and both outrank divergence inside the scene.
    """
    c = F.col
    share = F.coalesce(c(divergent_share), F.lit(0.0))
    light = F.pmod(c(light_deg) + 180.0, F.lit(360.0)) if light_deg else F.lit(None).cast("double")
    measured = F.coalesce(c(shadow_deg), light) if shadow_deg else light
    gap = F.abs(measured - c("shadow_azimuth"))
    gap = F.when(gap > 180.0, 360.0 - gap).otherwise(gap)
    out = df.withColumn("consistency", F.when(c("elevation").isNull(), F.lit(None)).when(c("elevation") < -1.0, "DAY_NIGHT_CONFLICT")
                        .when(gap > tolerance, "INCONSISTENT").otherwise("CONSISTENT"))
    against = c("consistency").isin("DAY_NIGHT_CONFLICT", "INCONSISTENT")
    score = F.least(F.lit(1.0), share * 1.5)
    out = out.withColumn("score", F.when(against, F.greatest(score, F.lit(0.75))).otherwise(score))
    verdict = (F.when(c("consistency") == "DAY_NIGHT_CONFLICT", "SOLAR_NIGHT_CONFLICT").when(c("consistency") == "INCONSISTENT", "SOLAR_ASTRONOMICAL_ANOMALY")
               .when(share > 0.40, "LIGHTING_DIRECTION_ANOMALY").when(share > 0.20, "MODERATE_LIGHTING_VARIANCE").otherwise("LIGHTING_PHYSICS_CONSISTENT"))
    return out.withColumns({"verdict": verdict, "direction": F.when(c("score") > 0.40, "anomalous").when(c("score") > 0.20, "elevated").otherwise("consistent")})
