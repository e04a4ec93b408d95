"""Geometry columns and comparisons of observed lines."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.ellipsoid import GRS80, Ellipsoid, geocentric, with_geodetic
from cairn.operators.crs import projection_bearing
from cairn.operators.observe import arc_factor, calculate


def line_geometry(df: DataFrame, ell: Ellipsoid = GRS80, projection=None) -> DataFrame:
    """Slope and arc distance, azimuth, projection azimuth and height difference of each line, mark to mark."""
    plain = df.withColumns({"from_hgt": F.lit(0.0), "to_hgt": F.lit(0.0)})

    def value(kind: str, name: str) -> DataFrame:
        return calculate(out.withColumn("obs_type", F.lit(kind)), ell).withColumnRenamed("calc", name)

    out = plain
    keep = list(df.columns)
    for kind, name in (("SD", "slope_distance"), ("ED", "arc_distance"), ("AZ", "azimuth"), ("LV", "height_difference")):
        done = [c for c in out.columns if c in ("slope_distance", "arc_distance", "azimuth")]
        out = value(kind, name).select(*[c for c in plain.columns if c not in ("obs_type",)], *done, name)
    if projection is not None:
        out = projection_bearing(out, projection, out="projection_azimuth")
    extra = ["slope_distance", "arc_distance", "azimuth", "height_difference"] + (["projection_azimuth"] if projection else [])
    return out.select(*[c for c in keep if c in out.columns and c not in ("from_hgt", "to_hgt", "obs_type")], *extra)


def _ratio(part: Column) -> Column:
    """One in how many; parts below a millionth show as the largest."""
    return F.when(part < 1.0e-6, 999999.0).otherwise(1.0 / part)


def baseline_comparison(df: DataFrame, projection, ell: Ellipsoid = GRS80) -> DataFrame:
    """Observed against calculated baselines: ellipsoidal distance, grid bearing and horizontal vector error.

    The observed vector is laid symmetrically about the middle of the line, so its ends fall beside the marks.
    ``df`` has ``f_*``/``t_*`` positions in radians and ``vec``.
    """
    f = geocentric(F.col("f_lon"), F.col("f_lat"), F.col("f_ohgt") + F.col("f_und"), ell)
    t = geocentric(F.col("t_lon"), F.col("t_lat"), F.col("t_ohgt") + F.col("t_und"), ell)
    out = df
    for i, a in enumerate("xyz"):
        half = F.element_at("vec", i + 1) / 2.0
        out = out.withColumns({f"_p{a}": (f[i] + t[i]) / 2.0 - half, f"_q{a}": (f[i] + t[i]) / 2.0 + half})
    out = with_geodetic(out, "_px", "_py", "_pz", ell, ("_plon", "_plat", "_ph"))
    out = with_geodetic(out, "_qx", "_qy", "_qz", ell, ("_qlon", "_qlat", "_qh"))
    out = projection_bearing(out, projection, ("_plon", "_plat", "_qlon", "_qlat"), "_ob")
    out = projection_bearing(out, projection, out="_cb")

    def between(lon1, lat1, lon2, lat2) -> Column:
        zero = F.lit(0.0)
        a, b = geocentric(lon1, lat1, zero, ell), geocentric(lon2, lat2, zero, ell)
        return F.sqrt(sum(((p - q) ** 2 for p, q in zip(a, b)), F.lit(0.0)))

    cosv = F.sin("f_lat") * F.sin("t_lat") + F.cos("f_lat") * F.cos("t_lat") * F.cos(F.col("f_lon") - F.col("t_lon"))
    c = F.col
    out = out.withColumns(
        {
            "obs_distance": between(c("_plon"), c("_plat"), c("_qlon"), c("_qlat")) * arc_factor(cosv),
            "calc_distance": between(c("f_lon"), c("f_lat"), c("t_lon"), c("t_lat")) * arc_factor(cosv),
            "vector_error": 2.0 * between(c("_plon"), c("_plat"), c("f_lon"), c("f_lat")),
        }
    )
    turn = F.degrees(c("_cb") - c("_ob"))
    turn = (turn - 360.0 * F.round(turn / 360.0)) * 3600.0
    out = out.withColumns({"distance_error": c("calc_distance") - c("obs_distance"), "bearing_error": turn})
    dist_part = F.abs(c("distance_error") / c("obs_distance"))
    brng_part = F.abs(F.radians(c("bearing_error") / 3600.0))
    vec_part = F.abs(c("vector_error") / c("obs_distance"))
    return out.select(
        *df.columns, "obs_distance", "calc_distance", "distance_error",
        F.degrees("_ob").alias("obs_bearing"), F.degrees("_cb").alias("calc_bearing"), "bearing_error", "vector_error",
        (dist_part * 1.0e6).alias("distance_ppm"), _ratio(dist_part).alias("distance_ratio"),
        (brng_part * 1.0e6).alias("bearing_ppm"), _ratio(brng_part).alias("bearing_ratio"),
        (vec_part * 1.0e6).alias("vector_ppm"), _ratio(vec_part).alias("vector_ratio"),
    )


