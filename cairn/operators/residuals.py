"""Residuals and the statistics that follow an adjustment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import probability as P
from cairn.functions.ellipsoid import LOWER, enu_axes, rotate_covariance, to_enu

# A residual whose own error is below this share of the observation's has no meaningful ratio.
CERTAIN = 1.0e-4
# Square metres below which a direction of a residual covariance counts as fixed.
NIL_VARIANCE = 1.0e-10


def residual_rows(equations: DataFrame, solution: DataFrame, inverse: DataFrame | None = None) -> DataFrame:
    """Residual, its error and the standardised residual of each equation.

    ``equations`` need a unique ``obs_key, component``. A row's variance of the calculated value is the double
    sum of its coefficients over the inverse cells its own parameters pair up; those cells are always
    stored ones, so two joins by key give it without any full matrix.
    """
    key = ["obs_key", "component"]
    # The outer form keeps the planner from copying the design's arithmetic into a filter on its size.
    terms = equations.select(*key, F.explode_outer("design").alias("t")).select(*key, "t.param", "t.coef")
    moved = terms.join(solution.select("param", "x"), "param").groupBy(*key).agg(
        F.sum(F.col("coef") * F.col("x")).alias("_shift")
    )
    out = equations.join(moved, key, "left").withColumn(
        "residual", F.col("misclosure") - F.coalesce("_shift", F.lit(0.0))
    )
    error = 1.0 / F.sqrt("weight")
    if inverse is None:
        return out.drop("_shift").withColumn("error", error)
    pairs = equations.select(
        *key,
        F.inline_outer(
            F.flatten(
                F.transform(
                    "design",
                    lambda a: F.transform(
                        F.filter("design", lambda b: b["param"] <= a["param"]),
                        lambda b: F.struct(
                            a["param"].alias("row"),
                            b["param"].alias("col"),
                            (a["coef"] * b["coef"] * F.when(a["param"] == b["param"], 1.0).otherwise(2.0)).alias("c"),
                        ),
                    ),
                )
            )
        ),
    )
    var = pairs.join(inverse, ["row", "col"]).groupBy(*key).agg(F.sum(F.col("c") * F.col("value")).alias("_cv"))
    out = out.join(var, key, "left").withColumns(
        {"error": error, "calc_error": F.sqrt(F.greatest(F.lit(0.0), F.coalesce("_cv", F.lit(0.0))))}
    )
    own = F.col("error") ** 2
    sign = F.when(F.col("used"), -1.0).otherwise(1.0)
    out = out.withColumn("res_error", F.sqrt(F.greatest(F.lit(0.0), own + sign * F.col("calc_error") ** 2)))
    sres = F.when(F.col("res_error") >= CERTAIN * F.col("error"), F.abs("residual") / F.col("res_error"))
    return out.withColumn("sres", sres).drop("_shift", "_cv")


def vector_sres(df: DataFrame, res: str = "res_vec", cov: str = "res_cov") -> DataFrame:
    """Standardised length ``sqrt(v' C^-1 v / rank)`` of a residual vector and the rank of its covariance.

    A pivot below ``NIL_VARIANCE`` drops its direction, as happens for a baseline the network fixes in one direction.
    """
    v = [F.element_at(res, i + 1) for i in range(3)]
    c = {ij: F.element_at(cov, k + 1) for k, ij in enumerate(LOWER)}
    out = df.withColumns({"_on1": c[0, 0] >= NIL_VARIANCE, "_p1": c[0, 0]})
    out = out.withColumns(
        {
            "_l21": F.when(F.col("_on1"), c[1, 0] / F.col("_p1")).otherwise(0.0),
            "_l31": F.when(F.col("_on1"), c[2, 0] / F.col("_p1")).otherwise(0.0),
        }
    )
    out = out.withColumn("_p2", c[1, 1] - F.col("_l21") * c[1, 0])
    out = out.withColumn("_on2", F.col("_p2") >= NIL_VARIANCE)
    out = out.withColumn("_c32", c[2, 1] - F.col("_l31") * c[1, 0])
    out = out.withColumn("_l32", F.when(F.col("_on2"), F.col("_c32") / F.col("_p2")).otherwise(0.0))
    out = out.withColumn("_p3", c[2, 2] - F.col("_l31") * c[2, 0] - F.col("_l32") * F.col("_c32"))
    out = out.withColumn("_on3", F.col("_p3") >= NIL_VARIANCE)
    out = out.withColumn("_y2", v[1] - F.col("_l21") * v[0])
    out = out.withColumn("_y3", v[2] - F.col("_l31") * v[0] - F.col("_l32") * F.col("_y2"))
    part = lambda on, y, p: F.when(F.col(on), y * y / F.col(p)).otherwise(0.0)
    total = part("_on1", v[0], "_p1") + part("_on2", F.col("_y2"), "_p2") + part("_on3", F.col("_y3"), "_p3")
    rank = F.col("_on1").cast("int") + F.col("_on2").cast("int") + F.col("_on3").cast("int")
    scratch = ["_on1", "_on2", "_on3", "_p1", "_p2", "_p3", "_l21", "_l31", "_l32", "_c32", "_y2", "_y3"]
    return out.withColumn("rank", rank).withColumn(
        "sres", F.when(F.col("rank") > 0, F.sqrt(total / F.col("rank")))
    ).drop(*scratch)


def redundancy(res_error: Column, error: Column) -> Column:
    return F.when(error > 0, res_error / error)


def mde_level(significance: float, power: float, aposteriori: bool = False, dof: int = 0) -> float:
    """Multiple of sigma at which an error is found: percentages in, a-priori normal or a-posteriori tau."""
    tail = 1.0 - (1.0 - significance / 100.0) / 2.0
    if aposteriori and dof > 1:
        return P.tau_quantile(tail, dof) + P.t_quantile(power / 100.0, dof)
    return P.normal_quantile(tail) + P.normal_quantile(power / 100.0)


def minimum_detectable(error: Column, res_error: Column, level: float, seu: float = 1.0) -> Column:
    """Smallest error in the observation that the residual test would find; NULL without redundancy."""
    return F.when(res_error > CERTAIN * error, F.lit(level * seu) * error * error / res_error)


def residual_significance(df: DataFrame, dof: int = 0, seu: float = 1.0, aposteriori: bool = False) -> DataFrame:
    """Percentage ``significance``: how likely a smaller standardised residual is.

    A-priori residuals squared times rank follow chi-square. A-posteriori unused ones follow F; used ones
    are first transformed because they took part in the estimate they are tested against.
    """

    @F.pandas_udf("double")
    def level(sres: pd.Series, rank: pd.Series, used: pd.Series) -> pd.Series:
        s = sres.to_numpy(dtype=float)
        k = np.maximum(rank.to_numpy(dtype=float), 1.0)
        square = s * s * k
        if not aposteriori or dof <= 0:
            p = P.chi2_cdf(square, k)
        else:
            left = np.maximum(dof - k, 1.0)
            ratio = square / seu**2
            inside = np.maximum(dof - ratio, 1e-12)
            f_used = ratio / k * left / inside
            p = np.where(used.to_numpy(dtype=bool), P.f_cdf(f_used, k, left), P.f_cdf(ratio / k, k, float(dof)))
        return pd.Series(np.where(np.isnan(s), np.nan, 100.0 * p))

    return df.withColumn("significance", F.when(F.col("sres").isNotNull(), level("sres", "rank", "used")))


def flag_limits(levels: tuple[float, float], maximum: tuple[bool, bool], nobs: int, ranks=(1, 2, 3)) -> dict[int, tuple[float, float]]:
    """Standardised residuals, per rank, above which a residual is flagged at each of two levels (percent).

    With ``maximum`` set, the level is for the largest of ``nobs`` residuals rather than for one.
    """
    out = {}
    for rank in ranks:
        limits = []
        for level, largest in zip(levels, maximum):
            p = level / 100.0
            if largest and nobs > 0:
                p = p ** (1.0 / nobs)
            limits.append(math.sqrt(P.chi2_quantile(p, rank) / rank))
        out[rank] = tuple(limits)
    return out


def flag(sres: Column, rank: Column, limits: dict[int, tuple[float, float]]) -> Column:
    """0, 1 or 2: how many of the two limits the residual passes."""
    out = F.lit(0)
    for k, (low, high) in limits.items():
        here = F.when(sres > high, 2).when(sres > low, 1).otherwise(0)
        out = F.when(rank == k, here).otherwise(out)
    return out


def flag_tallies(df: DataFrame) -> DataFrame:
    return df.groupBy("used", "flag").agg(F.count("*").alias("n"))


def worst_residuals(df: DataFrame, k: int, used: str = "used", rank: str = "rank", sres: str = "sres", key: str = "obs_key") -> DataFrame:
    """The ``k`` largest standardised residuals of every (used, rank).

    The row limit reaches below the shuffle: each task keeps ``k`` rows per group.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(used, rank).orderBy(F.col(sres).desc(), F.col(key))
    return df.filter(F.col(sres).isNotNull()).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def scaled(column: Column, seu: float, aposteriori: bool, ratio: bool = False) -> Column:
    """A-posteriori results: errors multiplied, ratios divided, by the standard error of unit weight."""
    if not aposteriori:
        return column
    return column / seu if ratio else column * seu


def error_ellipse(vee: Column, ven: Column, vnn: Column) -> tuple[Column, Column, Column]:
    """Semi-axes and azimuth in degrees (0..180) of the major one, from an east/north covariance."""
    mean, diff = (vee + vnn) / 2.0, (vnn - vee) / 2.0
    spread = F.hypot(diff, ven)
    azimuth = F.degrees(F.atan2(ven, diff) / 2.0)
    azimuth = F.when(spread <= 0, 0.0).when(azimuth < 0, azimuth + 180.0).otherwise(azimuth)
    return F.sqrt(F.greatest(F.lit(0.0), mean + spread)), F.sqrt(F.greatest(F.lit(0.0), mean - spread)), azimuth


def coordinate_changes(initial: DataFrame, final: DataFrame, ell) -> DataFrame:
    """Shift of every station from its initial position, in east, north, up metres."""
    from cairn.functions.ellipsoid import meridian_radius, prime_vertical

    a = initial.select("code", F.col("lon").alias("_lon0"), F.col("lat").alias("_lat0"), F.col("ohgt").alias("_h0"))
    df = final.join(a, "code")
    h = F.col("_h0") + F.col("und")
    return df.select(
        "code",
        ((F.col("lon") - F.col("_lon0")) * (prime_vertical(F.col("_lat0"), ell) + h) * F.cos("_lat0")).alias("adj_e"),
        ((F.col("lat") - F.col("_lat0")) * (meridian_radius(F.col("_lat0"), ell) + h)).alias("adj_n"),
        (F.col("ohgt") - F.col("_h0")).alias("adj_u"),
    )


def float_diagnostics(changes: DataFrame, stations: DataFrame) -> DataFrame:
    """Shift of floating stations against the error they were floated with."""
    df = changes.join(stations.select("code", "mode_h", "mode_v", "float_h", "float_v"), "code")
    df = df.filter((F.col("mode_h") == "float") | (F.col("mode_v") == "float"))
    h = F.hypot("adj_e", "adj_n")
    return df.select(
        "code",
        h.alias("shift_h"),
        F.when(F.col("float_h") > 0, h / F.col("float_h")).alias("ratio_h"),
        F.col("adj_u").alias("shift_v"),
        F.when(F.col("float_v") > 0, F.abs("adj_u") / F.col("float_v")).alias("ratio_v"),
    )


def sigma_and_correlation(cov: Column) -> list[Column]:
    """Three standard errors and the correlations 12, 13, 23 of a six-element lower triangle."""
    c = [F.element_at(cov, i + 1) for i in range(6)]
    s = [F.sqrt(F.greatest(F.lit(0.0), c[i])) for i in (0, 2, 5)]
    corr = lambda k, i, j: F.when((s[i] > 0) & (s[j] > 0), c[k] / (s[i] * s[j])).otherwise(0.0)
    return [*s, corr(1, 0, 1), corr(3, 0, 2), corr(4, 1, 2)]


def vector_view(vec: Column, cov: Column, lon: Column, lat: Column, topocentric: bool) -> dict[str, Column]:
    """A vector with its standard errors, length and the length's error, in X/Y/Z or east/north/up."""
    v = [F.element_at(vec, i + 1) for i in range(3)]
    c = [F.element_at(cov, i + 1) for i in range(6)]
    # Length and its error do not depend on the axes, so they come from the vector as given.
    length = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    quad = F.lit(0.0)
    for value, (i, j) in zip(c, LOWER):
        quad = quad + (1.0 if i == j else 2.0) * v[i] * v[j] * value
    if topocentric:
        c = rotate_covariance(c, enu_axes(lon, lat))
        v = list(to_enu(lon, lat, *v))
    return {
        "v1": v[0], "v2": v[1], "v3": v[2],
        "s1": F.sqrt(c[0]), "s2": F.sqrt(c[2]), "s3": F.sqrt(c[5]),
        "length": length,
        "length_error": F.when(length > 0, F.sqrt(F.greatest(F.lit(0.0), quad)) / length),
    }


def component_residuals(df: DataFrame, residual: str, sigma: str) -> DataFrame:
    """One row per component of a vector residual with ``component`` and ``comp_sres``; tiny sigmas drop out."""
    zipped = F.posexplode(F.arrays_zip(F.col(residual).alias("r"), F.col(sigma).alias("s")))
    rows = df.select(*df.columns, zipped.alias("component", "_rs"))
    return rows.filter(F.col("_rs.s") > 1.0e-6).withColumn("comp_sres", F.col("_rs.r") / F.col("_rs.s")).drop("_rs")
