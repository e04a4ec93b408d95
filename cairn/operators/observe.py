"""Observation modelling: calculated values and design rows.

An observation resolved to both stations carries ``f_*``/``t_*`` columns
(longitude, latitude, deflections in radians, heights in metres). One pass of
column stages gives the calculated value and its gradient, which is kept as an
array of ``(param, coef)`` on the row; nothing is exploded until the normal
equations need it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.ellipsoid import GRS80, Ellipsoid, enu_axes, geocentric, meridian_radius, prime_vertical, to_enu
from cairn.operators.crs import projection_bearing
from cairn.plans.settle import settle
from cairn.plans.skew import salted_join

ARC_SECOND = math.pi / 180.0 / 3600.0
COLLOCATED = 1.0e-4

DISTANCES = ("SD", "HD", "ED", "MD", "DR")
ANGLES = ("HA", "AZ", "PB")
POINTS = ("OH", "EH", "LT", "LN", "GX", "EP")
VECTORS = ("GB", "GX", "EP")


def resolve_ends(observations: DataFrame, stations: DataFrame, columns: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """Join both ends to their stations as ``f_*`` and ``t_*``; point rows keep null ``t_*``.

    A station that is an end of a large share of the rows is salted, so its rows
    do not meet in one task.
    """
    side = lambda end, code: stations.select(
        F.col("code").alias(code), *[F.col(c).alias(f"{end}_{c}") for c in columns]
    )
    if hot_rows is None:
        # The far end first: observations just joined to their far ends stay where they are.
        out = observations.join(side("t", "to_code"), "to_code", "left").filter(
            F.col("to_code").isNull() | F.col(f"t_{columns[0]}").isNotNull()
        )
        return out.join(side("f", "from_code"), "from_code")
    out = salted_join(observations, side("f", "from_code"), ["from_code"], ["obs_key"], hot_rows=hot_rows)
    out = salted_join(out, side("t", "to_code"), ["to_code"], ["obs_key"], how="left", hot_rows=hot_rows)
    return out.filter(F.col("to_code").isNull() | F.col(f"t_{columns[0]}").isNotNull())


def missing_stations(observations: DataFrame, stations: DataFrame) -> DataFrame:
    """Codes used by observations but absent from the stations, with how often each is used."""
    uses = observations.select(F.col("from_code").alias("code"), F.lit(1).alias("f"), F.lit(0).alias("t")).unionAll(
        observations.filter(F.col("to_code").isNotNull()).select(F.col("to_code").alias("code"), F.lit(0), F.lit(1))
    )
    counted = uses.groupBy("code").agg(F.sum("f").alias("used_from"), F.sum("t").alias("used_to"))
    return counted.join(stations.select("code"), "code", "left_anti")


def drop_missing(observations: DataFrame, stations: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """Drop observations of missing stations: all of them, or only those in ``accepted``."""
    if accepted is not None:
        gone = accepted.select("code").distinct().join(stations.select("code"), "code", "left_anti")
        out = observations.join(gone.withColumnRenamed("code", "from_code"), "from_code", "left_anti")
        return out.join(gone.withColumnRenamed("code", "to_code"), "to_code", "left_anti")
    known = stations.select("code")
    out = observations.join(known.withColumnRenamed("code", "from_code"), "from_code", "left_semi")
    both = out.filter(F.col("to_code").isNotNull()).join(
        known.withColumnRenamed("code", "to_code"), "to_code", "left_semi"
    )
    return both.unionByName(out.filter(F.col("to_code").isNull()))


def _or_zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def with_line_geometry(df: DataFrame, ell: Ellipsoid = GRS80) -> DataFrame:
    """Add the vector between the ends of each row and what follows from it.

    Heights at the ends follow the observation type: instrument heights for slope
    types, both ends at the mean height for horizontal distances, the ellipsoid or
    the geoid for ellipsoidal and sea-level distances.
    """
    kind = F.col("obs_type")
    hf, ht = _or_zero(df, "from_hgt"), _or_zero(df, "to_hgt")
    level_f, level_t = F.col("f_ohgt") + hf, F.col("t_ohgt") + ht
    mean = (level_t - level_f) / 2.0
    undulation = (_or_zero(df, "f_und") - _or_zero(df, "t_und")) / 2.0
    out = df.withColumns(
        {
            "_of": F.when(kind == "HD", hf + mean)
            .when(kind == "ED", -F.col("f_ohgt") - _or_zero(df, "f_und"))
            .when(kind == "MD", -F.col("f_ohgt") - undulation)
            .otherwise(hf),
            "_ot": F.when(kind == "HD", ht - mean)
            .when(kind == "ED", -F.col("t_ohgt") - _or_zero(df, "t_und"))
            .when(kind == "MD", -F.col("t_ohgt") + undulation)
            .otherwise(ht),
            "_f_glat": F.col("f_lat") + F.when(kind.isin("AZ", "PB"), 0.0).otherwise(_or_zero(df, "f_xi")),
            "_f_glon": F.col("f_lon")
            + F.when(kind.isin("AZ", "PB"), 0.0).otherwise(_or_zero(df, "f_eta")) / F.cos("f_lat"),
        }
    )
    fx = geocentric(F.col("f_lon"), F.col("f_lat"), F.col("f_ohgt") + _or_zero(df, "f_und") + F.col("_of"), ell)
    tx = geocentric(F.col("t_lon"), F.col("t_lat"), F.col("t_ohgt") + _or_zero(df, "t_und") + F.col("_ot"), ell)
    out = out.withColumns({n: t - f for n, t, f in zip(("dx", "dy", "dz"), tx, fx)})
    e, n, u = to_enu(F.col("_f_glon"), F.col("_f_glat"), F.col("dx"), F.col("dy"), F.col("dz"))
    up_f, up_t = enu_axes(F.col("f_lon"), F.col("f_lat"))[2], enu_axes(F.col("t_lon"), F.col("t_lat"))[2]
    out = out.withColumns(
        {
            "_e": e,
            "_n": n,
            "_u": u,
            "_cosv": up_f[0] * up_t[0] + up_f[1] * up_t[1] + up_f[2] * up_t[2],
        }
    )
    return out.withColumns(
        {"_hz": F.hypot("_e", "_n"), "_chord": F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)}
    )


def arc_factor(cos_verticals: Column) -> Column:
    """Chord to arc for a line whose end verticals have this cosine between them."""
    return 1.0 + (1.0 - cos_verticals) / 12.0


def calculate(df: DataFrame, ell: Ellipsoid = GRS80, projection=None) -> DataFrame:
    """Add ``calc`` (metres or radians) for the line types; expects :func:`resolve_ends` columns.

    Projection bearings need the ``projection`` they were taken in; without one their ``calc`` is null.
    """
    out = with_line_geometry(df, ell)
    bearing = F.lit(None).cast("double")
    if projection is not None:
        out = projection_bearing(out, projection, out="_bearing")
        bearing = F.col("_bearing")
    kind = F.col("obs_type")
    azimuth = F.atan2("_e", "_n")
    azimuth = F.when(azimuth < 0, azimuth + 2.0 * math.pi).otherwise(azimuth)
    calc = (
        F.when(kind.isin("SD", "DR", "HD"), F.col("_chord"))
        .when(kind.isin("ED", "MD"), F.col("_chord") * arc_factor(F.col("_cosv")))
        .when(kind.isin("AZ", "HA"), azimuth)
        .when(kind == "PB", bearing)
        .when(kind == "ZD", F.atan2("_hz", "_u"))
        .when(
            kind == "LV",
            F.col("t_ohgt") + _or_zero(df, "to_hgt") - F.col("f_ohgt") - _or_zero(df, "from_hgt"),
        )
    )
    return out.withColumn("calc", calc)


def reject_collocated(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split off rows whose line is too short to give a direction or a distance."""
    df = settle(df, ["_chord"])
    short = (F.col("_chord") < COLLOCATED) & F.col("obs_type").isin(*DISTANCES, *ANGLES, "ZD")
    return df.filter(~F.coalesce(short, F.lit(False))), df.filter(short)


def refraction_angle(cos_verticals: Column) -> Column:
    """Effect of one unit of refraction coefficient on a zenith distance."""
    return -F.sqrt(F.greatest(F.lit(0.0), 1.0 - cos_verticals * cos_verticals))


def wrap_angle(value: Column) -> Column:
    """Into -pi..pi."""
    return value - 2.0 * math.pi * F.round(value / (2.0 * math.pi))


def _terms(prefix: str, code: str, coefs: list[Column], axes: str, free: Column | None) -> list[Column]:
    out = []
    for axis, coef in zip(axes, coefs):
        term = F.struct(F.concat(F.col(code), F.lit(f"|{axis}")).alias("param"), coef.cast("double").alias("coef"))
        keep = coef != 0.0
        if free is not None:
            keep = keep & F.coalesce(free.contains(axis), F.lit(False))
        out.append(F.when(keep, term))
    return out


def design_rows(
    df: DataFrame, ell: Ellipsoid = GRS80, dimension: str = "enu", extra: Sequence[Column] = ()
) -> DataFrame:
    """Add ``misclosure`` and ``design`` for the line types.

    ``f_free``/``t_free`` name the axes a station may move in (a subset of ``enu``);
    ``dimension`` limits them further. Take ``design`` apart with ``explode_outer``: the plain form makes the
    planner repeat the whole gradient in a filter below it. ``extra`` are ``(param, coef)`` structs for
    named unknowns, null where they do not apply.
    """
    out = df if "calc" in df.columns else calculate(df, ell)
    kind = F.col("obs_type")
    ax = enu_axes(F.col("_f_glon"), F.col("_f_glat"))
    d = [F.col("dx"), F.col("dy"), F.col("dz")]
    hz2, ch2 = F.col("_hz") ** 2, F.col("_chord") ** 2
    # A plumb line has no direction: its gradients come out null rather than failing the job.
    local_az = [F.try_divide("_n", hz2), F.try_divide(-F.col("_e"), hz2), F.lit(0.0)]
    local_zd = [
        F.try_divide(F.col("_u") * F.col("_e"), F.col("_hz") * ch2),
        F.try_divide(F.col("_u") * F.col("_n"), F.col("_hz") * ch2),
        F.try_divide(-F.col("_hz"), ch2),
    ]

    def in_xyz(local: list[Column], k: int) -> Column:
        return local[0] * ax[0][k] + local[1] * ax[1][k] + local[2] * ax[2][k]

    out = out.withColumns(
        {
            f"_g{k}": F.when(kind.isin(*DISTANCES), F.try_divide(d[k], F.col("_chord")))
            .when(kind.isin("AZ", "HA", "PB"), in_xyz(local_az, k))
            .when(kind == "ZD", in_xyz(local_zd, k))
            for k in range(3)
        }
    )
    g = [F.col("_g0"), F.col("_g1"), F.col("_g2")]
    coefs = {}
    for end, sign in (("t", 1.0), ("f", -1.0)):
        e, n, u = to_enu(F.col(f"{end}_lon"), F.col(f"{end}_lat"), *g)
        flat = kind.isin("ED", "MD")
        coefs[end] = [
            F.when(kind == "LV", 0.0).otherwise(e * sign),
            F.when(kind == "LV", 0.0).otherwise(n * sign),
            F.when(kind == "LV", sign).when(flat, 0.0).otherwise(u * sign),
        ]
    terms = []
    for end, code in (("f", "from_code"), ("t", "to_code")):
        free = F.col(f"{end}_free") if f"{end}_free" in df.columns else F.lit("enu")
        kept = [(a, c) for a, c in zip("enu", coefs[end]) if a in dimension]
        terms += _terms(end, code, [c for _, c in kept], "".join(a for a, _ in kept), free)
    difference = F.col("value") - F.col("calc")
    misclosure = F.when(kind.isin(*ANGLES), wrap_angle(difference)).otherwise(difference)
    return out.withColumns(
        {
            "misclosure": misclosure,
            "design": F.array_compact(F.array(*terms, *extra)),
            "weight": F.try_divide(F.lit(1.0), F.col("error") * F.col("error")),
        }
    )


def named_term(param: Column, coef: Column) -> Column:
    """A design term of a named unknown; null when the row does not name one."""
    return F.when(param.isNotNull(), F.struct(param.alias("param"), coef.cast("double").alias("coef")))


def scale_term(name: Column) -> Column:
    """Distance scale unknown in parts per million; needs the line geometry."""
    return named_term(F.concat(F.lit("distsf|"), name), F.col("_chord") * 1.0e-6)


def refraction_term(name: Column) -> Column:
    return named_term(F.concat(F.lit("refcoef|"), name), refraction_angle(F.col("_cosv")))


def orientation_term(name: Column) -> Column:
    """Bearing orientation unknown in arc-seconds."""
    return named_term(F.concat(F.lit("brngref|"), name), F.lit(ARC_SECOND))


def systematic_terms(errors: Column) -> Column:
    """Terms of an ``array<struct<prm, influence>>`` column."""
    return F.transform(
        errors,
        lambda s: F.struct(F.concat(F.lit("syserr|"), s["prm"]).alias("param"), s["influence"].cast("double").alias("coef")),
    )


def point_rows(df: DataFrame, ell: Ellipsoid = GRS80) -> DataFrame:
    """Calculated value and design of height, latitude and longitude observations of one station."""
    kind, lat = F.col("obs_type"), F.col("f_lat")
    h = F.col("f_ohgt") + _or_zero(df, "f_und")
    calc = (
        F.when(kind == "OH", F.col("f_ohgt"))
        .when(kind == "EH", h)
        .when(kind == "LT", lat)
        .when(kind == "LN", F.col("f_lon"))
    )
    coefs = [
        F.when(kind == "LN", 1.0 / ((prime_vertical(lat, ell) + h) * F.cos(lat))).otherwise(0.0),
        F.when(kind == "LT", 1.0 / (meridian_radius(lat, ell) + h)).otherwise(0.0),
        F.when(kind.isin("OH", "EH"), 1.0).otherwise(0.0),
    ]
    free = F.col("f_free") if "f_free" in df.columns else F.lit("enu")
    return df.withColumns(
        {
            "calc": calc,
            "misclosure": F.when(kind == "LN", wrap_angle(F.col("value") - calc)).otherwise(F.col("value") - calc),
            "design": F.array_compact(F.array(*_terms("f", "from_code", coefs, "enu", free))),
            "weight": F.try_divide(F.lit(1.0), F.col("error") * F.col("error")),
        }
    )


def vector_rows(
    df: DataFrame, ell: Ellipsoid = GRS80, frame: str | Column | None = None, years: Column | None = None, translated: Column | None = None
) -> DataFrame:
    """Baselines and points as three whitened equations each.

    ``vec`` holds the observed X, Y, Z and ``cov`` the six-element lower triangle. The rows are
    multiplied by the inverse Cholesky factor of ``cov``, so each is an equation of unit weight and the
    correlated and the plain case sum alike. ``frame`` (a name, or a column that is null where there is none) adds scale
    (ppm), rotation (arc-seconds) and, for points, translation unknowns of that frame; with ``years`` since its epoch
    also their rates a year. Points of sets where ``translated`` holds get ``set_design``: three translations of their set.
    """
    point = F.col("obs_type").isin("GX", "EP")
    fx = geocentric(
        F.col("f_lon"), F.col("f_lat"), F.col("f_ohgt") + _or_zero(df, "f_und") + _or_zero(df, "from_hgt"), ell
    )
    tx = geocentric(
        F.col("t_lon"), F.col("t_lat"), F.col("t_ohgt") + _or_zero(df, "t_und") + _or_zero(df, "to_hgt"), ell
    )
    out = df.withColumns({f"_c{k}": F.when(point, fx[k]).otherwise(tx[k] - fx[k]) for k in range(3)})
    cov = [F.element_at("cov", i + 1) for i in range(6)]
    out = out.withColumns({"_l11": F.sqrt(cov[0])})
    out = out.withColumns({"_l21": cov[1] / F.col("_l11"), "_l31": cov[3] / F.col("_l11")})
    out = out.withColumns({"_l22": F.sqrt(cov[2] - F.col("_l21") ** 2)})
    out = out.withColumns({"_l32": (cov[4] - F.col("_l31") * F.col("_l21")) / F.col("_l22")})
    out = out.withColumns({"_l33": F.sqrt(cov[5] - F.col("_l31") ** 2 - F.col("_l32") ** 2)})

    def whiten(v: list[Column]) -> list[Column]:
        a = v[0] / F.col("_l11")
        b = (v[1] - F.col("_l21") * a) / F.col("_l22")
        c = (v[2] - F.col("_l31") * a - F.col("_l32") * b) / F.col("_l33")
        return [a, b, c]

    raw = [F.element_at("vec", k + 1) - F.col(f"_c{k}") for k in range(3)]
    white_obs = whiten(raw)
    per_row: list[list[Column]] = [[], [], []]
    for end, code, sign in (("f", "from_code", F.when(point, 1.0).otherwise(-1.0)), ("t", "to_code", F.lit(1.0))):
        free = F.col(f"{end}_free") if f"{end}_free" in df.columns else F.lit("enu")
        axes = enu_axes(F.col(f"{end}_lon"), F.col(f"{end}_lat"))
        for a, axis in enumerate("enu"):
            white = whiten([axes[a][k] * sign for k in range(3)])
            for k in range(3):
                term = F.struct(F.concat(F.col(code), F.lit(f"|{axis}")).alias("param"), white[k].alias("coef"))
                per_row[k].append(F.when(F.coalesce(free.contains(axis), F.lit(False)) & (white[k] != 0.0), term))
    if frame is not None:
        c = [F.col(f"_c{k}") for k in range(3)]
        zero = F.lit(0.0)
        unknowns = {
            "scale": [v * 1.0e-6 for v in c],
            "rx": [zero, -c[2] * ARC_SECOND, c[1] * ARC_SECOND],
            "ry": [c[2] * ARC_SECOND, zero, -c[0] * ARC_SECOND],
            "rz": [-c[1] * ARC_SECOND, c[0] * ARC_SECOND, zero],
        }
        one = F.when(point, 1.0).otherwise(0.0)
        unknowns |= {"tx": [one, zero, zero], "ty": [zero, one, zero], "tz": [zero, zero, one]}
        if years is not None:
            unknowns |= {f"{name}_rate": [g * years for g in grad] for name, grad in unknowns.items()}
        label = F.lit(frame) if isinstance(frame, str) else frame
        for name, grad in unknowns.items():
            white = whiten(grad)
            for k in range(3):
                term = F.struct(F.concat(F.lit("frame|"), label, F.lit(f"|{name}")).alias("param"), white[k].alias("coef"))
                per_row[k].append(F.when(label.isNotNull() & (white[k] != 0.0), term))
    own: list[list[Column]] = [[], [], []]
    if translated is not None:
        for a, name in enumerate(("tx", "ty", "tz")):
            white = whiten([F.lit(1.0 if k == a else 0.0) for k in range(3)])
            for k in range(3):
                term = F.struct(F.lit(name).alias("param"), white[k].alias("coef"))
                own[k].append(F.when(point & translated & (white[k] != 0.0), term))
    set_terms = lambda k: [F.array_compact(F.array(*own[k])).alias("set_design")] if translated is not None else []
    equations = F.array(
        *[
            F.struct(
                F.lit(k).alias("component"),
                white_obs[k].alias("misclosure"),
                F.array_compact(F.array(*per_row[k])).alias("design"),
                F.lit(1.0).alias("weight"),
                *set_terms(k),
            )
            for k in range(3)
        ]
    )
    keep = [c for c in df.columns]
    return out.select(*keep, *[F.col(f"_c{k}") for k in range(3)], F.explode(equations).alias("_eq")).select(
        *keep, F.array("_c0", "_c1", "_c2").alias("calc_vec"), "_eq.*"
    )


def default_error(df: DataFrame, spec: dict[str, dict[str, float]]) -> DataFrame:
    """Fill missing errors from defaults per type; angles in arc-seconds, lengths in millimetres.

    Distances: ``mm`` and ``ppm`` in quadrature. Directions and azimuths: ``sec`` with ``mm`` over the
    horizontal distance. Zenith distances: ``sec`` with horizontal and vertical centring. Needs the line geometry.
    """
    kind = F.col("obs_type")
    error = F.col("error")
    for code, s in spec.items():
        if code in DISTANCES:
            e = F.hypot(F.lit(s.get("mm", 0.0) / 1000.0), F.col("value") * (s.get("ppm", 0.0) * 1.0e-6))
        elif code in ANGLES:
            mm = s.get("mm", 0.0) / 1000.0
            e = F.lit(max(s.get("sec", 0.0), 0.0) * ARC_SECOND)
            if mm > 0:
                e = F.hypot(e, F.lit(mm) / F.greatest(F.col("_hz"), F.lit(mm / 2.0)))
        elif code == "ZD":
            sec = s.get("sec", 0.0) * ARC_SECOND

            def part(mm: float) -> Column:
                mm = max(mm, 0.0) / 1000.0
                return F.when(F.lit(mm) < F.col("_chord") / 2.0, F.lit(mm) / F.col("_chord")).otherwise(2.0)

            h = part(s.get("mmh", 0.0)) * F.cos("value")
            v = part(s.get("mmv", 0.0)) * F.sin("value")
            e = F.sqrt(F.lit(sec * sec) + h * h + v * v)
        else:
            e = F.lit(s.get("mm", 0.0) / 1000.0)
        error = F.when((kind == code) & F.col("error").isNull(), e).otherwise(error)
    return df.withColumn("error", error)
