"""Observation models, covariances, residual views and result tables."""


from pyspark.sql import functions as F

from cairn.catalog import query
from cairn.catalog.coordinates import E2, TM, _tm_sql
from cairn.fixtures import with_views
from cairn.functions.ellipsoid import GRS80
from cairn.operators import adjust as A
from cairn.operators import covariance as CV
from cairn.operators import crs as X
from cairn.operators import lines as L
from cairn.operators import normal as N
from cairn.operators import observe as O
from cairn.operators import residuals as RS
from cairn.sinks import tables as K

LN = with_views("lines")
DEFLECT = {"xi": "(CAST(substr(from_code, 2) AS BIGINT) % 17 - 8) * 5.0E-6", "eta": "(CAST(substr(from_code, 2) AS BIGINT) % 13 - 6) * 5.0E-6"}


def _lines(t, kind):
    """Resolved lines of one type with instrument heights and deflections."""
    n = F.substring("from_code", 2, 20).cast("long")
    return t.lines.select(
        "obs_key", "set_id", "from_code", "to_code", F.lit(kind).alias("obs_type"), "error", "noise",
        *[F.radians(f"{e}_{c}").alias(f"{e}_{d}") for e in "ft" for c, d in (("lat", "lat"), ("lon", "lon"))],
        "f_ohgt", "t_ohgt", "f_und", "t_und",
        F.lit(1.5).alias("from_hgt"), F.lit(2.0).alias("to_hgt"),
        ((n % 17 - 8) * 5.0e-6).alias("f_xi"), ((n % 13 - 6) * 5.0e-6).alias("f_eta"),
        F.lit(0.0).alias("value"),
    )


def _ends(hf: str, ht: str) -> str:
    def xyz(e, h):
        nu = f"({GRS80.a!r} / sqrt(1 - {E2!r} * sin({e}la) * sin({e}la)))"
        return (
            f"({nu} + {h}) * cos({e}la) * cos({e}lo) AS {e}x, ({nu} + {h}) * cos({e}la) * sin({e}lo) AS {e}y, ({nu} * (1 - {E2!r}) + {h}) * sin({e}la) AS {e}z"
        )

    return LN + f""", r AS (SELECT *, radians(f_lat) AS fla, radians(f_lon) AS flo, radians(t_lat) AS tla, radians(t_lon) AS tlo, {DEFLECT['xi']} AS xi, {DEFLECT['eta']} AS eta FROM fx_lines),
g AS (SELECT *, {xyz('f', '(' + hf + ')')}, {xyz('t', '(' + ht + ')')},
  1 + (1 - (sin(fla) * sin(tla) + cos(fla) * cos(tla) * cos(flo - tlo))) / 12 AS arc, sin(fla) * sin(tla) + cos(fla) * cos(tla) * cos(flo - tlo) AS cosv FROM r),
d AS (SELECT *, tx - fx AS dx, ty - fy AS dy, tz - fz AS dz FROM g),
c AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS chord, dy * cos(flo) - dx * sin(flo) AS te, dz * cos(fla) - sin(fla) * (dx * cos(flo) + dy * sin(flo)) AS tn,
  dy * cos(flo + eta / cos(fla)) - dx * sin(flo + eta / cos(fla)) AS ge,
  dz * cos(fla + xi) - sin(fla + xi) * (dx * cos(flo + eta / cos(fla)) + dy * sin(flo + eta / cos(fla))) AS gn,
  dz * sin(fla + xi) + cos(fla + xi) * (dx * cos(flo + eta / cos(fla)) + dy * sin(flo + eta / cos(fla))) AS gu FROM d)
"""


INST = _ends("f_ohgt + f_und + 1.5", "t_ohgt + t_und + 2.0")
TURN = "CASE WHEN {a} < 0 THEN {a} + 2 * pi() ELSE {a} END"


def _calc(t, kind, places):
    return O.calculate(_lines(t, kind)).select("obs_key", F.round("calc", places).alias("calc"))


@query("slope_distance", INST + "SELECT obs_key, round(chord, 5) AS calc FROM c")
def _(t):
    return _calc(t, "SD", 5)


@query(
    "horizontal_distance",
    _ends("f_ohgt + f_und + 1.5 + (t_ohgt + 2.0 - f_ohgt - 1.5) / 2", "t_ohgt + t_und + 2.0 - (t_ohgt + 2.0 - f_ohgt - 1.5) / 2")
    + "SELECT obs_key, round(chord, 5) AS calc FROM c",
)
def _(t):
    return _calc(t, "HD", 5)


@query("ellipsoidal_distance", _ends("0", "0") + "SELECT obs_key, round(chord * arc, 5) AS calc FROM c")
def _(t):
    return _calc(t, "ED", 5)


@query(
    "sea_level_distance",
    _ends("f_und - (f_und - t_und) / 2", "t_und + (f_und - t_und) / 2") + "SELECT obs_key, round(chord * arc, 5) AS calc FROM c",
)
def _(t):
    return _calc(t, "MD", 5)


@query("azimuth", INST + f"SELECT obs_key, round({TURN.format(a='atan2(te, tn)')}, 9) AS calc FROM c")
def _(t):
    return _calc(t, "AZ", 9)


@query("horizontal_direction", INST + f"SELECT obs_key, round({TURN.format(a='atan2(ge, gn)')}, 9) AS calc FROM c")
def _(t):
    return _calc(t, "HA", 9)


@query("zenith_distance", INST + "SELECT obs_key, round(atan2(sqrt(ge * ge + gn * gn), gu), 9) AS calc FROM c")
def _(t):
    return _calc(t, "ZD", 9)


@query("refraction_effect", INST + "SELECT obs_key, round(-sqrt(greatest(0, 1 - cosv * cosv)), 8) AS coef FROM c")
def _(t):
    g = O.with_line_geometry(_lines(t, "ZD"))
    return g.select("obs_key", F.round(O.refraction_angle(F.col("_cosv")), 8).alias("coef"))


@query("height_difference", LN + "SELECT obs_key, round(t_ohgt + 2.0 - f_ohgt - 1.5, 6) AS calc FROM fx_lines")
def _(t):
    return _calc(t, "LV", 6)


@query(
    "point_observations",
    with_views("stations") + f"""SELECT code, round(ohgt, 6) AS oh, round(ohgt + und, 6) AS eh, round(radians(lat_deg), 10) AS lt,
  round(1 / ({GRS80.a * (1 - E2)!r} / pow(1 - {E2!r} * sin(radians(lat_deg)) * sin(radians(lat_deg)), 1.5) + ohgt + und) * 1e6, 8) AS lt_coef FROM fx_stations""",
)
def _(t):
    st = t.stations.select(
        F.col("code").alias("from_code"), F.radians("lat_deg").alias("f_lat"), F.radians("lon_deg").alias("f_lon"),
        F.col("ohgt").alias("f_ohgt"), F.col("und").alias("f_und"), F.lit(0.0).alias("value"), F.lit(1.0).alias("error"),
    )
    kinds = st.withColumn("obs_type", F.explode(F.array(*[F.lit(k) for k in ("OH", "EH", "LT")])))
    rows = O.point_rows(kinds)
    pick = lambda k, c: F.max(F.when(F.col("obs_type") == k, c))
    return rows.groupBy(F.col("from_code").alias("code")).agg(
        F.round(pick("OH", F.col("calc")), 6).alias("oh"), F.round(pick("EH", F.col("calc")), 6).alias("eh"),
        F.round(pick("LT", F.col("calc")), 10).alias("lt"), F.round(pick("LT", F.col("design")[0]["coef"]) * 1e6, 8).alias("lt_coef"),
    )


@query("gnss_baseline", INST + "SELECT obs_key, round(dx, 4) AS dx, round(dy, 4) AS dy, round(dz, 4) AS dz FROM c")
def _(t):
    df = _lines(t, "GB").withColumns({"vec": F.array(*[F.lit(0.0)] * 3), "cov": F.array(*[F.lit(v) for v in (1.0, 0.0, 1.0, 0.0, 0.0, 1.0)])})
    rows = O.vector_rows(df).filter("component = 0")
    return rows.select("obs_key", *[F.round(F.element_at("calc_vec", i + 1), 4).alias(n) for i, n in enumerate(("dx", "dy", "dz"))])


@query(
    "gnss_point_and_frame_terms",
    INST + """SELECT obs_key, round(fx, 4) AS x, round(fx * 1e-6, 7) AS scale, round(fz * pi() / 648000 / 1, 4) AS ry FROM c""",
)
def _(t):
    df = _lines(t, "GX").withColumns({"vec": F.array(*[F.lit(0.0)] * 3), "cov": F.array(*[F.lit(v) for v in (1.0, 0.0, 1.0, 0.0, 0.0, 1.0)])})
    rows = O.vector_rows(df.withColumn("to_code", F.lit(None).cast("string")), frame="F").filter("component = 0")
    term = lambda n: F.element_at(F.filter("design", lambda d: d["param"] == f"frame|F|{n}"), 1)["coef"]
    return rows.select(
        "obs_key", F.round(F.element_at("calc_vec", 1), 4).alias("x"), F.round(term("scale"), 7).alias("scale"), F.round(term("ry"), 4).alias("ry")
    )


@query(
    "azimuth_design_rows",
    INST + """, a AS (SELECT obs_key, from_code, to_code, tn / (te * te + tn * tn) AS le, -te / (te * te + tn * tn) AS ln, flo, fla, tlo, tla FROM c),
x AS (SELECT *, -sin(flo) * le - sin(fla) * cos(flo) * ln AS gx, cos(flo) * le - sin(fla) * sin(flo) * ln AS gy, cos(fla) * ln AS gz FROM a)
SELECT obs_key, concat(to_code, '|n') AS param, round((gz * cos(tla) - sin(tla) * (gx * cos(tlo) + gy * sin(tlo))) * 1e6, 6) AS coef FROM x
UNION ALL SELECT obs_key, concat(from_code, '|e'), round((gx * sin(flo) - gy * cos(flo)) * 1e6, 6) FROM x""",
)
def _(t):
    rows = O.design_rows(_lines(t, "AZ")).select("obs_key", "from_code", "to_code", F.explode_outer("design").alias("d"))
    wanted = F.concat("to_code", F.lit("|n")), F.concat("from_code", F.lit("|e"))
    return rows.filter((F.col("d.param") == wanted[0]) | (F.col("d.param") == wanted[1])).select(
        "obs_key", "d.param", F.round(F.col("d.coef") * 1e6, 6).alias("coef")
    )


@query(
    "named_unknown_terms",
    INST + """SELECT obs_key, 'distsf|A' AS param, round(chord * 1e-6, 8) AS coef FROM c UNION ALL SELECT obs_key, 'brngref|B', round(pi() / 648000, 12) FROM c
UNION ALL SELECT obs_key, 'syserr|S1', round(chord / 1000, 6) FROM c""",
)
def _(t):
    g = O.with_line_geometry(_lines(t, "SD"))
    sys = F.array(F.struct(F.lit("S1").alias("prm"), (F.col("_chord") / 1000).alias("influence")))
    terms = F.concat(
        F.array(O.scale_term(F.lit("A")), O.orientation_term(F.lit("B"))), O.systematic_terms(sys)
    )
    rows = g.select("obs_key", F.inline(terms))
    places = F.when(F.col("param") == "distsf|A", F.round("coef", 8)).when(F.col("param") == "brngref|B", F.round("coef", 12)).otherwise(F.round("coef", 6))
    return rows.select("obs_key", "param", places.alias("coef"))


@query(
    "projection_bearing",
    with_views("lines") + ", l AS MATERIALIZED (SELECT obs_key, f_lon, f_lat, t_lon, t_lat FROM fx_lines), fx_stations2 AS MATERIALIZED (SELECT DISTINCT f_lon AS lon_deg, f_lat AS lat_deg, concat(f_lon, ' ', f_lat) AS code FROM l UNION SELECT t_lon, t_lat, concat(t_lon, ' ', t_lat) FROM l), "
    + _tm_sql().replace("fx_stations", "fx_stations2").replace("t AS (", "t AS MATERIALIZED (", 1).replace("s AS (SELECT", "s AS MATERIALIZED (SELECT", 1).replace("\nSELECT code, round", ",\nen AS MATERIALIZED (SELECT code, round").replace(" FROM s", " FROM s)").replace("round(", "(").replace(", 4) AS", ") AS")
    + """, m AS (SELECT l.obs_key, atan2(b.easting - a.easting, b.northing - a.northing) AS v FROM l JOIN en a ON a.code = concat(l.f_lon, ' ', l.f_lat) JOIN en b ON b.code = concat(l.t_lon, ' ', l.t_lat))
SELECT obs_key, round(CASE WHEN v < 0 THEN v + 2 * pi() ELSE v END, 8) AS calc FROM m""",
)
def _(t):
    out = X.projection_bearing(_lines(t, "PB"), TM)
    return out.select("obs_key", F.round("calc", 8).alias("calc"))


@query(
    "line_geometry",
    _ends("f_ohgt + f_und", "t_ohgt + t_und") + f"SELECT obs_key, round(chord, 5) AS slope_distance, round({TURN.format(a='atan2(te, tn)')}, 9) AS azimuth, round(t_ohgt - f_ohgt, 6) AS height_difference FROM c",
)
def _(t):
    df = _lines(t, "SD").drop("f_xi", "f_eta")
    g = L.line_geometry(df, projection=TM)
    return g.select(
        "obs_key", F.round("slope_distance", 5).alias("slope_distance"), F.round("azimuth", 9).alias("azimuth"), F.round("height_difference", 6).alias("height_difference")
    )


@query(
    "collocated_lines_rejected",
    with_views("obs", "stations") + """SELECT o.obs_key FROM fx_obs o JOIN fx_stations f ON o.from_code = f.code JOIN fx_stations t ON o.to_code = t.code
WHERE o.from_code = o.to_code""",
)
def _(t):
    st = t.stations.select("code", F.radians("lon_deg").alias("lon"), F.radians("lat_deg").alias("lat"), "ohgt", "und")
    df = O.resolve_ends(t.obs.withColumn("obs_type", F.lit("SD")), st, ["lon", "lat", "ohgt", "und"])
    return O.reject_collocated(O.calculate(df))[1].select("obs_key")


@query(
    "default_observation_errors",
    INST + """, q AS (SELECT obs_key, chord, sqrt(ge * ge + gn * gn) AS hz, CAST(substr(from_code, 2) AS BIGINT) % 3 AS k FROM c)
SELECT obs_key, CASE k WHEN 0 THEN 'SD' WHEN 1 THEN 'HA' ELSE 'ZD' END AS obs_type, round(CASE k WHEN 0 THEN sqrt(0.003 * 0.003 + chord * 2e-6 * chord * 2e-6)
  WHEN 1 THEN sqrt(pow(pi() / 648000, 2) + pow(0.002 / greatest(hz, 0.001), 2))
  ELSE sqrt(pow(3 * pi() / 648000, 2) + pow(CASE WHEN 0.001 < chord / 2 THEN 0.001 / chord ELSE 2 END * cos(1.5), 2) + pow(CASE WHEN 0.004 < chord / 2 THEN 0.004 / chord ELSE 2 END * sin(1.5), 2)) END, 12) AS error FROM q""",
)
def _(t):
    n = F.substring("from_code", 2, 20).cast("long") % 3
    df = _lines(t, "SD").withColumns(
        {"obs_type": F.when(n == 0, "SD").when(n == 1, "HA").otherwise("ZD"), "error": F.lit(None).cast("double")}
    )
    g = O.with_line_geometry(df).withColumn("value", F.when(F.col("obs_type") == "SD", F.col("_chord")).otherwise(1.5))
    out = O.default_error(g, {"SD": {"mm": 3.0, "ppm": 2.0}, "HA": {"sec": 1.0, "mm": 2.0}, "ZD": {"sec": 3.0, "mmh": 1.0, "mmv": 4.0}})
    return out.select("obs_key", "obs_type", F.round("error", 12).alias("error"))


ROT = "SELECT obs_key, {q} FROM (SELECT obs_key, [-sin(lo), -sin(la) * cos(lo), cos(la) * cos(lo)] AS rx, [cos(lo), -sin(la) * sin(lo), cos(la) * sin(lo)] AS ry, [0.0, cos(la), sin(la)] AS rz, {v} AS v FROM (SELECT *, (flo + tlo) / 2 AS lo, (fla + tla) / 2 AS la FROM c))"


def _quad(a, b):
    return " + ".join(f"{a}[{i}] * {b}[{i}] * v[{i}]" for i in (1, 2, 3))


@query(
    "default_baseline_covariance",
    INST + ROT.format(
        q=f"round(({_quad('rx', 'rx')}) * 1e6, 3) AS cxx, round(({_quad('rx', 'ry')}) * 1e6, 3) AS cxy, round(({_quad('rz', 'rz')}) * 1e6, 3) AS czz",
        v="[9e-6 + chord * chord * 1e-12, 9e-6 + chord * chord * 1e-12, 25e-6 + chord * chord * 4e-12]",
    ),
)
def _(t):
    g = O.with_line_geometry(_lines(t, "GB"))
    lon, lat = (F.col("f_lon") + F.col("t_lon")) / 2, (F.col("f_lat") + F.col("t_lat")) / 2
    cov = CV.default_covariance(F.col("_chord"), lon, lat, (3.0, 3.0, 5.0), (1.0, 1.0, 2.0))
    c = lambda i, n: F.round(F.element_at("cov", i) * 1e6, 3).alias(n)
    return g.withColumn("cov", cov).select("obs_key", c(1, "cxx"), c(2, "cxy"), c(6, "czz"))


@query(
    "covariance_input_forms",
    LN + """SELECT obs_key, round(error * error * 1e6, 6) AS diag11, round(error * (2 * error) * 0.25 * 1e6, 6) AS corr21, round(3 * error * 3 * error * 1e6, 6) AS corr33,
  round(error * 1e3, 6) AS se1, 0.25E0 AS r12 FROM fx_lines""",
)
def _(t):
    e = F.col("error")
    df = t.lines.select("obs_key", F.array(e, e * 2, e * 3).alias("d"), F.array(e, F.lit(0.25), e * 2, F.lit(0.1), F.lit(0.2), e * 3).alias("s"))
    df = df.withColumns({"cd": CV.from_diagonal(F.col("d")), "cc": CV.from_correlation(F.col("s"))})
    back = RS.sigma_and_correlation(F.col("cc"))
    at = lambda c, i: F.round(F.element_at(c, i) * 1e6, 6)
    return df.select(
        "obs_key", at("cd", 1).alias("diag11"), at("cc", 2).alias("corr21"), at("cc", 6).alias("corr33"), F.round(back[0] * 1e3, 6).alias("se1"),
        F.round(back[3], 6).alias("r12"),
    )


@query(
    "correlated_set_covariance_blocks",
    LN + """, m AS (SELECT set_id, obs_key, noise, line_no, row_number() OVER (PARTITION BY set_id ORDER BY line_no, obs_key) AS i FROM fx_lines),
b AS (SELECT a.set_id, a.i, b.i AS j, a.noise * 1e6 AS va, b.noise * 1e6 AS vb FROM m a JOIN m b ON a.set_id = b.set_id AND a.i <= b.i)
SELECT set_id, i, j, round(CASE WHEN i = j THEN 9 + va * va * 1e-6 ELSE (9 + 9 + va * va * 1e-6 + vb * vb * 1e-6 - 9 - (va - vb) * (va - vb) * 1e-6) / 2 END, 6) AS trace3 FROM b""",
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("set_id").orderBy("line_no", "obs_key")
    m = t.lines.select("set_id", "obs_key", "line_no", "noise").withColumn("i", F.row_number().over(w).cast("long"))
    v = m.select("set_id", "i", F.array(F.col("noise") * 1e6, F.lit(0.0), F.lit(0.0)).alias("vec"), F.lit(0.3).alias("lon"), F.lit(-0.7).alias("lat"))
    b = CV.default_set_blocks(v, (3.0, 3.0, 3.0), (1.0, 1.0, 1.0))
    trace = F.element_at("cov", 1) + F.element_at("cov", 3) + F.element_at("cov", 6)
    return b.select("set_id", "i", "j", F.round(trace * 1e6 / 3, 6).alias("trace3"))


@query(
    "round_orientation_unknowns",
    with_views("mixed") + """SELECT set_id, round(sum(noise / (error * error)) / sum(1 / (error * error)), 9) AS set_value, round(1e6 / sum(1 / (error * error)), 7) AS set_variance, count(*) AS n
FROM fx_mixed WHERE obs_type = 'HA' GROUP BY set_id""",
)
def _(t):
    eq = t.mixed.filter("obs_type = 'HA'").select(
        "set_id", F.col("noise").alias("misclosure"), (1 / (F.col("error") * F.col("error"))).alias("weight"), F.lit(1.0).alias("set_coef"),
        F.array().cast("array<struct<param:string,coef:double>>").alias("design"),
    )
    out = N.set_unknown_values(eq)
    return out.select("set_id", F.round("set_value", 9).alias("set_value"), F.round(F.col("set_variance") * 1e6, 7).alias("set_variance"), "n")


@query(
    "round_orientation_eliminated",
    with_views("mixed") + """, e AS (SELECT set_id, to_code, noise AS v, 1 / (error * error) AS w FROM fx_mixed WHERE obs_type = 'HA'),
s AS (SELECT set_id, sum(w) AS sw, sum(w * v) AS sv FROM e GROUP BY set_id),
a AS (SELECT set_id, to_code, sum(w) AS wt FROM e GROUP BY set_id, to_code),
c AS (SELECT concat(to_code, '|a') AS row, concat(to_code, '|a') AS col, w AS x FROM e
  UNION ALL SELECT '=', concat(to_code, '|a'), w * v FROM e
  UNION ALL SELECT '=', concat(a.to_code, '|a'), -sv * wt / sw FROM a JOIN s USING (set_id)
  UNION ALL SELECT concat(a.to_code, '|a'), concat(b.to_code, '|a'), -a.wt * b.wt / sw FROM a JOIN a b ON a.set_id = b.set_id AND concat(a.to_code, '|a') <= concat(b.to_code, '|a') JOIN s ON s.set_id = a.set_id)
SELECT row, col, round(sum(x), 3) AS value FROM c GROUP BY row, col""",
)
def _(t):
    eq = t.mixed.filter("obs_type = 'HA'").select(
        "set_id", F.col("noise").alias("misclosure"), (1 / (F.col("error") * F.col("error"))).alias("weight"), F.lit(1.0).alias("set_coef"),
        F.array(F.struct(F.concat("to_code", F.lit("|a")).alias("param"), F.lit(1.0).alias("coef"))).alias("design"),
    )
    cells = N.normal_cells(N.eliminate_set_unknowns(eq))
    return cells.filter("col <> '='").select("row", "col", F.round("value", 3).alias("value"))


@query(
    "tied_parameters",
    with_views("mixed") + """SELECT param, count(*) AS n, round(sum(coef), 6) AS total FROM (
  SELECT CASE WHEN class_party IN ('P1', 'P2', 'P3') THEN 'distsf|P1' ELSE concat('distsf|', class_party) END AS param, noise AS coef FROM fx_mixed) GROUP BY param""",
)
def _(t):
    eq = t.mixed.select(
        "obs_key", F.array(F.struct(F.concat(F.lit("distsf|"), "class_party").alias("param"), F.col("noise").alias("coef"))).alias("design")
    )
    links = t.mixed.filter("class_party IN ('P2', 'P3')").select(
        F.concat(F.lit("distsf|"), "class_party").alias("param"), F.when(F.col("class_party") == "P2", "distsf|P1").otherwise("distsf|P2").alias("same_as")
    ).distinct()
    merged = N.merge_parameters(eq, links).select(F.explode_outer("design").alias("d"))
    return merged.groupBy("d.param").agg(F.count("*").alias("n"), F.round(F.sum("d.coef"), 6).alias("total"))


@query(
    "float_station_equations",
    with_views("stations") + """, f AS (SELECT * FROM fx_stations WHERE mode_h = 'float')
SELECT concat('float|', code, '|e') AS obs_key, concat(code, '|e') AS param, 0.0E0 AS misclosure, round(1 / (0.02 * 0.02), 6) AS weight FROM f
UNION ALL SELECT concat('float|', code, '|n'), concat(code, '|n'), 0.0E0, round(1 / (0.02 * 0.02), 6) FROM f""",
)
def _(t):
    st = t.stations.filter("mode_h = 'float'").select(
        "code", F.radians("lon_deg").alias("lon"), F.radians("lat_deg").alias("lat"), "ohgt", "und", F.lit("enu").alias("free"),
        F.lit(0.02).alias("float_h"), F.lit(None).cast("double").alias("float_v"),
    )
    eq = A.float_equations(st)
    return eq.select("obs_key", F.col("design")[0]["param"].alias("param"), F.col("misclosure").alias("misclosure"), F.round("weight", 6).alias("weight"))


@query(
    "colocation_equations",
    with_views("stations", "recode") + """SELECT concat('coloc|', r.code_from, '|C0|u') AS obs_key, s.ohgt - z.ohgt AS misclosure, round(1 / (r.v_error * r.v_error), 4) AS weight
FROM fx_recode r JOIN fx_stations s ON s.code = r.code_from JOIN fx_stations z ON z.code = 'C0' WHERE r.v_error > 0""",
)
def _(t):
    st = t.stations.select("code", F.radians("lon_deg").alias("lon"), F.radians("lat_deg").alias("lat"), "ohgt", "und", F.lit("u").alias("free"))
    pairs = t.recode.select(F.col("code_from").alias("a"), F.lit("C0").alias("b"), F.lit(0.0).alias("h_error"), "v_error")
    eq = A.colocation_equations(pairs, st)
    return eq.select("obs_key", "misclosure", F.round("weight", 4).alias("weight"))


@query(
    "standardised_vector_residuals",
    with_views("residuals") + """SELECT obs_key, round(sqrt((r * r / (e * e) + 4 * r * r / (4 * e * e) + CASE WHEN k THEN 9 * r * r / (9 * e * e) ELSE 0 END) / CASE WHEN k THEN 3 ELSE 2 END), 6) AS sres,
  CAST(CASE WHEN k THEN 3 ELSE 2 END AS BIGINT) AS rank FROM (SELECT obs_key, residual AS r, error AS e, line_no % 2 = 0 AS k FROM fx_residuals)""",
)
def _(t):
    r, e = F.col("residual"), F.col("error")
    z = F.lit(0.0)
    third = F.when(F.col("line_no") % 2 == 0, 9 * e * e).otherwise(0.0)
    df = t.residuals.select("obs_key", F.array(r, r * 2, r * 3).alias("res_vec"), F.array(e * e, z, e * e * 4, z, z, third).alias("res_cov"))
    out = RS.vector_sres(df)
    return out.select("obs_key", F.round("sres", 6).alias("sres"), F.col("rank").cast("long").alias("rank"))


@query(
    "vector_views",
    INST + """SELECT obs_key, round(te, 4) AS east, round(tn, 4) AS north, round(chord, 4) AS length, round(error * 1e3, 6) AS s1, round(error * 1e3, 6) AS length_error FROM c""",
)
def _(t):
    g = O.with_line_geometry(_lines(t, "SD"))
    e2, z = F.col("error") * F.col("error"), F.lit(0.0)
    view = RS.vector_view(F.array("dx", "dy", "dz"), F.array(e2, z, e2, z, z, e2), F.col("f_lon"), F.col("f_lat"), True)
    return g.select(
        "obs_key", F.round(view["v1"], 4).alias("east"), F.round(view["v2"], 4).alias("north"), F.round(view["length"], 4).alias("length"),
        F.round(view["s1"] * 1e3, 6).alias("s1"), F.round(view["length_error"] * 1e3, 6).alias("length_error"),
    )


@query("baseline_comparison_listing")
def _(t):
    df = O.with_line_geometry(_lines(t, "GB").withColumns({"from_hgt": F.lit(0.0), "to_hgt": F.lit(0.0)}))
    df = df.withColumn("vec", F.array(F.col("dx") + F.col("noise"), F.col("dy") - F.col("noise"), F.col("dz")))
    keep = ["obs_key", "vec", *[f"{e}_{c}" for e in "ft" for c in ("lon", "lat", "ohgt", "und")]]
    out = L.baseline_comparison(df.select(*keep), TM)
    return out.select(
        "obs_key", *[F.round(c, 4).alias(c) for c in ("obs_distance", "calc_distance", "distance_error", "vector_error", "distance_ppm")]
    )


@query(
    "station_result_table",
    with_views("stations") + """SELECT code, round(lon_deg, 9) AS longitude, round(ohgt, 4) AS height, CASE WHEN mode_h = mode_v THEN mode_h ELSE concat(mode_h, '/', mode_v) END AS mode,
  round(und / 1000, 6) AS adj_e, round(sqrt(und + 1) * 0.02, 6) AS errhgt, name FROM fx_stations""",
)
def _(t):
    final = t.stations.select("code", "name", F.col("lon_deg").alias("lon"), F.col("lat_deg").alias("lat"), "ohgt", "mode_h", "mode_v")
    changes = t.stations.select("code", (F.col("und") / 1000).alias("adj_e"), F.lit(0.0).alias("adj_n"), F.lit(0.0).alias("adj_u"))
    cov = t.stations.select("code", F.lit(1e-4).alias("vee"), F.lit(0.0).alias("ven"), F.lit(1e-4).alias("vnn"), ((F.col("und") + 1) * 1e-4).alias("vuu"))
    out = K.station_results(final, changes, cov, 2.0)
    return out.select(
        "code", F.round("longitude", 9).alias("longitude"), F.round("height", 4).alias("height"), "mode", F.round("adj_e", 6).alias("adj_e"),
        F.round("errhgt", 6).alias("errhgt"), "name",
    )


@query(
    "observation_result_table",
    with_views("residuals") + """SELECT from_code AS fromstn, to_code AS tostn, obs_type AS obstype, obs_key AS obsid, CASE WHEN rejected THEN 'rejected' ELSE 'used' END AS status,
  round(residual, 9) AS residual, round(res_error * 1.5, 9) AS reserror, round(sres / 1.5, 7) AS stdres, round(res_error / error, 7) AS redundancy, data_file AS file FROM fx_residuals""",
)
def _(t):
    df = t.residuals.withColumns({"unused": F.lit(False), "value": F.col("noise")})
    out = K.observation_results(df, 1.5, True)
    return out.select(
        "fromstn", "tostn", "obstype", "obsid", "status", F.round("residual", 9).alias("residual"), F.round("reserror", 9).alias("reserror"),
        F.round("stdres", 7).alias("stdres"), F.round("redundancy", 7).alias("redundancy"), "file",
    )


@query(
    "observation_component_rows",
    with_views("residuals") + """, g AS (SELECT obs_key, residual AS r, error AS e FROM fx_residuals WHERE obs_type = 'GB')
SELECT obs_key, CAST(1 AS BIGINT) AS component, r AS residual, e AS error FROM g UNION ALL SELECT obs_key, 2, r * 2, e * 2 FROM g UNION ALL SELECT obs_key, 3, r * 4, e * 4 FROM g""",
)
def _(t):
    r, e = F.col("residual"), F.col("error")
    g = t.residuals.filter("obs_type = 'GB'").select("obs_key", F.array(r, r * 2, r * 4).alias("residual"), F.array(e, e * 2, e * 4).alias("error"))
    return K.vector_components(g, ["residual", "error"])


@query(
    "observation_component_columns",
    with_views("residuals") + """SELECT obs_key, residual AS residual1, residual * 2 AS residual2, residual * 4 AS residual3 FROM fx_residuals WHERE obs_type = 'GB'""",
)
def _(t):
    r = F.col("residual")
    g = t.residuals.filter("obs_type = 'GB'").select("obs_key", F.array(r, r * 2, r * 4).alias("residual"))
    return K.inline_components(g, ["residual"])


@query(
    "run_metadata_table",
    with_views("mixed", "stations") + """SELECT 'nstations' AS code, CAST(count(*) AS VARCHAR) AS value FROM fx_stations UNION ALL SELECT 'nobservations', CAST(count(*) AS VARCHAR) FROM fx_mixed
UNION ALL SELECT 'nunused', CAST(count(*) FILTER (rejected) AS VARCHAR) FROM fx_mixed UNION ALL SELECT 'dof', '12'""",
)
def _(t):
    return K.metadata(t.stations, t.mixed.withColumn("unused", F.col("rejected")), {"dof": 12}).select("code", "value")


@query(
    "file_list_table",
    with_views("mixed", "stations") + """SELECT DISTINCT class_district AS file, 'coordinates' AS role FROM fx_stations UNION SELECT DISTINCT data_file, 'observations' FROM fx_mixed""",
)
def _(t):
    return K.file_list(t.stations, t.mixed, "class_district")


@query(
    "geometry_text",
    LN + """SELECT obs_key, concat('LINESTRING(', printf('%.4f', round(f_lon, 4)), ' ', printf('%.4f', round(f_lat, 4)), ', ', printf('%.4f', round(t_lon, 4)), ' ', printf('%.4f', round(t_lat, 4)), ')') AS shape FROM fx_lines""",
)
def _(t):
    c = F.col
    return t.lines.select("obs_key", K.line_wkt(c("f_lon"), c("f_lat"), c("t_lon"), c("t_lat"), 4).alias("shape"))


@query(
    "updated_coordinate_lines",
    with_views("stations") + """, p AS (SELECT *, CAST(round(-lat_deg * 3600000) AS BIGINT) AS u, CAST(round(lon_deg * 3600000) AS BIGINT) AS w FROM fx_stations)
SELECT code, concat(rpad(code, 10, ' '), ' ', u // 3600000, ' ', lpad(CAST(u // 60000 % 60 AS VARCHAR), 2, '0'), ' ', lpad(CAST(u // 1000 % 60 AS VARCHAR), 2, '0'), '.', lpad(CAST(u % 1000 AS VARCHAR), 3, '0'), ' S ',
  w // 3600000, ' ', lpad(CAST(w // 60000 % 60 AS VARCHAR), 2, '0'), ' ', lpad(CAST(w // 1000 % 60 AS VARCHAR), 2, '0'), '.', lpad(CAST(w % 1000 AS VARCHAR), 3, '0'), ' E ',
  printf('%.2f', ohgt), ' ', class_district, ' ', name) AS line FROM p""",
)
def _(t):
    st = t.stations.withColumns({"lat": F.col("lat_deg"), "lon": F.col("lon_deg")})
    return K.coordinate_lines(st, ["class_district"], 2, 3)


@query(
    "user_defined_listing",
    with_views("stations") + """SELECT code, concat(rpad(code, 8, ' '), ',', lpad(printf('%.3f', ohgt), 12, ' '), ',', mode_v) AS line FROM fx_stations""",
)
def _(t):
    cols = [K.ListColumn("code", "Code", 8, right=False), K.ListColumn("ohgt", "Height", 12, 3), K.ListColumn("mode_v", "Mode")]
    return K.listing(t.stations, cols, ",", ["code"])


@query(
    "residual_listing",
    with_views("residuals") + """SELECT from_code AS "from", to_code AS "to", obs_type AS type, residual, sres, obs_key AS id FROM fx_residuals""",
)
def _(t):
    return K.residual_listing(t.residuals, ["from", "to", "type", "residual", "sres", "id"])


@query(
    "equations_as_json",
    with_views("levels", "stations") + """SELECT obs_key, 3.0E0 AS keys FROM fx_levels l JOIN fx_stations f ON l.from_code = f.code JOIN fx_stations t ON l.to_code = t.code""",
)
def _(t):
    from cairn.catalog.adjustment import level_equations

    out = K.equations_json(level_equations(t))
    keys = F.size(F.json_object_keys("json")) - F.when(F.get_json_object("json", "$.weight") == "", 1).otherwise(0)
    return out.select("obs_key", (keys - 1).cast("double").alias("keys"))


@query(
    "coordinate_covariance_triplets",
    with_views("stations") + """, c AS (SELECT code, und FROM fx_stations) SELECT code AS row_code, 'n' AS row_axis, code AS col_code, 'e' AS col_axis, c.und * 1.0E-6 AS value, s.ohgt FROM c JOIN fx_stations s USING (code)""",
)
def _(t):
    cells = t.stations.select(F.concat("code", F.lit("|n")).alias("row"), F.concat("code", F.lit("|e")).alias("col"), (F.col("und") * 1e-6).alias("value"))
    st = t.stations.select("code", F.col("lon_deg").alias("lon"), F.col("lat_deg").alias("lat"), "ohgt")
    return K.coordinate_covariances(st, cells).select("row_code", "row_axis", "col_code", "col_axis", "value", "ohgt")


@query(
    "solution_exchange_lines",
    with_views("stations") + """SELECT 'SOLUTION/ESTIMATE' AS block, count(*) + 2 AS n FROM fx_stations UNION ALL SELECT 'SOLUTION/MATRIX_ESTIMATE L COVA', count(*) + 2 FROM fx_stations""",
)
def _(t):
    n = F.substring("code", 2, 20).cast("long") + 1
    est = t.stations.select(n.alias("no"), F.lit("STAX").alias("kind"), "code", F.col("ohgt").alias("value"), F.lit(0.001).alias("error"))
    cells = t.stations.select(n.alias("row_no"), n.alias("col_no"), F.lit(1e-6).alias("value"))
    return K.solution_exchange_lines(est, cells).groupBy("block").agg(F.count("*").alias("n"))


@query(
    "coordinate_changes",
    with_views("stations") + f"""SELECT code, round(1.0E-8 * ({GRS80.a!r} / sqrt(1 - {E2!r} * sin(radians(lat_deg)) * sin(radians(lat_deg))) + ohgt + und) * cos(radians(lat_deg)), 6) AS adj_e,
  round(-2.0E-8 * ({GRS80.a * (1 - E2)!r} / pow(1 - {E2!r} * sin(radians(lat_deg)) * sin(radians(lat_deg)), 1.5) + ohgt + und), 6) AS adj_n, 0.25E0 AS adj_u FROM fx_stations""",
)
def _(t):
    st = t.stations.select("code", F.radians("lon_deg").alias("lon"), F.radians("lat_deg").alias("lat"), "ohgt", "und")
    final = st.withColumns({"lon": F.col("lon") + 1e-8, "lat": F.col("lat") - 2e-8, "ohgt": F.col("ohgt") + 0.25})
    out = RS.coordinate_changes(st, final, GRS80)
    return out.select("code", F.round("adj_e", 6).alias("adj_e"), F.round("adj_n", 6).alias("adj_n"), F.round("adj_u", 6).alias("adj_u"))


@query(
    "float_station_diagnostics",
    with_views("stations") + """SELECT code, round(und * 1.0E-3, 7) AS shift_h, round(und * 1.0E-3 / 0.02, 6) AS ratio_h, 0.01E0 AS shift_v FROM fx_stations WHERE mode_h = 'float'""",
)
def _(t):
    changes = t.stations.select("code", (F.col("und") * 0.6e-3).alias("adj_e"), (F.col("und") * 0.8e-3).alias("adj_n"), F.lit(0.01).alias("adj_u"))
    st = t.stations.withColumns({"float_h": F.lit(0.02), "float_v": F.lit(None).cast("double")})
    out = RS.float_diagnostics(changes, st)
    return out.select("code", F.round("shift_h", 7).alias("shift_h"), F.round("ratio_h", 6).alias("ratio_h"), "shift_v")


