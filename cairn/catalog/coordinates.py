"""Coordinate conversion, grids, deformation and text forms."""

import math

from pyspark.sql import functions as F

from cairn.catalog import query
from cairn.fixtures import with_views
from cairn.functions import angles as AN
from cairn.functions import dates as D
from cairn.functions import projections as P
from cairn.functions.ellipsoid import GRS80, INTERNATIONAL_1924, with_geocentric, with_geodetic
from cairn.operators import crs as X
from cairn.operators import deform as DF
from cairn.operators import grids as G

ST = with_views("stations")
SG = with_views("stations", "grid")
RAD = math.pi / 180


def _radians(t):
    return t.stations.withColumns({"lon": F.radians("lon_deg"), "lat": F.radians("lat_deg"), "hgt": F.col("ohgt") + F.col("und")})


def _rounded(df, places, *names, key="code"):
    return df.select(key, *[F.round(n, places).alias(n) for n in names])


E2 = GRS80.e2
GEOC = f"""nu AS (SELECT *, radians(lon_deg) AS lo, radians(lat_deg) AS la, ohgt + und AS h,
  {GRS80.a!r} / sqrt(1 - {E2!r} * sin(radians(lat_deg)) * sin(radians(lat_deg))) AS nu FROM fx_stations),
xyz AS (SELECT code, (nu + h) * cos(la) * cos(lo) AS x, (nu + h) * cos(la) * sin(lo) AS y, (nu * (1 - {E2!r}) + h) * sin(la) AS z FROM nu)
"""


@query("geodetic_to_geocentric", ST + ", " + GEOC + "SELECT code, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM xyz")
def _(t):
    return _rounded(with_geocentric(_radians(t), "lon", "lat", "hgt", GRS80), 5, "x", "y", "z")


@query(
    "geocentric_to_geodetic",
    ST + "SELECT code, round(lon_deg, 9) AS lon, round(lat_deg, 9) AS lat, round(ohgt + und, 4) AS hgt FROM fx_stations",
)
def _(t):
    xyz = with_geocentric(_radians(t), "lon", "lat", "hgt", GRS80).select("code", "x", "y", "z")
    back = with_geodetic(xyz, "x", "y", "z", GRS80)
    return back.select(
        "code", F.round(F.degrees("lon"), 9).alias("lon"), F.round(F.degrees("lat"), 9).alias("lat"), F.round("hgt", 4).alias("hgt")
    )


def _iso_sql(lat: str, e2: float) -> str:
    e = math.sqrt(e2)
    return f"(atanh(sin({lat})) - {e!r} * atanh({e!r} * sin({lat})))"


TM = P.TransverseMercator(173 * RAD, 0.0, 0.9996, 1.6e6, 1.0e7)


# Fixed values for the SQL side, from the closed formulas in 40-digit arithmetic of the projections queried here.
TM_RADIUS, TM_ALPHA = 6364902.166112739, (0.0008377318247344344, 7.608527788826163e-07, 1.1976380191731534e-09, 2.4433762425103678e-12)
LCC_N, LCC_SIZE, LCC_R0 = 0.6564741723596046, 12242592.025446493, 7329506.805914943
PS_SIZE, EM_SIZE = 12637318.498049943, 4820591.0156223085


def _tm_sql() -> str:
    radius, alpha, xi0 = TM_RADIUS, TM_ALPHA, 0.0
    se = " + ".join(f"{a!r} * cos({2 * (j + 1)} * xi) * sinh({2 * (j + 1)} * et)" for j, a in enumerate(alpha))
    sn = " + ".join(f"{a!r} * sin({2 * (j + 1)} * xi) * cosh({2 * (j + 1)} * et)" for j, a in enumerate(alpha))
    return f"""t AS (SELECT code, sinh({_iso_sql('radians(lat_deg)', E2)}) AS t, radians(lon_deg) - {TM.lon0!r} AS dl FROM fx_stations),
s AS (SELECT code, atan2(t, cos(dl)) AS xi, asinh(sin(dl) / sqrt(t * t + cos(dl) * cos(dl))) AS et FROM t)
SELECT code, round({TM.fe!r} + {radius!r} * (et + {se}), 4) AS easting, round({TM.fn!r} + {radius!r} * (xi + {sn} - {xi0!r}), 4) AS northing FROM s"""


def _there_and_back(t, projection):
    out = projection.inverse(projection.forward(_radians(t), "lon", "lat").select("code", "easting", "northing"), "easting", "northing")
    return out.select("code", F.round(F.degrees("lon"), 9).alias("lon"), F.round(F.degrees("lat"), 9).alias("lat"))


BACK_SQL = ST + "SELECT code, round(lon_deg, 9) AS lon, round(lat_deg, 9) AS lat FROM fx_stations"


@query("transverse_mercator", ST + ", " + _tm_sql())
def _(t):
    return _rounded(TM.forward(_radians(t), "lon", "lat"), 4, "easting", "northing")


@query("transverse_mercator_inverse", BACK_SQL)
def _(t):
    return _there_and_back(t, TM)


LCC = P.LambertConic(-37.5 * RAD, -44.5 * RAD, -41 * RAD, 173 * RAD, 3.0e6, 7.0e6)


def _lcc_sql() -> str:
    n, size, r0 = LCC_N, LCC_SIZE, LCC_R0
    r = f"{size!r} * exp({-n!r} * {_iso_sql('radians(-lat_deg)', E2)})"
    th = f"{n!r} * (radians(lon_deg) - {LCC.lon0!r})"
    return f"SELECT code, round({LCC.fe!r} + {r} * sin({th}), 4) AS easting, round({LCC.fn!r} - ({r0!r} - {r} * cos({th})), 4) AS northing FROM fx_stations"


@query("lambert_conic", ST + _lcc_sql())
def _(t):
    return _rounded(LCC.forward(_radians(t), "lon", "lat"), 4, "easting", "northing")


@query("lambert_conic_inverse", BACK_SQL)
def _(t):
    return _there_and_back(t, LCC)


PS = P.PolarStereographic(170 * RAD, 0.994, 5.0e6, 1.0e6)


@query(
    "polar_stereographic",
    ST + f""", r AS (SELECT code, {PS_SIZE!r} * exp(-{_iso_sql('radians(-lat_deg)', E2)}) AS r, radians(lon_deg) - {PS.lon0!r} AS dl FROM fx_stations)
SELECT code, round({PS.fe!r} + r * sin(dl), 4) AS easting, round({PS.fn!r} + r * cos(dl), 4) AS northing FROM r""",
)
def _(t):
    return _rounded(PS.forward(_radians(t), "lon", "lat"), 4, "easting", "northing")


@query("polar_stereographic_inverse", BACK_SQL)
def _(t):
    return _there_and_back(t, PS)


EM = P.Mercator(160 * RAD, -41 * RAD)


@query(
    "equatorial_mercator",
    ST + f"""SELECT code, round({EM_SIZE!r} * (radians(lon_deg) - {EM.lon0!r}), 4) AS easting, round({EM_SIZE!r} * {_iso_sql('radians(lat_deg)', E2)}, 4) AS northing FROM fx_stations""",
)
def _(t):
    return _rounded(EM.forward(_radians(t), "lon", "lat"), 4, "easting", "northing")


@query("equatorial_mercator_inverse", BACK_SQL)
def _(t):
    return _there_and_back(t, EM)


GN = P.Gnomonic(173 * RAD, -41 * RAD, 1000.0, 2000.0)


@query(
    "gnomonic",
    ST + f""", g AS (SELECT code, radians(lat_deg) AS la, radians(lon_deg) - {GN.lon0!r} AS dl, sin({GN.lat0!r}) AS s0, cos({GN.lat0!r}) AS c0 FROM fx_stations)
SELECT code, round(1000 + {GRS80.a!r} * cos(la) * sin(dl) / (s0 * sin(la) + c0 * cos(la) * cos(dl)), 4) AS easting,
  round(2000 + {GRS80.a!r} * (c0 * sin(la) - s0 * cos(la) * cos(dl)) / (s0 * sin(la) + c0 * cos(la) * cos(dl)), 4) AS northing FROM g""",
)
def _(t):
    return _rounded(GN.forward(_radians(t), "lon", "lat"), 4, "easting", "northing")


@query("gnomonic_inverse", BACK_SQL)
def _(t):
    return _there_and_back(t, GN)


def _nzmg_sql() -> str:
    o = P.NZMG_ORIGIN
    dphi = f"((lat_deg - ({o['lat']!r})) * 3600 * 1e-5)"
    psi = " + ".join(f"({c!r}) * pow({dphi}, {k + 1})" for k, c in enumerate(P.NZMG_LAT))
    text = f"z1 AS (SELECT code, {psi} AS re, radians(lon_deg) - {math.radians(o['lon'])!r} AS im, {psi} AS r1, radians(lon_deg) - {math.radians(o['lon'])!r} AS i1 FROM fx_stations)"
    for k in range(2, 7):
        text += f",\nz{k} AS (SELECT *, r{k - 1} * re - i{k - 1} * im AS r{k}, r{k - 1} * im + i{k - 1} * re AS i{k} FROM z{k - 1})"
    north = " + ".join(f"({a!r}) * r{k + 1} - ({b!r}) * i{k + 1}" for k, (a, b) in enumerate(P.NZMG_FORWARD))
    east = " + ".join(f"({a!r}) * i{k + 1} + ({b!r}) * r{k + 1}" for k, (a, b) in enumerate(P.NZMG_FORWARD))
    a = INTERNATIONAL_1924.a
    return text + f"\nSELECT code, round({o['fe']!r} + {a!r} * ({east}), 4) AS easting, round({o['fn']!r} + {a!r} * ({north}), 4) AS northing FROM z6"


@query("new_zealand_map_grid", ST + ", " + _nzmg_sql())
def _(t):
    return _rounded(P.NewZealandMapGrid().forward(_radians(t), "lon", "lat"), 4, "easting", "northing")


@query("new_zealand_map_grid_inverse")
def _(t):
    return _there_and_back(t, P.NewZealandMapGrid())


OLD = X.Frame("old", INTERNATIONAL_1924, (59.47, -5.04, 187.44), (-0.47, 0.1, -1.024), -4.5993)
MOVING = X.Frame(
    "moving", GRS80, (0.1, -0.2, 0.3), (0.01, 0.02, -0.03), 0.5, 2000.0, (0.001, 0.002, -0.003), (0.0004, -0.0005, 0.0006), 0.01
)
BASE = X.Frame("base", GRS80)


def _frame_sql(frame, span: str) -> str:
    """Rotate about x, y and z in turn, then scale and shift, from ``xyz`` to ``moved``."""
    rot = [f"radians(({r!r} + {span} * {d!r}) / 3600)" for r, d in zip(frame.rotation, frame.rotation_rate)]
    sc = f"(1 + ({frame.scale!r} + {span} * {frame.scale_rate!r}) * 1e-6)"
    tr = [f"({r!r} + {span} * {d!r})" for r, d in zip(frame.shift, frame.shift_rate)]
    return f"""r1 AS (SELECT code, x, y * cos({rot[0]}) + z * sin({rot[0]}) AS y, z * cos({rot[0]}) - y * sin({rot[0]}) AS z FROM xyz),
r2 AS (SELECT code, x * cos({rot[1]}) - z * sin({rot[1]}) AS x, y, z * cos({rot[1]}) + x * sin({rot[1]}) AS z FROM r1),
r3 AS (SELECT code, x * cos({rot[2]}) + y * sin({rot[2]}) AS x, y * cos({rot[2]}) - x * sin({rot[2]}) AS y, z FROM r2),
moved AS (SELECT code, x * {sc} + {tr[0]} AS x, y * {sc} + {tr[1]} AS y, z * {sc} + {tr[2]} AS z FROM r3)
"""


@query(
    "frame_transformation",
    ST + ", " + GEOC + ", " + _frame_sql(MOVING, "(2015.5 - 2000.0)") + "SELECT code, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM moved",
)
def _(t):
    xyz = with_geocentric(_radians(t), "lon", "lat", "hgt", GRS80)
    return _rounded(X.to_base(xyz, MOVING, "x", "y", "z", F.lit(2015.5)), 4, "x", "y", "z")


@query("frame_transformation_inverse", ST + ", " + GEOC + "SELECT code, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM xyz")
def _(t):
    xyz = with_geocentric(_radians(t), "lon", "lat", "hgt", GRS80)
    there = X.to_base(xyz, MOVING, "x", "y", "z", F.lit(2015.5))
    return _rounded(X.from_base(there, MOVING, "x", "y", "z", F.lit(2015.5)), 4, "x", "y", "z")


GRID = G.Grid(166.5, -46.5, 0.5, 0.5, 25, 25)


def _geoid(nodes):
    def surface(df, lon, lat):
        return G.interpolate(df, nodes, GRID, lon, lat, ["v"]), F.col("v")

    return surface


def _systems(t):
    datum = X.VerticalDatum("local", 0.25, None, X.VerticalDatum("geoid", 0.0, _geoid(t.grid)))
    geodetic = X.CoordinateSystem("geodetic", "geodetic", OLD, vertical=None)
    grid = X.CoordinateSystem("grid", "projected", BASE, TM, datum, (166.0, -48.0, 178.0, -34.5))
    return geodetic, grid


@query("bulk_conversion_with_status")
def _(t):
    geodetic, grid = _systems(t)
    df = t.stations.withColumn("h", F.col("ohgt") + F.col("und"))
    out = X.convert(df, geodetic, grid, ("lon_deg", "lat_deg", "h"), ("easting", "northing", "height"))
    return out.select("code", *[F.round(c, 4).alias(c) for c in ("easting", "northing", "height")], "status")


@query(
    "bulk_conversion_round_trip",
    ST + """SELECT code, round(lon_deg, 9) AS lon, round(lat_deg, 9) AS lat, round(ohgt + und, 4) AS h FROM fx_stations
WHERE lat_deg BETWEEN -46 AND -34.6""",
)
def _(t):
    geodetic, grid = _systems(t)
    df = t.stations.filter("lat_deg BETWEEN -46 AND -34.6").withColumn("h", F.col("ohgt") + F.col("und"))
    there = X.convert(df, geodetic, grid, ("lon_deg", "lat_deg", "h"), ("easting", "northing", "height")).filter("status = 'ok'")
    back = X.convert(there.select("code", "easting", "northing", "height"), grid, geodetic, ("easting", "northing", "height"), ("lon", "lat", "h"))
    return back.select("code", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), F.round("h", 4).alias("h"))


BILINEAR = """c AS (SELECT *, (lon_deg - 166.5) / 0.5 AS cx, (lat_deg + 46.5) / 0.5 AS cy FROM fx_stations),
f AS (SELECT *, CAST(floor(cx) AS BIGINT) AS ix, CAST(floor(cy) AS BIGINT) AS iy, cx - floor(cx) AS fx, cy - floor(cy) AS fy FROM c),
v AS (SELECT f.*, a.v AS v00, b.v AS v01, c2.v AS v10, d.v AS v11 FROM f
  LEFT JOIN fx_grid a ON a.iy = f.iy AND a.ix = f.ix LEFT JOIN fx_grid b ON b.iy = f.iy AND b.ix = f.ix + 1
  LEFT JOIN fx_grid c2 ON c2.iy = f.iy + 1 AND c2.ix = f.ix LEFT JOIN fx_grid d ON d.iy = f.iy + 1 AND d.ix = f.ix + 1)
"""
BIVALUE = "((1 - fy) * ((1 - fx) * v00 + fx * v01) + fy * ((1 - fx) * v10 + fx * v11))"


@query(
    "bilinear_grid_value",
    SG + ", " + BILINEAR + f"SELECT code, round({BIVALUE}, 7) AS v, CASE WHEN iy + 1 >= 25 OR ix + 1 >= 25 THEN 'range' WHEN {BIVALUE} IS NULL THEN 'missing' ELSE 'ok' END AS grid_status FROM v",
)
def _(t):
    out = G.interpolate(t.stations, t.grid, GRID, "lon_deg", "lat_deg", ["v"])
    return out.select("code", F.round("v", 7).alias("v"), "grid_status")


@query(
    "bicubic_grid_value",
    SG + """, c AS (SELECT code, (lon_deg - 166.5) / 0.5 AS cx, (lat_deg + 46.5) / 0.5 AS cy FROM fx_stations),
f AS (SELECT code, CAST(floor(cx) AS BIGINT) AS ix, CAST(floor(cy) AS BIGINT) AS iy, cx - floor(cx) AS x, cy - floor(cy) AS y FROM c),
w AS (SELECT f.*, [-x*(x-1)*(x-2)/6, (x+1)*(x-1)*(x-2)/2, -(x+1)*x*(x-2)/2, (x+1)*x*(x-1)/6] AS wx,
  [-y*(y-1)*(y-2)/6, (y+1)*(y-1)*(y-2)/2, -(y+1)*y*(y-2)/2, (y+1)*y*(y-1)/6] AS wy FROM f)
SELECT w.code, round(sum(g.v * w.wx[g.ix - w.ix + 2] * w.wy[g.iy - w.iy + 2]), 6) AS v, 'ok' AS grid_status
FROM w JOIN fx_grid g ON g.ix BETWEEN w.ix - 1 AND w.ix + 2 AND g.iy BETWEEN w.iy - 1 AND w.iy + 2
WHERE w.ix >= 1 AND w.ix + 2 < 25 AND w.iy >= 1 AND w.iy + 2 < 25 GROUP BY w.code
UNION ALL SELECT code, NULL, 'range' FROM w WHERE NOT (ix >= 1 AND ix + 2 < 25 AND iy >= 1 AND iy + 2 < 25)""",
)
def _(t):
    out = G.interpolate(t.stations, t.grid, GRID, "lon_deg", "lat_deg", ["v"], cubic=True)
    return out.select("code", F.round("v", 6).alias("v"), "grid_status")


@query(
    "grid_value_missing_nodes_and_wrap",
    SG + ", g0 AS (SELECT * FROM fx_grid WHERE (iy + ix) % 5 <> 0), " + BILINEAR.replace("fx_grid", "g0")
    + f"SELECT code, round({BIVALUE}, 7) AS v, CASE WHEN iy + 1 >= 25 OR ix + 1 >= 25 THEN 'range' WHEN {BIVALUE} IS NULL THEN 'missing' ELSE 'ok' END AS grid_status FROM v",
)
def _(t):
    holes = t.grid.filter("(iy + ix) % 5 <> 0")
    shifted = t.stations.withColumn("lon_deg", F.col("lon_deg") - 360.0)
    out = G.interpolate(shifted, holes, GRID, "lon_deg", "lat_deg", ["v"])
    return out.select("code", F.round("v", 7).alias("v"), "grid_status")


@query(
    "station_geoid_heights",
    SG + ", " + BILINEAR + f"""SELECT code, round(coalesce({BIVALUE}, und), 6) AS und, round(ohgt + und - coalesce({BIVALUE}, und), 6) AS ohgt,
  CASE WHEN {BIVALUE} IS NULL THEN 'range' ELSE 'ok' END AS geoid_status FROM v""",
)
def _(t):
    nodes = t.grid.withColumnRenamed("v", "und")
    out = G.geoid_heights(t.stations, nodes, GRID, "lon_deg", "lat_deg")
    return out.select("code", F.round("und", 6).alias("und"), F.round("ohgt", 6).alias("ohgt"), "geoid_status")


@query(
    "station_geoid_heights_keeping_existing",
    SG + ", " + BILINEAR + f"""SELECT code, round(CASE WHEN und < 20 THEN {BIVALUE} ELSE und END, 6) AS und, ohgt FROM v""",
)
def _(t):
    nodes = t.grid.withColumnRenamed("v", "und")
    some = t.stations.withColumn("und", F.when(F.col("und") >= 20, F.col("und")))
    out = G.geoid_heights(some, nodes, GRID, "lon_deg", "lat_deg", keep_existing=True, preserve="orthometric")
    return out.select("code", F.round("und", 6).alias("und"), "ohgt")


@query(
    "grid_frame_shift",
    SG + ", " + BILINEAR + f"SELECT code, round(lon_deg + {BIVALUE} * 1e-5, 9) AS lon, round(lat_deg - {BIVALUE} * 2e-5, 9) AS lat FROM v",
)
def _(t):
    nodes = t.grid.select("iy", "ix", (F.col("v") * 1e-5).alias("dlon"), (F.col("v") * -2e-5).alias("dlat"))
    out = G.shift_by_grid(t.stations, nodes, GRID, "lon_deg", "lat_deg")
    return out.select("code", F.round("lon_deg", 9).alias("lon"), F.round("lat_deg", 9).alias("lat"))


@query(
    "grid_frame_shift_inverse",
    SG + ", " + BILINEAR + f""", s1 AS (SELECT code, lon_deg AS lon0, lat_deg AS lat0, lon_deg - {BIVALUE} * 1e-5 AS lon_deg, lat_deg + {BIVALUE} * 2e-5 AS lat_deg FROM v),
{BILINEAR.replace('fx_stations', 's1').replace('c AS', 'cc AS').replace('FROM c)', 'FROM cc)').replace('f AS', 'ff AS', 1).replace(' FROM f ', ' FROM ff f ').replace('FROM f\n', 'FROM ff f\n').replace('v AS (', 'vv AS (', 1)}
SELECT code, round(lon0 - {BIVALUE} * 1e-5, 9) AS lon, round(lat0 + {BIVALUE} * 2e-5, 9) AS lat FROM vv""",
)
def _(t):
    nodes = t.grid.select("iy", "ix", (F.col("v") * 1e-5).alias("dlon"), (F.col("v") * -2e-5).alias("dlat"))
    out = G.shift_by_grid(t.stations, nodes, GRID, "lon_deg", "lat_deg", inverse=True)
    return out.select("code", F.round("lon_deg", 9).alias("lon"), F.round("lat_deg", 9).alias("lat"))


@query(
    "velocity_grid_displacement",
    SG + ", " + BILINEAR + f"""SELECT code, round({BIVALUE} * 0.001 * 12.5, 8) AS de, round({BIVALUE} * -0.002 * 12.5, 8) AS dn, CASE WHEN {BIVALUE} IS NOT NULL THEN 0.0E0 END AS du FROM v""",
)
def _(t):
    nodes = t.grid.select("iy", "ix", (F.col("v") * 0.001).alias("ve"), (F.col("v") * -0.002).alias("vn"))
    out = G.velocity_displacement(t.stations, nodes, GRID, "lon_deg", "lat_deg", F.lit(2012.5) - 2000.0)
    return out.select("code", F.round("de", 8).alias("de"), F.round("dn", 8).alias("dn"), "du")


def _triangles(t):
    """Two triangles per grid square of whole-degree corners, with heights from the grid's values."""
    n = t.grid.filter("iy % 2 = 0 AND ix % 2 = 0").select("iy", "ix", "v")
    b = n.select(F.col("iy").alias("iy"), (F.col("ix") - 2).alias("ix"), F.col("v").alias("vb"))
    c = n.select((F.col("iy") - 2).alias("iy"), F.col("ix").alias("ix"), F.col("v").alias("vc"))
    d = n.select((F.col("iy") - 2).alias("iy"), (F.col("ix") - 2).alias("ix"), F.col("v").alias("vd"))
    q = n.join(b, ["iy", "ix"]).join(c, ["iy", "ix"]).join(d, ["iy", "ix"])
    x, y = 166.5 + F.col("ix") * 0.5, -46.5 + F.col("iy") * 0.5

    def tri(k, p1, p2, p3):
        cols = [(F.col("iy") * 1000 + F.col("ix") * 10 + k).alias("tri_id")]
        for i, (px, py, v) in enumerate((p1, p2, p3)):
            cols += [px.alias(f"x{i + 1}"), py.alias(f"y{i + 1}"), F.array(F.col(v)).alias(f"v{i + 1}")]
        return q.select(*cols)

    lower = tri(0, (x, y, "v"), (x + 1.0, y, "vb"), (x, y + 1.0, "vc"))
    upper = tri(1, (x + 1.0, y + 1.0, "vd"), (x, y + 1.0, "vc"), (x + 1.0, y, "vb"))
    return lower.unionByName(upper)


@query(
    "triangle_interpolation",
    SG + """, c AS (SELECT code, CAST(floor((lon_deg - 166.5)) * 2 AS BIGINT) AS ix, CAST(floor((lat_deg + 46.5)) * 2 AS BIGINT) AS iy,
  (lon_deg - 166.5) - floor(lon_deg - 166.5) AS x, (lat_deg + 46.5) - floor(lat_deg + 46.5) AS y FROM fx_stations)
SELECT c.code, CASE WHEN a.v IS NULL OR b.v IS NULL OR d.v IS NULL OR e.v IS NULL THEN NULL WHEN x + y <= 1 THEN c.iy * 1000 + c.ix * 10 ELSE c.iy * 1000 + c.ix * 10 + 1 END AS tri_id,
  round(CASE WHEN x + y <= 1 THEN (1 - x - y) * a.v + x * b.v + y * d.v ELSE (x + y - 1) * e.v + (1 - x) * d.v + (1 - y) * b.v END, 6) AS v
FROM c LEFT JOIN fx_grid a ON a.iy = c.iy AND a.ix = c.ix LEFT JOIN fx_grid b ON b.iy = c.iy AND b.ix = c.ix + 2
LEFT JOIN fx_grid d ON d.iy = c.iy + 2 AND d.ix = c.ix LEFT JOIN fx_grid e ON e.iy = c.iy + 2 AND e.ix = c.ix + 2""",
)
def _(t):
    out = G.triangle_values(t.stations, _triangles(t), "code", "lon_deg", "lat_deg", 1)
    return out.select("code", "tri_id", F.round(F.element_at("tri_value", 1), 6).alias("v"))


def _model(t):
    """Sequences and components from the nations: extents of some degrees, ramps over some years, one shared grid."""
    n = t.nation
    seq = n.filter("n_nationkey % 5 = 0").select(
        F.concat(F.lit("Q"), "n_nationkey").alias("seq_id"),
        (1990.0 + F.col("n_nationkey") % 3).alias("start_year"), (2010.0 + F.col("n_nationkey")).alias("end_year"),
        (F.col("n_nationkey") % 10 == 5).alias("nested"), F.lit(True).alias("zero_beyond"),
    )
    k = F.col("n_nationkey")
    comp = n.select(
        F.concat(F.lit("Q"), k - k % 5).alias("seq_id"), k.alias("comp_no"), F.lit("g").alias("grid_id"),
        (166.5 + (k % 7)).alias("x_min"), (171.5 + (k % 7)).alias("x_max"), (-46.5 + (k % 5)).alias("y_min"), (-41.5 + (k % 5)).alias("y_max"),
        F.lit(0.0).alias("factor0"),
        F.array(
            F.struct((1995.0 + k % 4).alias("year"), F.lit(0.0).alias("factor")),
            F.struct((2000.0 + k % 4).alias("year"), F.lit(0.5).alias("factor")),
            F.struct((2005.0 + k % 4).alias("year"), F.lit(1.0).alias("factor")),
        ).alias("time_points"),
    )
    meta = n.select(F.lit("g").alias("grid_id")).distinct().withColumns(GRID.columns)
    nodes = t.grid.select(F.lit("g").alias("grid_id"), "iy", "ix", (F.col("v") * 0.01).alias("de"), (F.col("v") * 0.02).alias("dn"), F.lit(0.0).alias("du"))
    return seq, comp, meta, nodes


@query(
    "deformation_model_displacement",
    SG + ", " + BILINEAR + f""", seq AS (SELECT concat('Q', n_nationkey) AS seq_id, 1990.0E0 + n_nationkey % 3 AS start_year, 2010.0E0 + n_nationkey AS end_year, n_nationkey % 10 = 5 AS nested
  FROM nation WHERE n_nationkey % 5 = 0),
comp AS (SELECT n_nationkey AS k, concat('Q', n_nationkey - n_nationkey % 5) AS seq_id, 166.5 + n_nationkey % 7 AS x0, 171.5 + n_nationkey % 7 AS x1,
  -46.5 + n_nationkey % 5 AS y0, -41.5 + n_nationkey % 5 AS y1, 1995.0E0 + n_nationkey % 4 AS t0 FROM nation),
p AS (SELECT v.code, {BIVALUE} AS g, lon_deg, lat_deg, 1994.0E0 + (ohgt % 1700) / 100 AS year FROM v),
hit AS (SELECT p.code, g, nested, s.seq_id, c.k, row_number() OVER (PARTITION BY p.code, s.seq_id ORDER BY c.k) AS rn,
  CASE WHEN year <= t0 THEN 0 WHEN year > t0 + 10 THEN 1 ELSE (year - t0) / 10 END AS f
  FROM p JOIN comp c ON lon_deg BETWEEN x0 AND x1 AND lat_deg BETWEEN y0 AND y1 JOIN seq s ON c.seq_id = s.seq_id AND year BETWEEN start_year AND end_year),
d AS (SELECT code, sum(f * g) AS fg FROM hit WHERE NOT nested OR rn = 1 GROUP BY code)
SELECT p.code, round(coalesce(fg, 0) * 0.01, 7) AS de, round(coalesce(fg, 0) * 0.02, 7) AS dn, 'ok' AS deform_status FROM p LEFT JOIN d ON p.code = d.code""",
)
def _(t):
    points = t.stations.select("code", "lon_deg", "lat_deg", (1994.0 + (F.col("ohgt") % 1700) / 100).alias("year"))
    seq, comp, meta, nodes = _model(t)
    out = DF.model_displacement(points, seq, comp, meta, nodes, "code", "lon_deg", "lat_deg", "year")
    return out.select("code", F.round("de", 7).alias("de"), F.round("dn", 7).alias("dn"), "deform_status")


RATES = DF.euler_rates(32.0, -178.0, 0.64)


def _motion_sql(rates, years: str) -> str:
    _, m = rates
    d = [" + ".join(f"({m[i][j]!r}) * {a}0" for j, a in enumerate("xyz")) for i in range(3)]
    return f"""b AS (SELECT code, lo, la, nu * cos(la) * cos(lo) AS x0, nu * cos(la) * sin(lo) AS y0, nu * (1 - {E2!r}) * sin(la) AS z0 FROM nu),
m AS (SELECT code, lo, la, ({d[0]}) * {years} AS dx, ({d[1]}) * {years} AS dy, ({d[2]}) * {years} AS dz FROM b),
enu AS (SELECT code, lo, la, dy * cos(lo) - dx * sin(lo) AS de, dz * cos(la) - sin(la) * (dx * cos(lo) + dy * sin(lo)) AS dn,
  dz * sin(la) + cos(la) * (dx * cos(lo) + dy * sin(lo)) AS du FROM m)
"""


@query(
    "plate_motion_displacement",
    ST + ", " + GEOC.split("xyz AS")[0].rstrip().rstrip(",") + ", " + _motion_sql(RATES, "20.0") + "SELECT code, round(de, 7) AS de, round(dn, 7) AS dn, round(du, 7) AS du FROM enu",
)
def _(t):
    de, dn, du = DF.motion_displacement(F.col("lon"), F.col("lat"), F.lit(20.0), RATES)
    return _rounded(_radians(t).withColumns({"de": de, "dn": dn, "du": du}), 7, "de", "dn", "du")


@query(
    "epoch_shift",
    ST + ", " + GEOC.split("xyz AS")[0].rstrip().rstrip(",") + ", " + _motion_sql(RATES, "(-15.0)")
    + f"""SELECT code, round(degrees(lo + de / ({GRS80.a!r} / sqrt(1 - {E2!r} * sin(la) * sin(la)) * cos(la))), 9) AS lon,
  round(degrees(la + dn / ({GRS80.a * (1 - E2)!r} / pow(1 - {E2!r} * sin(la) * sin(la), 1.5))), 9) AS lat FROM enu""",
)
def _(t):
    out = DF.epoch_shift(_radians(t), "lon", "lat", "hgt", F.lit(2015.0), F.lit(2000.0), 2010.0, RATES)
    return out.select("code", F.round(F.degrees("lon"), 9).alias("lon"), F.round(F.degrees("lat"), 9).alias("lat"))


@query(
    "network_topocentre",
    ST + """, s AS (SELECT sum(cos(radians(lat_deg)) * cos(radians(lon_deg))) AS x, sum(cos(radians(lat_deg)) * sin(radians(lon_deg))) AS y, sum(sin(radians(lat_deg))) AS z FROM fx_stations)
SELECT round(degrees(atan2(y, x)), 8) AS lon, round(degrees(atan2(z, sqrt(x * x + y * y))), 8) AS lat FROM s""",
)
def _(t):
    return DF.topocentre(_radians(t)).select(F.round(F.degrees("lon"), 8).alias("lon"), F.round(F.degrees("lat"), 8).alias("lat"))


OFFS = with_views("obs", "stations") + """, uses AS (SELECT DISTINCT from_code AS code, CAST(date_diff('day', DATE '1970-01-01', CAST(obs_ts AS DATE)) AS DOUBLE) AS day FROM fx_obs
  WHERE obs_ts IS NOT NULL AND data_file = 'FA')"""


@query(
    "station_time_series_offsets",
    OFFS + """SELECT u.code, u.day, round(CASE WHEN k % 3 = 0 AND day >= 9500 + k THEN k * 0.001 ELSE 0 END
  + CASE WHEN k % 3 = 1 THEN (day - 9000) / 365.25 * k * 0.0001 ELSE 0 END
  + CASE WHEN k % 3 = 2 THEN CASE WHEN day < 9200 THEN 0.5 WHEN day < 9800 THEN k * 0.001 * (9800 - day) / 600 + k * 0.002 * (day - 9200) / 600 ELSE k * 0.002 END ELSE 0 END, 8) AS d1
FROM (SELECT code, day, CAST(substr(code, 2) AS BIGINT) AS k FROM uses) u""",
)
def _(t):
    k = F.substring("code", 2, 20).cast("long")
    arr = lambda v: F.array(v, F.lit(0.0), F.lit(0.0))
    point = lambda d, v: F.struct(F.lit(d).cast("double").alias("day"), arr(v).alias("v"))
    offsets = t.stations.select(
        "code", F.lit("enu").alias("frame"),
        F.element_at(F.array(F.lit("step"), F.lit("velocity"), F.lit("series")), (k % 3 + 1).cast("int")).alias("mode"),
        F.when(k % 3 == 0, 9500.0 + k).otherwise(9000.0).alias("day"),
        F.when(k % 3 == 0, arr(k * 0.001)).when(k % 3 == 1, arr(k * 0.0001)).otherwise(arr(F.lit(0.5))).alias("base"),
        F.when(k % 3 == 2, F.array(point(9200, k * 0.001), point(9800, k * 0.002))).alias("points"),
    )
    uses = t.obs.filter("obs_ts IS NOT NULL AND data_file = 'FA'").select(
        F.col("from_code").alias("code"), D.day_number(F.col("obs_ts")).alias("day")
    ).distinct()
    out = DF.station_offsets(uses, DF.offset_segments(offsets))
    return out.select("code", "day", F.round("d1", 8).alias("d1"))


@query(
    "angle_text_to_degrees",
    ST + """, p AS (SELECT code, CAST(floor(-lat_deg * 3600) AS BIGINT) AS s FROM fx_stations)
SELECT code, round(-(s // 3600 + (s // 60 % 60) / 60.0 + (s % 60 + 0.25) / 3600.0), 9) AS dms, round(s // 3600 + (s // 60 % 60) / 60.0 + (s % 60 + 0.25) / 3600.0, 9) AS hp,
  round(-s / 3600.0, 9) AS dec FROM p""",
)
def _(t):
    s = F.floor(-F.col("lat_deg") * 3600).cast("long")
    d, m, c = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    df = t.stations.select(
        "code",
        F.concat_ws(" ", d.cast("string"), m.cast("string"), F.concat(c.cast("string"), F.lit(".25")), F.lit("S")).alias("dms"),
        F.concat(d.cast("string"), F.lit("."), two(m), two(c), F.lit("25")).alias("hp"),
        F.concat(F.lit("-"), F.round(s / 3600, 12).cast("decimal(20,12)").cast("string")).alias("dec"),
    )
    return df.select(
        "code",
        F.round(AN.parse_dms(F.col("dms"), "NS"), 9).alias("dms"),
        F.round(AN.parse_hp(F.col("hp")), 9).alias("hp"),
        F.round(AN.parse_coordinate_text(F.col("dec"), "NS"), 9).alias("dec"),
    )


@query(
    "degrees_to_angle_text",
    ST + """, p AS (SELECT code, CAST(round(-lat_deg * 36000) AS BIGINT) AS u FROM fx_stations)
SELECT code, concat(u // 36000, ' ', lpad(CAST(u // 600 % 60 AS VARCHAR), 2, '0'), ' ', lpad(CAST(u // 10 % 60 AS VARCHAR), 2, '0'), '.', u % 10, ' S') AS dms FROM p""",
)
def _(t):
    return t.stations.select("code", AN.format_dms(F.col("lat_deg"), 1, "NS").alias("dms"))


@query(
    "date_text_to_days",
    """SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) + 0.5 AS ymd,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS dmy, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS yd,
  round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / (CASE WHEN year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) THEN 366.0 ELSE 365.0 END), 9) AS years
FROM orders""",
)
def _(t):
    ts = F.col("o_orderdate")
    df = t.orders.select(
        "o_orderkey",
        F.date_format(ts, "yyyy-MM-dd' 12:00:00'").alias("ymd"),
        F.date_format(ts, "dd MMM yyyy").alias("dmy"),
        F.date_format(ts, "yyyy.DDD").alias("yd"),
        ts.alias("ts"),
    )
    return df.select(
        "o_orderkey",
        D.parse_date(F.col("ymd")).cast("double").alias("ymd"),
        D.parse_date(F.col("dmy")).cast("double").alias("dmy"),
        D.parse_year_day(F.col("yd")).alias("yd"),
        F.round(D.decimal_year(F.col("ts")), 9).alias("years"),
    )
