"""Approximate positions."""

from pyspark.sql import functions as F

from cairn.catalog import query
from cairn.fixtures import with_views
from cairn.operators import fix as X

PL = with_views("lines") + """, l AS (SELECT *, (t_lon - f_lon) * 8.0E4 AS dx, (t_lat - f_lat) * 1.1E5 AS dy, t_ohgt - f_ohgt AS dh, line_no % 4 AS k FROM fx_lines),
o AS (SELECT from_code, to_code, CASE k WHEN 0 THEN 'vector' WHEN 1 THEN 'distance' WHEN 2 THEN 'azimuth' ELSE 'height' END AS kind,
  CASE k WHEN 1 THEN sqrt(dx * dx + dy * dy) + noise WHEN 2 THEN CASE WHEN atan2(dx, dy) < 0 THEN atan2(dx, dy) + 2 * pi() ELSE atan2(dx, dy) END + noise * 1e-3 WHEN 3 THEN dh + noise END AS value, dx, dy, dh FROM l)
"""


def plane_observations(t):
    dx, dy, dh = (F.col("t_lon") - F.col("f_lon")) * 8.0e4, (F.col("t_lat") - F.col("f_lat")) * 1.1e5, F.col("t_ohgt") - F.col("f_ohgt")
    df = t.lines.withColumns({"dx": dx, "dy": dy, "dh": dh, "k": F.col("line_no") % 4})
    az = F.atan2("dx", "dy")
    az = F.when(az < 0, az + 2 * 3.141592653589793).otherwise(az)
    kind = F.element_at(F.array(F.lit("vector"), F.lit("distance"), F.lit("azimuth"), F.lit("height")), (F.col("k") + 1).cast("int"))
    value = F.when(F.col("k") == 1, F.hypot("dx", "dy") + F.col("noise")).when(F.col("k") == 2, az + F.col("noise") * 1e-3).when(F.col("k") == 3, F.col("dh") + F.col("noise"))
    return df.select("from_code", "to_code", kind.alias("kind"), value.alias("value"), "dx", "dy", "dh")


def plane_stations(t, every=4):
    n = F.substring("code", 2, 20).cast("long")
    keep = lambda c: F.when(n % every == 0, c)
    return t.stations.select(
        "code", keep((F.col("lon_deg") - 167) * 8.0e4).alias("x"), keep((F.col("lat_deg") + 46) * 1.1e5).alias("y"), keep(F.col("ohgt")).alias("h")
    )


@query(
    "line_summary",
    PL + """, d AS (SELECT least(from_code, to_code) AS a, greatest(from_code, to_code) AS b, kind, value, CASE WHEN from_code < to_code THEN 1.0E0 ELSE -1.0E0 END AS s, dx, dy, dh FROM o)
SELECT a, b, round(avg(dx * s) FILTER (kind = 'vector'), 4) AS dx, round(avg(value) FILTER (kind = 'distance'), 4) AS distance, round(avg(value * s) FILTER (kind = 'height'), 7) AS height,
  round(avg(sin(value + CASE WHEN s < 0 THEN pi() ELSE 0 END)) FILTER (kind = 'azimuth'), 7) AS sin_azimuth, count(*) AS n FROM d GROUP BY a, b""",
)
def _(t):
    out = X.line_summary(plane_observations(t))
    return out.select(
        "a", "b", F.round("dx", 4).alias("dx"), F.round("distance", 4).alias("distance"), F.round("height", 7).alias("height"), F.round(F.sin("azimuth"), 7).alias("sin_azimuth"), "n"
    )


@query(
    "zenith_to_height_difference",
    with_views("lines") + """SELECT obs_key, round(1000 * cos(1.5 + noise) / sin(1.5 + noise) + 1000.0 * 1000.0 * 0.87 / (2 * 6371000.0) + 1.5 - 2.0, 6) AS dh FROM fx_lines""",
)
def _(t):
    dh = X.zenith_to_height(F.col("noise") + 1.5, F.lit(1000.0), F.lit(1.5), F.lit(2.0), 0.13)
    return t.lines.select("obs_key", F.round(dh, 6).alias("dh"))


FR = PL + """, p AS (SELECT code, (lon_deg - 167) * 8.0E4 AS x, (lat_deg + 46) * 1.1E5 AS y, ohgt AS h FROM fx_stations WHERE CAST(substr(code, 2) AS BIGINT) % 4 = 0),
d AS (SELECT least(from_code, to_code) AS a, greatest(from_code, to_code) AS b, kind, value, CASE WHEN from_code < to_code THEN 1.0E0 ELSE -1.0E0 END AS s, dx, dy, dh FROM o),
m AS (SELECT a, b, avg(dx * s) FILTER (kind = 'vector') AS dx, avg(dy * s) FILTER (kind = 'vector') AS dy, avg(value) FILTER (kind = 'distance') AS ds, avg(value * s) FILTER (kind = 'height') AS dh, avg(dh * s) FILTER (kind = 'vector') AS vh,
  atan2(avg(sin(value + CASE WHEN s < 0 THEN pi() ELSE 0 END)) FILTER (kind = 'azimuth'), avg(cos(value + CASE WHEN s < 0 THEN pi() ELSE 0 END)) FILTER (kind = 'azimuth')) AS az FROM d GROUP BY a, b),
e AS (SELECT a AS code, b AS other, dx, dy, ds, az, dh, vh FROM m UNION ALL SELECT b, a, -dx, -dy, ds, az + pi(), -dh, -vh FROM m),
f AS (SELECT e.*, p.x AS ox, p.y AS oy, p.h AS oh FROM e JOIN p ON e.other = p.code WHERE e.code NOT IN (SELECT code FROM p))
"""


def _frontier(t):
    return X._frontier(X.both_ways(X.line_summary(plane_observations(t))), plane_stations(t))


@query("positions_from_vectors", FR + "SELECT code, round(avg(ox - dx), 3) AS x, round(avg(oy - dy), 3) AS y, count(dx) AS n FROM f WHERE dx IS NOT NULL GROUP BY code")
def _(t):
    out = X.fix_by_vectors(_frontier(t))
    return out.select("code", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "n")


@query("heights_from_differences", FR + "SELECT code, round(avg(oh - coalesce(dh, vh)) + 1.1E-8, 6) AS h, count(*) AS n FROM f WHERE coalesce(dh, vh) IS NOT NULL GROUP BY code")
def _(t):
    out = X.fix_heights(X.both_ways(X.line_summary(plane_observations(t))), plane_stations(t))
    # The shift keeps means of microns off the rounding ties.
    return out.select("code", F.round(F.col("h") + 1.1e-8, 6).alias("h"), "n")


@query(
    "positions_by_polar_fix",
    FR + "SELECT code, round(avg(ox - ds * sin(az)), 3) AS x, round(avg(oy - ds * cos(az)), 3) AS y, count(*) AS n FROM f WHERE ds IS NOT NULL AND az IS NOT NULL GROUP BY code",
)
def _(t):
    out = X.fix_by_polar(_frontier(t))
    return out.select("code", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "n")


@query(
    "positions_by_bearing_intersection",
    FR + """, s AS (SELECT code, sum(cos(az) * cos(az)) AS cc, sum(-sin(az) * cos(az)) AS sc, sum(sin(az) * sin(az)) AS ss, sum(cos(az) * (ox * cos(az) - oy * sin(az))) AS ct,
  sum(-sin(az) * (ox * cos(az) - oy * sin(az))) AS st, count(*) AS n FROM f WHERE az IS NOT NULL GROUP BY code)
SELECT code, round((ct * ss - st * sc) / (cc * ss - sc * sc), 2) AS x, round((cc * st - sc * ct) / (cc * ss - sc * sc), 2) AS y, n FROM s WHERE n >= 2 AND cc * ss - sc * sc > 0.0025""",
)
def _(t):
    out = X.fix_by_bearings(_frontier(t))
    return out.select("code", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), "n")


@query(
    "positions_by_distances",
    FR + """, h AS (SELECT code, ox, oy, ox * ox + oy * oy - ds * ds AS k FROM f WHERE ds IS NOT NULL),
g AS (SELECT code, avg(ox) AS mx, avg(oy) AS my, avg(k) AS mk, count(*) AS n FROM h GROUP BY code HAVING count(*) >= 3),
s AS (SELECT code, n, sum((ox - mx) * (ox - mx)) AS uu, sum((ox - mx) * (oy - my)) AS uv, sum((oy - my) * (oy - my)) AS vv, sum((ox - mx) * (k - mk) / 2) AS uk, sum((oy - my) * (k - mk) / 2) AS vk
  FROM h JOIN g USING (code) GROUP BY code, n)
SELECT code, round((uk * vv - vk * uv) / (uu * vv - uv * uv), 2) AS x, round((uu * vk - uv * uk) / (uu * vv - uv * uv), 2) AS y, n FROM s WHERE uu * vv - uv * uv > 0.0025 * uu * vv + 1.0E-12""",
)
def _(t):
    out = X.fix_by_distances(_frontier(t))
    return out.select("code", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), "n")


@query(
    "best_candidate_fix",
    FR + """, v AS (SELECT DISTINCT code FROM f WHERE dx IS NOT NULL), po AS (SELECT DISTINCT code FROM f WHERE ds IS NOT NULL AND az IS NOT NULL)
SELECT code, CASE WHEN code IN (SELECT code FROM v) THEN 'vector' ELSE 'polar' END AS method FROM (SELECT code FROM v UNION SELECT code FROM po)""",
)
def _(t):
    fr = _frontier(t)
    return X.rank_candidates(X.fix_by_vectors(fr).unionByName(X.fix_by_polar(fr))).select("code", "method")


@query("approximate_positions")
def _(t):
    out = X.fix_positions(X.line_summary(plane_observations(t)), plane_stations(t, 50))
    return out.select("code", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.round("h", 2).alias("h"), "method", "step")


@query(
    "unfixed_stations",
    with_views("stations") + "SELECT code, true AS no_plan, true AS no_height FROM fx_stations WHERE CAST(substr(code, 2) AS BIGINT) % 4 <> 0",
)
def _(t):
    return X.unfixed_stations(plane_stations(t))


def _rounds(t):
    """Directions of one round per order: the round's zero is an arbitrary turn."""
    dx, dy = (F.col("t_lon") - F.col("f_lon")) * 8.0e4, (F.col("t_lat") - F.col("f_lat")) * 1.1e5
    return t.lines.select(
        F.col("set_id").alias("round_id"), F.col("from_code").alias("code"), F.col("to_code").alias("other"),
        (F.atan2(dx, dy) - (F.col("order_no") % 6)).alias("reading"), "order_no",
    )


@query(
    "round_orientations",
    with_views("lines") + """, k AS (SELECT DISTINCT set_id, order_no FROM fx_lines)
SELECT set_id AS round_id, round(sin(order_no % 6), 6) AS sin_o, round(cos(order_no % 6), 6) AS cos_o FROM k""",
)
def _(t):
    rounds = _rounds(t)
    seeds = rounds.filter("order_no % 3 = 0").select("code", "other", (F.col("reading") + F.col("order_no") % 6).alias("azimuth"))
    more = rounds.filter("order_no % 3 <> 0").groupBy("round_id").agg(F.min(F.struct("other", "code", "reading", "order_no")).alias("s"))
    more = more.select("s.code", "s.other", (F.col("s.reading") + F.col("s.order_no") % 6).alias("azimuth"))
    out = X.orient_rounds(rounds, seeds.unionByName(more))
    return out.select("round_id", F.round(F.sin("orientation"), 6).alias("sin_o"), F.round(F.cos("orientation"), 6).alias("cos_o"))


@query("positions_by_resection")
def _(t):
    known = plane_stations(t, 2).filter("x IS NOT NULL").select(F.col("code").alias("other"), F.col("x").alias("o_x"), F.col("y").alias("o_y"))
    out = X.fix_by_resection(_rounds(t).join(known, "other"))
    return out.select("code", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), "n")


@query("traverse_positions")
def _(t):
    """Chains along neighbouring station numbers: every tenth is fixed, legs join consecutive ones."""
    n = F.substring("code", 2, 20).cast("long")
    s = t.stations.select("code", n.alias("n"), ((F.col("lon_deg") - 167) * 8.0e4).alias("px"), ((F.col("lat_deg") + 46) * 1.1e5).alias("py"))
    nxt = s.select(F.col("code").alias("to_code"), (F.col("n") - 1).alias("n"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    legs = s.join(nxt, "n").select(F.col("code").alias("from_code"), "to_code", F.hypot(dx, dy).alias("d"), F.atan2(dx, dy).alias("az"))
    none = F.lit(None).cast("double")
    obs = legs.select("from_code", "to_code", F.lit("distance").alias("kind"), (F.col("d") * 1.0001).alias("value"), none.alias("dx"), none.alias("dy"), none.alias("dh")).unionAll(
        legs.select("from_code", "to_code", F.lit("azimuth"), "az", none, none, none)
    )
    fixed = plane_stations(t, 10)
    out = X.traverses(X.line_summary(obs), fixed)
    return out.select("code", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), "chain", F.round("misclose", 2).alias("misclose"))
