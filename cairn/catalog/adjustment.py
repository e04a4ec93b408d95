"""Levelling adjustment end to end, normal equations and summaries."""

from pyspark.sql import functions as F

from cairn.catalog import query
from cairn.fixtures import with_views
from cairn.operators import adjust as A
from cairn.operators import criteria as C
from cairn.operators import graph as G
from cairn.operators import normal as N
from cairn.operators import observe as O
from cairn.operators import residuals as RS
from cairn.operators import solve as V
from cairn.operators import summary as S

LV = with_views("levels", "stations")
OB = with_views("obs", "stations")
MX = with_views("mixed", "stations")
RES = with_views("residuals", "stations")


def level_stations(t):
    return t.stations.select(
        "code", F.radians("lon_deg").alias("lon"), F.radians("lat_deg").alias("lat"), "ohgt", "und",
        F.lit("fix").alias("mode_h"), "mode_v",
    )


def level_equations(t):
    st = level_stations(t).withColumn("free", F.when(F.col("mode_v") == "free", "u").otherwise(""))
    df = O.resolve_ends(t.levels, st, ["lon", "lat", "ohgt", "und", "free"])
    eq = O.design_rows(df, dimension="u")
    return eq.withColumn("used", ~F.col("rejected")).withColumn("component", F.lit(0))


def _level_solution(eq):
    cells = A.cut(N.normal_cells(eq.filter("used")))
    matrix, rhs, _ = N.split_cells(cells)
    return A.cut(V.solve(matrix, rhs, stored=True))


@query("adjusted_level_error_summary")
def _(t):
    keep = ["obs_key", "component", "set_id", "misclosure", "weight", "used", "design", "data_file", "class_method", "error"]
    eq = A.store(level_equations(t).select(*keep))
    solution = _level_solution(eq)
    res = RS.residual_rows(eq, solution)
    ratio = res.withColumns(
        {"sres": F.abs("residual") / F.col("error"), "rank": F.lit(1), "unused": ~F.col("used")}
    )
    return S.error_summary(ratio, ["data_file", "class_method"])


@query("adjusted_level_heights")
def _(t):
    """The equations are used once, so only their normal cells are stored."""
    return _level_solution(level_equations(t)).select("param", F.round("x", 6).alias("shift"), "singular")


@query(
    "level_normal_equations_satisfied",
    LV + """, e AS (SELECT f.code AS fc, f.mode_v AS fm, t.code AS tc, t.mode_v AS tm FROM fx_levels l JOIN fx_stations f ON l.from_code = f.code JOIN fx_stations t ON l.to_code = t.code WHERE NOT l.rejected)
SELECT DISTINCT concat(fc, '|u') AS param, true AS satisfied FROM e WHERE fm = 'free' UNION SELECT DISTINCT concat(tc, '|u'), true FROM e WHERE tm = 'free'""",
)
def _(t):
    """The solved heights put back into the normal equations leave nothing over."""
    from cairn.plans.lineage import cut

    matrix, rhs, _ = N.split_cells(cut(N.normal_cells(level_equations(t).filter("used"))))
    x = V.solve(matrix, rhs, stored=True).select(F.col("param").alias("col"), "x")
    back = matrix.join(x, "col").groupBy(F.col("row").alias("param")).agg(F.sum(F.col("value") * F.col("x")).alias("nx"), F.sum(F.abs("value")).alias("size"))
    left = back.join(rhs, "param").withColumn("gap", F.abs(F.col("nx") - F.col("b")) / F.col("size"))
    return left.select("param", (F.col("gap") < 1.0e-7).alias("satisfied"))


@query(
    "class_values_by_name",
    MX + """SELECT obs_key, coalesce(m.class_method, '-') AS method, s.class_mark_type AS from_mark_type FROM fx_mixed m JOIN fx_stations s ON m.from_code = s.code""",
)
def _(t):
    ob = t.mixed.withColumn("classes", F.create_map(F.lit("method"), "class_method", F.lit("party"), "class_party"))
    st = t.stations.select(F.col("code").alias("from_code"), F.create_map(F.lit("mark_type"), "class_mark_type").alias("st_classes"))
    joined = ob.join(st, "from_code")
    return joined.select("obs_key", S.class_value("classes", "method").alias("method"), S.class_value("st_classes", "mark_type").alias("from_mark_type"))


@query(
    "level_normal_matrix",
    LV + """, e AS (
SELECT l.obs_key, 1 / (l.error * l.error) AS w, l.value - (t.ohgt - f.ohgt) AS v,
  CASE WHEN f.mode_v = 'free' THEN concat(f.code, '|u') END AS pf, CASE WHEN t.mode_v = 'free' THEN concat(t.code, '|u') END AS pt
FROM fx_levels l JOIN fx_stations f ON l.from_code = f.code JOIN fx_stations t ON l.to_code = t.code WHERE NOT l.rejected),
d AS (SELECT obs_key, w, '=' AS p, v AS c FROM e UNION ALL SELECT obs_key, w, pf, -1 FROM e WHERE pf IS NOT NULL
  UNION ALL SELECT obs_key, w, pt, 1 FROM e WHERE pt IS NOT NULL),
c AS (SELECT '=' AS r, '=' AS c, w * v * v AS x FROM e
  UNION ALL SELECT '=', pf, -w * v FROM e WHERE pf IS NOT NULL UNION ALL SELECT '=', pt, w * v FROM e WHERE pt IS NOT NULL
  UNION ALL SELECT pf, pf, w FROM e WHERE pf IS NOT NULL UNION ALL SELECT pt, pt, w FROM e WHERE pt IS NOT NULL
  UNION ALL SELECT least(pf, pt), greatest(pf, pt), -w FROM e WHERE pf IS NOT NULL AND pt IS NOT NULL)
SELECT r AS row, c AS col, round(sum(x), 3) AS value FROM c GROUP BY r, c""",
)
def _(t):
    cells = N.normal_cells(level_equations(t).filter("used"))
    return cells.select("row", "col", F.round("value", 3).alias("value"))


@query(
    "level_misclosures",
    LV + """SELECT l.obs_key, round(t.ohgt - f.ohgt, 6) AS calc, round(l.value - (t.ohgt - f.ohgt), 6) AS misclosure,
  CAST((f.mode_v = 'free')::INT + (t.mode_v = 'free')::INT AS BIGINT) AS n_params
FROM fx_levels l JOIN fx_stations f ON l.from_code = f.code JOIN fx_stations t ON l.to_code = t.code""",
)
def _(t):
    return level_equations(t).select(
        "obs_key", F.round("calc", 6).alias("calc"), F.round("misclosure", 6).alias("misclosure"),
        F.size("design").cast("long").alias("n_params"),
    )


@query(
    "missing_stations",
    OB + """, u AS (SELECT from_code AS code, 1 AS f, 0 AS t FROM fx_obs UNION ALL SELECT to_code, 0, 1 FROM fx_obs)
SELECT code, CAST(sum(f) AS BIGINT) AS used_from, CAST(sum(t) AS BIGINT) AS used_to FROM u
WHERE code NOT IN (SELECT code FROM fx_stations) GROUP BY code""",
)
def _(t):
    return O.missing_stations(t.obs, t.stations)


@query(
    "observations_without_missing_stations",
    OB + """SELECT obs_key FROM fx_obs WHERE from_code IN (SELECT code FROM fx_stations) AND to_code IN (SELECT code FROM fx_stations)""",
)
def _(t):
    return O.drop_missing(t.obs, t.stations).select("obs_key")


@query(
    "observations_without_accepted_missing",
    OB + """, u AS (SELECT code FROM (SELECT to_code AS code FROM fx_obs) WHERE code NOT IN (SELECT code FROM fx_stations) AND code LIKE '%1')
SELECT obs_key FROM fx_obs WHERE from_code NOT IN (SELECT code FROM u) AND to_code NOT IN (SELECT code FROM u)""",
)
def _(t):
    accepted = t.obs.select(F.col("to_code").alias("code")).filter(C.code_like("*1"))
    return O.drop_missing(t.obs, t.stations, accepted).select("obs_key")


@query(
    "observations_with_stations",
    OB + """SELECT o.obs_key, f.name AS f_name, t.name AS t_name, t.ohgt - f.ohgt AS dh
FROM fx_obs o JOIN fx_stations f ON o.from_code = f.code JOIN fx_stations t ON o.to_code = t.code""",
)
def _(t):
    df = O.resolve_ends(t.obs, t.stations, ["name", "ohgt"], hot_rows=5000)
    return df.select("obs_key", "f_name", "t_name", (F.col("t_ohgt") - F.col("f_ohgt")).alias("dh"))


@query(
    "connected_pairs",
    OB + """SELECT DISTINCT least(from_code, to_code) AS a, greatest(from_code, to_code) AS b FROM fx_obs WHERE from_code <> to_code""",
)
def _(t):
    return G.connected_pairs(t.obs)


@query(
    "connected_components",
    """WITH e AS (
  SELECT DISTINCT concat('K', l_orderkey % 1009) AS a, concat('K', (l_orderkey % 1009) - (l_orderkey % 1009) % 7) AS b FROM lineitem)
SELECT a AS node, min(CASE WHEN b2 < a THEN b2 ELSE a END) OVER (PARTITION BY b2) AS component
FROM (SELECT a, min(b) AS b2 FROM e GROUP BY a)""",
)
def _(t):
    k = F.pmod("l_orderkey", F.lit(1009))
    edges = t.lineitem.select(
        F.concat(F.lit("K"), k).alias("a"), F.concat(F.lit("K"), k - F.pmod(k, F.lit(7))).alias("b")
    )
    return G.connected_components(edges)


@query(
    "error_summary_by_levels",
    RES + """SELECT data_file, class_method, obs_type,
  round(coalesce(sum(sres * sres * rank) FILTER (NOT rejected), 0), 6) AS ssr_used, CAST(coalesce(sum(rank) FILTER (NOT rejected AND sres IS NOT NULL), 0) AS BIGINT) AS n_used,
  CAST(coalesce(sum(rank) FILTER (rejected AND sres IS NOT NULL), 0) AS BIGINT) AS n_unused,
  round(sqrt(sum(sres * sres * rank) / sum(rank) FILTER (sres IS NOT NULL)) / 1.25, 6) AS seu_all,
  CAST(3 - grouping(data_file) - grouping(class_method) - grouping(obs_type) AS BIGINT) AS depth
FROM fx_residuals GROUP BY ROLLUP (data_file, class_method, obs_type)""",
)
def _(t):
    df = t.residuals.withColumn("unused", F.col("rejected"))
    out = S.error_summary(df, ["data_file", "class_method", "obs_type"], 1.25)
    return out.select(
        "data_file", "class_method", "obs_type", F.round("ssr_used", 6).alias("ssr_used"), "n_used", "n_unused",
        F.round("seu_all", 6).alias("seu_all"), "depth",
    )


@query(
    "component_error_summary",
    RES + """, c AS (SELECT data_file, 0 AS component, residual / 1.0E-3 AS s FROM fx_residuals WHERE obs_type = 'GB'
  UNION ALL SELECT data_file, 1, residual * 2 / 2.0E-3 FROM fx_residuals WHERE obs_type = 'GB')
SELECT data_file, CAST(component AS BIGINT) AS component, round(sqrt(sum(s * s) / count(*)), 6) AS seu, count(*) AS n FROM c GROUP BY data_file, component""",
)
def _(t):
    r = F.col("residual")
    gb = t.residuals.filter("obs_type = 'GB'").select(
        "data_file", F.array(r, r * 2, r * 3).alias("rv"), F.array(F.lit(1e-3), F.lit(2e-3), F.lit(1e-7)).alias("sv")
    )
    rows = RS.component_residuals(gb, "rv", "sv")
    return rows.groupBy("data_file", F.col("component").cast("long").alias("component")).agg(
        F.round(F.sqrt(F.sum(F.col("comp_sres") ** 2) / F.count("*")), 6).alias("seu"), F.count("*").alias("n")
    )


@query(
    "station_usage_counts",
    MX + """, e AS (SELECT from_code AS code, obs_type, rejected FROM fx_mixed UNION ALL SELECT to_code, obs_type, rejected FROM fx_mixed)
SELECT code, count(*) FILTER (obs_type = 'LV' AND NOT rejected) AS lv_used, count(*) FILTER (obs_type = 'LV' AND rejected) AS lv_unused,
  count(*) FILTER (obs_type = 'GB' AND NOT rejected) AS gb_used, count(*) FILTER (obs_type = 'GB' AND rejected) AS gb_unused FROM e GROUP BY code""",
)
def _(t):
    return S.usage_counts(t.mixed.withColumn("unused", F.col("rejected")), ["LV", "GB"])


@query(
    "observation_type_counts",
    MX + "SELECT obs_type, count(*) FILTER (NOT rejected) AS used, count(*) FILTER (rejected) AS unused FROM fx_mixed GROUP BY obs_type",
)
def _(t):
    return S.type_counts(t.mixed.withColumn("unused", F.col("rejected")))


@query(
    "problem_summary",
    MX + """SELECT 'station mode' AS part, concat(mode_h, '/', mode_v) AS name, count(*) AS n FROM fx_stations GROUP BY 2
UNION ALL SELECT 'observation type', obs_type, count(*) FROM fx_mixed GROUP BY 2
UNION ALL SELECT 'file', data_file, count(*) FROM fx_mixed GROUP BY 2""",
)
def _(t):
    return S.problem_summary(t.stations, t.mixed)


@query(
    "solution_summary",
    RES + """SELECT count(*) AS nobs, CAST(150 AS BIGINT) AS nprm, CAST(7 AS BIGINT) AS nset, count(*) - 157 AS dof,
  round(sum((residual / error) * (residual / error)), 5) AS ssr, round(sqrt(sum((residual / error) * (residual / error)) / (count(*) - 157)), 7) AS seu
FROM fx_residuals WHERE NOT rejected""",
)
def _(t):
    out = S.solution_summary(t.residuals.withColumn("used", ~F.col("rejected")), 150, 7)
    return out.withColumns({"ssr": F.round("ssr", 5), "seu": F.round("seu", 7)})


KIND_SQL = """CASE obs_type WHEN 'SD' THEN 8 WHEN 'HD' THEN 8 WHEN 'LV' THEN 1 WHEN 'AZ' THEN 16 WHEN 'HA' THEN 16
  WHEN 'ZD' THEN 33 WHEN 'GB' THEN 57 END"""


@query(
    "station_data_sufficiency",
    MX + f""", u AS (SELECT *, {KIND_SQL} AS k FROM fx_mixed WHERE NOT rejected AND data_file = 'FA' AND class_party = 'P1'),
e AS (SELECT from_code AS code, to_code AS other, k FROM u UNION ALL SELECT to_code, from_code, k FROM u),
p AS (SELECT code, bit_or(k) AS kinds, count(DISTINCT CASE WHEN k & 24 > 0 THEN other END) AS n FROM e GROUP BY code)
SELECT s.code, CAST(coalesce(kinds, 0) AS BIGINT) AS kinds, coalesce(n, 0) >= 2 AS two_partners,
  (mode_h = 'free' AND NOT (coalesce(kinds, 0) & 6 = 6 OR coalesce(kinds, 0) & 24 = 24 OR (coalesce(kinds, 0) & 24 > 0 AND coalesce(n, 0) >= 2)))
  OR (mode_v = 'free' AND coalesce(kinds, 0) & 1 = 0) AS reject
FROM fx_stations s LEFT JOIN p ON s.code = p.code""",
)
def _(t):
    some = t.mixed.filter("data_file = 'FA' AND class_party = 'P1'").withColumn("unused", F.col("rejected"))
    return S.data_sufficiency(some, t.stations)


@query(
    "maximum_adjustment",
    with_views("stations") + """, s AS (SELECT code, greatest(abs(ohgt - 700) / 1.0E3, und / 1.0E2) AS s FROM fx_stations)
SELECT max(s) AS max_shift, (SELECT max(code) FROM s WHERE s = (SELECT max(s) FROM s)) AS code, count(*) FILTER (s > 1) AS above FROM s""",
)
def _(t):
    moved = t.stations.select(
        "code", ((F.col("ohgt") - 700) / 1e3).alias("de"), (F.col("und") / 1e2).alias("dn"), F.lit(0.0).alias("du")
    )
    return A.max_adjustment(moved, 1.0)


@query(
    "station_extremes",
    with_views("stations") + """SELECT min(lat_deg) AS min_lat_deg, max(lat_deg) AS max_lat_deg, min(lon_deg) AS min_lon_deg,
  max(lon_deg) AS max_lon_deg, min(und) AS min_und, max(und) AS max_und FROM fx_stations""",
)
def _(t):
    return S.extremes(t.stations, ["lat_deg", "lon_deg", "und"])


@query(
    "line_statistics",
    MX + """SELECT least(from_code, to_code) AS a, greatest(from_code, to_code) AS b, count(*) AS n, count(*) FILTER (rejected) AS n_unused,
  count(DISTINCT obs_type) AS n_types FROM fx_mixed GROUP BY 1, 2""",
)
def _(t):
    return S.line_statistics(t.mixed.withColumn("unused", F.col("rejected")))


@query(
    "station_connections",
    MX + """SELECT code, neighbour, count(*) AS n FROM (SELECT from_code AS code, to_code AS neighbour FROM fx_mixed
  UNION ALL SELECT to_code, from_code FROM fx_mixed) GROUP BY code, neighbour""",
)
def _(t):
    return S.connections(t.mixed)


@query(
    "class_census",
    MX + """SELECT 'class_method' AS class_name, class_method AS class_value, count(*) AS n FROM fx_mixed GROUP BY class_method
UNION ALL SELECT 'class_party', class_party, count(*) FROM fx_mixed GROUP BY class_party""",
)
def _(t):
    return S.class_census(t.mixed, ["class_method", "class_party"])


@query(
    "file_date_ranges",
    OB + """SELECT data_file, strftime(min(obs_ts), '%Y-%m-%d') AS first, strftime(max(obs_ts), '%Y-%m-%d') AS last,
  count(*) FILTER (obs_ts IS NULL) AS undated FROM fx_obs GROUP BY data_file""",
)
def _(t):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return S.file_dates(t.obs).select("data_file", day("first"), day("last"), "undated")


@query(
    "worst_residuals",
    RES + """SELECT obs_key, used, rank, sres, place FROM (
  SELECT obs_key, NOT rejected AS used, CAST(rank AS BIGINT) AS rank, sres,
    row_number() OVER (PARTITION BY rejected, rank ORDER BY sres DESC, obs_key) AS place FROM fx_residuals WHERE sres IS NOT NULL)
WHERE place <= 20""",
)
def _(t):
    df = t.residuals.withColumn("used", ~F.col("rejected")).withColumn("rank", F.col("rank").cast("long"))
    return RS.worst_residuals(df, 20).select("obs_key", "used", "rank", "sres", F.col("place").cast("long").alias("place"))


@query(
    "residual_flag_tallies",
    RES + """, f AS (SELECT NOT rejected AS used, CASE WHEN rank = 1 THEN CASE WHEN sres > 1.959963984540054E0 THEN 2 WHEN sres > 9.944578832097535E-1 THEN 1 ELSE 0 END
   ELSE CASE WHEN sres > 1.6139738012586936E0 THEN 2 WHEN sres > 1.0834E0 THEN 1 ELSE 0 END END AS flag FROM fx_residuals WHERE rank = 1)
SELECT used, CAST(flag AS BIGINT) AS flag, count(*) AS n FROM f GROUP BY used, flag""",
)
def _(t):
    limits = RS.flag_limits((68.0, 95.0), (False, False), 0)
    df = t.residuals.filter("rank = 1").select(
        (~F.col("rejected")).alias("used"), RS.flag(F.col("sres"), F.col("rank"), limits).cast("long").alias("flag")
    )
    return RS.flag_tallies(df)


@query(
    "redundancy_and_detectable_errors",
    RES + """SELECT obs_key, round(res_error / error, 9) AS redundancy,
  round((1.959963984540054E0 + 1.2815515655446004E0) * error * error / res_error, 7) AS mde FROM fx_residuals""",
)
def _(t):
    level = RS.mde_level(95.0, 90.0)
    return t.residuals.select(
        "obs_key",
        F.round(RS.redundancy(F.col("res_error"), F.col("error")), 9).alias("redundancy"),
        F.round(RS.minimum_detectable(F.col("error"), F.col("res_error"), level), 7).alias("mde"),
    )


@query("residual_significance")
def _(t):
    df = t.residuals.withColumn("used", ~F.col("rejected"))
    return RS.residual_significance(df, 5000, 1.1, True).select("obs_key", "sres", F.round("significance", 4).alias("significance"))


@query(
    "error_ellipses",
    with_views("stations") + """, c AS (SELECT code, (1 + und) * 1.0E-4 AS ee, (ohgt - 1000) * 1.0E-8 AS en, (2 + lat_deg + 46) * 1.0E-4 AS nn FROM fx_stations)
SELECT code, round(sqrt((ee + nn) / 2 + sqrt((nn - ee) / 2 * (nn - ee) / 2 + en * en)), 7) AS semi_max,
  round(sqrt((ee + nn) / 2 - sqrt((nn - ee) / 2 * (nn - ee) / 2 + en * en)), 7) AS semi_min,
  round(degrees(CASE WHEN atan2(en, (nn - ee) / 2) < 0 THEN atan2(en, (nn - ee) / 2) / 2 + pi() ELSE atan2(en, (nn - ee) / 2) / 2 END), 5) AS azimuth FROM c""",
)
def _(t):
    ee = (1 + F.col("und")) * 1e-4
    en = (F.col("ohgt") - 1000) * 1e-8
    nn = (2 + F.col("lat_deg") + 46) * 1e-4
    a, b, az = RS.error_ellipse(ee, en, nn)
    return t.stations.select(
        "code", F.round(a, 7).alias("semi_max"), F.round(b, 7).alias("semi_min"), F.round(az, 5).alias("azimuth")
    )
