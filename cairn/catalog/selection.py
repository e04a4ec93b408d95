"""Station and observation selection, rules and modes."""

from pyspark.sql import functions as F

from cairn.catalog import query
from cairn.fixtures import with_views
from cairn.operators import criteria as C
from cairn.operators import rules as R
from cairn.sources.polygons import polygon_edges

ST = with_views("stations")
OB = with_views("obs", "stations")
MX = with_views("mixed", "stations")


@query("station_by_code", ST + "SELECT code, name FROM fx_stations WHERE code IN ('C1', 'C22', 'C149', 'C77')")
def _(t):
    return t.stations.filter(C.code_is(["c1", "C22", "c149", "C77"])).select("code", "name")


@query("station_all", ST + "SELECT code, mode_v FROM fx_stations")
def _(t):
    return t.stations.filter(C.all_stations()).select("code", "mode_v")


@query("station_by_wildcard", ST + "SELECT code, lat_deg FROM fx_stations WHERE code LIKE 'C1_%5'")
def _(t):
    return t.stations.filter(C.code_like("c1?*5")).select("code", "lat_deg")


@query(
    "station_by_code_range",
    ST + "SELECT code FROM fx_stations WHERE CAST(substr(code, 2) AS BIGINT) BETWEEN 20 AND 350",
)
def _(t):
    return t.stations.filter(C.code_between("C20", "c350")).select("code")


POLYGON_SQL = ST + """, p AS (
  SELECT s_suppkey AS poly_id, 167 + (s_suppkey * 7) % 10 AS x, -45 + (s_suppkey * 5) % 11 AS y
  FROM supplier WHERE s_suppkey % 3 = 0),
e AS (
  SELECT poly_id, x * 1.0E0 AS x1, y * 1.0E0 AS y1, x + 1.0E0 AS x2, y * 1.0E0 AS y2 FROM p
  UNION ALL SELECT poly_id, x + 1.0E0, y * 1.0E0, x * 1.0E0, y - 1.0E0 FROM p
  UNION ALL SELECT poly_id, x * 1.0E0, y - 1.0E0, x * 1.0E0, y * 1.0E0 FROM p
  UNION ALL SELECT poly_id, x + 1.0E-1, y - 1.0E-1, x + 4.0E-1, y - 1.0E-1 FROM p
  UNION ALL SELECT poly_id, x + 4.0E-1, y - 1.0E-1, x + 1.0E-1, y - 4.0E-1 FROM p
  UNION ALL SELECT poly_id, x + 1.0E-1, y - 4.0E-1, x + 1.0E-1, y - 1.0E-1 FROM p),
hit AS (
  SELECT s.code, e.poly_id
  FROM fx_stations s JOIN e ON (y1 <= lat_deg) <> (y2 <= lat_deg)
   AND lon_deg < x1 + (lat_deg - y1) * (x2 - x1) / CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END
  GROUP BY s.code, e.poly_id HAVING count(*) % 2 = 1)
"""


@query(
    "station_inside_polygon",
    POLYGON_SQL + "SELECT code, lon_deg, lat_deg FROM fx_stations WHERE code IN (SELECT code FROM hit)",
)
def _(t):
    return C.inside_polygons(t.stations, polygon_edges(t.polygons)).select("code", "lon_deg", "lat_deg")


@query("station_outside_polygon", POLYGON_SQL + "SELECT code FROM fx_stations WHERE code NOT IN (SELECT code FROM hit)")
def _(t):
    return C.inside_polygons(t.stations, polygon_edges(t.polygons), outside=True).select("code")


@query(
    "polygon_edges_from_text",
    """WITH p AS (SELECT s_suppkey AS poly_id, 167 + (s_suppkey * 7) % 10 AS x, -45 + (s_suppkey * 5) % 11 AS y
     FROM supplier WHERE s_suppkey % 3 = 0)
SELECT poly_id, CAST(0 AS BIGINT) AS ring, x * 1.0E0 AS x1, y * 1.0E0 AS y1, x + 1.0E0 AS x2, y * 1.0E0 AS y2 FROM p
UNION ALL SELECT poly_id, 0, x + 1.0E0, y * 1.0E0, x * 1.0E0, y - 1.0E0 FROM p
UNION ALL SELECT poly_id, 0, x * 1.0E0, y - 1.0E0, x * 1.0E0, y * 1.0E0 FROM p
UNION ALL SELECT poly_id, 1, round(x + 1.0E-1, 6), round(y - 1.0E-1, 6), round(x + 4.0E-1, 6), round(y - 1.0E-1, 6) FROM p
UNION ALL SELECT poly_id, 1, round(x + 4.0E-1, 6), round(y - 1.0E-1, 6), round(x + 1.0E-1, 6), round(y - 4.0E-1, 6) FROM p
UNION ALL SELECT poly_id, 1, round(x + 1.0E-1, 6), round(y - 4.0E-1, 6), round(x + 1.0E-1, 6), round(y - 1.0E-1, 6) FROM p""",
)
def _(t):
    e = polygon_edges(t.polygons)
    return e.select("poly_id", "ring", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("station_by_class", ST + "SELECT code FROM fx_stations WHERE class_mark_type IN ('MACHINERY', 'BUILDING')")
def _(t):
    return t.stations.filter(C.class_is("class_mark_type", ["machinery", "building"])).select("code")


@query(
    "station_criteria_lines",
    ST + """SELECT code FROM fx_stations
WHERE ((code LIKE 'C1%' AND class_mark_type = 'MACHINERY') OR class_district = 'D3') AND NOT mode_v = 'fix'
   OR CAST(substr(code, 2) AS BIGINT) BETWEEN 5 AND 9""",
)
def _(t):
    first = C.line(
        C.code_like("c1*"),
        ("and", C.class_is("class_mark_type", ["machinery"])),
        ("or", C.class_is("class_district", ["d3"])),
        ("except", F.col("mode_v") == "fix"),
    )
    return t.stations.filter(C.any_of([first, C.code_between("C5", "C9")])).select("code")


@query(
    "station_in_list",
    ST + "SELECT code, name FROM fx_stations WHERE code IN (SELECT concat('C', s_suppkey * 3) FROM supplier)",
)
def _(t):
    listed = t.supplier.select(F.concat(F.lit("c"), F.col("s_suppkey") * 3).alias("code"))
    return C.in_list(t.stations, listed).select("code", "name")


@query(
    "station_in_coordinate_range",
    ST + "SELECT code FROM fx_stations WHERE lon_deg BETWEEN 168 AND 175.5 AND lat_deg BETWEEN -44 AND -38",
)
def _(t):
    shifted = t.stations.withColumn("lon_deg", F.col("lon_deg") - 360.0)
    return shifted.filter(C.in_range("lon_deg", "lat_deg", 168.0, -44.0, 175.5, -38.0)).select("code")


@query(
    "station_by_status_or_size",
    ST + """SELECT code, mode_h, mode_v FROM fx_stations
WHERE (mode_h IN ('float', 'fix') OR mode_v IN ('float', 'fix')) AND und > 10""",
)
def _(t):
    picked = C.stations_by_size(t.stations, modes=["float", "fix"], vertical_above=10.0, v_column="und")
    return picked.select("code", "mode_h", "mode_v")


@query("observation_by_type", MX + "SELECT obs_key, obs_type FROM fx_mixed WHERE obs_type IN ('SD', 'HD')")
def _(t):
    return t.mixed.filter(C.type_is(["sd", "HD"])).select("obs_key", "obs_type")


@query("observation_by_file", OB + "SELECT obs_key FROM fx_obs WHERE data_file IN ('FA', 'FN')")
def _(t):
    pathed = t.obs.withColumn("data_file", F.concat(F.lit("/archive/y/"), F.col("data_file")))
    return pathed.filter(C.file_like("Y/f?") & ~C.file_like("fr")).select("obs_key")


@query(
    "observation_by_class",
    OB + "SELECT obs_key FROM fx_obs WHERE class_party IN ('P1', 'P4') AND class_method LIKE 'O%'",
)
def _(t):
    return t.obs.filter(C.class_like("class_party", "p1/p4") & C.class_like("class_method", "o*")).select("obs_key")


@query(
    "observation_in_id_list",
    OB + """SELECT obs_key FROM fx_obs WHERE obs_key IN (
  SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-',
                CAST(round(l_extendedprice * 100) AS BIGINT)) FROM lineitem WHERE l_quantity > 45)""",
)
def _(t):
    ids = t.spark.sql(
        """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-',
                  CAST(round(l_extendedprice * 100) AS BIGINT)) AS id FROM {lineitem} WHERE l_quantity > 45""",
        lineitem=t.lineitem,
    )
    return C.id_in_list(t.obs, ids).select("obs_key")


@query(
    "observation_by_date",
    OB + """SELECT obs_key, CASE WHEN obs_ts IS NULL THEN 'unknown' WHEN obs_ts < TIMESTAMP '1995-01-01' THEN 'before'
       ELSE 'after' END AS part
FROM fx_obs WHERE obs_ts IS NULL OR obs_ts < TIMESTAMP '1995-01-01' OR obs_ts > TIMESTAMP '2000-01-01'""",
)
def _(t):
    before, after, unknown = C.dated("before", "1995-01-01"), C.dated("after", "2000-01-01"), C.dated("unknown")
    part = F.when(unknown, "unknown").when(before, "before").otherwise("after")
    return t.obs.filter(before | after | unknown).select("obs_key", part.alias("part"))


@query(
    "observation_using_stations",
    OB + """, s AS (SELECT code FROM fx_stations WHERE class_district = 'D3')
SELECT obs_key FROM fx_obs WHERE from_code IN (SELECT code FROM s) OR to_code IN (SELECT code FROM s)""",
)
def _(t):
    return C.using_stations(t.obs, t.stations.filter(C.class_is("class_district", ["D3"]))).select("obs_key")


@query(
    "observation_between_stations",
    OB + """, s AS (SELECT code FROM fx_stations WHERE class_mark_type = 'MACHINERY')
SELECT obs_key FROM fx_obs WHERE from_code IN (SELECT code FROM s) AND to_code IN (SELECT code FROM s)""",
)
def _(t):
    return C.between_stations(t.obs, t.stations.filter(C.class_is("class_mark_type", ["MACHINERY"]))).select("obs_key")


RULE_SQL = MX + """, m AS (
SELECT obs_key, set_id, obs_type, order_no, rejected, class_party, data_file,
  data_file = 'FA' AND obs_type = 'HA' AS ig,
  class_party = 'P2' AS rej, obs_type IN ('SD', 'HD') AS rw1, data_file = 'FR' AS rw2,
  class_method = 'O' AND obs_type = 'GB' AS oe, obs_type = 'ZD' AS rs, class_party = 'P1' AND obs_type = 'GB' AS ce,
  class_party = 'P3' AS an, obs_type = 'SD' AS op, data_file = 'FN' AS un
FROM fx_mixed),
a AS (SELECT * EXCLUDE (rej, rw1, rw2, oe, rs, ce, an, op, un),
  rej AND NOT ig AS rej, rw1 AND NOT ig AS rw1, rw2 AND NOT ig AS rw2, oe AND NOT ig AS oe, rs AND NOT ig AS rs,
  ce AND NOT ig AS ce, an AND NOT ig AS an, op AND NOT ig AS op, un AND NOT ig AS un FROM m),
s AS (SELECT *, bool_or(rs) OVER w AS s_rs, bool_or(ce) OVER w AS s_ce, bool_or(oe AND obs_type = 'GB') OVER w AS s_oe,
  bool_or(an AND obs_type = 'GB') OVER w AS s_an FROM a WINDOW w AS (PARTITION BY set_id))
"""


def _rules():
    c = F.col
    return [
        R.Rule("drop rounds", (c("data_file") == "FA") & (c("obs_type") == "HA"), "ignore"),
        R.Rule("reject party", c("class_party") == "P2", "reject"),
        R.Rule("distances", C.type_is(["SD", "HD"]), "reweight", 2.0),
        R.Rule("file", c("data_file") == "FR", "reweight", 1.5),
        R.Rule("eccentric", (c("class_method") == "O") & (c("obs_type") == "GB"), "offset_error", 0.003, 0.005),
        R.Rule("zenith sets", C.type_is(["ZD"]), "reweight_set", 3.0),
        R.Rule("centring", (c("class_party") == "P1") & (c("obs_type") == "GB"), "centroid_error", 0.002, 0.004),
        R.Rule("antenna", c("class_party") == "P3", "antenna", 0.05),
        R.Rule("option on", C.type_is(["SD"]), "set_option", option=3),
        R.Rule("option off", c("data_file") == "FN", "unset_option", option=1),
    ]


@query(
    "observation_rules_ignore_reject",
    RULE_SQL + """SELECT obs_key, rej OR rejected AS rejected FROM a WHERE NOT ig""",
)
def _(t):
    out = R.apply_rules(t.mixed, _rules()[:2])
    return out.filter(~F.col("ignored")).select("obs_key", "rejected")


@query(
    "observation_rules_reweight",
    RULE_SQL + """SELECT obs_key, CASE WHEN rw1 THEN 2.0E0 ELSE 1.0E0 END * CASE WHEN rw2 THEN 1.5E0 ELSE 1.0E0 END AS error_factor,
  CASE WHEN s_rs THEN 3.0E0 ELSE 1.0E0 END AS set_factor FROM s WHERE NOT ig""",
)
def _(t):
    out = R.apply_rules(t.mixed, _rules())
    return out.filter(~F.col("ignored")).select("obs_key", "error_factor", "set_factor")


@query(
    "observation_rules_added_errors",
    RULE_SQL + """SELECT obs_key, round(CASE WHEN oe THEN 9.0E-6 ELSE 0 END, 9) AS offset_hv,
  round(CASE WHEN oe THEN 2.5E-5 ELSE 0 END, 9) AS offset_vv,
  round(CASE WHEN s_oe THEN 9.0E-6 ELSE 0 END + CASE WHEN s_ce THEN 4.0E-6 ELSE 0 END, 9) AS centroid_hv,
  round(CASE WHEN s_oe THEN 2.5E-5 ELSE 0 END + CASE WHEN s_ce THEN 1.6E-5 ELSE 0 END, 9) AS centroid_vv
FROM s WHERE NOT ig""",
)
def _(t):
    out = R.apply_rules(t.mixed, _rules()).filter(~F.col("ignored"))
    names = ("offset_hv", "offset_vv", "centroid_hv", "centroid_vv")
    return out.select("obs_key", *[F.round(n, 9).alias(n) for n in names])


@query(
    "observation_rules_antenna_and_options",
    RULE_SQL + """SELECT obs_key, CASE WHEN an AND obs_type IN ('GB', 'GX') THEN 5.0E-2 ELSE 0.0E0 END AS to_hgt_add,
  CASE WHEN s_an THEN 5.0E-2 ELSE 0.0E0 END AS from_hgt_add,
  CAST(CASE WHEN op THEN CASE WHEN un THEN 2 ELSE 3 END ELSE 0 END AS BIGINT) AS options FROM s WHERE NOT ig""",
)
def _(t):
    out = R.apply_rules(t.mixed, _rules()).filter(~F.col("ignored"))
    return out.select("obs_key", "to_hgt_add", "from_hgt_add", F.col("options").cast("long").alias("options"))


@query(
    "observation_rule_usage",
    RULE_SQL + """SELECT 'drop rounds' AS rule, 'ignore' AS action, count(*) FILTER (ig) AS matched FROM a
UNION ALL SELECT 'reject party', 'reject', count(*) FILTER (rej) FROM a
UNION ALL SELECT 'distances', 'reweight', count(*) FILTER (rw1) FROM a
UNION ALL SELECT 'file', 'reweight', count(*) FILTER (rw2) FROM a""",
)
def _(t):
    return R.rule_usage(t.mixed, _rules()[:4])


@query(
    "file_error_factor",
    OB + """SELECT obs_key, round(error * CASE data_file WHEN 'FA' THEN 1.25E0 WHEN 'FR' THEN 2.0E0 ELSE 1.0E0 END, 9) AS error
FROM fx_obs""",
)
def _(t):
    files = t.obs.select("data_file").distinct().withColumn(
        "factor", F.when(F.col("data_file") == "FA", 1.25).when(F.col("data_file") == "FR", 2.0)
    )
    return R.file_factor(t.obs, files).select("obs_key", F.round("error", 9).alias("error"))


@query(
    "station_use_modes",
    ST + """SELECT code, CASE WHEN class_district = 'D3' THEN 'float' WHEN code LIKE 'C1%' THEN 'fix' ELSE 'free' END AS mode_h,
  CASE WHEN class_mark_type = 'MACHINERY' THEN 'free' WHEN code LIKE 'C1%' THEN 'fix' ELSE 'free' END AS mode_v,
  CASE WHEN class_district = 'D3' THEN 1.0E-2 END AS float_h,
  CASE WHEN code LIKE '%7' THEN 'use' WHEN class_district IN ('D4', 'D5') THEN 'reject' ELSE 'use' END AS use
FROM fx_stations""",
)
def _(t):
    rules = [
        R.ModeRule(C.code_like("c1*"), "fix", "fix"),
        R.ModeRule(C.class_is("class_district", ["d4", "d5"]), "reject"),
        R.ModeRule(C.class_is("class_mark_type", ["machinery"]), None, "free"),
        R.ModeRule(C.class_is("class_district", ["d3"]), "float", None, h_error=0.01),
        R.ModeRule(C.code_like("*7"), "accept"),
    ]
    return R.station_modes(t.stations, rules).select("code", "mode_h", "mode_v", "float_h", "use")


@query(
    "highlighted_observations",
    with_views("residuals") + """SELECT obs_key, sres FROM fx_residuals WHERE sres > 0.1 OR rejected""",
)
def _(t):
    return C.highlight(t.residuals, sres_above=0.1, rejected=True).select("obs_key", "sres")
