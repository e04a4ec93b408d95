"""Recodes, merges, sorts and set work on whole tables."""

from pyspark.sql import functions as F

from cairn.catalog import query
from cairn.fixtures import with_views
from cairn.operators import merge as M
from cairn.operators import recode as RC
from cairn.functions.text import clean_class_name, natural_key

OB = with_views("obs", "stations", "recode")
ST = with_views("stations", "update_stations")

RECODED = OB + """, u AS (SELECT from_code AS code, obs_ts AS ts FROM fx_obs UNION SELECT to_code, obs_ts FROM fx_obs),
rules AS (SELECT *, CASE WHEN date_to IS NULL THEN 2 ELSE 1 END AS kind FROM fx_recode
  UNION ALL SELECT concat('C', s_suppkey * 3), concat('C', s_suppkey * 3, 'X'), NULL, NULL, false, 0.0E0, 0.0E0, 3 FROM supplier WHERE s_suppkey % 4 = 0
  UNION ALL SELECT concat('C', s_suppkey * 3), concat('C', s_suppkey * 3, 'B'), NULL, TIMESTAMP '1994-06-01', false, 0.0E0, 0.0E0, 0 FROM supplier WHERE s_suppkey % 7 = 0
  UNION ALL SELECT concat('C', s_suppkey * 3), concat('C', s_suppkey * 3, 'L'), TIMESTAMP '1999-01-01', NULL, false, 0.0E0, 0.0E0, 2 FROM supplier WHERE s_suppkey % 3 = 0),
hit AS (SELECT u.code, u.ts, r.code_to, r.reject, row_number() OVER (PARTITION BY u.code, u.ts ORDER BY kind,
    CASE WHEN kind = 2 THEN date_from END DESC) AS k
  FROM u JOIN rules r ON u.code = r.code_from AND (kind = 3 OR (kind = 0 AND ts < date_to) OR (kind = 1 AND ts BETWEEN date_from AND date_to)
    OR (kind = 2 AND ts >= date_from))),
res AS (SELECT * FROM hit WHERE k = 1),
out AS (SELECT o.obs_key, coalesce(f.code_to, o.from_code) AS from_code, coalesce(t.code_to, o.to_code) AS to_code,
  o.from_code AS from_original, o.to_code AS to_original,
  coalesce(f.reject, false) OR coalesce(t.reject, false) AS recode_rejected
FROM fx_obs o LEFT JOIN res f ON o.from_code = f.code AND o.obs_ts IS NOT DISTINCT FROM f.ts
  LEFT JOIN res t ON o.to_code = t.code AND o.obs_ts IS NOT DISTINCT FROM t.ts)
"""


def _rules(t):
    s = t.supplier
    c = F.concat(F.lit("C"), F.col("s_suppkey") * 3)
    none = F.lit(None).cast("timestamp_ntz")
    day = lambda d: F.lit(d).cast("timestamp_ntz")

    def extra(every, suffix, start, end):
        return s.filter(F.col("s_suppkey") % every == 0).select(
            c.alias("code_from"), F.concat(c, F.lit(suffix)).alias("code_to"), start.alias("date_from"), end.alias("date_to"),
            F.lit(False).alias("reject"), F.lit(0.0).alias("h_error"), F.lit(0.0).alias("v_error"),
        )

    return (
        t.recode.unionByName(extra(4, "X", none, none))
        .unionByName(extra(7, "B", none, day("1994-06-01")))
        .unionByName(extra(3, "L", day("1999-01-01"), none))
    )


@query("dated_recode", RECODED + "SELECT obs_key, from_code, to_code, recode_rejected FROM out")
def _(t):
    return RC.recode_ends(t.obs, _rules(t)).select("obs_key", "from_code", "to_code", "recode_rejected")


@query(
    "dated_recode_file_then_global",
    OB + """, f AS (SELECT obs_key, obs_ts, CASE WHEN from_code IN (SELECT concat('C', s_suppkey * 3) FROM supplier) AND substr(from_code, length(from_code)) = '0'
   THEN 'C6' ELSE from_code END AS from_code, to_code FROM fx_obs)
SELECT obs_key, from_code, to_code FROM (SELECT obs_key, CASE WHEN from_code = 'C6' AND obs_ts >= TIMESTAMP '1996-03-01' THEN 'GLOBAL' ELSE from_code END AS from_code,
   CASE WHEN to_code = 'C6' AND obs_ts >= TIMESTAMP '1996-03-01' THEN 'GLOBAL' WHEN to_code IN (SELECT concat('C', s_suppkey * 3) FROM supplier) AND substr(to_code, length(to_code)) = '0'
   THEN CASE WHEN obs_ts >= TIMESTAMP '1996-03-01' THEN 'GLOBAL' ELSE 'C6' END ELSE to_code END AS to_code FROM f)""",
)
def _(t):
    none = F.lit(None).cast("timestamp_ntz")
    c = F.concat(F.lit("C"), F.col("s_suppkey") * 3)
    file_rules = t.supplier.filter(c.endswith("0")).select(
        c.alias("code_from"), F.lit("C6").alias("code_to"), none.alias("date_from"), none.alias("date_to"), F.lit(False).alias("reject")
    )
    global_rules = t.supplier.filter("s_suppkey = 2").select(
        F.lit("C6").alias("code_from"), F.lit("GLOBAL").alias("code_to"), F.lit("1996-03-01").cast("timestamp_ntz").alias("date_from"),
        none.alias("date_to"), F.lit(False).alias("reject"),
    )
    return RC.recode_ends(t.obs, global_rules, file_rules).select("obs_key", "from_code", "to_code")


@query(
    "stations_created_by_recode",
    RECODED + """, p AS (SELECT from_original AS old, from_code AS new FROM out UNION ALL SELECT to_original, to_code FROM out),
w AS (SELECT new, min(old) AS old FROM p WHERE old <> new AND new NOT IN (SELECT code FROM fx_stations) GROUP BY new)
SELECT code, name, ohgt FROM fx_stations UNION ALL SELECT w.new, s.name, s.ohgt FROM w JOIN fx_stations s ON s.code = w.old""",
)
def _(t):
    return RC.stations_from_recodes(t.stations, RC.recode_ends(t.obs, _rules(t))).select("code", "name", "ohgt")


@query(
    "recode_definitions_merged",
    with_views("recode") + """, twice AS (SELECT * FROM fx_recode UNION ALL SELECT code_from, code_to, date_from, date_to, reject, h_error * 2, v_error FROM fx_recode
  UNION ALL SELECT code_from, concat(code_to, 'Z'), date_from, date_to, reject, 1.0E-3, 0.0E0 FROM fx_recode WHERE reject)
SELECT code_from, code_to, CASE WHEN min(h_error) <= 0 THEN 0.0E0 ELSE max(h_error) END AS h_error,
  CASE WHEN min(v_error) <= 0 THEN 0.0E0 ELSE max(v_error) END AS v_error, bool_or(reject) AS conflict FROM twice GROUP BY code_from, code_to""",
)
def _(t):
    r = t.recode
    twice = r.unionByName(r.withColumn("h_error", F.col("h_error") * 2)).unionByName(
        r.filter("reject").withColumns({"code_to": F.concat("code_to", F.lit("Z")), "h_error": F.lit(1e-3), "v_error": F.lit(0.0)})
    )
    return RC.merge_definitions(twice).select("code_from", "code_to", "h_error", "v_error", "conflict")


@query(
    "colocation_pairs",
    with_views("recode", "stations") + """, s AS (SELECT code FROM fx_stations UNION ALL SELECT code_to FROM fx_recode)
SELECT code_from AS a, code_to AS b, h_error, v_error FROM fx_recode
WHERE (h_error > 0 OR v_error > 0) AND code_from IN (SELECT code FROM s) AND code_to IN (SELECT code FROM s)""",
)
def _(t):
    marks = t.stations.select("code").unionAll(t.recode.select("code_to"))
    pairs, _ = RC.colocations(t.recode, marks)
    return pairs


@query(
    "recode_whole_table",
    OB + """, m AS (SELECT concat('C', s_suppkey) AS old, concat('N', s_suppkey % 50) AS new FROM supplier)
SELECT obs_key, coalesce(a.new, from_code) AS from_code, coalesce(b.new, to_code) AS to_code
FROM fx_obs LEFT JOIN m a ON from_code = a.old LEFT JOIN m b ON to_code = b.old""",
)
def _(t):
    s = F.col("s_suppkey")
    m = t.supplier.select(F.concat(F.lit("C"), s).alias("old"), F.concat(F.lit("N"), s % 50).alias("new"))
    return RC.recode_table(t.obs.select("obs_key", "from_code", "to_code"), m, ["from_code", "to_code"])


def _station_maps(df, **classes):
    pairs = [c for k, v in classes.items() for c in (F.lit(k), F.col(v))]
    return df.select(
        "code", "name", F.col("lon_deg").alias("lon"), F.col("lat_deg").alias("lat"), "ohgt", "und", F.create_map(*pairs).alias("classes")
    )


def _flat(df):
    names = ("Mark_Type", "Order")
    return df.select(
        "code", "name", *[F.round(c, 8).alias(c) for c in ("lon", "lat", "ohgt", "und")],
        *[F.element_at("classes", F.lit(n)).alias(n.lower()) for n in names],
    )


def _pair(t):
    base = _station_maps(t.stations, Mark_Type="class_mark_type")
    data = _station_maps(t.update_stations, Order="class_order")
    return base, data


@query(
    "merge_overwrite_and_add",
    ST + """SELECT coalesce(d.code, b.code) AS code, coalesce(d.name, b.name) AS name, round(coalesce(d.lon_deg, b.lon_deg), 8) AS lon,
  round(coalesce(d.lat_deg, b.lat_deg), 8) AS lat, round(coalesce(d.ohgt, b.ohgt), 8) AS ohgt, round(coalesce(d.und, b.und), 8) AS und,
  CASE WHEN d.code IS NULL THEN b.class_mark_type END AS mark_type, d.class_order AS "order"
FROM fx_stations b FULL JOIN fx_update_stations d ON b.code = d.code""",
)
def _(t):
    base, data = _pair(t)
    return _flat(M.merge_stations(base, data, M.MergeOptions(overwrite=True, add_classes=True)))


@query(
    "merge_update_coordinates",
    ST + """SELECT b.code, b.name, round(coalesce(d.lon_deg, b.lon_deg), 8) AS lon, round(coalesce(d.lat_deg, b.lat_deg), 8) AS lat,
  round(coalesce(d.ohgt + d.und - b.und, b.ohgt), 8) AS ohgt, round(b.und, 8) AS und, b.class_mark_type AS mark_type, d.class_order AS "order"
FROM fx_stations b LEFT JOIN fx_update_stations d ON b.code = d.code""",
)
def _(t):
    base, data = _pair(t)
    options = M.MergeOptions(add_new=False, coords=True, classes=True, add_classes=True, height="ellipsoidal")
    return _flat(M.merge_stations(base, data, options))


@query(
    "merge_selected_geoid_only_known_classes",
    ST + """, d AS (SELECT * FROM fx_update_stations WHERE code IN (SELECT concat('C', s_suppkey * 4) FROM supplier))
SELECT coalesce(b.code, d.code) AS code, coalesce(b.name, d.name) AS name, round(coalesce(d.lon_deg, b.lon_deg), 8) AS lon, round(coalesce(d.lat_deg, b.lat_deg), 8) AS lat,
  round(coalesce(d.ohgt, b.ohgt), 8) AS ohgt, round(coalesce(d.und, b.und), 8) AS und, b.class_mark_type AS mark_type, CAST(NULL AS VARCHAR) AS "order"
FROM fx_stations b FULL JOIN d ON b.code = d.code""",
)
def _(t):
    base, data = _pair(t)
    only = t.supplier.select(F.concat(F.lit("C"), F.col("s_suppkey") * 4).alias("code"))
    options = M.MergeOptions(geoid=True, classes=True)
    return _flat(M.merge_stations(base, data, options, only, ["Mark_Type"]))


@query(
    "coordinate_files_in_order",
    ST + """SELECT code, name, ohgt FROM fx_update_stations UNION ALL
SELECT code, name, ohgt FROM fx_stations WHERE code NOT IN (SELECT code FROM fx_update_stations)""",
)
def _(t):
    cols = ["code", "name", "ohgt"]
    return M.add_coordinate_files([t.stations.select(*cols), t.update_stations.select(*cols)])


@query(
    "duplicate_stations_removed",
    ST + """, u AS (SELECT code, name, 1 AS k FROM fx_update_stations UNION ALL SELECT lower(code), name, 2 FROM fx_stations)
SELECT code, name FROM (SELECT *, row_number() OVER (PARTITION BY lower(code) ORDER BY k) AS n FROM u) WHERE n = 1""",
)
def _(t):
    u = t.update_stations.select("code", "name", F.lit(1).alias("k")).unionAll(
        t.stations.select(F.lower("code"), "name", F.lit(2))
    )
    return M.remove_duplicates(u, "k")[0].select("code", "name")


@query(
    "duplicate_station_report",
    ST + """, u AS (SELECT code FROM fx_update_stations UNION ALL SELECT code FROM fx_stations)
SELECT code, count(*) AS n FROM u GROUP BY code HAVING count(*) > 1""",
)
def _(t):
    u = t.update_stations.select("code").unionAll(t.stations.select("code"))
    return M.remove_duplicates(u, "code")[1]


@query(
    "station_orders_cleared_and_set",
    ST + """SELECT b.code, b.class_mark_type AS mark_type, CASE WHEN d.code IS NOT NULL THEN d.class_order END AS "order"
FROM fx_stations b LEFT JOIN fx_update_stations d ON b.code = d.code""",
)
def _(t):
    base = _station_maps(t.stations, Mark_Type="class_mark_type", Order="class_district")
    out = M.set_class(M.clear_class(base, "order"), t.update_stations.select("code", F.col("class_order").alias("value")), "Order")
    return out.select(
        "code", F.element_at("classes", F.lit("Mark_Type")).alias("mark_type"), F.element_at("classes", F.lit("Order")).alias("order")
    )


@query(
    "stations_in_natural_order",
    ST + "SELECT code, row_number() OVER (ORDER BY CAST(substr(code, 2) AS BIGINT)) AS place FROM fx_stations",
)
def _(t):
    from cairn.plans.ordered import number_rows

    keyed = t.stations.select("code", natural_key(F.col("code")).alias("k"))
    return number_rows(keyed, ["k"], "place", start=1).select("code", "place")


@query(
    "stations_sorted_by_class",
    ST + "SELECT code, class_mark_type FROM fx_stations ORDER BY class_mark_type DESC, CAST(substr(code, 2) AS BIGINT)",
)
def _(t):
    return M.sort_stations(t.stations, "class_mark_type", descending=True).select("code", "class_mark_type")


@query(
    "observations_sorted_by_line",
    with_views("mixed") + """SELECT least(from_code, to_code) AS a, greatest(from_code, to_code) AS b, obs_type, obs_key FROM fx_mixed
ORDER BY 1, 2, 3, 4""",
)
def _(t):
    out = M.sort_observations(t.mixed, "line")
    return out.select(F.least("from_code", "to_code").alias("a"), F.greatest("from_code", "to_code").alias("b"), "obs_type", "obs_key")


@query(
    "observations_sorted_by_size",
    with_views("residuals") + "SELECT obs_key, sres FROM fx_residuals ORDER BY sres DESC NULLS LAST, obs_key",
)
def _(t):
    return M.sort_observations(t.residuals, "sres").select("obs_key", "sres")


@query(
    "reference_direction_of_round",
    with_views("mixed") + """SELECT obs_key, first_value(noise) OVER (PARTITION BY set_id ORDER BY line_no, obs_key
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS reference FROM fx_mixed WHERE obs_type = 'HA'""",
)
def _(t):
    ha = t.mixed.filter("obs_type = 'HA'")
    return M.first_of_set(ha, "set_id", ["line_no", "obs_key"], "noise", "reference").select("obs_key", "reference")


@query(
    "class_names_cleaned",
    """SELECT p_partkey, replace(trim(concat(' ', p_name, '  ', p_type, ' ')), '  ', ' ') AS spaced, regexp_replace(trim(concat(' ', p_name, '  ', p_type, ' ')), '\\s+', '_', 'g') AS clean FROM part""",
)
def _(t):
    raw = F.concat(F.lit(" "), "p_name", F.lit("  "), "p_type", F.lit(" "))
    return t.part.select("p_partkey", F.replace(F.trim(raw), F.lit("  "), F.lit(" ")).alias("spaced"), clean_class_name(raw).alias("clean"))
