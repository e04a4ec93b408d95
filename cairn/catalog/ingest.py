"""Readers run over text that Spark writes from the given tables."""

from pyspark.sql import functions as F

from cairn.catalog import query
from cairn.fixtures import with_views
from cairn.plans import ordered as OR
from cairn.sources import lines as LN
from cairn.sources import models as MD
from cairn.sources import observations as OB
from cairn.sources import solutions as SN
from cairn.sources import stations as SS
from cairn.sources import tables as TB

ST = with_views("stations")
LV = with_views("levels")
two = lambda v: F.lpad(v.cast("string"), 2, "0")


def _dms(seconds):
    """D M S text of whole seconds."""
    return F.concat_ws(" ", F.floor(seconds / 3600).cast("string"), (F.floor(seconds / 60) % 60).cast("string"), (seconds % 60).cast("string"))


def _station_lines(t):
    """One coordinate file per district: title, system, options, stations; every 50th station line is broken."""
    n = F.substring("code", 2, 20).cast("long")
    lat = F.floor(-F.col("lat_deg") * 3600).cast("long")
    lon = F.floor(F.col("lon_deg") * 3600).cast("long")
    body = t.stations.select(
        F.col("class_district").alias("file"), (n + 10).alias("line_no"),
        F.concat_ws(
            " ", "code", F.when(n % 50 == 7, "bad").otherwise(_dms(lat)), F.lit("S"), _dms(lon), F.lit("E"), F.col("ohgt").cast("string"),
            F.round("und", 1).cast("decimal(10,1)").cast("string"), "class_mark_type", "name", F.lit("! a note"),
        ).alias("text"),
    )
    files = t.stations.select(F.col("class_district").alias("file")).distinct()
    heads = None
    for k, line in enumerate(("Stations of a district", "NZGD2000", "options orthometric_heights no_deflections geoid_heights c=Mark_Type"), 1):
        part = files.select("file", F.lit(k).cast("long").alias("line_no"), F.lit(line).alias("text"))
        heads = part if heads is None else heads.unionByName(part)
    return heads.unionByName(body)


@query(
    "station_text_ingest",
    ST + """, p AS (SELECT *, CAST(floor(-lat_deg * 3600) AS BIGINT) AS la, CAST(floor(lon_deg * 3600) AS BIGINT) AS lo, CAST(substr(code, 2) AS BIGINT) AS n FROM fx_stations)
SELECT class_district AS file, 'NZGD2000' AS crdsys, code, name, round(-la / 3600.0, 9) AS lat_deg, round(lo / 3600.0, 9) AS lon_deg, ohgt, round(und, 1) AS und, class_mark_type AS mark_type FROM p WHERE n % 50 <> 7""",
)
def _(t):
    good, _ = SS.station_text(_station_lines(t))
    return good.select(
        "file", "crdsys", "code", "name", F.round("lat_deg", 9).alias("lat_deg"), F.round("lon_deg", 9).alias("lon_deg"), "ohgt", "und",
        F.element_at("classes", F.lit("Mark_Type")).alias("mark_type"),
    )


@query(
    "ingest_error_counts",
    ST + """SELECT class_district AS file, count(*) AS n, min(CAST(substr(code, 2) AS BIGINT) + 10) AS first_line FROM fx_stations WHERE CAST(substr(code, 2) AS BIGINT) % 50 = 7 GROUP BY class_district""",
)
def _(t):
    _, bad = SS.station_text(_station_lines(t))
    return LN.error_counts(bad).select("file", "n", "first_line")


@query(
    "station_csv_ingest",
    ST + """SELECT code, name, round(lon_deg, 6) AS lon_deg, round(-CAST(floor(-lat_deg * 3600) AS BIGINT) / 3600.0, 9) AS lat_deg, ohgt, class_mark_type AS mark FROM fx_stations""",
)
def _(t):
    lat = F.floor(-F.col("lat_deg") * 3600).cast("long")
    rows = t.stations.select(
        F.lit("s.csv").alias("file"), F.substring("code", 2, 20).cast("long").alias("line_no"), F.concat(F.lit(" "), "code").alias("CODE"), F.col("name").alias("NAME"),
        F.round("lon_deg", 6).cast("decimal(12,6)").cast("string").alias("X"), F.concat(_dms(lat), F.lit(" S")).alias("Y"), F.col("ohgt").cast("string").alias("H"),
        F.col("class_mark_type").alias("MRKT"),
    )
    good, _ = SS.station_csv(rows, SS.StationFormat("CODE", "X", "Y", "H", "NAME", classes={"Mark_Type": "MRKT"}))
    return good.select(
        "code", "name", F.round("lon_deg", 6).alias("lon_deg"), F.round("lat_deg", 9).alias("lat_deg"), "ohgt", F.element_at("classes", F.lit("Mark_Type")).alias("mark")
    )


@query(
    "published_station_list",
    ST + "SELECT code, round(ohgt * 1000, 3) AS x, round(und, 3) AS y, code AS name FROM fx_stations WHERE und > 5",
)
def _(t):
    rows = t.stations.select(
        "code", (F.col("ohgt") * 1000).cast("string").alias("X"), F.round("und", 3).cast("string").alias("Y"), F.when(F.col("und") > 5, F.lit("1.0")).otherwise("-").alias("Z")
    )
    return SS.published_stations(rows, "code", "X", "Y", "Z").select("code", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "name")


def _observation_lines(t):
    """One file per return flag of grouped direction-like height rounds: commands, an instrument line, then targets.

    The rows of an order are one group; the error and date commands change from group to group.
    """
    from pyspark.sql import Window

    # Positions come from the order of the sorted rows, six lines apart, so a group's head fits before its targets.
    src = t.mixed.select(F.lit("all.dat").alias("file"), "order_no", "line_no", "obs_key", "from_code", "to_code", "noise", "rejected", "obs_ts")
    numbered = OR.number_rows(src, ["order_no", "from_code", "line_no", "obs_key"], "k")
    w = Window.partitionBy("order_no")
    first = numbered.withColumn("_first", F.min("k").over(w) == F.col("k")).withColumn("k", F.col("k") * 6 + 10)
    value = F.concat(F.round((F.col("noise") + 2) * 1e6).cast("long").cast("string"), F.lit("e-6"))
    target = first.select(
        "file", (F.col("k") + 5).alias("line_no"),
        F.concat_ws(" ", F.concat(F.when(F.col("rejected"), "*").otherwise(""), "to_code"), value).alias("text"),
    )
    head = first.filter("_first")
    rows = target
    for step, text in enumerate(
        (
            F.concat(F.lit("#lv_error "), ((F.col("order_no") % 5) + 1).cast("string"), F.lit(" mm")),
            F.concat(F.lit("#date "), F.coalesce(F.date_format("obs_ts", "yyyy-MM-dd"), F.lit("unknown"))),
            F.lit("#data LV no_heights"),
            F.lit("! comment"),
            F.col("from_code"),
        )
    ):
        rows = rows.unionByName(head.select("file", (F.col("k") + step).alias("line_no"), text.alias("text")))
    return rows


OBS_SQL = with_views("mixed") + """, g AS (SELECT *, first_value(from_code) OVER w AS f, first_value(obs_ts) OVER w AS d FROM fx_mixed WINDOW w AS (PARTITION BY order_no ORDER BY from_code, line_no, obs_key))
"""


@query(
    "observation_text_ingest",
    OBS_SQL + """SELECT f AS from_code, to_code, rejected, round(error * 1e3, 6) AS error_mm, round(value, 6) AS value, CAST(date_diff('day', DATE '1970-01-01', CAST(d AS DATE)) AS DOUBLE) AS day
FROM (SELECT *, (order_no % 5 + 1) * 1.0E-3 AS error2, noise + 2 AS value FROM g) x, LATERAL (SELECT error2 AS e2)""".replace("round(error * 1e3, 6)", "round(error2 * 1e3, 6)"),
)
def _(t):
    good, _ = OB.observation_text(_observation_lines(t))
    return good.select(
        "from_code", "to_code", "rejected", F.round(F.col("error") * 1e3, 6).alias("error_mm"), F.round("value", 6).alias("value"), F.col("day").cast("double").alias("day")
    )


@query("observation_text_sets", OBS_SQL + "SELECT f AS from_code, count(*) AS n FROM g GROUP BY order_no, f")
def _(t):
    good, _ = OB.observation_text(_observation_lines(t))
    return good.groupBy("set_id").agg(F.max("from_code").alias("from_code"), F.count("*").alias("n")).drop("set_id")


def _csv_rows(t):
    k = F.col("order_no") * 10 + F.col("line_no")
    return t.mixed.select(
        F.col("data_file").alias("file"), k.alias("line_no"), F.col("from_code").alias("FROM"), F.col("to_code").alias("TO"),
        F.round(F.col("noise") + 5, 6).cast("decimal(12,6)").cast("string").alias("DIST"), F.round(F.col("noise") - 1, 6).cast("decimal(12,6)").cast("string").alias("HDIFF"),
        F.concat(F.lit("M"), F.col("line_no") % 4).alias("METH"), F.concat(F.lit("R"), F.col("order_no")).alias("SET"), "rejected", "obs_key",
    )


@query(
    "observation_csv_ingest",
    with_views("mixed") + """, e AS (SELECT *, CASE line_no % 4 WHEN 0 THEN 0.001E0 WHEN 1 THEN 0.002E0 ELSE 0.009E0 END AS err FROM fx_mixed)
SELECT 'SD' AS obs_type, from_code, to_code, round(noise + 5, 6) AS value, round(err * 1e3, 6) AS error_mm, rejected FROM e
UNION ALL SELECT 'LV', from_code, to_code, round(noise - 1, 6), 4.0E0, rejected FROM e WHERE line_no % 3 <> 0""",
)
def _(t):
    lookup = OB.Lookup({"M0": "0.001", "m1": "0.002"}, "0.009")
    c = F.col
    forms = [
        OB.ObservationFormat("SD", c("FROM"), c("TO"), c("DIST"), error=lookup.apply(c("METH")), rejected=c("rejected"), set_id=c("SET")),
        OB.ObservationFormat("LV", c("FROM"), c("TO"), c("HDIFF"), error=F.lit("0.004"), rejected=c("rejected"), ignore=c("line_no") % 10 % 3 == 0),
    ]
    good, _ = OB.observation_csv(_csv_rows(t), forms)
    return good.select("obs_type", "from_code", "to_code", F.round("value", 6).alias("value"), F.round(F.col("error") * 1e3, 6).alias("error_mm"), "rejected")


@query(
    "lookup_with_default",
    with_views("mixed", "recode") + """SELECT obs_key, coalesce(r.code_to, 'none') AS hit FROM fx_mixed m LEFT JOIN fx_recode r ON m.to_code = r.code_from""",
)
def _(t):
    table = t.recode.select(F.upper("code_from").alias("code"), F.col("code_to").alias("value"))
    return OB.lookup_join(t.mixed, table, "to_code", "value", "none", "hit").select("obs_key", "hit")


@query(
    "csv_set_continuation",
    """WITH r AS (SELECT o_orderkey AS k, concat('C', o_custkey % 3) AS f, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('S', o_orderkey // 4) END AS s FROM orders),
l AS (SELECT *, CASE WHEN s = lag(s) OVER (ORDER BY k) AND f = lag(f) OVER (ORDER BY k) THEN 0 ELSE 1 END AS b FROM r)
SELECT k AS line_no, CAST(sum(b) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS set_no FROM l""",
)
def _(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(
        F.lit("one.csv").alias("file"), k.alias("line_no"), F.lit(0).alias("part"), F.concat(F.lit("C"), F.col("o_custkey") % 3).alias("from_code"),
        F.when(k % 11 != 0, F.concat(F.lit("S"), F.floor(k / 4))).alias("set_text"),
    )
    return OB.continue_sets(rows).select("line_no", F.substring_index("set_id", "#", -1).alias("set_no"))


@query(
    "fixed_width_ingest",
    """WITH r AS (SELECT o_orderkey AS k, concat('A', o_custkey % 50) AS f, concat('B', o_custkey % 70) AS t FROM orders),
g AS (SELECT *, k - k % 3 AS h FROM r)
SELECT g.k AS line_no, h.f AS from_code, g.t AS to_code, round(g.k / 1000.0, 3) AS value, 0.005E0 AS error FROM g JOIN r h ON h.k = g.h""",
)
def _(t):
    k = F.col("o_orderkey")
    lines = t.orders.select(
        F.lit("old.gb").alias("file"), k.alias("line_no"),
        F.concat(
            F.rpad(F.when(k % 3 == 0, F.concat(F.lit("A"), F.col("o_custkey") % 50)).otherwise("0"), 10, " "),
            F.rpad(F.concat(F.lit("B"), F.col("o_custkey") % 70), 10, " "), F.lpad((k / 1000).cast("decimal(14,3)").cast("string"), 14, " "), F.lit("  0.005"),
        ).alias("text"),
    )
    good, _ = OB.fixed_width(lines, {"from_code": (1, 10), "to_code": (11, 10), "value": (21, 14), "error": (35, 7)}, "LV")
    return good.select("line_no", "from_code", "to_code", F.round("value", 3).alias("value"), "error")


@query(
    "observation_validation_defaults",
    with_views("mixed", "stations") + """SELECT obs_key, CASE WHEN class_method = 'O' THEN 'special' ELSE 'std' END AS refcoef,
  rejected OR from_code IN (SELECT code FROM fx_stations WHERE class_district = 'D4') OR to_code IN (SELECT code FROM fx_stations WHERE class_district = 'D4') AS rejected
FROM fx_mixed WHERE error > 0.0015""",
)
def _(t):
    ob = t.mixed.withColumns(
        {
            "file": F.col("data_file"), "value": F.col("noise"), "error": F.when(F.col("error") > 0.0015, F.col("error")),
            "classes": F.when(F.col("class_method") == "O", F.create_map(F.lit("refr"), F.lit("special"))).otherwise(F.create_map(F.lit("x"), F.lit("y"))),
        }
    )
    gone = t.stations.filter("class_district = 'D4'")
    good, _ = OB.validate(ob, {"refcoef": ("refr", "std")}, gone)
    return good.select("obs_key", "refcoef", "rejected")


@query(
    "file_registration",
    with_views("mixed") + """SELECT data_file AS file, CASE data_file WHEN 'FA' THEN 1 ELSE 2 END::BIGINT AS file_id, count(*) AS n FROM fx_mixed WHERE data_file IN ('FA', 'FN') GROUP BY data_file""",
)
def _(t):
    ob = t.mixed.withColumn("file", F.col("data_file"))
    files = ob.select(F.col("file").alias("path")).distinct().filter("path <> 'FR'").select(
        "path", F.when(F.col("path") == "FA", 1).otherwise(2).cast("long").alias("file_id"), F.lit("csv").alias("format"), F.lit(None).cast("string").alias("recode"),
        F.lit(1.0).alias("factor"),
    )
    return LN.register_files(ob, files).groupBy("file", "file_id").agg(F.count("*").alias("n"))


@query(
    "recode_csv_ingest",
    """SELECT concat('C', s_suppkey) AS code_from, concat('N', s_suppkey) AS code_to, s_suppkey % 5 = 0 AS reject, CASE WHEN s_suppkey % 2 = 0 THEN '1995-03-04' END AS date_from,
  CASE WHEN s_suppkey % 3 = 0 THEN '1997-01-02' END AS date_to FROM supplier""",
)
def _(t):
    k = F.col("s_suppkey")
    rows = t.supplier.select(
        F.lit("r.csv").alias("file"), k.alias("line_no"), F.concat(F.lit("C"), k).alias("codefrom"),
        F.concat(F.when(k % 5 == 0, "*").otherwise(""), F.lit("N"), k).alias("codeto"), F.when(k % 2 == 0, "4 Mar 1995").alias("datefrom"),
        F.when(k % 3 == 0, "1997-01-02").otherwise("").alias("dateto"),
    )
    good, _ = TB.recode_csv(rows)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return good.select("code_from", "code_to", "reject", day("date_from"), day("date_to"))


@query(
    "recode_text_ingest",
    """SELECT concat('C', s_suppkey) AS code_from, concat('N', s_suppkey) AS code_to, CASE s_suppkey % 3 WHEN 0 THEN '1995-01-01' WHEN 2 THEN '1996-02-03' END AS date_from,
  CASE s_suppkey % 3 WHEN 0 THEN '1996-01-01' WHEN 1 THEN '1994-05-06' END AS date_to, CASE WHEN s_suppkey % 3 = 0 THEN 0.01E0 ELSE 0.0E0 END AS h_error FROM supplier""",
)
def _(t):
    k = F.col("s_suppkey")
    tail = F.when(k % 3 == 0, " 0.01 between 1995-01-01 and 1996-01-01").when(k % 3 == 1, " before 1994-05-06").otherwise(" AFTER 1996-02-03 ! note")
    lines = t.supplier.select(F.lit("r").alias("file"), k.alias("line_no"), F.concat(F.lit("recode C"), k, F.lit(" to N"), k, tail).alias("text"))
    good, _ = TB.recode_text(lines)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return good.select("code_from", "code_to", day("date_from"), day("date_to"), "h_error")


@query(
    "station_offset_ingest",
    ST + """, k AS (SELECT code, CAST(substr(code, 2) AS BIGINT) AS n FROM fx_stations)
SELECT code, CASE n % 4 WHEN 0 THEN 'step' WHEN 1 THEN 'velocity' WHEN 2 THEN 'series' ELSE 'step' END AS mode, CASE WHEN n % 4 = 1 THEN 'xyz' ELSE 'enu' END AS frame, n % 4 = 2 AS is_deformation,
  CASE WHEN n % 4 = 2 THEN NULL ELSE CAST(date_diff('day', DATE '1970-01-01', DATE '2005-03-02') AS DOUBLE) END AS day,
  CASE n % 4 WHEN 3 THEN 0.0E0 WHEN 2 THEN -0.3E0 ELSE n / 10.0E0 END AS b1, CASE n % 4 WHEN 3 THEN n / 10.0E0 WHEN 2 THEN 0.5E0 ELSE 0.2E0 END AS b3, CASE WHEN n % 4 = 2 THEN 2 ELSE -1 END::BIGINT AS n_points FROM k""",
)
def _(t):
    n = F.substring("code", 2, 20).cast("long")
    v = (n / 10).cast("decimal(10,1)").cast("string")
    text = (
        F.when(n % 4 == 0, F.concat_ws(" ", "code", F.lit("2005-03-02"), v, F.lit("0.1 0.2")))
        .when(n % 4 == 1, F.concat_ws(" ", "code", F.lit("xyz offset velocity 2005-03-02"), v, F.lit("0.1 0.2")))
        .when(n % 4 == 2, F.concat_ws(" ", "code", F.lit("enu deformation time_series -0.3 0.1 0.5 2005-03-02 1 2 3 2006-03-02 4 5 6")))
        .otherwise(F.concat_ws(" ", "code", F.lit("height offset 2005-03-02"), v))
    )
    lines = t.stations.select(F.lit("o.sto").alias("file"), n.alias("line_no"), text.alias("text"))
    good, _ = TB.offset_text(lines)
    return good.select(
        "code", "mode", "frame", "is_deformation", F.col("day").cast("double").alias("day"), F.element_at("base", 1).alias("b1"), F.element_at("base", 3).alias("b3"),
        F.coalesce(F.size("points"), F.lit(-1)).cast("long").alias("n_points"),
    )


@query(
    "grid_text_ingest",
    """SELECT concat('g', s_suppkey % 4) AS file, s_suppkey // 10 AS iy, s_suppkey % 10 AS ix, round(s_acctbal, 2) AS v FROM supplier WHERE s_suppkey % 7 <> 0""",
)
def _(t):
    k = F.col("s_suppkey")
    lines = t.supplier.select(
        F.concat(F.lit("g"), k % 4).alias("file"), (k + 100).alias("line_no"),
        F.concat(F.lit("V"), k % 10 + 1, F.lit(","), F.floor(k / 10) + 1, F.lit(": "), F.when(k % 7 == 0, "*").otherwise(F.round("s_acctbal", 2).cast("decimal(12,2)").cast("string"))).alias("text"),
    )
    heads = [("CRDSYS: NZGD2000"), ("NGRDX: 10"), ("NGRDY: 11"), ("XMIN: 166"), ("XMAX: 175"), ("YMIN: -47"), ("YMAX: -37"), ("NDIM: 1"), ("LATLON: 1"), ("VALUES: REAL")]
    files = lines.select("file").distinct()
    for i, h in enumerate(heads):
        lines = lines.unionByName(files.select("file", F.lit(i).cast("long").alias("line_no"), F.lit(h).alias("text")))
    _, nodes = MD.grid_text(lines)
    return nodes.select("file", "iy", "ix", F.round(F.element_at("v", 1), 2).alias("v"))


@query(
    "geoid_text_ingest",
    """SELECT round(110 + (s_suppkey % 90) * 2 / 60.0, 6) AS lon_deg, round(-(10 + (s_suppkey % 70) / 2.0 ), 6) AS lat_deg, round(s_suppkey % 900 / 10.0 - 40, 3) AS und FROM supplier""",
)
def _(t):
    k = F.col("s_suppkey")
    lat, lon = k % 70, k % 90
    whole = (k % 900) / 10 - 40
    text = F.concat(
        F.lit("GEO"), F.lpad(whole.cast("decimal(9,3)").cast("string"), 9, " "), F.lit(" S"), two(10 + F.floor(lat / 2)), F.lit(" "), F.lpad(((lat % 2) * 30).cast("string"), 2, " "),
        F.lit("  0.000 E"), (110 + F.floor(lon * 2 / 60)).cast("string"), F.lit(" "), F.lpad((lon * 2 % 60).cast("string"), 2, " "), F.lit("  0.000"),
    )
    lines = t.supplier.select(F.lit("a.txt").alias("file"), k.alias("line_no"), text.alias("text"))
    out = MD.geoid_text(lines)
    return out.select(F.round("lon_deg", 6).alias("lon_deg"), F.round("lat_deg", 6).alias("lat_deg"), F.round("und", 3).alias("und"))


@query(
    "triangle_text_ingest",
    """SELECT s_suppkey + 100000 AS tri_id, s_suppkey % 13 * 1.0E0 AS x1, (s_suppkey + 1) % 13 * 1.0E0 AS x2, s_suppkey * 0.5E0 AS v1, (s_suppkey + 2) * 0.5E0 AS v3 FROM supplier WHERE s_suppkey + 2 < (SELECT count(*) FROM supplier)""",
)
def _(t):
    k = F.col("s_suppkey")
    points = t.supplier.select(F.lit("t").alias("file"), k.alias("line_no"), F.concat_ws(" ", F.lit("P"), k, k % 13, k % 17, (k * 0.5).cast("string")).alias("text"))
    tris = t.supplier.select(F.lit("t").alias("file"), (k + 100000).alias("line_no"), F.concat_ws(" ", F.lit("T"), k, k + 1, k + 2).alias("text"))
    out = MD.triangle_text(points.unionByName(tris))
    return out.select("tri_id", "x1", "x2", F.element_at("v1", 1).alias("v1"), F.element_at("v3", 1).alias("v3"))


@query(
    "deformation_model_ingest",
    """SELECT concat('m', s_suppkey) AS file, 2 AS seq, CAST(2 AS BIGINT) AS comps, concat('patch ', s_suppkey) AS name, 2020.0E0 + s_suppkey % 9 AS start_year FROM supplier""",
)
def _(t):
    k = F.col("s_suppkey")
    texts = [
        F.lit("DEFORMATION_MODEL test"), F.lit("DESCRIPTION"), F.lit("DEFORMATION_SEQUENCE not one"), F.lit("END_DESCRIPTION"), F.lit("DEFORMATION_SEQUENCE National"), F.lit("START_DATE 1-Jan-1850"),
        F.lit("END_DATE 1-Jan-2101"), F.lit("DEFORMATION_COMPONENT vel.gdf"), F.lit("MODEL_TYPE grid"), F.concat(F.lit("DEFORMATION_SEQUENCE patch "), k), F.concat(F.lit("START_DATE 1-Jan-"), 2020 + k % 9),
        F.lit("ZERO_BEYOND_RANGE yes"), F.lit("# note"), F.lit("DEFORMATION_COMPONENT a.trg"), F.lit("DEFORMATION_COMPONENT b.trg"),
    ]
    rows = t.supplier.select(F.concat(F.lit("m"), k).alias("file"), F.posexplode(F.array(*texts)).alias("p", "text")).select("file", F.col("p").cast("long").alias("line_no"), "text")
    seq, comp = MD.deformation_text(rows)
    counts = comp.groupBy("file", "seq_no").agg(F.count("*").alias("comps"))
    out = seq.filter("seq_no = 2").join(counts, ["file", "seq_no"])
    return out.select("file", F.col("seq_no").cast("int").alias("seq"), "comps", "name", F.round("start_year", 6).alias("start_year"))


def _solution_lines(t):
    """Solution files per district: an estimate block and a lower covariance triangle of single cells."""
    n = F.substring("code", 2, 20).cast("long")
    d = t.stations.withColumn("file", F.col("class_district"))
    est = None
    for i, a in enumerate("XYZ"):
        text = F.format_string(" %6d STA%s   %s  A 0001 01:333:43185 m    0 %.6e .560395E-02", n * 3 + i + 1, F.lit(a), F.col("code"), F.col("ohgt") * (i + 1))
        part = d.select("file", (n * 10 + i + 10).alias("line_no"), text.alias("text"))
        est = part if est is None else est.unionByName(part)
    base = 10_000_000_000
    cov = d.select("file", (n * 10 + base).alias("line_no"), F.format_string(" %6d %6d  %.6e", n * 3 + 1, n * 3 + 1, F.col("und") * 1e-6).alias("text"))
    cov = cov.unionByName(d.select("file", (n * 10 + base + 1).alias("line_no"), F.format_string(" %6d %6d  0.5E-06  0.2E-05", n * 3 + 2, n * 3 + 1).alias("text")))
    cov = cov.unionByName(d.select("file", (n * 10 + base + 2).alias("line_no"), F.format_string(" %6d %6d  0.1E-06  0.3E-06  0.4E-05", n * 3 + 3, n * 3 + 1).alias("text")))
    files = d.select("file").distinct()
    marks = [(1, "+SOLUTION/ESTIMATE"), (base - 2, "-SOLUTION/ESTIMATE"), (base - 1, "+SOLUTION/MATRIX_ESTIMATE L COVA"), (3 * base, "-SOLUTION/MATRIX_ESTIMATE L COVA"), (0, "%=SNX 2.00")]
    out = est.unionByName(cov)
    for at, text in marks:
        out = out.unionByName(files.select("file", F.lit(at).cast("long").alias("line_no"), F.lit(text).alias("text")))
    return out


@query(
    "solution_file_ingest",
    ST + """SELECT class_district AS file, code, ohgt * 2 AS y, ohgt * 3 AS z, round(und, 3) AS cxx, 0.3E0 AS czy, 4.0E0 AS czz FROM fx_stations""",
)
def _(t):
    points, cells, _ = SN.solution_points(_solution_lines(t))
    cov = SN.point_covariances(points, cells)
    c = lambda i: F.round(F.element_at("cov", i) * 1e6, 3)
    return points.join(cov, ["file", "code", "pt"]).select(
        "file", "code", F.element_at("vec", 2).alias("y"), F.element_at("vec", 3).alias("z"), c(1).alias("cxx"), c(5).alias("czy"), c(6).alias("czz")
    )


@query(
    "baseline_summary_ingest",
    with_views("mixed") + """SELECT from_code, to_code, round(noise * 1e4, 4) AS dx, round(noise * 2e4, 4) AS dz, 'fixed' AS solution, 4.0E0 AS cxx FROM fx_mixed""",
)
def _(t):
    keyed = t.mixed.select(F.concat(F.lit("f"), "data_file").alias("file"), "obs_key", "from_code", "to_code", "noise", "order_no")
    numbered = OR.number_rows(keyed, ["file", "obs_key"], "k")
    vec = F.format_string("dx %.4f dy %.4f dz %.4f", F.col("noise") * 1e4, F.lit(1.5), F.col("noise") * 2e4)
    texts = F.array(
        F.lit("Project Name: x"), F.concat(F.lit("From Station: "), "from_code"), F.concat(F.lit("To Station: "), "to_code"), F.lit("Solution Type: fixed"),
        F.concat(F.lit("Baseline Components: "), vec), F.lit("Standard Deviations: 0.002 0.003 0.004"),
    )
    lines = numbered.select("file", "k", F.posexplode(texts).alias("p", "text")).select("file", (F.col("k") * 10 + F.col("p")).alias("line_no"), "text")
    out = SN.labelled_summary(lines)
    return out.select(
        "from_code", "to_code", F.round(F.element_at("vec", 1), 4).alias("dx"), F.round(F.element_at("vec", 3), 4).alias("dz"), "solution", F.round(F.element_at("cov", 1) * 1e6, 3).alias("cxx")
    )


@query(
    "tagged_baseline_ingest",
    with_views("mixed") + """SELECT from_code, to_code, round(noise * 1e4, 4) AS dx, 4.0E0 AS c11, 12.0E0 AS c31, 16.0E0 AS c22 FROM fx_mixed""",
)
def _(t):
    keyed = t.mixed.select(F.lit("one.asc").alias("file"), "obs_key", "from_code", "to_code", "noise")
    numbered = OR.number_rows(keyed, ["obs_key"], "k")
    pad = lambda c: F.rpad(c, 16, " ")
    texts = F.array(
        F.concat(F.lit("@+"), pad("from_code"), F.lit(" 1 2 3")), F.concat(F.lit("@-"), pad("to_code"), F.format_string(" %.4f %.4f %.4f", F.col("noise") * 1e4, F.lit(2.0), F.lit(3.0))),
        F.lit("@=2.0 1.0 2.0 3.0 4.0 5.0 6.0"), F.lit("@*12/31/99 10:11:12"),
    )
    lines = numbered.select("file", "k", F.posexplode(texts).alias("p", "text")).select("file", (F.col("k") * 10 + F.col("p")).alias("line_no"), "text")
    out = SN.tagged_summary(lines)
    return out.select(
        "from_code", "to_code", F.round(F.element_at("vec", 1), 4).alias("dx"), F.element_at("cov", 1).alias("c11"), F.element_at("cov", 4).alias("c31"), F.element_at("cov", 3).alias("c22")
    )


@query(
    "xml_measurement_ingest",
    with_views("mixed") + """SELECT obs_key, CASE WHEN line_no % 2 = 0 THEN 'SD' ELSE 'AZ' END AS obs_type, from_code, to_code, round(CASE WHEN line_no % 2 = 0 THEN noise + 100 ELSE radians(12 + 34 / 60.0 + 56.78 / 3600.0) END, 8) AS value,
  rejected FROM fx_mixed""",
)
def _(t):
    even = F.col("line_no") % 2 == 0
    xml = F.concat(
        F.lit("<DnaMeasurement><Type>"), F.when(even, "S").otherwise("B"), F.lit("</Type><Ignore>"), F.when(F.col("rejected"), "*").otherwise(""), F.lit("</Ignore><First>"), "from_code",
        F.lit("</First><Second>"), "to_code", F.lit("</Second><Value>"), F.when(even, F.format_string("%.6f", F.col("noise") + 100)).otherwise("12.345678"), F.lit("</Value><StdDev>0.01</StdDev></DnaMeasurement>"),
    )
    good, _ = SN.xml_measurements(t.mixed.select("obs_key", xml.alias("xml")))
    return good.select("obs_key", "obs_type", "from_code", "to_code", F.round("value", 8).alias("value"), F.coalesce("rejected", F.lit(False)).alias("rejected"))


@query(
    "adjustment_report_ingest",
    ST + """SELECT code, round(und / 1000, 4) AS adj_e, round(und / 100, 4) AS errell_max, 45.0E0 AS errell_bmax FROM fx_stations""",
)
def _(t):
    text = F.concat(F.rpad("code", 12, " "), F.format_string("%8.4f %8.4f %8.4f %8.4f %8.4f %6.1f %8.4f", F.col("und") / 1000, F.lit(-0.01), F.lit(0.0), F.col("und") / 100, F.lit(0.001), F.lit(45.0), F.lit(0.02)))
    lines = t.stations.select(F.lit("r.lst").alias("file"), F.substring("code", 2, 20).cast("long").alias("line_no"), text.alias("text"))
    out = SN.report_test_data(lines)
    return out.select("code", F.round("adj_e", 4).alias("adj_e"), F.round("errell_max", 4).alias("errell_max"), "errell_bmax")
