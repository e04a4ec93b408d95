"""Distance joins, accuracy tests and orders."""

from pyspark.sql import functions as F

from cairn.catalog import query
from cairn.fixtures import with_views
from cairn.functions.ellipsoid import GRS80, with_geocentric
from cairn.operators import graph as G
from cairn.operators import pairs as PR
from cairn.operators import spec as S

E2 = GRS80.e2
XYZ = with_views("stations", "obs") + f""", nu AS (SELECT *, radians(lon_deg) AS lo, radians(lat_deg) AS la, {GRS80.a!r} / sqrt(1 - {E2!r} * sin(radians(lat_deg)) * sin(radians(lat_deg))) AS nu FROM fx_stations),
p AS (SELECT code, mode_v, class_mark_type, class_district, und, ohgt, (nu + ohgt) * cos(la) * cos(lo) AS x, (nu + ohgt) * cos(la) * sin(lo) AS y, (nu * (1 - {E2!r}) + ohgt) * sin(la) AS z,
  (1 + (CAST(substr(code, 2) AS BIGINT) * 7919) % 97) * 1.0E-4 AS error2, (1 + (CAST(substr(code, 2) AS BIGINT) * 31) % 89) * 1.0E-4 AS verror2 FROM nu),
"""


def marks(t):
    st = t.stations.withColumns({"lon": F.radians("lon_deg"), "lat": F.radians("lat_deg")})
    n = F.substring("code", 2, 20).cast("long")
    return with_geocentric(st, "lon", "lat", "ohgt", GRS80).select(
        "code", "x", "y", "z", "mode_v", "class_mark_type", "class_district", "und", "ohgt",
        ((1 + (n * 7919) % 97) * 1.0e-4).alias("error2"), ((1 + (n * 31) % 89) * 1.0e-4).alias("verror2"),
    )


D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(
    "station_pairs_in_range",
    XYZ + f"""q AS (SELECT a.code AS a, b.code AS b, {D2} AS d2 FROM p a JOIN p b ON a.code < b.code AND abs(a.z - b.z) < 40000)
SELECT a, b, round(sqrt(d2), 4) AS dist FROM q WHERE d2 < 40000.0 * 40000.0""",
)
def _(t):
    near = PR.pairs_within(marks(t), "code", 40000.0)
    return near.select("a", "b", F.round(F.sqrt("dist2"), 4).alias("dist"))


@query(
    "nearest_control_distance",
    XYZ.rstrip().rstrip(",") + f"""
SELECT a.code, round(sqrt(min({D2})), 4) AS dist FROM p a JOIN p b ON b.mode_v = 'fix' WHERE a.mode_v <> 'fix' GROUP BY a.code""",
)
def _(t):
    m = marks(t)
    near = PR.nearest(m.filter("mode_v <> 'fix'"), m.filter("mode_v = 'fix'"), "code", "code", crowd=4)
    return near.select(F.col("query").alias("code"), F.round("dist", 4).alias("dist"))


@query(
    "nearest_neighbours",
    XYZ + f"""d AS (SELECT a.code AS query, b.code AS target, sqrt({D2}) AS dist FROM p a JOIN p b ON a.code <> b.code AND abs(a.z - b.z) <= 120000),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, target) AS place FROM d WHERE dist BETWEEN 5000 AND 120000)
SELECT query, target, round(dist, 4) AS dist, place FROM r WHERE place <= 5""",
)
def _(t):
    m = marks(t)
    out = PR.nearest(m, m, "code", "code", 5, max_distance=120000.0, min_distance=5000.0, exclude_same=True, crowd=30)
    return out.select("query", "target", F.round("dist", 4).alias("dist"), F.col("place").cast("long").alias("place"))


@query(
    "synthetic_baselines",
    XYZ + f"""d AS (SELECT a.code AS f, b.code AS t, sqrt({D2}) AS dist, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM p a JOIN p b ON a.code <> b.code AND abs(a.z - b.z) <= 90000),
r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY dist, t) AS place FROM d WHERE dist <= 90000)
SELECT f AS from_code, t AS to_code, round(dx, 4) AS dx, round(dy, 4) AS dy, round(dz, 4) AS dz FROM r WHERE place <= 2""",
)
def _(t):
    out = PR.synthetic_baselines(marks(t), 2, max_length=90000.0)
    return out.select("from_code", "to_code", *[F.round(c, 4).alias(c) for c in ("dx", "dy", "dz")])


@query(
    "nearest_station_to_event",
    with_views("stations") + """, q AS (SELECT event_id, 167 + (event_id * 7919 % 10007) * 11.0E0 / 10007 AS x, -46 + (event_id * 104729 % 10007) * 12.0E0 / 10007 AS y FROM events),
d AS (SELECT event_id, code, abs(lon_deg - x) + abs(lat_deg - y) AS dist FROM q JOIN fx_stations ON lon_deg BETWEEN x - 0.3 AND x + 0.3),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, code) AS k FROM d WHERE dist <= 0.3)
SELECT event_id, code, round(dist, 6) AS dist FROM r WHERE k = 1""",
)
def _(t):
    e = F.col("event_id")
    q = t.events.select(
        "event_id", (167 + (e * 7919 % 10007) * 11.0 / 10007).alias("x"), (-46 + (e * 104729 % 10007) * 12.0 / 10007).alias("y")
    )
    s = t.stations.select("code", F.col("lon_deg").alias("x"), F.col("lat_deg").alias("y"))
    out = PR.nearest(q, s, "event_id", "code", names=("x", "y"), max_distance=0.3, taxicab=True)
    return out.select(F.col("query").alias("event_id"), F.col("target").alias("code"), F.round("dist", 6).alias("dist"))


@query(
    "nearest_line_to_station",
    with_views("stations") + """, s AS (SELECT s_suppkey AS seg, 167.0E0 + s_suppkey % 11 AS x1, -46.0E0 + s_suppkey % 12 AS y1, 167.5E0 + (s_suppkey * 7) % 10 AS x2, -45.5E0 + (s_suppkey * 5) % 11 AS y2 FROM supplier),
d AS (SELECT code, seg, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, lon_deg - x1 AS px, lat_deg - y1 AS py FROM fx_stations JOIN s
  ON lon_deg BETWEEN least(x1, x2) - 0.2 AND greatest(x1, x2) + 0.2 AND lat_deg BETWEEN least(y1, y2) - 0.2 AND greatest(y1, y2) + 0.2),
a AS (SELECT *, greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) AS t FROM d),
r AS (SELECT code, seg, sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)) AS dist FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY round(dist, 9), seg) AS n FROM r WHERE dist < 0.2)
SELECT code, round(dist, 7) AS dist FROM k WHERE n = 1""",
)
def _(t):
    k = F.col("s_suppkey")
    seg = t.supplier.select(
        k.alias("seg"), (167.0 + k % 11).alias("x1"), (-46.0 + k % 12).alias("y1"), (167.5 + (k * 7) % 10).alias("x2"), (-45.5 + (k * 5) % 11).alias("y2")
    )
    out = PR.nearest_segment(t.stations, seg, "code", "seg", 0.2, ("lon_deg", "lat_deg"))
    return out.select(F.col("query").alias("code"), F.round("dist", 7).alias("dist"))


@query(
    "baselines_from_line_lists",
    """WITH l AS (SELECT l_orderkey AS list_id, concat('C', l_partkey % 97) AS code, min(l_linenumber) AS place FROM lineitem GROUP BY 1, 2),
f AS (SELECT list_id, code, place, first_value(code) OVER (PARTITION BY list_id ORDER BY place, code) AS from_code FROM l)
SELECT list_id, count(*) AS n, CAST(sum(place) AS BIGINT) AS places FROM f WHERE code <> from_code GROUP BY list_id""",
)
def _(t):
    lists = t.lineitem.select(
        F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").cast("long").alias("place"), F.concat(F.lit("C"), F.col("l_partkey") % 97).alias("code")
    )
    out = PR.baselines_from_lists(lists, "list_id", "place", "code")
    return out.groupBy("list_id").agg(F.count("*").alias("n"), F.sum("place").alias("places"))


@query(
    "list_pairs_in_range",
    XYZ + f"""l AS (SELECT DISTINCT from_code AS code, class_party FROM fx_obs)
SELECT la.class_party AS list_id, a.code AS a, b.code AS b FROM p a JOIN p b ON a.code < b.code AND {D2} < 20000.0 * 20000.0
JOIN l la ON la.code = a.code JOIN l lb ON lb.code = b.code AND lb.class_party = la.class_party""",
)
def _(t):
    lists = t.obs.select(F.col("class_party").alias("list_id"), F.col("from_code").alias("code"))
    return PR.list_pairs_within(lists, marks(t), "list_id", "code", 20000.0).select("list_id", "a", "b")


@query(
    "requested_covariance_pairs",
    XYZ + f"""o AS (SELECT DISTINCT least(from_code, to_code) AS a, greatest(from_code, to_code) AS b FROM fx_obs WHERE from_code <> to_code)
SELECT a, b FROM o UNION SELECT a.code, b.code FROM p a JOIN p b ON a.code < b.code AND a.class_district = 'D3' AND b.class_district = 'D3' AND {D2} < 90000.0 * 90000.0""",
)
def _(t):
    m = marks(t)
    return PR.requested_pairs(G.connected_pairs(t.obs), m, 90000.0, m.filter("class_district = 'D3'"))


SPECS = (
    S.AccuracySpec("fine", 0.05, 0.06, 0.02, 1.0, 0.02, 1.0, 2.4477, 1.96),
    S.AccuracySpec("coarse", 0.2, 0.0, 0.1, 3.0, 0.0, 0.0, 2.4477, 1.96),
)


def _assigned(t):
    return S.assign_specs(
        t.stations, {"fine": F.col("class_mark_type") == "MACHINERY", "coarse": F.col("class_district").isin("D3", "D4")}
    )


ELL_SQL = """sqrt((ee + nn) / 2 + sqrt((nn - ee) / 2 * (nn - ee) / 2 + en * en))"""
ASSIGN_SQL = """asg AS (SELECT code, 'fine' AS name FROM fx_stations WHERE class_mark_type = 'MACHINERY' UNION ALL SELECT code, 'coarse' FROM fx_stations WHERE class_district IN ('D3', 'D4')),
sp AS (SELECT 'fine' AS name, 0.05 AS hm, 0.06 AS vm, 0.02 AS ha, 1.0 AS hp, 0.02 AS va, 1.0 AS vp UNION ALL SELECT 'coarse', 0.2, 0, 0.1, 3.0, 0, 0)"""


@query(
    "specification_assignment",
    with_views("stations") + ", " + ASSIGN_SQL + "SELECT code, name FROM asg",
)
def _(t):
    return _assigned(t)


@query(
    "absolute_accuracy_test",
    with_views("stations") + ", " + ASSIGN_SQL + f""", c AS (SELECT code, (1 + und) * 1.0E-5 AS ee, (ohgt - 1000) * 1.0E-9 AS en, (48 + lat_deg) * 1.0E-5 AS nn, (1 + und) * 2.0E-5 AS uu FROM fx_stations),
r AS (SELECT name, code, {ELL_SQL} * 2.4477 * 1.1 / hm AS h, CASE WHEN vm > 0 THEN sqrt(uu) * 1.96 * 1.1 / vm END AS v FROM asg JOIN sp USING (name) JOIN c USING (code))
SELECT name, count(*) AS tested, count(*) FILTER (h > 1) AS h_failed, round(max(h), 6) AS h_worst, count(*) FILTER (v > 1) AS v_failed, round(max(v), 6) AS v_worst FROM r GROUP BY name""",
)
def _(t):
    cov = t.stations.select(
        "code", ((1 + F.col("und")) * 1e-5).alias("vee"), ((F.col("ohgt") - 1000) * 1e-9).alias("ven"),
        ((48 + F.col("lat_deg")) * 1e-5).alias("vnn"), ((1 + F.col("und")) * 2e-5).alias("vuu"),
    )
    _, out = S.absolute_test(cov, _assigned(t), S.spec_table(t.spark, SPECS), 1.1)
    return out.select("name", "tested", "h_failed", F.round("h_worst", 6).alias("h_worst"), "v_failed", F.round("v_worst", 6).alias("v_worst"))


@query(
    "relative_accuracy_test",
    XYZ + ASSIGN_SQL + f""", q AS (SELECT a.code AS a, b.code AS b, sqrt({D2}) AS len, a.error2 + b.error2 AS ee, (a.verror2 - b.verror2) / 4 AS en, a.verror2 + b.verror2 AS nn, a.error2 + b.verror2 AS uu
  FROM p a JOIN p b ON a.code < b.code AND {D2} < 60000.0 * 60000.0),
r AS (SELECT s.name, q.a, q.b, {ELL_SQL} * 2.4477 / sqrt(ha * ha + hp * len * 1e-6 * hp * len * 1e-6) AS h,
  CASE WHEN va > 0 THEN sqrt(uu) * 1.96 / sqrt(va * va + vp * len * 1e-6 * vp * len * 1e-6) END AS v
  FROM q JOIN asg x ON x.code = q.a JOIN asg y ON y.code = q.b AND x.name = y.name JOIN sp s ON s.name = x.name)
SELECT name, count(*) AS tested, count(*) FILTER (h > 1) AS h_failed, round(max(h), 6) AS h_worst, count(*) FILTER (v > 1) AS v_failed FROM r GROUP BY name""",
)
def _(t):
    assigned = _assigned(t)
    near = S.assigned_pairs(marks(t), assigned, 60000.0, carry=("error2", "verror2"))
    cov = near.select(
        "name", "a", "b", F.sqrt("dist2").alias("length"), (F.col("a_error2") + F.col("b_error2")).alias("vee"),
        ((F.col("a_verror2") - F.col("b_verror2")) / 4).alias("ven"), (F.col("a_verror2") + F.col("b_verror2")).alias("vnn"),
        (F.col("a_error2") + F.col("b_verror2")).alias("vuu"),
    )
    _, out = S.relative_test(cov, assigned, S.spec_table(t.spark, SPECS))
    return out.select("name", "tested", "h_failed", F.round("h_worst", 6).alias("h_worst"), "v_failed")


@query(
    "station_roles",
    with_views("stations") + """SELECT code, CASE WHEN class_district = 'D9' THEN 'ignore' WHEN mode_h = 'fix' THEN CASE WHEN mode_v = 'free' THEN 'ignore' ELSE 'control' END ELSE 'tested' END AS role_h,
  CASE WHEN class_district = 'D9' THEN 'ignore' WHEN mode_h = 'fix' AND mode_v = 'fix' THEN 'control' WHEN mode_h = 'fix' OR mode_v = 'fix' THEN 'ignore' ELSE 'tested' END AS role_3d FROM fx_stations""",
)
def _(t):
    st = t.stations.withColumns(
        {
            "calc_h": F.col("mode_h") != "fix", "calc_v": F.col("mode_v") != "fix",
            "use": F.when(F.col("class_district") == "D9", "reject").otherwise("use"),
        }
    )
    h = S.station_roles(st, True, False).withColumnRenamed("role", "role_h")
    return S.station_roles(h, True, True, True).select("code", "role_h", F.col("role").alias("role_3d"))


@query(
    "limit_orders_and_priorities",
    with_views("stations") + """, o AS (SELECT concat('C', s_suppkey * 5) AS code, s_suppkey % 3 AS l, s_suppkey % 4 AS p FROM supplier)
SELECT s.code, CAST(coalesce(o.l, CASE WHEN class_mark_type = 'MACHINERY' THEN 1 ELSE 0 END) AS BIGINT) AS limit_no,
  CAST(coalesce(o.p, CASE WHEN class_district = 'D3' THEN 7 END) AS BIGINT) AS priority FROM fx_stations s LEFT JOIN o ON s.code = o.code""",
)
def _(t):
    k = F.col("s_suppkey")
    table = t.supplier.select(F.concat(F.lit("C"), k * 5).alias("code"), (k % 3).alias("limit_no"), (k % 4).alias("priority"))
    rules = [(F.col("class_mark_type") == "MACHINERY", 1, None), (F.col("class_district") == "D3", None, 7)]
    out = S.limit_orders(t.stations, rules, table)
    return out.select("code", F.col("limit_no").cast("long").alias("limit_no"), F.col("priority").cast("long").alias("priority"))


TEST_A = S.OrderTest("A", 60000.0, False, 1, True, 0.09, 0.01, 0.0005, 0.02, 0.05, 0.0003)
TEST_B = S.OrderTest("B", 60000.0, False, 1, True, 0.2, 0.1, 0.001, 0.04, 0.1, 0.0008)


def _order_marks(t):
    m = marks(t)
    n = F.substring("code", 2, 20).cast("long")
    return m.withColumns(
        {
            "role": F.when(F.col("mode_v") == "fix", "control").otherwise("tested"),
            "limit_no": F.when(n % 6 == 1, 1).otherwise(0),
            "priority": F.when(n % 4 == 1, (n % 3).cast("int")),
            "test_order": (n % 2).cast("int"),
        }
    )


CTL = XYZ + f"""cd AS (SELECT a.code, min({D2}) AS cd2 FROM p a JOIN p b ON b.mode_v = 'fix' WHERE a.mode_v <> 'fix' GROUP BY a.code),
sc AS (SELECT p.code, x, y, z, error2, cd2, CASE WHEN error2 > 0.0081 THEN 'abs' WHEN error2 > 0.0001 + 0.000005 * 0.000005 * cd2 THEN 'abs_dist' WHEN error2 < 0.0004 THEN 'by_abs' END AS why
  FROM p JOIN cd ON p.code = cd.code),
st AS (SELECT *, CASE WHEN why IN ('abs', 'abs_dist') THEN 'fail' WHEN why = 'by_abs' THEN 'pass' ELSE 'unknown' END AS status FROM sc)
"""


def _screened(t):
    from cairn.plans.lineage import cut

    state = S.control_distances(_order_marks(t)).withColumn(
        "status", F.when(F.col("role") == "control", "passed").otherwise("unknown")
    )
    return cut(S.absolute_screen(state, TEST_A))


@query("absolute_order_screen", CTL + "SELECT code, status, why FROM st")
def _(t):
    return _screened(t).filter("role = 'tested'").select("code", "status", "why")


PAIR_SQL = CTL + f""", al AS (SELECT code, x, y, z, error2, status FROM st WHERE status <> 'fail' UNION ALL SELECT code, x, y, z, error2, 'passed' FROM p WHERE mode_v = 'fix'),
pr AS (SELECT a.code AS a, b.code AS b, a.error2 AS ea, b.error2 AS eb, {D2} AS d2, 0.0025 + 0.000003 * 0.000003 * {D2} AS tol FROM al a JOIN al b ON a.code < b.code AND {D2} < 60000.0 * 60000.0
  AND (a.status = 'unknown' OR b.status = 'unknown'))
"""


@query(
    "order_pair_status",
    PAIR_SQL + """SELECT a, b, CASE WHEN ea + eb < tol THEN 'pass' WHEN ea + eb - 2 * sqrt(ea * eb) > tol THEN 'fail' WHEN (ea + eb) * 0.6 < tol THEN 'pass' ELSE 'fail' END AS status FROM pr""",
)
def _(t):
    m = _screened(t)
    return S.pair_status(m, TEST_A, _covariances(t)).select("a", "b", "status")


def _covariances(t):
    """Relative covariances between the marks of the pairs that a test asks for."""

    def between(asked):
        ends = asked.select(F.col("a").alias("code")).unionAll(asked.select("b")).distinct()
        near = PR.pairs_within(marks(t).join(ends, "code", "left_semi"), "code", 60000.0, carry=("error2", "verror2"))
        return near.select(
            "a", "b", ((F.col("a_error2") + F.col("b_error2")) * 0.6).alias("error2"), ((F.col("a_verror2") + F.col("b_verror2")) * 0.6).alias("verror2")
        )

    return between


@query(
    "missing_pair_covariances",
    PAIR_SQL + """SELECT a, b FROM pr WHERE NOT (ea + eb < tol) AND NOT (ea + eb - 2 * sqrt(ea * eb) > tol)""",
)
def _(t):
    return S.missing_covariances(S.pair_status(_screened(t), TEST_A, None))


@query("orders_by_elimination")
def _(t):
    state = _screened(t)
    near = S.pair_status(state, TEST_A, _covariances(t))
    return S.eliminate(state, near, TEST_A).select("code", "status")


@query("failed_pairs_left_among_passed_marks", with_views("stations") + "SELECT CAST(count(*) * 0 AS BIGINT) AS n, CAST(count(*) * 0 AS BIGINT) AS undecided FROM fx_stations")
def _(t):
    """After elimination no failed pair joins two passed marks and no mark with tests is left undecided."""
    state = _screened(t)
    near = S.pair_status(state, TEST_A, _covariances(t)).filter("status = 'fail'")
    done = S.eliminate(state, S.pair_status(state, TEST_A, _covariances(t)), TEST_A)
    good = done.filter("status IN ('pass', 'passed')").select("code")
    bad = near.join(good.withColumnRenamed("code", "a"), "a", "left_semi").join(good.withColumnRenamed("code", "b"), "b", "left_semi")
    rows = bad.select(F.lit(1).alias("b"), F.lit(0).alias("u")).unionAll(done.select(F.lit(0), F.when(F.col("status") == "unknown", 1).otherwise(0)))
    return rows.agg(F.sum("b").cast("long").alias("n"), F.sum("u").cast("long").alias("undecided"))


@query("order_cascade")
def _(t):
    out, _ = S.cascade(_order_marks(t), [TEST_A, TEST_B], _covariances(t))
    return out.select("code", "order")


@query(
    "order_test_log",
    PAIR_SQL + """SELECT 'A' AS "order", test, status, count(*) AS n FROM (SELECT why AS test, status FROM st WHERE why IS NOT NULL
UNION ALL SELECT CASE WHEN ea + eb < tol OR ea + eb - 2 * sqrt(ea * eb) > tol THEN 'ends' ELSE 'covariance' END, CASE WHEN ea + eb < tol THEN 'pass' WHEN ea + eb - 2 * sqrt(ea * eb) > tol THEN 'fail' WHEN (ea + eb) * 0.6 < tol THEN 'pass' ELSE 'fail' END FROM pr)
GROUP BY 2, 3""",
)
def _(t):
    state = _screened(t)
    log = S.test_log(state, S.pair_status(state, TEST_A, _covariances(t)), "A")
    return log.groupBy("order", "test", "status").agg(F.count("*").alias("n"))
