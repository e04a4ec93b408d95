"""A three-dimensional network adjusted end to end, with its covariances, residuals and reports.

Stations with neighbouring numbers form blocks of twenty, joined by baselines,
distances, direction rounds and height differences that Spark derives from the
station table; every tenth station is control. Block by block the network is
small, and the number of blocks grows with the table.
"""

from pyspark.sql import functions as F

from cairn.catalog import query
from cairn.fixtures import with_views
from cairn.functions.ellipsoid import GRS80, geocentric
from cairn.operators import adjust as A
from cairn.operators import covariance as CV
from cairn.operators import deform as DF
from cairn.operators import normal as N
from cairn.operators import observe as O
from cairn.operators import residuals as RS
from cairn.operators import solve as V
from cairn.operators import unknowns as U
from cairn.sinks import tables as K

BLOCK = 20


def truth(t):
    """True positions: block origins spread out, members some kilometres apart."""
    n = F.substring("code", 2, 20).cast("long")
    k = F.pmod(n, F.lit(BLOCK))
    b = F.floor(n / BLOCK)
    return t.stations.select(
        "code", n.alias("n"), b.alias("block"),
        F.radians(F.lit(168.0) + F.pmod(b * 7, F.lit(40)) * 0.2 + F.pmod(k * 7, F.lit(20)) * 0.004).alias("lon"),
        F.radians(F.lit(-45.0) + F.pmod(b * 3, F.lit(50)) * 0.2 + F.pmod(k * 3, F.lit(20)) * 0.003).alias("lat"),
        (F.pmod(n * 613, F.lit(300)) * 1.0).alias("ohgt"), F.lit(12.0).alias("und"),
    )


def start(t, control: bool = True):
    """Initial positions: free stations are off by up to a decimetre."""
    free = F.col("n") % 10 != 0
    off = F.when(free, (F.pmod(F.col("n") * 37, F.lit(11)) - 5) * 1.5e-9).otherwise(0.0)
    mode = F.when(free, "free").otherwise("fix") if control else F.lit("free")
    return truth(t).select(
        "code", (F.col("lon") + off).alias("lon"), (F.col("lat") - off).alias("lat"), (F.col("ohgt") + off * 1.0e7).alias("ohgt"), "und",
        mode.alias("mode_h"), mode.alias("mode_v"),
    )


def observations(t):
    """Lines to the next three members of the block: a baseline to each, and a distance, a direction or a height difference."""
    s = truth(t)
    cols = ["lon", "lat", "ohgt", "und"]
    f = s.select(F.col("code").alias("from_code"), "n", "block", *[F.col(c).alias(f"f_{c}") for c in cols])
    reach = f.withColumn("step", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("m", F.col("n") + F.col("step"))
    o = s.select(F.col("code").alias("to_code"), F.col("n").alias("m"), F.col("block").alias("_b"), *[F.col(c).alias(f"t_{c}") for c in cols])
    lines = reach.join(o, "m").filter("block = _b")
    kinds = F.array(F.lit("GB"), F.element_at(F.array(F.lit("SD"), F.lit("HA"), F.lit("LV")), F.col("step")))
    rows = lines.withColumn("obs_type", F.explode(kinds))
    noise = (F.pmod(F.col("n") * 131 + F.col("step") * 17, F.lit(21)) - 10) * 1.0e-4
    calc = O.calculate(rows.withColumn("noise", noise))
    turned = F.pmod(F.col("n"), F.lit(6)).cast("double")
    value = F.when(F.col("obs_type") == "HA", F.col("calc") - turned + F.col("noise") * 1e-4).when(F.col("obs_type") == "GB", 0.0).otherwise(F.col("calc") + F.col("noise"))
    e2 = 4.0e-6
    vec = F.array(*[F.col(c) + F.col("noise") * w for c, w in (("dx", 1.0), ("dy", -0.5), ("dz", 0.7))])
    return calc.select(
        F.concat_ws("-", "from_code", "to_code", "obs_type").alias("obs_key"), F.concat(F.lit("R"), "from_code").alias("set_id"),
        "obs_type", "from_code", "to_code", value.alias("value"),
        F.when(F.col("obs_type") == "HA", 1.0e-6).otherwise(2.0e-3).alias("error"),
        F.when(F.col("obs_type") == "GB", vec).alias("vec"), F.array(*[F.lit(v) for v in (e2, e2 / 4, e2, 0.0, 0.0, e2 * 2)]).alias("cov"),
        (F.pmod(F.col("n"), F.lit(17)) == 3).alias("rejected"),
    )


def adjusted(t, **options):
    return A.adjust(observations(t), start(t), A.Options(max_iterations=4, **options))


def _off_truth(t, stations):
    true = truth(t).select("code", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.col("ohgt").alias("_h"))
    return stations.join(true, "code").select(
        "code", F.greatest(F.abs(F.col("lon") - F.col("_lon")) * 6.4e6, F.abs(F.col("lat") - F.col("_lat")) * 6.4e6, F.abs(F.col("ohgt") - F.col("_h"))).alias("off")
    )


@query("adjusted_network_positions", with_views("stations") + "SELECT code, true AS near_truth FROM fx_stations")
def _(t):
    """Adjusted positions land within two centimetres of the positions the observations were made from."""
    return _off_truth(t, adjusted(t).stations).select("code", (F.col("off") < 0.02).alias("near_truth"))


@query("preanalysis_covariances")
def _(t):
    run = adjusted(t, mode="preanalysis")
    cells = V.inverse_cells(run.matrix)
    return K.coordinate_covariances(run.stations, cells).filter("row_code = col_code").select(
        "row_code", "row_axis", "col_axis", F.round(F.col("value") * 1e6, 3).alias("mm2")
    )


@query(
    "data_check_residuals",
    with_views("stations") + """, k AS (SELECT CAST(substr(code, 2) AS BIGINT) AS n FROM fx_stations)
SELECT count(*) AS n FROM k a JOIN k b ON b.n - a.n BETWEEN 1 AND 3 AND a.n // 20 = b.n // 20""",
)
def _(t):
    run = adjusted(t, mode="datacheck")
    return run.equations.filter("weight = 1.0 AND component = 0").agg(F.count("*").alias("n"))


@query("free_network_singularities")
def _(t):
    run = A.adjust(observations(t), start(t, control=False), A.Options(mode="freenet", max_iterations=1))
    return V.singular_report(run.solution)


@query("network_residual_statistics")
def _(t):
    run = adjusted(t)
    inverse = V.inverse_cells(run.matrix)
    out = RS.residual_rows(run.equations.drop("set_coef"), run.solution, inverse)
    return out.groupBy("used").agg(
        F.count("*").alias("n"), F.count("sres").alias("tested"), F.round(F.avg(F.col("sres") * F.col("sres")), 3).alias("mean_square")
    )


@query("network_station_results")
def _(t):
    run = adjusted(t)
    cells = K.coordinate_covariances(run.stations, V.inverse_cells(run.matrix)).filter("row_code = col_code")
    pick = lambda a, b: F.coalesce(F.max(F.when((F.col("row_axis") == a) & (F.col("col_axis") == b), F.col("value"))), F.lit(0.0))
    cov = cells.groupBy(F.col("row_code").alias("code")).agg(
        pick("e", "e").alias("vee"), (pick("n", "e") + pick("e", "n")).alias("ven"), pick("n", "n").alias("vnn"), pick("u", "u").alias("vuu")
    )
    changes = RS.coordinate_changes(start(t), run.stations, GRS80)
    final = run.stations.withColumns({"name": F.col("code"), "lon": F.degrees("lon"), "lat": F.degrees("lat")})
    out = K.station_results(final, changes, cov, 2.45, max(run.stats["seu"], 1e-9))
    return out.select("code", F.round("longitude", 8).alias("longitude"), "mode", F.round("adj_e", 4).alias("adj_e"), F.round("errell_max", 5).alias("errell_max"))


@query("relative_covariances_of_observed_pairs")
def _(t):
    run = adjusted(t)
    cells = A.cut(V.inverse_cells(run.matrix))
    return relative_covariances(cells).select("a", "b", F.round(F.col("vee") * 1e6, 3).alias("vee"), F.round(F.col("vuu") * 1e6, 3).alias("vuu"))


def relative_covariances(cells):
    """Covariance of the difference of every pair of stations that shares inverse cells, in the axes of the cells."""
    parts = K.coordinate_covariances(cells.select(F.explode(F.array("row", "col")).alias("p")).select(F.split("p", r"\|")[0].alias("code")).distinct().withColumns(
        {"lon": F.lit(0.0), "lat": F.lit(0.0), "ohgt": F.lit(0.0)}), cells)
    axes = [("e", "e", "vee"), ("n", "n", "vnn"), ("u", "u", "vuu")]
    own = parts.filter("row_code = col_code AND row_axis = col_axis").groupBy("row_code").agg(
        *[F.max(F.when(F.col("row_axis") == a, F.col("value"))).alias(v) for a, _, v in axes]
    )
    cross = parts.filter("row_code <> col_code AND row_axis = col_axis").groupBy(
        F.least("row_code", "col_code").alias("a"), F.greatest("row_code", "col_code").alias("b")
    ).agg(*[F.max(F.when(F.col("row_axis") == x, F.col("value"))).alias(f"c_{v}") for x, _, v in axes])
    left = own.select(F.col("row_code").alias("a"), *[F.col(v).alias(f"a_{v}") for *_, v in axes])
    right = own.select(F.col("row_code").alias("b"), *[F.col(v).alias(f"b_{v}") for *_, v in axes])
    joined = cross.join(left, "a").join(right, "b")
    return joined.select("a", "b", *[(F.col(f"a_{v}") + F.col(f"b_{v}") - 2.0 * F.col(f"c_{v}")).alias(v) for *_, v in axes])


@query("correlated_sets_whitened")
def _(t):
    """Baselines of one station as a set with default correlated errors, whitened set by set."""
    from pyspark.sql import Window

    gb = observations(t).filter("obs_type = 'GB'")
    w = Window.partitionBy("set_id").orderBy("to_code")
    st = start(t).withColumn("free", F.lit("enu"))
    numbered = O.resolve_ends(gb.withColumn("i", F.row_number().over(w).cast("long")), st, A.STATION_COLUMNS)
    mid = {"lon": (F.col("f_lon") + F.col("t_lon")) / 2, "lat": (F.col("f_lat") + F.col("t_lat")) / 2}
    blocks = CV.default_set_blocks(numbered.withColumns(mid).select("set_id", "i", "vec", "lon", "lat"), (3.0, 3.0, 5.0), (1.0, 1.0, 1.0))
    unit = F.array(*[F.lit(v) for v in (1.0, 0.0, 1.0, 0.0, 0.0, 1.0)])
    rows = O.vector_rows(numbered.withColumn("cov", unit))
    white = CV.whiten_sets(rows.select("set_id", "i", "component", "misclosure", "design"), blocks)
    return white.groupBy("set_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("misclosure") ** 2), 4).alias("square"))


@query(
    "deformation_corrected_misclosures",
    with_views("levels", "stations") + """SELECT l.obs_key, round(l.value - (t.ohgt - f.ohgt) - CASE WHEN t.mode_v = 'free' THEN t.und * 0.001 ELSE 0 END + CASE WHEN f.mode_v = 'free' THEN f.und * 0.001 ELSE 0 END, 6) AS misclosure
FROM fx_levels l JOIN fx_stations f ON l.from_code = f.code JOIN fx_stations t ON l.to_code = t.code""",
)
def _(t):
    from cairn.catalog.adjustment import level_equations

    eq = level_equations(t).select("obs_key", "component", "misclosure", "design", F.lit(2010.5).alias("year"))
    moves = t.stations.select("code", F.lit(2010.5).alias("year"), F.lit(0.0).alias("de"), F.lit(0.0).alias("dn"), (F.col("und") * 0.001).alias("du"))
    return DF.corrected_misclosure(eq, moves).select("obs_key", F.round("misclosure", 6).alias("misclosure"))


@query(
    "parameters_numbered_by_component",
    with_views("stations") + """, k AS (SELECT concat('C', CAST(substr(code, 2) AS BIGINT)) AS code, CAST(substr(code, 2) AS BIGINT) // 20 AS b FROM fx_stations),
g AS (SELECT b, min(concat(code, '|u')) AS component FROM k GROUP BY b)
SELECT concat(code, '|u') AS param, component, row_number() OVER (ORDER BY component, concat(code, '|u')) - 1 AS row_no FROM k JOIN g USING (b)""",
)
def _(t):
    s = truth(t).select("code", "n", "block")
    nxt = s.select(F.col("code").alias("other"), (F.col("n") - 1).alias("n"), F.col("block").alias("_b"))
    p = lambda c: F.concat(c, F.lit("|u"))
    off = s.join(nxt, "n").filter("block = _b").select(F.least(p("code"), p("other")).alias("row"), F.greatest(p("code"), p("other")).alias("col"), F.lit(-1.0).alias("value"))
    diag = s.select(p("code").alias("row"), p("code").alias("col"), F.lit(3.0).alias("value"))
    return V.number_parameters(diag.unionByName(off)).select("param", "component", "row_no")


@query(
    "parameter_updates",
    """WITH p AS (SELECT concat('distsf|S', s_suppkey) AS name, s_acctbal AS value, s_suppkey % 2 = 0 AS adjusted FROM supplier)
SELECT name, round(value + CASE WHEN adjusted THEN 0.5 ELSE 0 END, 4) AS value, CASE WHEN adjusted THEN 4.0E0 END AS variance FROM p""",
)
def _(t):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("distsf|S"), k)
    params = t.supplier.select(name.alias("name"), F.col("s_acctbal").alias("value"))
    solution = t.supplier.filter(k % 2 == 0).select(name.alias("param"), F.lit(0.5).alias("x"))
    inverse = t.supplier.filter(k % 2 == 0).select(name.alias("row"), name.alias("col"), F.lit(4.0).alias("value"))
    return A.update_parameters(params, solution, inverse).select("name", F.round("value", 4).alias("value"), "variance")


@query(
    "accuracy_result_table",
    with_views("stations") + """SELECT code, round(und / 1000, 6) AS adj_e, round(sqrt(und * 1.0E-4), 7) AS errhor, CASE WHEN und > 20 THEN 'B' ELSE 'A' END AS calc_order FROM fx_stations""",
)
def _(t):
    m = t.stations.select(
        "code", (F.col("und") * 1e-4).alias("error2"), F.lit(0.0).alias("verror2"), F.lit(0).alias("limit_no"), F.lit(None).cast("int").alias("priority"),
        F.when(F.col("und") > 20, "B").otherwise("A").alias("order"),
    )
    adj = t.stations.select("code", (F.col("und") / 1000).alias("adj_e"), F.lit(0.0).alias("adj_n"), F.lit(0.0).alias("adj_h"))
    out = K.accuracy_results(m, adj)
    return out.select("code", F.round("adj_e", 6).alias("adj_e"), F.round("errhor", 7).alias("errhor"), "calc_order")


def level_line(t):
    """One line of height differences through all stations by number, from a bench mark: bordered cells, by SQL's own means."""
    n = F.substring("code", 2, 20).cast("long")
    s = t.stations.select("code", n.alias("n"), F.when(n == 1, 1.0e-4).otherwise(((n * 37) % 11 + 1) * 1.0e-6).alias("v"), (((n * 613) % 401 - 200) * 1.0e-4).alias("d"))
    before = s.select((F.col("n") + 1).alias("n"), F.col("code").alias("before"))
    ends = s.join(before, "n", "left")
    term = lambda c, k: F.struct(F.concat(c, F.lit("|u")).alias("param"), F.lit(k).alias("coef"))
    design = F.when(F.col("before").isNull(), F.array(term(F.col("code"), 1.0))).otherwise(F.array(term(F.col("code"), 1.0), term(F.col("before"), -1.0)))
    return N.split_cells(A.cut(N.normal_cells(ends.select(F.col("d").alias("misclosure"), (1.0 / F.col("v")).alias("weight"), design.alias("design")))))


LINE = """, s AS (SELECT CAST(substr(code, 2) AS BIGINT) AS n FROM fx_stations),
l AS (SELECT n, sum(CASE WHEN n = 1 THEN 1.0E-4 ELSE ((n * 37) % 11 + 1) * 1.0E-6 END) OVER w AS v, sum(((n * 613) % 401 - 200) * 1.0E-4) OVER w AS x FROM s WINDOW w AS (ORDER BY n))
"""


@query("long_line_heights", with_views("stations") + LINE + "SELECT concat('C', n, '|u') AS param, round(x, 7) AS x, false AS singular FROM l")
def _(t):
    """Heights along a line of all stations, solved over separators; the sums of the differences along the line."""
    matrix, rhs, _ = level_line(t)
    return V.solve(matrix, rhs, limit=100, stored=True).select("param", F.round("x", 7).alias("x"), "singular")


@query(
    "long_line_covariances",
    with_views("stations") + LINE + """, p AS (SELECT a.n AS a, b.n AS b, a.v FROM l a JOIN l b ON b.n - a.n IN (0, 1, 10))
SELECT greatest(concat('C', a, '|u'), concat('C', b, '|u')) AS row, least(concat('C', a, '|u'), concat('C', b, '|u')) AS col, round(v * 1.0E6, 4) AS mm2 FROM p""",
)
def _(t):
    """Variances, covariances of neighbours and of marks ten apart along a line of all stations, from one selected inversion."""
    matrix, _, _ = level_line(t)
    n = F.substring("code", 2, 20).cast("long")
    far = t.stations.select(F.concat("code", F.lit("|u")).alias("row"), F.concat(F.lit("C"), n + 10, F.lit("|u")).alias("col"))
    return V.inverse_cells(matrix, far, limit=100).select("row", "col", F.round(F.col("value") * 1e6, 4).alias("mm2"))


@query("station_blocks_by_dissection", with_views("stations") + "SELECT code, 6 AS cells, true AS same FROM fx_stations WHERE CAST(substr(code, 2) AS BIGINT) % 10 <> 0")
def _(t):
    """Every station's own block of the inverse of the three-dimensional network: over separators and by one dense inverse."""
    matrix = adjusted(t, mode="preanalysis").matrix
    code = lambda c: F.split(c, r"\|")[0]
    own = lambda df, name: df.filter(code("row") == code("col")).select("row", "col", F.col("value").alias(name))
    both = own(V.inverse_cells(matrix), "dense").join(own(V.inverse_cells(matrix, limit=10), "split"), ["row", "col"], "full")
    near = F.abs(F.col("dense") - F.col("split")) < 1.0e-9 * (F.abs("dense") + 1.0e-6)
    return both.groupBy(code("row").alias("code")).agg(F.count("*").cast("int").alias("cells"), F.bool_and(F.coalesce(near, F.lit(False))).alias("same"))


def point_sessions(t, frame: bool = False):
    """The network with points of every station in sessions of a block, each session off by a translation of its own (or by a frame's drift)."""
    s = truth(t)
    x, y, z = geocentric(F.col("lon"), F.col("lat"), F.col("ohgt") + F.col("und"), GRS80)
    b, year = F.col("block"), F.pmod(F.col("n"), F.lit(5)).cast("double")
    if frame:
        off = [0.25 + 0.01 * year, -0.125 + 0.02 * year, 0.5 - 0.005 * year]
    else:
        off = [F.pmod(b * k, F.lit(19)) * 0.01 - 0.05 for k in (3, 5, 7)]
    e2 = 4.0e-6
    points = s.select(
        F.concat(F.lit("P"), "code").alias("obs_key"), F.concat(F.lit("B"), b).alias("set_id"), F.lit("GX").alias("obs_type"), F.col("code").alias("from_code"),
        F.lit(None).cast("string").alias("to_code"), F.lit(0.0).alias("value"), F.lit(2.0e-3).alias("error"), F.array(*[c + o for c, o in zip((x, y, z), off)]).alias("vec"),
        F.array(*[F.lit(v) for v in (e2, e2 / 4, e2, 0.0, 0.0, e2 * 2)]).alias("cov"), F.lit(False).alias("rejected"),
    )
    if frame:
        points = points.withColumns({"frame": F.lit("drift"), "frame_years": F.pmod(F.substring("from_code", 2, 20).cast("long"), F.lit(5)).cast("double")})
    return points


@query(
    "session_translations",
    with_views("stations") + """, b AS (SELECT DISTINCT CAST(substr(code, 2) AS BIGINT) // 20 AS b FROM fx_stations),
k AS (SELECT * FROM (VALUES ('tx', 3), ('ty', 5), ('tz', 7)) v(name, k))
SELECT concat('B', b) AS set_id, name, round((b * k) % 19 * 1.0E-2 - 5.0E-2, 6) + 0.0 AS value FROM b, k""",
)
def _(t):
    """Three translations of every session of points, eliminated in the adjustment and found again from its solution."""
    odd = F.pmod("n", F.lit(2)) == 1
    off = F.when(odd, (F.pmod(F.col("n") * 37, F.lit(11)) - 5) * 1.5e-9).otherwise(0.0)
    mode = F.when(odd, "free").otherwise("fix")
    stations = truth(t).select("code", (F.col("lon") + off).alias("lon"), (F.col("lat") - off).alias("lat"), "ohgt", "und", mode.alias("mode_h"), mode.alias("mode_v"))
    run = A.adjust(point_sessions(t), stations, A.Options(max_iterations=3, translated_sets=True))
    return run.set_values.select("set_id", "name", (F.round("value", 6) + 0.0).alias("value"))


@query(
    "frame_translations_and_rates",
    """SELECT * FROM (VALUES ('tx', 2.5E-1), ('ty', -1.25E-1), ('tz', 5.0E-1), ('tx_rate', 1.0E-2), ('ty_rate', 2.0E-2), ('tz_rate', -5.0E-3)) v(name, value)
WHERE (SELECT count(*) FROM customer) > 0""",
)
def _(t):
    """A frame whose points drift: its translations and their rates, from points on marks held at their true positions; rotations and scale come out as zero."""
    held = truth(t).select("code", "lon", "lat", "ohgt", "und").withColumns({"mode_h": F.lit("fix"), "mode_v": F.lit("fix")})
    run = A.adjust(point_sessions(t, True), held, A.Options(max_iterations=1, frame_rates=True))
    parts = F.split("param", r"\|")
    found = run.solution.select(F.element_at(parts, 3).alias("name"), (F.round("x", 5) + 0.0).alias("value"))
    return found.filter(F.col("name").startswith("t"))


def exact_lines(t, kinds=("GB", "SD"), moves=None):
    """Error-free lines to the next three members of the block, in years of their own; with ``moves`` between marks as they stand in that year."""
    cols = ["lon", "lat", "ohgt", "und"]
    s = truth(t)
    ends = s.select(F.col("code").alias("from_code"), "n", "block").withColumn("step", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    to = s.select(F.col("code").alias("to_code"), F.col("n").alias("_m"), F.col("block").alias("_b"))
    rows = ends.join(to, (F.col("n") + F.col("step") == F.col("_m")) & (F.col("block") == F.col("_b"))).drop("_m", "_b")
    rows = rows.withColumn("obs_type", F.explode(F.array(*[F.lit(k) for k in kinds])))
    rows = rows.withColumns({"obs_key": F.concat_ws("-", "from_code", "to_code", "obs_type"), "year": 2000.0 + F.pmod("n", F.lit(4))})
    there = O.resolve_ends(rows, s, cols)
    there = U.displaced(there, moves) if moves is not None else there
    calc = O.calculate(there)
    e2 = 4.0e-6
    return calc.select(
        "obs_key", F.concat(F.lit("R"), "from_code").alias("set_id"), "obs_type", "from_code", "to_code", "year", "block", "step",
        F.coalesce("calc", F.lit(0.0)).alias("value"), (F.col("_chord") * 1.0e-6).alias("ppm"), F.lit(2.0e-3).alias("error"),
        F.when(F.col("obs_type") == "GB", F.array("dx", "dy", "dz")).alias("vec"), F.array(*[F.lit(v) for v in (e2, e2 / 4, e2, 0.0, 0.0, e2 * 2)]).alias("cov"),
    )


TRUE_PLACES = with_views("stations") + """, s AS (SELECT code, CAST(substr(code, 2) AS BIGINT) AS n FROM fx_stations), p AS (SELECT code, n, n % 20 AS k, n // 20 AS b FROM s)
SELECT code, round(1.68E2 + (b * 7) % 40 * 2.0E-1 + (k * 7) % 20 * 4.0E-3, 8) AS lon, round(-4.5E1 + (b * 3) % 50 * 2.0E-1 + (k * 3) % 20 * 3.0E-3, 8) AS lat, round((n * 613) % 300 * 1.0E0, 4) AS ohgt FROM p"""


def places(run):
    return run.stations.select("code", F.round(F.degrees("lon"), 8).alias("lon"), F.round(F.degrees("lat"), 8).alias("lat"), (F.round("ohgt", 4) + 0.0).alias("ohgt"))


def with_scales(t, instruments):
    """Distances by instruments of the blocks, each off by its own scale, which repeats every seven."""
    number = F.pmod("block", F.lit(instruments))
    off = F.when(F.col("obs_type") == "SD", F.col("ppm") * (F.pmod("block", F.lit(7)) * 0.5 - 1.0)).otherwise(0.0)
    return exact_lines(t).withColumns({"value": F.col("value") + off, "distsf": F.when(F.col("obs_type") == "SD", F.concat(F.lit("I"), number))})


SCALES = with_views("stations") + ", b AS (SELECT DISTINCT CAST(substr(code, 2) AS BIGINT) // 20 AS b FROM fx_stations)\n"


@query("distance_scales_by_instrument", SCALES + "SELECT DISTINCT concat('distsf|I', b % 7) AS param, round(b % 7 * 5.0E-1 - 1.0E0, 3) + 0.0 AS value FROM b")
def _(t):
    """The scale of every distance instrument, solved for together with the positions."""
    run = A.adjust(with_scales(t, 7), start(t), A.Options(max_iterations=3))
    return run.parameters.select("param", (F.round("value", 3) + 0.0).alias("value"))


@query(
    "tied_and_known_scales",
    SCALES + """SELECT DISTINCT concat('distsf|I', b % 14) AS param, least(concat('distsf|I', b % 7), concat('distsf|I', b % 7 + 7)) AS name, b % 7 <> 3 AS solve, round(b % 7 * 5.0E-1 - 1.0E0, 3) + 0.0 AS value FROM b""",
)
def _(t):
    """Instruments tied two by two; one pair's scale is known, a pattern gives the others a value to start from."""
    spark = t.stations.sparkSession
    ties = spark.range(7).select(F.concat(F.lit("distsf|I"), F.col("id") + 7).alias("param"), F.concat(F.lit("distsf|I"), "id").alias("same_as"))
    given = spark.createDataFrame([("distsf|*", 1.0, True), ("distsf|I3", 0.5, False), ("distsf|I10", 0.5, False)], "name string, value double, solve boolean")
    run = A.adjust(with_scales(t, 14), start(t), A.Options(max_iterations=3), U.Model(parameters=given, ties=ties))
    return run.parameters.select("param", "name", "solve", (F.round("value", 3) + 0.0).alias("value"))


@query("positions_of_moving_marks", TRUE_PLACES)
def _(t):
    """Positions of all marks at the model's epoch from lines between marks that move, the fixed ones too."""
    rate = [F.pmod(F.col("n") * k, F.lit(13)) * 0.01 - 0.06 for k in (3, 5, 7)]
    y = F.col("y")
    moves = truth(t).withColumn("y", F.explode(F.array(*[F.lit(float(v)) for v in range(4)]))).select(
        "code", (2000.0 + y).alias("year"), *[(r * y).alias(c) for r, c in zip(rate, ("de", "dn", "du"))]
    )
    return places(A.adjust(exact_lines(t, moves=moves), start(t), A.Options(max_iterations=4), U.Model(displacements=moves)))


@query("positions_from_correlated_sets", TRUE_PLACES)
def _(t):
    """Positions of all marks from baselines observed together at a mark, with the default covariances between them."""
    obs = exact_lines(t, ("GB",)).withColumn("i", F.col("step").cast("long"))
    ends = O.resolve_ends(obs, truth(t), ["lon", "lat"])
    mid = {"lon": (F.col("f_lon") + F.col("t_lon")) / 2, "lat": (F.col("f_lat") + F.col("t_lat")) / 2}
    blocks = CV.default_set_blocks(ends.withColumns(mid).select("set_id", "i", "vec", "lon", "lat"), (3.0, 3.0, 5.0), (1.0, 1.0, 1.0))
    return places(A.adjust(obs, start(t), A.Options(max_iterations=4), U.Model(blocks=blocks)))


@query("positions_of_paired_marks", TRUE_PLACES)
def _(t):
    """Positions of all marks where every third has no line of its own and is held to a witness mark that has them."""
    # Numbers are read with try_cast, as the planner may test witnesses too.
    bare = lambda c: F.coalesce(F.pmod(F.substring(c, 2, 20).try_cast("long"), F.lit(3)) == 1, F.lit(False))
    witness = lambda c: F.concat(F.lit("W"), F.col(c))
    s = start(t)
    own = s.filter(bare("code"))
    marks = s.unionByName(own.withColumns({"code": witness("code"), "mode_h": F.lit("free"), "mode_v": F.lit("free")}))
    pairs = own.select(F.col("code").alias("a"), witness("code").alias("b"), F.lit(1.0e-3).alias("h_error"), F.lit(2.0e-3).alias("v_error"))
    obs = exact_lines(t).withColumns({c: F.when(bare(c), witness(c)).otherwise(F.col(c)) for c in ("from_code", "to_code")})
    run = A.adjust(obs, marks, A.Options(max_iterations=4), U.Model(colocated=pairs))
    return places(run).filter(~F.col("code").startswith("W"))
