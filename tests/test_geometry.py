import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.catalog import network as NW
from cairn.functions import projections as P
from cairn.functions.angles import format_dms, parse_dms, parse_hp
from cairn.functions.dates import parse_date
from cairn.functions.ellipsoid import GRS80, meridian_radius, prime_vertical
from cairn.functions import probability as PB
from cairn.functions.text import natural_code, natural_key, path_matches_wildcard
from cairn.operators import fix as X
from cairn.operators import observe as O
from cairn.operators import residuals as RS
from cairn.operators.grids import Grid, interpolate

RAD = math.pi / 180


@pytest.mark.parametrize(
    "projection",
    [
        P.TransverseMercator(173 * RAD, -20 * RAD, 0.9996, 1.6e6, 1.0e7), P.LambertConic(-37.5 * RAD, -44.5 * RAD, -41 * RAD, 173 * RAD, 3e6, 7e6),
        P.LambertConic(30 * RAD, 60 * RAD, 45 * RAD, 170 * RAD), P.PolarStereographic(170 * RAD, 0.994, 5e6, 1e6), P.PolarStereographic(170 * RAD, south=False),
        P.Mercator(160 * RAD, -41 * RAD), P.Gnomonic(173 * RAD, -41 * RAD, 10.0, 20.0), P.NewZealandMapGrid(),
    ],
    ids=lambda p: type(p).__name__,
)
def test_projection_round_trip(spark, projection):
    north = getattr(projection, "south", True) is False or getattr(projection, "sp1", -1) > 0
    lats = [40.0, 52.5, 61.0] if north else [-35.0, -41.0, -46.5]
    df = spark.createDataFrame([(lo * RAD, la * RAD) for lo in (168.0, 172.9, 177.5) for la in lats], "lon double, lat double")
    back = projection.inverse(projection.forward(df, "lon", "lat").withColumnsRenamed({"lon": "a", "lat": "b"}), "easting", "northing")
    worst = back.select(F.max(F.greatest(F.abs(F.col("lon") - F.col("a")), F.abs(F.col("lat") - F.col("b"))))).first()[0]
    assert worst < (2e-9 if isinstance(projection, P.NewZealandMapGrid) else 1e-11)


def test_design_rows_match_finite_differences(spark):
    base = {"f_lon": 3.01, "f_lat": -0.71, "f_ohgt": 120.0, "t_lon": 3.0103, "t_lat": -0.7098, "t_ohgt": 460.0, "f_und": 10.0, "t_und": 11.0, "from_hgt": 1.4, "to_hgt": 1.9,
            "f_xi": 2e-5, "f_eta": -3e-5}
    kinds = ["SD", "HD", "ED", "MD", "AZ", "HA", "ZD", "LV"]
    step = 0.5
    rows = []
    radius = spark.createDataFrame([(base["f_lat"],), (base["t_lat"],)], "lat double").select(
        "lat", meridian_radius(F.col("lat"), GRS80).alias("m"), prime_vertical(F.col("lat"), GRS80).alias("n")
    ).collect()
    size = {"f": radius[0], "t": radius[1]}
    for kind in kinds:
        rows.append((kind, "", 0, *base.values()))
        for end in "ft":
            h = base[f"{end}_ohgt"] + base[f"{end}_und"]
            for axis in "enu":
                for sign in (1, -1):
                    v = dict(base)
                    if axis == "e":
                        v[f"{end}_lon"] += sign * step / ((size[end].n + h) * math.cos(base[f"{end}_lat"]))
                    elif axis == "n":
                        v[f"{end}_lat"] += sign * step / (size[end].m + h)
                    else:
                        v[f"{end}_ohgt"] += sign * step
                    rows.append((kind, end + axis, sign, *v.values()))
    df = spark.createDataFrame(rows, "obs_type string, moved string, sign int, " + ", ".join(f"{k} double" for k in base))
    df = df.withColumns({"from_code": F.lit("f"), "to_code": F.lit("t"), "value": F.lit(0.0), "error": F.lit(1.0)})
    out = O.design_rows(df).select("obs_type", "moved", "sign", "calc", "design").collect()
    calc = {(r.obs_type, r.moved, r.sign): r.calc for r in out}
    for r in out:
        if r.moved:
            continue
        coef = {d.param[0] + d.param[2]: d.coef for d in r.design}
        for end in "ft":
            for axis in "enu":
                if r.obs_type in ("HD", "ED", "MD") and axis == "u":
                    continue  # the height reduction is held fixed in these
                numeric = (calc[r.obs_type, end + axis, 1] - calc[r.obs_type, end + axis, -1]) / (2 * step)
                scale = max(abs(numeric), 1e-3 if r.obs_type in ("AZ", "HA", "ZD") else 1.0)
                tolerance = 2e-3 if r.obs_type in ("AZ", "HA", "ZD", "HD", "ED", "MD") else 1e-4
                assert abs(coef.get(end + axis, 0.0) - numeric) < tolerance * scale, (r.obs_type, end, axis)


def test_probability_levels():
    assert abs(PB.chi2_quantile(0.95, 1) - 3.841458820694124) < 1e-9
    assert abs(PB.chi2_quantile(0.99, 10) - 23.209251158954356) < 1e-8
    assert abs(PB.f_quantile(0.95, 2, 10) - 4.10282101513) < 1e-8
    assert abs(PB.t_quantile(0.975, 10) - 2.2281388519649385) < 1e-9
    assert 1.0 < PB.tau_quantile(0.975, 10) < PB.t_quantile(0.975, 10)
    x = np.linspace(0.1, 30, 50)
    assert np.all(np.diff(PB.chi2_cdf(x, 5)) > 0)
    assert abs(PB.f_cdf(1.0, 7, 7) - 0.5) < 1e-12


def test_significance_is_a_percentage(spark):
    df = spark.createDataFrame([(1.959963984540054, 1, False), (2.0, 3, True), (None, 1, True)], "sres double, rank int, used boolean")
    prior = [r.significance for r in RS.residual_significance(df).collect()]
    assert abs(prior[0] - 95.0) < 1e-9 and 0 < prior[1] < 100 and prior[2] is None
    after = [r.significance for r in RS.residual_significance(df, 50, 1.0, True).collect()]
    assert after[0] < 95.0


def test_angle_and_date_text(spark):
    df = spark.createDataFrame([("41 30 36 S", "41.3036", "4-Mar-1995 12:30"), ("361 0 0", "12.6100", "1995.5"), ("41 61 0 S", "-7.30", "2001/2/3")], "a string, b string, c string")
    out = df.select(parse_dms(F.col("a"), "NS"), parse_hp(F.col("b"), "+-"), parse_date(F.col("c"))).collect()
    assert abs(out[0][0] + 41.51) < 1e-12 and abs(out[0][1] - 41.51) < 1e-12 and abs(out[0][2] - (9193 + 12.5 / 24)) < 1e-9
    assert out[1][0] is None and out[1][1] is None and abs(out[1][2] - (9131 + 182.5)) < 1e-9
    assert out[2][0] is None and abs(out[2][1] + 7.5) < 1e-12 and out[2][2] == 11356
    text = spark.createDataFrame([(-41.999999999,)], "d double").select(format_dms(F.col("d"), 2, "NS")).first()[0]
    assert text == "42 00 00.00 S"


def test_natural_order_and_path_wildcards(spark):
    codes = ["A10", "a2", "A2B", "A-1", "AB1", "B", "A02", "10", "9X", "A"]
    got = [r.c for r in spark.createDataFrame([(c,) for c in codes], "c string").orderBy(natural_key(F.col("c"))).collect()]
    assert got == sorted(codes, key=natural_code)
    assert got.index("a2") < got.index("A10") and got.index("9X") < got.index("10")
    df = spark.createDataFrame([("/x/data/f1.dat",), ("/x/dat/f2.dat",)], "p string")
    assert [r.p for r in df.filter(path_matches_wildcard(F.col("p"), "data/F?.dat")).collect()] == ["/x/data/f1.dat"]


def test_grid_reproduces_polynomials(spark):
    nodes = spark.createDataFrame([(iy, ix, 1.0 + 2 * ix - iy + 0.5 * ix * iy, float(ix**3 - iy**2)) for iy in range(8) for ix in range(9)], "iy long, ix long, v double, w double")
    pts = spark.createDataFrame([(f"p{i}", 10 + 0.37 * i, 5 + 0.29 * i) for i in range(1, 20)], "code string, x double, y double")
    grid = Grid(10.0, 5.0, 1.0, 1.0, 9, 8, latlon=False)
    for r in interpolate(pts, nodes, grid, "x", "y", ["v", "w"], cubic=True).collect():
        if r.grid_status == "ok":
            a, b = r.x - 10, r.y - 5
            assert abs(r.v - (1 + 2 * a - b + 0.5 * a * b)) < 1e-9 and abs(r.w - (a**3 - b**2)) < 1e-9


def test_grid_wraps_and_ignores_nil_weights(spark):
    nodes = spark.createDataFrame([(iy, ix, float(ix)) for iy in range(3) for ix in range(36) if (iy, ix) != (1, 6)], "iy long, ix long, v double")
    grid = Grid(0.0, -10.0, 10.0, 10.0, 36, 3, latlon=True, wraps=True)
    pts = spark.createDataFrame([("wrap", 355.0, -5.0), ("back", -5.0, -5.0), ("node", 50.0, -5.0), ("hole", 55.0, -5.0)], "code string, x double, y double")
    got = {r.code: (r.v, r.grid_status) for r in interpolate(pts, nodes, grid, "x", "y", ["v"]).collect()}
    assert got["wrap"] == (17.5, "ok") and got["back"] == (17.5, "ok") and got["node"] == (5.0, "ok") and got["hole"] == (None, "missing")


def test_positions_recover_the_truth(spark):
    known = {"A": (0.0, 0.0), "B": (1000.0, 100.0), "C": (300.0, 900.0), "D": (-500.0, 700.0)}
    truth = (420.0, 310.0)
    turn = 1.234
    sights = [("P", "r", o, math.atan2(x - truth[0], y - truth[1]) - turn, x, y) for o, (x, y) in known.items()]
    d = spark.createDataFrame(sights, "code string, round_id string, other string, reading double, o_x double, o_y double")
    for n in (3, 4):
        got = X.fix_by_resection(d.filter(F.col("other").isin(list(known)[:n]))).first()
        assert math.hypot(got.x - truth[0], got.y - truth[1]) < 1e-6
    dist = [("P", o, math.hypot(x - truth[0], y - truth[1]), math.atan2(x - truth[0], y - truth[1]), x, y) for o, (x, y) in known.items()]
    f = spark.createDataFrame(dist, "code string, other string, distance double, azimuth double, o_x double, o_y double")
    for fix in (X.fix_by_distances(f), X.fix_by_bearings(f), X.fix_by_polar(f)):
        got = fix.first()
        assert math.hypot(got.x - truth[0], got.y - truth[1]) < 1e-6
    got = X.fix_by_distance_angle(f.filter("other = 'A'"), d.filter("other in ('A', 'B')")).first()
    assert math.hypot(got.x - truth[0], got.y - truth[1]) < 1e-6
    assert X.fix_by_distances(f.filter("other in ('A', 'B')")).count() == 0


def test_traverse_closes_on_its_ends(spark):
    pts = {"A": (0.0, 0.0), "p1": (100.0, 50.0), "p2": (220.0, 40.0), "p3": (300.0, 140.0), "B": (420.0, 150.0)}
    order = list(pts)
    obs = []
    for a, b in zip(order, order[1:]):
        dx, dy = pts[b][0] - pts[a][0], pts[b][1] - pts[a][1]
        obs.append((a, b, "distance", math.hypot(dx, dy) * 1.001, None, None, None))
        obs.append((b, a, "azimuth", math.atan2(-dx, -dy), None, None, None))
    lines = X.line_summary(spark.createDataFrame(obs, "from_code string, to_code string, kind string, value double, dx double, dy double, dh double"))
    fixed = spark.createDataFrame([(c, *(pts[c] if c in "AB" else (None, None))) for c in order], "code string, x double, y double")
    got = {r.code: r for r in X.traverses(lines, fixed).collect()}
    assert set(got) == {"p1", "p2", "p3"}
    total = math.hypot(420, 150) * 0.001
    for c, r in got.items():
        assert math.hypot(r.x - pts[c][0], r.y - pts[c][1]) < total and abs(r.misclose - total) < 1e-6


def test_network_lands_on_the_truth(spark, tables):
    run = NW.adjusted(tables)
    assert NW._off_truth(tables, run.stations).agg(F.max("off")).first()[0] < 0.02
    assert run.stats["dof"] == run.stats["nobs"] - run.stats["nprm"] - run.stats["nset"] > 0
    assert run.iterations[-1]["max_shift"] < 1e-3
