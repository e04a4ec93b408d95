"""Inputs beyond the sizes at which rows were once cut off."""

from cairn.operators import fix, graph, merge
from cairn.sources import models, stations


def numbered(spark, texts):
    return spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(texts)], "file string, line_no long, text string")


def test_long_banner_before_the_header(spark):
    body = ["title", "WGS84", "options no_geoid", "A1 40 10 00.0 S 175 20 00.0 E 12.0 First"]
    plain, _ = stations.station_text(numbered(spark, body))
    banner, _ = stations.station_text(numbered(spark, [f"! note {i}" for i in range(40)] + body))
    columns = ["code", "lat_deg", "lon_deg"]
    assert [tuple(r) for r in banner.select(columns).collect()] == [tuple(r) for r in plain.select(columns).collect()]
    assert banner.count() == 1


def test_round_of_many_targets_keeps_all_pairs(spark):
    n = 230
    rows = spark.createDataFrame([("I", f"T{i:03d}", "r") for i in range(n)], "from_code string, to_code string, set_id string")
    assert graph.connected_pairs(rows, "set_id").count() == n + n * (n - 1) // 2


def test_rows_without_a_set_stay(spark):
    rows = spark.createDataFrame([("s", 1, 5.0), ("s", 2, 6.0), (None, 3, 7.0), (None, 4, 8.0)], "set_id string, k int, v double")
    out = merge.first_of_set(rows, "set_id", ["k"], "v", "first")
    assert sorted((r.k, r["first"]) for r in out.collect()) == [(1, 5.0), (2, 5.0), (3, 7.0), (4, 8.0)]


def test_geoid_lines_are_checked_by_field(spark):
    good = "GEO   12.345 S40 10  0.000 E175 20 30.000"
    lines = numbered(spark, [good, good.replace("S40", "N40"), good.replace("10  0", "70  0"), good.replace("12.345", "  none"), "GEO", ""])
    rows = models.geoid_text(lines).collect()
    assert [(r.und, round(r.lat_deg, 6), round(r.lon_deg, 6)) for r in rows] == [(12.345, -40.166667, 175.341667)]


def test_orientation_goes_on_until_nothing_is_added(spark):
    rounds = spark.createDataFrame([(f"r{i}", f"P{i}", f"P{i + 1}", 0.25) for i in range(4)] + [(f"r{i}", f"P{i}", f"P{i - 1}", 0.5) for i in range(1, 4)], "round_id string, code string, other string, reading double")
    known = spark.createDataFrame([("P0", "P1", 1.0)], "code string, other string, azimuth double")
    assert fix.orient_rounds(rounds, known).count() == 4


def test_null_directions_are_found_at_any_size(spark):
    from cairn.operators import normal, solve

    chain = [(0.5, 1.0, [(f"{name}{i:02d}|u", 1.0), (f"{name}{i + 1:02d}|u", -1.0)]) for name in "ab" for i in range(20)]
    held = [(0.0, 1.0, [("a00|u", 1.0)])]
    schema = "misclosure double, weight double, design array<struct<param:string,coef:double>>"
    matrix, _, _ = normal.split_cells(normal.normal_cells(spark.createDataFrame(chain + held, schema)))
    for limit in (1000, 5):
        assert {r.param for r in solve.singular_parameters(matrix, limit).collect()} == {f"b{i:02d}|u" for i in range(21)}


def test_pairs_across_components_are_zero(spark):
    from cairn.operators import normal, solve

    rows = [(0.0, 4.0, [("a|u", 1.0)]), (0.0, 2.0, [("b|u", 1.0)])]
    schema = "misclosure double, weight double, design array<struct<param:string,coef:double>>"
    matrix, _, _ = normal.split_cells(normal.normal_cells(spark.createDataFrame(rows, schema)))
    wanted = spark.createDataFrame([("b|u", "a|u"), ("b|u", "none")], "row string, col string")
    for limit in (10, 0):
        cells = {(r.row, r.col): r.value for r in solve.inverse_cells(matrix, wanted, limit).collect()}
        assert cells == {("a|u", "a|u"): 0.25, ("b|u", "b|u"): 0.5, ("b|u", "a|u"): 0.0}


def test_rows_with_an_unknown_of_their_own_change_nothing(spark):
    from cairn.operators import normal

    schema = "set_id string, set_coef double, misclosure double, weight double, design array<struct<param:string,coef:double>>"
    kept = [("s", 1.0, 0.5, 1.0, [("a", 1.0)]), ("s", 1.0, 0.1, 1.0, [("b", 1.0)])]
    alone = [(None, 1.0, 3.0, 1.0, [("a", 1.0)]), (None, 1.0, 4.0, 1.0, [("b", -1.0)])]
    cells = lambda rows: {(r.row, r.col): round(r.value, 12) for r in normal.normal_cells(normal.eliminate_set_unknowns(spark.createDataFrame(rows, schema))).collect()}
    assert cells(kept + alone) == cells(kept)


def test_projection_bearings_enter_the_adjustment(spark):
    import math

    import pytest
    from pyspark.sql import functions as F

    from cairn.catalog.models import TM
    from cairn.operators import adjust, crs

    place = {"A": (175.0, -40.0), "B": (175.02, -40.01), "C": (175.01, -40.02), "D": (174.99, -40.01)}
    ends = [(f, t) for f in "ABC" for t in "D"]
    lines = spark.createDataFrame([(f + t, *map(math.radians, place[f] + place[t])) for f, t in ends], "obs_key string, f_lon double, f_lat double, t_lon double, t_lat double")
    bearings = crs.projection_bearing(lines, TM).select(
        "obs_key", F.lit("PB").alias("obs_type"), F.col("obs_key").substr(1, 1).alias("from_code"), F.col("obs_key").substr(2, 1).alias("to_code"),
        F.lit(None).cast("string").alias("set_id"), F.col("calc").alias("value"), F.lit(5e-6).alias("error"),
    )
    start = spark.createDataFrame(
        [(c, math.radians(x + (1e-4 if c == "D" else 0)), math.radians(y), 10.0, 0.0, "free" if c == "D" else "fixed", "fixed") for c, (x, y) in place.items()],
        "code string, lon double, lat double, ohgt double, und double, mode_h string, mode_v string",
    )
    run = adjust.adjust(bearings, start, adjust.Options(dimension="en", projection=TM))
    at = run.stations.filter("code = 'D'").first()
    assert run.converged and run.stats["dof"] == 1
    assert abs(math.degrees(at.lon) - place["D"][0]) < 1e-9 and abs(math.degrees(at.lat) - place["D"][1]) < 1e-9
    with pytest.raises(ValueError, match="lack a misclosure"):
        adjust.adjust(bearings, start, adjust.Options(dimension="en"))


def test_points_in_polygons_at_any_tile_width(spark):
    import random

    from cairn.operators import criteria

    rnd = random.Random(5)
    rings = [(1, [(170.0, -50.0), (190.0, -48.0), (184.0, -30.0), (176.0, -41.0)]), (2, [(-4.0, 10.0), (3.0, 11.0), (5.0, 20.0), (0.0, 13.0), (-5.0, 19.0)]), (3, [(178.0, -46.0), (180.0, -44.0), (181.0, -40.0)])]
    edges = [(n, *p, *q) for n, ring in rings for p, q in zip(ring, ring[1:] + ring[:1])]
    points = [(f"p{i}", rnd.choice([rnd.uniform(-180, 180), rnd.uniform(170, 190), rnd.uniform(-6, 6), 0.0, 180.0, -180.0, 355.0]), rnd.choice([rnd.uniform(-52, -28), rnd.uniform(9, 21)])) for i in range(400)]

    def inside(x, y):
        for n, ring in rings:
            west, east = min(p[0] for p in ring), max(p[0] for p in ring)
            px = x - 360 * ((x - west) // 360)
            crossed = sum(((y1 <= y) != (y2 <= y)) and px < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for k, x1, y1, x2, y2 in edges if k == n)
            if px <= east and crossed % 2:
                return True
        return False

    expected = {c for c, x, y in points if inside(x, y)}
    assert 20 < len(expected) < 380
    stations = spark.createDataFrame(points, "code string, lon_deg double, lat_deg double")
    table = spark.createDataFrame(edges, "poly_id int, x1 double, y1 double, x2 double, y2 double")
    for tile in (0.7, 5.0, 360.0):
        assert {r.code for r in criteria.inside_polygons(stations, table, tile=tile).collect()} == expected
    assert {r.code for r in criteria.inside_polygons(stations, table, outside=True).collect()} == {c for c, _, _ in points} - expected


def test_polygons_are_settled_by_cells(spark, monkeypatch):
    import math
    import random

    from cairn.operators import criteria

    rnd = random.Random(11)
    rings = []
    for n in range(60):
        cx, cy, r = rnd.uniform(174, 186), rnd.uniform(-44, -36), rnd.uniform(0.2, 3.0)
        turn = sorted(rnd.uniform(0, 6.283) for _ in range(rnd.randint(3, 9)))
        rings.append((n % 40, [(cx + r * math.cos(a), cy + r * math.sin(a)) for a in turn]))
    rings += [(50, [(176.0, -40.0), (178.0, -40.0), (178.0, -38.0), (176.0, -38.0)]), (51, [(176.0, -40.0), (178.0, -40.0), (178.0, -38.0), (176.0, -38.0)])]
    edges = [(n, *p, *q) for n, ring in rings for p, q in zip(ring, ring[1:] + ring[:1])]
    edges += [(60, 183.0, -45.0, 187.0, -35.0), (60, 187.0, -35.0, 180.0, -38.0), (61, None, -45.0, 187.0, -35.0), (61, 187.0, -35.0, 180.0, -38.0)]  # open
    edges += [(62, -190.0, -46.0, 190.0, -46.0), (62, 190.0, -46.0, 0.0, -44.0), (62, 0.0, -44.0, -190.0, -46.0)]  # round the globe
    points = [(f"p{i}", rnd.choice([rnd.uniform(173, 180), rnd.uniform(-180, -173), 176.0, 178.0, rnd.uniform(533, 545)]), rnd.choice([rnd.uniform(-47, -35), -40.0, -38.0])) for i in range(1500)]
    points += [(f"p{i}", x + 1e-3, y) for i, (_, x, y) in enumerate(points[:40])]  # codes that come twice
    points += [("null", None, -40.0), ("nan", math.nan, -40.0), ("inf", 177.0, math.inf), (None, 177.0, -39.0)]

    odd = {}
    for c, x, y in points:
        if c is None or x is None or not (math.isfinite(x) and math.isfinite(y)):
            continue
        for n in {e[0] for e in edges}:
            own = [e[1:] for e in edges if e[0] == n]
            west, east = min(e[0] for e in own if e[0] is not None), max(e[0] for e in own if e[0] is not None)
            px = x - 360 * math.floor((x - west) / 360)
            crossed = sum(x1 is not None and ((y1 <= y) != (y2 <= y)) and px < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in own)
            odd[c, n] = odd.get((c, n), 0) + (crossed if west <= px <= east else 0)
    expected = {c for (c, _), k in odd.items() if k % 2}
    stations = spark.createDataFrame(points, "code string, lon_deg double, lat_deg double")
    table = spark.createDataFrame(edges, "poly_id int, x1 double, y1 double, x2 double, y2 double")
    counted, met = criteria._counted, []

    def plain(p, e, *rest):
        met.append((p.count(), e.select("poly_id").distinct().count()))
        return counted(p, e, *rest)

    monkeypatch.setattr(criteria, "_counted", plain)
    assert {r.code for r in criteria.inside_polygons(stations, table).collect()} == expected
    assert len(expected) > 300
    # Only repeated codes and places out of range meet all edges, and the others only those of the polygons without a grid.
    assert met == [(83, 45), (1460, 3)]
