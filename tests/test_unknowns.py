"""Named unknowns, ties, values, motion, paired marks and correlated sets inside the adjustment: planted and found again."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.ellipsoid import GRS80, LOWER, geocentric
from cairn.operators import adjust, observe
from cairn.operators.unknowns import Model, resolved_names

PLACE = {
    "A": (175.00, -40.00, 100.0), "B": (175.05, -40.01, 400.0), "C": (175.02, -40.05, 250.0),
    "D": (175.03, -40.02, 320.0), "E": (175.01, -40.03, 180.0), "G": (175.04, -40.04, 90.0),
}
FREE = "DEG"
STATION = "code string, lon double, lat double, ohgt double, und double, mode_h string, mode_v string"


def marks(spark, off=0.0, extra=()):
    rows = [(c, math.radians(x) + (off if c in FREE else 0), math.radians(y) - (off if c in FREE else 0), h + (1e6 * off if c in FREE else 0), 5.0, *(["free" if c in FREE else "fix"] * 2)) for c, (x, y, h) in PLACE.items()]
    return spark.createDataFrame([*rows, *extra], STATION)


def lines(spark, kinds, **columns):
    """Error-free observations of each kind over all pairs with a free mark, and the columns given as expressions."""
    pairs = [(f + t + k, k, f, t, f"{k}{f}") for k in kinds for f in PLACE for t in PLACE if f < t and (f in FREE or t in FREE)]
    rows = spark.createDataFrame(pairs, "obs_key string, obs_type string, from_code string, to_code string, set_id string").withColumns(columns)
    calc = observe.calculate(observe.resolve_ends(rows, marks(spark).withColumn("free", F.lit("enu")), adjust.STATION_COLUMNS))
    # Kept for planting: the effect of one unit of each unknown.
    return calc.select(
        *rows.columns, F.col("calc").alias("value"), F.when(F.col("obs_type").isin("AZ", "ZD", "HA"), 1e-6).otherwise(1e-3).alias("error"),
        (F.col("_chord") * 1e-6).alias("ppm"), observe.refraction_angle(F.col("_cosv")).alias("bend"), "dx", "dy", "dz",
    )


def off_truth(run):
    at = {r.code: r for r in run.stations.collect()}
    return max(max(abs(math.degrees(at[c].lon) - x), abs(math.degrees(at[c].lat) - y)) * 1e5 + abs(at[c].ohgt - h) for c, (x, y, h) in PLACE.items())


def planted(spark):
    """One instrument off by 5 ppm and 2 cm a line, two days of refraction, bearings turned by 3 seconds, ratios in sets of their own scale."""
    kind = F.col("obs_type")
    obs = lines(
        spark, ["SD", "ZD", "AZ", "DR", "LV"], distsf=F.when(kind == "SD", "edm"), refcoef=F.when(kind == "ZD", F.when(F.col("from_code") < "C", "day1").otherwise("day2")),
        brngref=F.when(kind == "AZ", "grid"), systematic=F.when(kind == "LV", F.array(F.struct(F.lit("staff").alias("prm"), F.lit(1.0).alias("influence")))),
    )
    effect = F.when(kind == "SD", F.col("ppm") * 5.0).when(kind == "ZD", F.col("bend") * F.when(F.col("refcoef") == "day1", 0.1).otherwise(0.2))
    effect = effect.when(kind == "AZ", math.radians(3.0 / 3600)).when(kind == "LV", 0.02).when(kind == "DR", F.col("ppm") * 40.0)
    return obs.withColumn("value", F.col("value") + effect)


TRUE = {"distsf|edm": 5.0, "refcoef|day1": 0.1, "refcoef|day2": 0.2, "brngref|grid": 3.0, "syserr|staff": 0.02}


@pytest.mark.parametrize("dense_limit", [4000, 4])
def test_named_unknowns_come_back(spark, dense_limit):
    run = adjust.adjust(planted(spark), marks(spark, 2e-8), adjust.Options(dense_limit=dense_limit))
    assert run.converged and off_truth(run) < 1e-5
    found = {r.param: r.value for r in run.parameters.collect()}
    assert found == {p: pytest.approx(v, abs=1e-5) for p, v in TRUE.items()}
    # 12 pairs of five kinds, one scale for each of the five marks that begin ratios, nine coordinates and five unknowns.
    assert run.stats["nset"] == 5 and run.stats["dof"] == 60 - 5 - 9 - 5


def test_known_values_and_ties(spark):
    given = spark.createDataFrame(
        [("distsf|edm", 5.0, False), ("refcoef|*", 9.0, False), ("refcoef|day?", 0.05, True), ("refcoef|day2", 0.2, False), ("brngref|*", 1.0, True)],
        "name string, value double, solve boolean",
    )
    run = adjust.adjust(planted(spark), marks(spark, 2e-8), model=Model(parameters=given))
    found = {r.param: (r.solve, r.value) for r in run.parameters.collect()}
    assert off_truth(run) < 1e-5
    held = ("distsf|edm", "refcoef|day2")
    assert found == {p: (p not in held, pytest.approx(v, abs=1e-5)) for p, v in TRUE.items()}
    assert run.solution.filter("param = 'distsf|edm' OR param = 'refcoef|day2'").count() == 0


def test_tied_unknowns_are_one(spark):
    same = planted(spark).withColumn("value", F.when(F.col("refcoef") == "day2", F.col("value") - F.col("bend") * 0.1).otherwise(F.col("value")))
    ties = spark.createDataFrame([("refcoef|*", "refcoef|all")], "param string, same_as string")
    run = adjust.adjust(same, marks(spark, 2e-8), model=Model(ties=ties))
    found = {r.param: (r.name, r.value) for r in run.parameters.collect()}
    assert off_truth(run) < 1e-5 and run.stats["dof"] == 60 - 5 - 9 - 4
    assert {p: n for p, (n, _) in found.items() if p.startswith("ref")} == {"refcoef|day1": "refcoef|all", "refcoef|day2": "refcoef|all"}
    assert found["refcoef|day2"][1] == pytest.approx(0.1, abs=1e-5)


def test_names_of_a_class(spark):
    eq = spark.createDataFrame([(["distsf|a", "distsf|b", "S|e"],), (["distsf|c", "syserr|a"],), ([],)], "names array<string>")
    eq = eq.select(F.transform("names", lambda n: F.struct(n.alias("param"), F.lit(1.0).alias("coef"))).alias("design"))
    ties = spark.createDataFrame([("distsf|a", "distsf|z"), ("distsf|b", "distsf|z"), (None, "distsf|c")], "param string, same_as string")
    value = lambda *rows: spark.createDataFrame(rows, "name string, value double, solve boolean")
    assert resolved_names(eq, Model()) is None
    found = {tuple(r) for r in resolved_names(eq, Model(value(("distsf|b", 2.0, None), ("x|*", 1.0, True), (None, 1.0, True)), ties)).collect()}
    assert found == {("distsf|a", "distsf|a", 2.0, True), ("distsf|b", "distsf|a", 2.0, True), ("distsf|c", "distsf|c", 0.0, True), ("syserr|a", "syserr|a", 0.0, True)}
    with pytest.raises(ValueError, match=r"tied to distsf\|a are given different values"):
        resolved_names(eq, Model(value(("distsf|a", 1.0, True), ("distsf|b", 2.0, True)), ties))
    assert resolved_names(eq.limit(0), Model(value(("distsf|b", 2.0, True)), ties)).count() == 0


def test_marks_that_move(spark):
    """Every mark moves by a velocity of its own, the fixed ones too; observations of four years give the marks of year zero."""
    rate = {c: (0.03 * k, -0.02 * k, 0.01 * k) for k, c in enumerate(PLACE, 1)}
    moves = [(c, 2000.0 + y, *(v * y for v in r)) for c, r in rate.items() for y in range(4)]
    moves = spark.createDataFrame([*moves, ("A", None, 9.0, 9.0, 9.0)], "code string, year double, de double, dn double, du double")
    from cairn.operators.unknowns import displaced

    year = 2000.0 + F.pmod(F.ascii("from_code") + F.ascii("to_code"), F.lit(4))
    obs = lines(spark, ["SD", "ZD", "AZ", "LV"], year=year)
    there = displaced(observe.resolve_ends(obs, marks(spark), ["lon", "lat", "ohgt", "und"]), moves)
    obs = observe.calculate(there).select(*[F.col("calc").alias("value") if c == "value" else F.col(c) for c in obs.columns])
    off = adjust.adjust(obs, marks(spark, 2e-8))
    assert off_truth(off) > 1e-2
    halves = moves.withColumns({c: F.col(c) / 2 for c in ("de", "dn", "du")})
    run = adjust.adjust(obs, marks(spark, 2e-8), model=Model(displacements=halves.unionAll(halves)))
    assert off_truth(run) < 1e-5
    assert run.stats["nobs"] == off.stats["nobs"]


def test_paired_marks_stay_together(spark):
    """A mark without observations follows the one that it is paired with; a pair of fixed marks says nothing."""
    x, y, h = PLACE["D"]
    alone = ("H", math.radians(x) + 3e-8, math.radians(y), h + 0.5, 5.0, "free", "free")
    pairs = spark.createDataFrame([("D", "H", 1e-3, 1e-3), ("A", "B", 1e-3, 1e-3), ("D", "nowhere", 1e-3, 1e-3)], "a string, b string, h_error double, v_error double")
    run = adjust.adjust(lines(spark, ["SD", "ZD", "AZ"]), marks(spark, 2e-8, [alone]), model=Model(colocated=pairs))
    at = {r.code: r for r in run.stations.collect()}
    assert run.converged and run.stats["dof"] == 36 + 3 - 12
    assert abs(math.degrees(at["H"].lon) - x) < 1e-10 and abs(math.degrees(at["H"].lat) - y) < 1e-10 and abs(at["H"].ohgt - h) < 1e-5


def test_sets_with_covariances_between_members(spark):
    """Three vectors to one mark as a set: the generalised mean by numpy, without the rejected fourth."""
    rng = np.random.default_rng(8)
    root = rng.normal(size=(12, 12))
    full = (root @ root.T + 12 * np.eye(12)) * 1e-6
    ends = ["A", "B", "C", "E"]
    at = marks(spark).select("code", F.array(*geocentric(F.col("lon"), F.col("lat"), F.col("ohgt") + F.col("und"), GRS80)).alias("p")).collect()
    p = {r.code: np.array(r.p) for r in at}
    noise = rng.normal(size=12) * 2e-3
    rows = [(f"{c}D", "s", 10 + k, "GB", c, "D", 0.0, 1.0, (p["D"] - p[c] + noise[3 * k : 3 * k + 3]).tolist(), [1.0, 0.0, 1.0, 0.0, 0.0, 1.0], c == "E") for k, c in enumerate(ends)]
    obs = spark.createDataFrame(rows, "obs_key string, set_id string, i int, obs_type string, from_code string, to_code string, value double, error double, vec array<double>, cov array<double>, rejected boolean")
    # The blocks off the diagonal are symmetric in the tables.
    blocks = []
    for a in range(4):
        for b in range(a, 4):
            block = full[3 * a : 3 * a + 3, 3 * b : 3 * b + 3]
            block = (block + block.T) / 2
            full[3 * a : 3 * a + 3, 3 * b : 3 * b + 3] = full[3 * b : 3 * b + 3, 3 * a : 3 * a + 3] = block
            blocks.append(("s", 10 + a, 10 + b, [float(block[q, r]) for q, r in LOWER]))
    blocks = spark.createDataFrame(blocks, "set_id string, i int, j int, cov array<double>")
    stations = marks(spark, 2e-8).withColumns({m: F.when(F.col("code") == "D", "free").otherwise("fix") for m in ("mode_h", "mode_v")})
    run = adjust.adjust(obs, stations, adjust.Options(tolerance=1e-7), Model(blocks=blocks))
    weight = np.linalg.inv(full[:9, :9])
    ones = np.tile(np.eye(3), (3, 1))
    mean = np.linalg.solve(ones.T @ weight @ ones, ones.T @ weight @ noise[:9])
    left = noise[:9] - ones @ mean
    moved = run.stations.filter("code = 'D'").select(F.array(*geocentric(F.col("lon"), F.col("lat"), F.col("ohgt") + F.col("und"), GRS80)).alias("p")).first().p
    assert np.allclose(np.array(moved) - p["D"], mean, atol=1e-7)
    assert run.stats["dof"] == 6 and run.stats["ssr"] == pytest.approx(left @ weight @ left, rel=1e-5)
    assert {(r.obs_key, r.used) for r in run.equations.collect()} == {("AD", True), ("BD", True), ("CD", True), ("ED", False)}
