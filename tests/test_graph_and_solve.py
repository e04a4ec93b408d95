import random

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import graph as G
from cairn.operators import normal as N
from cairn.operators import solve as V


def union_find(edges, nodes):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def test_components_of_chain_star_and_random(spark):
    rnd = random.Random(3)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]
    edges += [("hub", f"s{i}") for i in range(300)]
    edges += [(f"r{rnd.randint(0, 80)}", f"r{rnd.randint(0, 80)}") for _ in range(70)]
    nodes = {n for e in edges for n in e} | {"alone"}
    got = G.connected_components(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([("alone",)], "n string"))
    assert {r.node: r.component for r in got.collect()} == union_find(edges, nodes)


def system(n=40, seed=1):
    rnd = np.random.default_rng(seed)
    eqs = []
    for k in range(4 * n):
        i, j = rnd.integers(0, n, 2)
        design = [(f"p{i:03d}", 1.0)] + ([(f"p{j:03d}", -1.0)] if i != j and rnd.random() < 0.9 else [])
        eqs.append((f"s{k % 7}", float(rnd.normal()), float(1 + rnd.random()), design))
    return eqs


SCHEMA = "set_id string, misclosure double, weight double, design array<struct<param:string,coef:double>>"


def dense(eqs, coef=None):
    names = sorted({p for *_, d in eqs for p, _ in d})
    at = {p: i for i, p in enumerate(names)}
    a = np.zeros((len(eqs), len(names)))
    v = np.array([m for _, m, _, _ in eqs])
    w = np.array([x for _, _, x, _ in eqs])
    for r, (*_, d) in enumerate(eqs):
        for p, c in d:
            a[r, at[p]] += c
    return names, a, v, w


def test_small_and_large_solvers_agree_with_numpy(spark):
    eqs = system()
    names, a, v, w = dense(eqs)
    n = a.T @ (a * w[:, None])
    x = np.linalg.solve(n, a.T @ (w * v))
    df = spark.createDataFrame(eqs, SCHEMA)
    matrix, rhs, vwv = N.split_cells(N.normal_cells(df))
    assert abs(vwv.first()["vwv"] - v @ (w * v)) < 1e-9
    for limit in (1000, 5):
        got = {r.param: r.x for r in V.solve(matrix, rhs, limit).collect()}
        assert np.allclose([got[p] for p in names], x, atol=1e-8)
    again = {r.param: r.x for r in V.solve(matrix.repartition(11), rhs.repartition(3), 1000).collect()}
    assert np.allclose([again[p] for p in names], x, atol=1e-9)
    inv = np.linalg.inv(n)
    wanted = spark.createDataFrame([(names[-1], names[0])], "row string, col string")
    for limit in (1000, 5):
        cells = {(r.row, r.col): r.value for r in V.inverse_cells(matrix, wanted, limit, batch=16).collect()}
        assert (names[-1], names[0]) in cells
        for (p, q), value in cells.items():
            assert abs(value - inv[names.index(p), names.index(q)]) < 1e-7


def test_null_directions_are_reported_and_harmless(spark):
    eqs = [("s", 0.5, 1.0, [("a|u", 1.0), ("b|u", -1.0)]), ("s", 0.5, 1.0, [("c|u", 1.0)])]
    matrix, rhs, _ = N.split_cells(N.normal_cells(spark.createDataFrame(eqs, SCHEMA)))
    got = {r.param: r for r in V.solve(matrix, rhs).collect()}
    assert abs(got["a|u"].x - got["b|u"].x - 0.5) < 1e-9 and abs(got["c|u"].x - 0.5) < 1e-12
    assert {r.param for r in V.singular_report(V.solve(matrix, rhs)).collect()} == {"a|u", "b|u"}


def test_set_unknowns_give_one_solution_eliminated_or_kept(spark):
    eqs = system(12, 4)
    names, a, v, w = dense(eqs)
    sets = sorted({s for s, *_ in eqs})
    z = np.zeros((len(eqs), len(sets)))
    for r, (s, *_) in enumerate(eqs):
        z[r, sets.index(s)] = 1.0
    # A datum keeps the system regular once every set may float.
    datum = [("d", 0.0, 100.0, [(p, 1.0)]) for p in names[:2]]
    full = np.hstack([a, z])
    n = full.T @ (full * w[:, None])
    for p in names[:2]:
        n[names.index(p), names.index(p)] += 100.0
    x = np.linalg.lstsq(n, full.T @ (w * v), rcond=None)[0][: len(names)]
    grouped = spark.createDataFrame(eqs, SCHEMA).withColumn("set_coef", F.lit(1.0))
    fixed = spark.createDataFrame(datum, SCHEMA)
    for limit in (1000, 1):
        reduced = N.eliminate_set_unknowns(grouped, limit=limit).unionByName(fixed)
        matrix, rhs, _ = N.split_cells(N.normal_cells(reduced))
        got = {r.param: r.x for r in V.solve(matrix, rhs).collect()}
        assert np.allclose([got[p] for p in names], x, atol=1e-6)


def test_network_of_linked_axes_is_dissected(spark):
    """Stations with few neighbours are sparse although their axes fill many cells; steps of a vector would not tell what is singular."""
    axes, n = "enu", 60
    rows = []
    for i in range(n):
        rows += [(f"S{i}|{a}", f"S{i}|{b}", 40.0 if a == b else 0.1) for a in axes for b in axes]
        for j in range(max(0, i - 5), min(n, i + 6)):
            if i != j:
                rows += [(f"S{i}|{a}", f"S{j}|{b}", -1.0 if a == b else 0.01) for a in axes for b in axes]
    matrix = spark.createDataFrame(rows, "row string, col string, value double")
    rhs = spark.createDataFrame([(f"S{i}|{a}", float(i % 7) - 3.0) for i in range(n) for a in axes], "param string, b double")
    assert len(rows) > V.SPARSE_CELLS * 3 * n
    found = {r["param"]: r for r in V.solve(matrix, rhs, limit=10).collect()}
    names = sorted(found)
    at = {name: k for k, name in enumerate(names)}
    a, b = np.zeros((len(names), len(names))), np.zeros(len(names))
    for row, col, value in rows:
        a[at[row], at[col]] = value
    for r in rhs.collect():
        b[at[r["param"]]] = r["b"]
    assert np.allclose([found[k]["x"] for k in names], np.linalg.solve(a, b))
    assert {r["singular"] for r in found.values()} == {False}


def test_equations_of_one_split_are_dealt(spark, tables):
    """A network read as one split does not leave all equations to one task."""
    from cairn.catalog import network
    from cairn.operators import adjust as A

    obs = network.observations(tables).coalesce(1)
    run = A.adjust(obs, network.start(tables).coalesce(1), A.Options(mode="datacheck", max_iterations=1))
    parts = run.equations.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 4


def test_cells_are_summed_before_they_leave_python(spark, monkeypatch):
    """Products are summed by cell in a task, also where they come in several lots; missing values add nothing."""
    rows = [("s", 0.5, 2.0, [("a|u", 1.0), ("b|u", -1.0)])] * 50 + [("s", None, 1.0, [("a|u", 3.0)]), ("s", 1.0, None, [("c|u", 1.0)]), ("s", 1.0, 1.0, [])]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    want = {("=", "="): 26.0, ("=", "a|u"): 50.0, ("=", "b|u"): -50.0, ("a|u", "a|u"): 109.0, ("a|u", "b|u"): -100.0, ("b|u", "b|u"): 100.0, ("=", "c|u"): None, ("c|u", "c|u"): None}
    for lot in (2_000_000, 7):
        monkeypatch.setattr(N, "BATCH_PRODUCTS", lot)
        assert {(r.row, r.col): r.value for r in N.normal_cells(df).collect()} == want
    sent = df.select("misclosure", "weight", "design").mapInArrow(N._products, "row string, col string, value double")
    monkeypatch.setattr(N, "BATCH_PRODUCTS", 2_000_000)
    assert df.select("misclosure", "weight", "design").mapInArrow(N._products, sent.schema).count() == len(want)
