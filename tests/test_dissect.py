import numpy as np

from cairn.operators import dissect, solve

CHAIN = [(i, i + 1) for i in range(59)]
GRID = [(i * 9 + j, i * 9 + j + 1) for i in range(9) for j in range(8)] + [(i * 9 + j, i * 9 + 9 + j) for i in range(8) for j in range(9)]


def network(links, n, shared=False, held=True):
    rng = np.random.default_rng(n)
    m = 2 * n + shared
    a = np.zeros((m, m))
    for u, v in links:
        for k in range(2):
            r = np.zeros(m)
            r[2 * u + k], r[2 * v + k] = 1.0, -1.0
            if shared:
                r[-1] = rng.normal()
            a += rng.uniform(1, 4) * np.outer(r, r)
    if held:
        a[0, 0] += 1.0
        a[1, 1] += 1.0
    return a, [f"S{k // 2}|{'en'[k % 2]}" for k in range(2 * n)] + ["distsf|all"] * shared


def cells(spark, a, names):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(names[x], names[y], float(a[x, y])) for x, y in zip(i.tolist(), j.tolist())], "row string, col string, value double")


def test_three_components_equal_numpy(spark, monkeypatch):
    """A held chain, a held grid with an unknown that all its lines share, and a chain that nothing holds."""
    monkeypatch.setattr(dissect, "LAST_LINKS", 60)
    monkeypatch.setattr(dissect, "HUB_DEGREE", 40)
    parts = [network(CHAIN, 60), network(GRID, 81, shared=True), network(CHAIN[:29], 30, held=False)]
    a = np.zeros((sum(len(p) for p, _ in parts),) * 2)
    names, start = [], 0
    for k, (p, own) in enumerate(parts):
        a[start : start + len(p), start : start + len(p)] = p
        names += [f"{k}{name}" for name in own]
        start += len(p)
    loose = len(parts[2][0])
    b = np.arange(len(a)) % 7 - 3.0
    b[-loose:] = parts[2][0] @ (np.arange(loose) % 5)
    rhs = spark.createDataFrame(list(zip(names, b.tolist())), "param string, b double")
    wanted = spark.createDataFrame([(names[0], names[55]), (names[141], names[203]), (names[0], "none")], "row string, col string")
    found = dissect.dissect(cells(spark, a, names), rhs, wanted)
    sure = len(a) - loose
    inverse, x, at = np.linalg.inv(a[:sure, :sure]), np.linalg.solve(a[:sure, :sure], b[:sure]), {name: k for k, name in enumerate(names)}
    got = {frozenset((r.row, r.col)): r.value for r in found.cells.collect()}
    assert set(got) == {frozenset((names[i], names[j])) for i, j in zip(*np.nonzero(a))} | {frozenset((names[0], names[55])), frozenset((names[141], names[203]))}
    for pair, value in got.items():
        p, *q = [at[name] for name in pair]
        assert p >= sure or abs(value - inverse[p, q[0] if q else p]) < 1e-9 * np.abs(inverse).max()
    solution = {r.param: r for r in found.solution.collect()}
    solved = np.array([solution[name].x for name in names])
    assert np.abs(solved[:sure] - x).max() < 1e-8 * np.abs(x).max() and np.abs(a @ solved - b).max() < 1e-7
    assert [solution[name].singular for name in names] == [False] * sure + [True] * loose
    assert found.height >= 3 and found.largest < len(a) / 2


def test_large_fronts_are_left_to_iteration(spark, monkeypatch):
    a, names = network([(i, i + 1) for i in range(7)], 8)
    matrix = cells(spark, a, names)
    monkeypatch.setattr(dissect, "FRONT_LIMIT", 3)
    assert dissect.dissect(matrix) is None
    rhs = spark.createDataFrame([(name, 1.0) for name in names], "param string, b double")
    got = {r.param: r for r in solve.solve(matrix, rhs, limit=5).collect()}
    assert np.allclose([got[name].x for name in names], np.linalg.solve(a, np.ones(len(a))), rtol=1e-6)
    assert {r.singular for r in got.values()} == {None}


def hung(links, n=160):
    """Pairs of stations that hang together by one unknown only, with ``links`` between further stations."""
    names = ["distsf|I0", *[f"S{i:03d}|u" for i in range(n)]]
    a = np.zeros((n + 1, n + 1))
    for i in range(1, n + 1):
        a[i, i], a[0, i], a[i, 0] = 9.0 + i % 5, 0.1 * (i % 7) + 0.1, 0.1 * (i % 7) + 0.1
    for i, j in [(k, k + 1) for k in range(1, n, 2)] + links:
        a[i, j] = a[j, i] = -1.0 - 0.01 * i
    a[0, 0] = 1000.0
    return names, a


def test_clusters_below_a_hub_are_dealt_and_a_plan_is_used_again(spark, monkeypatch):
    """What hangs from one shared unknown goes down in parts; a plan serves the next matrix unless that has links it does not know."""
    monkeypatch.setattr(dissect, "LAST_LINKS", 0)
    monkeypatch.setattr(dissect, "HUB_DEGREE", 40)
    monkeypatch.setattr(dissect, "PACK_CLUSTERS", 1)
    assert dissect._salts(80, 1, 10, spark) > 1
    assert dissect._salts(80, 1, 100_000, spark) == 1
    plan = None
    for links in ([], [], [(10, 13)]):
        names, a = hung(links)
        rows = [(names[i], names[j], float(a[i, j])) for i, j in zip(*np.nonzero(a))]
        matrix = spark.createDataFrame(rows, "row string, col string, value double")
        rhs = spark.createDataFrame([(name, float(i % 11) - 4.0) for i, name in enumerate(names)], "param string, b double")
        found = dissect.dissect(matrix, rhs, plan=plan)
        x = np.linalg.solve(a, np.arange(len(names)) % 11 - 4.0)
        got = {r.param: r.x for r in found.solution.collect()}
        assert np.allclose([got[name] for name in names], x)
        inverse = np.linalg.inv(a)
        cells = found.cells.collect()
        assert len(cells) == (np.count_nonzero(a) + len(names)) // 2
        assert np.allclose([c.value for c in cells], [inverse[names.index(c.row), names.index(c.col)] for c in cells])
        assert (found.plan is plan) == (plan is not None and not links)
        plan = found.plan
