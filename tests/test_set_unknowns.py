import numpy as np
import pytest

from cairn.operators import normal

SCHEMA = "set_id string, misclosure double, weight double, design array<struct<param:string,coef:double>>, set_design array<struct<param:string,coef:double>>"
PARAMS = [f"S{k}|u" for k in range(6)]


def system():
    """Three sets with two unknowns each, one set that does not see its second unknown, rows without a set."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        s = i % 4
        own = [] if s == 3 else [("p", rng.normal()), ("q", rng.normal())] if s < 2 else [("p", 1.0), ("q", 0.0)]
        rows.append((None if s == 3 else f"s{s}", rng.normal(), rng.uniform(0.5, 2.0), [(p, rng.normal()) for p in rng.choice(PARAMS, 3, replace=False).tolist()], own))
    return rows


def dense(rows):
    names = PARAMS + [f"set|{s}|{u}" for s in ("s0", "s1", "s2") for u in "pq"]
    a = np.zeros((len(rows), len(names)))
    for r, (s, _, _, design, own) in enumerate(rows):
        for p, c in design:
            a[r, names.index(p)] += c
        for u, c in own:
            a[r, names.index(f"set|{s}|{u}")] += c
    w = np.array([r[2] for r in rows])
    n = a.T @ (a * w[:, None])
    return names, n, np.linalg.pinv(n), a.T @ (w * np.array([r[1] for r in rows]))


@pytest.mark.parametrize("limit", [400, 2])
def test_elimination_leaves_the_same_solution(spark, limit):
    rows = system()
    names, _, inverse, b = dense(rows)
    x = dict(zip(names, inverse @ b))
    reduced = normal.eliminate_set_blocks(spark.createDataFrame(rows, SCHEMA), limit=limit)
    matrix, rhs, _ = normal.split_cells(normal.normal_cells(reduced))
    at = sorted({r.row for r in matrix.collect()})
    assert set(at) == set(PARAMS if limit > 2 else names)
    n, v = np.zeros((len(at), len(at))), np.zeros(len(at))
    for r in matrix.collect():
        n[at.index(r.row), at.index(r.col)] = r.value
    for r in rhs.collect():
        v[at.index(r.param)] = r.b
    assert np.allclose(np.linalg.pinv(n) @ v, [x[p] for p in at], atol=1e-9)


def test_values_come_back_from_the_solution(spark):
    rows = system()
    names, n, inverse, b = dense(rows)
    x = dict(zip(names, inverse @ b))
    solution = spark.createDataFrame([(p, float(x[p])) for p in PARAMS], "param string, x double")
    found = {(r.set_id, r.name): r for r in normal.set_block_values(spark.createDataFrame(rows, SCHEMA), solution).collect()}
    assert len(found) == 6
    for (s, u), r in found.items():
        k = names.index(f"set|{s}|{u}")
        own = [i for i, name in enumerate(names) if name.startswith(f"set|{s}|")]
        assert abs(r.value - x[names[k]]) < 1e-9
        assert abs(r.variance - np.linalg.pinv(n[np.ix_(own, own)])[own.index(k), own.index(k)]) < 1e-9


def test_sets_reach_python_a_few_at_a_time():
    """A batch of sets is not taken into Python objects as a whole."""
    import pyarrow as pa

    seen = []
    batch = pa.RecordBatch.from_pydict({"set_id": list(range(10 * normal.SET_SLICE + 3))})
    parts = list(normal._by_slices(lambda b: seen.append(b.num_rows) or b)([batch]))
    assert max(seen) <= normal.SET_SLICE and sum(p.num_rows for p in parts) == batch.num_rows
