"""Distance joins and order tests keep what they shuffle in proportion to the marks, not to the pairs."""

import math
import random
from contextlib import contextmanager

from cairn.operators import pairs as P
from cairn.operators import spec as S
from cairn.plans.skew import salted_join

XYZ = "code string, x double, y double, z double"


def marks(n=90, seed=5):
    rnd = random.Random(seed)
    return [(f"m{i:03d}", rnd.random() * 30, rnd.random() * 30, rnd.random() * 3) for i in range(n)]


def dist(a, b):
    return math.dist(a[1:4], b[1:4])


@contextmanager
def no_small_tables(spark):
    """Plans as for large tables: nothing is broadcast by its estimated size."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_list_pairs_meet_in_the_cells_of_their_list(spark):
    pts = marks()
    lists = [(f"L{i % 4}" if i % 9 else None, p[0]) for i, p in enumerate(pts)] + [("L0", p[0]) for p in pts[::3]] + [("L0", "nowhere"), ("L1", None)]
    member = {(l, c) for l, c in lists if l and c}
    want = {(l, a[0], b[0]) for l in {m[0] for m in member} for a in pts for b in pts if a[0] < b[0] and dist(a, b) < 6.0 and (l, a[0]) in member and (l, b[0]) in member}
    with no_small_tables(spark):
        out = P.list_pairs_within(spark.createDataFrame(lists, "list_id string, mark string"), spark.createDataFrame(pts, XYZ), "list_id", "mark", 6.0)
        text = plan(out)
        got = [(r.list_id, r.a, r.b) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    # One shuffled join, that of the cells: the pairs it finds are not joined with anything.
    assert text.count("SortMergeJoin") + text.count("ShuffledHashJoin") == 1


ORDER = S.OrderTest("A", 12.0, False, 1, True, 0.0, 0.0, 0.0, 0.0, 0.05, 0.01)


def order_marks(spark):
    rnd = random.Random(7)
    rows = [(*m, rnd.choice(["unknown", "pass", "passed", "fail", "fail"]), "tested", rnd.random() * 5e-3, 1e-4) for m in marks(60)]
    return rows, spark.createDataFrame(rows, XYZ + ", status string, role string, error2 double, verror2 double")


def relative(rows):
    return [(a[0], b[0], (a[6] + b[6]) * 0.6, 1e-4) for a in rows for b in rows if a[0] < b[0]]


def test_covariances_are_cut_down_to_the_tested_pairs_before_they_are_joined(spark):
    rows, df = order_marks(spark)
    live = ("unknown", "pass", "passed")
    tested = {
        (a[0], b[0]) for a in rows for b in rows
        if a[0] < b[0] and dist(a, b) < 12.0 and a[4] in live and b[4] in live and "unknown" in (a[4], b[4])
    }
    table = spark.createDataFrame(relative(rows), "a string, b string, error2 double, verror2 double")
    handed = []

    def on_request(asked):
        handed.extend((r.a, r.b) for r in asked.collect())
        return table.join(asked, ["a", "b"], "left_semi")

    with no_small_tables(spark):
        whole = S.pair_status(df, ORDER, table)
        text = plan(whole)
        by_table = sorted(map(tuple, whole.select("a", "b", "status", "why").collect()))
        by_request = sorted(map(tuple, S.pair_status(df, ORDER, on_request).select("a", "b", "status", "why").collect()))
    assert {r[:2] for r in by_table} == tested and len(by_table) == len(tested)
    assert {r[2] for r in by_table} == {"pass", "fail"} and "covariance" in {r[3] for r in by_table}
    assert by_request == by_table and sorted(handed) == sorted(tested)
    # The table meets the tested pairs where it lies: a broadcast semi join below the exchange.
    assert any("BroadcastHashJoin" in line and "LeftSemi" in line for line in text.splitlines())


def test_nearest_forms_few_candidates_for_a_query(spark, monkeypatch):
    rnd = random.Random(3)
    pts = [(f"p{i:04d}", rnd.random() * 100, rnd.random() * 100, 0.0) for i in range(1500)]
    met = []

    def counted(*args, **kwargs):
        out = salted_join(*args, **kwargs)
        met.append(out.count())
        return out

    monkeypatch.setattr(P, "salted_join", counted)
    df = spark.createDataFrame(pts, XYZ)
    got = {r.query: r.target for r in P.nearest(df, df, "code", "code", 1, exclude_same=True).collect()}
    for p in pts[::50]:
        assert got[p[0]] == min((dist(p, q), q[0]) for q in pts if q[0] != p[0])[1]
    assert len(got) == len(pts) and sum(met) < 60 * len(pts)


def test_nearest_segment_forms_few_candidates_for_a_point(spark, monkeypatch):
    rnd = random.Random(11)
    segs = [(i, x, y, x + rnd.random() - 0.5, y + rnd.random() - 0.5) for i, (x, y) in enumerate((rnd.random() * 20, rnd.random() * 20) for _ in range(300))]
    segs += [(1000 + i, *s) for i, *s in segs] + [(2000 + i, *s) for i, *s in segs[:100]]
    pts = [(f"q{i}" if i else None, rnd.random() * 20, rnd.random() * 20) for i in range(400)]
    met = []

    def counted(*args, **kwargs):
        out = salted_join(*args, **kwargs)
        met.append(out.count())
        return out

    monkeypatch.setattr(P, "salted_join", counted)
    rows = P.nearest_segment(
        spark.createDataFrame(pts, "q string, x double, y double"), spark.createDataFrame(segs, "s long, x1 double, y1 double, x2 double, y2 double"), "q", "s", 6.0
    ).collect()

    def away(p, s):
        _, x1, y1, x2, y2 = s
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((p[1] - x1) * dx + (p[2] - y1) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[1] - x1 - t * dx, p[2] - y1 - t * dy)

    got = {r.query: (r.segment, r.dist) for r in rows}
    assert len(rows) == len(got) == len(pts)
    for p in pts:
        best = min((away(p, s), s[0]) for s in segs)
        assert got[p[0]][0] == best[1] and abs(got[p[0]][1] - best[0]) < 1e-9
    # Far fewer than the hundreds of segments within the tolerance of a point.
    assert sum(met) < 60 * len(pts)


def test_relative_test_forms_only_pairs_of_one_specification(spark):
    rows, df = order_marks(spark)
    under = [(r[0], "fine") for r in rows[::3]] + [(r[0], "coarse") for r in rows[::4]] + [(rows[0][0], "fine")]
    assigned = spark.createDataFrame(under, "code string, name string")
    specs = S.spec_table(spark, (S.AccuracySpec("fine", 0.0, 0.0, 0.05, 1.0, 0.02, 1.0), S.AccuracySpec("coarse", 0.0, 0.0, 0.08, 1.0)))
    cov = lambda near, *keep: near.selectExpr(
        *keep, "a", "b", "sqrt(dist2) AS length", "a_error2 + b_error2 AS vee", "0.0D AS ven", "a_error2 AS vnn", "b_error2 AS vuu"
    )
    want = S.relative_test(cov(P.pairs_within(df, "code", 12.0, carry=("error2",))), assigned, specs)
    near = S.assigned_pairs(df, assigned, 12.0, carry=("error2",))
    got = S.relative_test(cov(near, "name"), assigned, specs)
    for one, other in zip(got, want):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect())) and not one.isEmpty()
    with no_small_tables(spark):
        text = plan(S.relative_test(cov(S.assigned_pairs(df, assigned, 12.0, carry=("error2",)), "name"), assigned, specs)[1])
    # The exchange of the summary is the only one above the join of the cells.
    above = text[: text.index("SortMergeJoin")]
    assert above.count("Exchange hashpartitioning") == 1


def test_observations_at_their_far_ends_are_not_shuffled_for_them_again(spark):
    from cairn.operators import observe

    mark = spark.range(50).selectExpr("concat('C', id) AS code", "double(id) AS lon", "double(id) AS lat")
    obs = spark.range(300).selectExpr("id AS obs_key", "concat('C', id % 53) AS from_code", "CASE WHEN id % 9 > 0 THEN concat('C', id * 7 % 51) END AS to_code")
    with no_small_tables(spark):
        ends = observe.resolve_ends(obs.join(mark.selectExpr("code AS to_code", "lat AS there"), "to_code"), mark, ["lon", "lat"])
        # Far ends, near ends and the marks for each of the three joins.
        assert plan(ends).count("Exchange hashpartitioning") == 5
        found = {(r.obs_key, r.f_lon, r.t_lat, r.there) for r in ends.collect()}
    assert found == {(i, float(i % 53), float(i * 7 % 51), float(i * 7 % 51)) for i in range(300) if i % 53 < 50 and i % 9 and i * 7 % 51 < 50}
