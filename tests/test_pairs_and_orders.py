import math
import random

from cairn.operators import pairs as P
from cairn.operators import spec as S


def points(n=120, seed=2):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        # A third of all points crowd on one spot or near it.
        if i % 3 == 0:
            out.append((f"p{i:03d}", 5.0 + (0 if i % 2 else rnd.random() * 0.01), 5.0, 5.0))
        else:
            out.append((f"p{i:03d}", rnd.random() * 40, rnd.random() * 40, rnd.random() * 4))
    return out


def dist(a, b):
    return math.dist(a[1:], b[1:])


def test_pairs_in_range_match_brute_force(spark):
    pts = points()
    df = spark.createDataFrame(pts, "code string, x double, y double, z double")
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and dist(a, b) < 3.0}
    for hot in (10, 10**6):
        got = [(r.a, r.b) for r in P.pairs_within(df, "code", 3.0, hot_rows=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_nearest_matches_brute_force(spark):
    pts = points()
    df = spark.createDataFrame(pts, "code string, x double, y double, z double")
    for k, low, high in ((1, 0.0, None), (4, 0.5, 12.0)):
        got = {}
        for r in P.nearest(df, df, "code", "code", k, max_distance=high, min_distance=low, exclude_same=True, crowd=5).collect():
            got.setdefault(r.query, []).append((r.place, r.target))
        for p in pts:
            near = sorted((dist(p, q), q[0]) for q in pts if q[0] != p[0] and dist(p, q) >= low and (high is None or dist(p, q) <= high))
            assert [t for _, t in sorted(got.get(p[0], []))] == [c for _, c in near[:k]]


def test_nearest_segment_matches_brute_force(spark):
    rnd = random.Random(9)
    segs = [(i, *[rnd.random() * 20 for _ in range(4)]) for i in range(30)] + [(30, 4.0, 1.0, 4.0, 15.0)]
    pts = [(f"q{i}", rnd.random() * 20, rnd.random() * 20) for i in range(80)]
    got = {
        r.query: (r.segment, r.dist)
        for r in P.nearest_segment(
            spark.createDataFrame(pts, "q string, x double, y double"), spark.createDataFrame(segs, "s long, x1 double, y1 double, x2 double, y2 double"), "q", "s", 0.7
        ).collect()
    }

    def away(p, s):
        _, x1, y1, x2, y2 = s
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((p[1] - x1) * dx + (p[2] - y1) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[1] - x1 - t * dx, p[2] - y1 - t * dy)

    for p in pts:
        best = min((away(p, s), s[0]) for s in segs)
        if best[0] < 0.7:
            assert got[p[0]][0] == best[1] and abs(got[p[0]][1] - best[0]) < 1e-9
        else:
            assert p[0] not in got


def one_at_a_time(marks, edges, min_pairs):
    """The elimination as a plain loop over all marks."""
    status = {m["code"]: m["status"] for m in marks}
    info = {m["code"]: m for m in marks}

    def counts(c):
        live = [(o, bad) for a, b, bad in edges for s, o in ((a, b), (b, a)) if s == c and status[o] != "fail"]
        return len(live), sum(b for _, b in live), sum(b for o, b in live if status[o] != "unknown")

    while True:
        unknown = [c for c in status if status[c] == "unknown"]
        falls = [c for c in unknown if counts(c)[2] > 0 or counts(c)[0] < min_pairs]
        if falls:
            for c in falls:
                status[c] = "fail"
            continue
        for c in [c for c in unknown if counts(c)[1] == 0]:
            status[c] = "pass"
        left = [c for c in status if status[c] == "unknown" and counts(c)[0] > 0]
        if not left:
            return status
        rank = lambda c: S._rank(info[c]["priority"], info[c]["test_order"], counts(c)[1] / counts(c)[0], info[c]["error2"], c)
        status[max(left, key=rank)] = "fail"


def test_elimination_matches_the_plain_loop(spark):
    rnd = random.Random(11)
    for min_pairs in (0, 2):
        marks, edges = [], []
        for block in range(6):
            names = [f"b{block}m{i}" for i in range(8)]
            for c in names:
                marks.append(
                    {"code": c, "status": "passed" if rnd.random() < 0.15 else "unknown", "priority": rnd.choice([None, 1, 2]), "test_order": rnd.randint(0, 1),
                     "error2": rnd.random()}
                )
            pool = [(a, b) for a in names for b in names if a < b]
            for a, b in rnd.sample(pool, 16):
                edges.append((a, b, rnd.random() < 0.4))
        status = {m["code"]: m["status"] for m in marks}
        edges = [e for e in edges if "unknown" in (status[e[0]], status[e[1]])]
        df = spark.createDataFrame(
            [(m["code"], m["status"], m["priority"], m["test_order"], m["error2"]) for m in marks], "code string, status string, priority int, test_order int, error2 double"
        )
        links = spark.createDataFrame([(a, b, "fail" if bad else "pass") for a, b, bad in edges], "a string, b string, status string")
        got = {r.code: r.status for r in S.eliminate(df, links, S.OrderTest("A", min_pairs=min_pairs)).collect()}
        assert got == one_at_a_time(marks, edges, min_pairs)
        # The same marks fail where components do not fit into a task and are taken a part at a time.
        for limit in (0, 12):
            wide = {r.code: r.status for r in S.eliminate(df, links, S.OrderTest("A", min_pairs=min_pairs), edge_limit=limit).collect()}
            assert wide == got
