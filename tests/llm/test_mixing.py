import itertools

import pytest
from pyspark.sql import functions as F

from cairn.llm import mixing
from tests.llm.util import awkward, frame, prose


def poured(sizes, weights, share, most):
    """Targets by resharing the excess over and over."""
    got = [share * sum(sizes) * w / sum(weights) for w in weights]
    full = set()
    for _ in range(1000):
        excess = 0.0
        for i, s in enumerate(sizes):
            if got[i] > most * s:
                excess += got[i] - most * s
                got[i] = most * s
                full.add(i)
        rest = sum(w for i, w in enumerate(weights) if i not in full)
        if excess < 1e-12 or not rest:
            break
        for i, w in enumerate(weights):
            if i not in full:
                got[i] += excess * w / rest
    return got


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 10, 20, 0, 500], [5], [0, 0], [7, 7000, 3, 50, 900, 12]])
def test_targets(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    assert mixing.targets(sizes, weights) == pytest.approx(poured(sizes, weights, 1.5, 2))


def cheapest(capacity, members, quota):
    """Least cost of whole-word flows by trying every split of each pattern."""
    best = None
    choices = []
    for c, m in zip(capacity, members):
        choices.append([x for x in itertools.product(range(2 * c + 1), repeat=len(m)) if sum(x) <= 2 * c])
    for pick in itertools.product(*choices):
        got = [0] * len(quota)
        for x, m in zip(pick, members):
            for v, s in zip(x, m):
                got[s] += v
        if got == quota:
            cost = sum(max(0, sum(x) - c) for x, c in zip(pick, capacity))
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize(
    "capacity,members,quota",
    [([3, 3], [[0], [1]], [4, 2]), ([3, 2, 2], [[0, 1], [0], [1]], [4, 3]), ([2, 2, 2], [[0], [0, 1], [1, 2]], [3, 2, 3]), ([1, 4], [[0, 1], [1]], [2, 4])],
)
def test_flow_meets_quotas_at_least_cost(capacity, members, quota):
    sent = mixing.flow(capacity, members, quota)
    assert sum(map(sum, sent)) == pytest.approx(sum(quota))
    assert sum(copies[1] for copies in sent) == pytest.approx(cheapest(capacity, members, quota))
    for copies, c in zip(sent, capacity):
        assert copies[1] == 0 or copies[0] == pytest.approx(c)


def test_awkward_rows_near_targets_and_same_again(spark):
    rows = awkward() + [(1000 + i, prose(i, 5 + i % 40), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(400)]
    for wide in (False, True):
        docs = frame(spark, rows, wide)
        out = mixing.mix(docs, F.array("source"))
        got = sorted(out.collect(), key=str)
        assert len(got) == len(rows)
        assert got == sorted(mixing.mix(docs, F.array("source")).collect(), key=str)
    source, by = {r[0]: r[3] for r in rows}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        if r.doc_id is not None and r.doc_id >= 1000:
            target, taken, most = by.get(source[r.doc_id], (r.targets[0], 0, 0))
            by[source[r.doc_id]] = target, taken + r.taken, max(most, r.size)
    assert len(by) == 6
    for target, taken, most in by.values():
        assert abs(taken - target) <= most / 2 + 1e-6
    assert mixing.mix(frame(spark, []), F.array("source")).collect() == []


def test_overlapping_sources_and_carried_columns(spark):
    rows = [(i, prose(i, 10), "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(300)]
    docs = frame(spark, rows, wide=True)
    out = mixing.mix(docs, F.array("source", "lang"), carry=True)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.columns[len(docs.columns) :] == ["size_", "source_sizes", "targets", "repeats", "taken"]
    total = out.agg(F.sum("taken")).first()[0]
    # Sources overlap, so all sizes count each document twice.
    assert abs(total - 1.5 * 2 * 300 * 10) <= 300 or total == 2 * 300 * 10


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 10, 20, 0, 500], [5], [0, 0], [7, 7000, 3, 50, 900, 12], list(range(1, 200))])
def test_quotas_are_the_targets(spark, sizes):
    sized = spark.createDataFrame([([f"s{i:04d}"], n) for i, n in enumerate(sizes)], "sources array<string>, size long")
    got = [r.target for r in mixing.quotas(sized, mixing.WEIGHTS, 1.5, 2).orderBy("number").collect()]
    assert got == pytest.approx(mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]))


def test_more_than_twenty_thousand_sources(spark):
    """One source with a third of the rows beside 20,001 others: rows as by plain arithmetic over all of them, with and without a broadcast."""
    docs = spark.range(30_003).selectExpr(
        "id AS doc_id", "repeat('w ', CAST(1 + id % 7 AS INT)) AS text", "'en' AS lang", "CASE WHEN id < 10002 THEN 'hot' ELSE concat('s', id) END AS source", "id AS n_chars"
    )
    got = {r.doc_id: r for r in mixing.mix(docs, F.array("source")).collect()}
    assert len(got) == 30_003
    sizes = {}
    for i in range(30_003):
        name = "hot" if i < 10_002 else f"s{i}"
        sizes[name] = sizes.get(name, 0) + 1 + i % 7
    names = sorted(sizes)
    want = dict(zip(names, mixing.targets([sizes[n] for n in names], [(3, 1, 2)[k % 3] for k in range(len(names))])))
    taken = {}
    for i, r in got.items():
        name = "hot" if i < 10_002 else f"s{i}"
        assert r.source_sizes == [sizes[name]] and r.targets == pytest.approx([want[name]])
        taken[name] = taken.get(name, 0) + r.taken
    assert all(abs(taken[n] - want[n]) <= 3.5 + 1e-6 for n in names)
    assert sorted(mixing.mix(docs, F.array("source"), broadcast_rows=5).collect()) == sorted(got.values())


def test_overlapping_parts_are_routed_apart(spark):
    """Parts that share no source get what one flow over all patterns gives them in sum, and single sources their closed form."""
    spec = [(["a"], 30), (["a", "b"], 50), (["b"], 10), (["c"], 40), (["d", "e"], 25), (["e", "f"], 35), (["f"], 5), ([None], 20)]
    rows, i = [], 0
    for sources, n in spec:
        for _ in range(n):
            rows.append((i, "one two three", sources))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, names array<string>")
    got = mixing.mix(docs, F.col("names")).collect()
    assert sorted(got) == sorted(mixing.mix(docs, F.col("names")).collect())
    names = ["a", "b", "c", "d", "e", "f", None]
    members = [[names.index(s) for s in p] for p, _ in spec]
    sizes = [sum(3 * n for p, n in spec if s in p) for s in names]
    quota = mixing.targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))])
    whole = mixing.flow([3 * n for _, n in spec], members, quota)
    by = {}
    for r in got:
        by[tuple(rows[r.doc_id][2])] = by.get(tuple(rows[r.doc_id][2]), 0) + r.taken
    for part in (["a", "b"], ["c"], ["d", "e", "f"], [None]):
        mine = sum(by[tuple(p)] for p, _ in spec if p[0] in part)
        want = sum(sum(c) for (p, _), c in zip(spec, whole) if p[0] in part)
        assert abs(mine - want) <= 1.5 * 4
