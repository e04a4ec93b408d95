"""Steps that go round after round: the planner's estimates stay small and no round does the whole work again."""

import random

from cairn.operators import dissect as D
from cairn.operators import graph as G
from cairn.plans.lineage import store


def estimated(df) -> int:
    """Digits of the size that the planner expects of ``df``."""
    return len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def smallest(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {x: root(x) for x in parent}


def test_components_over_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(G, "LAST_LINKS", 3)
    rnd = random.Random(5)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("hub", f"s{i}") for i in range(40)]
    edges += [(f"r{rnd.randint(0, 40)}", f"r{rnd.randint(0, 40)}") for _ in range(25)] + [("c3", "c4"), ("c4", "c3"), ("c9", "c9"), (None, "c1"), ("n", None)]
    got = G.connected_components(spark.createDataFrame(edges, "a string, b string"))
    expected = {x: x for e in edges for x in e} | smallest([e for e in edges if None not in e])
    assert {r.node: r.component for r in got.collect()} == expected


def test_components_of_a_long_chain_keep_a_small_estimate(spark, monkeypatch):
    # The estimate of self-joins grew with every round, to thousands of digits and minutes of planning.
    monkeypatch.setattr(G, "LAST_LINKS", 20, raising=False)
    chain = spark.range(2000).selectExpr("id AS a", "id + 1 AS b")
    got = G.connected_components(chain)
    assert estimated(got) < 60
    assert got.groupBy("component").count().collect() == [(0, 2001)]


def test_clusters_of_a_chain_keep_a_small_estimate(spark, monkeypatch):
    monkeypatch.setattr(D, "LAST_LINKS", 8)
    ends = spark.range(400).selectExpr("id AS a", "id + 1 AS b")
    edges = store(ends.unionAll(ends.selectExpr("b AS a", "a AS b")))
    paths, height = D._heights(edges, spark.range(401).withColumnRenamed("id", "unit"))
    assert paths.count() == 401 and height > 3
    assert estimated(paths) < 60


def test_small_clusters_share_calls_and_few_ones_are_spread(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = D._deal(spark.range(2000).withColumnRenamed("id", "t"), 2000)
    assert many.select("bucket").distinct().count() <= 8 * parts + 2000 // D.PACK_CLUSTERS
    few = D._deal(spark.range(10).withColumnRenamed("id", "t"), 10)
    assert few.filter("bucket = t").count() == 10 and few.rdd.getNumPartitions() == parts
