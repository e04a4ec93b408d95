"""Connected pairs and components of the observation graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.lineage import store

LAST_LINKS = 20_000  # edges of a contracted graph, both directions, that one task takes


def connected_pairs(observations: DataFrame, set_id: str | None = None) -> DataFrame:
    """Unique station pairs joined by an observation, lower code first.

    With ``set_id`` given, targets of one grouped round also join each other, whatever the round's size.
    """
    direct = observations.filter(F.col("to_code").isNotNull() & (F.col("from_code") != F.col("to_code"))).select(
        F.least("from_code", "to_code").alias("a"), F.greatest("from_code", "to_code").alias("b")
    )
    if set_id is not None:
        members = observations.filter(F.col("to_code").isNotNull()).select(set_id, "to_code").distinct()
        sizes = members.groupBy(set_id).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
        small = members.join(sizes.select(set_id), set_id)
        other = small.select(set_id, F.col("to_code").alias("_other"))
        inner = (
            small.join(other, set_id)
            .filter(F.col("to_code") < F.col("_other"))
            .select(F.col("to_code").alias("a"), F.col("_other").alias("b"))
        )
        direct = direct.unionByName(inner)
    return direct.distinct()


def _union():
    """A task's function that gives the smallest node of each component among the few edges left of a contracted graph."""

    def run(batches):
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch["a"], batch["b"]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
        if parent:
            yield pd.DataFrame({"a": list(parent), "to": [root(x) for x in parent]})

    return run


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` with the smallest node as the component's name.

    Contracts the graph: in a round every node moves to the neighbour with the least hash, or stays if its own is less, and only
    edges between different places go on. A chain halves in a round and denser graphs shrink faster, so that all
    rounds together cost little more than the first. The last ``LAST_LINKS`` edges are joined in one task. Then the moves
    are followed back, each round's over the one after it. A node's least neighbour is a combinable aggregate,
    so a hub with a third of all edges stays spread out.
    """
    both = lambda df: df.select("a", "b").unionAll(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    work = store(both(edges.select("a", "b").filter("a <> b")).distinct())
    links, moves = work.count(), []
    while links > LAST_LINKS:
        if len(moves) == max_rounds:
            raise RuntimeError("components did not settle; raise max_rounds")
        salt = F.lit(len(moves))
        rank = lambda c: F.struct(F.xxhash64(c, salt).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        moved = store(work.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least(rank("a"), "m")["id"].alias("to")))
        moves.append(moved)
        end = lambda c: moved.select(F.col("a").alias(c), F.col("to").alias(f"_{c}"))  # noqa: B023, E731
        work = store(
            work.join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct()
        )
        links = work.count()
    kind = work.schema["a"].dataType.simpleString()
    found = work.coalesce(1).filter("a < b").mapInPandas(_union(), f"a {kind}, to {kind}")
    for moved in reversed(moves):
        found = moved.join(found.select(F.col("a").alias("to"), F.col("to").alias("_up")), "to", "left").select("a", F.coalesce("_up", "to").alias("to"))
    if moves:
        found = store(found)
        least = found.groupBy("to").agg(F.min("a").alias("_least"))
        found = found.join(least, "to").select("a", F.col("_least").alias("to"))
    labelled = found.select(F.col("a").alias("node"), F.col("to").alias("component"))
    ends = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node")))
    if nodes is not None:
        ends = ends.unionAll(nodes.select(F.col(nodes.columns[0]).alias("node")))
    return ends.distinct().join(labelled, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
