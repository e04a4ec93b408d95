"""Mix overlapping sources to target weights: min-cost flow over membership patterns, then seeded selection.

A document belongs to one or more sources; documents with the same set of sources form a
pattern. Patterns are sized by one aggregation. A flow network routes their words to the quotas
of their sources: the first copy of a pattern costs nothing a word, each further copy more
than the one before, so words repeat only where quotas cannot be met otherwise. The network has a node
for each pattern and source and no documents. It falls into parts that share no source: a pattern
that has its one source to itself is routed in closed form, and each connected part of the others by one task,
which holds that part's patterns and sources. Sources are numbered, weighed and levelled by Spark; there
is no limit on their number. A pattern's flow is then
``repeats`` whole passes and a part; the part takes the documents with the smallest seeded hashes up to
a cut found from 4,096 hash ranges and, in the one range where it lies, the documents. No window
or group holds a whole source.

Sizes are runs of characters other than ASCII white space. A null text has size 0 and takes 0. A null
source is a source of its own, last in order. Documents without an id are hashed by their text; equal
hashes go together. Very long texts are counted whole. Without rows the result is empty. Reruns agree.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cairn.llm.common import SALTS, components, free_name, freeze
from cairn.plans.skew import BROADCAST_ROWS, bounded_broadcast

SEED = "mix0"
SHARE = 1.5
MAX_REPEAT = 2
WEIGHTS = (3, 1, 2)
RANGES = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MAX_REPEAT) -> list[float]:
    """Split ``share`` of all sizes by weight; nobody gets more than ``most`` times its size, the excess is shared again."""
    total, caps = share * sum(sizes), [most * s for s in sizes]
    held: set[int] = set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in held]
        weight = sum(weights[i] for i in open_)
        level = (total - sum(caps[i] for i in held)) / weight if weight else 0.0
        above = [i for i in open_ if weights[i] * level > caps[i]]
        if not above:
            return [float(caps[i]) if i in held else weights[i] * level for i in range(len(sizes))]
        held.update(above)


def flow(capacity: Sequence[float], members: Sequence[Sequence[int]], quota: Sequence[float], copies: int = MAX_REPEAT, cost: Callable[[int], float] = lambda r: r) -> list[list[float]]:
    """Words each pattern sends in each of its copies, least cost first.

    Successive shortest paths: quotas are filled from the cheapest copy that can reach them, over
    detours through patterns that several sources share. Costs rise with each copy, so copies fill in order.
    """
    left = [[float(c)] * copies for c in capacity]
    sent: list[dict[int, float]] = [dict.fromkeys(m, 0.0) for m in members]
    of_source: list[list[int]] = [[] for _ in quota]
    for p, m in enumerate(members):
        for s in m:
            of_source[s].append(p)
    need = [float(q) for q in quota]
    tiny = 1e-9 * max([1.0, *need])
    # Words already sent are charged to no source in particular, so a detour costs nothing: a source is
    # reached from the cheapest copy of any pattern that is joined to it by patterns already in use.
    for s in range(len(quota)):
        while need[s] > tiny:
            best = {s: None}
            queue: list[tuple[int, float, int]] = [(0, float(s), s)]
            end = None
            choice = (float("inf"),)
            while queue:
                hops, _, at = heapq.heappop(queue)
                for p in of_source[at]:
                    layer = next((r for r in range(copies) if left[p][r] > tiny), None)
                    if layer is not None and (cost(layer), hops, p) < choice:
                        choice, end = (cost(layer), hops, p), (at, p, layer)
                    for other in members[p]:
                        if other not in best and sent[p][other] > tiny:
                            best[other] = (at, p)
                            heapq.heappush(queue, (hops + 1, float(other), other))
            if end is None:
                break
            at, p, layer = end
            path, amount = [], min(need[s], left[p][layer])
            node = at
            while best[node] is not None:
                before, q = best[node]
                path.append((before, q, node))
                amount = min(amount, sent[q][node])
                node = before
            left[p][layer] -= amount
            sent[p][at] += amount
            for before, q, after in path:
                sent[q][after] -= amount
                sent[q][before] += amount
            need[s] -= amount
    return [[capacity[p] - x for x in left[p]] for p in range(len(capacity))]


def _numbered(df: DataFrame, order: Column, number: str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from a distributed sort and the sizes of its partitions."""
    placed = freeze(df.orderBy(order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    start, starts = 0, []
    # One row for each partition of the sort.
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r["part"], start))
        start += r["count"]
    table = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn(number, F.col("_start") + inside).drop("_place", "_part", "_start")


def quotas(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``targets`` in Spark: source, source_size, patterns (how many hold it), number (its order) and target, from ``(sources, size)`` of each pattern."""
    each = sized.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("patterns"))
    numbered = _numbered(each, F.col("source").asc_nulls_last(), "number")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    known = freeze(numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    total = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    # The level rises from round to round, and who is above it stays above it.
    level, held = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        sums = known.agg(F.count_if(above).alias("held"), F.sum(F.when(above, F.col("cap"))).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if sums.held == held:
            break
        held = sums.held
        if sums.open:
            level = max(level, (total - (sums.full or 0.0)) / sums.open)
    return known.withColumn("target", F.least("cap", F.col("weight") * F.lit(level))).drop("weight", "cap")


def _route(most: int):
    def route(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(_order=[tuple(n) for n in part["numbers"]]).sort_values("_order")
        numbers = sorted({int(n) for row in part["numbers"] for n in row})
        place = {n: i for i, n in enumerate(numbers)}
        target = {int(n): float(t) for row in part.itertuples() for n, t in zip(row.numbers, row.targets)}
        sizes = [int(x) for x in part["size"]]
        sent = flow(sizes, [[place[int(n)] for n in row] for row in part["numbers"]], [target[n] for n in numbers], most)
        whole = [sum(1 for x in copies if size and x >= size) for size, copies in zip(sizes, sent)]
        rest = [float(copies[w]) if size and w < most else 0.0 for size, copies, w in zip(sizes, sent, whole)]
        return part[["sources", "source_sizes", "targets"]].assign(repeats=whole, part=rest)

    return route


def plan(rows: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """From ``(sources, size, u)`` of each document: sources, source_sizes, targets, repeats, cut; one row per pattern."""
    sized = freeze(rows.groupBy("sources").agg(F.sum("size").alias("size")))
    quota = freeze(quotas(sized, weights, share, most))
    at = sized.select("sources", "size", F.posexplode("sources").alias("at", "_source"))
    met = at.join(bounded_broadcast(quota), F.col("_source").eqNullSafe(F.col("source")))
    facts = met.groupBy("sources", "size").agg(F.sort_array(F.collect_list(F.struct("at", "source_size", "target", "number", "patterns"))).alias("f"))
    facts = freeze(facts.select("sources", "size", F.col("f.source_size").alias("source_sizes"), F.col("f.target").alias("targets"), F.col("f.number").alias("numbers"), ((F.size("f") == 1) & (F.col("f")[0]["patterns"] == 1)).alias("alone")))
    target = F.col("targets")[0]
    whole = sum((F.when((F.col("size") > 0) & (target >= F.col("size") * k), 1).otherwise(0) for k in range(1, most + 1)), F.lit(0))
    rest = F.when((F.col("size") > 0) & (whole < most), target - whole * F.col("size")).otherwise(0.0)
    table = facts.filter("alone").select("sources", "source_sizes", "targets", whole.cast("int").alias("repeats"), rest.alias("part"))
    shared = facts.filter("NOT alone")
    if not shared.isEmpty():
        edges = shared.select(F.col("numbers")[0].alias("a"), F.explode("numbers").alias("b")).filter("a <> b")
        named = components(edges).withColumnRenamed("node", "_first")
        parts = shared.withColumn("_first", F.col("numbers")[0]).join(named, "_first")
        table = table.unionByName(parts.groupBy("component").applyInPandas(_route(most), "sources array<string>, source_sizes array<long>, targets array<double>, repeats int, part double"))
    table = freeze(table)
    ranged = rows.groupBy("sources", F.shiftright("u", 40).alias("range")).agg(F.sum("size").alias("_size"))
    running = Window.partitionBy("sources").orderBy("range")
    here = ranged.withColumn("_upto", F.sum("_size").over(running)).join(bounded_broadcast(table.select("sources", "part")), "sources")
    here = here.filter((F.col("_upto") >= F.col("part")) & (F.col("_upto") - F.col("_size") < F.col("part")) & (F.col("_size") > 0))
    inside = rows.withColumn("range", F.shiftright("u", 40)).join(here.select("sources", "range", "part", (F.col("_upto") - F.col("_size")).alias("_below")), ["sources", "range"])
    by_hash = inside.groupBy("sources", "range", "u").agg(F.sum("size").alias("_size"), F.first("part").alias("part"), F.first("_below").alias("_below"))
    order = Window.partitionBy("sources", "range").orderBy("u")
    # Up to the document whose middle lies below the part wanted.
    taken = by_hash.withColumn("_mid", 2 * (F.col("_below") + F.sum("_size").over(order)) - F.col("_size")).filter(F.col("_mid") < 2 * F.col("part"))
    cuts = taken.groupBy("sources").agg(F.max("u").alias("_in"))
    floor = here.groupBy("sources").agg((F.min("range") * F.lit(1 << 40) - 1).alias("_floor"))
    found = floor.join(cuts, "sources", "left").select("sources", F.coalesce("_in", "_floor").alias("cut"))
    return table.join(found, "sources", "left").withColumn("cut", F.coalesce("cut", F.lit(-1)))


def mix(
    docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MAX_REPEAT, seed: str = SEED,
    carry: bool = False, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Each row of ``docs`` with size, source_sizes, targets (by its sources in order), repeats and taken.

    ``sources`` is an array of source names; null names are allowed. With ``carry`` the rows keep all their columns
    and sizes are counted again beside them (new names get underscores where taken); otherwise only the id is kept.
    The patterns' cuts are broadcast up to ``broadcast_rows`` patterns.
    """
    text = F.col(text_col).cast("string")
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), text), F.lit(""))
    hash_ = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), key).cast("binary")), 1, 13), 16, 10).cast("long")
    named = {"sources": F.array_sort(F.array_distinct(sources)), "size": size_of(text), "u": hash_}
    rows = freeze(docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in named.items()]))
    cuts = freeze(plan(rows, weights, share, most).select(F.col("sources").alias("_mix_sources"), F.struct("source_sizes", "targets", "repeats", "cut").alias("_mix_plan")))
    if carry:
        rows = docs.withColumns({f"_mix_{n}_": c for n, c in named.items()})
        at = {n: F.col(f"_mix_{n}_") for n in named}
    else:
        at = {n: F.col(n) for n in named}
    kept = docs.columns if carry else ["doc_id"]
    same = at["sources"].eqNullSafe(F.col("_mix_sources"))
    if cuts.limit(broadcast_rows + 1).count() <= broadcast_rows:
        out = rows.join(F.broadcast(cuts), same, "left")
    else:
        # A pattern that holds a large share of the rows is met in parts.
        dealt = cuts.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.join(dealt, same & (F.pmod(at["u"], F.lit(SALTS)) == F.col("_mix_salt")), "left")
    times = F.coalesce("_mix_plan.repeats", F.lit(0)) + F.when(at["u"] <= F.col("_mix_plan.cut"), 1).otherwise(0)
    made = {
        "size": at["size"], "source_sizes": F.col("_mix_plan.source_sizes"), "targets": F.col("_mix_plan.targets"),
        "repeats": times.cast("int"), "taken": at["size"] * times,
    }
    return out.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(free_name(docs, n) if carry else n) for n, c in made.items()])
