"""Nested dissection: direct solution and selected inversion of large sparse components.

The parameters of a station form a unit. Units are gathered into clusters of clusters: in each round the units whose hash
beats their neighbours' become centres and take their neighbours in, so that a round shrinks the graph by about
its degree and a chain of n stations is one cluster after some log n rounds. Of an edge between two clusters one end is a
separator at the height where both first lie in the same cluster; the rest is inner to its own cluster. Units with more
than ``HUB_DEGREE`` neighbours (unknowns shared by many observations) are separators of the last height.

Going up, every cluster eliminates its inner parameters: one dense front, whose Schur complement on the separators around
it goes to the cluster above. Going down, every cluster gets the inverse and the solution on those separators and finds
its own: selected inversion (Takahashi et al. 1973). Every pair that shares a cell meets in one front, so all stored cells
of the inverse, and any wanted pair, come from one pass up and one down. The number of Spark jobs follows the height, not
the number of columns. Fronts of a height are independent tasks. A front above ``FRONT_LIMIT`` parameters ends the attempt
before it is formed; callers then iterate instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.lineage import cut, store

HUB_DEGREE = 256
FRONT_LIMIT = 6000
LEAF_ROUNDS = 2
LAST_LINKS = 512
PACK_CLUSTERS = 32  # clusters that share a call where there are very many
SALTED_BYTES = 1 << 29  # of fronts that are repeated for the parts of their clusters
NULL_PIVOT = 1.0e-10
NULL_SHARE = 1.0e-4

_FACTOR = (
    "t long, pivots array<long>, outer array<long>, w binary, inv binary, y binary, scale binary, nulls binary, "
    "need binary, update binary, rest binary, size int"
)
_FRONT = "t long, ids array<long>, z binary, x binary, nulls binary, row array<long>, col array<long>, value array<double>, id array<long>, solved array<double>, singular array<boolean>"


def unit_of(param: Column) -> Column:
    """A parameter's station, or itself: its name without the last part."""
    return F.when(F.instr(param, "|") > 0, F.regexp_replace(param, r"\|[^|]*$", "")).otherwise(param)


def _heights(edges: DataFrame, units: DataFrame) -> tuple[DataFrame, int]:
    """``(unit, path)``: the clusters a unit lies in, from the leaves up; ``edges(a, b)`` hold both directions."""
    degree = edges.groupBy("a").agg(F.count("*").alias("n"))
    hubs = store(degree.filter(F.col("n") > HUB_DEGREE).select(F.col("a").alias("unit")))
    plain = edges.join(hubs.withColumnRenamed("unit", "a"), "a", "left_anti").join(hubs.withColumnRenamed("unit", "b"), "b", "left_anti")
    work = store(plain.select("a", "b"))
    paths = units.join(hubs, "unit", "left_anti").select("unit", F.col("unit").alias("now"), F.array().cast("array<bigint>").alias("path"))
    rounds, links = 0, work.count()
    while links > LAST_LINKS:
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(rounds)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        best = work.groupBy("a").agg(F.max(rank("b")).alias("m"))
        centres = best.filter(rank("a") > F.col("m")).select(F.col("a").alias("b"))
        # A centre has no centre beside it, so whoever finds one joins it.
        moved = store(work.join(centres, "b").groupBy("a").agg(F.max(rank("b")).alias("m")).select(F.col("a").alias("now"), F.col("m.id").alias("to")))
        paths = paths.join(moved, "now", "left").select("unit", F.coalesce("to", "now").alias("now"), "path")
        end = lambda c: moved.select(F.col("now").alias(c), F.col("to").alias(f"_{c}"))  # noqa: B023, E731
        work = store(
            work.join(end("a"), "a", "left").join(end("b"), "b", "left")
            .select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).filter("a <> b").distinct()
        )
        rounds, links = rounds + 1, work.count()
        if rounds >= LEAF_ROUNDS:
            paths = paths.withColumn("path", F.concat("path", F.array("now")))
        if rounds % 4 == 0:
            paths = store(paths)
    if rounds < LEAF_ROUNDS:
        paths, rounds = paths.withColumn("path", F.array("now")), LEAF_ROUNDS
    height = rounds - LEAF_ROUNDS + 1
    if links or not hubs.isEmpty():
        # All clusters hang from one more, which holds the hubs and what separates the few clusters left.
        inner = paths.select("unit", F.concat("path", F.array(F.lit(-1).cast("bigint"))).alias("path"))
        outer = hubs.select("unit", F.concat(F.array_repeat(F.lit(None).cast("bigint"), height), F.array(F.lit(-1).cast("bigint"))).alias("path"))
        return store(inner.unionByName(outer)), height + 1
    return store(paths.select("unit", "path")), height


def _elimination_heights(edges: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """``(unit, path, at)``: the height at which a unit is eliminated, that of the highest edge it is to separate."""
    end = lambda c: paths.select(F.col("unit").alias(c), F.col("path").alias(f"_{c}"))
    met = F.array_position(F.zip_with("_a", "_b", lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), 1) - 1
    apart = store(edges.join(end("a"), "a").join(end("b"), "b").select("a", "b", met.cast("int").alias("at"), F.element_at("_a", 1).isNull().alias("hub_a"), F.element_at("_b", 1).isNull().alias("hub_b")).filter("at > 0"))
    # The end with more edges to cover at this height; equal ends by hash. A hub always.
    load = apart.groupBy("a", "at").agg(F.count("*").alias("n"))
    weighed = apart.join(load, ["a", "at"]).join(load.select(F.col("a").alias("b"), "at", F.col("n").alias("m")), ["b", "at"])
    weight = lambda h, n, c: F.struct(F.col(h), F.col(n), F.xxhash64(c), F.col(c))
    top = weighed.filter(weight("hub_a", "n", "a") > weight("hub_b", "m", "b")).groupBy(F.col("a").alias("unit")).agg(F.max("at").alias("at"))
    hub = F.element_at("path", 1).isNull()
    return store(paths.join(top, "unit", "left").select("unit", "path", F.when(hub, height - 1).otherwise(F.coalesce("at", F.lit(0))).cast("int").alias("at")))


def _salts(clusters: int, above: int, front: int, spark: SparkSession) -> int:
    """Parts into which the clusters below one are dealt, as one that holds hubs has nearly all below it; each part gets its front."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(parts // max(above, 1), clusters // (max(above, 1) * 8 * PACK_CLUSTERS), SALTED_BYTES // max(8 * front * front * above, 1)))


def _deal(df: DataFrame, clusters: int, salt: str | None = None) -> DataFrame:
    """``df`` by ``bucket`` of the cluster ``t``: many small clusters share a call, few large ones have one each, or one a ``salt``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(8 * parts, clusters // PACK_CLUSTERS)
    bucket = F.col("t") if clusters <= 8 * parts else F.pmod(F.xxhash64("t"), F.lit(buckets))
    # By number, as small rows make much work: the planner would put them into one task.
    if salt is None:
        return df.withColumn("bucket", bucket).repartition(parts, "bucket")
    return df.withColumn("bucket", F.struct(bucket.alias("of"), F.col(salt).alias("salt"))).drop(salt).repartition(parts, "bucket")


def _split(df: pd.DataFrame) -> dict:
    return {t: part for t, part in df.groupby("t", sort=False)} if len(df) else {}


def _eliminate(limit: int, with_inverse: bool = True):
    def run(cells: pd.DataFrame, kids: pd.DataFrame) -> pd.DataFrame:
        own, held = _split(cells), _split(kids)
        return pd.DataFrame([one(t, own.get(t, cells[:0]), held.get(t, kids[:0])) for t in {**own, **held}], columns=_COLUMNS)

    def one(t: int, cells: pd.DataFrame, kids: pd.DataFrame) -> tuple:
        i, j = cells["i"].to_numpy(np.int64), cells["j"].to_numpy(np.int64)
        value = cells["value"].to_numpy(float)
        rhs = j < 0
        pivots = np.unique(i[(i == j) & ~rhs])
        ids = [i, j[~rhs], *(np.asarray(x, np.int64) for x in kids["outer"])]
        outer = np.setdiff1d(np.unique(np.concatenate(ids)) if ids else pivots, pivots)
        members = np.concatenate([pivots, outer])
        p, n = len(pivots), len(members)
        if n > limit:
            return t, [], [], b"", b"", b"", b"", b"", b"", b"", b"", n
        order = np.argsort(members)
        place = lambda x: order[np.searchsorted(members, x, sorter=order)]
        a, b = np.zeros((n, n)), np.zeros(n)
        r, c = place(i[~rhs]), place(j[~rhs])
        np.add.at(a, (r, c), value[~rhs])
        np.add.at(a, (c[r != c], r[r != c]), value[~rhs][r != c])
        np.add.at(b, place(i[rhs]), value[rhs])
        scale = 1.0 / np.sqrt(np.maximum(np.diag(a)[:p], 1e-300))
        for held, update, rest in zip(kids["outer"], kids["update"], kids["rest"]):
            at = place(np.asarray(held, np.int64))
            a[np.ix_(at, at)] += np.frombuffer(update).reshape(len(at), len(at))
            b[at] += np.frombuffer(rest)
        inner = a[:p, :p] * scale[:, None] * scale[None, :]
        nulls = np.zeros((p, 0))
        try:
            np.linalg.cholesky(inner - NULL_PIVOT * np.eye(p))
            inverse = np.linalg.inv(inner)
        except np.linalg.LinAlgError:
            values, vectors = np.linalg.eigh(inner)
            null = values < NULL_PIVOT
            inverse = (vectors * np.where(null, 0.0, 1.0 / np.where(null, 1.0, values))) @ vectors.T
            nulls = vectors[:, null] * scale[:, None]
        inverse = inverse * scale[:, None] * scale[None, :]
        w, y = inverse @ a[:p, p:], inverse @ b[:p]
        update, rest = a[p:, p:] - a[p:, :p] @ w, b[p:] - a[p:, :p] @ y
        pair = np.unique(np.maximum(r, c) * n + np.minimum(r, c)) if with_inverse else np.zeros(0, np.int64)
        need = np.stack([pair // n, pair % n], axis=1).astype(np.int32)
        return t, pivots, outer, w.tobytes(), inverse.tobytes() if with_inverse else b"", y.tobytes(), scale.tobytes(), nulls.tobytes(), need.tobytes(), update.tobytes(), rest.tobytes(), n

    return run


_COLUMNS = [c.split()[0] for c in _FACTOR.split(", ")]


def _back(row, held: np.ndarray, z: np.ndarray | None, x: np.ndarray, nulls: np.ndarray) -> tuple:
    """A cluster's part of the inverse and of the solution, from those of the cluster above (its members ``held``)."""
    pivots, outer = np.asarray(row.pivots, np.int64), np.asarray(row.outer, np.int64)
    p, q = len(pivots), len(outer)
    order = np.argsort(held)
    at = order[np.searchsorted(held, outer, sorter=order)] if q else np.zeros(0, np.int64)
    xb, nb = x[at], nulls[at]
    nb = nb[:, np.abs(nb).max(axis=0) > 0] if q and nb.shape[1] else np.zeros((q, 0))
    w = np.frombuffer(row.w).reshape(p, q)
    scale, own = np.frombuffer(row.scale), np.frombuffer(row.nulls).reshape(p, -1) if p else np.zeros((0, 0))
    solved = np.concatenate([np.frombuffer(row.y) - w @ xb, xb])
    free = np.block([[own, -w @ nb], [np.zeros((q, own.shape[1])), nb]])
    loose = (np.abs(free[:p]) / scale[:, None] > NULL_SHARE).any(axis=1) if free.shape[1] else np.zeros(p, bool)
    ids = np.concatenate([pivots, outer])
    if z is None:
        none = np.zeros(0)
        return row.own, ids, b"", solved.tobytes(), free.tobytes(), none.astype(np.int64), none.astype(np.int64), none, pivots, solved[:p], loose
    zb = z[np.ix_(at, at)]
    zpb, inverse = -w @ zb, np.frombuffer(row.inv).reshape(p, p)
    front = np.block([[inverse - zpb @ w.T, zpb], [zpb.T, zb]])
    i, j = np.frombuffer(row.need, np.int32).reshape(-1, 2).T
    return row.own, ids, front.tobytes(), solved.tobytes(), free.tobytes(), ids[i], ids[j], front[i, j], pivots, solved[:p], loose


_FRONT_COLUMNS = [c.split()[0] for c in _FRONT.split(", ")]


def _down(with_inverse: bool):
    def run(above: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        tops, out = {top.t: top for top in above.itertuples()}, []
        for up, part in _split(own).items():
            if up in tops:
                top = tops[up]
                held = np.asarray(top.ids, np.int64)
                n = len(held)
                z = np.frombuffer(top.z).reshape(n, n) if with_inverse else None
                x, nulls = np.frombuffer(top.x), np.frombuffer(top.nulls).reshape(n, -1) if n else np.zeros((0, 0))
            else:
                held, z, x, nulls = np.zeros(0, np.int64), np.zeros((0, 0)) if with_inverse else None, np.zeros(0), np.zeros((0, 0))
            out.extend(_back(r, held, z, x, nulls) for r in part.itertuples())
        return pd.DataFrame(out, columns=_FRONT_COLUMNS)

    return run


@dataclass
class Plan:
    """What an elimination owes to the pattern of its cells alone, so that another matrix of the same pattern may go by it.

    ``spots(param, id, at, t)``: number, height and cluster of the elimination; ``plan(unit, path, at)``; clusters by height.
    """

    spots: DataFrame
    plan: DataFrame
    height: int
    clusters: list[int]


@dataclass
class Dissection:
    """``cells(row, col, value)`` of the inverse, row >= col by number of the parameter, and ``solution(param, x, singular)``."""

    cells: DataFrame
    solution: DataFrame
    height: int
    largest: int
    plan: Plan


def _planned(cells: DataFrame, params: DataFrame, sparse: int | None) -> Plan | None:
    """The plan for ``cells(row, col)``; None where more than ``sparse`` cells a parameter and linked units a unit are given."""
    names = store(params.distinct().withColumn("id", F.monotonically_increasing_id()))
    numbered = store(names.withColumn("unit_name", unit_of(F.col("param"))))
    units = numbered.groupBy("unit_name").agg(F.min("id").alias("unit"))
    numbered = store(numbered.join(units, "unit_name"))
    units = numbered.select("unit_name", "unit").distinct()
    linked = cells.select(unit_of(F.col("row")).alias("_ua"), unit_of(F.col("col")).alias("_ub")).filter("_ua <> _ub").distinct()
    end = lambda c: units.select(F.col("unit_name").alias(f"_u{c}"), F.col("unit").alias(c))
    one_way = linked.join(end("a"), "_ua").join(end("b"), "_ub").select("a", "b")
    edges = store(one_way.unionAll(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if sparse is not None:
        # Both triangles count, and a unit's link to itself.
        number = numbered.count()
        if 2 * cells.count() - number > sparse * number:
            several = units.count()
            if several == number or edges.count() + several > sparse * several:
                return None
    paths, height = _heights(edges, numbered.select("unit").distinct())
    plan = _elimination_heights(edges, paths, height)
    own = plan.select("unit", "at", F.element_at("path", F.col("at") + 1).alias("t"))
    spots = store(numbered.join(own, "unit").select("param", "id", "at", "t"))
    clusters = list(plan.agg(*[F.count_distinct(F.element_at("path", k + 1)) for k in range(height)]).first())
    return Plan(spots, plan, height, clusters)


def dissect(
    matrix: DataFrame, rhs: DataFrame | None = None, wanted: DataFrame | None = None, limit: int | None = None, inverse: bool = True,
    sparse: int | None = None, plan: Plan | None = None,
) -> Dissection | None:
    """Solve ``matrix(row, col, value)``, both triangles given, and invert it at its own cells and the ``wanted(row, col)`` pairs.

    With ``inverse`` off only the solution goes down; ``cells`` is empty.
    None where a front would hold more than ``limit`` parameters, or where the matrix and the graph of its units have more than ``sparse``
    links each. Undetermined parameters are flagged ``singular``; the solution and
    inverse hold null directions at zero in the separators where they show. Wanted pairs count as links, so many pairs
    of distant stations make large fronts. ``plan`` hands in that of a matrix of the same pattern; where the pattern turns out to
    be another, it is made anew.
    """
    limit = FRONT_LIMIT if limit is None else limit
    half = matrix.filter("row >= col").select("row", "col", "value")
    if wanted is not None:
        half = half.unionByName(wanted.select(F.greatest("row", "col").alias("row"), F.least("row", "col").alias("col")).distinct().withColumn("value", F.lit(0.0)))
    given = plan
    plan = given or _planned(half, matrix.select(F.col("row").alias("param")), sparse)
    if plan is None:
        return None
    height, clusters = plan.height, plan.clusters

    def parents(k: int) -> DataFrame:
        return plan.plan.select(F.element_at("path", k + 1).alias("t"), F.element_at("path", k + 2).alias("up")).filter("t IS NOT NULL").distinct()

    # A cell belongs to the cluster that eliminates the first of its two parameters.
    spot = lambda c, e: plan.spots.select(F.col("param").alias(c), F.col("id").alias(f"i{e}"), F.col("at").alias(f"a{e}"), F.col("t").alias(f"t{e}"))
    placed = half.join(spot("row", 0), "row").join(spot("col", 1), "col").select(
        F.least("a0", "a1").alias("at"), F.when(F.col("a0") <= F.col("a1"), F.col("t0")).otherwise(F.col("t1")).alias("t"),
        F.greatest("i0", "i1").alias("i"), F.least("i0", "i1").alias("j"), "value",
    )
    if rhs is not None:
        placed = placed.unionByName(rhs.join(plan.spots, "param").select("at", "t", F.col("id").alias("i"), F.lit(-1).cast("bigint").alias("j"), F.col("b").alias("value")))
    placed = store(placed)
    if given is not None and placed.count() < half.count() + (0 if rhs is None else rhs.count()):
        return dissect(matrix, rhs, wanted, limit, inverse, sparse)
    factors, kids, sizes = [], None, []
    nothing = matrix.sparkSession.createDataFrame([], "t long, outer array<long>, update binary, rest binary")
    for k in range(height):
        own = _deal(placed.filter(F.col("at") == k).select("t", "i", "j", "value"), clusters[k])
        below = _deal(nothing if kids is None else kids, clusters[k])
        done = cut(own.groupBy("bucket").cogroup(below.groupBy("bucket")).applyInPandas(_eliminate(limit, inverse), _FACTOR))
        most = done.agg(F.max("size").alias("size"), F.max(F.size("outer")).alias("outer")).first()
        sizes.append(most["size"] or 0)
        if sizes[-1] > limit:
            return None
        if given is not None and k + 1 == height and (most["outer"] or 0) > 0:
            # A link that the plan does not know is left over at the end.
            return dissect(matrix, rhs, wanted, limit, inverse, sparse)
        if k + 1 < height:
            done = done.join(parents(k), "t")
            kids = done.select(F.col("up").alias("t"), "outer", "update", "rest")
            done = done.drop("update", "rest")
        else:
            done = done.drop("update", "rest").withColumn("up", F.col("t"))
        factors.append(done)
    fronts, out = matrix.sparkSession.createDataFrame([], _FRONT), []
    for k, done in reversed(list(enumerate(factors))):
        # Clusters meet the one above, whose inverse is as large as its front: few of those share a call.
        up = min(k + 1, height - 1)
        salts = _salts(clusters[k], clusters[up], sizes[up] if inverse else 0, matrix.sparkSession)
        own = done.withColumnsRenamed({"t": "own", "up": "t"}).withColumn("salt", F.pmod(F.xxhash64("own"), F.lit(salts)).cast("int"))
        keep = fronts.select("t", "ids", "z", "x", "nulls").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        fronts = cut(
            _deal(keep, clusters[up], "salt").groupBy("bucket").cogroup(_deal(own, clusters[up], "salt").groupBy("bucket")).applyInPandas(_down(inverse), _FRONT)
        )
        out.append(fronts)
    parts = _FRONT_COLUMNS[5:]
    gathered = out[0].select(*parts)
    for more in out[1:]:
        gathered = gathered.unionByName(more.select(*parts))
    names = plan.spots.select("param", "id")
    name = lambda c: names.select(F.col("param").alias(f"{c}_name"), F.col("id").alias(c))
    cells = gathered.select(F.inline(F.arrays_zip("row", "col", "value"))).join(name("row"), "row").join(name("col"), "col").select(F.col("row_name").alias("row"), F.col("col_name").alias("col"), "value")
    solution = gathered.select(F.inline(F.arrays_zip("id", "solved", "singular"))).join(names, "id").select("param", F.col("solved").alias("x"), "singular")
    return Dissection(cells, solution, height, max(sizes, default=0), plan)
