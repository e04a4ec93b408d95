"""Solving normal equations: one task per small component; large ones by dissection if sparse, else by conjugate gradients."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.dissect import dissect
from cairn.operators.graph import connected_components
from cairn.plans.lineage import cut, store

DENSE_LIMIT = 1500
PACK_ROWS = 200_000
PACK_SIZE = 150  # parameters of a component up to which it shares a call with others
NULL_PIVOT = 1.0e-10
SPARSE_CELLS = 24  # stored cells a parameter, or linked stations a station, up to which separators are expected to be small


def components_of(matrix: DataFrame) -> DataFrame:
    """``(param, component, size)`` of the parameter graph."""
    edges = matrix.filter("row < col").select(F.col("row").alias("a"), F.col("col").alias("b"))
    nodes = matrix.filter("row = col").select("row")
    comps = connected_components(edges, nodes).withColumnRenamed("node", "param")
    sizes = comps.groupBy("component").agg(F.count("*").alias("size"))
    return comps.join(sizes, "component")


def number_parameters(matrix: DataFrame) -> DataFrame:
    """Consecutive row numbers for the parameters in use, components side by side."""
    from cairn.plans.ordered import number_rows

    return number_rows(components_of(matrix), ["component", "param"], "row_no")


def _dense_solver(with_inverse: bool):
    def solve(batch: pd.DataFrame) -> pd.DataFrame:
        # Names are compared once for all components that share the call.
        row, names = pd.factorize(batch["row"].to_numpy(), sort=True)
        col = pd.Index(names).get_indexer(batch["col"].to_numpy())
        right, value = batch["col"].isna().to_numpy(), batch["value"].to_numpy()
        component, _ = pd.factorize(batch["component"].to_numpy())
        order = np.argsort(component, kind="stable")
        out = []
        for part in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            ids, index = np.unique(row[part], return_inverse=True)
            cells = ~right[part]
            n = len(ids)
            a = np.zeros((n, n))
            np.add.at(a, (index[cells], np.searchsorted(ids, col[part][cells])), value[part][cells])
            b = np.zeros(n)
            np.add.at(b, index[~cells], value[part][~cells])
            x, inverse, bad = _factor(a, b)
            out.append((ids, np.full(n, -1), x, bad))
            if with_inverse:
                i, j = np.nonzero(np.tril(a != 0) | np.eye(n, dtype=bool))
                out.append((ids[i], ids[j], inverse[i, j], bad[i] | bad[j]))
        i, j, x, bad = (np.concatenate(v) for v in zip(*out))
        return pd.DataFrame({"row": names[i], "col": np.where(j < 0, None, names[j]), "value": x, "singular": bad})

    return solve


def _factor(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Solution and inverse with null directions held at zero; flags the parameters they involve."""
    scale = 1.0 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    scaled = a * scale[:, None] * scale[None, :]
    try:
        np.linalg.cholesky(scaled - NULL_PIVOT * np.eye(len(b)))
        inv = np.linalg.inv(scaled)
        bad = np.zeros(len(b), dtype=bool)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(scaled)
        null = values < NULL_PIVOT
        safe = np.where(null, 0.0, 1.0 / np.where(null, 1.0, values))
        inv = (vectors * safe) @ vectors.T
        bad = (vectors[:, null] ** 2).sum(axis=1) > 1e-8
    inverse = inv * scale[:, None] * scale[None, :]
    return inverse @ b, inverse, bad


def solve_small(matrix: DataFrame, rhs: DataFrame, comps: DataFrame, inverse: bool, limit: int) -> DataFrame:
    """Dense solution of every component within ``limit`` parameters; tiny ones share a task."""
    small = comps.filter(F.col("size") <= limit)
    # A component of n parameters holds at most n*n cells, so a bucket stays near PACK_ROWS or one component.
    totals = small.select("component", "size").distinct().agg(F.sum(F.col("size") * F.col("size"))).first()[0] or 0
    buckets = max(1, int(totals // PACK_ROWS) + 1)
    tagged = small.select("param", "component", "size").withColumn(
        "bucket",
        F.when(F.col("size") > PACK_SIZE, F.xxhash64("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(buckets))),
    )
    cells = matrix.select(F.col("row"), F.col("col"), "value").unionByName(
        rhs.select(F.col("param").alias("row"), F.lit(None).cast("string").alias("col"), F.col("b").alias("value"))
    )
    keyed = cells.join(tagged.withColumnRenamed("param", "row"), "row").select("bucket", "component", "row", "col", "value")
    return keyed.groupBy("bucket").applyInPandas(
        _dense_solver(inverse), "row string, col string, value double, singular boolean"
    )


def conjugate_gradients(
    matrix: DataFrame, rhs: DataFrame, tolerance: float = 1.0e-12, max_steps: int = 2000
) -> DataFrame:
    """Solve for several right-hand sides ``rhs(rhs_id, param, b)`` at once: ``(rhs_id, param, x)``.

    Preconditioned by the diagonal, in the form that needs one matrix product and one reduction per
    step (Chronopoulos and Gear, 1989). The matrix is laid out by column once; a step shuffles only
    vectors. Every step is cut to the checkpoint folder, so a lost executor repeats one step at most.
    The scalars that reach the driver are two per right-hand side; callers bound how many run together.
    """
    spark = matrix.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Summed where it is laid, in one shuffle; the cells it comes from are stored.
    laid = matrix.repartition(parts, "col").groupBy("row", "col").agg(F.sum("value").alias("value")).persist()
    diag = laid.filter("row = col").select(F.col("row").alias("param"), (1.0 / F.col("value")).alias("m"))

    def product(vectors: DataFrame) -> DataFrame:
        v = vectors.select("rhs_id", F.col("param").alias("col"), "u")
        return (
            laid.join(v, "col")
            .groupBy("rhs_id", F.col("row").alias("param"))
            .agg(F.sum(F.col("value") * F.col("u")).alias("w"))
        )

    def scalars(state: DataFrame) -> dict:
        rows = state.groupBy("rhs_id").agg(
            F.sum(F.col("r") * F.col("u")).alias("gamma"), F.sum(F.col("w") * F.col("u")).alias("delta")
        )
        return {r["rhs_id"]: (r["gamma"], r["delta"]) for r in rows.collect()}

    def lookup(values: dict) -> F.Column:
        keys = list(values)
        return F.element_at(F.create_map(*[c for k in keys for c in (F.lit(k), F.lit(float(values[k])))]), F.col("rhs_id"))

    ids = [r["rhs_id"] for r in rhs.select("rhs_id").distinct().collect()]
    state = diag.withColumn("rhs_id", F.explode(F.array(*[F.lit(i).cast("long") for i in ids])))
    state = (
        state.join(rhs, ["rhs_id", "param"], "left")
        .select("rhs_id", "param", "m", F.coalesce("b", F.lit(0.0)).alias("r"))
        .withColumn("u", F.col("m") * F.col("r"))
    )
    zero = F.lit(0.0)
    state = state.join(product(state), ["rhs_id", "param"], "left").select(
        "rhs_id", "param", "m", zero.alias("x"), "r", zero.alias("p"), zero.alias("s"), "u", F.coalesce("w", zero).alias("w")
    )
    state = cut(state)
    first = scalars(state)
    now = first
    alpha = {i: (g / d if d > 0 else 0.0) for i, (g, d) in now.items()}
    beta = {i: 0.0 for i in now}
    for _ in range(max_steps):
        if all(now[i][0] <= tolerance * tolerance * max(first[i][0], 1e-300) for i in now):
            break
        a, b = lookup(alpha), lookup(beta)
        step = state.select(
            "rhs_id", "param", "m",
            (F.col("u") + b * F.col("p")).alias("p"),
            (F.col("w") + b * F.col("s")).alias("s"),
            "x", "r",
        )
        step = step.select(
            "rhs_id", "param", "m", "p", "s",
            (F.col("x") + a * F.col("p")).alias("x"),
            (F.col("r") - a * F.col("s")).alias("r"),
        ).withColumn("u", F.col("m") * F.col("r"))
        state = cut(
            step.join(product(step), ["rhs_id", "param"], "left").withColumn("w", F.coalesce("w", zero))
        )
        before, now = now, scalars(state)
        for i, (gamma, delta) in now.items():
            old = before[i][0]
            beta[i] = gamma / old if old > 0 else 0.0
            denominator = delta - beta[i] * gamma / alpha[i] if alpha[i] else 0.0
            alpha[i] = gamma / denominator if denominator > 0 else 0.0
    else:
        raise RuntimeError("conjugate gradients did not settle")
    laid.unpersist()
    return state.select("rhs_id", "param", "x")


def solve(
    matrix: DataFrame, rhs: DataFrame, limit: int = DENSE_LIMIT, tolerance: float = 1.0e-12,
    comps: DataFrame | None = None, stored: bool = False, direct: bool = True, kept: dict | None = None,
) -> DataFrame:
    """``(param, x, singular)`` of the normal equations, component by component.

    Components above ``limit`` are solved by :func:`~cairn.operators.dissect.dissect` if they are sparse and their fronts
    are small, which suits long thin networks; else (or with ``direct`` off) by conjugate gradients, where ``singular`` is
    null as solving does not tell; :func:`singular_parameters` does. ``stored`` says that the cells already lie in the
    checkpoint folder; ``comps`` hands in the components of an earlier solution over the same graph, and ``kept`` carries the
    order of its elimination from one call to the next.
    """
    if not stored:
        matrix, rhs = cut(matrix), cut(rhs)
    if comps is None:
        comps = store(components_of(matrix))
    dense = solve_small(matrix, rhs, comps, False, limit)
    out = dense.select(F.col("row").alias("param"), F.col("value").alias("x"), "singular")
    large = comps.filter(F.col("size") > limit).select("param")
    if large.limit(1).count():
        part = matrix.join(large.withColumnRenamed("param", "row"), "row")
        b = rhs.join(large, "param")
        kept = {} if kept is None else kept
        split = dissect(part, b, inverse=False, sparse=SPARSE_CELLS, plan=kept.get("plan")) if direct else None
        if split is not None:
            kept["plan"] = split.plan
            return out.unionByName(split.solution)
        cg = conjugate_gradients(part, b.withColumn("rhs_id", F.lit(0).cast("long")), tolerance)
        out = out.unionByName(cg.select("param", "x", F.lit(None).cast("boolean").alias("singular")))
    return out


def singular_parameters(matrix: DataFrame, limit: int = DENSE_LIMIT, seen: float = 1.0e-3) -> DataFrame:
    """``param`` of every parameter that the equations do not determine, in components of any size.

    Small components are factored. In a large one a random vector is multiplied by the matrix and solved for
    again: what does not come back lies in a null direction, and the parameters in which more than ``seen`` of a
    standard deviation is missing are the undetermined ones. Parameters with nothing on the diagonal are too.
    """
    matrix = cut(matrix.groupBy("row", "col").agg(F.sum("value").alias("value")))
    comps = store(components_of(matrix))
    diag = matrix.filter("row = col").select(F.col("row").alias("param"), F.col("value").alias("d"))
    zero = diag.select("param", F.lit(0.0).alias("b"))
    out = solve_small(matrix, zero, comps, False, limit).filter("singular").select(F.col("row").alias("param"))
    large = diag.join(comps.filter(F.col("size") > limit).select("param"), "param")
    if large.limit(1).count():
        out = out.unionByName(large.filter("d <= 0").select("param"))
        # Normal deviates from a hash of the name (Box and Muller 1958), the same in every run.
        share = lambda salt: (F.pmod(F.xxhash64("param", F.lit(salt)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
        normal = F.sqrt(-2.0 * F.ln(share(1))) * F.cos(2.0 * math.pi * share(2))
        probe = cut(large.filter("d > 0").select("param", "d", (normal / F.sqrt("d")).alias("v")))
        part = cut(matrix.join(probe.select(F.col("param").alias("row")), "row", "left_semi").join(probe.select(F.col("param").alias("col")), "col", "left_semi"))
        b = part.join(probe.select(F.col("param").alias("col"), "v"), "col").groupBy(F.col("row").alias("param")).agg(F.sum(F.col("value") * F.col("v")).alias("b"))
        back = conjugate_gradients(part, b.withColumn("rhs_id", F.lit(0).cast("long"))).select("param", "x")
        missing = F.abs(F.col("v") - F.col("x")) * F.sqrt("d")
        out = out.unionByName(probe.join(back, "param").filter(missing > seen).select("param"))
    return out


def inverse_cells(
    matrix: DataFrame, wanted: DataFrame | None = None, limit: int = DENSE_LIMIT, batch: int = 96, direct: bool = True
) -> DataFrame:
    """Cells ``(row, col, value)`` of the inverse.

    Small components give their stored cells, and any ``wanted(row, col)`` pair, from one dense inverse.
    Large ones give theirs by selected inversion over their separators. Only where those are too large (or with ``direct``
    off) are unit vectors of the wanted columns solved for, ``batch`` at a time. Wanted pairs with ends in
    different components are zero; those that name no parameter of the matrix are left out.
    """
    matrix = cut(matrix)
    comps = store(components_of(matrix))
    zero = matrix.filter("row = col").select(F.col("row").alias("param"), F.lit(0.0).alias("b"))
    pairs = matrix.select("row", "col")
    apart = None
    if wanted is not None:
        part_of = lambda end: comps.select(F.col("param").alias(end), F.col("component").alias(f"_{end}"))
        placed = cut(wanted.select("row", "col").distinct().join(part_of("row"), "row").join(part_of("col"), "col"))
        apart = placed.filter("_row <> _col").select(F.greatest("row", "col").alias("row"), F.least("row", "col").alias("col"), F.lit(0.0).alias("value"))
        wanted = placed.filter("_row = _col").select("row", "col")
        pairs = pairs.unionByName(wanted.select("row", "col")).distinct()
        # A wanted pair outside the stored cells enters as an explicit zero so that it is returned.
        matrix_w = matrix.unionByName(wanted.select("row", "col", F.lit(1e-300).alias("value")))
        matrix_w = matrix_w.unionByName(wanted.select(F.col("col").alias("row"), F.col("row").alias("col"), F.lit(1e-300).alias("value")))
    else:
        matrix_w = matrix
    dense = solve_small(matrix_w, zero, comps, True, limit).filter(F.col("col").isNotNull())
    out = dense.select(F.greatest("row", "col").alias("row"), F.least("row", "col").alias("col"), "value")
    large = comps.filter(F.col("size") > limit).select("param")
    if large.limit(1).count():
        part = cut(matrix.join(large.withColumnRenamed("param", "row"), "row"))
        split = dissect(part, wanted=wanted) if direct else None
        if split is not None:
            out = out.unionByName(split.cells.select(F.greatest("row", "col").alias("row"), F.least("row", "col").alias("col"), "value"))
            return (out if apart is None else out.unionByName(apart)).dropDuplicates(["row", "col"])
        from cairn.plans.ordered import number_rows

        need = pairs.join(large.withColumnRenamed("param", "row"), "row").select(
            F.greatest("row", "col").alias("row"), F.least("row", "col").alias("col")
        ).distinct()
        columns = cut(number_rows(need.select("col").distinct(), ["col"], "rhs_id"))
        total = columns.count()
        for start in range(0, total, batch):
            some = columns.filter(F.col("rhs_id").between(start, start + batch - 1))
            unit = some.select("rhs_id", F.col("col").alias("param"), F.lit(1.0).alias("b"))
            x = conjugate_gradients(part, unit, 1e-10)
            cells = (
                x.join(F.broadcast(some), "rhs_id")
                .select(F.col("param").alias("row"), "col", F.col("x").alias("value"))
                .join(need, ["row", "col"], "left_semi")
            )
            out = out.unionByName(cells)
    if apart is not None:
        out = out.unionByName(apart)
    return out.dropDuplicates(["row", "col"])


def singular_report(solution: DataFrame) -> DataFrame:
    """Parameters the equations do not determine, by station or name and axis."""
    parts = F.split("param", r"\|")
    return solution.filter("singular").select(
        "param", F.element_at(parts, 1).alias("name"), F.element_at(parts, -1).alias("axis")
    )
