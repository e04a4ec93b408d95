"""Normal equations from design rows.

Equations are rows with ``misclosure``, ``weight`` and
``design array<struct<param, coef>>``. Products are formed inside the row and
summed by cell within Arrow batches, so the only shuffle is the summing by cell
of what is left: an unknown every observation shares is summed on the map side first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.lineage import cut

BATCH_PRODUCTS = 2_000_000  # products that a task holds before it sums them
SET_SLICE = 64  # sets that a task holds as Python objects at a time
RHS = "="  # stands for the right-hand side among the parameter names; sorts before any code used


def merge_parameters(equations: DataFrame, links: DataFrame) -> DataFrame:
    """Replace tied parameters by the one they are tied to, following ``links(param, same_as)``."""
    from cairn.operators.graph import connected_components

    groups = connected_components(links.select(F.col("param").alias("a"), F.col("same_as").alias("b")))
    # Written once, so both sides of the join back see the same numbers.
    flat = cut(equations.withColumn("_eq", F.monotonically_increasing_id()))
    terms = flat.select("_eq", F.explode_outer("design").alias("_t")).select("_eq", "_t.param", "_t.coef")
    terms = terms.filter("param IS NOT NULL")
    terms = terms.join(groups, F.col("param") == F.col("node"), "left").groupBy(
        "_eq", F.coalesce("component", "param").alias("param")
    ).agg(F.sum("coef").alias("coef"))
    packed = terms.groupBy("_eq").agg(F.collect_list(F.struct("param", "coef")).alias("design"))
    return flat.drop("design").join(packed, "_eq", "left").drop("_eq")


def eliminate_set_unknowns(
    equations: DataFrame, set_id: str = "set_id", coef: str = "set_coef", limit: int = 400
) -> DataFrame:
    """Remove each set's own unknown (orientation or scale) from its equations.

    A set's weighted sum, taken with negative weight, downdates the normal equations; its products
    fill a block over the whole set. Sets with more than ``limit`` terms would fill too much, so they
    keep their unknown as a parameter of its own, which gives the same solution. A row without a set has an
    unknown to itself, which takes up all it says: it adds nothing.
    """
    equations = equations.filter(F.col(set_id).isNotNull() | F.col(coef).isNull() | (F.col(coef) == 0.0))
    grouped = equations.filter(F.col(coef).isNotNull() & (F.col(coef) != 0.0))
    sizes = grouped.groupBy(set_id).agg(
        F.sum(F.size("design")).alias("_terms"),
        F.sum(F.col("weight") * F.col(coef) * F.col(coef)).alias("_ss"),
        F.sum(F.col("weight") * F.col(coef) * F.col("misclosure")).alias("_sv"),
    )
    small = sizes.filter(F.col("_terms") <= limit)
    terms = (
        grouped.join(small.select(set_id), set_id, "left_semi")
        .select(set_id, (F.col("weight") * F.col(coef)).alias("_w"), F.explode_outer("design").alias("_t"))
        .filter("_t IS NOT NULL")
        .groupBy(set_id, F.col("_t.param").alias("param"))
        .agg(F.sum(F.col("_w") * F.col("_t.coef")).alias("coef"))
    )
    packed = terms.groupBy(set_id).agg(F.collect_list(F.struct("param", "coef")).alias("design"))
    downdate = small.join(packed, set_id, "left").select(
        set_id,
        F.col("_sv").alias("misclosure"),
        (-1.0 / F.col("_ss")).alias("weight"),
        F.coalesce("design", F.array().cast("array<struct<param:string,coef:double>>")).alias("design"),
    )
    big = sizes.filter(F.col("_terms") > limit).select(set_id, F.lit(True).alias("_big"))
    kept = equations.join(big, set_id, "left").withColumn(
        "design",
        F.when(
            F.col("_big") & F.col(coef).isNotNull(),
            F.concat(
                "design",
                F.array(
                    F.struct(
                        F.concat(F.lit("set|"), F.col(set_id)).alias("param"), F.col(coef).cast("double").alias("coef")
                    )
                ),
            ),
        ).otherwise(F.col("design")),
    )
    return kept.select(set_id, "misclosure", "weight", "design").unionByName(downdate)


def set_unknown_values(
    equations: DataFrame, solution: DataFrame | None = None, set_id: str = "set_id", coef: str = "set_coef"
) -> DataFrame:
    """Each set's implicit unknown: its weighted mean misclosure after the solution is taken off, with its a-priori variance.

    Rows without a set are sets by themselves, named by their ``obs_key`` where there is one.
    """
    rows = equations.filter(F.col(coef).isNotNull())
    if "obs_key" in rows.columns:
        rows = rows.withColumn(set_id, F.coalesce(set_id, F.col("obs_key").cast("string")))
    left = F.col("misclosure")
    if solution is not None:
        rows = cut(rows.withColumn("_eq", F.monotonically_increasing_id()))
        moved = (
            rows.select("_eq", F.explode_outer("design").alias("_t"))
            .join(solution, F.col("_t.param") == F.col("param"))
            .groupBy("_eq")
            .agg(F.sum(F.col("_t.coef") * F.col("x")).alias("_m"))
        )
        rows = rows.join(moved, "_eq", "left")
        left = left - F.coalesce("_m", F.lit(0.0))
    ss = F.sum(F.col("weight") * F.col(coef) * F.col(coef))
    return rows.groupBy(set_id).agg(
        (F.sum(F.col("weight") * F.col(coef) * left) / ss).alias("set_value"),
        (1.0 / ss).alias("set_variance"),
        F.count("*").alias("n"),
    )


_TERMS = "array<struct<param:string,coef:double>>"


def _set_sums(equations: DataFrame, set_id: str) -> tuple[DataFrame, DataFrame]:
    """Per set the normal equations of its own unknowns ``(names, n, b)``, and their cells with other parameters."""
    rows = equations.filter(F.col(set_id).isNotNull() & (F.size("set_design") > 0))
    pairs = rows.select(set_id, "weight", "misclosure", "set_design", F.explode("set_design").alias("a"))
    weighted = F.col("weight") * F.col("a.coef")
    right = pairs.groupBy(set_id, F.col("a.param").alias("name")).agg(F.sum(weighted * F.col("misclosure")).alias("b"))
    own = pairs.select(set_id, F.col("a.param").alias("name"), weighted.alias("w"), F.explode("set_design").alias("c")).groupBy(
        set_id, "name", F.col("c.param").alias("other")
    ).agg(F.sum(F.col("w") * F.col("c.coef")).alias("n"))
    line = own.groupBy(set_id, "name").agg(F.collect_list(F.struct("other", "n")).alias("line"))
    square = line.join(right, [set_id, "name"]).groupBy(set_id).agg(F.array_sort(F.collect_list(F.struct("name", "b", "line"))).alias("own"))
    cross = rows.select(set_id, "weight", "set_design", F.explode("design").alias("t")).select(
        set_id, "t", F.explode("set_design").alias("a"), "weight"
    ).groupBy(set_id, F.col("t.param").alias("param"), F.col("a.param").alias("name")).agg(F.sum(F.col("weight") * F.col("a.coef") * F.col("t.coef")).alias("n"))
    return square, cross


def _square(own) -> tuple[list[str], np.ndarray, np.ndarray]:
    names = [r["name"] for r in own]
    at = {name: k for k, name in enumerate(names)}
    n = np.zeros((len(names), len(names)))
    for k, r in enumerate(own):
        for cell in r["line"]:
            n[k, at[cell["other"]]] = cell["n"]
    return names, (n + n.T) / 2.0, np.array([r["b"] for r in own])


def _root(n: np.ndarray) -> np.ndarray:
    """R with R'R the inverse of ``n``; directions that the set does not see are left out."""
    scale = 1.0 / np.sqrt(np.maximum(np.diag(n), 1e-300))
    values, vectors = np.linalg.eigh(n * scale[:, None] * scale[None, :])
    seen = values > 1.0e-12
    return (vectors[:, seen] / np.sqrt(values[seen])).T * scale[None, :]


def _by_slices(fn):
    """``fn`` over Arrow batches a few sets at a time, as a whole batch of them is far larger in Python objects."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SET_SLICE):
                yield fn(batch.slice(start, SET_SLICE))

    return run


def eliminate_set_blocks(equations: DataFrame, set_id: str = "set_id", limit: int = 400) -> DataFrame:
    """Remove several unknowns per set, those in ``set_design array<struct<param, coef>>``, from its equations.

    With N their own normal equations in the set and R'R = 1 / N, the rows of R times their cells with the other parameters, taken
    with weight -1, downdate the normal equations. Sets with more than ``limit`` other parameters keep
    their unknowns as parameters ``set|<set>|<name>`` of their own, with the same solution. Rows without a set have no such unknowns.
    """
    square, cross = _set_sums(equations, set_id)
    cross = cut(cross)
    sizes = cross.groupBy(set_id).agg(F.count_distinct("param").alias("_n"))
    big = sizes.filter(F.col("_n") > limit).select(set_id, F.lit(True).alias("_big"))
    terms = cross.groupBy(set_id, "param").agg(F.collect_list(F.struct("name", "n")).alias("c")).groupBy(set_id).agg(F.collect_list(F.struct("param", "c")).alias("terms"))
    small = square.join(big, set_id, "left_anti").join(terms.join(big, set_id, "left_anti"), set_id, "left")

    def downdate(batch):
        rights, params, coefs, size, owners = [], [], [], [0], []
        for at_row, (own, found) in enumerate(zip(batch.column("own").to_pylist(), batch.column("terms").to_pylist())):
            names, n, b = _square(own)
            at, root = {name: k for k, name in enumerate(names)}, _root(n)
            found = found if found is not None else []
            cells = np.zeros((len(names), len(found)))
            for j, f in enumerate(found):
                for c in f["c"]:
                    cells[at[c["name"]], j] = c["n"]
            left, named = root @ cells, [f["param"] for f in found]
            rights.extend(root @ b)
            for line in left:
                params.extend(named)
                coefs.append(line)
                size.append(len(named))
                owners.append(at_row)
        terms = pa.StructArray.from_arrays([pa.array(params, pa.string()), pa.array(np.concatenate([np.zeros(0), *coefs]))], names=["param", "coef"])
        design = pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), terms)
        sets = batch.column(set_id).take(pa.array(owners, pa.int32()))
        return pa.RecordBatch.from_arrays([sets, pa.array(rights, pa.float64()), design], names=[set_id, "misclosure", "design"])

    kind = equations.schema[set_id].dataType.simpleString()
    made = small.select(set_id, "own", "terms").mapInArrow(_by_slices(downdate), f"`{set_id}` {kind}, misclosure double, design {_TERMS}")
    less = made.select(set_id, "misclosure", F.lit(-1.0).alias("weight"), "design")
    named = F.transform("set_design", lambda t: F.struct(F.concat(F.lit("set|"), F.col(set_id), F.lit("|"), t["param"]).alias("param"), t["coef"].cast("double").alias("coef")))
    kept = equations.join(big, set_id, "left").withColumn("design", F.when(F.col("_big") & (F.size("set_design") > 0), F.concat(F.col("design").cast(_TERMS), named)).otherwise(F.col("design").cast(_TERMS)))
    return kept.select(set_id, "misclosure", "weight", "design").unionByName(less)


def set_block_values(equations: DataFrame, solution: DataFrame, set_id: str = "set_id") -> DataFrame:
    """``(set_id, name, value, variance)`` of the unknowns of each set, from the solution for the others; variances a priori."""
    square, cross = _set_sums(equations, set_id)
    moved = cross.join(solution.select("param", "x"), "param").groupBy(set_id, "name").agg(F.sum(F.col("n") * F.col("x")).alias("m"))
    taken = moved.groupBy(set_id).agg(F.collect_list(F.struct("name", "m")).alias("taken"))

    def values(batch):
        found, owners = {"name": [], "value": [], "variance": []}, []
        for at_row, (own, taken) in enumerate(zip(batch.column("own").to_pylist(), batch.column("taken").to_pylist())):
            names, n, b = _square(own)
            at, root = {name: k for k, name in enumerate(names)}, _root(n)
            for t in taken if taken is not None else []:
                b[at[t["name"]]] -= t["m"]
            inverse = root.T @ root
            found["name"].extend(names)
            found["value"].extend(inverse @ b)
            found["variance"].extend(np.diag(inverse))
            owners.extend([at_row] * len(names))
        sets = batch.column(set_id).take(pa.array(owners, pa.int32()))
        return pa.RecordBatch.from_arrays(
            [sets, pa.array(found["name"], pa.string()), pa.array(found["value"], pa.float64()), pa.array(found["variance"], pa.float64())], names=[set_id, *found]
        )

    kind = equations.schema[set_id].dataType.simpleString()
    return square.join(taken, set_id, "left").select(set_id, "own", "taken").mapInArrow(
        _by_slices(values), f"`{set_id}` {kind}, name string, value double, variance double"
    )


def _bordered(batch: pa.RecordBatch) -> tuple:
    """Names in order, and per equation its terms with the right-hand side first: numbers of the names (-1 where there is none), coefficients, which are given."""
    design = batch.column("design")
    param, coef = design.flatten().flatten()
    coded = pa.concat_arrays([pa.array([RHS], param.type), param]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order) + 1, np.int64)
    place[order], place[-1] = np.arange(len(order)), -1
    number = place[pc.fill_null(coded.indices, len(order)).to_numpy()]
    some = ~np.asarray(design.is_null())
    length = pc.fill_null(pc.list_value_length(design), 0).to_numpy()[some].astype(np.int64) + 1
    first = np.cumsum(length) - length
    inner = np.ones(length.sum(), bool)
    inner[first] = False
    names, value, given = np.full(len(inner), number[0]), np.empty(len(inner)), np.ones(len(inner), bool)
    misclosure = batch.column("misclosure")
    for at, column in ((first, misclosure.filter(pa.array(some))), (inner, coef)):
        value[at], given[at] = column.to_numpy(zero_copy_only=False), ~np.asarray(column.is_null())
    names[inner] = number[1:]
    return coded.dictionary.take(pa.array(order)), names, value, given, first, length, some


def _summed(names: pa.Array, keys: list, values: list, given: list) -> pa.RecordBatch:
    """The cells of some equations, each once; one without a given product is null."""
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    value, known = np.concatenate(values), np.concatenate(given)
    total = np.bincount(at[known], value[known], len(key))
    empty = np.bincount(at[known], minlength=len(key)) == 0
    row, col = (names.take(pa.array(k)) for k in (key // len(names), key % len(names)))
    return pa.RecordBatch.from_arrays([row, col, pa.array(total, pa.float64(), mask=empty)], names=["row", "col", "value"])


def _products(batches):
    """Products of the terms of each equation, summed by cell within a batch."""
    for batch in batches:
        names, number, value, given, first, length, some = _bordered(batch)
        if not some.all():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64())], names=["row", "col", "value"])
        scale = batch.column("weight").filter(pa.array(some))
        weight, weighed = scale.to_numpy(zero_copy_only=False).astype(float), ~np.asarray(scale.is_null())
        keys, values, known, held = [], [], [], 0
        for n in np.unique(length):
            ones = np.flatnonzero(length == n)
            step = max(1, BATCH_PRODUCTS // int(n * n))
            for start in range(0, len(ones), step):
                eq = ones[start : start + step]
                at = first[eq][:, None] + np.arange(n)
                a, v, g = number[at], value[at], given[at] & weighed[eq][:, None]
                keep = (a[:, None, :] >= a[:, :, None]) & (a[:, :, None] >= 0)
                keys.append((a[:, :, None] * len(names) + a[:, None, :])[keep])
                values.append((weight[eq][:, None, None] * v[:, :, None] * v[:, None, :])[keep])
                known.append((g[:, :, None] & g[:, None, :])[keep])
                held += len(keys[-1])
                if held >= BATCH_PRODUCTS:
                    yield _summed(names, keys, values, known)
                    keys, values, known, held = [], [], [], 0
        if held:
            yield _summed(names, keys, values, known)


def normal_cells(equations: DataFrame) -> DataFrame:
    """Lower triangle of the normal matrix bordered by its right-hand side: ``(row, col, value)``.

    Cells of row ``=`` are the right-hand side; cell ``(=, =)`` is the weighted square sum of the misclosures.
    """
    rows = equations.select(F.col("misclosure").cast("double").alias("misclosure"), F.col("weight").cast("double").alias("weight"), F.col("design").cast(_TERMS).alias("design"))
    return rows.mapInArrow(_products, "row string, col string, value double").groupBy("row", "col").agg(F.sum("value").alias("value"))


def split_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matrix cells (both triangles), right-hand side and the weighted square sum."""
    lower = cells.filter((F.col("row") != RHS) & (F.col("col") != RHS))
    matrix = lower.unionAll(lower.filter("row <> col").select(F.col("col"), F.col("row"), F.col("value")))
    rhs = cells.filter((F.col("row") == RHS) & (F.col("col") != RHS)).select(
        F.col("col").alias("param"), F.col("value").alias("b")
    )
    vwv = cells.filter((F.col("row") == RHS) & (F.col("col") == RHS)).select(F.col("value").alias("vwv"))
    return matrix, rhs, vwv
