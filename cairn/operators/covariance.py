"""Covariances of GNSS vectors: input forms, defaults, set blocks and whitening."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.ellipsoid import LOWER, enu_axes, rotate_covariance
from cairn.plans.lineage import cut, ensure_checkpoint_dir, store
from cairn.plans.settle import settle
from cairn.plans.skew import salted_join

SET_LIMIT = 400
TILE = 64
CHUNK = 128
SALTS = 16
CALL_BLOCKS = 20_000  # covariance blocks of the sets that share a call
STACK_CELLS = 2_000_000  # numbers in the matrices that are factored together


def _six(cov: Column) -> list[Column]:
    return [F.element_at(cov, i + 1) for i in range(6)]


def from_diagonal(errors: Column) -> Column:
    """Covariance of three uncorrelated X, Y, Z standard errors."""
    e = [F.element_at(errors, i + 1) for i in range(3)]
    z = F.lit(0.0)
    return F.array(e[0] * e[0], z, e[1] * e[1], z, z, e[2] * e[2])


def from_correlation(secorr: Column) -> Column:
    """Covariance of a lower triangle holding standard errors on its diagonal and correlations off it."""
    c = _six(secorr)
    return F.array(c[0] ** 2, c[1] * c[0] * c[2], c[2] ** 2, c[3] * c[0] * c[5], c[4] * c[2] * c[5], c[5] ** 2)


def from_topocentric(secorr: Column, lon: Column, lat: Column, correlated: bool = False) -> Column:
    """X, Y, Z covariance of east, north, up errors (with correlations if ``correlated``) at a position."""
    c = _six(secorr)
    zero = F.lit(0.0)
    off = [c[1] * c[0] * c[2], c[3] * c[0] * c[5], c[4] * c[2] * c[5]] if correlated else [zero] * 3
    local = [c[0] ** 2, off[0], c[2] ** 2, off[1], off[2], c[5] ** 2]
    return F.array(*rotate_covariance(local, enu_axes(lon, lat), transpose=True))


def to_topocentric(cov: Column, lon: Column, lat: Column) -> Column:
    return F.array(*rotate_covariance(_six(cov), enu_axes(lon, lat)))


def default_covariance(length: Column, lon: Column, lat: Column, mm: Sequence[float], ppm: Sequence[float]) -> Column:
    """Covariance of a vector from east, north, up errors in millimetres and parts per million of its length."""
    zero = F.lit(0.0)
    var = [F.lit(m * m * 1.0e-6) + length * length * (p * p * 1.0e-12) for m, p in zip(mm, ppm)]
    return F.array(*rotate_covariance([var[0], zero, var[1], zero, zero, var[2]], enu_axes(lon, lat), transpose=True))


def _length(v: Column, w: Column | None = None) -> Column:
    total = F.lit(0.0)
    for i in (1, 2, 3):
        d = F.element_at(v, i) - (F.element_at(w, i) if w is not None else F.lit(0.0))
        total = total + d * d
    return F.sqrt(total)


def default_set_blocks(
    vectors: DataFrame, mm: Sequence[float], ppm: Sequence[float], set_id: str = "set_id", member: str = "i"
) -> DataFrame:
    """Blocks ``(set_id, i, j, cov)`` with ``i <= j`` of sets observed together, so that every derived vector also has the default errors.

    Off-diagonal blocks are ``(C_i + C_j - C_ij) / 2``. ``vectors(set_id, i, vec, lon, lat)`` take their axes from the mean
    of the positions involved. The blocks are the set's covariance matrix, and their join is salted by set.
    """
    # Written once, as both sides of the join and the count of its hot sets read them.
    vectors = store(vectors.select(set_id, member, "vec", "lon", "lat"))
    own = vectors.withColumn("_c", default_covariance(_length(F.col("vec")), F.col("lon"), F.col("lat"), mm, ppm))
    left = own.select(set_id, F.col(member).alias("i"), F.col("vec").alias("_vi"), F.col("_c").alias("_ci"), F.col("lon").alias("_loi"), F.col("lat").alias("_lai"))
    right = own.select(set_id, F.col(member).alias("j"), F.col("vec").alias("_vj"), F.col("_c").alias("_cj"), F.col("lon").alias("_loj"), F.col("lat").alias("_laj"))
    both = salted_join(left, right, [set_id], ["i"]).filter("i <= j")
    mid_lon, mid_lat = (F.col("_loi") + F.col("_loj")) / 2.0, (F.col("_lai") + F.col("_laj")) / 2.0
    # The length and the axes are met dozens of times in a block, the block itself by whoever takes it apart.
    both = settle(both.withColumns({"_length": _length(F.col("_vi"), F.col("_vj")), "_lon": mid_lon, "_lat": mid_lat}), ["_length", "_lon", "_lat"])
    between = default_covariance(F.col("_length"), F.col("_lon"), F.col("_lat"), mm, ppm)
    both = settle(both.withColumn("_between", between).select(set_id, "i", "j", "_ci", "_cj", "_between"), ["_between"])
    mixed = F.array(*[(a + b - d) / 2.0 for a, b, d in zip(_six(F.col("_ci")), _six(F.col("_cj")), _six(F.col("_between")))])
    return settle(both.select(set_id, "i", "j", F.when(F.col("i") == F.col("j"), F.col("_ci")).otherwise(mixed).alias("cov")), ["cov"])


def default_point_blocks(
    points: DataFrame, absolute: Sequence[float], mm: Sequence[float], ppm: Sequence[float], set_id: str = "set_id", member: str = "i"
) -> DataFrame:
    """The same for sets of points: ``absolute`` errors on the diagonal, length-dependent covariances off it."""
    left = points.select(set_id, F.col(member).alias("i"), F.col("vec").alias("_vi"), F.col("lon").alias("_lo"), F.col("lat").alias("_la"))
    right = points.select(set_id, F.col(member).alias("j"), F.col("vec").alias("_vj"))
    both = salted_join(left, right, [set_id], ["i"]).filter("i >= j")
    zero = [0.0, 0.0, 0.0]
    own = default_covariance(F.lit(0.0), F.col("_lo"), F.col("_la"), absolute, zero)
    off = default_covariance(_length(F.col("_vi"), F.col("_vj")), F.col("_lo"), F.col("_la"), mm, ppm)
    return both.select(set_id, F.col("j").alias("i"), F.col("i").alias("j"), F.when(F.col("i") == F.col("j"), own).otherwise(off).alias("cov"))


def whiten_sets(rows: DataFrame, blocks: DataFrame, set_id: str = "set_id", limit: int = SET_LIMIT, tile: int = TILE) -> DataFrame:
    """Equations of sets with a full covariance multiplied by its inverse Cholesky factor: unit weight, uncorrelated.

    ``rows(set_id, i, component, misclosure, design)`` and ``blocks(set_id, i, j, cov)`` with ``i <= j``. A set of up to
    ``limit`` members is one matrix in one task; a larger one is factored in tiles of ``tile`` members (``whiten_tiled``),
    with the same equations. Without rows the result is empty.
    """
    r = rows.select(F.col(set_id).alias("_set"), "i", F.col("component").cast("int").alias("component"), "misclosure", F.col("design").cast(TERMS).alias("design"))
    b = blocks.select(F.col(set_id).alias("_key"), "i", "j", "cov")
    members = store(r.groupBy("_set").agg(F.count_distinct("i").alias("_n")))
    n = F.col("_n")
    blocks = members.agg(F.sum(F.when(n <= limit, n * (n + 1) / 2)).cast("long")).first()[0] or 0
    large = cut(members.filter(n > limit).select(F.col("_set").alias("_large")))
    if large.isEmpty():
        return _whiten_dense(r, b, set_id, blocks)
    in_r, in_b = F.col("_set").eqNullSafe(F.col("_large")), F.col("_key").eqNullSafe(F.col("_large"))
    small = _whiten_dense(r.join(large, in_r, "left_anti"), b.join(large, in_b, "left_anti"), set_id, blocks)
    return small.unionByName(whiten_tiled(r.join(large, in_r, "left_semi"), b.join(large, in_b, "left_semi"), set_id, tile))


TERMS = "array<struct<param:string,coef:double>>"


def _codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Both columns as numbers of one dictionary, in which a missing value has a number too."""
    coded = pa.concat_arrays([c for side in (left, right.cast(left.type)) for c in side.chunks] or [pa.array([], left.type)]).dictionary_encode("encode")
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers[: len(left)], numbers[len(left) :], coded.dictionary


def _known(keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Places of ``keys`` among the sorted ``seen``, all of which have to be there."""
    at = np.minimum(np.searchsorted(seen, keys), max(len(seen) - 1, 0))
    if len(keys) and (not len(seen) or (seen[at] != keys).any()):
        raise KeyError("a set has covariances of members without equations")
    return at


def _whitener(set_id: str):
    """The sets of a bucket: those with equally many members are factored together, as one stack of matrices."""

    def whiten(left: pa.Table, right: pa.Table) -> pa.Table:
        if left["i"].null_count or left["component"].null_count or left["design"].null_count:
            raise ValueError("equations of a set lack member, component or design")
        of_row, of_block, sets = _codes(left["_set"], right["_key"])
        numbers, rank = np.unique(left["i"].to_numpy(), return_inverse=True)
        width = max(len(numbers), 1)
        members = np.unique(of_row * width + rank)
        owner = members // width
        size = np.bincount(owner, minlength=len(sets))
        place = np.arange(len(members)) - np.searchsorted(owner, owner)
        row = 3 * place[np.searchsorted(members, of_row * width + rank)] + left["component"].to_numpy()
        ends = [place[_known(of_block * width + _known(right[c].to_numpy(), numbers), members)] for c in ("i", "j")]
        cov = right["cov"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(of_block), len(LOWER))

        design = left["design"].combine_chunks()
        term_row = np.repeat(np.arange(len(of_row)), pc.list_value_length(design).to_numpy(zero_copy_only=False))
        param, coef = design.flatten().flatten()
        if param.null_count:
            raise ValueError("equations of a set have terms without a name")
        coded = param.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        by_name = np.empty(len(order), np.int64)
        by_name[order] = np.arange(len(order))
        names, wide = coded.dictionary.take(pa.array(order)), max(len(order), 1)
        of_term = of_row[term_row]
        key = of_term * wide + by_name[coded.indices.to_numpy()]
        columns = np.unique(key)
        column_owner = columns // wide
        column_at = np.arange(len(columns)) - np.searchsorted(column_owner, column_owner)
        column = column_at[np.searchsorted(columns, key)]
        breadth = np.bincount(column_owner, minlength=len(sets))

        # Stacks of sets with as many members, each of a bounded size.
        stack, slot, shapes, fill = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), [], STACK_CELLS
        for one in np.lexsort((breadth, size)):
            n, m = 3 * int(size[one]), int(breadth[one])
            if not shapes or shapes[-1][0] != n or (fill + 1) * n * (n + m + 1) > STACK_CELLS:
                shapes.append([n, m, []])
                fill = 0
            shapes[-1][1] = m
            shapes[-1][2].append(one)
            stack[one], slot[one], fill = len(shapes) - 1, fill, fill + 1

        def dealt(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            by = np.argsort(stack[of], kind="stable")
            return by, np.searchsorted(stack[of][by], np.arange(len(shapes) + 1))

        misclosure, value = left["misclosure"].to_numpy(), coef.to_numpy(zero_copy_only=False)
        rows, blocks, terms, heads = dealt(of_row), dealt(of_block), dealt(of_term), dealt(column_owner)
        part = lambda pair, k: pair[0][pair[1][k] : pair[1][k + 1]]
        out: dict[str, list] = {"set": [], "i": [], "component": [], "misclosure": [], "length": [], "param": [], "coef": []}
        for k, (n, m, ones) in enumerate(shapes):
            full, raw = np.zeros((len(ones), n, n)), np.zeros((len(ones), n, m + 1))
            at = part(blocks, k)
            s, p, q = slot[of_block[at]], 3 * ends[0][at], 3 * ends[1][at]
            for v, (a, c) in zip(cov[at].T, LOWER):
                full[s, p + a, q + c] = full[s, p + c, q + a] = v
                full[s, q + c, p + a] = full[s, q + a, p + c] = v
            at = part(rows, k)
            raw[slot[of_row[at]], row[at], m] = misclosure[at]
            at = part(terms, k)
            np.add.at(raw, (slot[of_term[at]], row[term_row[at]], column[at]), value[at])
            white = np.linalg.solve(np.linalg.cholesky(full), raw)
            at, named = part(heads, k), np.zeros((len(ones), m), np.int64)
            named[slot[column_owner[at]], column_at[at]] = columns[at] % wide
            s, r, c = np.nonzero(white[:, :, :m])
            out["param"].append(named[s, c])
            out["coef"].append(white[s, r, c])
            out["length"].append(np.bincount(s * n + r, minlength=len(ones) * n))
            first = np.searchsorted(owner, ones)
            out["set"].append(np.repeat(ones, n))
            out["i"].append(numbers[members[first[:, None] + np.arange(n)[None, :] // 3].ravel() % width] if n else np.zeros(0, np.int64))
            out["component"].append(np.tile(np.arange(n) % 3, len(ones)))
            out["misclosure"].append(white[:, :, m].ravel())
        flat = {c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}
        whole = lambda c: pa.array(flat[c].astype(np.int64))
        held = pa.StructArray.from_arrays([names.take(whole("param")), pa.array(flat["coef"], pa.float64(), from_pandas=True)], names=["param", "coef"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(flat["length"])]).astype(np.int32)), held)
        found = [sets.take(whole("set")), whole("i"), whole("component").cast(pa.int32()), pa.array(flat["misclosure"], pa.float64(), from_pandas=True), lists]
        return pa.Table.from_arrays(found, names=[set_id, "i", "component", "misclosure", "design"])

    return whiten


def _whiten_dense(r: DataFrame, b: DataFrame, set_id: str, blocks: int = 0) -> DataFrame:
    """One matrix per set, many sets to a call; ``blocks`` says how many blocks all sets have."""
    parts = int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, blocks // CALL_BLOCKS)
    # By number, as small rows make much work: the planner would put them into one task.
    deal = lambda df, key: df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).repartition(parts, "_bucket").groupBy("_bucket")
    kind = dict(r.dtypes)["_set"]
    out = deal(r, "_set").cogroup(deal(b, "_key")).applyInArrow(
        _whitener(set_id), f"`{set_id}` {kind}, i long, component int, misclosure double, design {TERMS}"
    )
    return out.withColumn("weight", F.lit(1.0))


def _square(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(width, -1)


def _tile_of(rank: int):
    """The matrix of one tile, from its 3 by 3 blocks; places without a member are those of a unit matrix."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((3 * rank, 3 * rank))
        first = pdf.iloc[0]
        if first["r"] == first["c"]:
            np.fill_diagonal(out, 1.0)
        for p, q, cov in zip(pdf["p"], pdf["q"], pdf["cov"]):
            if cov is None:
                continue
            p, q = int(p), int(q)
            for value, (a, c) in zip(cov, LOWER):
                out[3 * p + a, 3 * q + c] = out[3 * p + c, 3 * q + a] = value
                if first["r"] == first["c"]:
                    out[3 * q + c, 3 * p + a] = out[3 * q + a, 3 * p + c] = value
        return pd.DataFrame({"k": [first["k"]], "r": [first["r"]], "c": [first["c"]], "m": [out.tobytes()]})

    return build


def _side_of(rank: int):
    """The right-hand side of one block of members and one chunk of names."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        at = {name: n for n, name in enumerate(first["names"])}
        out = np.zeros((3 * rank, len(at)))
        for p, comp, name, coef in zip(pdf["p"], pdf["component"], pdf["name"], pdf["coef"]):
            if not np.isnan(p):
                out[3 * int(p) + int(comp), at[name]] += coef
        return pd.DataFrame({"k": [first["k"]], "r": [first["r"]], "c": [first["c"]], "m": [out.tobytes()]})

    return build


def whiten_tiled(r: DataFrame, b: DataFrame, set_id: str, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """``whiten_sets`` for sets whose matrix no task holds: a right-looking Cholesky in tiles, the right-hand sides as further columns.

    ``r(_set, i, component, misclosure, design)`` and ``b(_key, i, j, cov)``. Tiles are keyed by set, row block and column
    block. Round ``n`` factors the diagonal tile ``n`` of every set, solves the tiles below and beside it, and takes their
    products off the tiles that remain; a task holds three tiles. Rounds are as many as the largest set has blocks of
    ``tile`` members; what each leaves finished is appended to a folder beside the checkpoints. Members with
    equations but no covariance, or the reverse, are refused.
    """
    spark, width = r.sparkSession, 3 * tile
    # A key that is not null even where the set is.
    of_set = lambda df, col: df.withColumn("k", F.to_json(F.struct(F.col(col).alias("set"))))
    eq, cov = of_set(r, "_set"), of_set(b, "_key").drop("_key")
    have = eq.select("k", "i").distinct().withColumn("eq", F.lit(True))
    given = cov.filter("i = j").select("k", "i").distinct().withColumn("cov", F.lit(True))
    odd = have.join(given, ["k", "i"], "full").filter("eq IS NULL OR cov IS NULL").limit(1).collect()
    if odd:
        raise ValueError(f"member {odd[0]['i']} of set {odd[0]['k']} has equations without covariance or the reverse")
    block = lambda col: F.floor(F.col(col) / F.lit(tile)).cast("long")
    inside = lambda col: F.pmod(F.col(col), F.lit(tile)).cast("int")
    # Blocks are numbered from each set's first, so that all sets begin in the same round.
    base = eq.groupBy("k").agg(F.min(block("i")).alias("base"), F.max(block("i")).alias("top"), F.first("_set").alias("_set"))
    base = cut(base.select("k", "_set", "base", (F.col("top") - F.col("base")).alias("last")))
    last = base.agg(F.max("last")).first()[0]
    if last is None:
        return _whiten_dense(r, b, set_id)
    grid = base.select("k", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("r"))
    lower = grid.select("k", "r", F.explode(F.sequence(F.lit(0).cast("long"), "r")).alias("c"), *[F.lit(None).cast(t).alias(n) for n, t in (("p", "int"), ("q", "int"), ("cov", "array<double>"))])
    # A block (i, j) with i <= j stands below the diagonal as (j, i); it is symmetric itself.
    tiled = cov.join(base, "k").select("k", (block("j") - F.col("base")).alias("r"), (block("i") - F.col("base")).alias("c"), inside("j").alias("p"), inside("i").alias("q"), "cov")
    schema = "k string, r long, c long, m binary"
    matrix = lower.unionByName(tiled).groupBy("k", "r", "c").applyInPandas(_tile_of(tile), schema)
    # Names of a set are dealt over chunks by hash; the misclosure is the column without a name, in chunk 0.
    terms = eq.select("k", "i", "component", F.explode(F.concat("design", F.array(F.struct(F.lit(None).cast("string").alias("param"), F.col("misclosure").alias("coef"))))).alias("t"))
    terms = terms.select("k", "i", "component", F.col("t.param").alias("name"), F.col("t.coef").alias("coef"))
    names = terms.select("k", "name").distinct()
    chunks = names.groupBy("k").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("long").alias("chunks"))
    dealt = -1 - F.when(F.col("name").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("name"), F.col("chunks")))
    listed = cut(names.join(chunks, "k").withColumn("c", dealt.cast("long")).groupBy("k", "c").agg(F.collect_list(F.struct("name")).alias("names")))
    listed = listed.withColumn("names", F.transform(F.array_sort("names"), lambda n: n["name"]))
    placed = terms.join(chunks, "k").withColumn("c", dealt.cast("long")).join(base, "k")
    placed = placed.select("k", (block("i") - F.col("base")).alias("r"), "c", inside("i").alias("p"), "component", "name", "coef")
    empty = grid.join(listed, "k").select("k", "r", "c", *[F.lit(None).cast(t).alias(n) for n, t in (("p", "int"), ("component", "int"), ("name", "string"), ("coef", "double"))])
    sides = placed.unionByName(empty).join(listed, ["k", "c"]).groupBy("k", "r", "c").applyInPandas(_side_of(tile), schema)

    # One call is one tile of about width squared numbers, so rows are passed singly and in small batches.
    @F.udf("binary")
    def factor(m):
        return np.linalg.cholesky(_square(bytes(m), width)).tobytes()

    @F.udf("binary")
    def panel(m, low, below):
        held, root = _square(bytes(m), width), _square(bytes(low), width)
        # Below the diagonal tile: A / L', kept as its transpose; beside it: L \ B.
        return np.ascontiguousarray(np.linalg.solve(root, held.T if below else held)).tobytes()

    @F.udf("binary")
    def update(m, left, right):
        return (_square(bytes(m), width) - _square(bytes(left), width).T @ _square(bytes(right), width)).tobytes()

    folder = f"{ensure_checkpoint_dir(spark)}/whiten-{uuid.uuid4().hex}"
    work = cut(matrix.unionByName(sides))
    for n in range(last + 1):
        root = work.filter((F.col("r") == n) & (F.col("c") == n)).select("k", factor("m").alias("low"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        edge = work.filter(((F.col("r") > n) & (F.col("c") == n)) | ((F.col("r") == n) & (F.col("c") < 0)))
        edge = edge.withColumn("_salt", F.pmod(F.xxhash64("r", "c"), F.lit(SALTS)).cast("int")).join(root, ["k", "_salt"])
        below = F.col("c") == n
        solved = cut(edge.select("k", F.when(below, F.col("r")).otherwise(F.col("c")).alias("at"), panel("m", "low", below).alias("side")))
        solved.filter("at < 0").select("k", F.lit(n).cast("long").alias("r"), F.col("at").alias("c"), F.col("side").alias("m")).write.mode("append").parquet(folder)
        if n < last:
            rest = work.filter((F.col("r") > n) & ((F.col("c") > n) | (F.col("c") < 0)))
            left = solved.select("k", F.col("at").alias("r"), F.col("side").alias("left"))
            right = solved.select("k", F.col("at").alias("c"), F.col("side").alias("right"))
            work = cut(rest.join(left, ["k", "r"]).join(right, ["k", "c"]).select("k", "r", "c", update("m", "left", "right").alias("m")))

    @F.udf("array<struct<place:int,param:string,coef:double>>")
    def cells(m, names):
        held = _square(bytes(m), width)
        return [(int(p), names[q], float(held[p, q])) for p, q in zip(*np.nonzero(held))]

    done = spark.read.parquet(folder).join(listed, ["k", "c"]).select("k", "r", F.explode(cells("m", "names")).alias("e"))
    term = F.struct(F.col("e.param").alias("param"), F.col("e.coef").alias("coef"))
    whole = done.groupBy("k", "r", F.col("e.place").alias("place")).agg(
        F.sort_array(F.collect_list(F.when(F.col("e.param").isNotNull(), term))).cast(TERMS).alias("design"),
        F.coalesce(F.max(F.when(F.col("e.param").isNull(), F.col("e.coef"))), F.lit(0.0)).alias("misclosure"),
    )
    number = ((F.col("r") + F.col("base")) * tile + F.floor(F.col("place") / 3)).alias("i")
    found = whole.join(base.select("k", "base"), "k").select("k", number, (F.col("place") % 3).cast("int").alias("component"), "misclosure", "design")
    # A member has three equations after whitening, those without any term too.
    every = have.select("k", "i", F.explode(F.array(*[F.lit(c) for c in range(3)])).alias("component"))
    return every.join(found, ["k", "i", "component"], "left").join(base.select("k", "_set"), "k").select(
        F.col("_set").alias(set_id), "i", "component", F.coalesce("misclosure", F.lit(0.0)).alias("misclosure"),
        F.coalesce("design", F.array().cast(TERMS)).alias("design"), F.lit(1.0).alias("weight"),
    )
