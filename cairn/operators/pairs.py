"""Joins by distance: pairs in range, nearest neighbours, nearest lines.

Points fall into cells; only neighbouring cells meet. Crowded cells are split by
salt, and nearest-neighbour searches start with cells small enough to hold few
targets and widen them only for points that found too little, so dense and empty
country cost alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.lineage import cut
from cairn.plans.skew import HOT_ROWS, bounded_broadcast, salted_join

NARROWEST = 2.0**-12


def _cell(names: Sequence[str], size: float) -> list[Column]:
    return [F.floor(F.col(n) / size).cast("long").alias(f"_c{i}") for i, n in enumerate(names)]


def _steps(n: int, half: bool) -> list[tuple[int, ...]]:
    """Offsets to the neighbouring cells; ``half`` keeps one of each opposite pair, and the cell itself."""
    every = list(product((-1, 0, 1), repeat=n))
    return [s for s in every if s >= (0,) * n] if half else every


def _spread(df: DataFrame, dims: int, half: bool) -> DataFrame:
    """Repeat rows into the neighbouring cells."""
    steps = F.array(
        *[F.struct(*[F.lit(v).alias(f"_s{i}") for i, v in enumerate(s)]) for s in _steps(dims, half)]
    )
    wide = df.select("*", F.inline(steps))
    same = F.lit(True)
    for i in range(dims):
        same = same & (F.col(f"_s{i}") == 0)
    out = wide.withColumns({f"_c{i}": F.col(f"_c{i}") + F.col(f"_s{i}") for i in range(dims)} | {"_same": same})
    return out.drop(*[f"_s{i}" for i in range(dims)])


def squared_distance(a: str, b: str, names: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for n in names:
        d = F.col(f"{a}_{n}") - F.col(f"{b}_{n}")
        total = total + d * d
    return total


def pairs_within(
    points: DataFrame, key: str, radius: float, names: Sequence[str] = ("x", "y", "z"), carry: Sequence[str] = (),
    hot_rows: int = HOT_ROWS, within: Sequence[str] = (),
) -> DataFrame:
    """Every pair ``(a, b)`` with ``a < b`` closer than ``radius``, with its ``dist2`` and ``carry`` columns of both ends.

    Each pair of neighbouring cells meets once, in one direction, so no pair is formed twice. With ``within`` given, only
    points with the same values there meet, and the pairs keep these columns.
    """
    dims = len(names)
    base = points.select(*within, key, *names, *carry, *_cell(names, radius))
    cell = [*within, *[f"_c{i}" for i in range(dims)]]
    left = base.select(F.col(key).alias("p"), *[F.col(c).alias(f"p_{c}") for c in (*names, *carry)], *cell)
    right = _spread(
        base.select(F.col(key).alias("q"), *[F.col(c).alias(f"q_{c}") for c in (*names, *carry)], *cell), dims, True
    )
    met = salted_join(left, right, cell, ["p"], hot_rows=hot_rows)
    near = met.withColumn("dist2", squared_distance("p", "q", names)).filter(
        (F.col("dist2") < radius * radius) & (~F.col("_same") | (F.col("p") < F.col("q")))
    )
    first = F.col("p") < F.col("q")
    ends = []
    for c in carry:
        ends += [
            F.when(first, F.col(f"p_{c}")).otherwise(F.col(f"q_{c}")).alias(f"a_{c}"),
            F.when(first, F.col(f"q_{c}")).otherwise(F.col(f"p_{c}")).alias(f"b_{c}"),
        ]
    return near.select(*within, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "dist2", *ends)


def _start_size(targets: DataFrame, names: Sequence[str], widest: float, crowd: int) -> float:
    """Largest cell, halving from ``widest``, whose fullest cell holds at most ``crowd`` target positions.

    One aggregate per halving over the distinct positions; each needs only the largest count.
    """
    size = widest
    for _ in range(40):
        top = targets.groupBy(*_cell(names, size)).count().agg(F.max("count").alias("m")).first()["m"]
        if top is None or top <= crowd:
            break
        size /= 2.0
    return size


def nearest(
    queries: DataFrame, targets: DataFrame, query_key: str, target_key: str, k: int = 1,
    names: Sequence[str] = ("x", "y", "z"), max_distance: float | None = None, min_distance: float = 0.0,
    exclude_same: bool = False, taxicab: bool = False, crowd: int | None = None,
) -> DataFrame:
    """The ``k`` nearest targets of every query: ``(query, target, dist, place)``; ties go to the lower target key.

    Exact for any layout. Targets on one spot beyond ``k`` (one more where one may be the query itself) can never be
    among the ``k`` nearest and are set aside first. The first cells hold at most ``crowd`` spots, by default a few for each
    neighbour sought, so that a query meets about as many targets as it needs. A query is settled once ``k`` targets lie
    within the present cell size; the others go on with cells twice as wide, until ``max_distance`` or the extent of the data.
    """
    dims = len(names)
    crowd = 4 * (k + 1) if crowd is None else crowd
    spot = Window.partitionBy(*names).orderBy(target_key)
    most = k + 1 if exclude_same else k
    some = targets.select(target_key, *names).withColumn("_n", F.row_number().over(spot)).filter(F.col("_n") <= most)
    some = cut(some.select(F.col(target_key).alias("target"), *[F.col(n).alias(f"t_{n}") for n in names], "_n"))
    extent = some.agg(
        *[F.min(f"t_{n}").alias(f"lo{i}") for i, n in enumerate(names)], *[F.max(f"t_{n}").alias(f"hi{i}") for i, n in enumerate(names)]
    ).first()
    q_extent = queries.agg(
        *[F.min(n).alias(f"lo{i}") for i, n in enumerate(names)], *[F.max(n).alias(f"hi{i}") for i, n in enumerate(names)]
    ).first()
    if extent["lo0"] is None or q_extent["lo0"] is None:
        empty = queries.limit(0).select(F.col(query_key).alias("query"))
        return empty.withColumns(
            {"target": F.lit(None).cast("string"), "dist": F.lit(None).cast("double"), "place": F.lit(None).cast("int")}
        )
    span = [max(extent[f"hi{i}"], q_extent[f"hi{i}"]) - min(extent[f"lo{i}"], q_extent[f"lo{i}"]) for i in range(dims)]
    reach = (sum(span) if taxicab else sum(s * s for s in span) ** 0.5) + 1.0
    if max_distance is not None:
        reach = min(reach, max_distance)
    size = min(reach, _start_size(some.filter("_n = 1").select(*[F.col(f"t_{n}").alias(n) for n in names]), names, reach, crowd))
    some = some.drop("_n")
    left = queries.select(F.col(query_key).alias("query"), *names)
    found = None
    while True:
        at = left.select("query", *[F.col(n).alias(f"q_{n}") for n in names], *_cell(names, size))
        around = _spread(some.select("*", *_cell([f"t_{n}" for n in names], size)), dims, False).drop("_same")
        if found is not None:
            # Few queries are left: only the targets around them go on.
            cells = [f"_c{i}" for i in range(dims)]
            around = around.join(bounded_broadcast(at.select(*cells).distinct()), cells, "left_semi")
        met = salted_join(at, around, [f"_c{i}" for i in range(dims)], ["query"])
        if taxicab:
            dist = F.lit(0.0)
            for n in names:
                dist = dist + F.abs(F.col(f"q_{n}") - F.col(f"t_{n}"))
        else:
            dist = F.sqrt(squared_distance("q", "t", names))
        met = met.withColumn("dist", dist).filter((F.col("dist") <= size) & (F.col("dist") >= min_distance))
        if exclude_same:
            met = met.filter(F.col("query") != F.col("target"))
        w = Window.partitionBy("query").orderBy("dist", "target")
        top = met.select("query", "target", "dist").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
        last = size >= reach
        if not last:
            top = cut(top)
            full = top.filter(F.col("place") == k).select("query")
            done = top.join(full, "query", "left_semi")
            left = cut(left.join(full, "query", "left_anti"))
        else:
            done = top
        found = done if found is None else found.unionByName(done)
        if last or not left.limit(1).count():
            return found
        size = min(size * 2.0, reach)


def _tiled(segments: DataFrame, size: float) -> DataFrame:
    """Segments in the tiles ``(_tx, _ty)`` that their course crosses, and those beside them, column by column."""
    lo_x, hi_x = F.least("x1", "x2"), F.greatest("x1", "x2")
    columns = segments.withColumn(
        "_tx",
        F.explode(F.sequence(F.floor(lo_x / size).cast("long") - 1, F.floor(hi_x / size).cast("long") + 1)),
    )
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))

    def height(at: Column) -> Column:
        inside = F.greatest(lo_x, F.least(hi_x, at))
        return F.when(F.col("x2") == F.col("x1"), F.col("y1")).otherwise(F.col("y1") + slope * (inside - F.col("x1")))

    y_a, y_b = height((F.col("_tx") - 1) * size), height((F.col("_tx") + 2) * size)
    vertical = F.col("x1") == F.col("x2")
    low = F.when(vertical, F.least("y1", "y2")).otherwise(F.least(y_a, y_b))
    high = F.when(vertical, F.greatest("y1", "y2")).otherwise(F.greatest(y_a, y_b))
    return columns.withColumn(
        "_ty", F.explode(F.sequence(F.floor(low / size).cast("long") - 1, F.floor(high / size).cast("long") + 1))
    )


def nearest_segment(
    queries: DataFrame, segments: DataFrame, query_key: str, segment_key: str, tolerance: float, names=("x", "y")
) -> DataFrame:
    """Nearest line ``(query, segment, dist)`` within ``tolerance`` of each query point; ties go to the lower key.

    A segment is laid into the tiles its course crosses, column by column, not its whole box. Segments between the same
    points count once, by their lowest key. Where tiles as wide as ``tolerance`` would hold many segments the search starts
    with narrower ones: a query with a line closer than the present width is settled, the others go on with twice the width.
    """
    x, y = names
    ends = ["x1", "y1", "x2", "y2"]
    lines = segments.groupBy(*ends).agg(F.min(F.struct(F.col(segment_key).alias("k")))["k"].alias("segment"))
    lines = cut(lines.select("segment", *ends))
    left = cut(queries.select(F.col(query_key).alias("query"), F.col(x).alias("_x"), F.col(y).alias("_y")))
    held = _tiled(lines, tolerance).groupBy("_tx", "_ty").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares")
    ).first()
    # Halving the width doubles the rows laid out and halves the lines a query meets: go on until they balance.
    size, rows = tolerance, held["rows"] or 0
    met_rows = left.count() * (held["squares"] / rows) if rows else 0
    while rows and met_rows > rows and size > tolerance * NARROWEST:
        size, rows, met_rows = size / 2.0, rows * 2, met_rows / 2.0
    found = None
    while True:
        at = left.withColumns({"_tx": F.floor(F.col("_x") / size).cast("long"), "_ty": F.floor(F.col("_y") / size).cast("long")})
        met = salted_join(at, _tiled(lines, size), ["_tx", "_ty"], ["query"])
        dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        length2 = dx * dx + dy * dy
        along = F.when(length2 > 0, ((F.col("_x") - F.col("x1")) * dx + (F.col("_y") - F.col("y1")) * dy) / length2).otherwise(0.0)
        along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        dist = F.hypot(F.col("_x") - F.col("x1") - along * dx, F.col("_y") - F.col("y1") - along * dy)
        near = met.withColumn("dist", dist).filter(F.col("dist") < size)
        done = near.groupBy("query").agg(F.min_by("segment", F.struct("dist", "segment")).alias("segment"), F.min("dist").alias("dist"))
        last = size >= tolerance
        if not last:
            done = cut(done)
            left = cut(left.join(done.select(F.col("query").alias("_done")), F.col("query").eqNullSafe(F.col("_done")), "left_anti"))
        found = done if found is None else found.unionByName(done)
        if last or left.isEmpty():
            return found
        size *= 2.0


def baselines_from_lists(lists: DataFrame, list_id: str, place: str, code: str) -> DataFrame:
    """Baselines from the first mark of every list to its other marks; repeats in a list count once."""
    marks = lists.groupBy(list_id, code).agg(F.min(place).alias("_p"))
    first = marks.groupBy(list_id).agg(F.min_by(code, "_p").alias("from_code"))
    return marks.join(first, list_id).filter(F.col(code) != F.col("from_code")).select(
        list_id, "from_code", F.col(code).alias("to_code"), F.col("_p").alias("place")
    )


def list_pairs_within(lists: DataFrame, stations: DataFrame, list_id: str, code: str, radius: float) -> DataFrame:
    """Pairs of one list closer than ``radius``: members meet in the cells of their list, so no pair is shuffled."""
    members = lists.select(list_id, F.col(code).alias("code")).distinct()
    placed = cut(members.join(stations.select("code", "x", "y", "z"), "code"))
    return pairs_within(placed, "code", radius, within=(list_id,))


def requested_pairs(observed: DataFrame, stations: DataFrame, radius: float | None, listed: DataFrame | None = None) -> DataFrame:
    """Station pairs whose covariance is wanted: observed ones, those under a length, and those under it in a list."""
    out = observed.select("a", "b")
    if radius is not None:
        some = stations if listed is None else stations.join(listed.select("code").distinct(), "code", "left_semi")
        out = out.unionByName(pairs_within(some, "code", radius).select("a", "b"))
    return out.distinct()


def synthetic_baselines(
    stations: DataFrame, k: int, min_length: float = 0.0, max_length: float | None = None
) -> DataFrame:
    """Baselines from every station to its ``k`` nearest within length limits, with the vector between them."""
    near = nearest(stations, stations, "code", "code", k, max_distance=max_length, min_distance=min_length, exclude_same=True)
    f = stations.select(F.col("code").alias("query"), *[F.col(c).alias(f"f_{c}") for c in "xyz"])
    t = stations.select(F.col("code").alias("target"), *[F.col(c).alias(f"t_{c}") for c in "xyz"])
    return near.join(f, "query").join(t, "target").select(
        F.col("query").alias("from_code"), F.col("target").alias("to_code"), "dist", "place",
        *[(F.col(f"t_{c}") - F.col(f"f_{c}")).alias(f"d{c}") for c in "xyz"],
    )
