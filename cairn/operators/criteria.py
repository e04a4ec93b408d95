"""Station and observation criteria as boolean Columns and semi joins.

A criterion is a function from the table's columns to a Column. Criteria that
need another table (polygons, lists, selected stations) return a flagged
DataFrame instead, so each is decided once per station and then joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import matches_wildcard, natural_key, natural_literal, path_matches_wildcard
from cairn.plans.lineage import store
from cairn.plans.skew import bounded_broadcast

FAR = 1.0e7  # coordinates from here on are left to the plain count

# ---------------------------------------------------------------- stations


def all_stations() -> Column:
    return F.lit(True)


def code_is(codes: Sequence[str], code: str = "code") -> Column:
    """Case-blind equality with any of ``codes``."""
    return F.lower(F.col(code)).isin([c.lower() for c in codes])


def code_like(pattern: str, code: str = "code") -> Column:
    return matches_wildcard(F.col(code), pattern)


def code_between(first: str, last: str, code: str = "code") -> Column:
    """Codes from ``first`` to ``last`` in natural order, both included."""
    key = natural_key(F.col(code))
    return (key >= natural_literal(first)) & (key <= natural_literal(last))


def class_is(column: str, values: Sequence[str]) -> Column:
    return F.lower(F.col(column)).isin([v.lower() for v in values])


def in_range(lon: str, lat: str, lon_min: float, lat_min: float, lon_max: float, lat_max: float) -> Column:
    """Inside a longitude/latitude rectangle after bringing the longitude into the turn that starts at ``lon_min``."""
    return wrap_longitude(F.col(lon), lon_min).between(lon_min, lon_max) & F.col(lat).between(lat_min, lat_max)


def wrap_longitude(lon: Column, start: float) -> Column:
    return lon - 360.0 * F.floor((lon - start) / 360.0)


def any_of(criteria: Iterable[Column]) -> Column:
    """Separate criteria lines: a station matches when any line does."""
    return reduce(lambda a, b: a | b, criteria, F.lit(False))


def line(first: Column, *rest: tuple[str, Column]) -> Column:
    """One criteria line read from left to right: ``and``, ``or`` and ``except`` bind equally."""
    out = first
    for word, criterion in rest:
        if word == "and":
            out = out & criterion
        elif word == "or":
            out = out | criterion
        elif word == "except":
            out = out & ~criterion
        else:
            raise ValueError(f"unknown connective {word!r}")
    return out


def in_list(stations: DataFrame, listed: DataFrame, code: str = "code") -> DataFrame:
    """Stations whose code is in a list table, whatever the letter case."""
    wanted = listed.select(F.lower(F.col(listed.columns[0])).alias("_wanted")).distinct()
    return stations.join(wanted, F.lower(F.col(code)) == F.col("_wanted"), "left_semi")


def inside_polygons(
    stations: DataFrame, edges: DataFrame, key: str = "code", x: str = "lon_deg", y: str = "lat_deg",
    band: float = 0.5, outside: bool = False, wrap: bool = True, polygon: str = "poly_id", tile: float = 5.0,
) -> DataFrame:
    """Stations inside any polygon of ``edges(poly_id, x1, y1, x2, y2)`` by the even-odd rule over all rings.

    A grid of cells of ``band`` degrees or less settles most stations without an edge: cells that lie wholly in some polygon are
    found once (``_cells``). In the others a station meets the runs of edges through its own cell only. Stations whose
    code is not unique or whose place is out of range, and polygons that are not closed or go round the globe, are
    counted edge by edge (``_counted``) over bands and, with ``wrap``, tiles of ``tile`` degrees. ``outside`` keeps the rest.
    """
    number = lambda c: F.abs(F.col(c)) < FAR
    ends = F.explode(F.array(F.struct(F.col("x1").alias("_px"), F.col("y1").alias("_py")), F.struct(F.col("x2").alias("_px"), F.col("y2").alias("_py"))))
    corners = edges.filter(F.col(polygon).isNotNull()).select(polygon, ends.alias("_p")).select(polygon, "_p.*")
    corners = corners.groupBy(polygon, "_px", "_py").agg((F.count("*") % 2 == 1).alias("_odd"))
    odd = corners.groupBy(polygon).agg(
        F.bool_or(F.col("_odd") | ~F.coalesce(number("_px") & number("_py"), F.lit(False))).alias("_open"),
        (F.max("_px") - F.min("_px")).alias("_span"),
    )
    odd = store(odd.filter(F.col("_open") | (F.col("_span") > 360.0 - 3.0 * band) if wrap else F.col("_open")).select(polygon))
    points = stations.select(key, x, y).filter(F.col(key).isNotNull())
    there = F.coalesce(number(x) & number(y), F.lit(False))
    loose = points.groupBy(key).agg(F.count("*").alias("_n"), F.bool_and(there).alias("_there")).filter((F.col("_n") > 1) | ~F.col("_there"))
    loose = store(loose.select(key))
    hits = _in_cells(points.filter(there), edges.filter(F.col(polygon).isNotNull()).join(odd, polygon, "left_anti"), key, x, y, band, wrap, polygon)
    count = lambda p, e: _counted(p, e, key, x, y, band, wrap, polygon, tile)
    if not loose.isEmpty():
        hits = hits.join(loose, key, "left_anti").unionAll(count(points.join(loose, key, "left_semi"), edges))
    if not odd.isEmpty():
        hits = hits.unionAll(count(points.join(loose, key, "left_anti"), edges.join(odd, polygon, "left_semi")))
    return stations.join(hits.distinct(), key, "left_anti" if outside else "left_semi")


def _in_cells(points: DataFrame, edges: DataFrame, key: str, x: str, y: str, band: float, wrap: bool, polygon: str) -> DataFrame:
    """Keys of ``points`` inside a polygon, all of them closed; keys may come several times."""
    tall = edges.agg(F.avg(F.abs(F.col("y1") - F.col("y2")))).first()[0] or band
    size = min(band, max(band / 32.0, tall / 16.0))
    around = math.ceil(360.0 / size) if wrap else None
    width = 360.0 / around if wrap else size
    covered, runs = _cells(edges, size, width, around, polygon)
    at = points.select(key, F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(x) / width).cast("long").alias("_c"), F.floor(F.col(y) / size).cast("long").alias("_row"))
    at = at.withColumn("_cell", F.pmod("_c", F.lit(around)) if wrap else F.col("_c"))
    met = at.join(bounded_broadcast(runs), ["_row", "_cell"])
    # Whole turns between the station's own longitude and that of the polygon.
    px = F.col("_x") - 360.0 * F.round((F.col("_c") - F.col("_at")) / F.lit(around)) if wrap else F.col("_x")
    met = met.withColumn("_px", px)

    def crossed(e):
        slope_x = e["x1"] + (F.col("_y") - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
        return ((e["y1"] <= F.col("_y")) != (e["y2"] <= F.col("_y"))) & (F.col("_px") >= slope_x)

    inside = met.filter((F.col("_left") + F.size(F.filter("_edges", crossed))) % 2 == 1)
    return at.join(bounded_broadcast(covered), ["_row", "_cell"], "left_semi").select(key).unionAll(inside.select(key))


def _cells(edges: DataFrame, size: float, width: float, around: int | None, polygon: str) -> tuple[DataFrame, DataFrame]:
    """Cells ``(_row, _cell)`` wholly inside a polygon, and the runs of edges ``(_row, _cell, _at, _left, _edges)`` through other cells.

    Of the edges of a polygon in one row of cells, those that touch the same or neighbouring cells form a run. Between two runs
    no edge is met, so the number of edges to the left, counted at half height, says for the whole gap whether it is inside. A run
    has its edges and the number of those left of it modulo two; runs of different polygons that say the same are one.
    """
    hair = 1.0e-6 * size  # more than rounding can move a point or an edge
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    step = lambda v, unit: F.floor(v / unit).cast("long")
    rows = edges.select(polygon, "x1", "y1", "x2", "y2", F.explode(F.sequence(step(low - hair, size), step(high + hair, size))).alias("_row"))
    level = F.col("y1") == F.col("y2")
    at = lambda v: F.col("x1") + (v - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.when(~level, F.col("y2") - F.col("y1"))
    bottom, top = F.col("_row") * size, (F.col("_row") + 1) * size
    a = F.when(level, F.col("x1")).otherwise(at(F.greatest(low, F.least(high, bottom - hair))))
    b = F.when(level, F.col("x2")).otherwise(at(F.least(high, F.greatest(low, top + hair))))
    half = (F.col("_row") + 0.5) * size
    rows = rows.withColumns({
        "_c0": step(F.least(a, b) - hair, width), "_c1": step(F.greatest(a, b) + hair, width),
        "_cross": ((F.col("y1") <= half) != (F.col("y2") <= half)).cast("int"),
    })
    line = Window.partitionBy(polygon, "_row").orderBy("_c0", "_c1")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_reach": F.max("_c1").over(before), "_left": F.coalesce(F.sum("_cross").over(before), F.lit(0)) % 2})
    first = F.col("_reach").isNull() | (F.col("_c0") > F.col("_reach") + 1)
    rows = rows.withColumn("_first", first)
    spans = rows.filter((F.col("_left") == 1) & F.col("_first") & F.col("_reach").isNotNull()).select("_row", (F.col("_reach") + 1).alias("_from"), (F.col("_c0") - 1).alias("_to"))
    if around is not None:
        turn = F.floor(F.col("_from") / around) * around
        spans = spans.select("_row", (F.col("_from") - turn).alias("_from"), (F.col("_to") - turn).alias("_to"))
        parts = F.array(
            F.struct(F.col("_from").alias("_from"), F.least("_to", F.lit(around - 1)).alias("_to")),
            F.struct(F.lit(0).cast("long").alias("_from"), (F.col("_to") - around).alias("_to")),
        )
        spans = spans.select("_row", F.inline(parts)).filter("_from <= _to")
    # Overlapping spans of different polygons become one before they are taken apart into cells.
    across = Window.partitionBy("_row").orderBy("_from", "_to")
    spans = spans.distinct().withColumn("_reach", F.max("_to").over(across.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("_part", F.sum((F.col("_reach").isNull() | (F.col("_from") > F.col("_reach") + 1)).cast("int")).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("_row", "_part").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    covered = store(spans.select("_row", F.explode(F.sequence("_from", "_to")).alias("_cell")))
    runs = rows.withColumn("_run", F.sum(F.col("_first").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    edge = F.when(~level, F.struct("x1", "y1", "x2", "y2"))
    runs = runs.groupBy(polygon, "_row", "_run").agg(
        F.min("_c0").alias("_from"), F.max("_c1").alias("_to"), F.max(F.when(F.col("_first"), F.col("_left"))).alias("_left"),
        F.sort_array(F.collect_list(edge)).alias("_edges"),
    )
    runs = runs.select("_row", "_from", "_to", "_left", "_edges").distinct()
    runs = runs.select("_row", F.explode(F.sequence("_from", "_to")).alias("_at"), "_left", "_edges")
    runs = runs.withColumn("_cell", F.pmod("_at", F.lit(around)) if around is not None else F.col("_at"))
    return covered, store(runs.join(bounded_broadcast(covered), ["_row", "_cell"], "left_anti"))


def _counted(
    points: DataFrame, edges: DataFrame, key: str, x: str, y: str, band: float, wrap: bool, polygon: str, tile: float
) -> DataFrame:
    """Keys with an odd number of edges of a polygon to the right, over all rows of the key.

    Edges are cut into horizontal bands; with ``wrap`` each also lies in the tiles of ``tile`` degrees from its
    polygon's western limit to its own eastern end, where points can see it. Points meet edges of their band
    and tile only.
    """
    bounds = edges.groupBy(polygon).agg(F.min("x1").alias("_xmin"), F.max("x1").alias("_xmax"))
    steps = lambda low, high, size: F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))
    banded = edges.filter(F.col("y1") != F.col("y2")).join(bounds, polygon)
    points = points.withColumn("_band", F.floor(F.col(y) / band).cast("long"))
    on = ["_band"]
    px = F.col(x)
    if wrap:
        px = F.col(x) - 360.0 * F.floor((F.col(x) - F.col("_xmin")) / 360.0)
        around = math.ceil(360.0 / tile)
        width = 360.0 / around
        # A hair wider, as points on a limit of tiles may be rounded to either side.
        seen = steps(F.col("_xmin") - 1e-9, F.greatest("x1", "x2") + 1e-9, width)
        banded = banded.withColumn("_tile", F.explode(F.array_distinct(F.transform(seen, lambda k: F.pmod(k, F.lit(around))))))
        points = points.withColumn("_tile", F.pmod(F.floor(F.col(x) / width).cast("long"), F.lit(around)))
        on = ["_band", "_tile"]
    banded = banded.withColumn("_band", F.explode(steps(F.least("y1", "y2"), F.greatest("y1", "y2"), band)))
    slope_x = F.col("x1") + (F.col(y) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossing = ((F.col("y1") <= F.col(y)) != (F.col("y2") <= F.col(y))) & (F.col("_px") < slope_x)
    return (
        points.join(bounded_broadcast(banded), on)
        .withColumn("_px", px)
        .filter(F.col("_px").between(F.col("_xmin"), F.col("_xmax")) & crossing)
        .groupBy(key, polygon)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") % 2 == 1)
        .select(key)
    )


# ------------------------------------------------------------ observations


def type_is(types: Sequence[str], column: str = "obs_type") -> Column:
    return F.upper(F.col(column)).isin([t.upper() for t in types])


def file_like(pattern: str, column: str = "data_file") -> Column:
    return path_matches_wildcard(F.col(column), pattern)


def class_like(column: str, pattern: str) -> Column:
    """One value, several joined by ``/``, or a wildcard."""
    if "*" in pattern or "?" in pattern:
        return matches_wildcard(F.col(column), pattern)
    return class_is(column, pattern.split("/"))


def dated(when: str, day: str | None = None, column: str = "obs_ts") -> Column:
    """``before`` or ``after`` a date (undated rows match neither), or ``unknown``."""
    ts = F.col(column)
    if when == "unknown":
        return ts.isNull()
    limit = F.lit(day).cast("timestamp_ntz")
    return F.coalesce(ts < limit if when == "before" else ts > limit, F.lit(False))


def id_in_list(observations: DataFrame, ids: DataFrame, column: str = "obs_key") -> DataFrame:
    wanted = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    return observations.join(wanted, F.col(column) == F.col("_id"), "left_semi")


def flag_ends(observations: DataFrame, selected: DataFrame, code: str = "code") -> DataFrame:
    """Add ``from_selected`` and ``to_selected`` against a table of selected station codes."""
    chosen = selected.select(F.col(code).alias("_code")).distinct()
    f = chosen.select(F.col("_code").alias("from_code"), F.lit(True).alias("from_selected"))
    t = chosen.select(F.col("_code").alias("to_code"), F.lit(True).alias("to_selected"))
    return (
        observations.join(f, "from_code", "left")
        .join(t, "to_code", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("from_selected", "to_selected")})
    )


def using_stations(observations: DataFrame, selected: DataFrame) -> DataFrame:
    """Observations with either end among the selected stations."""
    flagged = flag_ends(observations, selected)
    return flagged.filter(F.col("from_selected") | F.col("to_selected")).drop("from_selected", "to_selected")


def between_stations(observations: DataFrame, selected: DataFrame) -> DataFrame:
    """Observations with both ends among the selected stations; a point observation has only one end."""
    flagged = flag_ends(observations, selected)
    return flagged.filter(F.col("from_selected") & (F.col("to_code").isNull() | F.col("to_selected"))).drop(
        "from_selected", "to_selected"
    )


def highlight(
    observations: DataFrame, sres_above: float | None = None, redundancy_below: float | None = None,
    rejected: bool = False, unused: bool = False, seu: float = 1.0,
) -> DataFrame:
    """Rows worth a second look: large standardised residuals, weak redundancy, rejected or unused."""
    tests = []
    if sres_above is not None:
        tests.append(F.col("sres") / seu > sres_above)
    if redundancy_below is not None:
        tests.append(F.col("redundancy") < redundancy_below)
    if rejected:
        tests.append(F.col("rejected"))
    if unused:
        tests.append(F.col("unused"))
    return observations.filter(F.coalesce(any_of([F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False)))


def stations_by_size(
    stations: DataFrame, modes: Sequence[str] | None = None, orders: Sequence[str] | None = None,
    horizontal_above: float | None = None, vertical_above: float | None = None,
    h_column: str = "h_error", v_column: str = "v_error",
) -> DataFrame:
    """Stations by status, order, and error or adjustment size."""
    out = stations
    if modes is not None:
        out = out.filter(F.col("mode_h").isin(list(modes)) | F.col("mode_v").isin(list(modes)))
    if orders is not None:
        out = out.filter(F.col("order").isin(list(orders)))
    if horizontal_above is not None:
        out = out.filter(F.col(h_column) > horizontal_above)
    if vertical_above is not None:
        out = out.filter(F.abs(F.col(v_column)) > vertical_above)
    return out
