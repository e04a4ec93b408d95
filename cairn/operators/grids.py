"""Values from regular grids by joins on grid cells.

Nodes are regrouped once into cells that carry all the node values a point in
that cell needs. A point then meets exactly one cell row: one join, no exploding
of points and no grouping after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.plans.skew import bounded_broadcast

NIL_WEIGHT = 1.0e-8


@dataclass(frozen=True)
class Grid:
    """Where the nodes of a grid lie; columns ``iy, ix`` and one or more values hold the nodes."""

    min_x: float
    min_y: float
    res_x: float
    res_y: float
    nx: int
    ny: int
    latlon: bool = True
    wraps: bool = False

    @property
    def columns(self) -> dict[str, Column]:
        names = ("min_x", "min_y", "res_x", "res_y", "nx", "ny", "latlon", "wraps")
        return {n: F.lit(getattr(self, n)) for n in names}


def grid_columns(prefix: str = "") -> dict[str, Column]:
    """The same description read from columns, for points that belong to different grids."""
    names = ("min_x", "min_y", "res_x", "res_y", "nx", "ny", "latlon", "wraps")
    return {n: F.col(prefix + n) for n in names}


def locate(x: Column, y: Column, g: dict[str, Column], cubic: bool) -> dict[str, Column]:
    """Cell indices, fractions in the cell, and whether the needed nodes are inside the grid."""
    dx = x - g["min_x"]
    turned = F.when(g["latlon"], dx - 360.0 * F.floor(dx / 360.0)).otherwise(dx)
    cx, cy = turned / g["res_x"], (y - g["min_y"]) / g["res_y"]
    ix, iy = F.floor(cx).cast("long"), F.floor(cy).cast("long")
    width = F.when(g["wraps"], g["nx"]).otherwise(g["nx"] - 1)
    inside = (turned >= 0) & (cx <= width) & (cy >= 0) & (cy <= g["ny"] - 1)
    low, high = (1, 2) if cubic else (0, 1)
    in_y = (iy >= low) & (iy + high < g["ny"])
    in_x = g["wraps"] | ((ix >= low) & (ix + high < g["nx"]))
    return {"ix": F.pmod(ix, g["nx"]), "iy": iy, "fx": cx - ix, "fy": cy - iy, "inside": inside & in_y & in_x}


def weights(f: Column, cubic: bool) -> list[Column]:
    """Lagrange weights of the two or four nodes around a fraction of a cell."""
    if not cubic:
        return [1.0 - f, f]
    return [
        -f * (f - 1.0) * (f - 2.0) / 6.0,
        (f + 1.0) * (f - 1.0) * (f - 2.0) / 2.0,
        -(f + 1.0) * f * (f - 2.0) / 2.0,
        (f + 1.0) * f * (f - 1.0) / 6.0,
    ]


def cells(nodes: DataFrame, values: Sequence[str], nx: Column, wraps: Column, cubic: bool, grid: Sequence[str] = ()) -> DataFrame:
    """One row per cell with the values of its nodes in a map from node place to value struct."""
    low, high = (-1, 2) if cubic else (0, 1)
    steps = F.array(
        *[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(low, high + 1) for dx in range(low, high + 1)]
    )
    span = high - low + 1
    spread = nodes.withColumns({"_nx": nx, "_w": wraps}).select(
        *grid, "iy", "ix", "_nx", "_w", F.struct(*values).alias("_v"), F.inline(steps)
    )
    cell_x = F.when(F.col("_w"), F.pmod(F.col("ix") - F.col("dx"), F.col("_nx"))).otherwise(F.col("ix") - F.col("dx"))
    place = (F.col("dy") - low) * span + (F.col("dx") - low)
    return (
        spread.select(
            *grid, (F.col("iy") - F.col("dy")).alias("cell_y"), cell_x.alias("cell_x"), place.alias("_k"), "_v"
        )
        .groupBy(*grid, "cell_y", "cell_x")
        .agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_nodes"))
    )


def interpolate(
    points: DataFrame,
    nodes: DataFrame,
    description: Grid | dict[str, Column],
    x: str,
    y: str,
    values: Sequence[str],
    cubic: bool = False,
    grid: Sequence[str] = (),
    node_nx: Column | None = None,
    node_wraps: Column | None = None,
) -> DataFrame:
    """Points with grid ``values`` and ``grid_status``: ``ok``, ``range`` (off the grid) or ``missing`` (undefined node).

    Nodes with a weight under 1e-8 do not count, so an undefined node on the far side does no harm.
    ``grid`` names key columns shared by points and nodes when there are several grids.
    """
    g = description.columns if isinstance(description, Grid) else description
    if isinstance(description, Grid):
        node_nx, node_wraps = F.lit(description.nx), F.lit(description.wraps)
    table = bounded_broadcast(cells(nodes, values, node_nx, node_wraps, cubic, grid), 50_000)
    at = locate(F.col(x), F.col(y), g, cubic)
    placed = points.withColumns({f"_{k}": c for k, c in at.items()})
    placed = placed.withColumns(
        {"_inside": F.coalesce("_inside", F.lit(False)), "cell_x": F.col("_ix"), "cell_y": F.col("_iy")}
    )
    joined = placed.join(table, [*grid, "cell_y", "cell_x"], "left")
    span = 4 if cubic else 2
    wy, wx = weights(F.col("_fy"), cubic), weights(F.col("_fx"), cubic)
    out = {}
    for v in values:
        total = F.lit(0.0)
        for j in range(span):
            for i in range(span):
                node = F.element_at("_nodes", F.lit(j * span + i))[v]
                nil = (F.abs(wy[j]) < NIL_WEIGHT) | (F.abs(wx[i]) < NIL_WEIGHT)
                total = total + F.when(nil, 0.0).otherwise(wy[j] * wx[i] * node)
        out[v] = F.when(F.col("_inside"), total)
    keep = [c for c in points.columns if c not in values]
    result = joined.select(*keep, "_inside", *[c.alias(n) for n, c in out.items()])
    complete = F.lit(True)
    for v in values:
        complete = complete & F.col(v).isNotNull()
    status = F.when(~F.col("_inside"), "range").when(complete, "ok").otherwise("missing")
    return result.withColumn("grid_status", status).drop("_inside")


def geoid_heights(
    stations: DataFrame, nodes: DataFrame, grid: Grid, x: str, y: str, values=("und", "xi", "eta"),
    keep_existing: bool = False, preserve: str = "ellipsoidal", cubic: bool = False,
) -> DataFrame:
    """Stations with undulation (and deflections) from a grid.

    ``preserve`` says which height of a station stays: with ``ellipsoidal`` the orthometric one is
    recomputed from it. ``keep_existing`` leaves stations that already have an undulation alone.
    ``geoid_status`` says which stations the grid could not serve.
    """
    fields = [v for v in values if v in nodes.columns]
    got = interpolate(
        stations.withColumnsRenamed({v: f"_old_{v}" for v in fields}), nodes, grid, x, y, fields, cubic
    )
    ok = F.col("grid_status") == "ok"
    if keep_existing:
        ok = ok & F.col("_old_und").isNull()
    new = {v: F.when(ok, F.col(v)).otherwise(F.col(f"_old_{v}")) for v in fields}
    out = got.withColumns({f"_new_{v}": c for v, c in new.items()})
    if preserve == "ellipsoidal":
        shift = F.coalesce("_old_und", F.lit(0.0)) - F.coalesce("_new_und", F.lit(0.0))
        out = out.withColumn("ohgt", F.col("ohgt") + shift)
    keep = [c for c in stations.columns if c not in fields]
    return out.select(*keep, *[F.col(f"_new_{v}").alias(v) for v in fields], F.col("grid_status").alias("geoid_status"))


def shift_by_grid(
    points: DataFrame, nodes: DataFrame, grid: Grid, lon: str, lat: str, inverse: bool = False
) -> DataFrame:
    """Move positions (degrees) by a shift grid with values ``dlon, dlat``; the inverse takes the shift at the first guess."""
    fields = ["dlon", "dlat"]
    first = interpolate(points, nodes, grid, lon, lat, fields)
    if not inverse:
        return first.withColumns({lon: F.col(lon) + F.col("dlon"), lat: F.col(lat) + F.col("dlat")}).drop(*fields)
    guess = first.withColumns({"_x": F.col(lon) - F.col("dlon"), "_y": F.col(lat) - F.col("dlat")}).drop(*fields, "grid_status")
    second = interpolate(guess, nodes, grid, "_x", "_y", fields)
    return second.withColumns({lon: F.col(lon) - F.col("dlon"), lat: F.col(lat) - F.col("dlat")}).drop(*fields, "_x", "_y")


def velocity_displacement(points: DataFrame, nodes: DataFrame, grid: Grid, lon: str, lat: str, years: Column) -> DataFrame:
    """Displacement ``de, dn, du`` from a grid of yearly rates ``ve, vn, vu``; missing vertical rates count as zero."""
    fields = [v for v in ("ve", "vn", "vu") if v in nodes.columns]
    got = interpolate(points, nodes, grid, lon, lat, fields)
    named = {"ve": "de", "vn": "dn", "vu": "du"}
    out = got.withColumns({named[v]: F.col(v) * years for v in fields})
    if "vu" not in fields:
        out = out.withColumn("du", F.when(F.col("grid_status") == "ok", 0.0))
    return out.drop(*fields)


# ------------------------------------------------------------------ triangles


def triangle_values(
    points: DataFrame, triangles: DataFrame, key: str, x: str, y: str, values: int, tile: float = 0.5,
    surface: Sequence[str] = (),
) -> DataFrame:
    """Values of a triangulated surface at points: ``tri_id`` and ``tri_value`` (array), null outside.

    ``triangles(tri_id, x1, y1, v1, x2, y2, v2, x3, y3, v3)`` with array values are spread over the tiles
    their box touches; a point looks only at its tile. On a shared edge the lower triangle id counts.
    """
    xs = [F.col(f"x{i}") for i in (1, 2, 3)]
    ys = [F.col(f"y{i}") for i in (1, 2, 3)]
    span = lambda cols: F.sequence(
        F.floor(F.least(*cols) / tile).cast("long"), F.floor(F.greatest(*cols) / tile).cast("long")
    )
    tiled = triangles.withColumn("_tx", F.explode(span(xs))).withColumn("_ty", F.explode(span(ys)))
    at = points.withColumns(
        {"_tx": F.floor(F.col(x) / tile).cast("long"), "_ty": F.floor(F.col(y) / tile).cast("long")}
    )
    px, py = F.col(x), F.col(y)
    joined = at.join(bounded_broadcast(tiled, 100_000), [*surface, "_tx", "_ty"])
    det = (ys[1] - ys[2]) * (xs[0] - xs[2]) + (xs[2] - xs[1]) * (ys[0] - ys[2])
    w1 = ((ys[1] - ys[2]) * (px - xs[2]) + (xs[2] - xs[1]) * (py - ys[2])) / det
    w2 = ((ys[2] - ys[0]) * (px - xs[2]) + (xs[0] - xs[2]) * (py - ys[2])) / det
    weighed = joined.filter(det != 0).withColumns({"_w1": w1, "_w2": w2}).withColumn("_w3", 1.0 - F.col("_w1") - F.col("_w2"))
    edge = -1.0e-10
    inside = weighed.filter((F.col("_w1") >= edge) & (F.col("_w2") >= edge) & (F.col("_w3") >= edge))
    value = F.array(
        *[
            F.col("_w1") * F.element_at("v1", i + 1)
            + F.col("_w2") * F.element_at("v2", i + 1)
            + F.col("_w3") * F.element_at("v3", i + 1)
            for i in range(values)
        ]
    )
    best = inside.groupBy(key, *surface).agg(F.min_by(F.struct("tri_id", value.alias("tri_value")), F.col("tri_id")).alias("_b"))
    return points.join(best, [key, *surface], "left").select(*points.columns, "_b.tri_id", "_b.tri_value")
