"""Polygon text to edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def polygon_edges(polygons: DataFrame, wkt: str = "wkt", key: str = "poly_id", lat_first: bool = False) -> DataFrame:
    """Edges ``(poly_id, ring, x1, y1, x2, y2)`` of every ring in well-known text.

    Whatever stands between a pair of innermost brackets is a ring, so POLYGON
    and MULTIPOLYGON texts read alike; an open ring is closed.
    """
    rings = polygons.select(
        key, F.posexplode(F.expr(f"regexp_extract_all({wkt}, '\\\\(([^()]+)\\\\)', 1)")).alias("ring", "_text")
    )
    number = lambda pair, i: F.element_at(F.split(F.trim(pair), r"\s+"), i).try_cast("double")
    x, y = (2, 1) if lat_first else (1, 2)
    points = rings.select(
        key,
        F.col("ring").cast("long").alias("ring"),
        F.transform(
            F.split("_text", ","), lambda p: F.struct(number(p, x).alias("x"), number(p, y).alias("y"))
        ).alias("_pts"),
    )
    shifted = F.concat(F.slice("_pts", 2, F.size("_pts")), F.slice("_pts", 1, 1))
    edge = F.explode(
        F.zip_with(
            "_pts",
            shifted,
            lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")),
        )
    )
    edges = points.select(key, "ring", edge.alias("_e")).select(key, "ring", "_e.*")
    return edges.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
