"""Gridded, triangulated and deformation models from their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.dates import from_decimal_year, parse_date
from cairn.plans.ordered import carry_forward, running_sum
from cairn.sources.lines import fields

_HEADER = r"^([A-Za-z][A-Za-z0-9_]*):\s*(.*)$"
_NODE = r"^V(\d+),(\d+):\s*(.*)$"


def grid_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grids and nodes of ASCII grid files.

    Returns ``grids(file, crdsys, min_x, min_y, res_x, res_y, nx, ny, ndim, latlon, wraps)`` and
    ``nodes(file, ix, iy, v)`` with zero-based places; nodes marked ``*`` are undefined and left out.
    """
    node = F.col("text").rlike(_NODE)
    heads = lines.filter(~node & F.col("text").rlike(_HEADER)).select(
        "file", F.upper(F.regexp_extract("text", _HEADER, 1)).alias("k"), F.trim(F.regexp_extract("text", _HEADER, 2)).alias("v")
    )
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    number = lambda k: pick(k).try_cast("double")
    g = heads.groupBy("file").agg(
        pick("CRDSYS").alias("crdsys"), number("XMIN").alias("min_x"), number("XMAX").alias("_mx"), number("YMIN").alias("min_y"),
        number("YMAX").alias("_my"), pick("NGRDX").try_cast("long").alias("nx"), pick("NGRDY").try_cast("long").alias("ny"),
        pick("NDIM").try_cast("int").alias("ndim"), F.coalesce(pick("LATLON") == "1", F.lit(False)).alias("latlon"),
        F.when(F.upper(pick("VALUES")) == "INTEGER", number("VRES")).otherwise(1.0).alias("unit"),
    )
    grids = g.withColumns(
        {"res_x": (F.col("_mx") - F.col("min_x")) / (F.col("nx") - 1), "res_y": (F.col("_my") - F.col("min_y")) / (F.col("ny") - 1)}
    )
    wraps = F.col("latlon") & (F.abs(F.col("nx") * F.col("res_x") - 360.0) < F.col("res_x") * 1.0e-3)
    grids = grids.withColumn("wraps", wraps).drop("_mx", "_my")
    parts = fields(F.regexp_extract("text", _NODE, 3))
    nodes = lines.filter(node).select(
        "file",
        (F.regexp_extract("text", _NODE, 1).try_cast("long") - 1).alias("ix"),
        (F.regexp_extract("text", _NODE, 2).try_cast("long") - 1).alias("iy"),
        F.transform(parts, lambda p: p.try_cast("double")).alias("v"),
    ).filter(~F.exists("v", lambda x: x.isNull()))
    scaled = nodes.join(grids.select("file", "unit"), "file").select(
        "file", "ix", "iy", F.transform("v", lambda x: x * F.col("unit")).alias("v")
    )
    return grids.drop("unit"), scaled


# First column and width of each field of a published geoid listing.
GEOID_COLUMNS = {
    "tag": (1, 3), "und": (4, 9), "south": (14, 1), "lat_d": (15, 2), "lat_m": (18, 2), "lat_s": (21, 6),
    "east": (28, 1), "lon_d": (29, 3), "lon_m": (33, 2), "lon_s": (36, 6),
}


def geoid_text(lines: DataFrame) -> DataFrame:
    """Nodes ``(file, lon_deg, lat_deg, und)`` of a published geoid listing: one line per node, latitude south, longitude east.

    Fields stand in fixed columns; a line whose fields are not all numbers in their range is no node.
    """
    raw = {n: F.trim(F.substring("text", at, width)) for n, (at, width) in GEOID_COLUMNS.items()}
    value = {n: c.try_cast("double") for n, c in raw.items() if n not in ("tag", "south", "east")}
    sixty = [value[n].between(0.0, 59.9999999) for n in ("lat_m", "lat_s", "lon_m", "lon_s")]
    known = (raw["tag"] == "GEO") & (raw["south"] == "S") & (raw["east"] == "E") & value["und"].isNotNull()
    for test in (*sixty, value["lat_d"].between(0.0, 90.0), value["lon_d"].between(0.0, 360.0)):
        known &= test
    degrees = lambda k: value[k + "_d"] + value[k + "_m"] / 60.0 + value[k + "_s"] / 3600.0
    return lines.filter(F.coalesce(known, F.lit(False))).select(
        "file", degrees("lon").alias("lon_deg"), (-degrees("lat")).alias("lat_deg"), value["und"].alias("und")
    )


def index_nodes(points: DataFrame, res: float, x: str = "lon_deg", y: str = "lat_deg") -> tuple[DataFrame, DataFrame]:
    """Grid places of listed nodes, and the grid's description, from their spacing ``res``."""
    grids = points.groupBy("file").agg(
        F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("_mx"), F.max(y).alias("_my")
    ).withColumns(
        {
            "res_x": F.lit(res), "res_y": F.lit(res),
            "nx": F.round((F.col("_mx") - F.col("min_x")) / res).cast("long") + 1,
            "ny": F.round((F.col("_my") - F.col("min_y")) / res).cast("long") + 1,
        }
    ).drop("_mx", "_my")
    placed = points.join(grids, "file").withColumns(
        {
            "ix": F.round((F.col(x) - F.col("min_x")) / res).cast("long"),
            "iy": F.round((F.col(y) - F.col("min_y")) / res).cast("long"),
        }
    )
    return grids, placed.select(*points.columns, "ix", "iy")


def triangle_text(lines: DataFrame) -> DataFrame:
    """Triangles ``(file, tri_id, x1, y1, v1, ...)`` of files with ``P id x y values...`` and ``T id1 id2 id3`` lines."""
    parts = lines.withColumn("_f", fields(F.col("text")))
    kind = F.upper(F.get("_f", F.lit(0)))
    points = parts.filter(kind == "P").select(
        "file", F.get("_f", F.lit(1)).alias("p"), F.get("_f", F.lit(2)).try_cast("double").alias("x"), F.get("_f", F.lit(3)).try_cast("double").alias("y"),
        F.transform(F.slice("_f", 5, F.size("_f")), lambda v: v.try_cast("double")).alias("v"),
    )
    out = parts.filter(kind == "T").select(
        "file", F.col("line_no").alias("tri_id"), *[F.get("_f", F.lit(i)).alias(f"p{i}") for i in (1, 2, 3)]
    )
    for i in (1, 2, 3):
        corner = points.select("file", F.col("p").alias(f"p{i}"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"), F.col("v").alias(f"v{i}"))
        out = out.join(corner, ["file", f"p{i}"])
    return out.drop("p1", "p2", "p3")


def _year(text: Column) -> Column:
    """Decimal year of a date text."""
    day = parse_date(text)
    y0 = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(day).cast("int"))).cast("double")
    start, end = from_decimal_year(y0), from_decimal_year(y0 + 1.0)
    return y0 + (day - start) / (end - start)


def deformation_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences and components of deformation model definitions.

    Each keyword line belongs to the last ``DEFORMATION_SEQUENCE`` or ``DEFORMATION_COMPONENT`` above it; the
    free text between ``DESCRIPTION`` and ``END_DESCRIPTION`` is skipped. Components name their grid or triangle file.
    """
    body = lines.withColumn("text", F.trim("text"))
    opens, closes = F.upper(F.col("text")) == "DESCRIPTION", F.upper(F.col("text")) == "END_DESCRIPTION"
    body = carry_forward(body, ["file"], "line_no", {"_desc": F.when(opens, 1).when(closes, 0)})
    body = body.filter((F.coalesce("_desc", F.lit(0)) == 0) & ~closes & (F.col("text") != "") & ~F.col("text").startswith("#"))
    word = F.upper(F.regexp_extract("text", r"^(\S+)", 1))
    body = body.withColumns({"k": word, "v": F.trim(F.regexp_extract("text", r"^\S+\s*(.*)$", 1))})
    seq, comp = F.col("k") == "DEFORMATION_SEQUENCE", F.col("k") == "DEFORMATION_COMPONENT"
    body = running_sum(body, ["file"], "line_no", seq.cast("long"), "seq_no")
    body = running_sum(body, ["file"], "line_no", comp.cast("long"), "comp_no")
    body = carry_forward(body, ["file"], "line_no", {"_in": F.when(seq, "s").when(comp, "c").when(F.col("k") == "DEFORMATION_MODEL", "m")})
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    yes = lambda k: F.coalesce(F.lower(pick(k)) == "yes", F.lit(False))
    sequences = body.filter("`_in` = 's'").groupBy("file", "seq_no").agg(
        pick("DEFORMATION_SEQUENCE").alias("name"), F.lower(pick("DATA_TYPE")).alias("data_type"), pick("DIMENSION").try_cast("int").alias("dimension"),
        _year(pick("START_DATE")).alias("start_year"), _year(pick("END_DATE")).alias("end_year"),
        yes("NESTED_SEQUENCE").alias("nested"), yes("ZERO_BEYOND_RANGE").alias("zero_beyond"),
    )
    components = body.filter("`_in` = 'c'").groupBy("file", "seq_no", "comp_no").agg(
        pick("DEFORMATION_COMPONENT").alias("grid_id"), F.lower(pick("MODEL_TYPE")).alias("model_type"), _year(pick("REF_DATE")).alias("ref_year"),
        F.lower(pick("BEFORE_REF_DATE")).alias("before_ref"), F.lower(pick("AFTER_REF_DATE")).alias("after_ref"),
    )
    return sequences, components
