"""Builders of result tables, and writers that keep them distributed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.angles import format_dms
from cairn.operators.residuals import error_ellipse


def point_wkt(x: Column, y: Column, places: int = 9) -> Column:
    return F.concat(F.lit("POINT("), _fixed(x, places), F.lit(" "), _fixed(y, places), F.lit(")"))


def line_wkt(x1: Column, y1: Column, x2: Column, y2: Column, places: int = 9) -> Column:
    """A line between both ends, or a point where the second end is missing."""
    line = F.concat(
        F.lit("LINESTRING("), _fixed(x1, places), F.lit(" "), _fixed(y1, places), F.lit(", "),
        _fixed(x2, places), F.lit(" "), _fixed(y2, places), F.lit(")"),
    )
    return F.when(x2.isNull(), point_wkt(x1, y1, places)).otherwise(line)


def _fixed(value: Column, places: int) -> Column:
    return F.round(value, places).cast(f"decimal(28,{places})").cast("string")


def station_results(final: DataFrame, changes: DataFrame, covariances: DataFrame, confidence: float = 1.0, seu: float = 1.0) -> DataFrame:
    """Adjusted stations: position, mode, shifts, error ellipse, height error and shape.

    ``final(code, name, lon, lat, ohgt, mode_h, mode_v)`` in degrees; ``covariances(code, vee, ven, vnn, vuu)``.
    """
    df = final.join(changes.select("code", "adj_e", "adj_n", "adj_u"), "code", "left").join(covariances, "code", "left")
    a, b, az = error_ellipse(F.col("vee"), F.col("ven"), F.col("vnn"))
    m = confidence * seu
    mode = F.concat("mode_h", F.lit("/"), "mode_v")
    return df.select(
        "code",
        F.col("lon").alias("longitude"),
        F.col("lat").alias("latitude"),
        F.col("ohgt").alias("height"),
        F.when(F.col("mode_h") == F.col("mode_v"), F.col("mode_h")).otherwise(mode).alias("mode"),
        F.col("adj_e"), F.col("adj_n"), F.col("adj_u").alias("adj_h"),
        (a * m).alias("errell_max"), (b * m).alias("errell_min"), az.alias("errell_bmax"),
        (F.sqrt(F.greatest(F.lit(0.0), F.col("vuu"))) * m).alias("errhgt"),
        "name",
        point_wkt(F.col("lon"), F.col("lat")).alias("shape"),
    )


def observation_results(residuals: DataFrame, seu: float = 1.0, aposteriori: bool = False) -> DataFrame:
    """One row per scalar observation with residual, errors, standardised residual and redundancy."""
    m = seu if aposteriori else 1.0
    status = F.when(F.col("rejected"), "rejected").when(F.col("unused"), "unused").otherwise("used")
    return residuals.select(
        F.col("from_code").alias("fromstn"), F.col("to_code").alias("tostn"), F.col("obs_ts").alias("date"),
        F.col("obs_type").alias("obstype"), F.col("set_id").alias("obsset"), F.col("obs_key").alias("obsid"), status.alias("status"),
        "value", (F.col("error") * m).alias("error"), "residual", (F.col("res_error") * m).alias("reserror"),
        (F.col("sres") / m).alias("stdres"), (F.col("res_error") / F.col("error")).alias("redundancy"), F.col("data_file").alias("file"),
    )


def vector_components(vectors: DataFrame, columns: Sequence[str], key: str = "obs_key") -> DataFrame:
    """Component rows of array columns: ``component`` 1..3 with one column per array."""
    zipped = F.posexplode(F.arrays_zip(*[F.col(c) for c in columns]))
    rows = vectors.select(key, zipped.alias("_p", "_z"))
    return rows.select(key, (F.col("_p") + 1).cast("long").alias("component"), *[F.col(f"_z.{c}").alias(c) for c in columns])


def inline_components(vectors: DataFrame, columns: Sequence[str], key: str = "obs_key") -> DataFrame:
    """The same side by side: ``value1 .. value3`` and so on."""
    return vectors.select(key, *[F.element_at(c, i).alias(f"{c}{i}") for c in columns for i in (1, 2, 3)])


def metadata(stations: DataFrame, observations: DataFrame, stats: dict[str, float]) -> DataFrame:
    """Run description as ``(code, value, comment)``: counts from the tables, figures from the solution."""
    st = stations.agg(F.count("*").alias("nstations"))
    ob = observations.agg(F.count("*").alias("nobservations"), F.count_if("unused").alias("nunused"))
    notes = {
        "nstations": "stations in the network", "nobservations": "observations read", "nunused": "observations not used",
        "nprm": "calculated parameters", "dof": "degrees of freedom", "ssr": "sum of squared residuals", "seu": "standard error of unit weight",
    }

    def rows(df: DataFrame, values: dict[str, Column]) -> DataFrame:
        items = [
            F.struct(F.lit(k).alias("code"), v.cast("string").alias("value"), F.lit(notes.get(k, "")).alias("comment"))
            for k, v in values.items()
        ]
        return df.select(F.inline(F.array(*items)))

    counted = rows(st, {"nstations": F.col("nstations")} | {k: F.lit(v) for k, v in stats.items()})
    return counted.unionByName(rows(ob, {"nobservations": F.col("nobservations"), "nunused": F.col("nunused")}))


def file_list(stations: DataFrame, observations: DataFrame, station_file: str = "crd_file") -> DataFrame:
    """Files used and their role."""
    crd = stations.select(F.col(station_file).alias("file")).distinct().select("file", F.lit("coordinates").alias("role"))
    obs = observations.select(F.col("data_file").alias("file")).distinct().select("file", F.lit("observations").alias("role"))
    return crd.unionByName(obs)


def coordinate_lines(stations: DataFrame, classes: Sequence[str] = (), places: int = 4, lat_places: int = 6) -> DataFrame:
    """Adjusted stations as lines of a coordinate file, ordered by ``line_no`` keys: code, latitude, longitude, height, classes, name."""
    fields = [
        F.rpad("code", 10, " "), format_dms(F.col("lat"), lat_places, "NS"), format_dms(F.col("lon"), lat_places, "EW"),
        _fixed(F.col("ohgt"), places), *[F.coalesce(F.col(c), F.lit("-")) for c in classes], F.col("name"),
    ]
    return stations.select("code", F.concat_ws(" ", *fields).alias("line"))


def coordinate_covariances(stations: DataFrame, cells: DataFrame) -> DataFrame:
    """Coordinates and covariance triplets of parameters ``code|axis`` as ``(row_code, row_axis, col_code, col_axis, value)``."""
    r, c = F.split("row", r"\|"), F.split("col", r"\|")
    parts = cells.select(r[0].alias("row_code"), r[1].alias("row_axis"), c[0].alias("col_code"), c[1].alias("col_axis"), "value")
    return parts.join(stations.select(F.col("code").alias("row_code"), "lon", "lat", "ohgt"), "row_code")


def as_json(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One JSON text per row, with its key columns kept for ordering and joining."""
    return df.select(*key, F.to_json(F.struct(*df.columns)).alias("json"))


def equations_json(equations: DataFrame) -> DataFrame:
    """Observation equations as JSON texts."""
    return equations.select(
        "obs_key", F.to_json(F.struct("obs_key", "misclosure", "weight", "design")).alias("json")
    )


def solution_exchange_lines(estimates: DataFrame, cells: DataFrame) -> DataFrame:
    """Solution blocks as ordered lines ``(block, place, line)``: estimates, then the lower triangle of their covariance.

    ``estimates(no, kind, code, value, error)``, ``cells(row_no, col_no, value)``; numbers start at one. The line
    order is a sort key, so a writer can range-partition instead of gathering.
    """
    number = lambda c, n: F.lpad(c.cast("string"), n, " ")
    science = lambda c: F.lpad(F.format_string("%.14e", c), 21, " ")
    est = estimates.select(
        F.lit("SOLUTION/ESTIMATE").alias("block"),
        F.struct(F.col("no").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("place"),
        F.concat_ws(
            " ", number(F.col("no"), 6), F.rpad("kind", 6, " "), F.rpad("code", 10, " "), science(F.col("value")), science(F.col("error"))
        ).alias("line"),
    )
    mat = cells.filter("row_no >= col_no").select(
        F.lit("SOLUTION/MATRIX_ESTIMATE L COVA").alias("block"),
        F.struct(F.col("row_no").cast("long").alias("a"), F.col("col_no").cast("long").alias("b")).alias("place"),
        F.concat_ws(" ", number(F.col("row_no"), 6), number(F.col("col_no"), 6), science(F.col("value"))).alias("line"),
    )
    blocks = est.unionByName(mat)
    edges = blocks.select("block").distinct()
    far = F.struct(F.lit(9223372036854775807).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    near = F.struct(F.lit(-1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    heads = edges.select("block", near.alias("place"), F.concat(F.lit("+"), "block").alias("line"))
    tails = edges.select("block", far.alias("place"), F.concat(F.lit("-"), "block").alias("line"))
    return blocks.unionByName(heads).unionByName(tails)


def write_ordered_lines(lines: DataFrame, order: Sequence[str], path: str) -> None:
    """Text files whose names and contents follow ``order``."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(*partition)
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(kind).save(path)


@dataclass(frozen=True)
class ListColumn:
    """One column of a user-defined listing."""

    source: str
    header: str
    width: int = 0
    places: int | None = None
    angle: str | None = None  # dms, degrees
    hemispheres: str = ""
    right: bool = True


def listing(df: DataFrame, columns: Sequence[ListColumn], delimiter: str = " ", key: Sequence[str] = ()) -> DataFrame:
    """Rows formatted to the chosen columns, precision, angle form and delimiter, as ``line``."""
    fields = []
    for c in columns:
        value = F.col(c.source)
        if c.angle == "dms":
            text = format_dms(value, c.places or 0, c.hemispheres)
        elif c.places is not None:
            text = _fixed(value, c.places)
        else:
            text = value.cast("string")
        text = F.coalesce(text, F.lit(""))
        if c.width:
            wide = F.lpad(text, c.width, " ") if c.right else F.rpad(text, c.width, " ")
            text = F.when(F.length(text) > c.width, text).otherwise(wide)
        fields.append(text)
    return df.select(*key, F.concat_ws(delimiter, *fields).alias("line"))


def listing_header(columns: Sequence[ListColumn], delimiter: str = " ") -> str:
    return delimiter.join(c.header.rjust(c.width) if c.right else c.header.ljust(c.width) for c in columns)


# Fields a residual listing can show, by the name it is asked for.
RESIDUAL_FIELDS = {
    "from": "from_code", "to": "to_code", "type": "obs_type", "value": "value", "error": "error", "calc": "calc",
    "residual": "residual", "res_error": "res_error", "sres": "sres", "redundancy": "redundancy", "mde": "mde", "id": "obs_key",
    "set": "set_id", "date": "obs_ts", "file": "data_file", "rejected": "rejected", "rank": "rank", "used": "used",
    "slope_distance": "slope_distance", "arc_distance": "arc_distance", "azimuth": "azimuth", "projection_azimuth": "projection_azimuth",
    "height_difference": "height_difference", "from_height": "from_hgt", "to_height": "to_hgt", "line": "line_no", "from_name": "f_name",
    "to_name": "t_name", "error_factor": "error_factor",
}


def residual_listing(df: DataFrame, fields: Sequence[str], order: str = "type") -> DataFrame:
    """Chosen residual fields in report order."""
    from cairn.operators.merge import sort_observations

    ordered = sort_observations(df, order) if order in ("type", "line") else df.orderBy("data_file", "line_no")
    return ordered.select(*[F.col(RESIDUAL_FIELDS[f]).alias(f) for f in fields])


def accuracy_results(marks: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Accuracy-test results per mark."""
    return marks.join(adjusted.select("code", "adj_e", "adj_n", "adj_h"), "code", "left").select(
        "code", "adj_e", "adj_n", "adj_h", F.sqrt("error2").alias("errhor"), F.sqrt("verror2").alias("errhgt"),
        F.col("limit_no").alias("limit_order"), "priority", F.col("order").alias("calc_order"),
    )
