"""Station coordinate files: fixed text layout, CSV by definition, published lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions.angles import parse_coordinate_text, parse_dms
from cairn.functions.text import clean_class_name
from cairn.sources.lines import fields as split_fields
from cairn.sources.lines import split_errors, uncomment


def station_text(lines: DataFrame, projected: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Stations and errors of coordinate text files.

    A file has a title, a coordinate system code, optionally an ``options`` line, then one station per line:
    code, latitude and longitude as degrees, minutes, seconds, hemisphere (or easting and northing for
    systems in ``projected``), height, geoid columns and class values as the options declare, and the name.
    Only the three header lines are matched up per file; stations stay spread over tasks.
    """
    text = uncomment(lines).filter("text <> ''")
    # The first three lines that hold anything, however long a comment stands before them; Spark limits
    # the ranks below the shuffle, so a task sends three rows of a file at most.
    first = text.withColumn("_rank", F.row_number().over(Window.partitionBy("file").orderBy("line_no"))).filter("_rank <= 3")
    head = first.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_h"))
    second, third = F.get("_h", F.lit(1)), F.get("_h", F.lit(2))
    has_options = F.lower(third["text"]).startswith("options")
    opts = F.when(has_options, F.split(F.lower(F.trim(third["text"])), r"\s+"))
    raw = F.when(has_options, F.split(F.trim(third["text"]), r"\s+"))
    classes = F.transform(F.filter(raw, lambda o: F.lower(o).startswith("c=")), lambda o: F.substring(o, F.lit(3), F.length(o)))
    say = lambda word: F.coalesce(F.array_contains(opts, word), F.lit(False))
    header = head.select(
        "file",
        F.get("_h", F.lit(0))["text"].alias("title"),
        F.upper(F.element_at(F.split(second["text"], r"\s+"), 1)).alias("crdsys"),
        F.when(has_options, third["line_no"]).otherwise(second["line_no"]).alias("_last"),
        say("ellipsoidal_heights").alias("ellipsoidal"),
        say("geoid_heights").alias("_has_und"),
        say("deflections").alias("_has_defl"),
        F.coalesce(classes, F.array().cast("array<string>")).alias("class_names"),
    )
    # Files per job may be many but the join key spreads with them; a huge file only repeats one small row.
    body = text.join(header, "file").filter(F.col("line_no") > F.col("_last")).withColumn("_f", split_fields(F.col("text")))
    grid = F.col("crdsys").isin(*projected) if projected else F.lit(False)
    dms = lambda k, hem: parse_dms(F.concat_ws(" ", *[F.get("_f", F.lit(k + i)) for i in range(4)]), hem)
    number = lambda k: F.get("_f", k).try_cast("double")
    after = F.when(grid, 3).otherwise(9)
    n_defl = F.when(F.col("_has_defl"), 2).otherwise(0)
    n_und = F.when(F.col("_has_und"), 1).otherwise(0)
    first_class = after + 1 + n_defl + n_und
    out = body.withColumns(
        {
            "code": F.get("_f", F.lit(0)),
            "lat_deg": F.when(~grid, dms(1, "NS")),
            "lon_deg": F.when(~grid, dms(5, "EW")),
            "easting": F.when(grid, number(F.lit(1))),
            "northing": F.when(grid, number(F.lit(2))),
            "height": number(after),
            "xi_sec": F.when(F.col("_has_defl"), number(after + 1)),
            "eta_sec": F.when(F.col("_has_defl"), number(after + 2)),
            "und": F.when(F.col("_has_und"), number(after + 1 + n_defl)),
            "_c0": first_class,
        }
    )
    values = F.transform("class_names", lambda name, i: F.get("_f", F.col("_c0") + i))
    out = out.withColumns(
        {
            "classes": F.map_from_arrays(F.transform("class_names", clean_class_name), values),
            "name": F.array_join(F.slice("_f", F.col("_c0") + F.size("class_names") + 1, F.size("_f")), " "),
            "ohgt": F.when(F.col("ellipsoidal"), F.col("height") - F.coalesce("und", F.lit(0.0))).otherwise(F.col("height")),
            "_a": F.coalesce("lat_deg", "northing"),
            "_b": F.coalesce("lon_deg", "easting"),
        }
    )
    good, bad = split_errors(out, ["code", "_a", "_b", "height"], "invalid station")
    keep = ["file", "line_no", "crdsys", "code", "name", "lat_deg", "lon_deg", "easting", "northing", "ohgt", "und", "xi_sec", "eta_sec", "classes"]
    return good.select(*keep), bad


@dataclass(frozen=True)
class StationFormat:
    """Which columns of a CSV hold what; ``classes`` maps class names to columns."""

    code: str
    lon: str
    lat: str
    height: str
    name: str | None = None
    geoid: str | None = None
    ellipsoidal: bool = False
    projected: bool = False
    classes: dict[str, str] = field(default_factory=dict)


def station_csv(rows: DataFrame, form: StationFormat) -> tuple[DataFrame, DataFrame]:
    """Stations and errors of CSV rows read with all columns as text; angles in decimal degrees or DMS."""
    number = lambda c: F.trim(F.col(c)).try_cast("double")
    und = number(form.geoid) if form.geoid else F.lit(None).cast("double")
    height = number(form.height)
    ohgt = height - F.coalesce(und, F.lit(0.0)) if form.ellipsoidal else height
    lon = number(form.lon) if form.projected else parse_coordinate_text(F.col(form.lon), "EW")
    lat = number(form.lat) if form.projected else parse_coordinate_text(F.col(form.lat), "NS")
    names = ("easting", "northing") if form.projected else ("lon_deg", "lat_deg")
    pairs: list[Column] = []
    for k, c in form.classes.items():
        pairs += [F.lit(k), F.trim(F.col(c))]
    classes = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    place = [F.col(c) for c in ("file", "line_no") if c in rows.columns] or [F.lit("").alias("file"), F.lit(0).alias("line_no")]
    out = rows.select(
        *place, F.to_csv(F.struct(*rows.columns)).alias("text"),
        F.nullif(F.trim(F.col(form.code)), F.lit("")).alias("code"),
        (F.trim(F.col(form.name)) if form.name else F.lit(None).cast("string")).alias("name"),
        lon.alias(names[0]), lat.alias(names[1]), ohgt.alias("ohgt"), und.alias("und"), classes.alias("classes"),
    )
    good, bad = split_errors(out, ["code", *names, "ohgt"], "invalid station")
    return good.drop("text"), bad


def published_stations(rows: DataFrame, code: str, x: str, y: str, z: str) -> DataFrame:
    """Reference-station list with geocentric coordinates as a coordinate table; the code doubles as the name."""
    number = lambda c: F.col(c).try_cast("double")
    return rows.select(F.trim(code).alias("code"), number(x).alias("x"), number(y).alias("y"), number(z).alias("z"), F.trim(code).alias("name")).filter(
        "x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"
    )
