"""Observation files: commanded text, CSV by definition, fixed columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.angles import parse_angle, parse_dms, parse_hp
from cairn.functions.dates import parse_date
from cairn.plans.ordered import carry_forward, previous_value, running_sum
from cairn.sources.lines import fields as split_fields
from cairn.sources.lines import split_errors, uncomment

# Which default-error command serves an observation type, and types that stand in rounds.
ERROR_COMMAND = {
    "SD": "ds_error", "HD": "ds_error", "ED": "ds_error", "MD": "ds_error", "DR": "ds_error", "HA": "ha_error",
    "AZ": "az_error", "PB": "az_error", "ZD": "zd_error", "LV": "lv_error", "OH": "oh_error", "EH": "eh_error",
    "LT": "lt_error", "LN": "ln_error", "GB": "gb_enu_error", "GX": "gx_enu_error",
}
COMMANDS = (
    "ds_error", "ha_error", "az_error", "zd_error", "lv_error", "lt_error", "ln_error", "oh_error", "eh_error",
    "gb_enu_error", "gx_enu_error", "date", "time", "refraction_coefficient", "distance_scale_error",
    "bearing_orientation_error", "reference_frame", "projection", "gps_error_type", "note",
)
ANGLE_TYPES = ("HA", "AZ", "PB", "ZD", "LT", "LN")
POINT_TYPES = ("GX", "OH", "EH", "LT", "LN", "EP")


def _command(name: str) -> Column:
    """Argument of a command on this line; an empty argument still counts as given."""
    pattern = rf"(?i)^#\s*{name}\b\s*(.*)$"
    if name in ("gb_enu_error",):
        pattern = r"(?i)^#\s*(?:gb|gps)_enu_error\b\s*(.*)$"
    return F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, 1))


def observation_text(lines: DataFrame, grouped_blank_ends: bool = True) -> tuple[DataFrame, DataFrame]:
    """Observations and errors of commanded observation text.

    ``#`` commands hold for the lines after them until given again; ``#data`` starts a type and says which columns
    follow. Lines that hold one code alone start a group at that instrument station; a blank line, ``#end_set`` or
    another command ends it. Carrying values forward and counting sets both work in blocks of lines, so a file of
    any length spreads over tasks.
    """
    text = uncomment(lines)
    classify = r"(?i)^#\s*classify\s+(?:(\w\w)\s+)?(\S+)\s+(\S+)\s*$"
    here = {c: _command(c) for c in COMMANDS}
    data = _command("data")
    here["data"] = F.when(data.isNotNull(), F.upper(F.trim(data)))
    here["angles"] = F.when(F.col("text").rlike(r"(?i)^#\s*(hp|dms|deg)_angles"), F.lower(F.regexp_extract("text", r"(?i)^#\s*(hp|dms|deg)_angles", 1)))
    is_class = F.col("text").rlike(classify)
    here["class_set"] = F.when(
        is_class, F.concat_ws("=", F.regexp_extract("text", classify, 2), F.regexp_extract("text", classify, 3))
    )
    command = F.col("text").startswith("#")
    parts = split_fields(F.col("text"))
    alone = ~command & (F.col("text") != "") & (F.size(parts) == 1)
    # The last line that closes or opens a group tells what the following lines belong to.
    breaks = command | alone | ((F.col("text") == "") if grouped_blank_ends else F.lit(False))
    here["_group"] = F.when(breaks, F.struct(F.when(alone, parts[0]).alias("station"), F.col("line_no").alias("at")))
    state = carry_forward(text, ["file"], "line_no", here)
    state = running_sum(state, ["file"], "line_no", breaks.cast("long"), "_set")
    body = state.filter(~F.col("text").startswith("#") & (F.col("text") != "")).withColumn("_f", split_fields(F.col("text")))
    body = body.filter(~((F.size("_f") == 1)))
    grouped = F.col("_group.station").isNotNull()
    opts = F.split("data", r"\s+")
    kind = F.element_at(opts, 1)
    body = body.withColumns({"obs_type": kind, "_opts": opts, "_grouped": grouped})
    point = F.col("obs_type").isin(*POINT_TYPES)
    first = F.get("_f", F.lit(0))
    # A leading * rejects the observation; it is not part of the code.
    target = F.when(F.col("_grouped") | point, first).otherwise(F.get("_f", F.lit(1)))
    rejected = target.startswith("*") | first.startswith("*")
    bare = lambda c: F.regexp_replace(c, r"^\*", "")
    heights = ~F.array_contains("_opts", "NO_HEIGHTS")
    body = body.withColumns(
        {
            "from_code": bare(F.when(point, first).when(F.col("_grouped"), F.col("_group.station")).otherwise(first)),
            "to_code": F.when(~point, bare(target)),
            "rejected": rejected,
            # Where values start: after the codes, and after a height beside each code.
            "_v": F.when(point, F.when(heights, 2).otherwise(1))
            .when(F.col("_grouped"), F.when(heights, 2).otherwise(1))
            .otherwise(F.when(heights, 4).otherwise(2)),
            "_heights": heights,
        }
    )
    tohgt_at = F.when(F.col("_grouped"), 1).otherwise(3)
    at = lambda i: F.get("_f", F.col("_v") + i)
    angle = F.col("obs_type").isin(*ANGLE_TYPES)
    dms_text = F.concat_ws(" ", at(0), at(1), at(2))
    is_dms = F.coalesce(F.col("angles"), F.lit("dms")) == "dms"
    degrees = (
        F.when(is_dms, parse_dms(dms_text)).when(F.col("angles") == "hp", parse_hp(at(0))).otherwise(at(0).try_cast("double"))
    )
    vector = F.col("obs_type").isin("GB", "GX", "EP")
    width = F.when(vector, 3).when(angle & is_dms, 3).otherwise(1)
    given_error = F.when(F.array_contains("_opts", "ERROR"), F.get("_f", F.col("_v") + width).try_cast("double"))
    error_text = F.lit(None).cast("string")
    for k, c in ERROR_COMMAND.items():
        error_text = F.when(F.col("obs_type") == k, F.col(c)).otherwise(error_text)
    body = body.withColumns(
        {
            "to_hgt": F.when(F.col("_heights") & ~point, F.get("_f", tohgt_at).try_cast("double")),
            "from_hgt": F.when(F.col("_heights") & (point | ~F.col("_grouped")), F.get("_f", F.lit(1)).try_cast("double")),
            "value": F.when(vector, F.lit(0.0)).when(angle, F.radians(degrees)).otherwise(at(0).try_cast("double")),
            "vec": F.when(vector, F.array(*[at(i).try_cast("double") for i in range(3)])),
            "error_text": error_text,
            "given_error": given_error,
            "day": F.when(F.lower("date") != "unknown", parse_date(F.col("date"))),
            "set_id": F.concat_ws("#", "file", F.col("_set").cast("string")),
        }
    )
    body = body.withColumn("error", F.coalesce(_given_in_units(), simple_error(F.col("error_text"), F.col("obs_type"), F.col("value"))))
    body = body.withColumn("obs_key", F.concat_ws("#", "file", F.col("line_no").cast("string")))
    good, bad = split_errors(body, ["obs_type", "from_code", "value"], "invalid observation")
    keep = [
        "file", "line_no", "obs_key", "set_id", "obs_type", "from_code", "to_code", "from_hgt", "to_hgt", "value", "vec", "error",
        "error_text", "day", "rejected", "class_set", "reference_frame", "projection", "refraction_coefficient",
        "distance_scale_error", "bearing_orientation_error", "note",
    ]
    return good.select(*keep), bad


ARC_SECOND = math.pi / 648000.0


def _given_in_units() -> Column:
    angle = F.col("obs_type").isin(*ANGLE_TYPES)
    return F.when(angle, F.col("given_error") * ARC_SECOND).otherwise(F.col("given_error"))


def simple_error(text: Column, kind: Column, value: Column) -> Column:
    """Error of a default-error command that needs no line geometry: millimetres and ppm, or seconds of arc.

    Directions with a centring part keep their text for the model step, which knows the distance.
    """
    number = r"([0-9.]+(?:[eE][-+]?\d+)?)"
    mm = F.regexp_extract(text, rf"(?i){number}\s*mm", 1).try_cast("double")
    ppm = F.regexp_extract(text, rf"(?i){number}\s*ppm", 1).try_cast("double")
    sec = F.regexp_extract(text, rf"(?i){number}\s*sec", 1).try_cast("double")
    length = F.hypot(F.coalesce(mm, F.lit(0.0)) / 1000.0, F.coalesce(ppm, F.lit(0.0)) * value * 1.0e-6)
    return F.when(kind.isin(*ANGLE_TYPES), sec * ARC_SECOND).when(mm.isNotNull() | ppm.isNotNull(), length)


@dataclass(frozen=True)
class Lookup:
    """Code to value with an optional value for codes that are missing; a null default leaves them null."""

    table: dict[str, str]
    default: str | None = None

    def apply(self, code: Column) -> Column:
        """For the short tables written in a format definition."""
        pairs: list[Column] = []
        for k, v in self.table.items():
            pairs += [F.lit(k.lower()), F.lit(v)]
        hit = F.element_at(F.create_map(*pairs), F.lower(F.trim(code)))
        return F.coalesce(hit, F.lit(self.default)) if self.default is not None else hit


def lookup_join(df: DataFrame, table: DataFrame, code: str, value: str, default: str | None, name: str) -> DataFrame:
    """The same for a lookup that is a table of its own: ``table(code, value)``."""
    t = table.select(F.lower("code").alias("_k"), F.col("value").alias("_v"))
    out = df.join(t, F.lower(F.trim(F.col(code))) == F.col("_k"), "left")
    return out.withColumn(name, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


@dataclass(frozen=True)
class ObservationFormat:
    """One observation made from each CSV record; the fields are Columns over the record's text columns."""

    obs_type: str | Column
    from_code: Column
    to_code: Column | None
    value: Column | None = None
    vec: Sequence[Column] | None = None
    error: Column | None = None
    day: Column | None = None
    from_hgt: Column | None = None
    to_hgt: Column | None = None
    set_id: Column | None = None
    rejected: Column | None = None
    ignore: Column | None = None
    angles: str = "degrees"
    error_factor: Column | None = None
    classes: dict[str, Column] = field(default_factory=dict)
    note: Column | None = None


def _angle_or_number(form: ObservationFormat, kind: Column) -> Column:
    value = form.value if form.value is not None else F.lit("0")
    return F.when(kind.isin(*ANGLE_TYPES), F.radians(parse_angle(value, form.angles))).otherwise(F.trim(value).try_cast("double"))


def observation_csv(rows: DataFrame, formats: Sequence[ObservationFormat]) -> tuple[DataFrame, DataFrame]:
    """Observations and errors of CSV rows read as text; each record gives one observation per format that does not ignore it.

    ``rows`` needs ``file`` and ``line_no``. The formats become one array per record, so the input is read once.
    """
    none = F.lit(None)
    items = []
    for number, f in enumerate(formats):
        kind = F.upper(F.lit(f.obs_type) if isinstance(f.obs_type, str) else f.obs_type)
        text = lambda c: F.nullif(F.trim(c), F.lit("")) if c is not None else none.cast("string")
        real = lambda c: F.trim(c.cast("string")).try_cast("double") if c is not None else none.cast("double")
        pairs: list[Column] = []
        for k, c in f.classes.items():
            pairs += [F.lit(k), c]
        factor = real(f.error_factor) if f.error_factor is not None else F.lit(1.0)
        err = real(f.error)
        err = F.when(kind.isin(*ANGLE_TYPES), err * ARC_SECOND).otherwise(err) * F.coalesce(factor, F.lit(1.0))
        vec = F.array(*[real(c) for c in f.vec]) if f.vec is not None else none.cast("array<double>")
        items.append(
            F.struct(
                F.lit(number).alias("part"), kind.alias("obs_type"), text(f.from_code).alias("from_code"), text(f.to_code).alias("to_code"),
                (F.lit(0.0) if f.vec is not None else _angle_or_number(f, kind)).alias("value"), vec.alias("vec"), err.alias("error"),
                (f.day if f.day is not None else none.cast("double")).alias("day"), real(f.from_hgt).alias("from_hgt"), real(f.to_hgt).alias("to_hgt"),
                text(f.set_id).alias("set_text"), (f.rejected if f.rejected is not None else F.lit(False)).alias("rejected"),
                (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("classes"), text(f.note).alias("note"),
                F.coalesce(f.ignore, F.lit(False)).alias("_ignore") if f.ignore is not None else F.lit(False).alias("_ignore"),
            )
        )
    record = rows.select("file", "line_no", F.to_csv(F.struct(*[c for c in rows.columns if c not in ("file", "line_no")])).alias("text"), F.array(*items).alias("_o"))
    flat = record.select("file", "line_no", "text", F.inline("_o")).filter(~F.col("_ignore")).drop("_ignore")
    flat = flat.withColumn("obs_key", F.concat_ws("#", "file", F.col("line_no").cast("string"), F.col("part").cast("string")))
    good, bad = split_errors(flat, ["obs_type", "from_code", "value"], "invalid observation")
    return good.drop("text"), bad


def continue_sets(observations: DataFrame) -> DataFrame:
    """``set_id`` of CSV rows: neighbours in a file with the same non-blank set text and instrument station are one round."""
    before = previous_value(
        observations, ["file"], "line_no", {"_p_set": F.col("set_text"), "_p_from": F.col("from_code"), "_p_part": F.col("part")}
    )
    same = F.coalesce(
        (F.col("set_text") == F.col("_p_set")) & (F.col("from_code") == F.col("_p_from")), F.lit(False)
    )
    counted = running_sum(before, ["file"], "line_no", (~same).cast("long"), "_no")
    return counted.withColumn("set_id", F.concat_ws("#", "file", F.col("_no").cast("string"))).drop("_p_set", "_p_from", "_p_part", "_no")


def fixed_width(lines: DataFrame, columns: dict[str, tuple[int, int]], kind: str, dms: bool = False) -> tuple[DataFrame, DataFrame]:
    """Observations and errors of records with values at fixed columns ``name -> (start, length)``, counted from one.

    A ``0`` code repeats the one above it, as in reciprocal zenith distances.
    """
    cut = {n: F.trim(F.substring("text", a, b)) for n, (a, b) in columns.items()}
    raw = lines.filter(F.trim("text") != "").select("file", "line_no", "text", *[c.alias(n) for n, c in cut.items()])
    given = {f"_{c}": F.when((F.col(c) != "0") & (F.col(c) != ""), F.col(c)) for c in ("from_code", "to_code")}
    filled = carry_forward(raw, ["file"], "line_no", given)
    value = F.radians(parse_dms(F.col("value"))) if dms else F.col("value").try_cast("double")
    unit = ARC_SECOND if dms else 1.0
    out = filled.select(
        "file", "line_no", "text", F.lit(kind).alias("obs_type"), F.col("_from_code").alias("from_code"), F.col("_to_code").alias("to_code"),
        value.alias("value"), (F.col("error").try_cast("double") * unit).alias("error"),
        *[F.col(c).try_cast("double").alias(c) for c in ("from_hgt", "to_hgt") if c in columns],
    )
    good, bad = split_errors(out, ["from_code", "to_code", "value", "error"], "invalid record")
    return good.drop("text"), bad


def validate(
    observations: DataFrame, defaults: dict[str, tuple[str, str]], rejected_stations: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fill what observations need and set aside those that cannot be used.

    ``defaults`` maps a column (projection, refraction coefficient, reference frame) to the class that may give it and
    the value used otherwise. Rows of a rejected station are marked rejected.
    """
    out = observations
    for column, (class_name, default) in defaults.items():
        own = F.col(column) if column in observations.columns else F.lit(None).cast("string")
        out = out.withColumn(column, F.coalesce(own, F.element_at("classes", F.lit(class_name)), F.lit(default)))
    if rejected_stations is not None:
        gone = rejected_stations.select(F.col("code").alias("_code"), F.lit(True).alias("_gone")).distinct()
        for end in ("from_code", "to_code"):
            out = out.join(gone, out[end] == gone["_code"], "left").withColumn(
                "rejected", F.col("rejected") | F.coalesce("_gone", F.lit(False))
            ).drop("_code", "_gone")
    problem = F.when(F.col("value").isNull(), "no value").when(F.col("error").isNull() | (F.col("error") <= 0), "no error")
    out = out.withColumn("_problem", problem)
    bad = out.filter("_problem IS NOT NULL").select("file", "line_no", "obs_key", F.col("_problem").alias("error"))
    return out.filter("_problem IS NULL").drop("_problem"), bad
