"""Solution exchange files, receiver baseline summaries, XML and fixed-format adjustment data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.angles import parse_dms, parse_hp
from cairn.plans.ordered import carry_forward, running_sum
from cairn.sources.lines import fields



def solution_blocks(lines: DataFrame) -> DataFrame:
    """Data lines with the name of the block they stand in."""
    name = F.regexp_extract("text", r"^\+(.*?)\s*$", 1)
    mark = F.when(F.col("text").startswith("+"), name).when(F.col("text").startswith("-"), F.lit(""))
    # A data line starts with a blank, so block marks cannot be mistaken for negative numbers.
    tagged = carry_forward(lines, ["file"], "line_no", {"block": mark})
    return tagged.filter(F.col("text").startswith(" ") & (F.col("block") != ""))


def _number(text: Column) -> Column:
    return F.regexp_replace(text, "[dD]", "E").try_cast("double")


def solution_points(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Point observations, their covariance cells, and errors of solution files.

    Estimates of station X, Y, Z become points with ``par`` numbers; the lower or upper covariance triangle becomes
    ``(file, row, col, value)`` with ``row >= col``. A mark with more than one solution is an error.
    """
    blocks = solution_blocks(lines)
    est = blocks.filter("block = 'SOLUTION/ESTIMATE'").withColumn("_f", fields(F.col("text")))
    get = lambda i: F.get("_f", F.lit(i))
    est = est.filter(get(1).isin("STAX", "STAY", "STAZ")).select(
        "file", get(0).cast("long").alias("par"), F.substring(get(1), 4, 1).alias("axis"), get(2).alias("code"), get(3).alias("pt"),
        get(4).alias("soln"), get(5).alias("epoch"), _number(get(8)).alias("value"), _number(get(9)).alias("error"),
    )
    pick = lambda c, a: F.max(F.when(F.col("axis") == a, F.col(c)))
    points = est.groupBy("file", "code", "pt").agg(
        F.count_distinct("soln").alias("solutions"), F.max("epoch").alias("epoch"), F.array(*[pick("value", a) for a in "XYZ"]).alias("vec"),
        F.array(*[pick("par", a) for a in "XYZ"]).alias("par"),
    )
    cells = blocks.filter(F.col("block").rlike("^SOLUTION/MATRIX_ESTIMATE [LU] COVA")).withColumn("_f", fields(F.col("text")))
    flat = cells.select(
        "file", get(0).cast("long").alias("_r"), get(1).cast("long").alias("_c"), F.posexplode(F.slice("_f", 3, 3)).alias("_k", "_v")
    )
    cov = flat.select(
        "file", F.greatest("_r", F.col("_c") + F.col("_k")).alias("row"), F.least("_r", F.col("_c") + F.col("_k")).alias("col"), _number(F.col("_v")).alias("value")
    )
    bad = points.filter("solutions > 1").select("file", "code", F.lit("more than one solution").alias("error"))
    return points.filter("solutions = 1").drop("solutions"), cov, bad


def point_covariances(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Six-element covariance of each point from the cells of its own parameters."""
    par = points.select("file", "code", "pt", F.posexplode("par").alias("_i", "_p"))
    a = par.select("file", "code", "pt", F.col("_i").alias("_ia"), F.col("_p").alias("_a"))
    b = par.select("file", "code", "pt", F.col("_i").alias("_ib"), F.col("_p").alias("_b"))
    own = a.join(b, ["file", "code", "pt"]).filter("_ia >= _ib")
    hit = own.join(
        cells, (own["file"] == cells["file"]) & (F.greatest("_a", "_b") == F.col("row")) & (F.least("_a", "_b") == F.col("col"))
    ).select(own["file"], "code", "pt", "_ia", "_ib", "value")
    at = lambda i, j: F.max(F.when((F.col("_ia") == i) & (F.col("_ib") == j), F.col("value")))
    return hit.groupBy("file", "code", "pt").agg(
        F.array(at(0, 0), at(1, 0), at(1, 1), at(2, 0), at(2, 1), at(2, 2)).alias("cov")
    )


# ------------------------------------------------------ receiver baseline summaries


def labelled_summary(lines: DataFrame) -> DataFrame:
    """Baselines of ``Label: value`` reports, one report after another, each beginning at ``Project Name:``."""
    starts = F.col("text").rlike(r"(?i)^\s*Project Name:")
    body = running_sum(lines, ["file"], "line_no", starts.cast("long"), "report")
    label = F.lower(F.regexp_extract("text", r"^\s*([^:]+):", 1))
    value = F.trim(F.regexp_extract("text", r"^\s*[^:]+:\s*(.*)$", 1))
    tagged = body.withColumns({"_k": label, "_v": value}).filter("_k <> ''")
    pick = lambda k: F.max(F.when(F.col("_k").startswith(k), F.col("_v")))
    got = tagged.groupBy("file", "report").agg(
        pick("from station").alias("from_code"), pick("to station").alias("to_code"), pick("baseline components").alias("_vec"),
        pick("standard deviations").alias("_sd"), pick("solution type").alias("solution"),
    )
    triple = lambda c: F.transform(F.expr(f"regexp_extract_all({c}, '([-+]?[0-9]+[.]?[0-9]*(?:[eE][-+]?[0-9]+)?)', 1)"), lambda v: v.try_cast("double"))
    sd = triple("_sd")
    return got.select(
        "file", "report", "from_code", "to_code", triple("_vec").alias("vec"),
        F.array(F.get(sd, F.lit(0)) ** 2, F.lit(0.0), F.get(sd, F.lit(1)) ** 2, F.lit(0.0), F.lit(0.0), F.get(sd, F.lit(2)) ** 2).alias("cov"),
        "solution",
    ).filter("from_code IS NOT NULL AND to_code IS NOT NULL AND vec IS NOT NULL")


def tagged_summary(lines: DataFrame) -> DataFrame:
    """Baselines of ``@``-tagged records: ``@+`` from station, ``@-`` vector to a station, ``@=`` scale and upper covariance triangle, ``@*`` date."""
    tag = F.regexp_extract("text", r"^@(.)", 1)
    body = lines.filter(F.col("text").startswith("@")).withColumns({"_t": tag, "_d": F.substring("text", F.lit(3), F.length("text"))})
    body = running_sum(body, ["file"], "line_no", (F.col("_t") == "+").cast("long"), "report").filter("report > 0")
    code = F.trim(F.substring("_d", 1, 16))
    numbers = lambda c: F.transform(fields(c), lambda v: v.try_cast("double"))
    pick = lambda t, c: F.max(F.when(F.col("_t") == t, c))
    got = body.groupBy("file", "report").agg(
        pick("+", code).alias("from_code"), pick("-", code).alias("to_code"), pick("-", F.substring("_d", F.lit(17), F.length("_d"))).alias("_vec"),
        pick("=", F.col("_d")).alias("_cov"), F.trim(pick("*", F.col("_d"))).alias("date"),
    )
    c = numbers(F.col("_cov"))
    scale = F.get(c, F.lit(0)) ** 2
    # Upper triangle by rows: 11 12 13 22 23 33; kept as the lower triangle 11 21 22 31 32 33.
    lower = F.array(*[F.get(c, F.lit(i)) * scale for i in (1, 2, 4, 3, 5, 6)])
    return got.select("file", "report", "from_code", "to_code", numbers(F.col("_vec")).alias("vec"), lower.alias("cov"), "date").filter(
        "to_code IS NOT NULL"
    )


# ------------------------------------------------------------ other packages

MEASUREMENT = (
    "Type STRING, Ignore STRING, First STRING, Second STRING, Value STRING, StdDev STRING, InstHeight STRING, TargHeight STRING"
)


def xml_measurements(records: DataFrame, column: str = "xml") -> tuple[DataFrame, DataFrame]:
    """Observations of XML measurement records, one element per row as ``spark.read.format('xml')`` or a text split gives them."""
    types = {"S": "SD", "E": "ED", "M": "MD", "L": "LV", "D": "HA", "B": "AZ", "V": "ZD", "H": "OH", "R": "EH", "P": "LT", "Q": "LN"}
    m = records.select("*", F.from_xml(F.col(column), MEASUREMENT).alias("_m"))
    pairs = [F.lit(v) for kv in types.items() for v in kv]
    kind = F.element_at(F.create_map(*pairs), F.upper(F.col("_m.Type")))
    angle = kind.isin("HA", "AZ", "ZD", "LT", "LN")
    raw = F.trim("_m.Value")
    value = F.when(angle, F.radians(F.coalesce(parse_hp(raw, ""), parse_dms(raw)))).otherwise(raw.try_cast("double"))
    unit = F.when(angle, 3.14159265358979 / 648000.0).otherwise(1.0)
    clean = lambda c: F.nullif(F.regexp_replace(F.trim(c), r"\s+", "_"), F.lit(""))
    out = m.select(
        *[c for c in records.columns if c != column], kind.alias("obs_type"), clean("_m.First").alias("from_code"), clean("_m.Second").alias("to_code"),
        value.alias("value"), (F.trim("_m.StdDev").try_cast("double") * unit).alias("error"),
        F.trim("_m.InstHeight").try_cast("double").alias("from_hgt"), F.trim("_m.TargHeight").try_cast("double").alias("to_hgt"),
        (F.col("_m.Ignore") == "*").alias("rejected"),
    )
    ok = F.col("obs_type").isNotNull() & F.col("from_code").isNotNull() & F.col("value").isNotNull()
    return out.filter(ok), out.filter(~F.coalesce(ok, F.lit(False)))


def read_xml_measurements(spark, path, row_tag: str = "DnaMeasurement") -> DataFrame:
    """Measurement elements of XML files with Spark's own reader."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(MEASUREMENT).load(path)


def report_test_data(lines: DataFrame) -> DataFrame:
    """Accuracy-test input from an adjustment report: station lines with shifts, ellipse axes, azimuth and height error."""
    pattern = r"^\s*(\S+)\s+([-0-9.]+)\s+([-0-9.]+)\s+([-0-9.]+)\s+([0-9.]+)\s+([0-9.]+)\s+([0-9.]+)\s+([0-9.]+)\s*$"
    part = lambda i: F.regexp_extract("text", pattern, i)
    number = lambda i: part(i).try_cast("double")
    return lines.filter(F.col("text").rlike(pattern)).select(
        "file", part(1).alias("code"), number(2).alias("adj_e"), number(3).alias("adj_n"), number(4).alias("adj_h"),
        number(5).alias("errell_max"), number(6).alias("errell_min"), number(7).alias("errell_bmax"), number(8).alias("errhgt"),
    )
