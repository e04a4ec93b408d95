"""Recode definitions and station offset files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.dates import parse_date
from cairn.sources.lines import fields, split_errors, uncomment


def _as_ts(day: Column) -> Column:
    """Zone-free timestamp of a day number."""
    whole = F.floor(day)
    seconds = F.round((day - whole) * 86400.0)
    start = F.date_add(F.lit("1970-01-01").cast("date"), whole.cast("int")).cast("timestamp_ntz")
    return start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def _target(code: Column) -> dict[str, Column]:
    """A leading ``*`` recodes and rejects; ``*`` alone drops the station's observations."""
    bare = F.regexp_replace(F.trim(code), r"^\*", "")
    return {"reject": F.trim(code).startswith("*"), "code_to": F.when(bare != "", bare).otherwise(F.lit("*"))}


def recode_csv(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recodes of CSV rows ``codefrom, codeto, datefrom, dateto`` read as text."""
    bound = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", _as_ts(parse_date(F.col(c))))
    out = rows.select(
        "file", "line_no", F.to_csv(F.struct("codefrom", "codeto", "datefrom", "dateto")).alias("text"),
        F.nullif(F.trim("codefrom"), F.lit("")).alias("code_from"), *[c.alias(n) for n, c in _target(F.col("codeto")).items()],
        bound("datefrom").alias("date_from"), bound("dateto").alias("date_to"), F.lit(0.0).alias("h_error"), F.lit(0.0).alias("v_error"),
    )
    good, bad = split_errors(out, ["code_from", "code_to"], "invalid recode")
    return good.drop("text"), bad


_RULE = (
    r"(?i)^recode\s+(\S+)\s+to\s+(\S+)(?:\s+([0-9.]+)(?:\s+([0-9.]+))?)?"
    r"(?:\s+(between|before|after)\s+(\S+)(?:\s+and\s+(\S+))?)?\s*$"
)


def recode_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recodes of ``recode A to B [h [v]] [between D and D | before D | after D]`` lines; errors are metres."""
    part = lambda i: F.regexp_extract("text", _RULE, i)
    when = F.lower(part(5))
    first, second = _as_ts(parse_date(part(6))), _as_ts(parse_date(part(7)))
    h = F.coalesce(part(3).try_cast("double"), F.lit(0.0))
    out = uncomment(lines).filter("text <> ''").select(
        "file", "line_no", "text",
        F.nullif(part(1), F.lit("")).alias("code_from"), *[F.when(F.col("text").rlike(_RULE), c).alias(n) for n, c in _target(part(2)).items()],
        F.when(when.isin("between", "after"), first).alias("date_from"), F.when(when == "between", second).when(when == "before", first).alias("date_to"),
        h.alias("h_error"), F.coalesce(part(4).try_cast("double"), h).alias("v_error"),
        F.when(when != "", first.isNotNull()).otherwise(True).alias("_dated"),
    )
    good, bad = split_errors(out.withColumn("_dated", F.when(F.col("_dated"), True)), ["code_from", "code_to", "_dated"], "invalid recode")
    return good.drop("text", "_dated"), bad


def offset_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Station offset components, one per line.

    ``code [enu|xyz|height] [offset|deformation] [step|velocity|time_series]`` and then a date with values, or for a
    series its base values followed by dated values. Heights have one value instead of three.
    """
    text = uncomment(lines).filter("text <> ''").withColumn("_f", fields(F.col("text")))
    words = F.lower(F.get("_f", F.lit(1)))
    frame = F.when(words.isin("enu", "xyz", "height"), words)
    text = text.withColumn("frame", F.coalesce(frame, F.lit("enu"))).withColumn("_i", F.when(frame.isNotNull(), 2).otherwise(1))
    kind = F.lower(F.get("_f", F.col("_i")))
    kind = F.when(kind.isin("offset", "deformation"), kind)
    text = text.withColumn("kind", F.coalesce(kind, F.lit("offset"))).withColumn("_i", F.col("_i") + F.when(kind.isNotNull(), 1).otherwise(0))
    mode = F.lower(F.get("_f", F.col("_i")))
    mode = F.when(mode.isin("step", "velocity", "time_series"), mode)
    text = text.withColumn("mode", F.coalesce(mode, F.lit("step"))).withColumn("_i", F.col("_i") + F.when(mode.isNotNull(), 1).otherwise(0))
    series = F.col("mode") == "time_series"
    n = F.when(F.col("frame") == "height", 1).otherwise(3)
    number = lambda i: F.get("_f", i).try_cast("double")
    zero = F.lit(0.0)

    def values(start: Column) -> Column:
        three = F.array(number(start), number(start + 1), number(start + 2))
        one = F.array(zero, zero, number(start))
        return F.when(F.col("frame") == "height", one).otherwise(three)

    first = F.col("_i") + F.when(series, 0).otherwise(1)
    text = text.withColumns({"_n": n, "day": F.when(~series, parse_date(F.get("_f", F.col("_i")))), "base": values(first)})
    after = F.col("_i") + F.col("_n")
    count = F.when(series, F.floor((F.size("_f") - after) / (F.col("_n") + 1)).cast("int")).otherwise(0)
    text = text.withColumns({"_after": after, "_count": count})
    places = F.when(F.col("_count") > 0, F.sequence(F.lit(0), F.col("_count") - 1)).otherwise(F.array().cast("array<int>"))
    points = F.transform(
        places,
        lambda k: F.struct(
            parse_date(F.get("_f", F.col("_after") + k * (F.col("_n") + 1))).cast("double").alias("day"),
            values(F.col("_after") + k * (F.col("_n") + 1) + 1).alias("v"),
        ),
    )
    out = text.select(
        "file", "line_no", "text", F.get("_f", F.lit(0)).alias("code"), F.when(F.col("frame") == "xyz", "xyz").otherwise("enu").alias("frame"),
        (F.col("kind") == "deformation").alias("is_deformation"), F.when(series, "series").otherwise(F.col("mode")).alias("mode"), "day", "base",
        F.when(series, points).alias("points"),
        F.when((series | F.col("day").isNotNull()) & ~F.exists("base", lambda v: v.isNull()) & (~series | (F.col("_count") > 0)), True).alias("_ok"),
    )
    good, bad = split_errors(out, ["code", "_ok"], "invalid station offset")
    return good.drop("text", "_ok"), bad
