"""Text lines of many files as tables: comments, fields, and errors kept beside good rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.plans.ordered import read_numbered_lines
from cairn.plans.settle import settle

# A numbered line is (file, line_no, text).


def read_lines(spark, paths) -> DataFrame:
    return read_numbered_lines(spark, paths)


def uncomment(lines: DataFrame, mark: str = "!") -> DataFrame:
    """Cut each line at the comment mark and trim it; blank lines stay, as they can close a set."""
    body = F.trim(F.substring_index("text", mark, 1))
    return lines.withColumn("text", body)


def fields(text: Column) -> Column:
    """Blank-separated fields of a line."""
    return F.split(F.trim(text), r"\s+")


def field(parts: Column, i: int) -> Column:
    """Field ``i`` counted from one; null past the end."""
    return F.get(parts, F.lit(i - 1))


def split_errors(parsed: DataFrame, required: Sequence[str], message: str) -> tuple[DataFrame, DataFrame]:
    """Rows with every required value, and ``(file, line_no, text, error)`` of the others."""
    parsed = settle(parsed)
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    bad = parsed.filter(~ok).select(
        "file", "line_no", "text", F.concat(F.lit(message + ": "), missing).alias("error")
    )
    return parsed.filter(ok), bad


def error_counts(errors: DataFrame) -> DataFrame:
    """Errors per file with the first place and message."""
    return errors.groupBy("file").agg(
        F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.min_by("error", "line_no").alias("first_error")
    )


def register_files(observations: DataFrame, files: DataFrame) -> DataFrame:
    """Attach each file's id, format, recode name and error factor by its path.

    ``files(path, file_id, format, recode, factor)`` lists the job's inputs; rows of unlisted files drop out.
    """
    f = files.select(F.col("path").alias("file"), "file_id", "format", "recode", "factor")
    return observations.join(f, "file")
