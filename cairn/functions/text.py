"""Station-code ordering, wildcards and class-name clean-up as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(code: Column) -> Column:
    """Sort key under which codes order case-blind with the first digit run read as a number.

    The prefix gets a trailing ``0`` when digits follow so that it still sorts
    against codes whose prefix goes on with punctuation.
    """
    lower = F.lower(code)
    prefix = F.regexp_extract(lower, r"^(\D*)", 1)
    digits = F.regexp_extract(lower, r"^\D*(\d+)", 1)
    rest = F.regexp_extract(lower, r"^\D*(\d.*)$", 1)
    has_digits = digits != ""
    return F.struct(
        F.when(has_digits, F.concat(prefix, F.lit("0"))).otherwise(prefix).alias("prefix"),
        F.when(has_digits, digits.try_cast("decimal(38,0)")).otherwise(F.lit(-1).cast("decimal(38,0)")).alias("number"),
        rest.alias("rest"),
    )


def wildcard_regex(pattern: str) -> str:
    """Regular expression for a pattern in which ``*`` is any run and ``?`` any one character."""
    out = []
    for ch in pattern:
        out.append(".*" if ch == "*" else "." if ch == "?" else re.escape(ch))
    return "(?is)^" + "".join(out) + "$"


def matches_wildcard(value: Column, pattern: str) -> Column:
    return value.rlike(wildcard_regex(pattern))


def path_matches_wildcard(path: Column, pattern: str) -> Column:
    """True when the pattern matches the path or any suffix of it that starts after a separator."""
    body = wildcard_regex(pattern)[len("(?is)^"):]
    return path.rlike("(?is)^(.*[/\\\\])?" + body)


def clean_class_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"\s+", "_")


def natural_code(code: str) -> tuple:
    """The driver-side value of :func:`natural_key` for a literal code."""
    lower = code.lower()
    m = re.match(r"^(\D*)(\d*)(.*)$", lower, re.S)
    prefix, digits, tail = m.groups()
    return (prefix + "0", int(digits), digits + tail) if digits else (prefix, -1, "")


def natural_literal(code: str) -> Column:
    prefix, number, rest = natural_code(code)
    return F.struct(
        F.lit(prefix).alias("prefix"),
        F.lit(str(number)).cast("decimal(38,0)").alias("number"),
        F.lit(rest).alias("rest"),
    )
