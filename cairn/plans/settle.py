"""Evaluate computed columns once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The same rows, with ``columns`` computed here once.

    The planner moves filters below projections by copying the expressions they test, and a long parse or a
    geodetic formula copied into several filters costs more than the rows it drops. It does not move filters on
    a generator's output, so the columns pass through a one-element generator; the rest keep their pushdown.
    """
    names = list(columns or df.columns)
    rest = [c for c in df.columns if c not in names]
    out = df.select(*rest, F.inline_outer(F.array(F.struct(*[F.col(n) for n in names]))))
    return out.select(*df.columns)
