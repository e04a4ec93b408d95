"""Named column stages.

Geodetic formulas reuse intermediate values many times. Writing them as one
expression would repeat those subtrees, so a formula is a list of stages, each a
mapping from new column names to Columns over the names defined before it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame

Stage = dict[str, Column]


def apply_stages(df: DataFrame, stages: Iterable[Stage], outputs: dict[str, str]) -> DataFrame:
    """Run ``stages`` over ``df`` and keep its columns plus ``outputs`` (stage name -> final name)."""
    keep = [c for c in df.columns if c not in outputs.values()]
    out = df
    for stage in stages:
        out = out.withColumns(stage)
    return out.select(*keep, *[out[name].alias(final) for name, final in outputs.items()])
