"""Ordered operations over long runs of rows without a window over a whole run.

A file (or any other group) may hold a third of all rows, so a window
partitioned by it alone would land in one task. Each helper splits the group
into fixed-length blocks of consecutive positions, works inside the blocks,
then carries a one-row summary per block across them. The summary is smaller
than the input by the block length, and only that is ordered per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def _blocked(df: DataFrame, position: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(position) / F.lit(block)))


def carry_forward(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    values: dict[str, Column],
    block: int = BLOCK,
) -> DataFrame:
    """Add, for every name in ``values``, the last non-null value up to and including the row."""
    group = list(group)
    work = _blocked(df, position, block)
    for name, column in values.items():
        work = work.withColumn(f"_src_{name}", column)
    inside = (
        Window.partitionBy(*group, "_block")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summary = work.groupBy(*group, "_block").agg(
        *[
            F.max_by(F.col(f"_src_{n}"), F.when(F.col(f"_src_{n}").isNotNull(), F.col(position))).alias(f"_end_{n}")
            for n in values
        ]
    )
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *group,
        "_block",
        *[F.last(F.col(f"_end_{n}"), ignorenulls=True).over(before).alias(f"_in_{n}") for n in values],
    )
    out = work
    for name in values:
        out = out.withColumn(f"_here_{name}", F.last(F.col(f"_src_{name}"), ignorenulls=True).over(inside))
    out = out.join(carried, [*group, "_block"], "left")
    for name in values:
        out = out.withColumn(name, F.coalesce(F.col(f"_here_{name}"), F.col(f"_in_{name}")))
    scratch = ["_block"]
    for name in values:
        scratch += [f"_src_{name}", f"_here_{name}", f"_in_{name}"]
    return out.drop(*scratch)


def running_sum(
    df: DataFrame, group: Sequence[str], position: str, value: Column, name: str, block: int = BLOCK
) -> DataFrame:
    """Add ``name``: the sum of ``value`` from the start of the group up to the row."""
    group = list(group)
    work = _blocked(df, position, block).withColumn("_v", value)
    inside = (
        Window.partitionBy(*group, "_block")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = work.groupBy(*group, "_block").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_block", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    return (
        work.withColumn("_s", F.sum("_v").over(inside))
        .join(offsets, [*group, "_block"], "left")
        .withColumn(name, F.col("_s") + F.col("_o"))
        .drop("_block", "_v", "_s", "_o")
    )


def previous_value(
    df: DataFrame, group: Sequence[str], position: str, values: dict[str, Column], block: int = BLOCK
) -> DataFrame:
    """Add, for every name in ``values``, the value on the row just before in the group."""
    group = list(group)
    work = _blocked(df, position, block).withColumn(
        "_row", F.struct(*[column.alias(name) for name, column in values.items()])
    )
    inside = Window.partitionBy(*group, "_block").orderBy(position)
    ends = work.groupBy(*group, "_block").agg(F.max_by("_row", F.col(position)).alias("_end"))
    over_blocks = Window.partitionBy(*group).orderBy("_block")
    carried = ends.select(*group, "_block", F.lag("_end").over(over_blocks).alias("_in"))
    out = (
        work.withColumn("_before", F.lag("_row").over(inside))
        .join(carried, [*group, "_block"], "left")
        .withColumn("_before", F.coalesce("_before", "_in"))
    )
    for name in values:
        out = out.withColumn(name, F.col("_before")[name])
    return out.drop("_block", "_row", "_before", "_in")


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0) -> DataFrame:
    """Add consecutive numbers in ``order`` using a range partitioning instead of one global sort.

    ``df`` is evaluated once: the sorted rows are written to the checkpoint
    folder, so the partition a row is counted in is the one it is numbered in.
    """
    from cairn.plans.lineage import cut

    ranged = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
        .withColumn("_p", F.shiftright(F.col("_m"), 33))
    )
    # One row per partition of the range exchange: bounded by the shuffle width.
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    first = F.shiftleft(F.col("_p"), 33)
    return (
        ranged.join(F.broadcast(offsets), "_p")
        .withColumn(name, F.col("_m") - first + F.col("_o") + F.lit(start))
        .drop("_m", "_p", "_o")
    )


def read_numbered_lines(spark, paths) -> DataFrame:
    """Text files as (file, line_no, text), numbered inside each file.

    Every scan split keeps its rows in file order, so a line's number is its
    place in the split plus the lines of the splits before it; no file is
    pulled through one task.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_m"),
        F.col("value").alias("text"),
    )
    splits = lines.groupBy("file", "_start").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(splits, ["file", "_start"]).select(
        "file", (F.col("_m") - F.col("_first") + F.col("_o") + 1).alias("line_no"), "text"
    )
