"""Size-checked broadcasts and salted joins for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
HOT_ROWS = 200_000
HOT_KEYS = 20_000


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its counted size allows it, else ``df`` as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the session's partitions: a small file is one split, and its one task would do all the work on its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join where a key may hold a large share of ``left``.

    Keys with more than ``hot_rows`` rows on the left are split into
    ``ceil(rows / hot_rows)`` salts by a hash of the ``spread`` columns and the
    matching right rows are repeated once per salt. Other keys use salt zero.
    The result is the plain join; only where the work happens changes.
    """
    keys = list(keys)
    sizes = (
        left.groupBy(*keys)
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") > hot_rows)
        .select(*keys, F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("int").alias("_salts"))
        # Only the hottest keys are split, so the table both sides read stays small whatever the data size;
        # an unsplit key is joined all the same. The order is total, so both sides see the same keys.
        .orderBy(F.col("_salts").desc(), *keys)
        .limit(HOT_KEYS)
    )
    left_s = left.join(F.broadcast(sizes), keys, "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread), F.col("_salts").cast("long")).cast("int")
        ),
    )
    right_s = right.join(F.broadcast(sizes), keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    return left_s.drop("_salts").join(right_s.drop("_salts"), [*keys, "_salt"], how).drop("_salt")
