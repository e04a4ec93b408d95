"""Merging coordinate tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A station here has code, name, lon, lat, ohgt, und and classes (map of strings).
FIELDS = ("name", "lon", "lat", "ohgt", "und")


@dataclass(frozen=True)
class MergeOptions:
    overwrite: bool = False
    add_new: bool = True
    coords: bool = False
    geoid: bool = False
    classes: bool = False
    add_classes: bool = False
    height: str = "default"  # which height survives a coordinate update: default, ellipsoidal, orthometric
    base_has_geoid: bool = True
    data_has_geoid: bool = True
    base_ellipsoidal: bool = False
    data_ellipsoidal: bool = False

    @property
    def keeps_ellipsoidal(self) -> bool:
        if self.height != "default":
            return self.height == "ellipsoidal"
        from_data = not self.data_has_geoid and self.data_ellipsoidal and self.base_has_geoid
        from_base = self.data_has_geoid and self.base_ellipsoidal and not self.base_has_geoid
        return from_data or from_base


def merge_stations(
    base: DataFrame,
    data: DataFrame,
    options: MergeOptions,
    only: DataFrame | None = None,
    base_classes: Sequence[str] | None = None,
) -> DataFrame:
    """``base`` updated from ``data``, already in the base's coordinate system.

    ``only(code)`` restricts which data stations take part. ``base_classes`` names the classes the base
    knows; others come over only with ``add_classes``.
    """
    if only is not None:
        data = data.join(only.select("code").distinct(), "code", "left_semi")
    und = F.col("und") if options.data_has_geoid else F.lit(0.0)
    ohgt = F.col("ohgt")
    if not options.data_has_geoid and options.data_ellipsoidal:
        ohgt = F.col("ohgt") + F.col("und")
    incoming = data.select(
        "code", F.lit(True).alias("d_here"), F.col("name").alias("d_name"), F.col("lon").alias("d_lon"),
        F.col("lat").alias("d_lat"), ohgt.alias("d_ohgt"), und.alias("d_und"), F.col("classes").alias("d_classes"),
    )
    if base_classes is not None and not options.add_classes:
        known = F.array(*[F.lit(c) for c in base_classes])
        incoming = incoming.withColumn("d_classes", F.map_filter("d_classes", lambda k, v: F.array_contains(known, k)))
    joined = base.withColumn("b_here", F.lit(True)).join(incoming, "code", "full_outer")
    both = F.col("b_here").isNotNull() & F.col("d_here").isNotNull()
    new = F.col("b_here").isNull()
    replace = new | (both if options.overwrite else F.lit(False))
    move = both & F.lit((options.coords or options.geoid) and not options.overwrite)
    height = F.col("d_ohgt")
    if options.keeps_ellipsoidal and not options.geoid:
        height = F.col("d_ohgt") + F.col("d_und") - F.col("und")
    join_classes = F.map_concat(
        F.map_filter("classes", lambda k, v: ~F.map_contains_key("d_classes", k)), F.col("d_classes")
    )
    take_classes = both & F.lit(options.classes and not options.overwrite)
    out = joined.select(
        "code",
        F.when(replace, F.col("d_name")).otherwise(F.col("name")).alias("name"),
        F.when(replace | move, F.col("d_lon")).otherwise(F.col("lon")).alias("lon"),
        F.when(replace | move, F.col("d_lat")).otherwise(F.col("lat")).alias("lat"),
        F.when(replace, F.col("d_ohgt")).when(move, height).otherwise(F.col("ohgt")).alias("ohgt"),
        F.when(replace | (move & F.lit(options.geoid)), F.col("d_und")).otherwise(F.col("und")).alias("und"),
        F.when(replace, F.col("d_classes")).when(take_classes, join_classes).otherwise(F.col("classes")).alias("classes"),
        new.alias("_new"),
    )
    if not options.add_new:
        out = out.filter(~F.col("_new"))
    return out.drop("_new")


def add_coordinate_files(tables: Sequence[DataFrame], later_wins: bool = True) -> DataFrame:
    """Several coordinate tables in order, one row per code, in a single pass over their union."""
    united = None
    for place, table in enumerate(tables):
        part = table.withColumn("_place", F.lit(place))
        united = part if united is None else united.unionByName(part, allowMissingColumns=True)
    fields = [c for c in united.columns if c not in ("code", "_place")]
    pick = F.max_by if later_wins else F.min_by
    return united.groupBy("code").agg(pick(F.struct(*fields), F.col("_place")).alias("_s")).select("code", "_s.*")


def remove_duplicates(stations: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """One row per code (case-blind), the first in ``order``; and the codes that had more, with their counts."""
    fields = stations.columns
    grouped = stations.groupBy(F.lower("code").alias("_key")).agg(
        F.min_by(F.struct(*fields), F.col(order)).alias("_s"), F.count("*").alias("n")
    )
    return grouped.select("_s.*"), grouped.filter("n > 1").select(F.col("_s.code").alias("code"), "n")


def clear_class(stations: DataFrame, name: str) -> DataFrame:
    """Drop a class, such as the order, from every station."""
    return stations.withColumn("classes", F.map_filter("classes", lambda k, v: F.lower(k) != name.lower()))


def set_class(stations: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Write ``values(code, value)`` into a class, keeping the class of stations that have no value."""
    out = stations.join(values.select("code", F.col("value").alias("_v")), "code", "left")
    changed = F.map_concat(
        F.map_filter("classes", lambda k, v: F.lower(k) != name.lower()),
        F.create_map(F.lit(name), F.col("_v").cast("string")),
    )
    return out.withColumn("classes", F.when(F.col("_v").isNotNull(), changed).otherwise(F.col("classes"))).drop("_v")


def write_by_order(stations: DataFrame, path: str, column: str = "order") -> None:
    """One folder per order."""
    stations.write.mode("overwrite").partitionBy(column).parquet(path)


def sort_stations(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Station listing order; codes order naturally and ties fall back to the code."""
    from cairn.functions.text import natural_key

    key = natural_key(F.col("code"))
    first = key if by == "code" else F.col(by)
    return df.orderBy(first.desc() if descending else first.asc(), key)


def sort_observations(df: DataFrame, by: str = "line", normalise: bool = True, ties: Sequence[str] = ("obs_key",)) -> DataFrame:
    """Observations by line then type, by type then line, or by any column, with the earlier order for ties."""
    a = F.least("from_code", "to_code") if normalise else F.col("from_code")
    b = F.greatest("from_code", "to_code") if normalise else F.col("to_code")
    if by == "line":
        keys = [a, b, F.col("obs_type")]
    elif by == "type":
        keys = [F.col("obs_type"), a, b]
    else:
        keys = [F.col(by).desc_nulls_last()]
    return df.orderBy(*keys, *ties)


def first_of_set(df: DataFrame, set_id: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Carry the first member's value to every row of its set, as for a round's reference direction.

    The first value is a combinable aggregate joined back, so a set of any size stays spread out.
    """
    first = df.filter(F.col(set_id).isNotNull()).groupBy(set_id).agg(F.min_by(F.col(value), F.struct(*order)).alias(name))
    # A row without a set is a set by itself.
    return df.join(first, set_id, "left").withColumn(name, F.when(F.col(set_id).isNull(), F.col(value)).otherwise(F.col(name)))

