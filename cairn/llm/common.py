"""Helpers the corpus operators share: table access, frozen results and statistics of very large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.lineage import cut

SALTS = 32


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def freeze(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder, so that every later reader sees the same rows."""
    return cut(df)


def text_key(text: Column) -> Column:
    """Names a text within one ``doc_id``; with the id it tells apart rows that repeat an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def with_group_stats(
    df: DataFrame, keys: Sequence[str], stats: dict[str, tuple[str, Column]], spread: Sequence[str], salts: int = SALTS
) -> DataFrame:
    """``df`` with one value per group in each column of ``stats``.

    ``stats`` maps a new column to ``(count | sum | min | max, column)``. A group's
    rows are dealt over at most ``salts`` parts by a hash of ``spread``, counted part
    by part and joined back part by part, so a group that holds a third of all rows
    meets in no task; only its at most ``salts`` partial results do. Keys are not null.
    """
    merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    part = dealt.groupBy(*keys, "_salt").agg(*[first[kind](c).alias(n) for n, (kind, c) in stats.items()])
    whole = part.groupBy(*keys).agg(
        *[merge[kind](n).alias(n) for n, (kind, _) in stats.items()], F.collect_list("_salt").alias("_salts")
    )
    back = whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return dealt.join(back, [*keys, "_salt"]).drop("_salt")


def components(edges: DataFrame, salts: int = SALTS) -> DataFrame:
    """``(node, component)`` of every node in ``edges(a, b)``; a component is named by its smallest node.

    Large-star and small-star steps in turn (Kiveris et al. 2014). Each step needs the
    least neighbour of a node on all its edges, which ``with_group_stats`` attaches
    without gathering the edges of a hub. Rounds go on until one changes nothing.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    work = freeze(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        star = with_group_stats(both, ["a"], {"_m": ("min", F.col("b"))}, ["b"], salts).withColumn("_m", F.least("a", "_m"))
        large = star.filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").distinct()
        low = with_group_stats(large, ["a"], {"_m": ("min", F.col("b"))}, ["b"], salts)
        small = low.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("_m").alias("b")), F.struct("a", F.col("_m").alias("b")))).alias("e")).select("e.a", "e.b")
        work = freeze(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        seen = work.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return nodes.join(work.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
