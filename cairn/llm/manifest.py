"""Merkle manifest of a dataset: a content-addressed store of nodes, and proofs by descent through it.

Each row is a leaf, the SHA-256 of its fields. The leaves of a source, in the order of their ids, are hashed
together ``FANOUT`` at a time, level by level, into the source's subroot; the subroots, in the order of their
sources, likewise into the root. ``build`` writes a record digest -> children for every inner node, by height.

``prove`` answers leaf requests by going down from the root. A request's path is the digits of its source's
rank, then those of its own rank within the source. Requests with equal leading digits stand on the same node, so
they go down together as one row: each step looks the node's digest up in the store, picks the child its next digit
names and appends the children it did not pick to the path as one segment. At the lowest height a row answers the
requests of one run of leaves. Reversed, the segments fold a leaf back into the root.

Ranks come from a range partitioning, so a source of any size is ranked and hashed by many tasks; no group has
more than ``FANOUT`` members. Texts are hashed once and are not shuffled. Null ids come first in a source, the null
source first of all; rows that share an id are ordered by their leaf. Rows alike in every field are leaves
of their own with equal digests. A field that the table lacks counts as null. Of other columns none is read. Very
long texts are hashed whole. An empty table has no nodes and its root is null.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import freeze, with_group_stats
from cairn.plans.lineage import ensure_checkpoint_dir
from cairn.plans.ordered import number_rows

FANOUT = 16
SALTS = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its length in bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts), 256)


def _digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


@dataclass
class Manifest:
    """``folder`` holds the store; ``sources`` has a row per source, ``runs`` one per run of ``FANOUT`` leaves."""

    spark: SparkSession
    folder: str
    heights: int  # of the highest source
    top_heights: int  # of the tree over sources
    sources: DataFrame  # first, source, leaves, height, subroot, place
    runs: DataFrame  # first, at, members: rank, key, id, leaf, and what was carried
    root: str | None

    def records(self, height: int) -> DataFrame:
        """``digest -> children``; heights above ``heights`` are the tree over sources."""
        return self.spark.read.schema("digest string, children array<string>").parquet(f"{self.folder}/height={height}")


def _height(leaves: Column) -> Column:
    """Levels of runs that ``leaves`` nodes need to become one."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(16)), F.struct(leaves.alias("n"), F.lit(0).alias("h")),
        lambda s, _: F.struct(F.ceil(s["n"] / F.lit(FANOUT)).cast("long").alias("n"), (s["h"] + (s["n"] > 1).cast("int")).alias("h")),
    )["h"]


def _climb(nodes: DataFrame, group: list[str], write) -> DataFrame:
    """The next height: runs of ``nodes(group, at, digest)`` become one node each; their records are written."""
    run = F.floor(F.col("at") / F.lit(FANOUT)).alias("at")
    up = nodes.groupBy(*group, run).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]).alias("children"))
    return write(up.withColumn("digest", _digest(F.col("children"))))


def build(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: Sequence[str] = FIELDS, carry: dict[str, Column] | None = None) -> Manifest:
    """Hash ``docs`` into a manifest; ``carry`` adds columns to the members of ``runs``."""
    spark, names = docs.sparkSession, [c.lower() for c in docs.columns]
    folder = f"{ensure_checkpoint_dir(spark)}/manifest-{uuid.uuid4().hex}"
    cells = [F.col(f) if f.lower() in names else F.lit(None).cast("string") for f in fields]
    carry = carry or {}
    leaves = freeze(
        docs.select(
            F.col(source_col).isNotNull().alias("_known"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_name"), F.col(id_col).alias("id"),
            leaf_digest(cells).alias("leaf"), *[c.alias(f"_{n}") for n, c in carry.items()],
        )
    )
    # Rows alike in all of these are interchangeable; the last column deals even those over several partitions.
    ranked = number_rows(leaves.withColumn("_any", F.monotonically_increasing_id()), ["_known", "_name", "id", "leaf", *[f"_{n}" for n in carry], "_any"], "_n").drop("_any")
    placed = with_group_stats(ranked, ["_known", "_name"], {"first": ("min", F.col("_n")), "leaves": ("count", F.lit(1))}, ["_n"], SALTS)
    member = F.struct((F.col("_n") - F.col("first")).alias("rank"), "id", "leaf", *[F.col(f"_{n}").alias(n) for n in carry])
    runs = freeze(
        placed.groupBy("first", F.floor((F.col("_n") - F.col("first")) / F.lit(FANOUT)).alias("at"))
        .agg(F.array_sort(F.collect_list(member)).alias("members"), F.first("leaves").alias("leaves"), F.first(F.when(F.col("_known"), F.col("_name"))).alias("source"))
    )
    sources = runs.filter("at = 0").select("first", "source", "leaves", _height(F.col("leaves")).alias("height"))
    sources = freeze(number_rows(sources, ["first"], "place"))
    size = sources.agg(F.max("height"), F.count("*")).first()
    heights, count = size[0] or 0, size[1]

    def store(height: int):
        def write(up: DataFrame) -> DataFrame:
            up = freeze(up)
            up.select("digest", "children").dropDuplicates(["digest"]).write.parquet(f"{folder}/height={height}")
            return up.drop("children")

        return write

    done, nodes = [runs.filter("leaves = 1").select("first", F.col("members")[0]["leaf"].alias("subroot"))], None
    for height in range(1, heights + 1):
        if height == 1:
            tall = runs.filter(F.col("leaves") > 1).select("first", "at", "leaves", F.transform("members", lambda m: m["leaf"]).alias("children"))
            nodes = store(1)(tall.withColumn("digest", _digest(F.col("children"))))
        else:
            nodes = _climb(nodes.filter(F.col("leaves") > FANOUT ** (height - 1)), ["first", "leaves"], store(height))
        done.append(nodes.filter(F.col("leaves") <= FANOUT**height).select("first", F.col("digest").alias("subroot")))
    subroots = done[0]
    for more in done[1:]:
        subroots = subroots.unionByName(more)
    sources = freeze(sources.join(subroots, "first"))
    top, top_heights = sources.select(F.col("place").alias("at"), F.col("subroot").alias("digest")), 0
    while FANOUT**top_heights < count:
        top_heights += 1
        top = _climb(top, [], store(heights + top_heights))
    root = top.first()["digest"] if count else None
    return Manifest(spark, folder, heights, top_heights, sources, runs, root)


def _segment(children: Column, digit: Column) -> Column:
    """The children beside the one at ``digit``, joined: those before and those after it."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), digit), "").alias("before"), F.array_join(F.slice(children, digit + 2, F.lit(FANOUT)), "").alias("after"))


def _look_up(nodes: DataFrame, records: DataFrame, spread: list[str]) -> DataFrame:
    """``nodes`` with the children that the store has under their digest.

    Equal nodes recur only where rows are alike in every field; a digest is then asked for by parts.
    """
    dealt = nodes.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    asked = dealt.select("digest", "_part").distinct().join(records, "digest")
    return dealt.join(asked, ["digest", "_part"]).drop("_part")


def _step(state: DataFrame, manifest: Manifest, height: int, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """From the nodes of ``height`` to those of their children that ``wanted(keys, at)`` has."""
    digit = (F.col("at") % FANOUT).cast("int")
    next_ = wanted.withColumn("_up", F.floor(F.col("at") / F.lit(FANOUT))).join(state.withColumnRenamed("at", "_up"), [*keys, "_up"])
    found = _look_up(next_, manifest.records(height), [*keys, "at"])
    return freeze(found.select(*keys, "at", F.element_at("children", digit + 1).alias("digest"), F.concat("path", F.array(_segment(F.col("children"), digit))).alias("path")))


def _prefixes(places: DataFrame, keys: list[str], height: int) -> DataFrame:
    return places.select(*keys, F.floor(F.col("at") / F.lit(FANOUT**height)).alias("at")).distinct()


def prove(manifest: Manifest, runs: DataFrame | None = None) -> DataFrame:
    """``(first, member, path)`` of every leaf in ``runs`` (all): segments ``(before, after)`` from the leaf up to the root.

    ``runs`` is some of ``manifest.runs`` with some of their members.
    """
    runs = manifest.runs if runs is None else runs
    spark, empty = manifest.spark, "CAST(array() AS array<struct<before: string, after: string>>)"
    asked = manifest.sources.join(runs.select("first").distinct(), "first", "left_semi").select(F.col("place").alias("at"), "first", "height", "subroot")
    state = spark.range(1).select(F.col("id").alias("at"), F.lit(manifest.root).cast("string").alias("digest"), F.expr(empty).alias("path"))
    for height in range(manifest.top_heights, 0, -1):
        state = _step(state, manifest, manifest.heights + height, _prefixes(asked, [], height - 1), [])
    at_source = freeze(state.join(asked.select("at", "first", "height"), "at").select("first", "height", F.lit(0).cast("long").alias("at"), "digest", "path"))
    state = at_source.filter(F.col("height") == manifest.heights).drop("height")
    for height in range(manifest.heights, 1, -1):
        tall = runs.filter(F.col("leaves") > FANOUT ** (height - 1))
        state = _step(state, manifest, height, _prefixes(tall.select("first", "at"), ["first"], height - 2), ["first"])
        state = state.unionByName(at_source.filter(F.col("height") == height - 1).drop("height"))
    # A lone leaf is its source's subroot: it has no run to pick from.
    last = at_source.filter("height = 0").select("first", "at", "path", F.lit(None).cast("array<string>").alias("children"))
    if manifest.heights:
        last = last.unionByName(_look_up(state, manifest.records(1), ["first", "at"]).select("first", "at", "path", "children"))
    each = runs.join(last, ["first", "at"]).select("first", "source", "path", "children", F.explode("members").alias("member"))
    digit = (F.col("member")["rank"] % FANOUT).cast("int")
    own = F.when(F.col("children").isNull(), F.expr(empty)).otherwise(F.array(_segment(F.col("children"), digit)))
    return each.select("first", "source", "member", F.reverse(F.concat("path", own)).alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the segments above it give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def audit(docs: DataFrame, found: Column, id_col: str = "doc_id", source_col: str = "source", fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The manifest is that of ``docs``; ``found`` is the leaf digest met later, null where the row is as it was.
    """
    manifest = build(docs, id_col, source_col, fields, {"found": found})
    proofs = prove(manifest).join(manifest.sources.select("first", "subroot"), "first")
    leaf = F.col("member")["leaf"]
    return proofs.select(
        F.col("member")["id"].alias(id_col), leaf.alias("leaf"), "subroot", F.lit(manifest.root).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce(F.col("member")["found"], leaf), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_audit(docs: DataFrame) -> DataFrame:
    """``audit`` of documents of which those whose id's CRC-32 is a multiple of 5 had A-Z in their text lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    cells = [F.translate("text", upper, upper.lower()) if f == "text" else F.col(f) for f in FIELDS]
    return audit(docs, F.when(hit & F.col("text").rlike("[A-Z]"), leaf_digest(cells)))
