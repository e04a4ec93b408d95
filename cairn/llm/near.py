"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

Words are lower-case; an n-gram is a run of ``size`` words (a shorter text is one n-gram).
Texts with the same n-gram set form a copy class, kept as one row with its number of rows.
Band and row counts follow from the recall wanted at the threshold; classes are shuffled
on band hashes; buckets that hold the same classes in several bands are joined once. Pairs
are verified inside bucket cells on whole n-gram sets (64-bit hashes) and counted there
rather than written out, so a class of ten thousand near copies gives ten thousand rows, not
fifty million. A bucket of any size is cut into blocks and its block pairs into cells of
bounded size; no bucket, partner or candidate is left out. Links within a cell are passed on as one
root per row; classes of documents are their connected components.

A text without words (null, empty, punctuation) has no n-grams: it is a class of its own with
no links. Rows that repeat id and text share their class and count each other as links. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import textvec as V
from cairn.llm.common import components, freeze, text_key, with_group_stats

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 128
BLOCK_ROWS = 512
BLOCK_GRAMS = 1 << 19
_COLUMNS = 2048


def bands_and_rows(threshold: float, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """The most selective ``(bands, rows)`` of at most ``most`` hashes that find a pair at ``threshold`` with ``recall``."""
    best = None
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def _signatures(size: int, bands: int, rows: int):
    multiply, add = V.constants(bands * rows, 101), V.constants(bands * rows, 211)
    fold, salt = V.constants(rows, 307), V.constants(bands, 401)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch.column(2)):
                grams, offsets = V.shingles(V.words(part), size)
                counts = np.diff(offsets)
                full = counts > 0
                heads = offsets[:-1][full]
                least = np.zeros((bands * rows, len(heads)), np.uint64)
                for k in range(bands * rows) if len(heads) else ():
                    least[k] = np.minimum.reduceat(grams * multiply[k] + add[k], heads)
                keys = V.mix((least.reshape(bands, rows, -1) * fold[None, :, None]).sum(axis=1, dtype=np.uint64) + salt[:, None])
                sets, sizes = [None] * len(counts), np.zeros(len(counts), np.int64)
                for i in np.flatnonzero(full):
                    own = np.unique(grams[offsets[i] : offsets[i + 1]])
                    sets[i], sizes[i] = hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(own)
                at = np.concatenate(([0], np.cumsum(np.where(full, bands, 0)))).astype(np.int32)
                rows_ = batch.slice(part.first, len(counts))
                yield pa.RecordBatch.from_arrays(
                    [rows_.column(0), rows_.column(1), pa.array(sets, pa.binary()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.T.ravel().view(np.int64)))],
                    names=["doc_id", "text_key", "cls", "grams", "bands"],
                )

    return run


def _gram_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch.column(0)):
                grams, offsets = V.shingles(V.words(part), size)
                sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                rest = batch.slice(part.first, len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *rest.columns[1:]], names=["grams", *batch.schema.names[1:]])

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two of the sets share."""
    if len(sets) == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]], np.float32)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    place = np.cumsum(several) - 1
    use = several[column]
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = int(several.sum())
    for first in range(0, width, _COLUMNS):
        a, b = np.searchsorted(column, (first, first + _COLUMNS))
        some = np.zeros((len(sets), min(_COLUMNS, width - first)), np.float32)
        some[row[a:b], column[a:b] - first] = 1
        out += some @ some.T
    return out


def _links(members: list[tuple], bucket: int, low: int, high: int, threshold: float) -> list[tuple]:
    """Links of one cell: ``(class, linked classes, linked rows, root class)`` of each class that has any."""
    members = list({m[0]: m for m in members}.values())
    if len(members) < 2:
        return []
    sets = [np.frombuffer(m[3], np.uint64) for m in members]
    shared = _shared(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    block = np.array([m[1] for m in members])
    if low != high:
        linked &= block[:, None] != block[None, :]
    # A pair that meets in several joined buckets belongs to the one with the smallest name.
    earlier: dict[int, list[int]] = {}
    for i, m in enumerate(members):
        for name in m[4]:
            if name < bucket:
                earlier.setdefault(name, []).append(i)
    for own in earlier.values():
        if len(own) > 1:
            linked[np.ix_(own, own)] = False
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return []
    linked = linked[np.ix_(some, some)]
    copies = np.array([members[i][2] for i in some], np.int64)
    root = np.arange(len(some))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(some)).min(axis=1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    texts, rows = linked.sum(axis=1), linked @ copies
    return [(members[i][0], int(texts[k]), int(rows[k]), members[some[root[k]]][0]) for k, i in enumerate(some)]


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, members, out = None, [], []

        def full(rows: list[tuple]) -> pa.RecordBatch:
            names, texts, docs, roots = zip(*rows) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(texts, pa.int64()), pa.array(docs, pa.int64()), pa.array(roots, pa.binary())], names=["cls", "texts", "rows", "root"])

        for batch in batches:
            # Small pieces: a batch of sets may be large, and Python copies of it larger.
            for first in range(0, batch.num_rows, 64):
                c = batch.slice(first, 64).to_pydict()
                for row in zip(c["bucket"], c["low"], c["high"], c["cls"], c["block"], c["copies"], c["grams"], c["buckets"]):
                    if row[:3] != cell:
                        if members:
                            out += _links(members, *cell, threshold)
                        cell, members = row[:3], []
                    members.append(row[3:])
            if len(out) > 4096:
                yield full(out)
                out = []
        if members:
            out += _links(members, *cell, threshold)
        yield full(out)

    return run


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL,
    block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id of its class), n_links (other rows at or above
    the threshold, copies included), n_texts (other n-gram sets linked), copies, keep_id (largest id of the class), text_key,
    keep_key (text_key of the row that stays, the largest of those with the largest id)."""
    bands, rows = bands_and_rows(threshold, recall)
    text = F.lower(F.col(text_col).cast("string"))
    signed = freeze(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col).cast("string")).alias("text_key"), text.alias("text")).mapInArrow(
            _signatures(size, bands, rows), "doc_id long, text_key long, cls binary, grams long, bands array<long>"
        )
    )
    classes = freeze(
        signed.filter("grams > 0").groupBy("cls").agg(
            F.min(F.struct("doc_id", "text_key")).alias("_as"), F.min("doc_id").alias("least_id"),
            F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_key")).alias("most"),
            F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"),
        )
    )
    members = classes.select("cls", "grams", F.explode(F.array_distinct("bands")).alias("bucket"))
    mark = F.xxhash64("cls")
    shared = members.groupBy("bucket").agg(
        F.count("*").alias("_n"), F.sum("grams").alias("_grams"), F.min(mark).alias("_least"), F.max(mark).alias("_most"), F.bit_xor(mark).alias("_x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("_y")
    ).filter("_n > 1")
    # Buckets of several bands with the same members are joined once.
    joined = freeze(
        shared.groupBy("_n", "_grams", "_least", "_most", "_x", "_y").agg(F.min("bucket").alias("bucket")).select(
            "bucket", F.greatest(F.ceil(F.col("_n") / block_rows), F.ceil(F.col("_grams") / block_grams)).cast("int").alias("blocks")
        )
    )
    held = members.select("cls", "bucket").join(joined, "bucket").groupBy("cls").agg(F.collect_list(F.struct("bucket", "blocks")).alias("held"))
    repeats = signed.filter("grams > 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")).count().filter("count > 1")
    wanted = held.join(classes.select("cls", "_as", "copies"), "cls").select("cls", "copies", "held", F.col("_as.doc_id").alias("_id"), F.col("_as.text_key").alias("_text"))
    again = wanted["_id"].eqNullSafe(repeats["_id"]) & (wanted["_text"] == repeats["_text"])
    wanted = freeze(wanted.join(repeats, again, "left").select(*[wanted[c] for c in wanted.columns], F.col("count").isNotNull().alias("_again")))
    found = docs.select(text.alias("text"), F.col(id_col).cast("long").alias("_doc"), text_key(F.col(text_col).cast("string")).alias("_key")).join(
        wanted, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text"))
    )
    # Rows that repeat an id and text hold the same set; one of them goes to the cells.
    if not wanted.filter("_again").isEmpty():
        found = found.filter("NOT _again").unionByName(found.filter("_again").dropDuplicates(["cls"]))
    sets = found.select("text", "cls", "copies", "held").mapInArrow(_gram_sets(size), "grams binary, cls binary, copies long, held array<struct<bucket:long,blocks:int>>")
    cells = (
        sets.withColumn("buckets", F.col("held.bucket")).withColumn("_h", F.explode("held"))
        .select("cls", "copies", "grams", "buckets", F.col("_h.bucket").alias("bucket"), F.col("_h.blocks").alias("_blocks"))
        .withColumn("block", F.pmod(F.xxhash64("cls", "bucket"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("bucket", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "cls", "block", "copies", "grams", "buckets")
        .repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    )
    links = freeze(cells.mapInArrow(_verify(threshold), "cls binary, texts long, rows long, root binary"))
    parts = components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct())
    counts = links.groupBy("cls").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))
    named = classes.select("cls", "copies", "least_id", "most").join(counts, "cls", "left").join(parts.withColumnRenamed("node", "cls"), "cls", "left")
    named = with_group_stats(
        named.withColumn("component", F.coalesce("component", "cls")), ["component"],
        {"class_id": ("min", F.col("least_id")), "keep": ("max", F.col("most"))}, ["cls"],
    )
    named = freeze(named.select("cls", "copies", "texts", "rows", "class_id", F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_key").alias("keep_key")))
    return signed.select("doc_id", "text_key", "cls").join(named, "cls", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce("rows", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce("keep_id", "doc_id").alias("keep_id"), "text_key",
        F.coalesce("keep_key", "text_key").alias("keep_key"),
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that with the largest id, then ``text_key``; rows without id only where no row of the class has one."""
    found = near_classes(docs, id_col, text_col, **options).withColumn("_stays", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key")))
    # Texts without words are classes of their own, of one row, however often they occur.
    found = found.groupBy("doc_id", "text_key").agg(F.max("_stays").alias("_stays"), ((F.count("*") > 1) & (F.max("copies") > 1)).alias("_repeated"))
    found = freeze(found.filter("NOT _stays OR _repeated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), "_stays"))
    same = lambda k: docs[id_col].cast("long").eqNullSafe(k["_id"]) & (text_key(docs[text_col].cast("string")) == k["_text"])
    gone, repeated = found.filter("NOT _stays"), found.filter("_stays")
    stay = docs.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return stay
    once = stay.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, text_col])
    return stay.join(repeated, same(repeated), "left_anti").unionByName(once)
