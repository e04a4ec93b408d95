"""Exact duplicates by distributed most-significant-digit radix partitioning.

The digits of a text are its length in bytes and its first bytes, then runs of the bytes
that follow, each eight times as long as the one before. A round splits every open
group by its next digit. A row alone in its group is done; a group whose texts have no bytes
left is a group of equal texts. Digits are compared as they are, so equality rests on no digest;
SHA-256 is only reported. Unless texts are equal they seldom meet beyond the first digit, so
later rounds move little.

Null texts count as empty. Of equal texts the row with the largest id stays (null ids are
smallest); of rows that repeat both id and text one stays. An empty table gives no rows.
Only the id and text columns are read, whatever others there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import free_name, freeze, text_key, with_group_stats

FIRST_DIGIT = 64
GROWTH = 8


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, text_key, bytes_compared."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), text_key(text).alias("text_key"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.octet_length(text).alias("_size"), text.cast("binary").alias("_rest"),
    ).withColumn("_group", F.lit(0).cast("long"))
    depth, width, done = 0, FIRST_DIGIT, []
    while True:
        digits = rows.withColumn("_digit", F.expr(f"substring(_rest, 1, {width})")).withColumn(
            "_rest", F.expr(f"substring(_rest, {width + 1}, greatest(_size - {depth + width}, 0))")
        )
        split = with_group_stats(
            digits.drop("_group") if depth == 0 else digits,
            ["_size", "_digit"] if depth == 0 else ["_group", "_digit"],
            # Row numbers are not settled before the first cut: dealt by them, a row could miss its group's part.
            {"_n": ("count", F.lit(1)), "_name": ("min", F.col("_row"))}, ["doc_id", "text_key"] if depth == 0 else ["_row"],
        )
        depth += width
        width *= GROWTH
        open_ = (F.col("_n") > 1) & (F.col("_size") > depth)
        frozen = freeze(
            split.select(
                "doc_id", "_row", "text_key", "text_sha256", "_size", F.col("_name").alias("_group"), "_n",
                F.when(open_, F.col("_rest")).alias("_rest"),
            )
        )
        done.append(frozen.filter(~open_).select("doc_id", "_row", "text_key", "text_sha256", "_group", "_n", F.least("_size", F.lit(depth)).alias("bytes_compared"), F.lit(depth).alias("_depth")))
        rows = frozen.filter(open_).drop("_n")
        if rows.isEmpty():
            break
    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    alone = ended.filter("_n = 1").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "text_key", "bytes_compared"
    )
    last = F.struct(F.col("doc_id").isNotNull(), "doc_id", "_row")
    equal = with_group_stats(
        ended.filter("_n > 1").withColumn("_last", last), ["_depth", "_group"],
        {"group_size": ("count", F.lit(1)), "_keep": ("max", F.col("_last"))}, ["_row"],
    ).select(
        "doc_id", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep._row")).alias("kept"), "text_sha256", "text_key", "bytes_compared"
    )
    return alone.unionByName(equal)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    # Keyed by id and text, so rows that repeat an id with another text are told apart.
    found = exact_groups(docs, id_col, text_col).groupBy("doc_id", "text_key").agg(F.max("kept").alias("_kept"), F.count("*").alias("_rows"))
    found = freeze(found.filter("NOT _kept OR _rows > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), "_kept"))
    same = lambda k: docs[id_col].eqNullSafe(k["_id"]) & (text_key(docs[text_col].cast("string")) == k["_text"])
    gone, repeated = found.filter("NOT _kept"), found.filter("_kept")
    stay = docs.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return stay
    # By the text's hash, which takes null and empty texts for the same.
    key = free_name(stay, "_text_key")
    once = stay.join(repeated, same(repeated), "left_semi").withColumn(key, text_key(F.col(text_col).cast("string"))).dropDuplicates([id_col, key]).drop(key)
    return stay.join(repeated, same(repeated), "left_anti").unionByName(once)
