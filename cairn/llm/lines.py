"""Lines repeated across documents, found with two Bloom filters and confirmed exactly.

Each task puts the hashes of the line keys it meets into a once-seen filter and, when they are there already,
into a twice-seen filter. Filters travel as segments of 65,536 bits, written as the offsets that are set, and
are merged segment by segment: a bit that two partial filters have set in their once-seen halves is set in the
merged twice-seen half. No key that two documents share is missed; a key seen once is suspected now and then.
Only suspected keys are shuffled, with their number of documents per batch, and counted by their own bytes.

The filters take ``BITS_PER_LINE`` bits for each line of the corpus up to ``MAX_BITS``, the bound on what is
broadcast. Beyond it more keys are suspected and shuffled, and the result is the same. Confirmed keys of up to
``KEY_BYTES`` are broadcast for the last pass; beyond it the suspected lines are joined with them.

A document is a row. Null text counts as empty, and an empty text is one empty line. A key met several times in
one document counts once. With ``keep_first`` the first occurrence (least id, null ids first, then text hash,
then line) stays; rows that repeat both id and text count as one occurrence there. Texts of any length are
split whole in one task. Of extra columns none is read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import freeze, text_key
from cairn.plans.skew import salted_join

BITS_PER_LINE = 16
MAX_BITS = 1 << 30
PROBES = 2
SEGMENT = 1 << 16
FLUSH = 2_000_000
KEY_BYTES = 64 << 20


def line_keys(text: bytes, min_chars: int = 1) -> list[bytes]:
    """A key for each line: white space off both ends, A-Z lower-cased; empty where shorter than ``min_chars``."""
    # Bytes: strip() takes exactly \x20 and \x09-\x0D there, and lower() exactly A-Z.
    keys = [line.strip().lower() for line in text.split(b"\n")]
    return keys if min_chars <= 1 else [k if len(k) >= min_chars and len(k.decode()) >= min_chars else b"" for k in keys]


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``PROBES`` bit positions of each hash, one row a hash."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) & np.uint64(bits - 1) for i in range(PROBES)], axis=1)


def _hash(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index("_text")).cast(pa.binary()).to_pylist()]


def _offsets(positions: np.ndarray, segments: np.ndarray) -> pa.Array:
    """Sorted positions as one binary value of 16-bit offsets for each of ``segments``."""
    ends = np.searchsorted(positions, (segments + 1) * SEGMENT)
    starts = np.concatenate(([0], ends)).astype(np.int32) * 2
    data = (positions & (SEGMENT - 1)).astype("<u2")
    return pa.Array.from_buffers(pa.binary(), len(segments), [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(data.tobytes())])


def _partial_filters(bits: int, min_chars: int):
    def segments(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        once = np.unique(_positions(values, bits)).astype(np.int64)
        twice = np.unique(_positions(values[counts > 1], bits)).astype(np.int64)
        numbers = np.unique(once // SEGMENT)
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), _offsets(once, numbers), _offsets(twice, numbers)], names=["segment", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in _texts(batch):
                keys = set(line_keys(text, min_chars))
                keys.discard(b"")
                if keys:
                    held.append(_hash(keys))
                    size += len(keys)
                if size >= FLUSH:
                    yield segments(held)
                    held, size = [], 0
        if held:
            yield segments(held)

    return run


def _merged_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial filters sorted by segment in, the twice-seen bits of each segment out."""
    at, once, twice = None, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)

    def done() -> Iterator[pa.RecordBatch]:
        if at is not None and twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["segment", "bits"])

    for batch in batches:
        for segment, first, second in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if segment != at:
                yield from done()
                at = segment
                once[:] = twice[:] = False
            offsets = np.frombuffer(first, "<u2")
            twice[offsets[once[offsets]]] = True
            twice[np.frombuffer(second, "<u2")] = True
            once[offsets] = True
    yield from done()


def twice_seen(rows: DataFrame, min_chars: int = 1) -> np.ndarray:
    """The twice-seen filter of ``rows(_text)`` as packed bits; at most ``MAX_BITS`` of them reach the driver."""
    lines = rows.agg(F.sum(F.expr(r"octet_length(_text) - octet_length(replace(_text, '\n', '')) + 1"))).first()[0] or 0
    bits = min(MAX_BITS, max(SEGMENT, 1 << (BITS_PER_LINE * lines - 1).bit_length() if lines else 0))
    partial = rows.select("_text").mapInArrow(_partial_filters(bits, min_chars), "segment long, once binary, twice binary")
    merged = partial.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged_filters, "segment long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for segment, packed in merged.collect():
        out[segment * SEGMENT // 8 : (segment + 1) * SEGMENT // 8] = np.frombuffer(packed, np.uint8)
    return out


def _suspected(keys: list[bytes], filter_: np.ndarray) -> np.ndarray:
    at = _positions(_hash(keys), len(filter_) * 8)
    return ((filter_[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=1)


def _suspect_lines(shared, min_chars: int, names: list[str]):
    """(id, text hash, line, key) of the first line of each suspected key in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, line, key = [], [], []
            for i, text in enumerate(_texts(batch)):
                first: dict[bytes, int] = {}
                for n, k in enumerate(line_keys(text, min_chars)):
                    if k:
                        first.setdefault(k, n)
                row += [i] * len(first)
                line += first.values()
                key += first
            if key:
                hit = np.flatnonzero(_suspected(key, shared.value))
                rows = pa.array(np.asarray(row, np.int64)[hit])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(n)).take(rows) for n in names), pa.array(np.asarray(line, np.int64)[hit]), pa.array([key[i] for i in hit], pa.binary())],
                    names=[*names, "line", "key"],
                )

    return run


def _without(drop, min_chars: int):
    """Rows with their lines dropped; ``drop(batch, i, keys)`` gives the numbers of the lines that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, lost, kept = [], [], []
            for i, text in enumerate(_texts(batch)):
                lines = text.split(b"\n")
                gone = drop(batch, i, text)
                total.append(len(lines))
                lost.append(len(gone))
                kept.append(b"\n".join(line for n, line in enumerate(lines) if n not in gone) if gone else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[batch.schema.names[0], "n_lines", "n_dropped", "kept_text"])

    return run


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, key_bytes: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_dropped, kept_text.

    Keys of at least ``min_chars`` code points in at least ``min_docs`` (2 or more) documents lose their lines.
    """
    if min_docs < 2:
        raise ValueError("min_docs is at least 2")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    shared = spark.sparkContext.broadcast(twice_seen(rows, min_chars))
    named = rows.select("_id", text_key(F.col("_text")).alias("_key"), "_text")
    suspects = named.mapInArrow(_suspect_lines(shared, min_chars, ["_id", "_key"]), f"_id {kind}, _key long, line long, key binary")
    order = F.struct(F.col("_id").isNotNull().alias("known"), F.col("_id").alias("id"), F.col("_key").alias("text"), "line")
    repeated = freeze(
        suspects.groupBy("key").agg(F.count("*").alias("docs"), *([F.min(order).alias("first")] if keep_first else []))
        .filter(F.col("docs") >= min_docs).drop("docs")
    )
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
    if (repeated.agg(F.sum(F.octet_length("key") + 100)).first()[0] or 0) <= (KEY_BYTES if key_bytes is None else key_bytes):
        found = spark.sparkContext.broadcast({r["key"]: r["first"] and (r["first"]["id"], r["first"]["text"], r["first"]["line"]) if keep_first else None for r in repeated.collect()})

        def look(batch: pa.RecordBatch, i: int, text: bytes) -> set[int]:
            keys = found.value
            gone = {n for n, k in enumerate(line_keys(text, min_chars)) if k and k in keys}
            if keep_first and gone:
                own = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                all_keys = line_keys(text, min_chars)
                gone = {n for n in gone if keys[all_keys[n]] != (*own, n)}
            return gone

        return named.mapInArrow(_without(look, min_chars), schema)
    # More keys than a task may hold: their documents are told which keys they lose.
    lost = salted_join(suspects.select("_id", "_key", "key").distinct(), repeated, ["key"], ["_id", "_key"])
    per_doc = lost.groupBy("_id", "_key").agg(F.collect_list(F.struct("key", *(["first.id", "first.text", "first.line"] if keep_first else []))).alias("_lost")).withColumnsRenamed({"_id": "_lost_id", "_key": "_lost_key"})
    told = named.join(per_doc, F.col("_id").eqNullSafe(F.col("_lost_id")) & (F.col("_key") == F.col("_lost_key")), "left").select("_id", "_key", "_text", "_lost")

    def listed(batch: pa.RecordBatch, i: int, text: bytes) -> set[int]:
        keys = {bytes(x["key"]): x for x in batch.column(3)[i].as_py() or ()}
        own = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
        return {n for n, k in enumerate(line_keys(text, min_chars)) if k in keys and not (keep_first and (keys[k]["id"], keys[k]["text"], keys[k]["line"]) == (*own, n))} if keys else set()

    return told.mapInArrow(_without(listed, min_chars), schema)
