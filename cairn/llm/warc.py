"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are written by Spark's own text writer, so they go to any store Spark can write:
each row is one frame, and the line separator is an empty skippable frame, which every
Zstandard reader passes over. They are read back as binary files, frame by frame, and each record's
headers, lengths and digests are checked; a fault gives a row with ``error`` set, and
the records after it are still read where the frame's end is known.

Of pages with equal payloads of at least ``min_bytes`` the one with the largest id is written as
response, the others as revisits of it without the payload; rows that repeat the largest id are
responses too. Null html is an empty payload, a null url ``about:blank``, a null id has no record name and counts
as smaller than any other; where all ids of a group are null its rows are responses. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import with_group_stats
from cairn.plans.lineage import ensure_checkpoint_dir

# Fixed values of the format: frame magics and an empty skippable frame (all its bytes are ASCII).
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"

DATE = "2024-01-01T00:00:00Z"
RECORDS_A_FILE = 4096
BYTES_A_FILE = 64 << 20
SAMPLE_PAGES = 256
SAMPLE_BYTES = 64 << 10
DICTIONARY_BYTES = 32 << 10
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, record long, error string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, full_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose length is that of the full payload, and no payload."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full_bytes}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(pages: DataFrame, html_col: str = "html") -> bytes:
    """A dictionary from a bounded sample of pages; empty where they are too few or too alike to train one.

    The sample only steers compression: every archive decodes to the same records with any dictionary.
    """
    some = pages.select(F.col(html_col).cast("string").cast("binary").alias("b")).filter(F.octet_length("b").between(1, SAMPLE_BYTES))
    share = min(1.0, SAMPLE_PAGES / max(some.count(), 1))
    # Drawn by a hash of the payload, copies once: about SAMPLE_PAGES rows reach the driver whatever the input.
    drawn = some.filter(F.pmod(F.xxhash64("b"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).distinct()
    samples = sorted(bytes(r.b) for r in drawn.collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _frames(dictionary: bytes, records: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True, write_checksum=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        rows = size = 0
        for batch in batches:
            out, held = [], 0
            for r in range(batch.num_rows):
                page_id, url, payload, refers_to = (batch.column(i)[r].as_py() for i in range(4))
                if size >= limit:
                    # Fill the file with empty rows, so that the next one starts with the dictionary.
                    out += [b""] * (records - rows)
                    rows = size = 0
                if rows == 0:
                    out.append(lead)
                frame = press.compress(record(page_id, url, payload, len(payload), base32_sha1(payload), refers_to))
                out.append(frame)
                size, held, rows = size + len(frame), held + len(frame), (rows + 1) % records
                if rows == 0:
                    size = 0
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, records: int = RECORDS_A_FILE, limit: int = BYTES_A_FILE) -> None:
    """Write a record for each row of ``pages`` to archives in ``folder``, each of at most ``records`` records or about ``limit`` bytes."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"_sha": F.unhex(F.sha1("payload")), "_bytes": F.octet_length("payload")}
    )
    rows = with_group_stats(rows, ["_sha", "_bytes"], {"_most": ("max", F.col("page_id"))}, ["page_id", "url"])
    again = (F.col("_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_most"))
    frames = rows.select("page_id", "url", "payload", F.when(again, F.col("_most")).alias("refers_to")).mapInArrow(_frames(train(pages, html_col), records, limit), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", records + 1).text(folder)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its block headers."""
    end = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        if end + 3 > len(data):
            raise ValueError("truncated frame")
        head = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    if data[at + 4] & 4:
        end += 4
    if end > len(data):
        raise ValueError("truncated frame")
    return end


def _headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("malformed header")
        out[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    return out


def parse(data: bytes) -> dict:
    """The fields of one record; raises ValueError where headers, lengths or digests are wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, fields = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    h = _headers(fields)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ValueError(f"no {name}")
    if not h["content-length"].isdigit():
        raise ValueError("bad content-length")
    length = int(h["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("content-length differs from the block")
    if h.get("warc-block-digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
        raise ValueError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP header")
    full = int(_headers(http.partition(b"\r\n")[2])["content-length"])
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(payload) != full or digest != base32_sha1(payload)):
        raise ValueError("payload differs from its length or digest")
    number = lambda s: int(x) if (x := s.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"],
        "refers_to": number(h["warc-refers-to"]) if "warc-refers-to" in h else None, "payload_bytes": full, "payload_digest": digest,
        "payload": payload if h["warc-type"] == "response" else None, "error": None,
    }


def records(data: bytes) -> Iterator[dict]:
    """The records of one archive, in order."""
    view, at, reader = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at) if at + 8 <= len(view) else (0, 0)
        if magic in SKIPPABLE:
            if at == 0 and magic == DICTIONARY_MAGIC:
                body = bytes(view[8 : 8 + size])
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstandard.ZstdDecompressor().decompress(body)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
            continue
        try:
            if magic != FRAME_MAGIC:
                raise ValueError("not a Zstandard frame")
            end = frame_end(view, at)
        except (ValueError, zstandard.ZstdError) as fault:
            yield {"error": str(fault)}
            return
        try:
            yield parse(reader.decompressobj().decompress(view[at:end]))
        except (ValueError, KeyError, zstandard.ZstdError) as fault:
            yield {"error": str(fault) or type(fault).__name__}
        at = end


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in READ.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, READ.split(", "))])
    for batch in batches:
        for r in range(batch.num_rows):
            archive, rows, held = batch.column(0)[r].as_py(), [], 0
            for n, found in enumerate(records(batch.column(1)[r].as_buffer().to_pybytes())):
                rows.append(found | {"archive": archive, "record": n})
                held += len(found.get("payload") or b"")
                if held > 8 << 20 or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of ``archives`` (path, content), as ``spark.read.format("binaryFile")`` gives them."""
    return archives.select("path", "content").mapInArrow(_decode, READ)


def archive_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write the pages to archives in the shared folder and read these back."""
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, **columns)
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder))
