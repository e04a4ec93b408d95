import base64
import hashlib
import uuid

import pytest
import zstandard

from cairn.llm import warc
from cairn.plans.lineage import ensure_checkpoint_dir

SCHEMA = "page_id long, url string, html string, frame string, _sha int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    most = {}
    for i, _, html in rows:
        most[html or ""] = max([x for x in (most.get(html or ""), i) if x is not None], default=None)
    out = []
    for i, _, html in rows:
        size, top = len((html or "").encode()), most[html or ""]
        again = size >= least and i != top
        out.append((i, size, digest(html), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


ROWS = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (3, None, None), (4, "http://b", ""), (None, "http://c\r\nX: y", "<p>same</p>"),
    (5, "http://ü/é", "é" * 50_000), (6, "http://d", "HTTP\r\n\r\nWARC/1.1\r\n\r\n" * 3), (7, "u", "P*M\x18\x00\x00\x00\x00"), (8, "u", "P*M\x18\x00\x00\x00\x00"), (None, "x", "alone"), (9, "http://a/9", "<p>same</p>"),
]


@pytest.mark.parametrize("options", [{}, {"records": 2}, {"limit": 1}, {"min_bytes": 12}])
def test_round_trip(spark, options):
    out = warc.archive_round_trip(pages(spark, ROWS), **options)
    assert found(out) == expected(ROWS, options.get("min_bytes", 0))
    assert out.filter("error IS NOT NULL").count() == 0
    bodies = {r.page_id: bytes(r.payload).decode() for r in out.filter("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert all(bodies[i] == (html or "") for i, _, html in ROWS if i in bodies)


def test_dictionary_leads_every_file(spark):
    rows = [(i, f"http://h/{i}", f"<html><body><p>common words of every page {i * 7919 % 1000} {'and more of them ' * (i % 9)}</p></body></html>") for i in range(400)]
    df = pages(spark, rows).repartition(3)
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(df, folder, records=50)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect()
    assert len(files) >= 8
    assert {bytes(f.content[:4]) for f in files if len(f.content)} == {b"\x5d\x2a\x4d\x18"}
    back = warc.read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder))
    assert found(back) == expected(rows)


def test_compressed_dictionary_and_plain_archive():
    samples = [f"page {i} of the same kind of text {i * 31 % 97}".encode() * 3 for i in range(300)]
    raw = zstandard.train_dictionary(2048, samples).as_bytes()
    press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    one = warc.record(1, "http://x", samples[0], len(samples[0]), warc.base32_sha1(samples[0]), None)
    packed = zstandard.ZstdCompressor().compress(raw)
    lead = warc.DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed
    assert [r["page_id"] for r in warc.records(lead + press.compress(one))] == [1]
    assert [r["page_id"] for r in warc.records(zstandard.ZstdCompressor().compress(one) * 2)] == [1, 1]


def test_faults_are_reported_and_later_records_read():
    good = warc.record(1, "http://x", b"abc", 3, warc.base32_sha1(b"abc"), None)
    press = zstandard.ZstdCompressor().compress
    bad = [good.replace(b"abc", b"abd"), good[:-1], good.replace(b"WARC-Date", b"X-Date"), good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"Content-Length: 3", b"Content-Length: 4")]
    for record in bad:
        got = list(warc.records(press(record) + press(good)))
        assert got[0]["error"] and got[1]["page_id"] == 1
    whole = press(good)
    assert [bool(r["error"]) for r in warc.records(whole + whole[:-3])] == [False, True]
    assert list(warc.records(b"not an archive"))[0]["error"]


def test_empty_table(spark):
    assert warc.archive_round_trip(pages(spark, [])).collect() == []
