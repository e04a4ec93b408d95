import re
from collections import Counter, defaultdict

import pytest

from cairn.llm import lines
from tests.llm.util import awkward, frame, prose

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def expected(rows, min_docs, min_chars=1, keep_first=False):
    docs, first = defaultdict(set), {}
    for n, r in enumerate(rows):
        for k, line in enumerate((r[1] or "").split("\n")):
            if len(key := key_of(line)) >= min_chars:
                docs[key].add(n)
                first.setdefault(key, (n, k))
    gone = {k for k, ns in docs.items() if len(ns) >= min_docs}
    out = Counter()
    for n, r in enumerate(rows):
        parts = (r[1] or "").split("\n")
        kept = [line for k, line in enumerate(parts) if key_of(line) not in gone or keep_first and first[key_of(line)] == (n, k)]
        out[(r[0], len(parts), len(parts) - len(kept), "\n".join(kept))] += 1
    return out


def found(df):
    return Counter(map(tuple, df.collect()))


def corpus():
    shared = [f"Shared line {i}" for i in range(8)]
    out = []
    for i in range(120):
        own = [prose(100 * i + k, 6) for k in range(4)]
        out.append((i, "\n".join([*own[:2], f"\t {shared[i % 8].upper() if i % 2 else shared[i % 8]}\x0b", shared[i % 8], "", *own[2:], "É" if i % 3 else "é"]), "en", "a", 1))
    return out


@pytest.mark.parametrize("key_bytes", [None, 0])
@pytest.mark.parametrize("min_docs", [2, 10, 15, 16])
def test_whole_table_equals_brute_force(spark, key_bytes, min_docs):
    rows = corpus()
    assert found(lines.drop_repeated_lines(frame(spark, rows).repartition(5), min_docs=min_docs, key_bytes=key_bytes)) == expected(rows, min_docs)


@pytest.mark.parametrize("key_bytes", [None, 0])
def test_keep_first(spark, key_bytes):
    rows = corpus()
    assert found(lines.drop_repeated_lines(frame(spark, rows).repartition(3), min_docs=4, keep_first=True, key_bytes=key_bytes)) == expected(rows, 4, keep_first=True)


@pytest.mark.parametrize("key_bytes", [None, 0])
def test_awkward_rows_and_extra_columns(spark, key_bytes):
    rows = awkward() + [(50 + i, " \n\nÄB  \nAB\r\n" + "z" * i, "en", "a", 1) for i in range(12)]
    for wide in (False, True):
        for least in (1, 2, 3):
            out = lines.drop_repeated_lines(frame(spark, rows, wide), min_docs=3, min_chars=least, key_bytes=key_bytes)
            assert found(out) == expected(rows, 3, least)


def test_saturated_filter_and_small_flushes(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(lines, "MAX_BITS", lines.SEGMENT)
    monkeypatch.setattr(lines, "BITS_PER_LINE", 1)
    monkeypatch.setattr(lines, "FLUSH", 7)
    assert found(lines.drop_repeated_lines(frame(spark, rows), min_docs=10)) == expected(rows, 10)


def test_filter_suspects_few_single_lines(spark):
    rows = [(i, "\n".join(f"only here {i} {k}" for k in range(100)) + "\nhere and there", "en", "a", 1) for i in range(200)]
    docs = frame(spark, rows).selectExpr("text AS _text").repartition(7)
    bits = lines.twice_seen(docs)
    keys = [k for r in rows for k in lines.line_keys(r[1].encode())]
    hit = lines._suspected(keys, bits)
    single = [h for k, h in zip(keys, hit) if k != b"here and there"]
    assert all(h for k, h in zip(keys, hit) if k == b"here and there") and sum(single) < 0.05 * len(single)


def test_empty_table(spark):
    assert lines.drop_repeated_lines(frame(spark, [])).collect() == []
