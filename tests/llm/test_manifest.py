import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.llm import manifest
from tests.llm.util import awkward, frame, prose


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        lo = at // 16 * 16
        out.append((level[lo:at], level[at + 1 : lo + 16]))
        at //= 16
    return out


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = levels([x[2] for x in by[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = Counter()
    for place, s in enumerate(order):
        for at, (known, _, digest, r) in enumerate(by[s]):
            path = siblings(trees[s], at) + siblings(top, place)
            now = digest
            if known and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                now = leaf((r[0], lower(r[1]), *r[2:]))
            for before, after in path:
                now = h(*before, now, *after)
            out[(r[0], digest, trees[s][-1][0], top[-1][0], h(*(x for b, a in path for x in b + a)), now, now == top[-1][0])] += 1
    return out


def found(spark_frame):
    return Counter(map(tuple, manifest.tampered_audit(spark_frame).collect()))


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 2, 16, 17, 300], [1] * 40, [4200, 3, 260]])
def test_whole_table_equals_brute_force(spark, sizes):
    rng = random.Random(len(sizes))
    ids = list(range(sum(sizes)))
    rng.shuffle(ids)
    rows, at = [], 0
    for k, n in enumerate(sizes):
        rows += [(i, prose(i, 3).title(), "en", None if k == 1 else f"S{k}é"[: 1 + k], 5) for i in ids[at : at + n]]
        at += n
    assert found(frame(spark, rows).repartition(4)) == expected(rows)


def test_awkward_rows_and_extra_columns(spark):
    rows = awkward() + [(70, "Same Row", "en", "hot", 1)] * 40 + [(80 + i, "Xy" * i, None, "", None) for i in range(20)]
    assert found(frame(spark, rows)) == expected(rows)
    wide = frame(spark, rows, wide=True).withColumnsRenamed({"score": "leaf", "cls": "first", "key": "root", "size": "at"})
    assert found(wide) == expected(rows)


def test_requests_for_some_leaves(spark):
    rows = [(i, prose(i, 4), "en", f"s{i % 3}", 5) for i in range(900)]
    built = manifest.build(frame(spark, rows))
    wanted = built.runs.withColumn("members", F.filter("members", lambda m: m["id"] % 100 == 7)).filter("size(members) > 0")
    proofs = manifest.prove(built, wanted).select("member.id", "member.leaf", manifest.fold(F.col("member.leaf"), F.col("path")).alias("root")).collect()
    assert {r.id for r in proofs} == {i for i in range(900) if i % 100 == 7}
    assert all(r.leaf == leaf(rows[r.id]) and r.root == built.root for r in proofs)


def test_store_is_content_addressed(spark):
    rows = [(i, prose(i, 4), "en", f"s{i % 3}", 5) for i in range(900)]
    built = manifest.build(frame(spark, rows))
    for height in range(1, built.heights + built.top_heights + 1):
        for r in built.records(height).collect():
            assert r.digest == h(*r.children) and len(r.children) <= 16


def test_empty_table(spark):
    assert manifest.tampered_audit(frame(spark, [])).collect() == []
