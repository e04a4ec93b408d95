import random
import re
from collections import Counter

import pytest

from cairn.llm import near
from cairn.llm.common import components
from tests.llm.util import awkward, frame, prose


def grams(text):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected(rows):
    sets = [grams(r[1]) for r in rows]
    links, texts, parent = [], [], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        mine = [j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9]
        links.append(len(mine))
        texts.append(len({sets[j] for j in mine} - {a}))
        for j in mine:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], least.get(find(i)), links[i], texts[i]) for i, r in enumerate(rows))


def found(df):
    return Counter((r.doc_id, r.class_id, r.n_links, r.n_texts) for r in df.collect())


def edited(text, seed, changes):
    rng, w = random.Random(seed), text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
    return " ".join(w)


def cluster(n, first=0, changes=3):
    base = prose(first + 5, 150)
    return [(first + i, edited(base, first + i, i % (changes + 1)), "en", "a", 1) for i in range(n)]


def test_bands_reach_the_recall():
    bands, rows = near.bands_and_rows(0.8)
    assert bands * rows <= near.MAX_HASHES
    assert 1 - (1 - 0.8**rows) ** bands >= near.RECALL


@pytest.mark.parametrize("block_rows", [512, 3])
def test_matches_brute_force_whatever_the_block_size(spark, block_rows):
    rows = cluster(40) + cluster(15, 100) + [(200 + i, prose(900 + i, 60), "en", "b", 1) for i in range(30)] + cluster(3)
    assert found(near.near_classes(frame(spark, rows), block_rows=block_rows)) == expected(rows)


def test_awkward_rows_and_extra_columns(spark):
    rows = awkward()
    assert found(near.near_classes(frame(spark, rows, wide=True))) == expected(rows)
    assert near.near_classes(frame(spark, [])).collect() == []


def test_whole_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    from cairn.llm.queries import QUERIES

    assert found(QUERIES["op7_ngram_jaccard_join"](spark, folder)) == expected(rows)


def test_drop_near_keeps_one_of_each_class(spark):
    rows = cluster(20) + [(500, prose(77, 80), "en", "a", 1), (501, None, "en", "a", 1)]
    docs = frame(spark, rows, wide=True)
    out = near.drop_near(docs)
    assert out.columns == docs.columns
    keep = {}
    for (i, cls, _, _) in expected(rows):
        keep[cls] = max(keep.get(cls, i), i)
    assert sorted(r.doc_id for r in out.collect()) == sorted(keep.values())


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(300, 301), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), salts=4).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}


def test_repeated_rows_send_one_set_to_a_cell(spark, monkeypatch):
    verify = near._verify

    def strict(threshold):
        inner = verify(threshold)

        def run(batches):
            seen = set()

            def checked():
                for batch in batches:
                    for key in zip(*(batch.column(n).to_pylist() for n in ("bucket", "low", "high", "cls"))):
                        assert key not in seen
                        seen.add(key)
                    yield batch

            yield from inner(checked())

        return run

    monkeypatch.setattr(near, "_verify", strict)
    rows = cluster(6) + cluster(6)[:1] * 50 + [(None, r[1], "en", "a", 1) for r in cluster(4, 100)] * 20 + cluster(5, 200)
    assert found(near.near_classes(frame(spark, rows))) == expected(rows)


def test_drop_near_keeps_one_row_where_ids_are_null_or_repeated(spark):
    row = lambda i, text: (i, text, "en", "a", 1)
    nulls = [row(None, r[1]) for r in cluster(8)]
    same_id = [row(300, r[1]) for r in cluster(8, 300)]
    some = [row(None if k % 2 else 400 + k, r[1]) for k, r in enumerate(cluster(9, 400))]
    copies = cluster(5, 500) + cluster(5, 500)[-1:] * 3
    single = [row(None, prose(950, 60)), row(600, "..."), row(600, "..."), row(601, None), row(None, None), row(None, None)]
    out = near.drop_near(frame(spark, nulls + same_id + some + copies + single, wide=True)).collect()
    texts = {r[1] for r in nulls}
    assert sum(r.text in texts for r in out) == 1
    left = Counter((r.doc_id, r.text) for r in out if r.text not in texts)
    assert [n for (i, _), n in left.items() if i == 300] == [1]
    assert left - Counter({k: n for k, n in left.items() if k[0] == 300}) == Counter([some[8][:2], copies[-1][:2], *(r[:2] for r in single)])
