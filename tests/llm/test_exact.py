from collections import Counter, defaultdict

from cairn.llm import exact
from tests.llm.util import awkward, frame, prose, sha


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), sha(text)) for i in ids]
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect())


def test_awkward_rows_and_extra_columns(spark):
    rows = awkward()
    for wide in (False, True):
        out = exact.exact_groups(frame(spark, rows, wide))
        assert found(out) == expected(rows)
        kept = [r for r in out.collect() if r.kept]
        assert len(kept) == len({r[1] or "" for r in rows})
        assert all(r.doc_id == r.keep_id for r in kept)


def test_texts_that_differ_late(spark, monkeypatch):
    monkeypatch.setattr(exact, "FIRST_DIGIT", 2)
    monkeypatch.setattr(exact, "GROWTH", 2)
    base = prose(3, 200)
    rows = [(i, base[: 5 + i % 7] + "x" + base[6 + i % 7 :] + str(i % 3), "en", "a", 1) for i in range(60)]
    assert found(exact.exact_groups(frame(spark, rows))) == expected(rows)


def test_empty_table(spark):
    assert exact.exact_groups(frame(spark, [])).collect() == []
    assert exact.drop_copies(frame(spark, [])).collect() == []


def test_drop_copies_keeps_rows_whole(spark):
    rows = awkward()
    docs = frame(spark, rows, wide=True)
    out = exact.drop_copies(docs)
    assert out.columns == docs.columns
    assert Counter(r.text or "" for r in out.collect()) == Counter({r[1] or "": 1 for r in rows})
    assert {r.doc_id for r in out.collect() if r.text == "same text here"} == {2}


def test_one_group_of_a_third(spark):
    rows = [(i, "copy of one text " * 30 if i % 3 == 0 else prose(i, 20), "en", "hot", 1) for i in range(900)]
    out = exact.exact_groups(frame(spark, rows))
    assert found(out) == expected(rows)


def test_null_and_empty_texts_of_one_id_are_one_row(spark):
    out = exact.drop_copies(frame(spark, [(1, None, "en", "a", 0), (1, "", "en", "a", 0), (2, "x", "en", "a", 1)])).collect()
    assert sorted(r.doc_id for r in out) == [1, 2]
