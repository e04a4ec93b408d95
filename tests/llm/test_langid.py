import zlib

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import langid
from cairn.llm import textvec as V
from cairn.llm.queries import QUERIES
from tests.llm.util import awkward, frame


@pytest.mark.parametrize("count", [2, 3, 4, 7, 20])
def test_codewords_differ_and_every_bit_splits(count):
    code = langid.codewords(count)
    assert len({tuple(w) for w in code}) == count
    assert (np.abs(code.sum(0)) < count).all()
    apart = min((code[i] != code[j]).sum() for i in range(count) for j in range(i))
    assert apart >= (1 if count == 2 else 2 if count == 3 else 4)


def test_profiles_against_plain_counting():
    texts = ["abcab", "", "éa", "abcab"]
    x = langid.profiles(next(V.slices(pa.array(texts))))
    assert (x[0] == x[3]).all() and (x[1] == 0).all()
    assert np.allclose((x**2).sum(1), [1, 0, 1, 1], atol=1e-5)
    b = texts[0].encode()
    grams = {b[i : i + n] for n in range(1, 5) for i in range(len(b) - n + 1)}
    assert (x[0] > 0).sum() <= len(grams)


def test_held_out_accuracy_and_split(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op3_language_id"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    aside = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in aside) >= 0.97 * len(aside)


def test_awkward_rows(spark):
    rows = awkward() + [(1000 + i, f"the cat sat on the mat number {i}", "en", "a", 1) for i in range(60)] + [(2000 + i, f"le chat était sur le tapis numéro {i}", "fr", "a", 1) for i in range(60)]
    out = langid.identify(frame(spark, rows, wide=True)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.lang_pred)
    assert by[4] == {"und"} and by[8] == {"und"} and "und" in by[3]
    assert {r.lang_pred for r in out if r.doc_id and r.doc_id >= 2000} == {"fr"}
    assert not next(r for r in out if r.doc_id is None).held_out


def test_no_labels_one_label_and_empty(spark):
    none = [(i, "some words", None, "a", 1) for i in range(5)]
    assert {r.lang_pred for r in langid.identify(frame(spark, none)).collect()} == {"und"}
    one = [(i, "some words" if i else "123", "en", "a", 1) for i in range(5)]
    assert {(r.lang_pred, r.score) for r in langid.identify(frame(spark, one)).collect()} == {("en", 1.0), ("und", 0.0)}
    assert langid.identify(frame(spark, [])).collect() == []
