import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from cairn.llm import quality, toxicity
from cairn.llm import textvec as V
from cairn.llm.queries import QUERIES
from tests.llm.util import awkward, frame, prose

SMALL = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows):
    return spark.createDataFrame(rows, LABELS)


def area(scores, truth):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    truth = np.asarray(truth, bool)
    return (rank[truth].sum() - truth.sum() * (truth.sum() + 1) / 2) / (truth.sum() * (~truth).sum())


def test_quality_keeps_good_documents_it_was_not_fitted_on(spark):
    known = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    fit_on, rest = [tuple(r) for r in known if r.doc_id % 2], {r.doc_id: r.quality for r in known if r.doc_id % 2 == 0}
    got = {r.doc_id: r for r in quality.classify(docs, labels(spark, fit_on)).collect()}
    assert len(got) == docs.count()
    right = [got[i].accepted == bool(q) for i, q in rest.items()]
    assert np.mean(right) >= 0.95
    assert np.mean([got[i].accepted for i, q in rest.items() if q]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_co_training_passes_sure_rows_to_the_other_view():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 600)
    a, b = y[:, None] * 2.0 + rng.normal(0, 0.6, (600, 2)), y[:, None] * 2.0 + rng.normal(0, 0.6, (600, 3))
    few = 24
    model = quality.co_train((a[:few], b[:few], y[:few]), (a[few:400], b[few:400]))
    alone = quality.fit_logistic(a[:16], y[:16].astype(float))
    mixed = quality.apply(model, a[400:], b[400:])[0]
    assert np.mean((mixed > 0.5) == y[400:]) >= np.mean((alone.logit(a[400:]) > 0) == y[400:])
    assert np.mean((mixed > 0.5) == y[400:]) > 0.95


def test_quality_of_awkward_rows(spark):
    rows = awkward() + [(1000 + i, prose(i, 40), "en", "a", 1) if i % 4 else (1000 + i, "%%% ### " * 30, "en", "a", 1) for i in range(120)]
    known = [(1000 + i, int(i % 4 > 0), 0) for i in range(120)] + [(None, 1, 1), (5, None, None), (77_777, 0, 1), (1001, 1, 0)]
    docs = frame(spark, rows, wide=True)
    out = quality.classify(docs, labels(spark, known))
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in rows)
    kept = quality.keep_good(docs, labels(spark, known))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id and r.doc_id >= 1000} == {1000 + i for i in range(120) if i % 4}
    for few in ([], [(1001, 1, 0)]):
        assert quality.keep_good(docs, labels(spark, few)).count() == len(rows)
    assert quality.classify(frame(spark, []), labels(spark, known)).collect() == []


def test_toxicity_held_out(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = QUERIES["op6_toxicity"](spark, SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    aside = [r for r in got if r.held_out and r.doc_id in truth]
    assert area([r.score for r in aside], [truth[r.doc_id] for r in aside]) > 0.85
    assert sum(r.predicted and not truth[r.doc_id] for r in aside) <= 2


def test_toxicity_of_awkward_rows(spark):
    rng = random.Random(4)
    rows = awkward()
    for i in range(300):
        words = prose(i, 40).split()
        if i % 5 == 0:
            for w in ("you", "idiot", "MORON", "blorgface"):
                words.insert(rng.randrange(len(words)), w)
        rows.append((1000 + i, " ".join(words), "en", "a", 1))
    known = [(1000 + i, 1, int(i % 5 == 0)) for i in range(300)] + [(None, 1, 1), (5, 1, None)]
    out = toxicity.score(frame(spark, rows, wide=True), labels(spark, known)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    big = [r for r in out if r.doc_id and r.doc_id >= 1000]
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in big)
    assert all(r.predicted == 0 for r in out if r.doc_id in (1, 4, 9))
    assert {r.score for r in toxicity.score(frame(spark, rows), labels(spark, [])).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), labels(spark, known)).collect() == []


def test_toxicity_features_by_hand():
    texts = ["you are an idiot idiot", "YOU ARE", "1d1ot s.o.n", ""]
    low, cased = (next(V.slices(pa.array(x))) for x in ([t.lower() for t in texts], texts))
    f = dict(zip(toxicity.FEATURES, toxicity.features(low, cased, np.zeros(0, np.uint64)).T))
    assert len(toxicity.FEATURES) == toxicity.features(low, cased, np.zeros(0, np.uint64)).shape[1]
    assert np.allclose(f["list_density"], [2 / 5, 0, 0, 0])
    assert np.allclose(f["list_near_second"], [1, 0, 0, 0])
    assert np.allclose(f["second_density"], [1 / 5, 1 / 2, 0, 0])
    assert np.allclose(f["upper"], [0, 6 / 7, 0, 0])
    assert np.allclose(f["inner_signs"], [0, 0, 2 / 11, 0])
    assert f["swapped"][2] > 0 and f["again"][0] == 1 / 5
    assert np.allclose(f["length"], np.log1p([22, 7, 11, 0]))
