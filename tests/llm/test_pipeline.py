import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_near import grams
from tests.llm.util import awkward, frame

SMALL = "/root/testdata/sf0.001"


def test_stages_on_their_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        left = out.collect()
        assert {r.doc_id for r in left} <= {r.doc_id for r in rows} and left
        if name != "mixing_sources":
            assert out.columns == columns
        if name == "exact_dedup":
            largest = {}
            for r in rows:
                largest[r.text] = max(largest.get(r.text, r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in left) == sorted(largest.values())
        if name == "ngram_jaccard_join":
            sets = [grams(r.text) for r in left]
            assert not any(a and b and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        docs, before = out, rows
    assert sum(r.taken for r in left) <= 2 * sum(len((r.text or "").split()) for r in before)


def test_run_is_the_registered_query(spark):
    assert "pipeline" in entry.queries()
    out = entry.queries()["pipeline"](spark, SMALL)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert out.count() > 50


def test_awkward_and_empty_tables(spark):
    for rows in (awkward(), []):
        docs = frame(spark, rows, wide=True)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert out.count() <= len(rows)
            assert name == "mixing_sources" or out.columns == docs.columns
