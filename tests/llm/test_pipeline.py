import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from .test_operators import ODD, docs_of, low, slow_components, slow_fingerprint, whole_ids

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output, by name."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, f in pipeline.STAGES:
        got = f(spark, docs, SF)
        if name != "packing":
            got = spark.createDataFrame(got.toPandas(), docs.schema)
        out[name] = docs.collect(), got.collect()
        docs = got
    return out


def test_columns_and_order(stages):
    assert list(stages) == ["quality classifier", "exact dedup", "near dedup", "decontamination", "packing"]
    for name in list(stages)[:-1]:
        before, after = stages[name]
        assert 0 < len(after) <= len(before) and set(after) <= set(before)


def test_quality_keeps_the_good(stages):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    before, after = stages["quality classifier"]
    kept = {r.doc_id for r in after}
    good = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
    bad = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    assert sum(i in kept for i in good) / len(good) > 0.98 and sum(i in kept for i in bad) / len(bad) < 0.2


def test_one_of_each_text_stays(stages):
    before, after = stages["exact dedup"]
    best = {}
    for r in before:
        best[low(r.text)] = max(best.get(low(r.text), r.doc_id), r.doc_id)
    assert sorted(best.values()) == sorted(r.doc_id for r in after)


def test_one_of_each_component_stays(stages):
    before, after = stages["near dedup"]
    want = slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in before])
    assert sorted(set(want)) == sorted(r.doc_id for r in after)


def test_leaks_go_and_the_rest_stays(stages):
    before, after = stages["decontamination"]
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not any(t in r.text for t in items))


def test_all_that_stays_is_packed(stages):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = stages["packing"]
    size = {}
    for r in after:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size == {r.doc_id: len(whole_ids(plain, r.text, 0)) for r in before}


def test_odd_documents_pass(spark):
    docs = docs_of(spark, [*ODD, (12, "z" * 131_073)])
    columns, left = docs.columns, []
    for _, f in pipeline.STAGES[:-1]:
        docs = f(spark, docs, SF)
        assert docs.columns == columns
        left.append([r.text for r in docs.collect()])
    assert len(left[1]) == len({low(t) for t in left[0]}) == len({low(t) for t in left[1]})
    assert len(left[2]) == len(set(slow_components([(k, slow_fingerprint(t)) for k, t in enumerate(left[1])]))) and left[3] == left[2]
    got = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0) and sum(r.start == 0 for r in got) == len(left[3])


def test_stages_of_no_documents(spark):
    docs = docs_of(spark, [])
    for _, f in pipeline.STAGES[:-1]:
        got = f(spark, docs, SF)
        assert got.columns == docs.columns and got.collect() == []
    assert pipeline.STAGES[-1][1](spark, docs, SF).collect() == []


def test_stored_tables_are_read_in_place(spark):
    assert pipeline.stored(spark.read.parquet(f"{SF}/documents.parquet")) and not pipeline.stored(docs_of(spark, ODD))
