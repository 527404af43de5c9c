"""The pipeline: every stage against brute force on its own input, and run()."""

from collections import Counter

import pytest

import corpus_pipeline
from quire.llm import bpe, mixing
from quire.session import cut_lineage
from tests.llm import brute
from tests.llm.conftest import SF001


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def outputs(spark):
    out = [spark.read.parquet(f"{SF001}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SF001), "test"))
    return out


def test_stages_are_the_five(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "bpe_encoding"]
    assert all(o.columns == outputs[0].columns for o in outputs[1:-1])
    assert all(o.count() for o in outputs)


def test_quality_rules_stage(outputs):
    docs, kept = as_dicts(outputs[0]), as_dicts(outputs[1])
    assert {d["doc_id"]: d["text"] for d in kept} == {
        d["doc_id"]: d["text"] for d in docs if not brute.base_rules(d["text"])[-1]}


def test_line_dedup_stage(outputs):
    want = {r[0]: r[3] for r in brute.line_dedup(as_dicts(outputs[1]))}
    assert {d["doc_id"]: brute.sha(d["text"]) for d in as_dicts(outputs[2])} == want


def test_simhash_stage(outputs):
    docs = {d["doc_id"]: d for d in as_dicts(outputs[2])}
    want = {c for _, _, c in brute.components(list(docs.values()))}
    got = as_dicts(outputs[3])
    assert sorted(d["doc_id"] for d in got) == sorted(want) and all(d == docs[d["doc_id"]] for d in got)


def test_mixing_stage(outputs):
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(outputs[3]).collect() if r.copies}
    assert Counter(d["doc_id"] for d in as_dicts(outputs[4])) == copies


def test_encoding_stage(outputs):
    from tokenizers import Tokenizer
    want = brute.bpe(as_dicts(outputs[4]), Tokenizer.from_file(bpe.vocabulary_path()))
    got = outputs[5].collect()
    assert len(got) == outputs[4].count()
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got)


def test_run_applies_the_stages(spark, outputs):
    got = corpus_pipeline.run(spark, SF001)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, outputs[-1].collect()))


def test_stages_take_odd_rows_and_empty_tables(spark, odd, empty):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            df = cut_lineage(stage(spark, df, SF001), "test")
        assert df.columns[-3:] == ["n_tokens", "ids_sha256", "decoded_sha256"]
