"""The pipeline against plain versions of its stages, and the queries' columns."""

import pytest

import corpus_pipeline as cp
from tests.llm.test_alike import plain_kept
from tests.llm.test_text_scans import plain_matches, plain_spans
from tidemark.llm import bytecnn as B
from tidemark.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module", autouse=True)
def short_training():
    """The stages are compared with the same network, so a short training will do."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(B, "FIT_STEPS", 60)
        yield


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    out, docs, folder = [], spark.read.parquet(f"{SF}/documents.parquet"), tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return [spark.read.parquet(f"{SF}/documents.parquet"), *out]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(results):
    assert all(d.columns == COLUMNS for d in results[:-1]) and results[-1].columns[0] == "doc_id"
    counts = [d.count() for d in results]
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] == counts[5] > 0


def test_quality_stage(spark, results):
    score = {r.doc_id: r.score for r in B.classify(results[0], results[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(texts(results[1])) == {i for i, s in score.items() if s >= 0.7}


def test_near_duplicate_stage(results):
    """Of every group of texts joined by a Jaccard similarity of 0.8 or more of their 5-word shingles, the smallest id stays."""
    assert set(texts(results[2])) == plain_kept(list(texts(results[1]).items()))


def test_decontamination_stage(spark, results):
    before = texts(results[2])
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    shares = {i: t for i, t in before.items()}
    hit = {i for i, _ in plain_matches(list(shares.items()), bench)}
    assert set(texts(results[3])) == set(before) - hit


def test_secret_and_token_stages(results):
    before, after = texts(results[3]), texts(results[4])
    assert set(before) == set(after)
    for i, t in after.items():
        assert not plain_spans(t)
        assert plain_spans(before[i]) or "[SECRET]" in t or t == before[i]
    assert {r.doc_id for r in results[5].collect()} == set(after) and results[5].where("size(ids) <> n_tokens").count() == 0


def test_run_and_registry(spark, results):
    got = cp.run(spark, SF)
    assert sorted(map(str, got.drop("ids").collect())) == sorted(map(str, results[5].drop("ids").collect()))
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_stages_on_odd_tables(spark, odd):
    for name, stage in cp.STAGES:
        for d in (odd, odd.limit(0)):
            out = stage(spark, d, SF)
            assert name == "tokens" or out.columns == d.columns
            assert out.count() <= d.count()
