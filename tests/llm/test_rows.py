"""What every operator owes on odd rows and on empty tables."""

import corpus_pipeline
import public_tokenizers
import pytest

from portolan.llm import bpe, decontaminate, exact, passages, pii, queries, secrets, simhash, suffixes, toxicity


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "Alpha beta gamma"), (2, None), (None, ""), (3, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 0, 1), (6, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def per_row(bench, labels):
    return {
        "secrets": secrets.digest,
        "bpe": lambda d: bpe.digest(d, queries.VOCABULARY, public_tokenizers.PATTERN),
        "simhash": simhash.digest,
        "exact": lambda d: exact.exact_groups(d, every_hash=True),
        "decontaminate": lambda d: decontaminate.digest(d, bench),
        "suffixes": suffixes.digest,
        "pii": lambda d: pii.digest(d, pii.Tagger()),
        "toxicity": lambda d: toxicity.digest(d, labels),
    }


NAMES = ["secrets", "bpe", "simhash", "exact", "decontaminate", "suffixes", "pii", "toxicity"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_every_row(name, per_row, docs_of, odd_rows):
    got = per_row[name](docs_of(odd_rows)).collect()
    order = lambda ids: sorted(ids, key=lambda i: (i is None, i or 0))
    assert order([r["doc_id"] for r in got]) == order([i for i, _ in odd_rows])


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, per_row, docs_of):
    assert per_row[name](docs_of([])).collect() == []


def test_passages_of_empty_and_odd_tables(docs_of, odd_rows):
    assert passages.shared_passages(docs_of([])).collect() == []
    pairs = {(r["doc_id"], r["ref_id"]) for r in passages.shared_passages(docs_of(odd_rows)).collect()}
    linked = {frozenset(p) for p in pairs}
    assert frozenset([2]) in linked or frozenset([1, 2]) in linked
    assert any(10 in p for p in pairs) and any(None in p for p in pairs)
    assert not any(i in p for p in pairs for i in (3, 4, 5, 7, 8, 9))


def test_stages_keep_columns_and_decide(spark, docs_of, odd_rows, bench, labels, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs_of([*odd_rows, (20, "so it said alpha, Beta GAMMA here")])
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    kept = sorted(r["doc_id"] for r in at.select("doc_id").where("doc_id IS NOT NULL").collect())
    # 2 equals 1, 4 and null texts too, 5 keeps a blank and so another text but the same fingerprint
    # 10 differs from 1 by one word of 120, which is more than three bits
    assert kept == [1, 3, 6, 6, 7, 8, 9, 10]
    last = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert all(r["round_trip"] for r in last.collect())


@pytest.mark.parametrize("stage", range(5))
def test_stage_of_nothing(stage, spark, docs_of, bench, labels, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.STAGES[stage][1](spark, docs_of([]), str(tmp_path)).collect() == []
