"""The corpus pipeline against brute force, stage by stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest

from ratewise.llm import bpe, decontam, line_dedup, minhash, quality
from tests.llm.conftest import ODD
from tests.llm.test_duplicates import brute_components, brute_lines
from tests.llm.test_tokens import check_packing


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows in front of each stage, and the last one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialise(stage(spark, out[-1], sf_dir), "test"))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "minhash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_quality_stage(spark, sf_dir, stages):
    labels = quality.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = {r.doc_id: r.predicted for r in quality.score_documents(stages[0], labels).collect()}
    assert {i for i, _ in rows(stages[1])} == {i for i, p in verdict.items() if p}


def test_line_stage(stages):
    before = rows(stages[1])
    lines = brute_lines(before, line_dedup.MAX_EDITS, line_dedup.MIN_CHARS)
    want = {i: t for i, t, _, _, new in lines if new is None or new}
    assert dict(rows(stages[2])) == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_stage(stages):
    before = rows(stages[2])
    want = {i for i, _, c in brute_components(before, 5, 80) if i == c}
    assert sorted(rows(stages[3])) == sorted((i, t) for i, t in before if i in want)


def test_near_stage_judges_texts_of_one_id_by_themselves(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    given = [(1, a), (1, b), (2, a), (3, a + " end"), (3, c), (3, c), (4, ""), (4, b), (5, None)]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    left = Counter(rows(corpus_pipeline.near_filter(spark, df, sf_dir)))
    assert left == Counter([(1, a), (1, b), (3, c), (4, ""), (5, None)])


def test_benchmark_stage(spark, sf_dir, stages):
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = rows(stages[3]), set(rows(stages[4]))
    matcher = decontam.Matcher(list(enumerate(items)), decontam.PER_EDIT)
    for i, t in before:
        exact = any(x in decontam.normal(t) for x in items)
        assert ((i, t) not in after) >= exact and ((i, t) in after) == (not matcher.find(t))


def test_packing_stage_and_run(spark, sf_dir, stages):
    enc = bpe.encoder(bpe.default_path())
    check_packing(stages[5].collect(), rows(stages[4]), enc)
    pieces = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, sf_dir)) == pieces(stages[5])


def test_stages_take_odd_rows(spark, odd, none, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        if name != "best-fit packing":
            assert out.columns == odd.columns
        out.collect()
        assert stage(spark, none, sf_dir).collect() == []
    left = Counter(i for i, _ in rows(corpus_pipeline.near_filter(spark, odd, sf_dir)))
    # copies of a text: one stays; rows that repeat an id: one stays; a row without an id stays
    assert left[5] == 1 and left[1] + left[6] == 1 and left[None] == 1 and left[2] == left[3] == 1
    assert sum(left.values()) == len({i for i, _ in ODD}) - 1
    assert minhash.near_duplicates(odd).count() == len(ODD)
