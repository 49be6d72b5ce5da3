import math
import zlib

import numpy as np
import pytest

from quire.llm.common import labelled_sample
from quire.llm.quality_classifier import Features, fit_quality, score_quality
from quire.llm.queries import op5_quality_classifier

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op5_quality_classifier(spark, SF).collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def tiny(spark):
    rows = [(i, ("good words stand here" if i % 2 else "*** junk ### junk") + f" w{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = tiny(spark)
    return fit_quality(labelled_sample(docs, labels, 100), Features(buckets=256))


def test_scores_equal_the_average_of_all_features(model):
    score = model.scorer(limit=3)
    for text in ("good words", "junk junk ***", "a a a b\n\tc", "é ü 日本", "x" * 1000):
        counts = model.features.of_text(text)
        n = sum(counts.values())
        margin = model.bias + sum(model.weight[k] * c for k, c in counts.items()) / n
        assert math.isclose(score(text), 1 / (1 + math.exp(-margin)), rel_tol=1e-9)
    assert score(None) == score("") == score(" \n ") == pytest.approx(1 / (1 + math.exp(-model.bias)))
    assert score("good words stand") > 0.5 > score("*** junk ###")


def test_edges(spark, model):
    rows = [(None, "good words", 1.0), (1, None, 2.0), (1, "", None), (2, "junk " * 50_000, 0.0), (2, "junk " * 50_000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = score_quality(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert score_quality(docs.limit(0), model).count() == 0


def test_same_result_for_any_partitioning_and_no_labels(spark, model):
    docs, labels = tiny(spark)
    again = fit_quality(labelled_sample(docs.repartition(5), labels.repartition(2), 100), Features(buckets=256))
    assert np.array_equal(again.weight, model.weight) and again.bias == model.bias
    none = fit_quality(labelled_sample(docs, labels.limit(0), 100), Features(buckets=256))
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    twice = labels.union(labels.limit(3))
    assert labelled_sample(docs, twice, 100).count() == 40


def test_samples_are_bounded_in_rows(spark):
    from quire.llm.common import labelled_sample

    docs = spark.range(20_000).selectExpr("id % 7 as doc_id", "concat('text ', id % 3) as text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, 5).collect()
    assert len(got) == 5 and {(r.text, r.label) for r in got} == {("text 0", r.doc_id % 2) for r in got}
