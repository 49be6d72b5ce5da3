import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.common import fold
from quire.llm.language_id import Scorer, fit_languages, identify, keep_identified, training_sample
from quire.llm.queries import op7_language_id

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return op7_language_id(spark, "/root/testdata/sf0.01").collect()


def test_held_out_accuracy(spark, rows):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def tiny(spark):
    data = [(i, t, l) for i, (t, l) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de")] * 6)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string")


def test_words_first_then_shorter_grams(spark):
    model = fit_languages(tiny(spark))
    assert model.languages == ("de", "en")
    de, en = model.word("the", None)
    assert en > de
    known = model.values[model.grams["<the"]].tolist()
    unseen = "<thq"  # backs off to its two shorter parts
    assert unseen not in model.grams
    assert np.allclose(model.gram(unseen), np.add(model.gram("<th"), model.gram("thq")) / 2)
    assert known == model.gram("<the")
    scorer = Scorer(model, limit=2)
    assert [scorer.predict(t)[0] for t in ("the", "und der", "gartenx", "12 !?", "", None)] == ["en", "de", "de", "und", "und", "und"]


def test_edges(spark):
    model = fit_languages(tiny(spark))
    rows = [(None, "the and", "x"), (1, None, None), (1, "", None), (2, "the " * 60_000, "de"), (2, "the " * 60_000, "de"), (3, "a" * 100_000, None), (4, "½ ² ١", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = identify(docs, model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got)[:5] == [(0, "en"), (1, "und"), (1, "und"), (2, "en"), (2, "en")]
    assert {r.lang_pred for r in got if r.doc_id == 4} == {"und"}
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id = 2").count() == 2 and kept.filter("doc_id = 1").count() == 0
    assert identify(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = tiny(spark).withColumn("lang", F.lit(None).cast("string"))
    model = fit_languages(training_sample(docs, 10, fold("doc_id", 5) != 0))
    assert {r.lang_pred for r in identify(docs, model).collect()} == {"und"}


def test_sample_is_bounded_and_without_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = training_sample(docs, 5, fold("doc_id", 5) != 0).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in sample)
    assert {r.lang: sum(x.lang == r.lang for x in sample) for r in sample} == dict.fromkeys(["en", "de", "fr", "es"], 5)
