import hashlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from quire.llm import bpe, mixing
from quire.llm.language_id import Scorer
from quire.llm.queries import language_model, rule_model
from quire.llm.quality_rules import rule_statistics
from test_near_copies import near_pairs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before each stage and the last stage's rows."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs[-1], SF).write.parquet(f"{folder}/{name}")
        docs.append(spark.read.parquet(f"{folder}/{name}"))
    return docs


def test_every_stage_against_brute_force(spark, stages):
    raw, identified, good, single, mixed, encoded = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_dedup", "mixing", "encoding"]
    assert all(d.columns == raw.columns for d in stages[:-1])
    scorer = Scorer(language_model(raw))
    want = {r.doc_id for r in raw.collect() for lang, s in [scorer.predict(r.text)] if lang != "und" and s >= 0.5}
    assert {r.doc_id for r in identified.collect()} == want
    model = rule_model(spark, SF, identified)
    rows = identified.collect()
    stats = [rule_statistics(r.text) for r in rows]
    scores = model.forest.score(np.array([s.features() for s in stats]))
    want = {r.doc_id for r, s, a in zip(rows, stats, scores) if not s.base_failed and a < model.threshold}
    assert {r.doc_id for r in good.collect()} == want
    rows = good.collect()
    kept, pairs, joined = {r.doc_id for r in single.collect()}, *near_pairs({r.doc_id: r.text for r in rows})
    missed = kept & {i for i, r in joined.items() if r != i}
    assert {i for i, r in joined.items() if r == i} <= kept  # nothing else goes
    assert pairs and len(missed) <= 0.1 * (len(joined) - len(set(joined.values())))
    taken = {r.doc_id: r.taken for r in mixing.mix_counts(single).collect()}
    have = {}
    for r in mixed.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + len(r.text.encode().split())
    assert have == {i: n for i, n in taken.items() if n}
    byte_bpe = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = sorted((r.doc_id, len(byte_bpe.encode(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in encoded.collect()) == want


def test_stages_drop_junk_and_keep_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[2].collect()}
    before = {r.doc_id: len(r.text.split()) for r in stages[1].collect()}
    clean = [i for i in before if labels.get(i) == 1 and before[i] >= 10]
    junk = [i for i in before if labels.get(i) == 0]
    assert sum(i in kept for i in clean) / len(clean) > 0.97 and sum(i in kept for i in junk) / len(junk) < 0.1


def test_run_gives_the_same(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].collect()))


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
