import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.common import fold
from quire.llm.lm_scoring import LogBilinear, Scorer, Vocabulary, class_ids, contexts, count_tokens, fit, learn_and_score, rare_from, score, vocabulary, waves
from quire.llm.queries import op6_lm_scoring


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), " "]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base(rows):
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return {(i, x): (len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x))) for i, x in rows}


@pytest.mark.parametrize("head", [3, 100_000])
def test_base_equals_brute_force(spark, head):
    rows = [(i, "The cat SAT on É the\tmat\x0b" + " w%d" % (i % 7) * (i % 5)) for i in range(60)]
    rows += [(None, "no id"), (1, None), (2, ""), (3, "unseen\xa0word"), (3, "unseen\xa0word"), (4, "long " * 60_000)]
    df = spark.createDataFrame([(i, t, None, 1) for i, t in rows], "doc_id long, text string, score double, c int")
    got = learn_and_score(df, fold("doc_id", 7) != 2, head=head, short=2, dim=4).collect()
    want = base(rows)
    assert len(got) == len(rows)
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert have == sorted((-1 if i is None else i, a, b, n, round(s, 6)) for (i, t) in rows for a, b, n, s in [want[i, t]])
    assert all(r.score < 0 for r in got)


def test_probabilities_are_normalised(spark):
    rows = [(i, "a b c a b d e%d" % (i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = count_tokens(df)
    vocab = vocabulary(counts, 5, 3)
    model = fit(df, vocab, dim=4)
    u, v, z = model.tables()
    for near in range(vocab.size + 1):
        for far in range(vocab.size + 1):
            assert abs(np.exp(u[near] + v[far] - z[near, far]).sum() - 1) < 1e-4
    # All texts of one token before the end: their first token's probabilities add up to one.
    known = [r.token for r in counts.collect() if r.token != " "]
    one = spark.createDataFrame([(i, w) for i, w in enumerate([*known, "unknown"])] + [(99, "")], "doc_id long, text string")
    ends = {}
    for r in score(one, counts, vocab, model).collect():
        text = "" if r.doc_id == 99 else [*known, "unknown"][r.doc_id]
        end, other, before = vocab.size - 2, vocab.size - 1, vocab.size
        t = vocab.short.index(text) if text in vocab.short else other
        last = u[t, end] + v[before, end] - z[t, before] if text else 0.0
        ends[text] = 10 ** (r.score - last / math.log(10))
    assert abs(sum(ends.values()) - 1) < 1e-3


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    rows = op6_lm_scoring(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(r.held_out == held(r.doc_id) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = base([(r.doc_id, r.text) for r in texts])
    by_id = {i: w for (i, _), w in want.items()}
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == by_id[r.doc_id][:3]
        assert math.isclose(r.base_score, by_id[r.doc_id][3], rel_tol=1e-9)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    t = np.arange(4000) % 5  # each token is certain from the one before
    near, far = np.roll(t, 1), np.roll(t, 2)
    model, q = LogBilinear(6, 8), np.full(6, 1 / 6)
    state = np.zeros(len(model.values))
    for _ in range(200):
        model.train(t, near, far, q, state, rng)
    u, v, z = model.tables()
    assert np.exp(u[near, t] + v[far, t] - z[near, far]).mean() > 0.8


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = learn_and_score(df, F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    assert learn_and_score(df.limit(0), F.lit(True)).count() == 0
    assert Vocabulary(0, 0, {}, ()).other_total == 1


def test_rare_words_have_vectors_and_both_levels_are_normalised(spark):
    # A rare word is followed by a rare word that it determines; no word is among the short ones.
    rows = [(i, " ".join(f"a{(i * 7 + k) % 40} b{(i * 7 + k) % 40}" for k in range(20))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = count_tokens(df)
    vocab = vocabulary(counts, 10, 2, rare_from)
    assert len(vocab.rare) == 78 and vocab.groups > 1 and vocab.other_total == 1
    model = fit(df, vocab, dim=8, passes=20)
    scorer, place = Scorer(vocab, model), class_ids(vocab)
    a, b = (int(place([w.encode()])[0]) for w in vocab.rare[:2])
    ends = [place([w.encode()])[:1] for w in [*vocab.short, *vocab.rare, "unknown"]] + [place([])]
    x = np.concatenate([[a, b, int(e[0])] for e in ends])
    t, near, far, words = contexts([np.array(x, dtype=np.int32)], vocab)
    at = np.arange(2, len(x), 3)
    assert abs(np.exp(scorer(t[at], near[at], far[at], words[at])).sum() - 1) < 1e-4
    texts = [(i, f"a{i} b{i}") for i in range(40)] + [(100 + i, f"a{i} b{(i + 20) % 40}") for i in range(40)]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(texts, df.schema), counts, vocab, model).collect()}
    assert sum(got[i] for i in range(40)) > sum(got[100 + i] for i in range(40)) + 20


def test_vocabulary_follows_the_corpus(spark):
    sizes = []
    for sf in ("sf0.01", "sf0.1"):
        counts = count_tokens(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).cache()
        vocab = vocabulary(counts, 100_000, 1000, rare_from)
        have = {r.token for r in counts.filter(F.col("c") >= rare_from(vocab.tokens)).collect()} - {" "}
        assert have == {*vocab.short, *vocab.rare}
        sizes.append(len(have))
    assert sizes[1] > 1.5 * sizes[0] > 3000


def test_scores_do_not_depend_on_the_split(spark):
    assert waves(1) == [(0, 1)] and waves(11) == [(0, 1), (1, 2), (2, 3), (3, 6), (6, 11)]
    rows = [(i, " ".join(f"a{(i * 7 + k) % 30} b{(i * 7 + k) % 30}" for k in range(20))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = count_tokens(df)
    vocab, got = vocabulary(counts, 100, 5, rare_from), []
    for n in (1, 200):
        split = df.repartition(n)
        model = fit(split, vocab, dim=4, part_tokens=8000, passes=4)
        got.append({r.doc_id: r.score for r in score(split, counts, vocab, model).collect()})
    assert all(math.isclose(s, got[1][i], rel_tol=1e-6) for i, s in got[0].items())
    assert sum(got[1].values()) > sum(r.base_score for r in score(df, counts, vocab, model).collect())
