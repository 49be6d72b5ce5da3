import random
import re
from collections import Counter

import numpy as np

from quire.llm.common import labelled_sample
from quire.llm.quality_rules import IsolationForest, RuleModel, apply_rules, calibrate, fit_rules, keep_by_rules, rule_statistics


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def counts(s):
    return s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words


def test_statistics_equal_brute_force():
    rng = random.Random(3)
    for _ in range(800):
        text = "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "\t", "\x0b", "\x1c", "\xa0", "a b c d e "]) for _ in range(rng.randint(0, 80)))
        assert counts(rule_statistics(text)) == brute(text), repr(text)
    assert counts(rule_statistics(None)) == (0, 0, 0, 0, 0)


def test_forest_finds_what_stands_apart():
    rng = np.random.default_rng(1)
    usual, odd = rng.normal(0, 1, (400, 3)), rng.normal(8, 1, (20, 3))
    forest = IsolationForest().fit(np.vstack([usual, odd]))
    assert forest.score(odd).min() > np.quantile(forest.score(usual), 0.98)
    assert forest.score(np.zeros((0, 3))).shape == (0,)
    same = IsolationForest().fit(np.ones((5, 3)))
    assert len(set(same.score(np.ones((3, 3))))) == 1


def test_threshold():
    assert calibrate(np.array([0.1, 0.2, 0.8, 0.9]), np.array([1, 1, 0, 0])) == 0.5
    assert calibrate(np.array([0.1]), np.array([1])) is None


def make(spark, n=300):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            words = [w + rng.choice(["###", "***", "&&&"]) for w in words]
        rows.append((i, " ".join(words), "src"))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_documents(spark):
    docs, labels = make(spark)
    model = fit_rules(labelled_sample(docs, labels, 200))
    got = {r.doc_id: r for r in apply_rules(docs, model).collect()}
    assert len(got) == 300
    assert all(counts(r) == brute(t) for t, r in [(r.text, got[r.doc_id]) for r in docs.collect()])
    right = {v: [got[i].kept != v for i in range(300) if (i % 6 == 0) == v] for v in (True, False)}
    assert min(sum(x) / len(x) for x in right.values()) > 0.85
    assert {r.doc_id for r in keep_by_rules(docs, model).collect()} == {i for i, r in got.items() if r.kept}
    again = fit_rules(labelled_sample(docs.repartition(7), labels.repartition(3), 200))
    assert again.threshold == model.threshold


def test_edges(spark):
    rows = [(None, "a b", None), (1, None, None), (1, "", "x"), (2, "w " * 50_000, "x"), (2, "w " * 50_000, "x"), (3, " ".join(f"w{i}" for i in range(40_000)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = fit_rules(labelled_sample(docs, labels, 10))
    assert model == RuleModel(None, None)
    got = apply_rules(docs, model).collect()
    assert len(got) == 6
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == [(0, 2, False), (1, 0, False), (1, 0, False), (2, 50_000, False), (2, 50_000, False), (3, 40_000, True)]
    assert apply_rules(docs.limit(0), model).count() == 0
