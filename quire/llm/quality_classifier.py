"""Quality classifier: averaged subword embeddings with a softmax output.

Every word and every character n-gram of it has a learned vector, found by a hash; the vectors
of a document are averaged and a linear layer gives the two classes.  Training is plain
stochastic gradient descent in numpy over a bounded labelled sample.  A word equal to the one
before it adds one more feature, so that runs of one word are visible in an average.

The output is linear in the average, so at scoring time each feature is one number and a
document's score needs the sum of these numbers over its features only.

Null and empty texts have no features and get the score of the bias.  Without labelled rows
every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches


@dataclass(frozen=True)
class Features:
    """Hashed features of words: the word itself and its n-grams with marked ends."""

    buckets: int = 1 << 14
    gram: int = 3

    def of_word(self, word: bytes) -> list[int]:
        text = f"<{word.decode('utf-8', 'replace')}>"
        keys = [word, *[text[i : i + self.gram].encode("utf-8", "replace") for i in range(len(text) - self.gram + 1)]]
        return [crc32(key) % self.buckets for key in keys]

    @property
    def same(self) -> int:
        """The feature of a word that repeats the word before it; it has a bucket of its own."""
        return self.buckets

    def of_text(self, text: str | None) -> Counter:
        words = (text or "").encode("utf-8", "replace").split()
        found: Counter = Counter()
        for word, n in Counter(words).items():
            for key in self.of_word(word):
                found[key] += n
        if same := sum(a == b for a, b in zip(words, words[1:], strict=False)):
            found[self.same] += same
        return found


@dataclass(frozen=True)
class QualityModel:
    """One number per feature, and a bias: the difference of the two outputs."""

    features: Features
    weight: np.ndarray
    bias: float

    def scorer(self, limit: int = 200_000):
        """A function from texts to scores that remembers the sums of up to ``limit`` words."""
        features, weight = self.features, self.weight

        class Sums(dict):
            """Per word the sum over its features, and as imaginary part their number."""

            def __missing__(self, word: bytes) -> complex:
                keys = features.of_word(word)
                self[word] = value = complex(weight[keys].sum(), len(keys))
                return value

        sums = Sums()

        def score(text: str | None) -> float:
            words = (text or "").encode("utf-8", "replace").split()
            if len(sums) > limit:
                sums.clear()
            total = sum(map(sums.__getitem__, words), 0j)
            same = sum(map(bytes.__eq__, words, words[1:]))
            total += same * complex(weight[features.same], 1)
            margin = self.bias + (total.real / total.imag if total.imag else 0.0)
            return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))

        return score


def train(
    texts: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    features: Features,
    dim: int = 16,
    epochs: int = 12,
    rate: float = 0.2,
    seed: int = 11,
) -> QualityModel:
    """Gradient descent over documents given as (feature ids, their shares)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (features.buckets + 1, dim))
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    if not len(labels):
        return QualityModel(features, np.zeros(features.buckets + 1), 0.0)
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            ids, share = texts[i]
            step = rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            # A document's features share its step; scaled up, as each has a small share.
            vectors[ids] -= step * np.minimum(share * len(ids), 8.0)[:, None] * back
    return QualityModel(features, vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def fit_quality(labelled: DataFrame, features: Features | None = None, **options) -> QualityModel:
    """Learn from a bounded table (doc_id, text, label).

    Features are counted on the executors; the driver gets the counts of the sample and does
    the descent over them in the order of the ids.
    """
    features = features or Features()

    def start():
        def step(ids, texts, labels):
            found = [features.of_text(t) for t in texts]
            return ids, labels, [list(f) for f in found], [list(f.values()) for f in found]

        return step

    schema = "doc_id bigint, label int, ids array<int>, counts array<int>"
    rows = map_batches(labelled.select("doc_id", "text", "label"), schema, start).collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.ids))
    texts = []
    for r in rows:
        counts = np.array(r.counts, dtype=np.float64)
        texts.append((np.array(r.ids, dtype=np.int64), counts / max(counts.sum(), 1)))
    return train(texts, np.array([r.label for r in rows], dtype=np.int64), features, **options)


def score_quality(
    docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document ``score`` (the probability of label 1) and ``predicted``."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def start():
        score = model.scorer()

        def step(ids, texts):
            scores = [score(t) for t in texts]
            return ids, scores, [int(s >= threshold) for s in scores]

        return step

    schema = f"`{id_col}` {id_type}, score double, predicted int"
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), schema, start)
