"""Quality rules: rule statistics of whole texts, fixed base rules, and an isolation forest.

The forest is grown on the rule statistics of a bounded sample of labelled documents; how
short a mean path counts as anomalous is calibrated on further labelled documents.  A document
is kept if it passes the base rules and the forest does not find it anomalous.

Null texts have no words and fail the base rules, as do empty ones.  Rows repeat as given.
Without labelled rows of both kinds there is no threshold and the base rules alone decide.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import column_function, map_batches

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes]) -> int:
    """Words within 5-word windows that occur twice or more in the text, the first included."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    hashed = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    window = np.zeros(n, dtype=np.uint64)
    for k in range(REPEAT_WINDOW):
        window = window * _MIX + hashed[k : k + n]
    if np.unique(window).size == n:  # equal windows have equal hashes, so none is repeated
        return 0
    windows = list(zip(*[words[k : k + n] for k in range(REPEAT_WINDOW)], strict=True))
    count = Counter(windows)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.fromiter((i for i, w in enumerate(windows) if count[w] > 1), dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + REPEAT_WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


@dataclass(frozen=True)
class RuleStatistics:
    """Counts of one text; all over whole texts."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_distinct: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words

    def features(self) -> tuple[float, ...]:
        """What the forest splits on: rates that hardly depend on the length of the text."""
        words = max(self.n_words, 1)
        return (
            self.word_chars / words,
            self.n_symbols / max(self.word_chars, 1),
            self.n_repeat_words / words,
            self.n_distinct / words**0.9,
        )


def rule_statistics(text: str | None) -> RuleStatistics:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return RuleStatistics(
        n_words=len(words),
        word_chars=len(text) - sum(map(text.count, _SPACE)),
        n_symbols=sum(map(text.count, SYMBOLS)),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated_words(words),
        n_distinct=len(set(words)),
    )


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    big = np.maximum(n, 3)
    many = 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big
    return np.where(n > 2, many, np.where(n > 1, 1.0, 0.0))


class IsolationForest:
    """Trees of random splits over random subsamples, as arrays.

    A tree is one row of ``feature``, ``split`` and ``size``; the children of node i are
    2i + 1 and 2i + 2, and a leaf has feature -1.
    """

    def __init__(self, trees: int = 200, subsample: int = 64, seed: int = 7):
        self.trees, self.subsample, self.seed = trees, subsample, seed

    def fit(self, rows: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        size = min(self.subsample, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(size, 2))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((self.trees, nodes), -1, dtype=np.int64)
        self.split = np.zeros((self.trees, nodes))
        self.size = np.zeros((self.trees, nodes), dtype=np.int64)
        for tree in range(self.trees):
            self._grow(tree, 0, 0, rows[rng.choice(len(rows), size, replace=False)], rng)
        self.unit = float(_mean_path(np.array([size]))[0]) or 1.0
        return self

    def _grow(self, tree: int, node: int, depth: int, rows: np.ndarray, rng: np.random.Generator) -> None:
        self.size[tree, node] = len(rows)
        low, high = rows.min(0), rows.max(0)
        varied = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) < 2 or not len(varied):
            return
        f = rng.choice(varied)
        at = rng.uniform(low[f], high[f])
        left = rows[:, f] < at
        if not left.any() or left.all():
            return
        self.feature[tree, node], self.split[tree, node] = f, at
        self._grow(tree, 2 * node + 1, depth + 1, rows[left], rng)
        self._grow(tree, 2 * node + 2, depth + 1, rows[~left], rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 to the minus mean path over its expectation: near 1 is anomalous, below 0.5 is not."""
        if not len(rows):
            return np.zeros(0)
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for tree in range(self.trees):
            node = np.zeros(len(rows), dtype=np.int64)
            depth = np.zeros(len(rows))
            for _ in range(self.depth):
                f = self.feature[tree, node]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[every, np.maximum(f, 0)] >= self.split[tree, node]
                node = np.where(inner, 2 * node + 1 + right, node)
                depth += inner
            total += depth + _mean_path(self.size[tree, node])
        return 2.0 ** (-total / self.trees / self.unit)


@dataclass(frozen=True)
class RuleModel:
    """A forest and the score from which a document is anomalous (None: never)."""

    forest: IsolationForest | None
    threshold: float | None

    def judge(self, texts: list[str | None]) -> tuple[list[RuleStatistics], np.ndarray, np.ndarray]:
        """Statistics, anomaly scores, and whether each text is kept."""
        stats = [rule_statistics(t) for t in texts]
        passed = np.array([not s.base_failed for s in stats], dtype=bool)
        scores = np.zeros(len(stats))
        if self.forest is not None and len(stats):
            scores = self.forest.score(np.array([s.features() for s in stats]))
        if self.threshold is not None:
            return stats, scores, passed & (scores < self.threshold)
        return stats, scores, passed


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float | None:
    """The threshold that best tells label 0 from label 1, in the middle of its gap.

    It maximises the rate of found label 0 less the rate of flagged label 1; of equally good
    ones it is the highest, which keeps most documents.
    """
    bad, good = np.sort(scores[labels == 0]), np.sort(scores[labels == 1])
    if not len(bad) or not len(good):
        return None
    points = np.unique(scores)
    found = 1 - np.searchsorted(bad, points) / len(bad)
    flagged = 1 - np.searchsorted(good, points) / len(good)
    best = np.flatnonzero(found - flagged == (found - flagged).max())[-1]
    below = points[best - 1] if best else points[best]
    return float((points[best] + below) / 2)


def fit_rules(labelled: DataFrame, trees: int = 200, subsample: int = 64, seed: int = 7) -> RuleModel:
    """Grow and calibrate the forest on a bounded table (doc_id, text, label).

    Documents of one parity of crc32(doc_id) grow the trees, the others that pass the base
    rules set the threshold.  Texts are measured on the executors; the driver gets one row of
    statistics per labelled document.
    """

    def start():
        def step(ids, texts, labels):
            stats = [rule_statistics(t) for t in texts]
            return ids, labels, [s.base_failed for s in stats], [list(s.features()) for s in stats]

        return step

    schema = "id bigint, label int, failed boolean, features array<double>"
    half = F.crc32(F.col("doc_id").cast("string"))
    rows = map_batches(labelled.select(half, "text", "label"), schema, start).collect()
    rows.sort(key=lambda r: (r.id, r.label, r.features))
    grow = np.array([r.features for r in rows if r.id % 2 == 0])
    rest = [r for r in rows if r.id % 2 and not r.failed]
    if not len(grow) or not rest:
        return RuleModel(None, None)
    forest = IsolationForest(trees, subsample, seed).fit(grow)
    scores = forest.score(np.array([r.features for r in rest]))
    return RuleModel(forest, calibrate(scores, np.array([r.label for r in rest])))


def apply_rules(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its rule statistics, ``base_failed``, ``anomaly`` and ``kept``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def start():
        def step(ids, texts):
            stats, scores, kept = model.judge(texts)
            return ids, *[[getattr(s, c) for s in stats] for c in counts], [s.base_failed for s in stats], scores, kept

        return step

    schema = f"`{id_col}` {id_type}, {', '.join(f'{c} bigint' for c in counts)}, base_failed boolean, anomaly double, kept boolean"
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), schema, start)


def keep_by_rules(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    passes = column_function("boolean", lambda: lambda texts: model.judge(texts)[2])
    return docs.filter(passes(F.col(text_col)))
