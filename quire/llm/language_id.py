"""Language identification by known words, backing off to shorter and shorter character n-grams.

A word of a language's table scores its log frequency there.  Any other word scores by its
character n-grams, longest first: an n-gram that no language knows is replaced by the two
shorter ones it consists of, down to single characters.  The language with the largest sum
over all words of the text wins; ``score`` is its share of the probability.

Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing
could be learned.  Equal sums go to the first language in code point order.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import column_function, key_of, low_keys, map_batches

UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _RUN.findall(text.lower())


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies per language: ``words`` and ``grams`` map to rows of ``values``."""

    languages: tuple[str, ...]
    words: dict[str, int]
    grams: dict[str, int]
    values: np.ndarray
    rare: list[float]
    longest: int

    def word(self, word: str, gram_of) -> list[float]:
        """Log frequencies of one word; ``gram_of`` gives those of an n-gram."""
        if (known := self.words.get(word)) is not None:
            return self.values[known].tolist()
        if not any(map(str.isalpha, word)):
            return [0.0] * len(self.languages)
        marked = f"<{word}>"
        size = min(self.longest, len(marked))
        n = len(marked) - size + 1
        # Plain lists: a word has few n-grams and there are few languages.
        return [sum(c) / n for c in zip(*[gram_of(marked[at : at + size]) for at in range(n)], strict=True)]

    def gram(self, gram: str) -> list[float]:
        """Log frequencies of one n-gram, or the mean of its two shorter parts' if it is unknown."""
        if (known := self.grams.get(gram)) is not None:
            return self.values[known].tolist()
        if len(gram) == 1:
            return self.rare
        return [(a + b) / 2 for a, b in zip(self.gram(gram[:-1]), self.gram(gram[1:]), strict=True)]


class Grams(dict):
    """Values of n-grams, computed when they are first asked for."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model

    def __missing__(self, gram: str) -> list[float]:
        value = self[gram] = self.model.gram(gram)
        return value


class Table(dict):
    """Words to rows of a matrix, which doubles when it is full; a new word's row is computed."""

    def __init__(self, width: int, row_of):
        super().__init__()
        self.matrix, self.row_of = np.zeros((1024, width)), row_of

    def __missing__(self, key: str) -> int:
        row = self.row_of(key)
        at = self[key] = len(self)
        if at == len(self.matrix):
            self.matrix = np.vstack([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[at] = row
        return at

    def total(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return self.matrix[at].sum(0)


class Scorer:
    """Sums over texts; the values of at most ``limit`` words and n-grams are kept between texts."""

    def __init__(self, model: LanguageModel, limit: int = 100_000):
        self.model, self.limit = model, limit
        self._reset()

    def _reset(self) -> None:
        grams = Grams(self.model)
        self.grams = grams
        self.table = Table(len(self.model.languages), lambda word: self.model.word(word, grams.__getitem__))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not self.model.languages or not any(any(map(str.isalpha, w)) for w in words):
            return UNKNOWN, 0.0
        if max(len(self.table), len(self.grams)) > self.limit:
            self._reset()
        total = self.table.total(words)
        best = int(np.argmax(total))
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def training_sample(
    docs: DataFrame, per_language: int, where: Column, max_languages: int = 200
) -> DataFrame:
    """(doc_id, lang, text) of at most ``per_language`` documents of each language, by a hash.

    The documents of each language are counted first, for at most ``max_languages`` languages,
    the most frequent ones; about twice ``per_language`` ids of each are then ranked, and at
    most ``per_language * max_languages`` ids are broadcast.
    """
    keys = docs.filter(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang").dropna()
    there = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    most = F.lit(0)
    for r in there:
        most = F.when(F.col("lang") == r.lang, low_keys(per_language, r["count"])).otherwise(most)
    keys = keys.withColumn("key", key_of("doc_id")).filter(F.col("key") < most)
    order = Window.partitionBy("lang").orderBy("key", "doc_id")
    chosen = keys.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language)
    ids = F.broadcast(chosen.select("doc_id").distinct().limit(per_language * max_languages))
    learn = docs.filter(where & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    return learn.join(ids, "doc_id", "left_semi")


def fit_languages(
    sample: DataFrame, max_words: int = 20_000, max_grams: int = 20_000, longest: int = 4
) -> LanguageModel:
    """Learn from a bounded table (lang, text).

    Words and n-grams are counted per partition and summed by Spark; the driver gets the
    ``max_words`` and ``max_grams`` most frequent of each language.
    """

    def start():
        def step(langs, texts):
            per = defaultdict(Counter)
            for lang, text in zip(langs, texts, strict=True):
                per[lang].update(words_of(text or ""))
            rows = []
            for lang, words in per.items():
                grams = Counter()
                for word, n in words.items():
                    marked = f"<{word}>"
                    for size in range(1, longest + 1):
                        for at in range(len(marked) - size + 1):
                            grams[marked[at : at + size]] += n
                rows += [(lang, 0, k, n) for k, n in words.items()]
                rows += [(lang, len(k), k, n) for k, n in grams.items()]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4

        return step

    counts = map_batches(sample.select("lang", "text"), "lang string, kind int, item string, n bigint", start)
    counts = counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("lang", "kind")
    ranked = counts.withColumn("total", F.sum("n").over(group)).withColumn(
        "rank", F.row_number().over(group.orderBy(F.desc("n"), "item"))
    )
    rows = ranked.filter(F.col("rank") <= F.when(F.col("kind") == 0, max_words).otherwise(max_grams)).collect()
    languages = tuple(sorted({r.lang for r in rows}))
    place = {lang: i for i, lang in enumerate(languages)}
    totals: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    found: dict[tuple[int, str], np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for r in rows:
        totals[r.kind][place[r.lang]] = r.total
        found[r.kind, r.item][place[r.lang]] = r.n
    values = np.zeros((len(found), len(languages)))
    for at, ((kind, _), n) in enumerate(found.items()):
        values[at] = np.log((n + 0.5) / (totals[kind] + 0.5 * max_words))
    return LanguageModel(
        languages,
        {item: at for at, (kind, item) in enumerate(found) if kind == 0},
        {item: at for at, (kind, item) in enumerate(found) if kind},
        values,
        np.log(0.5 / (totals[1] + 0.5 * max_words)).tolist() if languages else [],
        longest,
    )


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``lang_pred`` and ``score``; nothing is shuffled."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def start():
        scorer = Scorer(model)

        def step(ids, texts):
            found = [scorer.predict(t) for t in texts]
            return ids, [f[0] for f in found], [f[1] for f in found]

        return step

    schema = f"`{id_col}` {id_type}, lang_pred string, score double"
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), schema, start)


def keep_identified(
    docs: DataFrame, model: LanguageModel, min_score: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """The documents with a language of at least ``min_score``, with all their columns."""

    def start():
        scorer = Scorer(model)

        def step(texts):
            return [lang != UNKNOWN and score >= min_score for lang, score in map(scorer.predict, texts)]

        return step

    return docs.filter(column_function("boolean", start)(F.col(text_col)))
