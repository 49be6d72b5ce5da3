"""Language-model scoring: counts of all training tokens, and a log-bilinear model on top.

Tokens are the words of a text, A-Z lower-cased, and one end.  Counts of all training tokens
are summed by Spark into a table that grows with the corpus.  Its ``head`` most frequent words
are known to every task; the counts of all other words are joined, and as none of them is
frequent, no key of that join is.

The model predicts the next class from the two tokens before: one of ``short`` frequent words,
a group of *rare* words, the end, or any other word.  The context vector is the sum of two linear
maps of their vectors, and the score of a class is its product with the class's vector plus a
bias.  A rare word has a vector of its own, as a context and as a member of its group, in which
it is predicted by a second softmax.  Rare words are all whose count reaches a bound that rises
with the root of the corpus, so that their number and the share of tokens with a vector grow
with it; groups hold about the root of their number.

It is trained in numpy by noise-contrastive estimation on both levels.  Training parts hold a
fixed number of tokens and are dealt by a hash of id and text, so they do not depend on how the
input is split.  A pass over the corpus goes in waves, each of about as many parts as all before
it: the parts of a wave start from the average of the last one, so what a part learns from grows
with the corpus while every document is read once.  After a wave values and optimiser states are
averaged, each row weighted by its uses, which adds up in two steps.

With ``exp(u)`` and ``exp(v)`` the exponentials of a class's score parts from either context
word, the normaliser of all contexts that are classes is one matrix product; other normalisers
are summed in blocks, so log-probabilities are exact.  Another word has the probability of its
class times ``(c + 1)`` over all counts and words of that class plus one; the model so is
normalised over known words and one unknown.

Null texts count as empty and consist of the end alone.  Rows repeat as given; a document
without an id is trained on.  Without training documents all counts are 0 and the model is
uniform.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, map_batches

END = " "  # no word holds white space


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def count_tokens(docs: DataFrame, text_col: str = "text", flush: int = 200_000) -> DataFrame:
    """(token, c) over whole texts; each task adds up before it hands rows on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows():
            batch = pa.RecordBatch.from_arrays(
                [pa.array([w.decode("utf-8", "replace") for w in found], pa.string()), pa.array(found.values(), pa.int64())],
                names=["token", "c"],
            )
            found.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                found.update(words_of(text.as_py()))
                found[END.encode()] += 1
                if len(found) > flush:
                    yield rows()
        if found:
            yield rows()

    partial = docs.select(text_col).mapInArrow(run, "token string, c bigint")
    return partial.groupBy("token").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Vocabulary:
    """What every task knows of the counts: totals and the most frequent words."""

    tokens: int
    distinct: int
    head: dict[str, int]
    short: tuple[str, ...]
    rare: tuple[str, ...] = ()

    @property
    def width(self) -> int:
        """Rare words in a group."""
        return math.isqrt(max(0, len(self.rare) - 1)) + 1

    @property
    def groups(self) -> int:
        return -(-len(self.rare) // self.width)

    @property
    def size(self) -> int:
        """Predicted classes: the short list, the groups, the end, any other word."""
        return len(self.short) + self.groups + 2

    @property
    def other_total(self) -> int:
        """Counts and words of the class of other words, and one for an unknown word."""
        inner = sum(self.head[w] for w in self.short + self.rare) + self.head.get(END, 0)
        return self.tokens - inner + self.distinct - len(self.short) - len(self.rare) - (END in self.head) + 1

    def rare_counts(self) -> np.ndarray:
        return np.array([self.head[w] for w in self.rare], dtype=np.float64)

    def classes(self) -> np.ndarray:
        """Smoothed frequencies of the classes."""
        groups = np.bincount(np.arange(len(self.rare)) // self.width, self.rare_counts()).tolist()
        counts = [self.head[w] for w in self.short] + groups + [self.head.get(END, 0)]
        n = np.array([*counts, self.tokens - sum(counts)], dtype=np.float64) + 1
        return n / n.sum()


def rare_from(tokens: int) -> int:
    """The count from which a word has a vector of its own."""
    return max(5, math.isqrt(tokens) // 100)


def vocabulary(counts: DataFrame, head: int, short: int, vectors_from: Callable[[int], int] | None = None) -> Vocabulary:
    """The totals, and the head of the count table: ``head`` words, or all that have a vector.

    Words are counted by the power of two their count reaches, and the head is all words from
    the lowest power that leaves no more than ``head``; only these come to the driver.
    """
    power = F.floor(F.log2("c")).cast("int")
    sizes = counts.groupBy(power.alias("power")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    tokens, distinct = sum(r.c for r in sizes), sum(r.n for r in sizes)
    lowest, above = 64, 0
    for r in sorted(sizes, reverse=True):
        above += r.n
        if above > head:
            break
        lowest = r.power
    bound = None if vectors_from is None else vectors_from(tokens)
    top = counts.filter(power >= lowest if bound is None else (power >= lowest) | (F.col("c") >= bound)).toArrow()
    known = dict(sorted(zip(*(c.to_pylist() for c in top.select(["token", "c"]).columns), strict=True), key=lambda r: (-r[1], r[0])))
    end = counts.filter(F.col("token") == END).first()
    if end is not None:
        known[END] = end.c
    words = [w for w in known if w != END]
    rare = () if bound is None else tuple(w for w in words[short:] if known[w] >= bound)
    return Vocabulary(tokens, distinct, known, tuple(words[:short]), rare)


class LogBilinear:
    """Parameters in one vector: vectors of classes, of the place before the text and of rare
    words, two context maps, biases of classes and of rare words."""

    def __init__(self, classes: int, dim: int, values: np.ndarray | None = None, seed: int = 5, rare: int = 0):
        self.classes, self.dim, self.rare = classes, dim, rare
        self.rows = classes + 1 + rare
        n = self.rows * dim
        shapes = [n, dim * dim, dim * dim, classes + rare]
        if values is None:
            rng = np.random.default_rng(seed)
            values = np.concatenate(
                [rng.normal(0, 0.1, n), *[np.eye(dim).ravel() * 0.5] * 2, np.zeros(classes + rare)]
            ).astype(np.float32)
        self.values = values
        ends = np.cumsum(shapes)
        self.vectors = values[:n].reshape(self.rows, dim)
        self.maps = values[n : ends[2]]
        self.near = values[n : ends[1]].reshape(dim, dim)
        self.far = values[ends[1] : ends[2]].reshape(dim, dim)
        self.bias = values[ends[2] :]

    def train(
        self, tokens: np.ndarray, near: np.ndarray, far: np.ndarray, noise_of: np.ndarray, state: np.ndarray,
        rng: np.random.Generator, noise: int = 32, rate: float = 0.1, words: np.ndarray | None = None,
        members: tuple[np.ndarray, int] | None = None, uses: np.ndarray | None = None, inner: int = 3,
    ) -> None:
        """One step of noise-contrastive estimation on a batch of classes with their contexts.

        The noise classes are shared by the batch, so their scores are one matrix product.  Of
        ``words`` that are rare (others are below zero) each is also told from ``inner`` words
        drawn from its group by the running counts and the width in ``members``.  Steps are
        scaled by the root of the summed squares of past gradients (``state``); ``uses`` adds up
        how often each row and bias was used.
        """
        dim, v, n = self.dim, self.vectors, len(tokens)
        drawn = rng.choice(len(noise_of), noise, p=noise_of)
        shift = np.log(noise * noise_of).astype(np.float32)
        a, b, out, other = v[near], v[far], v[tokens], v[drawn]
        q = a @ self.near + b @ self.far
        right = 1 / (1 + np.exp((q * out).sum(1) + self.bias[tokens] - shift[tokens]))
        wrong = -1 / (1 + np.exp(-(q @ other.T + self.bias[drawn] - shift[drawn])))
        back = right[:, None] * out + wrong @ other
        rows, steps = [tokens, near, far, drawn], [right[:, None] * q, None, None, wrong.T @ q]
        places, pulls = [tokens, drawn], [right, wrong.sum(0)]
        if words is not None and len(at := np.flatnonzero(words >= 0)):
            (ends, width), w, qw = members, words[at], q[at]
            low, first = w // width * width, self.classes
            least = np.where(low > 0, ends[low - 1], 0.0)
            most = ends[np.minimum(low + width, len(ends)) - 1]
            found = np.searchsorted(ends, least[:, None] + rng.random((len(w), inner)) * (most - least)[:, None], "right")
            found = np.clip(found, low[:, None], np.minimum(low + width, len(ends))[:, None] - 1)
            pick = np.concatenate([w[:, None], found], axis=1)
            share = np.log(inner * (ends[pick] - np.where(pick > 0, ends[pick - 1], 0.0)) / (most - least)[:, None]).astype(np.float32)
            vectors = v[first + 1 + pick]
            pull = np.einsum("nd,nkd->nk", qw, vectors) + self.bias[first + pick] - share
            pull[:, 0] = 1 / (1 + np.exp(pull[:, 0]))
            pull[:, 1:] = -1 / (1 + np.exp(-pull[:, 1:]))
            back[at] += np.einsum("nk,nkd->nd", pull, vectors)
            rows.append((first + 1 + pick).ravel())
            steps.append((pull[:, :, None] * qw[:, None, :]).reshape(-1, dim))
            places.append((first + pick).ravel())
            pulls.append(pull.ravel())
        steps[1], steps[2] = back @ self.near.T, back @ self.far.T
        self._apply(np.concatenate(rows), np.concatenate(steps), v, state[: v.size].reshape(v.shape), n, rate, uses, 0)
        grad = np.concatenate([(a.T @ back).ravel(), (b.T @ back).ravel()]) / n
        past = state[v.size : v.size + len(grad)]
        past += grad * grad
        self.maps += rate * grad / np.sqrt(past + 1e-8)
        bias, past = self.bias[:, None], state[v.size + len(grad) :][:, None]
        self._apply(np.concatenate(places), np.concatenate(pulls)[:, None], bias, past, n, rate, uses, self.rows)

    @staticmethod
    def _apply(rows, steps, values, state, n, rate, uses, first) -> None:
        """Add up the steps of each row that is used, and move these rows only."""
        order = np.argsort(rows, kind="stable")
        row = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        used = row[starts]
        grad = np.add.reduceat(steps[order].astype(np.float32), starts, axis=0) / np.float32(n)
        past = state[used] + grad * grad
        state[used] = past
        values[used] += rate * grad / np.sqrt(past + 1e-8)
        if uses is not None:
            uses[first + used] += np.diff(np.append(starts, len(row)))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-score parts of (near token, token) and (far token, token), and all log normalisers."""
        out, of = self.vectors[: self.classes], self.vectors[: self.classes + 1]
        u = of @ self.near @ out.T
        v = of @ self.far @ out.T + self.bias[: self.classes]
        top_u, top_v = u.max(1, keepdims=True), v.max(1, keepdims=True)
        z = np.log(np.exp(u - top_u) @ np.exp(v - top_v).T) + top_u + top_v.T
        return u.astype(np.float32), v.astype(np.float32), z.astype(np.float32)


def class_ids(vocab: Vocabulary):
    """A function from words to the rows of their vectors, with the end."""
    ids = {w.encode(): i for i, w in enumerate(vocab.short)}
    ids.update((w.encode(), vocab.size + 1 + i) for i, w in enumerate(vocab.rare))
    end, other = vocab.size - 2, vocab.size - 1

    def run(words: list[bytes]) -> np.ndarray:
        get = ids.get
        x = np.fromiter((get(w, other) for w in words), dtype=np.int32, count=len(words))
        return np.append(x, np.int32(end))

    return run


def contexts(texts: list[np.ndarray], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classes, near, far, rare words or below zero) of the rows of whole texts, one after another."""
    x = np.concatenate(texts).astype(np.int64)
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    near = np.concatenate([[0], x[:-1]])
    near[starts] = vocab.size
    far = np.concatenate([[0], near[:-1]])
    far[starts] = vocab.size
    words = np.where(x > vocab.size, x - vocab.size - 1, -1)
    return np.where(words >= 0, len(vocab.short) + words // vocab.width, x), near, far, words


class Scorer:
    """Exact natural log-probabilities of tokens, both levels."""

    def __init__(self, vocab: Vocabulary, model: LogBilinear):
        self.vocab, self.classes = vocab, model.classes
        self.near, self.far = (np.float32(model.vectors @ m) for m in (model.near, model.far))
        self.vectors, self.bias = np.float32(model.vectors), np.float32(model.bias)
        self.z = model.tables()[2]

    @staticmethod
    def total(scores: np.ndarray) -> np.ndarray:
        top = scores.max(1)
        scores -= top[:, None]
        np.exp(scores, out=scores)
        return np.log(scores.sum(1)) + top

    def __call__(self, t: np.ndarray, near: np.ndarray, far: np.ndarray, words: np.ndarray, block: int = 256) -> np.ndarray:
        c, v = self.classes, self.vectors
        q = self.near[near] + self.far[far]
        found = np.einsum("nd,nd->n", q, v[t]) + self.bias[t]
        plain = (near <= c) & (far <= c)
        found[plain] -= self.z[near[plain], far[plain]]
        _, first, same = np.unique(near[~plain] * np.int64(len(v)) + far[~plain], return_index=True, return_inverse=True)
        some, norms = np.flatnonzero(~plain)[first], np.empty(len(first), dtype=np.float32)
        for at in range(0, len(some), block):
            norms[at : at + block] = self.total(q[some[at : at + block]] @ v[:c].T + self.bias[:c])
        found[~plain] -= norms[same]
        at = np.flatnonzero(words >= 0)
        group = words[at] // self.vocab.width
        at = at[np.argsort(group, kind="stable")]
        ends = np.cumsum(np.bincount(group, minlength=self.vocab.groups))
        for g in np.unique(group):
            own = at[ends[g - 1] if g else 0 : ends[g]]
            low, high = g * self.vocab.width, min((g + 1) * self.vocab.width, len(self.vocab.rare))
            scores = q[own] @ v[c + 1 + low : c + 1 + high].T + self.bias[c + low : c + high]
            found[own] += scores[np.arange(len(own)), words[own] - low] - self.total(scores)
        return found


def waves(parts: int) -> list[tuple[int, int]]:
    """The parts of a pass in waves: a sixteenth of them first, then as many as all before."""
    ends = sorted({-(-parts // n) for n in (16, 8, 4, 2, 1)})
    return list(zip([0, *ends[:-1]], ends, strict=True))


def fit(
    docs: DataFrame, vocab: Vocabulary, dim: int = 16, passes: int = 1, batch: int = 4096, text_col: str = "text",
    id_col: str = "doc_id", part_tokens: int = 2_000_000,
) -> LogBilinear:
    """Train over all documents, ``passes`` times; each wave starts from the average of the last."""
    spark = docs.sparkSession
    model = LogBilinear(vocab.size, dim, rare=len(vocab.rare))
    noise_of, counts = vocab.classes(), vocab.rare_counts()
    model.bias[: vocab.size] = np.log(noise_of)
    if len(counts):
        sums = np.bincount(np.arange(len(counts)) // vocab.width, counts)
        model.bias[vocab.size :] = np.log(counts / np.repeat(sums, vocab.width)[: len(counts)])
    members = (np.cumsum(counts), vocab.width)
    parts = max(1, -(-vocab.tokens // part_tokens))
    tasks = min(parts, 2 * spark.sparkContext.defaultParallelism)
    key = F.xxhash64(id_col, text_col)

    def start():
        rows = class_ids(vocab)
        return lambda keys, parts, texts: (keys, parts, [rows(words_of(t)).tobytes() for t in texts])

    given = docs.select(key.alias("key"), F.pmod(key, F.lit(parts)).cast("int").alias("part"), text_col)
    dealt = map_batches(given, "key bigint, part int, x binary", start).repartitionById(tasks, F.col("part") % tasks)
    dealt = cut(dealt.sortWithinPartitions("part", "key", "x"))
    schema = "weight double, sums binary"  # as bytes, which the driver holds once

    def total(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, sums = 0.0, None
            for b in batches:
                for w, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    values = np.frombuffer(s.as_py(), kind)
                    weight, sums = weight + w, values.astype(np.float64) if sums is None else sums + values
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([sums.tobytes()])], names=["weight", "sums"])

        return run

    def weights(uses: np.ndarray, seen: float) -> np.ndarray:
        rows = vocab.size + 1 + len(vocab.rare)
        return np.concatenate([np.repeat(uses[:rows], dim), np.full(2 * dim * dim, seen), uses[rows:]])

    def step(model: LogBilinear, state: np.ndarray, number: int, low: int, high: int) -> tuple[LogBilinear, np.ndarray]:
        shared, size = spark.sparkContext.broadcast((model.values, state)), len(model.values)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, past = shared.value
            part, sums, seen_all = None, None, 0.0
            own = waiting = None

            def run():
                t, near, far, words = contexts(waiting, vocab)
                for at in range(0, len(t), batch):
                    to = slice(at, at + batch)
                    own.train(t[to], near[to], far[to], noise_of, own_state, rng, words=words[to], members=members, uses=uses)
                return len(t)

            def close():
                nonlocal sums, seen_all
                seen = n_seen + (run() if waiting else 0)
                w = weights(uses, seen)
                more = np.concatenate([(own.values - first) * w, (own_state - past) * w, uses])
                sums, seen_all = more if sums is None else sums + more, seen_all + seen

            for b in batches:
                for p, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if p != part:
                        if own is not None:
                            close()
                        part, waiting, n, n_seen = p, [], 0, 0
                        own = LogBilinear(vocab.size, dim, first.copy(), rare=len(vocab.rare))
                        own_state, uses = past.copy(), np.zeros(own.rows + len(own.bias))
                        rng = np.random.default_rng([3, number, p])
                    waiting.append(np.frombuffer(x.as_py(), np.int32))
                    n += len(waiting[-1])
                    if n >= 4 * batch:
                        n_seen += run()
                        waiting, n = [], 0
            if own is not None:
                close()
                found = sums.astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([seen_all]), pa.array([found])], names=["weight", "sums"])

        trained = dealt.filter((F.col("part") >= low) & (F.col("part") < high)).select("part", "x").mapInArrow(learn, schema)
        for n, kind in ((max(1, math.isqrt(min(tasks, high - low))), "<f4"), (1, "<f8")):
            trained = trained.repartition(n).mapInArrow(total(kind), schema)
        sums = trained.collect()
        shared.destroy()  # also the driver's copy: the next wave has its own
        if not (seen := sum(r.weight for r in sums)):
            return model, state
        found = np.frombuffer(sums[0].sums)
        w = np.maximum(weights(found[2 * size :], seen), 1)
        values = (model.values + found[:size] / w).astype(np.float32)
        return LogBilinear(vocab.size, dim, values, rare=len(vocab.rare)), (state + found[size : 2 * size] / w).astype(np.float32)

    state = np.zeros(len(model.values), dtype=np.float32)
    for number in range(passes):
        for low, high in waves(parts):
            model, state = step(model, state, number, low, high)
    return model


def score(
    docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: LogBilinear, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    A task adds up what it knows and lists a text's words outside the head with their numbers;
    the lists are written once and joined with the counts.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model.values)
    dim = model.dim
    unit = math.log10(math.e)
    base_total = math.log10(vocab.tokens + vocab.distinct + 1)
    other_total = math.log10(vocab.other_total)

    def start():
        scorer = Scorer(vocab, LogBilinear(vocab.size, dim, shared.value, rare=len(vocab.rare)))
        rows, other = class_ids(vocab), vocab.size - 1
        short = {*vocab.short, *vocab.rare}
        logs = {w.encode(): math.log10(c + 1) for w, c in vocab.head.items()}
        others = {w.encode() for w in vocab.head if w not in short and w != END}

        def scored(texts, most=50_000):
            """Each text with its rows and the sum of its log-probabilities; texts of some tokens at a time."""
            waiting, n = [], 0
            for i, text in enumerate(texts):
                waiting.append((text, rows(words_of(text))))
                n += len(waiting[-1][1])
                if n >= most or i == len(texts) - 1:
                    logs = scorer(*contexts([t for _, t in waiting], vocab)).astype(np.float64)
                    starts = np.cumsum([0, *(len(t) for _, t in waiting)])[:-1]
                    for (text, t), log in zip(waiting, np.add.reduceat(logs, starts), strict=True):
                        yield text, t, float(log) * unit
                    waiting, n = [], 0

        def step(ids, texts):
            columns = [[] for _ in range(6)]
            for text, t, model_sum in scored(texts):
                words = words_of(text)
                found = Counter(words)
                head = logs.get(END.encode(), 0.0)
                known, tail_words, tail_counts, in_other = int(END.encode() in logs), [], [], 0.0
                for w, n in found.items():
                    log = logs.get(w)
                    if log is None:
                        tail_words.append(w.decode("utf-8", "replace"))
                        tail_counts.append(n)
                    else:
                        head += n * log
                        known += n
                        if w in others:
                            in_other += n * log
                n_other = int(np.count_nonzero(t == other))
                row = (
                    len(t), known, head - len(t) * base_total, model_sum + in_other - n_other * other_total, tail_words, tail_counts,
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            return ids, *columns

        return step

    schema = f"id {id_type}, n bigint, known bigint, base double, model double, words array<string>, numbers array<int>"
    rows = map_batches(docs.select(F.col(id_col), F.col(text_col)), schema, start)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    tail = rows.select("row", F.explode(F.arrays_zip("words", "numbers")).alias("t"))
    tail = tail.select("row", F.col("t.words").alias("token"), F.col("t.numbers").alias("k")).join(counts, "token")
    found = tail.groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("log"))
    whole = rows.drop("words", "numbers").join(found, "row", "left")
    log = F.coalesce("log", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"),
        (F.col("model") + log).alias("score"),
    )


def learn_and_score(
    docs: DataFrame, training: Column, head: int = 100_000, short: int = 250, dim: int = 16, passes: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Count and train on the rows where ``training`` holds, and score every document."""
    learn = docs.filter(training)
    counts = cut(count_tokens(learn, text_col))
    vocab = vocabulary(counts, head, short, rare_from)
    model = fit(learn, vocab, dim, passes, text_col=text_col, id_col=id_col)
    return score(docs, counts, vocab, model, id_col, text_col)
