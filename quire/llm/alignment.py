"""Alignment of two tokenizers by divide and conquer at shared cuts.

Both tokenizers cut the same bytes, a space and the text.  Where a token of either ends at the
same byte the text can be cut, and the stretch between two such cuts is a group: the tokens of
one side that say what the tokens of the other side say.  A document is divided at a common end
near its middle, found by bisecting the other side's ends, and its halves again, until an
interval has no common end inside and is a leaf.  All intervals of a batch of documents are
divided level by level, so a level is a handful of array operations.

The last tokens of a group end together and so are a link.  Links are counted per pair of ids
over the corpus.  The most frequent pairs, ``head`` at most, are known to every task; all other
pairs are joined, and as none of them is frequent, no key of that join is.

Both tokenizers read a text word by word: no token runs over the border between another
character and a space.  Words are therefore encoded once and remembered.

Null and empty texts, and texts whose token bytes are not a space and the text (a character that
one tokenizer rewrites), have no tokens: zeros, and an empty digest.  Rows repeat as given and
count each time; null ids stay.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.common import cut, map_batches
from quire.llm.token_counts import byte_letters

# From one space that follows another character than white space to the next.
_UNIT = re.compile(r"(?s).[^ ]*(?:(?<=[\s\x85\xa0\x1c-\x1f]) [^ ]*)*")
# Words that both tokenizers spell as they are.
_PLAIN = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]*")


class Pair:
    """Two tokenizers, A with byte-level pieces and B with word pieces, and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str, max_units: int = 500_000, long_unit: int = 64):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        with open(path_a, encoding="utf-8") as f:
            plain = json.load(f)["model"]["vocab"]
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if plain.get(token) == i else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path_b} has pieces that run over a space")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.size_a = np.array(list(map(len, self.bytes_a)), dtype=np.int64)
        self.size_b = np.array(list(map(len, self.bytes_b)), dtype=np.int64)
        # The text of an id and what follows it: A's from the left, within a group or last; B's from the right.
        names_a = [b"%d%s" % (i, end) for i in range(len(self.bytes_a)) for end in (b",", b"|")]
        self.names = names_a + [b"%d%s" % (i, end) for i in reversed(range(len(pieces))) for end in (b";", b",")]
        self.max_units, self.long_unit = max_units, long_unit
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.odd: set[str] = set()  # units of other bytes than their text's
        # A space by itself: what the model gives for it after another character.
        self.space = self.b.encode("a ")[len(self.b.encode("a")) :]

    def _ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """The ids of texts that begin with a space, and whether their bytes are the text's."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        out = []
        for text, x, y in zip(texts, ids_a, ids_b, strict=True):
            y = y or self.space  # the text is one space
            data = text.encode("utf-8", "replace")
            same = b"".join(map(self.bytes_a.__getitem__, x)) == data == b"".join(map(self.bytes_b.__getitem__, y))
            out.append((np.array(x, "<i4"), np.array(y, "<i4"), same))
        return out

    def _learn(self, units: list[str], at_once: int = 200) -> None:
        """Plain units are encoded many at once, and the ids parted where the units end."""
        plain, other = [], []
        for u in units:
            (plain if _PLAIN.fullmatch(u) else other).append(u)
        parts = [plain[at : at + at_once] for at in range(0, len(plain), at_once)]
        for low in range(0, len(parts), 50):
            found = self._ids(list(map("".join, parts[low : low + 50])))
            for part, (x, y, same) in zip(parts[low : low + 50], found, strict=True):
                ends = np.cumsum([len(u.encode()) for u in part])
                to_a, to_b = (np.searchsorted(np.cumsum(size[ids]), ends) + 1 for size, ids in ((self.size_a, x), (self.size_b, y)))
                if not same or (self.size_a[x].cumsum()[to_a - 1] != ends).any() or (self.size_b[y].cumsum()[to_b - 1] != ends).any():
                    other += part
                    continue
                data_a, data_b, p, q = x.tobytes(), y.tobytes(), 0, 0
                for u, r, s in zip(part, (4 * to_a).tolist(), (4 * to_b).tolist(), strict=True):
                    self.known_a[u], self.known_b[u] = data_a[p:r], data_b[q:s]
                    p, q = r, s
        for at in range(0, len(other), 10_000):
            part = other[at : at + 10_000]
            for u, (x, y, same) in zip(part, self._ids(part), strict=True):
                self.known_a[u], self.known_b[u] = x.tobytes(), y.tobytes()
                if not same:
                    self.odd.add(u)

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of each text by A and by B; none where the bytes are not a space and the text."""
        split = [_UNIT.findall(" " + t) if t else [] for t in texts]
        units = set().union(*split)
        if len(self.known_a) > self.max_units:  # what the present texts use stays
            self.known_a, self.known_b = ({u: d[u] for u in units if u in d} for d in (self.known_a, self.known_b))
            self.odd &= units
        new = [u for u in units if u not in self.known_a]
        self._learn(new)
        if not self.odd.isdisjoint(units):
            split = [parts if self.odd.isdisjoint(parts) else [] for parts in split]
        a, b = (
            [np.frombuffer(b"".join(map(known.__getitem__, parts)), "<i4") for parts in split] for known in (self.known_a, self.known_b)
        )
        for u in new:
            if len(u) > self.long_unit:
                del self.known_a[u], self.known_b[u]
                self.odd.discard(u)
        return a, b


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Pair:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Pair(path_a, path_b)


def _near_middle(a: np.ndarray, b: np.ndarray, low: int, high: int) -> int:
    """The place in ``a[low:high - 1]`` of a common end near the middle, or -1: widening windows."""
    middle, reach = (low + high) // 2, 64
    while True:
        left, right = max(low, middle - reach), min(high - 1, middle + reach)
        part = a[left:right]
        at = np.searchsorted(b, part)
        shared = left + np.flatnonzero(b[np.minimum(at, len(b) - 1)] == part)
        if len(shared):
            return int(shared[np.abs(shared - middle).argmin()])
        if left == low and right == high - 1:
            return -1
        reach *= 4


def divide(a: np.ndarray, b: np.ndarray, edges_a: np.ndarray, edges_b: np.ndarray, tries: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The last token of each group, as places in the rising byte ends ``a`` and ``b``.

    ``edges`` hold the number of tokens before each document and at the end; documents end at
    common ends.  Each level looks for a common end of every open interval next to its middle,
    ``tries`` places at once and then in widening windows, and opens the two halves.
    """
    low_a, high_a, low_b, high_b = edges_a[:-1], edges_a[1:], edges_b[:-1], edges_b[1:]
    some = high_a > low_a
    low_a, high_a, low_b, high_b = low_a[some], high_a[some], low_b[some], high_b[some]
    leaves_a, leaves_b = [], []
    while len(low_a):
        # A common end inside needs two tokens on both sides.
        split_a, split_b = np.full(len(low_a), -1), np.zeros(len(low_a), dtype=np.int64)
        todo = np.flatnonzero((high_a - low_a > 1) & (high_b - low_b > 1))
        middle = (low_a + high_a) // 2 - 1
        for k in range(tries):
            at = middle[todo] + (k + 1) // 2 * (1 if k % 2 else -1)
            inside = (at >= low_a[todo]) & (at < high_a[todo] - 1)
            ends = a[np.where(inside, at, low_a[todo])]
            found = np.searchsorted(b, ends)
            hit = inside & (b[np.minimum(found, len(b) - 1)] == ends)
            split_a[todo[hit]], split_b[todo[hit]] = at[hit], found[hit]
            todo = todo[~hit]
        for i in todo[high_a[todo] - low_a[todo] > tries + 1 if tries else slice(None)].tolist():
            split_a[i] = _near_middle(a, b, int(low_a[i]), int(high_a[i]))
            split_b[i] = np.searchsorted(b, a[split_a[i]]) if split_a[i] >= 0 else 0
        cut_ = split_a >= 0
        leaves_a.append(high_a[~cut_] - 1)
        leaves_b.append(high_b[~cut_] - 1)
        p, q = split_a[cut_] + 1, split_b[cut_] + 1
        low_a, high_a = np.concatenate([low_a[cut_], p]), np.concatenate([p, high_a[cut_]])
        low_b, high_b = np.concatenate([low_b[cut_], q]), np.concatenate([q, high_b[cut_]])
    marks_a, marks_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    for at_a, at_b in zip(leaves_a, leaves_b, strict=True):
        marks_a[at_a] = marks_b[at_b] = True
    return np.flatnonzero(marks_a), np.flatnonzero(marks_b)


class Aligned:
    """A batch of documents: their tokens one after another, and the groups."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        a, b = pair.encode(texts)
        none = np.zeros(0, dtype="<i4")
        self.ids_a, self.ids_b = np.concatenate([none, *a]), np.concatenate([none, *b])
        self.edges_a, self.edges_b = np.cumsum([0, *map(len, a)]), np.cumsum([0, *map(len, b)])
        # Both sides of a document have as many bytes, so its ends are common ends.
        ends_a, ends_b = np.cumsum(pair.size_a[self.ids_a]), np.cumsum(pair.size_b[self.ids_b])
        self.last_a, self.last_b = divide(ends_a, ends_b, self.edges_a, self.edges_b)
        self.edges = np.searchsorted(self.last_a, self.edges_a)

    def groups(self, i: int) -> list[tuple[list[int], list[int]]]:
        """The groups of one document as ids of A and of B."""
        to_a, to_b = (x[self.edges[i] : self.edges[i + 1]] + 1 for x in (self.last_a, self.last_b))
        from_a, from_b = (np.concatenate([[e[i]], t[:-1]]) for e, t in ((self.edges_a, to_a), (self.edges_b, to_b)))
        bounds = zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist(), strict=True) if len(to_a) else ()
        return [(self.ids_a[p:q].tolist(), self.ids_b[r:s].tolist()) for p, q, r, s in bounds]


def _in_turn(found: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of each group, those of A before those of B, as numbers into ``Pair.names``; documents' edges."""
    marks_a, marks_b = (np.zeros(len(x), dtype=np.int64) for x in (found.ids_a, found.ids_b))
    marks_a[found.last_a] = marks_b[found.last_b] = 1
    before_a, before_b = (np.append(0, x + 1) for x in (found.last_a, found.last_b))
    group_a, group_b = (np.cumsum(m) - m for m in (marks_a, marks_b))
    out = np.empty(len(marks_a) + len(marks_b), dtype=np.int64)
    out[np.arange(len(marks_a)) + before_b[group_a]] = 2 * found.ids_a + marks_a
    out[np.arange(len(marks_b)) + before_a[group_b + 1]] = -1 - (2 * found.ids_b + marks_b)
    return out, found.edges_a + found.edges_b


def align(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("groups", "groups_sha256", "links"),
) -> DataFrame:
    """Per document ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and the ``outputs``.

    ``groups`` are the ids of both sides, ``links`` pairs of ids as A times the size of B plus B,
    in little-endian 64-bit integers.  The digest is over ``a1,a2|b1;a3|b2,b3``.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    kinds = {"groups": "array<struct<a: array<int>, b: array<int>>>", "groups_sha256": "string", "links": "binary"}

    def start():
        pair = load(path_a, path_b)

        def one(texts):
            found = Aligned(pair, texts)
            e = found.edges
            columns = [np.diff(found.edges_a), np.diff(found.edges_b), np.diff(e), np.diff(e)]
            for name in outputs:
                if name == "groups":
                    columns.append([[{"a": x, "b": y} for x, y in found.groups(i)] for i in range(len(texts))])
                elif name == "links":
                    keys = found.ids_a[found.last_a].astype("<i8") * len(pair.bytes_b) + found.ids_b[found.last_b]
                    columns.append([keys[e[i] : e[i + 1]].tobytes() for i in range(len(texts))])
                else:
                    codes, to = _in_turn(found)
                    names = list(map(pair.names.__getitem__, codes.tolist()))
                    parts = [b"".join(names[to[i] : to[i + 1]])[:-1] for i in range(len(texts))]
                    columns.append([hashlib.sha256(p).hexdigest() if p else "" for p in parts])
            return columns

        def step(ids, texts):
            """Some documents at a time, so that their tokens are bounded by the longest document."""
            out = [[] for _ in range(4 + len(outputs))]
            at = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > 1 << 20 or i == len(texts) - 1:
                    for column, values in zip(out, one(texts[at : i + 1]), strict=True):
                        column.extend(values)
                    at, size = i + 1, 0
            return ids, *out

        return step

    counts = [f"{n} bigint" for n in ("n_a", "n_b", "n_groups", "n_links")]
    schema = ", ".join([f"`{id_col}` {id_type}", *counts, *[f"{n} {kinds[n]}" for n in outputs]])
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), schema, start)


def pair_counts(aligned: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(pair, c) over all ``links``; each task adds up before it hands rows on."""

    def run(batches):
        waiting, size = [], 0

        def total():
            keys, counts = (np.concatenate(x) for x in zip(*waiting, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, counts).astype(np.int64)

        def rows(keys, counts):
            for at in range(0, len(keys), 100_000):
                part = [pa.array(x[at : at + 100_000], pa.int64()) for x in (keys, counts)]
                yield pa.RecordBatch.from_arrays(part, names=["pair", "c"])

        for batch in batches:
            links = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")
            waiting.append(np.unique(links, return_counts=True))
            size += len(waiting[-1][0])
            if size > most:
                waiting = [total()]
                size = len(waiting[0][0])
                if size > most // 2:
                    yield from rows(*waiting[0])
                    waiting, size = [], 0
        if waiting:
            yield from rows(*total())

    return aligned.select("links").mapInArrow(run, "pair bigint, c bigint").groupBy("pair").agg(F.sum("c").alias("c"))


def with_best(counts: DataFrame, size_b: int) -> DataFrame:
    """(pair, c, best): whether no pair with the same id of B is more frequent."""
    by_b = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("c").alias("most"))
    found = counts.withColumn("b", F.col("pair") % size_b).join(by_b, "b")
    return found.select("pair", "c", (F.col("c") == F.col("most")).alias("best"))


def most_frequent(counts: DataFrame, head: int) -> tuple[pa.Table, Column]:
    """The pairs from the lowest power of two of the count that leaves ``head`` at most, and the rest's condition."""
    power = F.floor(F.log2("c")).cast("int")
    lowest, above = 64, 0
    for r in sorted(counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        above += r.n
        if above > head:
            break
        lowest = r.power
    return counts.filter(power >= lowest).orderBy("pair").toArrow(), power < lowest


def count_links(
    docs: DataFrame, path_a: str, path_b: str, head: int = 200_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document's tokens, groups and links, with ``n_best``, ``count_sum`` and ``groups_sha256``.

    ``count_sum`` adds up the corpus-wide counts of a document's links, ``n_best`` counts those
    with the highest count of their id of B.
    """
    size_b = len(load(path_a, path_b).bytes_b)
    aligned = align(docs, path_a, path_b, id_col, text_col, ("groups_sha256", "links"))
    aligned = cut(aligned.withColumn("_row", F.monotonically_increasing_id()))
    counts = cut(with_best(pair_counts(aligned), size_b))
    top, rest = most_frequent(counts, head)
    keys, numbers, best = (top[n].to_numpy() for n in ("pair", "c", "best"))
    shared = docs.sparkSession.sparkContext.broadcast((keys, numbers.astype(np.int64), best.astype(np.int64)))

    def start():
        keys, numbers, best = shared.value

        def step(rows, all_links):
            out = [[] for _ in range(4)]
            links = [np.frombuffer(x, "<i8") for x in all_links]
            edges = np.cumsum([0, *map(len, links)])
            given = np.concatenate([np.zeros(0, dtype=np.int64), *links])
            if len(keys):
                at = np.minimum(np.searchsorted(keys, given), len(keys) - 1)
                known = keys[at] == given
                c, is_best = np.where(known, numbers[at], 0), np.where(known, best[at], 0)
            else:
                known = c = is_best = np.zeros(len(given), dtype=np.int64)
            sums, bests = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(is_best)])
            for i in range(len(links)):
                own = slice(edges[i], edges[i + 1])
                pairs, times = np.unique(given[own][known[own] == 0], return_counts=True)
                values = bests[edges[i + 1]] - bests[edges[i]], sums[edges[i + 1]] - sums[edges[i]], pairs, times
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            return rows, *out

        return step

    schema = "_row bigint, best bigint, sum bigint, pairs array<bigint>, times array<bigint>"
    found = cut(map_batches(aligned.select("_row", "links"), schema, start))
    tail = found.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("t"))
    tail = tail.select("_row", F.col("t.pairs").alias("pair"), F.col("t.times").alias("k")).join(counts.filter(rest), "pair")
    more = tail.select("_row", F.when(F.col("best"), F.col("k")).otherwise(0).alias("best"), (F.col("k") * F.col("c")).alias("sum"))
    sums = found.select("_row", "best", "sum").union(more).groupBy("_row").agg(F.sum("best").alias("n_best"), F.sum("sum").alias("count_sum"))
    names = [id_col, "n_a", "n_b", "n_groups", "n_links"]
    return aligned.select(*names, "groups_sha256", "_row").join(sums, "_row").select(*names, "n_best", "count_sum", "groups_sha256")
