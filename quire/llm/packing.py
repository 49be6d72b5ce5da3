"""Packing documents into token sequences: best fit, then local search by swaps.

A document is its token ids and one end id, cut into pieces of ``capacity`` tokens only where it
is longer.  Pieces of full length are sequences of their own.  The others are dealt at random into
groups of bounded size; a group is packed by best fit, longest first, and then improved: out of
the emptiest bins pieces move to fuller bins, or are exchanged one for one or two for one against
shorter pieces of these, whichever raises the sum of squared fills most.  A bin that has lost all
its pieces is gone.  The search ends when the bins are as few as the tokens allow, or when a pass
over the bins empties none.

Bins with little space left are final; the pieces of all others are dealt into fewer groups and
packed again, until one group is left or half of the pieces come back.  So no group grows with
the corpus, and what groups cannot fill by themselves meets at last.

Null texts count as empty: one piece that holds the end id.  Rows repeat as given and are packed
each; null ids stay.  An empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from quire.llm.common import cut, map_batches

# Control characters that Python takes for white space, and tokenizers do not.
_MARKS = re.compile(r"[\x1c-\x1f]")
_GAP = re.compile(r"[ \t\n\r]+")
# Letters whose lower case is one letter, so that a run of them is one word of the tokenizer.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_WITH_STOPS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and reads each word by itself.

    Then a text has the ids of its words in turn; those of up to ``max_words`` words of at most
    ``long_word`` characters are remembered between texts.  A run of plain letters is encoded in
    lower case and without the stops after it, many runs at once: a token that ends a word marks
    the border.  Ids are little-endian 32-bit integers.
    """

    def __init__(self, path: str, max_words: int = 800_000, long_word: int = 64):
        self.tokenizer, self.max_words, self.long_word = Tokenizer.from_file(path), max_words, long_word
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        probes = [" \t\r\n", *"ab"]
        words = self._ids("a \n b"), self._ids("Ab") + self._ids(",!")
        if not suffix or [len(self._ids(p)) for p in probes] != [0, 1, 1] or words != (self._ids("a") + self._ids("b"), self._ids("ab,!")):
            raise ValueError(f"{path} does not drop white space and case")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, stems: list[str], at_once: int = 200) -> None:
        plain = [s for s in stems if _PLAIN.fullmatch(s)]
        for low in range(0, len(plain), 50 * at_once):
            parts = [plain[at : at + at_once] for at in range(low, min(low + 50 * at_once, len(plain)), at_once)]
            found = self.tokenizer.encode_batch_fast(list(map(" ".join, parts)), add_special_tokens=False)
            for part, e in zip(parts, found, strict=True):
                ids = np.array(e.ids, "<u4")
                to = 4 * (np.flatnonzero(self.ends[ids]) + 1)
                data, at = ids.tobytes(), 0
                for stem, end in zip(part, to.tolist(), strict=True):
                    self.stems[stem] = data[at:end]
                    at = end
        other = [s for s in stems if s not in self.stems]
        for low in range(0, len(other), 10_000):
            part = other[low : low + 10_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.stems.update((s, np.array(e.ids, "<u4").tobytes()) for s, e in zip(part, found, strict=True))

    @staticmethod
    def _stem(word: str) -> tuple[str, str]:
        """Plain letters in lower case and the stops after them; any other word as it is."""
        found = _WITH_STOPS.fullmatch(word)
        return (found[1].lower(), found[2]) if found else (word, "")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        split = [_GAP.split(t) if _MARKS.search(t) else t.split() for t in (t or "" for t in texts)]
        words = set().union(*split)
        if len(self.known) > self.max_words:  # what the present texts use stays
            self.known = {w: self.known[w] for w in words if w in self.known}
            self.stems.clear()
        known, stems = self.known, self.stems
        new = {w: self._stem(w) for w in words if w not in known}
        self._learn(list({s for pair in new.values() for s in pair if s not in stems}))
        known.update((w, stems[stem] + stems[tail]) for w, (stem, tail) in new.items())
        rows = [b"".join(map(known.__getitem__, parts)) for parts in split]
        for w, (stem, _) in new.items():
            if len(w) > self.long_word:
                del known[w]
                stems.pop(stem, None)
        return rows


@lru_cache(maxsize=2)
def load(path: str) -> WordEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return WordEncoder(path)


OUTPUTS = {"ids": "array<int>", "ids_crc32": "bigint"}


def token_pieces(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = tuple(OUTPUTS),
) -> DataFrame:
    """Per piece its document, number, ``start`` in the document, ``length`` and the ``outputs``.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers.  The tokenizer file
    lies at ``path`` on every executor.  Nothing is shuffled.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    end, size = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def start():
        encoder = load(path)

        def step(ids, texts):
            rows = []
            for doc_id, x in zip(ids, encoder.encode(texts), strict=True):
                x += end
                for piece, at in enumerate(range(0, len(x), size)):
                    part = x[at : at + size]
                    found = {"ids": np.frombuffer(part, "<i4") if "ids" in outputs else None, "ids_crc32": zlib.crc32(part)}
                    rows.append((doc_id, piece, at // 4, len(part) // 4, *map(found.get, outputs)))
            return zip(*rows, strict=True) if rows else [[]] * (4 + len(outputs))

        return step

    schema = [f"`{id_col}` {id_type}, piece int, start bigint, length bigint", *[f"{n} {OUTPUTS[n]}" for n in outputs]]
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), ", ".join(schema), start)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: longest first, each into the fullest bin that takes it."""
    bins = np.empty(len(lengths), dtype=np.int64)
    with_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps, number = 0, 0  # a bit for each gap that some bin has
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = gaps >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = with_gap[gap].pop()
            if not with_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, b, number = capacity, number, number + 1
        bins[i] = b
        gap -= n
        with_gap[gap].append(b)
        gaps |= 1 << gap
    return bins


class Search:
    """Bins of pieces, improved by exchanges that raise the sum of squared fills."""

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins.copy(), capacity
        self.fill = np.bincount(bins, lengths, minlength=1).astype(np.int64)
        self.fewest = -(-int(lengths.sum()) // capacity)

    def used(self) -> int:
        return int(np.count_nonzero(self.fill))

    def squares(self) -> int:
        return int((self.fill**2).sum())

    def exchange(self, source: int) -> bool:
        """The best exchange out of a bin into fuller ones; False if none raises the squares.

        With ``d`` tokens more going than coming, squares rise by 2 d (fill of the target - fill
        of the source + d).  Moves come before exchanges, one for one before two for one.
        """
        own = np.flatnonzero(self.bins == source)
        sizes, first = np.unique(self.lengths[own], return_index=True)
        mine = self.fill[source]
        room = (self.fill >= mine) & (self.fill < self.capacity)
        room[source] = False
        targets = np.flatnonzero(room)
        if not len(targets):
            return False
        fill = self.fill[targets]
        gain = self._gain(sizes[:, None] + 0 * fill[None, :], fill, mine)
        if (best := gain.argmax()) >= 0 and gain.flat[best] > 0:
            s, t = divmod(int(best), len(targets))
            self._put([own[first[s]]], targets[t])
            return True
        theirs = np.flatnonzero(room[self.bins])
        fill, theirs_size = self.fill[self.bins[theirs]], self.lengths[theirs]
        i, j = np.triu_indices(len(own), 1)
        pair_sizes, at = np.unique(self.lengths[own[i]] + self.lengths[own[j]], return_index=True)
        out = [(sizes, [(own[k],) for k in first]), (pair_sizes, [(own[i[k]], own[j[k]]) for k in at])]
        for sums, pieces in out:
            for low in range(0, len(sums), 64):  # a bounded block of the table at a time
                gain = self._gain(sums[low : low + 64, None] - theirs_size[None, :], fill, mine)
                if (best := gain.argmax()) >= 0 and gain.flat[best] > 0:
                    s, t = divmod(int(best), len(theirs))
                    back, target = theirs[t], self.bins[theirs[t]]
                    self._put(pieces[low + s], target)
                    self._put([back], source)
                    return True
        return False

    def _gain(self, d: np.ndarray, fill: np.ndarray, mine: int) -> np.ndarray:
        if not d.size:
            return np.zeros((1, 1), dtype=np.int64)
        return np.where((d > 0) & (d <= self.capacity - fill), d * (fill - mine + d), 0)

    def _put(self, pieces, target: int) -> None:
        for p in pieces:
            self.fill[self.bins[p]] -= self.lengths[p]
            self.fill[target] += self.lengths[p]
            self.bins[p] = target

    def run(self, settled: int) -> np.ndarray:
        """Passes over the bins with more space than ``settled``, the emptiest first."""
        while True:
            before = self.used()
            order = np.argsort(self.fill, kind="stable")
            for source in order[self.fill[order] < self.capacity - settled]:
                if self.used() == self.fewest:
                    return self.bins
                while self.fill[source] and self.exchange(source):
                    pass
            if self.used() == before:
                return self.bins


def pack_group(lengths: np.ndarray, capacity: int, settled: int) -> np.ndarray:
    """The bin of each piece of one group."""
    return Search(lengths, best_fit(lengths, capacity), capacity).run(settled)


def places(lengths: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the pieces in their bins, in the order given, and the fills of these bins."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    _, first, count = np.unique(bins[order], return_index=True, return_counts=True)
    offset, fill = np.empty_like(lengths), np.empty_like(lengths)
    offset[order] = starts - np.repeat(starts[first], count)
    fill[order] = np.repeat(np.add.reduceat(lengths[order], first), count)
    return offset, fill


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 8192, settled: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless places of their ``length`` tokens.

    Lengths are 1 to ``capacity``.  About ``group_rows`` pieces form a group; a bin is final with
    up to ``settled`` tokens of space, a 32nd of the capacity unless given.  A sequence has the
    number of one of its rows.
    """
    settled = capacity // 32 if settled is None else settled
    given = cut(pieces.withColumn("_row", F.monotonically_increasing_id()))
    out = given.withColumn("sequence_id", F.col("_row")).withColumn("offset", F.lit(0).cast("bigint"))
    out = out.withColumn("_fill", F.col("length"))
    arrow = to_arrow_schema(out.schema)

    def run(group: pa.Table) -> pa.Table:
        group = group.drop_columns("_group").sort_by("_row")
        lengths, rows = group["length"].to_numpy().astype(np.int64), group["_row"].to_numpy()
        bins = pack_group(lengths, capacity, settled)
        offset, fill = places(lengths, bins)
        _, first, number = np.unique(bins, return_index=True, return_inverse=True)
        added = {"sequence_id": rows[first][number], "offset": offset, "_fill": fill}
        for name, values in added.items():
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group.select(arrow.names).cast(arrow)

    done = out.filter(F.col("length") == capacity)
    left = given.filter(F.col("length") < capacity)
    n, round_ = left.count(), 0
    while n:
        groups = -(-n // group_rows)
        key = F.pmod(F.xxhash64("_row", F.lit(round_)), F.lit(groups)).alias("_group")
        packed = cut(left.select("*", key).groupBy("_group").applyInArrow(run, out.schema))
        again = F.col("_fill") < capacity - settled
        more = packed.filter(again).count() if groups > 1 else 0
        if 2 * more > n:
            more = 0
        done = done.union(packed.filter(~again) if more else packed)
        left, n, round_ = packed.filter(again).select(given.columns), more, round_ + 1
    return done.drop("_row", "_fill")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the tokens of each sequence, at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
