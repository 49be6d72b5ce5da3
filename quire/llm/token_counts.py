"""Token counts by a finite-state transducer that is compiled from a byte-level BPE tokenizer.

The transducer reads the bytes of one match of the splitting pattern.  A state holds, for every
earlier position from which a token can still reach beyond the present one, the place in the
tree of tokens, the last token before that position and the difference of the counts.  A token
may end the encoding if it stays next to the token before it, and exactly one does, so states
and transitions are deterministic; each transition carries the change of the token count.
There are finitely many states; they are compiled when first met, and the table is emptied
when it exceeds a bound, which costs time only.

A chunk of text is a map of states.  Wherever white space follows another character a match
ends, so a chunk with such a place brings every state to the start state there: its map is a
head whose count depends on what came before, a number, and a tail.  Maps compose
associatively, and a text's chunks are composed pairwise up a tree.

Null texts count as empty: no bytes, no tokens.  Rows repeat as given, null ids stay.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches

# The pattern of byte-level BPE tokenizers and the Unicode white space in it.
_WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+"
    rf"|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)
_SAFE = re.compile(r"[^\s\x85\xa0\x1c-\x1f](?=[ \n\t\r])")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Counts the tokens of byte strings; compiled from ranked merges as it meets transitions."""

    def __init__(self, merges: list[tuple[bytes, bytes]], max_states: int = 100_000):
        self.max_states = max_states
        self.ids = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int] | None] = [None] * 256
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = self.ids[left], self.ids[right]
            new = self.ids.setdefault(left + right, len(self.halves))
            if new == len(self.halves):
                self.halves.append((a, b))
            self.merged.setdefault((a, b), new)
        # Tokens as a tree: child[node * 256 + byte], and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.inner = {0}
        for data, token in self.ids.items():
            if self._reachable(token):
                node = 0
                for b in data:
                    self.inner.add(node)
                    key = node * 256 + b
                    if key not in self.child:
                        self.child[key] = len(self.token)
                        self.token.append(-1)
                    node = self.child[key]
                self.token[node] = token
        self._clear()

    def _clear(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.step: dict[int, tuple[int, int]] = {}

    def _reachable(self, token: int) -> bool:
        """Whether the merges really make the token from its bytes: its halves are, and meet."""
        if self.halves[token] is None:
            return True
        a, b = self.halves[token]
        return self._reachable(a) and self._reachable(b) and self._meet(a, b, token)

    def stays(self, a: int, b: int) -> bool:
        """Whether the tokens a and b next to each other are the encoding of their bytes."""
        return self._meet(a, b, len(self.halves))

    def _meet(self, a: int, b: int, before: int) -> bool:
        """Whether no merge across the border of a and b comes before the one numbered ``before``.

        Merges are undone from the last to the first; ids follow ranks.  Parts of equal rank
        were merged from the left, so then the right one is undone first, and a merge across
        the border, being further left, would have come before it.
        """
        limit = before
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                return False
            if self.halves[a] is None and self.halves[b] is None:
                return True
            if a > b and self.halves[a] is not None:
                limit = a
                a = self.halves[a][1]
            elif self.halves[b] is not None:
                limit = b + 1
                b = self.halves[b][0]
            else:
                limit = a
                a = self.halves[a][1]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        live, ending = [], None
        for node, last, count in self.states[state]:
            child = self.child.get(node * 256 + byte)
            if child is None:
                continue
            token = self.token[child]
            if ending is None and token >= 0 and (last < 0 or self.stays(last, token)):
                ending = (token, count + 1)
            if child in self.inner:
                live.append((child, last, count))
        token, change = ending
        key = (*[(node, last, count - change) for node, last, count in live], (0, token, 0))
        target = self.number.get(key)
        if target is None:
            target = self.number[key] = len(self.states)
            self.states.append(key)
        self.step[state * 256 + byte] = target, change
        return target, change

    def count(self, data: bytes) -> int:
        """The number of tokens of one match."""
        if len(self.states) > self.max_states:
            self._clear()
        state = total = 0
        get = self.step.get
        for byte in data:
            state, change = get(state * 256 + byte) or self._compile(state, byte)
            total += change
        return total


class TokenCounter:
    """Counts tokens of texts: pattern, transducer, chunk maps, and special strings.

    A special string in a text is one token, and the parts around it are texts of their own.
    The counts of up to ``max_words`` matches are remembered between texts.
    """

    def __init__(
        self,
        merges: list[tuple[bytes, bytes]],
        specials: list[str] = (),
        chunk: int = 1 << 14,
        max_words: int = 200_000,
        max_states: int = 100_000,
    ):
        self.transducer = Transducer(merges, max_states)
        self.pattern, self.chunk, self.max_words = regex.compile(PATTERN), chunk, max_words
        longest_first = sorted(specials, key=lambda s: (-len(s), s))
        self.specials = re.compile("|".join(map(re.escape, longest_first))) if specials else None
        counter = self.transducer

        class Words(dict):
            def __missing__(self, word: str) -> int:
                self[word] = n = counter.count(word.encode())
                return n

        self.words = Words()

    def count(self, text: str | None) -> int:
        text = text or ""
        if self.specials is None:
            return self._count(text)
        parts = self.specials.split(text)
        return sum(map(self._count, parts)) + len(parts) - 1

    def _count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return self._run(text)
        maps = [self.chunk_map(text[i : i + self.chunk]) for i in range(0, len(text), self.chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, body, tail = maps[0]
        return self._run("".join(head)) + body + self._run("".join(tail or ()))

    def _run(self, text: str) -> int:
        if len(self.words) > self.max_words:
            self.words.clear()
        return sum(map(self.words.__getitem__, self.pattern.findall(text)))

    def chunk_map(self, chunk: str) -> tuple:
        """(head, tokens between the first and the last certain border, tail or None)."""
        first = _SAFE.search(chunk)
        if first is None:
            return (chunk,), 0, None
        at = len(chunk) - 1
        while not (chunk[at] in " \n\t\r" and _SAFE.match(chunk, at - 1)):
            at -= 1
        return (chunk[: first.end()],), self._run(chunk[first.end() : at]), (chunk[at:],)

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks together."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self._run("".join(a[2] + b[0])) + b[1], b[2]


@lru_cache(maxsize=2)
def load(path: str) -> TokenCounter:
    """The counter of a tokenizer file in JSON with a byte-level BPE model."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    splitter, model = spec["pre_tokenizer"] or {}, spec["model"]
    if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
        raise ValueError(f"{path} is not a plain byte-level tokenizer")
    byte_of = byte_letters()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = [tuple(bytes(byte_of[c] for c in half) for half in pair) for pair in pairs]
    return TokenCounter(merges, [t["content"] for t in spec["added_tokens"]])


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document ``n_bytes`` (UTF-8), ``n_tokens`` and whether they are more than ``limit``.

    The tokenizer file lies at ``path`` on every executor.  Nothing is shuffled.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def start():
        counter = load(path)

        def step(ids, n_bytes, texts):
            counts = [counter.count(t) for t in texts]
            return ids, n_bytes, counts, [n > limit for n in counts]

        return step

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes")
    schema = f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return map_batches(docs.select(F.col(id_col), size, F.col(text_col)), schema, start)
