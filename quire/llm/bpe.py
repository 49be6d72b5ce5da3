"""Byte-level BPE encoding and decoding by a tree reduction over text halves.

The token sequences of two neighbouring texts form a monoid under :meth:`ByteBpe.join`: the
tokens next to the boundary are encoded again together, in a window that grows until its
outermost tokens come out as they were.  A token sequence is the encoding of its bytes exactly
if every adjacent pair of tokens is (the first merge across a border would also happen in the
pair alone), so from then on every pair is settled and nothing outside the window can change.

Each match of the splitting pattern is encoded by itself; the ids of frequent matches are
remembered between texts.

Null texts count as empty; an empty text has no tokens.  Rows repeat as given, null ids stay.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches

OUTPUTS = {
    "n_tokens": "bigint",
    "ids": "array<int>",
    "decoded": "binary",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}

class ByteBpe:
    """An encoder for ranked byte sequences and a splitting pattern.

    ``leaf_bytes`` bounds the parts of one match that are merged at once, ``window`` is the first
    number of tokens taken on each side of a boundary, ``leaf_ids`` bounds the ids that are decoded
    at once.  Up to ``max_matches`` matches of at most ``long_match`` characters are remembered.
    """

    def __init__(
        self,
        ranks: dict[bytes, int],
        pattern: str,
        leaf_bytes: int = 16,
        window: int = 2,
        leaf_ids: int = 2048,
        max_matches: int = 500_000,
        long_match: int = 64,
    ):
        self.ranks, self.leaf_bytes, self.window, self.leaf_ids = ranks, leaf_bytes, window, leaf_ids
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern, self.max_matches, self.long_match = regex.compile(pattern), max_matches, long_match
        self.known: dict[str, bytes] = {}

    def encode_array(self, text: str) -> np.ndarray:
        """Ids of a whole text, as little-endian 32-bit integers."""
        found = self.pattern.findall(text)
        matches, known = set(found), self.known
        if len(known) > self.max_matches:  # what the present text uses stays
            known = self.known = {m: known[m] for m in matches if m in known}
        new = [m for m in matches if m not in known]
        for m in new:
            known[m] = np.array(self.encode_match(m.encode()), "<u4").tobytes()
        ids = np.frombuffer(b"".join(map(known.__getitem__, found)), "<u4")
        for m in new:
            if len(m) > self.long_match:
                del known[m]
        return ids

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def encode_match(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern; a match that is a token stays one."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self._halves(data)

    def _halves(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self._halves(data[:half]), self._halves(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbouring parts of one match together."""
        if not left or not right:
            return left + right
        size = self.window
        while True:
            a, b = left[-size:], right[:size]
            new = self.merge(b"".join(map(self.bytes_of.__getitem__, a + b)))
            settled_left = len(a) == len(left) or new[0] == a[0]
            settled_right = len(b) == len(right) or new[-1] == b[-1]
            if settled_left and settled_right:
                return left[: len(left) - len(a)] + new + right[len(b) :]
            size *= 2

    def merge(self, data: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, the first of equals, until none is left."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        pair = [ranks.get(data[i : i + 2]) for i in range(len(data) - 1)]
        while True:
            best = min((r for r in pair if r is not None), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = pair.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i])
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1])

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, concatenated up the tree."""
        if len(ids) <= self.leaf_ids:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ByteBpe(ranks, pattern)


def encode_documents(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = tuple(OUTPUTS),
) -> DataFrame:
    """Per document the chosen ``outputs``: ids, decoded bytes, their number and digests.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers.  The rank file
    lies at ``path`` on every executor.  Texts stay in their rows: nothing is shuffled.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def start():
        bpe = load(path, pattern)

        def step(doc_ids, texts):
            columns = {name: [] for name in outputs}
            for text in texts:
                ids = bpe.encode_array(text or "")
                decoded = bpe.decode(ids.tolist())
                for name, column in columns.items():
                    if name == "n_tokens":
                        column.append(len(ids))
                    elif name == "ids":
                        column.append(ids)
                    elif name == "decoded":
                        column.append(decoded)
                    elif name == "ids_sha256":
                        column.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    else:
                        column.append(hashlib.sha256(decoded).hexdigest())
            return doc_ids, *columns.values()

        return step

    schema = ", ".join([f"`{id_col}` {id_type}", *[f"{n} {OUTPUTS[n]}" for n in outputs]])
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), schema, start)
