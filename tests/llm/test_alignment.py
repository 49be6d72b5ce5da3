import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quire.llm import alignment
from quire.llm.queries import op13_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
LETTERS = alignment.byte_letters()


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_bytes(a, b, ids_a, ids_b):
    one = b"".join(bytes(LETTERS[c] for c in a.id_to_token(i)) for i in ids_a)
    pieces = [b.id_to_piece(i) for i in ids_b]
    return one, b"".join(bytes([int(p[3:5], 16)]) if p[:3] == "<0x" else p.replace("▁", " ").encode() for p in pieces)


def brute(libraries, text):
    """Ids and groups by one pass over the byte ends."""
    a, b = libraries
    if not text:
        return [], [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    data = (" " + text).encode()
    if plain_bytes(a, b, ids_a, ids_b) != (data, data):
        return [], [], []
    end_a = np.cumsum([len(plain_bytes(a, b, [i], [])[0]) for i in ids_a]).tolist()
    end_b = np.cumsum([len(plain_bytes(a, b, [], [i])[1]) for i in ids_b]).tolist()
    groups, p, q = [], 0, 0
    for e in sorted(set(end_a) & set(end_b)):
        r, s = end_a.index(e, p) + 1, end_b.index(e, q) + 1
        groups.append((ids_a[p:r], ids_b[q:s]))
        p, q = r, s
    return ids_a, ids_b, groups


POOL = [
    "the", "The ", " of", "ß", "日本", "\n", "\n\n ", "\t", " ", "  ", "'s", "12", "é", "é", "▁", " ", "\xa0", "\x85", "\x1c", "😀",
    "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "​", "ing", "...", "x" * 40, "　",
]


def test_words_by_themselves_equal_the_libraries(libraries):
    rng = random.Random(1)
    pair = alignment.Pair(A, B, max_units=50)
    texts = [None, "", " ", "  ", "a ", "a  ", "\n"] + ["".join(rng.choice(POOL) for _ in range(rng.randint(1, 25))) for _ in range(2000)]
    none = 0
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        found = alignment.Aligned(pair, part)
        for i, text in enumerate(part):
            ids_a, ids_b, groups = brute(libraries, text)
            none += bool(text) and not ids_a
            assert found.ids_a[found.edges_a[i] : found.edges_a[i + 1]].tolist() == ids_a, repr(text)
            assert found.ids_b[found.edges_b[i] : found.edges_b[i + 1]].tolist() == ids_b, repr(text)
            assert found.groups(i) == groups, repr(text)
    assert none > 10 and all(len(u) <= 64 for u in [*pair.known_a, *pair.known_b, *pair.odd])


def test_divide_equals_the_intersection():
    rng = np.random.default_rng(2)
    for trial in range(300):
        n = int(rng.integers(1, 3000))
        share = rng.choice([0.01, 0.2, 0.6])
        a = np.unique(np.append(rng.integers(1, n + 1, int(n * share) + 1), n))
        b = np.unique(np.append(rng.integers(1, n + 1, int(n * rng.choice([0.01, 0.3])) + 1), n))
        if trial % 5 == 0:  # a long stretch without a common end beside many of them
            a, b = np.unique(np.append(np.arange(1, n, 2), n)), np.unique(np.append(np.where(np.arange(1, n) < 0.7 * n, np.arange(1, n) // 2 * 2, np.arange(1, n)), n))
            b = b[b > 0]
        last_a, last_b = alignment.divide(a, b, np.array([0, len(a)]), np.array([0, len(b)]), tries=int(rng.integers(0, 7)))
        want = np.intersect1d(a, b)
        assert np.array_equal(a[last_a], want) and np.array_equal(b[last_b], want)


def expected(libraries, rows):
    found = [(i, *brute(libraries, t)) for i, t in rows]
    counts = Counter((x[-1], y[-1]) for *_, groups in found for x, y in groups)
    most = Counter()
    for (_, y), c in counts.items():
        most[y] = max(most[y], c)
    out = []
    for i, ids_a, ids_b, groups in found:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[p] == most[p[1]] for p in links)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, len(ids_a), len(ids_b), len(groups), len(links), best, sum(map(counts.get, links)), digest))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def test_query_against_brute_force(spark, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(libraries, rows), key=key)


@pytest.mark.parametrize("head", [0, 5, 10_000])
def test_edges_with_pairs_beyond_the_head(spark, libraries, head):
    rows = [(1, "One two, three."), (1, "One two, three."), (2, None), (None, "one ▁ two"), (None, "One\nTwo"), (3, ""), (4, "été " * 4000), (5, "x" * 9000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n_a int, links string")
    got = alignment.count_links(df, A, B, head=head).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(libraries, rows), key=key)
    assert alignment.count_links(df.limit(0), A, B, head=head).count() == 0


def test_groups_as_rows(spark, libraries):
    df = spark.createDataFrame([(1, "Donaudampfschiff fährt"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align(df, A, B).collect()}
    assert [(g.a, g.b) for g in got[1].groups] == brute(libraries, "Donaudampfschiff fährt")[2] and got[2].groups == []
