import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quire.llm.bpe import ByteBpe, encode_documents, load
from quire.llm.queries import op2_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def small(bpe):
    """The same ranks with tiny leaves, so that every join is exercised."""
    return ByteBpe(bpe.ranks, public_tokenizers.PATTERN, leaf_bytes=2, window=1, leaf_ids=3, max_matches=100)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={}
    )


POOLS = ["ab", "aab ", "the ing", "abcdefgh", " \n\t'strevmld", "éüßñ ", "日本語テキスト", "1234 56", "!?*$ a", " 　a\xa0", "\x1c\x1d a"]


def test_trees_equal_the_library(bpe, small, library):
    rng = random.Random(1)
    for _ in range(1500):
        pool = rng.choice(POOLS) + rng.choice(POOLS)
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        want = library.encode_ordinary(text)
        assert bpe.encode(text) == want, repr(text)
        assert small.encode(text) == want, repr(text)
        assert small.decode(want) == text.encode()


def test_join_is_associative(small):
    rng = random.Random(2)
    for _ in range(300):
        parts = [small.merge("".join(rng.choice("abethingé") for _ in range(rng.randint(0, 20))).encode()) for _ in range(3)]
        a, b, c = parts
        assert small.join(small.join(a, b), c) == small.join(a, small.join(b, c))


def test_texts_of_one_match(bpe, library):
    for text in ("a" * 20_001, "ab" * 9_000, "é" * 5_000, " " * 9_000, "x" * 3_000 + " " * 5_000 + "y" * 3_000, "the" * 7_000 + " a" * 10):
        assert bpe.encode(text) == library.encode_ordinary(text)


def test_documents(spark, library):
    text = "One two\n\n  three's 12345 " * 400
    rows = [(1, text, "x"), (1, text, None), (2, None, "y"), (None, "", "z"), (3, "<|endoftext|>", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_documents(df, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == 5
    for r in got:
        source = {1: text, 2: "", None: "", 3: "<|endoftext|>"}[r.doc_id]
        want = library.encode_ordinary(source)
        assert r.ids == want and r.n_tokens == len(want) and bytes(r.decoded) == source.encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(source.encode()).hexdigest()
    assert encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_whole_table_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r) for r in op2_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        digests = (hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), (r.text or "").encode()))
        assert got[r.doc_id] == (r.doc_id, len(ids), *digests)


def test_matches_go_through_the_joins(bpe, library, monkeypatch):
    """Without its joins the encoder is wrong, so no other path gives the ids."""
    texts = [" internationalisation", " Donaudampfschifffahrt", "counterrevolutionaries"]
    want = [library.encode_ordinary(t) for t in texts]
    assert [ByteBpe(bpe.ranks, public_tokenizers.PATTERN).encode(t) for t in texts] == want
    monkeypatch.setattr(ByteBpe, "join", lambda self, left, right: left + right)
    assert [ByteBpe(bpe.ranks, public_tokenizers.PATTERN).encode(t) for t in texts] != want
