import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm.token_counts import TokenCounter, count_tokens, load

PATH = public_tokenizers.path("byte_bpe_50k.json")
POOLS = ["ab", "aab ", "the ing", "abcdefgh", " \n\t'strevmld", "éüßñ ", "日本語テキスト", "1234 56", "!?*$ a", " 　a\xa0", "\x1c\x1d a", "thhaened er on re", "½²١"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return load(PATH)


def n(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library(library, counter):
    rng = random.Random(1)
    chunk = counter.chunk
    for _ in range(3000):
        pool = rng.choice(POOLS) + rng.choice(POOLS)
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 70)))
        if rng.random() < 0.1:
            text = text[:10] + "<|endoftext|>" + text[10:] + "<|endoftext|>"
        want = n(library, text)
        for counter.chunk in (chunk, 5, 1):
            assert counter.count(text) == want, repr(text)
    counter.chunk = chunk


def test_composition_is_associative(library, counter):
    rng = random.Random(2)
    for _ in range(300):
        texts = ["".join(rng.choice("ab  \n'sé1!") for _ in range(rng.randint(1, 12))) for _ in range(3)]
        a, b, c = map(counter.chunk_map, texts)
        left, right = counter.compose(counter.compose(a, b), c), counter.compose(a, counter.compose(b, c))
        total = [counter._run("".join(h)) + m + counter._run("".join(t or ())) for h, m, t in (left, right)]
        assert total[0] == total[1] == n(library, "".join(texts))


def test_small_tables_and_long_matches(library, counter):
    small = TokenCounter.__new__(TokenCounter)
    small.__dict__.update(counter.__dict__, chunk=3, max_words=2)
    counter.transducer.max_states, before = 5, counter.transducer.max_states
    for text in ("the quick brown foxes", "a" * 30_000, "ab " * 9000, " " * 30_000 + "x", "é" * 20_000, "thequickbrown" * 3000):
        assert small.count(text) == counter.count(text) == n(library, text)
    counter.transducer.max_states = before


def test_documents(spark, library):
    text = "One two\n\n  three's 12345 " * 400
    rows = [(1, text, 7), (1, text, None), (2, None, 1), (None, "", 2), (3, "a<|endoftext|> b", None), (4, "é ß", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = count_tokens(df, PATH).collect()
    want = [(i, len((t or "").encode()), n(library, t or ""), n(library, t or "") > 512) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    encoded = dict(zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False)))
    got = count_tokens(docs, PATH).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(e.ids) for i, e in encoded.items()}
