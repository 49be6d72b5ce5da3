import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import packing
from quire.llm.queries import op11_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_words_by_themselves_equal_whole_texts(library):
    rng = random.Random(1)
    pool = ["a", "The", "É", "é", "́x", "12", "'s", "don't", "!?", " ", "\n", "\t ", "\x1c", "\x85", "\xa0", "　", "<|endoftext|>", "日本", "ΑΣ", "​", "x" * 70, "The", "Éa", ".", ",", "ß", "ÿ", "İ", "aÿ?!", "</w>"]
    encoder = packing.WordEncoder(PATH, max_words=50)
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for text, ids in zip(part, encoder.encode(part)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.encode([None]) == [b""] and all(len(w) <= 64 for w in [*encoder.known, *encoder.stems])


def test_tokenizers_that_keep_white_space_are_refused():
    with pytest.raises(ValueError):
        packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def first_fit_bins(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        i = next((i for i, f in enumerate(free) if f >= n), None)
        if i is None:
            free.append(capacity - n)
        else:
            free[i] -= n
    return len(free)


def test_search_raises_squares_and_never_overfills():
    rng = np.random.default_rng(2)
    for trial in range(60):
        capacity = int(rng.integers(8, 120))
        lengths = rng.integers(1, capacity, rng.integers(1, 120))
        start = packing.best_fit(lengths, capacity)
        search = packing.Search(lengths, start, capacity)
        for source in range(len(search.fill)):
            before = search.squares()
            while search.fill[source] and search.exchange(source):
                assert search.squares() > before
                before = search.squares()
                assert search.fill.max() <= capacity and search.fill.sum() == lengths.sum()
        bins = packing.pack_group(lengths, capacity, 0)
        fill = np.bincount(bins, lengths)
        assert fill.max() <= capacity and np.array_equal(np.bincount(search.bins, lengths, len(search.fill)), search.fill)
        assert -(-lengths.sum() // capacity) <= np.count_nonzero(fill) <= first_fit_bins(lengths.tolist(), capacity)


def test_each_kind_of_exchange():
    def state(bins, capacity=10):
        lengths = np.array([n for b in bins for n in b])
        return packing.Search(lengths, np.repeat(np.arange(len(bins)), [len(b) for b in bins]), capacity)

    move = state([[2], [6], [7]])
    assert move.exchange(0) and move.fill.tolist() == [0, 6, 9]
    one = state([[5], [4, 4]])  # 5 for 4
    assert one.exchange(0) and one.fill.tolist() == [4, 9]
    two = state([[3, 3], [5, 4]])  # 3 and 3 for 5
    assert two.exchange(0) and two.fill.tolist() == [5, 10]
    assert not state([[5], [10]]).exchange(0) and not state([[6], [6]]).exchange(0)


def test_search_saves_bins_over_best_fit():
    rng = np.random.default_rng(7)
    saved = 0
    for _ in range(40):
        lengths = rng.integers(250, 700, 200)
        start = packing.best_fit(lengths, 1000)
        saved += start.max() + 1 - len(np.unique(packing.Search(lengths, start, 1000).run(0)))
    assert saved > 0


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_groups_and_rounds(spark):
    rng = random.Random(3)
    lengths = [rng.choice([rng.randint(1, 100), 100, 3, rng.randint(60, 99)]) for _ in range(6000)]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(lengths)], "length long, extra int")
    rows = packing.pack(df, 100, group_rows=200).collect()
    assert sorted(r.extra for r in rows) == list(range(6000))
    assert check_places(rows, 100) <= 1.02 * first_fit_bins(lengths, 100)
    same = spark.createDataFrame([(60,)] * 1000, "length long")  # nothing can be joined
    assert check_places(packing.pack(same, 100, group_rows=100).collect(), 100) == 1000


def test_documents(spark, library):
    long = "Some words, 12 of them! " * 900
    rows = [(1, long, 5), (1, long, 6), (2, None, 7), (None, "", 8), (3, "  ", None), (4, "a<|endoftext|>b", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    packed = packing.pack(packing.token_pieces(df, PATH))
    got = packed.collect()
    assert check_places(got, 2048) == -(-sum(r.length for r in got) // 2048)
    for doc_id, text in {1: long, 2: "", None: "", 3: "", 4: "a<|endoftext|>b"}.items():
        want = library.encode(text, add_special_tokens=False).ids + [0]
        own = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.piece)
        for r in own:
            ids = want[r.start : r.start + r.length]
            assert r.start == 2048 * r.piece and r.ids == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert sum(r.length for r in own) == len(want) * (2 if doc_id == 1 else 1)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in got:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert packing.pack(packing.token_pieces(df.limit(0), PATH)).count() == 0


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.01"
    got = op11_packing(spark, sf).collect()
    assert got and list(got[0].asDict()) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    pieces = {(r.doc_id, r.piece): r for r in got}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    n = tokens = 0
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        tokens += len(ids)
        for i, at in enumerate(range(0, len(ids), 2048)):
            p, part = pieces[r.doc_id, i], ids[at : at + 2048]
            assert (p.start, p.length, p.ids_crc32) == (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            n += 1
    assert n == len(got)
    assert check_places(got, 2048) <= 1.005 * -(-tokens // 2048)
