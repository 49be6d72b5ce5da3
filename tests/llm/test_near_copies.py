import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import near_copies
from quire.llm.near_copies import Blocks, candidates, drop_near_copies, plan_blocks, shingle_set


def brute_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_pairs(texts, similarity=0.8):
    """Pairs of ids of different sets with that similarity, and each id's smallest one reachable."""
    first, joined = {}, {}
    for i in sorted(texts):
        joined[i] = first.setdefault(brute_set(texts[i]), i)
    having, common = defaultdict(list), Counter()
    for shingles, i in first.items():
        for s in shingles:
            common.update((j, i) for j in having[s])
            having[s].append(i)
    size = {i: len(s) for s, i in first.items()}
    pairs = [(i, j) for (i, j), n in common.items() if n >= similarity * (size[i] + size[j] - n)]

    def root(i):
        while joined[i] != i:
            i = joined[i]
        return i

    for i, j in pairs:
        i, j = sorted((root(i), root(j)))
        joined[j] = i
    return pairs, {i: root(i) for i in joined}


def corpus(rng, copies=60):
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(2000)]
    texts = []
    for _ in range(copies):
        base = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 3)):
            own = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 60))):  # at about the bound and above it
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
        half = base[: len(base) // 2] + [rng.choice(words) for _ in range(len(base) // 2)]
        texts.append(" ".join(half))  # shares a long passage only
    return words, texts


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    words, texts = corpus(rng)
    big = [rng.choice(words) for _ in range(200)]
    for _ in range(300):  # one large group, above what a block pairs
        own = list(big)
        own[rng.randrange(200)] = rng.choice(words)
        texts.append(" ".join(own))
    texts += [texts[0].upper(), "", None, " \n", "Short text", "short TEXT", "x " * 50_000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "c") for i, t in zip(ids, texts)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, _id string")
    pairs, joined = near_pairs({i: t for i, t, _ in rows})
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got))
    assert {i for i, r in joined.items() if r == i} <= set(got)  # the smallest of each group stays
    missed = {i for i in got if joined[i] != i}
    assert len(pairs) > 100 and len(missed) <= 0.05 * (len(joined) - len(set(joined.values())))


def test_null_ids_repeated_ids_and_an_empty_table(spark):
    base = " ".join(f"word{i}" for i in range(100))
    rows = [(None, base), (7, base), (7, base), (7, "quite another text of six words"), (None, "only here"), (None, "only here"), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, drop_near_copies(docs).collect()), key=repr)
    assert got == sorted([(7, base), (7, rows[3][1]), (None, "only here"), (8, "")], key=repr)
    assert drop_near_copies(docs.limit(0)).count() == 0
    named = docs.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body"))
    assert drop_near_copies(named, id_col="name", text_col="body").count() == 4


def test_blocks_catch_pairs_at_the_bound():
    rng = random.Random(2)
    blocks = plan_blocks(100_000)
    met = close = 0
    for _ in range(150):
        same = [rng.getrandbits(64) for _ in range(320)]
        sides = [near_copies.np.array(same + [rng.getrandbits(64) for _ in range(40)], dtype="u8") for _ in range(2)]
        a, b = (near_copies.long_fingerprint(s, 64 + blocks.count * blocks.width) for s in sides)
        met += (a[64:] == b[64:]).reshape(blocks.count, blocks.width).all(1).any()
        close += (a[:64] != b[:64]).sum() <= blocks.near
    assert met >= 0.9 * 150 and close >= 0.98 * 150
    assert plan_blocks(1 << 24).width == 23 and plan_blocks(0).width == 8


@pytest.mark.parametrize("paired", [1, 4, 64])
def test_candidates_of_shared_blocks(spark, paired):
    rng = random.Random(paired)
    rows = [(i, rng.getrandbits(3), [rng.randrange(6), 10 + rng.randrange(6)]) for i in range(60)]
    got = [tuple(r) for r in candidates(spark.createDataFrame(rows, "node long, sketch long, parts array<long>"), 2, paired).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and set(a[2]) & set(b[2]) and (a[1] ^ b[1]).bit_count() <= 2}
    assert set(got) <= want and len(got) == len(set(got))
    if paired == 64:
        assert set(got) == want
    else:
        assert 0 < len(got) < len(want)


@pytest.mark.parametrize("chunk", [4, 256])
def test_large_blocks_give_every_pair_of_other_components(spark, chunk):
    rng = random.Random(chunk)
    rows = [(i, rng.getrandbits(7), [rng.randrange(3), 10 + rng.randrange(40)]) for i in range(150)]
    root = {i: i // 40 * 40 for i in range(110)}  # the others have no link yet
    nodes = spark.createDataFrame(rows, "node long, sketch long, parts array<long>")
    found = spark.createDataFrame(list(root.items()), "node long, root long")
    got = [tuple(r) for r in near_copies.unpaired(nodes, found, Blocks(1, 8, 2), 0.8, 32, chunk).collect()]
    want = {
        (a[0], b[0])
        for a in rows
        for b in rows
        if a[0] < b[0] and a[2][0] == b[2][0] and (a[1] ^ b[1]).bit_count() <= 2 and root.get(a[0], a[0]) != root.get(b[0], b[0])
    }
    assert len(want) > 100 and set(got) == want and len(got) == len(want)


def test_no_pair_of_a_large_block_is_lost(spark, monkeypatch):
    """One block of one bit: only the smallest nodes of a value met the others before."""
    rng = random.Random(8)
    _, texts = corpus(rng)
    blocks = Blocks(1, 1, 20)
    monkeypatch.setattr(near_copies, "plan_blocks", lambda *_: blocks)
    prints = [near_copies.long_fingerprint(shingle_set(t), 65) for t in texts]
    sets = [brute_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            alike = len(a & b) >= 0.8 * len(a | b)
            if a == b or (alike and prints[i][64] == prints[j][64] and (prints[i][:64] != prints[j][:64]).sum() <= blocks.near):
                i, k = sorted((find(i), find(j)))
                root[k] = i
    got = drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {i for i in range(len(texts)) if find(i) == i}
    assert len(want) < len(texts) - 50 and {r.doc_id for r in got} == want


def test_sets_equal_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice(["A", "b", " ", "\n", "é", "\x1c", "\xa0", "cd "]) for _ in range(rng.randint(0, 80)))
        want = sorted(near_copies.xxhash.xxh64_intdigest(s.encode(), 42) for s in brute_set(t))
        assert shingle_set(t).tolist() == want
    assert isinstance(plan_blocks(10), Blocks)


def test_a_group_of_close_texts_is_verified_in_rows_of_its_size(spark, monkeypatch):
    """Copies are similar to one text alone, but the fingerprints of nearly all their pairs are close."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)]
    for k in range(300):
        own = list(base)
        own[5 + k % 50] = f"new{k}"
        texts.append(" ".join(own))
    rng.shuffle(texts)
    monkeypatch.setattr(near_copies, "plan_blocks", lambda *_: Blocks(8, 4, 20))
    counts, verified, linked = [], near_copies.verified, getattr(near_copies, "linked", None)

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return verified(pairs, *rest)

    def counted_links(members, *rest):
        links = linked(members, *rest)
        meetings = members.select("xno", "yno").distinct().count()
        assert members.count() <= 2 * near_copies.CHUNK * meetings
        assert links.count() <= members.count()
        return links

    monkeypatch.setattr(near_copies, "verified", counted)
    monkeypatch.setattr(near_copies, "linked", counted_links, raising=False)
    got = drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    _, joined = near_pairs(dict(enumerate(texts)))
    assert sum(counts) <= 2 * len(texts)
    assert {r.doc_id for r in got} == {i for i, r in joined.items() if r == i} == {0}


def test_links_join_what_all_similar_pairs_join():
    rng = random.Random(4)
    for _ in range(30):
        sets = [near_copies.np.array(sorted(rng.sample(range(30), rng.randint(0, 6)))) for _ in range(40)]
        root = near_copies.np.array([rng.randrange(25) for _ in sets])
        up = list(range(25))

        def top(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        links = near_copies.links_of([s.astype("i8") for s in sets], root, 0.5)
        for i, j in links:
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert len(a & b) >= 0.5 * len(a | b) and top(root[i]) != top(root[j])
            up[top(root[i])] = top(root[j])
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                a_, b_ = set(a.tolist()), set(b.tolist())
                if len(a_ & b_) >= 0.5 * len(a_ | b_):
                    assert top(root[i]) == top(root[j])
