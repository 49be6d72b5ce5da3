import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm.simhash import block_masks, components, drop_near_duplicates, fingerprint, links, near_duplicates


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, edges):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(i) for i in range(n)]


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(1)
    texts = ["", None, "One", "one TWO", "É é İ", " \n", "a b c", "a b c a b c a b c"]
    texts += ["".join(rng.choice(["A", "b", " ", "\n", "é", "\x1c", "\xa0", "cd "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert fingerprint(t) % 2**64 == brute(t), repr(t)
    native = spark.sql("select xxhash64('one two three') h").first().h
    assert native % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def near(rng, n, centre_bits=10):
    """Fingerprints in a few crowded balls and some at random."""
    out = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        flips = rng.sample(range(64), centre_bits)
        while len(out) % n != n - 1:
            x = centre
            for b in rng.sample(flips, rng.randint(0, 6)):
                x ^= 1 << b
            out.add(x)
            if rng.random() < 0.01:
                break
    out |= {rng.getrandbits(64) for _ in range(50)}
    return sorted(x - 2**64 if x >> 63 else x for x in out)


@pytest.mark.parametrize("paired,blocks", [(64, 4), (2, 4), (3, 6)])
def test_links_connect_exactly_the_close(spark, paired, blocks):
    fps = near(random.Random(paired), 200)
    at = {x: i for i, x in enumerate(fps)}
    want = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) % 2**64).bit_count() <= 2]
    got = links(spark.createDataFrame([(x,) for x in fps], "fp long"), 2, blocks, paired).collect()
    pairs = [(at[r.a], at[r.b]) for r in got]
    assert all(((fps[i] ^ fps[j]) % 2**64).bit_count() <= 2 for i, j in pairs)
    assert roots(len(fps), pairs) == roots(len(fps), want)
    assert len(block_masks(blocks, 2)) == blocks * (blocks - 1) // 2


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300 + rng.randrange(50), 300 + rng.randrange(50)) for _ in range(30)]
    want = roots(400, edges)
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {n: want[n] for n in {x for a, b in edges if a != b for x in (a, b)}}
    assert len(rows) == len({r.node for r in rows})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(40):  # near copies, some of copies
        own = rng.choice(texts).split()
        own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 10 + ["", None, "short", " ".join(rng.choice(words) for _ in range(400)), "x " * 60_000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "clash") for i, t in zip(ids, texts)] + [(None, " ".join(base), "c"), (None, "alone with no id", None), (None, "alone with no id", None), (ids[0], texts[0], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    prints = [brute(t) for _, t, _ in rows]
    up = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {}
    for (i, _, _), r in zip(rows, up):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    got = near_duplicates(docs).collect()
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=repr) == sorted([(i, f"{p:016x}", least[r]) for (i, _, _), p, r in zip(rows, prints, up)], key=repr)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(v for v in least.values() if v is not None)
    assert kept.filter(F.col("doc_id").isNull()).count() == 1
    assert near_duplicates(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0
