import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from quire.llm import importance
from quire.llm.common import numbered
from quire.llm.queries import QUERIES, op12_importance_resampling

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_features(text, runs):
    words = WORD.findall(lower(text))
    return [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def test_windows_against_a_regular_expression():
    rng = random.Random(1)
    pool = ["Ab", "É", "12", "'", "_", " ", "\n", "\x00", "日本", "\x7f", "\x80", "ß", "😀", "z", "Z.", "İ"]
    for runs, part in ((1, 1 << 18), (3, 7)):
        of = importance.Features(runs, 97, part)
        for _ in range(500):
            text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
            n, buckets = of(text)
            want = plain_features(text, runs)
            assert n == len(WORD.findall(lower(text)))
            assert sorted(buckets.tolist()) == sorted(zlib.crc32(f.encode()) % 97 for f in want), repr(text)
            assert [lower(text)[a:b] for a, b in of.offsets(lower(text))] == WORD.findall(lower(text))


def brute(docs, target, share, runs, buckets, least):
    def counts(texts):
        n = [0] * buckets
        for t in texts:
            for f in plain_features(t, runs):
                n[zlib.crc32(f.encode()) % buckets] += 1
        return n

    s, t = counts(t for _, t in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        found = [gain[zlib.crc32(f.encode()) % buckets] for f in plain_features(text, runs)]
        weight = sum(found) // len(found) if found else 0
        rows.append([doc_id, len(found), weight, weight + importance.noise(doc_id, 2024), None, len(WORD.findall(lower(text)))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def key(row):
    return tuple((x is None, x) for x in row)


def test_query_against_brute_force_and_sql(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = op12_importance_resampling(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    rows = sorted(map(tuple, got.collect()), key=key)
    assert rows == sorted(brute(docs, target, 10, 1, 10_000, 20), key=key)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    assert rows == sorted(con.execute(QUERIES["op12_importance_resampling"][1]).fetchall(), key=key)


def test_edges(spark):
    docs = [(1, "a b C"), (1, "a b C"), (2, None), (None, "a x"), (3, ""), (4, "b " * 5000), (5, "a b c d e")]
    frame = spark.createDataFrame([(*r, 0, 0) for r in docs], "doc_id long, text string, rank int, score int")
    target = spark.createDataFrame([("a b", 1), (None, 2)], "text string, id long")
    for share in (0, 50, 100):
        got = importance.resample(frame, target, share, runs=2, buckets=50, least_words=2)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, ["a b", None], share, 2, 50, 2), key=key)
    got = importance.resample(frame, target.limit(0), 50, least_words=2).collect()
    assert len(got) == 7 and sorted(r.rank for r in got if r.rank) == [1, 2]
    assert importance.drawn(frame, importance.resample(frame, target, 100, least_words=2)).count() == 5
    assert importance.resample(frame.limit(0), target).count() == 0


def test_numbers_of_equal_rows(spark):
    df = spark.range(3000).selectExpr("id % 3 as a", "id as b").repartition(7)
    got = sorted(map(tuple, numbered(df, ["a", "b"], "no").collect()), key=lambda r: r[2])
    assert [(a, b) for a, b, _ in got] == sorted((i % 3, i) for i in range(3000)) and [n for *_, n in got] == list(range(1, 3001))


def test_gains_are_floors():
    g = importance.gains(np.array([3, 0]), np.array([0, 5]))
    assert g.tolist() == [math.floor(1000 * math.log(1 * 5 / (4 * 7))), math.floor(1000 * math.log(6 * 5 / (1 * 7)))]
    assert importance.noise(None, 2024) == importance.noise("", 2024)
    with pytest.raises(ValueError):
        importance.gains(np.array([1]), np.array([1, 2]))
