import duckdb
import numpy as np
import pytest

from quire.llm.queries import QUERIES
from quire.llm.topk_search import search_blocks, statistics, top_k


def brute(rows, query_ids, k):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q in query_ids:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_bounds_hold_and_get_finer():
    rng = np.random.default_rng(0)
    x, y = rng.integers(-300, 300, (40, 24)).astype(float), rng.integers(-300, 300, (50, 24)).astype(float)
    exact = x @ y.T
    before = None
    for s in (1, 2, 4, 8, 24):
        bound = statistics(x, s) @ statistics(y, s).T
        assert (bound >= exact - 1e-6).all()
        assert before is None or (bound <= before + 1e-6).all()
        before = bound
    assert np.allclose(before, exact)


@pytest.mark.parametrize("block", [(3, 5), (256, 4096)])
def test_vectors(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(20)]  # ties
    rows += [(200, None), (201, [None, 1.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, rows[0][1]), (204, []), (205, [1.0, 2.0]), (206, [0.5, -1.0]), (5, rows[5][1]), (207, [1e6] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    query_ids = {0, 5, 50, 100, 200, 205, 204, 207}
    queries = df.filter(df.vec_id.isin(list(query_ids)))
    got = sorted(tuple(r) for r in top_k(df, queries, 5, *block, shares=3).collect())
    assert got == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], query_ids, 5)
    assert top_k(df.limit(0), queries).count() == 0 and top_k(df, queries.limit(0)).count() == 0


def test_repeated_queries_each_get_their_answers(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(3, [3.0, 1.0])] * 4, df.schema).repartition(4)
    got = sorted(tuple(r) for r in top_k(df, queries, 5).collect())
    once = sorted(tuple(r) for r in top_k(df, queries.limit(1), 5).collect())
    assert len(once) == 5 and got == sorted(once * 4)


def test_one_query_among_few():
    ids, x = np.array([1, 2, 3]), np.array([[1, 2], [3, 4], [3, 4]])
    assert search_blocks((ids[:1], x[:1]), (ids, x), 5) == [(1, 0, 2, 11), (1, 0, 3, 11)]


def test_whole_table_equals_sql(spark):
    query, sql = QUERIES["op9_topk_search"]
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    df = query(spark, "/root/testdata/sf0.01")
    want = con.execute(f"select {', '.join(df.columns)} from ({sql})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
