import duckdb
import pytest

from quire.llm.queries import QUERIES, URL_MODEL, URL_RULES
from quire.llm.url_filter import UNIT, bucket, fit_urls, judge_urls, n_grams, seed_table, split_url, sql

URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://A.NET/", "http://net/x", "http://xnet/y", "x://a.net?q=/",
    "http://example.net/en/1", "http://sub.EXAMPLE.net/en/a#b", "http://example.net/EN/1", "http://badexample.com/de/1",
    "http://example.com/de/", "http://example.com/de", "http://a.example.com/de/x?y", "http://foo.org/fr/", "http://org/fr/x",
    "http://foo.org?x://y.net/", "http://É.example.org/en/é", "http://cheap-pills.example.org/en/1", "http://thhe.example.org/en/12",
    "a://b\nc.net/d\ne?f", "http://h.com/" + "long/" * 30_000,
]


def verdict(url):
    host, path = split_url(url)
    fit = [(len(r), v, r) for v, r in URL_RULES for own, _, rest in [r.partition("/")] if (host == own or host.endswith("." + own)) and path.startswith("/" + rest)]
    if fit:
        return max(fit)[2], max(fit)[1]
    total = URL_MODEL.bias + sum(URL_MODEL.weights[bucket(g, len(URL_MODEL.weights))] for g in n_grams(host, path))
    return None, "block" if total > 0 else "allow"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "x", None) for i, u in enumerate(URLS)] + [(3, URLS[3], "x", "y"), (None, URLS[5], None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string")


def test_urls_equal_brute_force(pages):
    got = judge_urls(pages, URL_RULES, URL_MODEL)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        url = URLS[5 if r.page_id is None else r.page_id]
        assert (r.host, r.path) == split_url(url), url
        assert (r.rule, r.verdict) == verdict(url), url
    assert judge_urls(pages.limit(0), URL_RULES, URL_MODEL).count() == 0


def test_plan_has_no_shuffle_and_no_python(pages):
    plan = judge_urls(pages, URL_RULES, URL_MODEL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_sql_on_odd_urls(pages):
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas())
    want = con.execute(sql(URL_RULES, URL_MODEL)).fetchall()
    got = [tuple(r) for r in judge_urls(pages, URL_RULES, URL_MODEL).collect()]
    same = lambda rows: sorted([(None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:]) for r in rows], key=repr)
    assert same(got) == same(want)


def test_model_learns_the_table_and_more():
    for url, label in seed_table():
        host, path = split_url(url)
        total = URL_MODEL.bias + sum(URL_MODEL.weights[bucket(g, len(URL_MODEL.weights))] for g in n_grams(host, path))
        assert (total > 0) == label, url
    assert verdict("http://spam-casino.example.com/en/1") == (None, "block")
    assert verdict("http://www.ththou.example.com/en/1") == (None, "allow")
    assert fit_urls([]).bias == 0 and abs(URL_MODEL.bias) < 100 * UNIT


def test_whole_table_equals_sql(spark):
    query, text = QUERIES["op4_url_filter"]
    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.1/pages.parquet'")
    want = con.execute(text).fetchall()
    assert sorted(tuple(r) for r in query(spark, "/root/testdata/sf0.1").collect()) == sorted(want)
