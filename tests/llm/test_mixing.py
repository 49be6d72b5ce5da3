import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm.mixing import Mix, mix_counts, mix_documents, permute, place, shard_counts, slots, sql
from quire.llm.queries import QUERIES


def targets(sizes, mix):
    """Sharing step by step: cap what is above, share the excess among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    total, free, out = mix.share * sum(sizes.values()), set(names), {}
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        above = {s for s in free if mix.most * sizes[s] < level * weight[s]}
        if not above:
            return out | {s: level * weight[s] for s in free}
        out |= {s: mix.most * sizes[s] for s in above}
        free -= above
    return out


def test_permutation(spark):
    for n in (1, 2, 3, 10, 257, 5000):
        rows = spark.range(n).select(permute(F.col("id"), F.lit(n), F.lit(3), Mix()).alias("y"), "id")
        back = rows.select("y", "id", permute(F.col("y"), F.lit(n), F.lit(3), Mix(), inverse=True).alias("z")).collect()
        assert sorted(r.y for r in back) == list(range(n)) and all(r.z == r.id for r in back)
    assert sum(abs(r.y - r.id) for r in back) / n > n / 5


def corpus(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "a", "b", "ç", None, "tiny"] if i < 380 else ["a"])
        rows.append((i, " \n".join("w%d" % rng.randrange(50) for _ in range(rng.choice([0, 1, 3, 40, 300]))), source, "x", 0))
    rows += [(7, "again and again", "a", "x", None), (7, "again and again", "a", "x", None), (None, "no id", "b", None, None), (None, None, None, None, None), (500, "  lead " * 3000, "ç", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string, n_chars long"), rows


@pytest.mark.parametrize("mix", [Mix(block_words=16, buckets=4, chunk=8), Mix(block_words=1, chunk=64), Mix()])
def test_counts(spark, mix):
    docs, rows = corpus(spark)
    got = mix_counts(docs, mix).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes, mix)
    pairs = {(sizes[s], round(want[s], 6)) for s in sizes}
    assert {(r.source_size, round(r.target, 6)) for r in got} == pairs
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, size(t)) for i, t, *_ in rows)
    for total, target in pairs:
        own = [r for r in got if (r.source_size, round(r.target, 6)) == (total, target)]
        assert abs(sum(r.taken for r in own) - target) <= 0.5
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = mix_counts(docs.repartition(7), mix).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_slots_and_shards(spark):
    docs, rows = corpus(spark)
    mix = Mix(block_words=4, chunk=16, shard_words=500)
    sized = docs.select(F.col("doc_id").alias("id"), "source", F.size(F.split("text", " ")).cast("long").alias("size"), F.lit(0).cast("long").alias("nth"))
    table, _ = place(sized, mix)
    all_slots = slots(table, mix)
    per = {r["rank"]: r for r in table.collect()}
    for rank, words in all_slots.groupBy("rank").agg(F.sum("words")).collect():
        assert words == per[rank]["want"]
    assert all_slots.groupBy("rank", "block").count().agg(F.max("count")).first()[0] <= 2
    draw = shard_counts(all_slots)
    assert draw.agg(F.sum("slots")).first()[0] == all_slots.count() and draw.select("shard").distinct().count() > 3


def test_documents_hold_the_taken_words(spark):
    docs, rows = corpus(spark)
    mix = Mix(block_words=16, buckets=4)
    mixed = mix_documents(docs, mix)
    assert mixed.columns == docs.columns
    out = mixed.collect()
    counted = {}
    for r in mix_counts(docs, mix).collect():
        counted[r.doc_id] = counted.get(r.doc_id, 0) + r.taken
    have = {}
    for r in out:
        have[r.doc_id] = have.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in counted.items() if v} == have
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t or "")
    whole = lambda r: any(set(r.text.split()) <= set(t.split()) for t in texts[r.doc_id])
    assert all(map(whole, out))
    assert any(r.text in texts[r.doc_id] for r in out)


def test_empty_and_wordless(spark):
    docs, _ = corpus(spark)
    assert mix_counts(docs.limit(0)).count() == 0 and mix_documents(docs.limit(0)).count() == 0
    none = docs.filter("text is null or text = ''")
    assert {(r.size, r.taken, r.target) for r in mix_counts(none).collect()} == {(0, 0, 0.0)}
    assert mix_documents(none).count() == 0


def same(got, want):
    norm = lambda rows: sorted([tuple(round(float(x), 6) if x is not None else -1.0 for x in r) for r in rows])
    assert norm(got) == norm(want)


def test_sql(spark):
    docs, _ = corpus(spark)
    con = duckdb.connect()
    con.register("d", docs.select("doc_id", "text", "source").toArrow())
    con.execute("create view documents as select * from d")
    for mix in (Mix(block_words=16, buckets=4), Mix()):
        columns = "doc_id, size, source_size, target, taken"
        same(mix_counts(docs, mix).select(*columns.split(", ")).collect(), con.execute(f"select {columns} from ({sql(mix)})").fetchall())


def test_whole_table_equals_sql(spark):
    query, text = QUERIES["op8_mixing"]
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    df = query(spark, "/root/testdata/sf0.01")
    same(df.collect(), con.execute(f"select {', '.join(df.columns)} from ({text})").fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
