"""The specification queries over all customers, with one invalid section in every third."""

from quire.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_specs_of_all_customers(spark):
    keys = [r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()]
    most = {f"c{k}": 250 if k % 3 == 0 else 100 + k % 50 for k in keys}
    for name in ("with_defaults", "nest_leaves"):
        rows = QUERIES[name][0](spark, SF).collect()
        have = sorted((r.style_id, r.label, r.max_words, r.margin_top, r.columns) for r in rows)
        assert have == sorted((f"c{k}", "Summary", most[f"c{k}"], 0.5 + k % 4, 1) for k in keys)
    leaves = {(r.style_id, r.path): r.value for r in QUERIES["flatten_specs"][0](spark, SF).collect()}
    assert {s for s, _ in leaves} == set(most) and all(leaves[s, "abstract.max_words"] == str(n) for s, n in most.items())
    merged = {(r.style_id, r.path): r.value for r in QUERIES["deep_merge"][0](spark, SF).collect()}
    for k in keys:
        if k % 4 == 1:
            leaves[f"c{k}", "abstract.label"] = f"note {k}"
        if k % 4 in (0, 3):
            leaves[f"c{k}", "custom.note"] = f"note {k}"
    assert merged == leaves
