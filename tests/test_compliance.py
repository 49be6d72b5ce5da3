import re

from pyspark.sql import functions as F

from quire.operators import compliance as V
from quire.plans.catalog.citation_queries import citations_and_references, report_and_issues
from quire.plans.compliance_inputs import tables
from quire.sources.styles import builtin_style_specs
from quire.sources.text import from_lines


def inputs(spark):
    rows = [(d, i, t) for d in (1, 2, 3) for i, t in enumerate(["A Title", "Abstract", "We test.", "REFERENCES", "Doe, J. (2000). On it."])]
    lines = from_lines(spark.createDataFrame(rows, "doc_id long, idx int, content string")).persist()
    report = spark.createDataFrame([], "doc_id long, style_id string, total_citations long, total_references long, matched long, consistency_score double")
    return lines, tables(lines), report


def scores(spark, doc_styles):
    lines, t, report = inputs(spark)
    specs = builtin_style_specs(spark)
    return lines, V.check_all(
        lines, t["paragraph_format"], t["runs"], t["sections"], t["doc_defaults"], t["changes"], report, specs, doc_styles
    )


def test_documents_without_a_known_style_are_set_in_apa7(spark):
    schema = "doc_id long, style_id string"
    given = spark.createDataFrame([(1, "apa7"), (2, "no such style")], schema)
    _, got = scores(spark, given)
    rows = {(r.doc_id, r.category): (r.style_id, r.score, r.issues) for r in got.collect()}
    assert len(rows) == 24 and {v[0] for v in rows.values()} == {"apa7"}
    every = spark.createDataFrame([(d, "apa7") for d in (1, 2, 3)], schema)
    _, want = scores(spark, every)
    assert rows == {(r.doc_id, r.category): (r.style_id, r.score, r.issues) for r in want.collect()}


def test_checks_are_one_pass_over_cached_lines(spark):
    lines, got = scores(spark, spark.createDataFrame([(1, "ieee")], "doc_id long, style_id string"))
    assert lines.storageLevel.useMemory  # building the tables keeps the cache
    plan = got._jdf.queryExecution().sparkPlan().toString()
    prepared = got._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
    # By document, and two for each join with styles and reports; there were 181.
    assert len(re.findall(r"\bExchange\b", prepared)) <= 14


def test_alone_and_together_agree(spark):
    styles = spark.createDataFrame([(1, "ieee"), (2, "mla"), (3, "chicago")], "doc_id long, style_id string")
    lines, every = scores(spark, styles)
    _, t, _ = inputs(spark)
    specs = builtin_style_specs(spark)
    alone = V.check_references(lines, t["paragraph_format"], t["changes"], specs, styles).unionByName(
        V.check_page_layout(t["sections"], specs, styles)
    )
    both = every.filter(F.col("category").isin("references", "page_layout"))
    assert sorted(map(repr, alone.collect())) == sorted(map(repr, both.collect()))


def test_steps_after_the_matches_carry_no_plan_of_the_passes(spark):
    found, issues = report_and_issues(spark, "/root/testdata/sf0.001")
    for df in (found, issues):
        plan = df._jdf.queryExecution().logical().toString()
        assert "_section" not in plan and "regexp" not in plan  # columns of detection, patterns of references
    citations, references = citations_and_references(spark, "/root/testdata/sf0.001")
    assert found.groupBy().sum("total_citations", "total_references").collect() == [(citations.count(), references.count())]
