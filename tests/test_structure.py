"""Labels worked out by hand, properties of random documents, and the two forms of the passes."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import merge as M
from quire.operators import structure as S
from quire.ordering import BlockScan, over_documents, reindex
from quire.schemas import ROLES
from quire.sources.text import from_lines

POOL = [
    ("paragraph", "A study of parts moving slowly between distant places", None),
    ("paragraph", "Effects of Delay on Supply", "Title"),
    ("paragraph", "and of their delays", None),
    ("paragraph", "Smith, J., Jones, A. and Chen, L.", None),
    ("paragraph", ", Maria Lopez b", None),
    ("paragraph", "Department of Logistics, Example University", None),
    ("paragraph", "Edited by A Person, received March 2014", None),
    ("paragraph", "contact@example.org", None),
    ("paragraph", "Submitted in Spring 2014", None),
    ("paragraph", "Abstract", None),
    ("paragraph", "We study how parts move between suppliers and what delays them on the way.", None),
    ("paragraph", "Keywords: parts, delay", None),
    ("paragraph", "parts | delay | supply", None),
    ("paragraph", "Introduction", None),
    ("paragraph", "METHODS.", None),
    ("paragraph", "Limitations", None),
    ("paragraph", "Section", "Heading 3"),
    ("paragraph", "Appendix A", None),
    ("paragraph", "References", None),
    ("paragraph", "References", "Heading 9"),
    ("paragraph", "1. Smith J (2001) On parts. J Parts 1(2): 3-4.", None),
    ("paragraph", "2) Jones A (2002) On delay.", None),
    ("paragraph", "3. Chen L (2003) On supply.", None),
    ("paragraph", "Journal of Parts, continued line", None),
    ("paragraph", "Figure 1. Delay by supplier.", None),
    ("paragraph", "Fig. 2 more", None),
    ("paragraph", "Table 3. Parts.", None),
    ("paragraph", "MICROBIOLOGY", None),
    ("paragraph", "12", None),
    ("paragraph", "Author contributions: J.S. wrote", None),
    ("paragraph", "A.B. and C.D. performed research", None),
    ("paragraph", "Downloaded from a place", None),
    ("paragraph", "short line", None),
    ("paragraph", "a longer line of text that does not end with a stop and so runs on into the", None),
    ("paragraph", "This one ends here.", None),
    ("paragraph", "Broken at a hy-", None),
    ("paragraph", "phen and then going on for a while until the line is nearly full of words.", None),
    ("paragraph", "(a) a listed item", None),
    ("paragraph", "x " * 120, None),
    ("paragraph", "", None),
    ("paragraph", "  ", None),
    ("paragraph", "", "Abstract Text"),
    ("table", "", None),
]


def documents(n, seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(n):
        pool = rng.sample(POOL, rng.randint(4, len(POOL)))
        docs.append([rng.choice(pool) for _ in range(rng.randint(0, 60))])
    return docs


def elements(spark, docs):
    rows = [(d, i, k, t, s) for d, doc in enumerate(docs) for i, (k, t, s) in enumerate(doc)]
    df = spark.createDataFrame(rows, "doc_id long, idx int, type string, content string, style_name string")
    base = from_lines(df.select("doc_id", "idx", "content"))
    extra = df.select("doc_id", "idx", F.col("type").alias("_t"), F.col("style_name").alias("_s"))
    out = base.join(extra, ["doc_id", "idx"])
    out = out.withColumns(
        {"type": F.col("_t"), "style_name": F.col("_s"), "role": F.when(F.col("_t") == "table", "table").otherwise("unknown")}
    )
    return out.select(*base.columns).persist()


def labelled_rows(df):
    return {(r.doc_id, r.idx): (r.role, round(r.confidence, 2), r.content) for r in df.collect()}


# A paper without labels, with the role each line should get, worked out by hand.
PAPER = [
    ("title", "Slow Movement of Parts Between Distant Places"),
    ("author_info", "Maria Lopez, Ana Silva, and John Chen"),
    ("author_info", "Department of Logistics, Example University"),
    ("abstract_label", "Abstract"),
    ("abstract_body", "We study how parts move between suppliers and what delays them on the way."),
    ("keywords", "Keywords: parts, delay"),
    ("heading_1", "Introduction"),
    ("body", "Parts move slowly between suppliers, as earlier work has found (1, 2)."),
    ("figure_caption", "Figure 1. Delay by supplier."),
    ("body", "The delay grows with the distance and is larger where borders are crossed."),
    ("table_caption", "Table 1. Parts."),
    ("heading_1", "Discussion"),
    ("body", "A shorter way would help most of the suppliers that we have looked at."),
    ("reference_label", "References"),
    ("reference_entry", "1. Smith J (2001) On parts. J Parts 1(2): 3-4."),
    ("reference_entry", "2. Jones A (2002) On delay. J Parts 2(3): 5-9."),
]


def test_paper_labelled_by_hand(spark):
    df = spark.createDataFrame([(1, i, t) for i, (_, t) in enumerate(PAPER)], "doc_id long, idx int, content string")
    got = {r.idx: r.role for r in S.detect_structure(from_lines(df)).collect()}
    assert [got[i] for i in range(len(PAPER))] == [role for role, _ in PAPER]


def test_every_row_is_labelled_once(spark):
    docs = documents(300, 7)
    df = elements(spark, docs)
    rows = S.detect_structure(df).collect()
    assert sorted((r.doc_id, r.idx) for r in rows) == [(d, i) for d, doc in enumerate(docs) for i in range(len(doc))]
    assert {r.role for r in rows} <= set(ROLES) and all(0 <= r.confidence <= 1 for r in rows)
    tables = [(d, i) for d, doc in enumerate(docs) for i, (kind, _, _) in enumerate(doc) if kind == "table"]
    assert {(r.doc_id, r.idx) for r in rows if r.role == "table"} == set(tables)


def test_long_documents_take_the_block_path(spark):
    docs = documents(25, 11)
    df = elements(spark, docs)
    want = labelled_rows(S.detect_structure(df))
    passes = [
        S._reference_pass,
        S._title_pass,
        S._author_pass,
        S._abstract_pass,
        S._artifact_pass,
        lambda d, s: S._set(S._set(d, S._keyword_rules()), S._caption_rules()),
        S._front_matter_pass,
        S._fill_pass,
    ]
    state = S._pack(S.role_from_keyword(S.role_from_style(S.clean_content(df))))
    for step in passes:
        # Documents above ten rows go block by block, seven rows to a block.
        state = over_documents(state, step, 10, block_rows=7)
    got = labelled_rows(S._unpack(state, df.columns))
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert len(got) == len(want) and not wrong, list(wrong.items())[:3]


def test_default_passes_keep_plans_in_proportion(spark):
    """Chained operators with default arguments neither run jobs nor repeat each other's plans."""
    df = elements(spark, documents(5, 3) + [[POOL[i % len(POOL)] for i in range(3000)]])
    sizes = []
    for _ in range(4):
        df = S.suppress_artifacts(df)
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
    steps = [b - a for a, b in zip(sizes, sizes[1:])]
    assert max(steps) < 3 * max(min(steps), 1)


def test_block_scan_reindexes(spark):
    df = spark.createDataFrame([(d, 3 * i) for d in (1, 2) for i in range(50)], "doc_id long, idx int")
    short = {(r.doc_id, r.idx) for r in reindex(df, None).collect()}
    assert short == {(r.doc_id, r.idx) for r in reindex(df, 20).collect()} == {(d, i) for d in (1, 2) for i in range(50)}
    assert BlockScan().block_rows > 1


def test_merge_groups_hold_neighbouring_rows_of_one_role(spark):
    docs = documents(200, 23)
    labelled = S.detect_structure(elements(spark, docs)).persist()
    role = {(r.doc_id, r.idx): r.role for r in labelled.collect()}
    rows = [r for r in M.merge_groups(labelled).collect() if r.grp is not None]
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.idx)):
        by.setdefault((r.doc_id, r.grp), []).append(r)
    assert by
    for (d, _), group in by.items():
        assert group[0].starts and not any(r.starts for r in group[1:])
        assert len({role[d, r.idx] for r in group}) == 1


def test_cut_lines_are_joined(spark):
    lines = [
        "Introduction",
        "This is the first line of a paragraph that the conversion has cut at the edge of a",
        "page so that it goes on here and still has not come to its end because it is rather",
        "long for one.",
        "A second paragraph starts here and is short.",
    ]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, idx int, content string")
    rows = from_lines(df).withColumn("role", F.when(F.col("idx") == 0, "heading_1").otherwise("body"))
    merged = [r.content for r in M.merge(rows, force=True).orderBy("idx").collect()]
    assert merged == [lines[0], " ".join(lines[1:4]), lines[4]]


def test_join_fragments(spark):
    df = spark.createDataFrame(
        [(["the re-", "port says", "Co-", "Author", " \u200b", "end"],), ([],)], "t array<string>"
    )
    got = [r[0] for r in df.select(M.join_fragments(F.col("t"))).collect()]
    assert got == ["the report says Co- Author end", ""]


@pytest.mark.parametrize("force", [True, False])
def test_merge_keeps_all_words(spark, force):
    docs = documents(60, 5)
    labelled = S.detect_structure(elements(spark, docs)).persist()
    words = lambda df: sum(len((r.content or "").replace("-", "").replace(" ", "")) for r in df.collect())
    assert words(M.merge(labelled, force)) == words(labelled)
