import random

from pyspark.sql import functions as F

from quire.functions import citation_text as T
from quire.operators import citations as C
from quire.operators import matching as J
from quire.sources.exports import csl_json
from quire.operators.structure import detect_structure
from quire.operators.styles import every_style
from quire.sources.styles import builtin_style_specs
from quire.sources.text import from_lines


def values(spark, build, inputs):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
    return [r.v for r in df.select("i", build(F.col("s")).alias("v")).orderBy("i").collect()]


def test_expand_citation_numbers(spark):
    got = values(
        spark,
        lambda s: T.expand_citation_numbers("s"),
        ["(1)", "(2, 3)", "(4–6)", "(9-12)", "[7]", "", "(1, 3–5)", "(1 - 5)", "(5-2)"],
    )
    assert got == [[1], [2, 3], [4, 5, 6], [9, 10, 11, 12], [7], [], [1, 3, 4, 5], [1, 5], []]


def test_parse_authors(spark):
    got = values(
        spark,
        T.parse_authors,
        ["Smith, J., & Jones, A. B.", "Nataro JP, Kaper JB, et al.", "A, P., B, M.", "Lee and Kim", "World Health"],
    )
    plain = [[(a.family, a.given) for a in r] for r in got]
    assert plain == [
        [("Smith", "J."), ("Jones", "A. B.")],
        [("Nataro", "JP"), ("Kaper", "JB")],
        [("A", "P., B, M.")],
        [("Lee", None), ("Kim", None)],
        [("World Health", None)],
    ]


def elements(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, idx int, type string, role string, content string")


def test_extract_citations(spark):
    text = "As Smith (2020) and (Doe & Roe, 2019; Lee, 2018a) say (1, 4–6), see (Fig. 1) and Table (2), per Wu et al. (2021)."
    rows = C.extract_citations(elements(spark, [(1, 0, "paragraph", "body", text)])).orderBy("cit_no").collect()
    assert [(r.text, r.author, r.year) for r in rows] == [
        ("(1, 4–6)", None, None),
        ("(Doe & Roe, 2019)", "Doe", "2019"),
        ("(Lee, 2018a)", "Lee", "2018a"),
        ("Smith (2020)", "Smith", "2020"),
        ("Wu et al. (2021)", "Wu et al.", "2021"),
    ]
    assert all(text[r.start : r.end].startswith(r.text[:4]) for r in rows if r.citation_type == "narrative")
    assert text[rows[0].start : rows[0].end] == "(1, 4–6)"


def test_references(spark):
    lines = [
        "Smith, J., & Jones, A. (2020). A title here. Journal of Things, 12(3), 45-67. https://doi.org/10.1234/abc",
        "Doe, R. (2019). Another title",
        "continued. Some Journal 4",
        "3. Nataro JP, Kaper JB (1998) On bacteria. Clin Rev 11(1):142-201.",
    ]
    rows = elements(spark, [(1, i, "paragraph", "reference_entry", s) for i, s in enumerate(lines)])
    refs = {r.ref_idx: r.ref for r in C.references_of(rows).collect()}
    assert sorted(refs) == [0, 1, 3]
    a, b, c = refs[0], refs[1], refs[3]
    assert (a.title, a.container_title, a.volume, a.issue, a.pages, a.doi) == (
        "A title here", "Journal of Things", "12", "3", "45-67", "10.1234/abc",
    )
    assert (b.year, b.title, b.container_title, b.volume) == ("2019", "Another title continued", "Some Journal", "4")
    assert (c.original_number, c.container_title, c.volume, c.issue, c.pages) == (3, "Clin Rev", "11", "1", "142-201")
    csl = {r.ref_idx: r.csl for r in csl_json(C.references_of(rows)).collect()}
    assert csl[1].startswith('{"type":"article-journal","id":"doe-2019"') and "DOI" not in csl[1]


def indel(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        prev = row
        row = [0]
        for j, x in enumerate(b):
            row.append(prev[j] + 1 if x == ch else max(prev[j + 1], row[j]))
    return round(200 * row[-1] / (len(a) + len(b)))


def test_fuzzy_matching_equals_all_pairs(spark):
    rng = random.Random(3)
    base = ["smith", "lindqvist", "chen", "o", "alvarez", "nakamura", "li", "vanderberg", "xu", "papadopoulos"]

    def mutate(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(s))
            if rng.random() < 0.5 and len(s) > 1:
                s.pop(min(i, len(s) - 1))
            else:
                s.insert(i, rng.choice("aeiknst "))
        return "".join(s)

    cited = sorted({(d, mutate(rng.choice(base)), y) for d in (1, 2) for y in ("2000", "2001") for _ in range(60)})
    names = [(d, mutate(rng.choice(base)), y, i) for i, (d, _, y) in enumerate(cited)]
    best = {}
    for d, f, y, i in names:
        best[d, f, y] = min(i, best.get((d, f, y), i))
    names = [(d, f, y, i) for (d, f, y), i in best.items()]
    c = spark.createDataFrame(cited, "doc_id long, author string, year string")
    n = spark.createDataFrame(names, "doc_id long, author string, year string, ref_idx int")
    for mode, similar in (("ratio", lambda a, f: indel(a, f) >= 85), ("substring", lambda a, f: a in f or f in a)):
        want = {}
        for d, a, y in cited:
            hits = [i for dd, f, yy, i in names if dd == d and yy == y and similar(a, f)]
            if hits:
                want[d, a, y] = min(hits)
        got = {(r.doc_id, r.author, r.year): r.ref_idx for r in J.match_author_date_fuzzy(c, n, mode).collect()}
        assert got == want, mode


def test_indel_ratio(spark):
    pairs = [("smith", "smithe"), ("smith et al.", "smith"), ("abc", "xyz"), ("jones", "johnson"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(T.indel_ratio("a", "b")).collect()]
    assert got == [91, 59, 0, indel("jones", "johnson"), 100]


def test_numeric_document_and_report(spark):
    rows = [(1, 0, "paragraph", "body", "Seen before (1, 3). Again (2). Also (9) and Smith (2000).")]
    rows += [(1, 1 + i, "paragraph", "reference_entry", f"{n}. Smith J (2000) T{i}. J Parts 1(2):3-4.") for i, n in enumerate((1, 2, 2))]
    e = elements(spark, rows)
    cits, refs = C.extract_citations(e), C.primary_references(C.references_of(e))
    got = sorted((r.text, r.number or 0, r.ref_idx or 0) for r in J.match_citations(cits, refs).collect())
    assert got == [("(1, 3)", 1, 1), ("(1, 3)", 3, 0), ("(2)", 2, 3), ("(9)", 9, 0), ("Smith (2000)", 0, 1)]
    report = J.citation_report(e.select("doc_id").distinct(), cits, refs, builtin_style_specs(spark), every_style(e, ["apa7", "ieee"]))
    r = report.filter("style_id = 'ieee'").collect()[0]
    assert (r.matched, r.orphan_citations, r.uncited_references, r.consistency_score) == (3, 2, 1, 57.1)


def test_ratio_of_long_names(spark):
    rng = random.Random(8)
    pairs = [("".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 500))) for _ in "ab") for _ in range(12)]
    pairs = [tuple(p) for p in pairs] + [("x" * 500, "x" * 333), ("a" * 32, "b" + "a" * 31), ("ab" * 40, "ba" * 40)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(T.indel_ratio("a", "b")).collect()]
    assert got == [indel(a, b) for a, b in pairs]


def test_et_al_tells_the_modes_apart(spark):
    c = spark.createDataFrame([(1, "smith et al.", "2000"), (1, "mit", "2000")], "doc_id long, author string, year string")
    n = spark.createDataFrame([(1, "smith", "2000", 3), (2, "smith", "2000", 1)], "doc_id long, author string, year string, ref_idx int")
    got = {m: sorted((r.author, r.ref_idx) for r in J.match_author_date_fuzzy(c, n, m).collect()) for m in ("ratio", "substring")}
    assert got == {"ratio": [], "substring": [("mit", 3), ("smith et al.", 3)]}


def test_a_paragraph_of_many_citations(spark):
    filler = "more words about it follow here " * 9
    one = "Figure ({0}) shows, and Smith (2001) agrees with it ({0}) as others do (Doe, 2002; Roe, 2003). " + filler
    text = "".join(one.format(i % 90) for i in range(5000))
    assert len(text) > 1_900_000
    found = C.extract_citations(elements(spark, [(1, 0, "paragraph", "body", text)])).collect()
    assert len(found) == 20_000 and {r.text for r in found if r.citation_type == "narrative"} == {"Smith (2001)"}
    for r in found[::1000]:
        assert text[r.start : r.end].startswith(r.text[:4])


def test_reference_lines_are_gathered_without_a_buffer_per_entry(spark):
    lines = [
        (1, 4, "reference_entry", " 1. Smith J (1999) On "),
        (1, 9, "reference_entry", "parts. J Parts 1(2): 3-4."),
        (1, 7, "body", "not a reference"),
        (1, 8, "reference_entry", "  "),
        (1, 12, "reference_entry", "2. Chen L (2001) On delay."),
        (2, 0, "reference_entry", "a line before any entry"),
        (2, 1, "reference_entry", "Jones, A. (2000). On"),
        (2, 2, "reference_entry", "suppliers and"),
        (2, 3, "reference_entry", "parts."),
    ]
    rows = spark.createDataFrame(lines, "doc_id long, idx int, role string, content string")
    merged = C.merge_reference_lines(rows)
    assert merged.columns == ["doc_id", "ref_idx", "content", "n_lines", "text"]
    assert sorted(map(tuple, merged.collect())) == [
        (1, 4, " 1. Smith J (1999) On ", 2, "1. Smith J (1999) On parts. J Parts 1(2): 3-4."),
        (1, 12, "2. Chen L (2001) On delay.", 1, "2. Chen L (2001) On delay."),
        (2, 0, "a line before any entry", 1, "a line before any entry"),
        (2, 1, "Jones, A. (2000). On", 3, "Jones, A. (2000). On suppliers and parts."),
    ]
    assert "Aggregate" not in merged._jdf.queryExecution().executedPlan().toString()


def test_format_issues_need_only_documents_that_join_names(spark):
    body = {
        1: ["It was seen (Doe and Roe, 2001).", "Doe (2002) agrees.", "Lee & Kim (2003) do not."],
        2: ["Doe (2002) agrees.", "This and that.", "As before (1)."],
        3: ["It was seen (Doe a​nd Roe, 2001; Lee & Kim, 2004).", "x (1, 2) and (3)"],
        4: ["Doe &\tRoe (2001), and so on (Lee, 2003)."],
    }
    rows = [(d, i, t) for d, ts in body.items() for i, t in enumerate(["A Title", "Abstract", "Introduction", *ts])]
    elements = from_lines(spark.createDataFrame(rows, "doc_id long, idx int, content string"))
    kept = C.joining_documents(elements)
    assert {r.doc_id for r in kept.select("doc_id").distinct().collect()} == {1, 3, 4}
    specs = builtin_style_specs(spark)
    styles = every_style(elements, ["apa7", "mla", "ieee"])

    def issues(citations):
        return sorted(map(repr, J.format_issues(citations, specs, styles).collect()))

    want = issues(C.extract_citations(detect_structure(elements)))
    assert len(want) > 1 and any("doc_id=3" in w for w in want)
    assert issues(C.extract_joining(detect_structure(kept))) == want


def _matching_inputs(spark):
    """Citations and references of many kinds: a number twice, no name, names with and without an equal one."""
    rng = random.Random(5)
    names = ["smith", "smithe", "Lee", "lee et al.", "", None, "okafor", "okafors", "chen"]
    cits, refs = [], []
    for d in range(6):
        for i in range(25):
            text, author, year = rng.choice([("(1)", None, None), ("(2, 9)", None, None), ("()", None, None), ("x", rng.choice(names), str(2000 + rng.randint(0, 2)))])
            cits.append((d, i // 2, i % 2, text, "parenthetical", author, year))
        for i in range(12):
            authors = rng.choice([[], [(rng.choice(names), None)]])
            number = rng.choice([None, 1, 2, 3])
            refs.append((d, 100 + i, rng.choice(["2. x", "x"]), (number, authors, rng.choice([None, "2000", "2001"]))))
    refs.append((9, 0, "1. only references", (1, [], None)))
    cits.append((8, 0, 0, "(1)", "parenthetical", None, None))
    c = spark.createDataFrame(cits, "doc_id long, idx int, cit_no int, text string, citation_type string, author string, year string")
    ref = "struct<original_number:int,authors:array<struct<family:string,given:string>>,year:string>"
    return cits, refs, c, spark.createDataFrame(refs, f"doc_id long, ref_idx int, content string, ref {ref}")


def _matches(cits, refs, similar):
    """The matches by the definition: number by number and name by name."""
    out = []
    for d in {c[0] for c in cits}:
        mine = [c for c in cits if c[0] == d]
        listed = [r for r in refs if r[0] == d]
        bare = sum(c[6] is None for c in mine)
        for _, i, k, text, _, author, year in mine:
            if year is None and bare > len(mine) - bare:
                for n in T_NUMBERS[text] or [None]:
                    hits = [i for _, i, s, (o, _, _) in listed if n is not None and (o if o is not None else 2 if s[0] == "2" else None) == n]
                    out.append((d, i, k, text, n, max(hits, default=None), "number" if hits else None))
                continue
            named = [(r[3][1][0][0].lower(), r[1]) for r in listed if r[3][1] and r[3][1][0][0] is not None and r[3][2] == year]
            a = author.lower() if author and year else None
            exact = [i for f, i in named if f == a]
            near = [i for f, i in named if a is not None and similar(a, f)]
            hit = min(exact or near, default=None)
            out.append((d, i, k, text, None, hit, "exact" if exact else "fuzzy" if near else None))
    return sorted(map(repr, out))


T_NUMBERS = {"(1)": [1], "(2, 9)": [2, 9], "()": [], "x": []}


def test_matches_meet_without_joining_every_citation(spark):
    cits, refs, c, r = _matching_inputs(spark)
    ways = {"ratio": lambda a, f: f != "" and indel(a, f) >= 85, "substring": lambda a, f: f != "" and (a in f or f in a)}
    for mode, similar in ways.items():
        got = J.match_citations(c, r, mode)
        assert sorted(repr(tuple(x)) for x in got.collect()) == _matches(cits, refs, similar), mode
    plan = got._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Union")]  # what all citations pass; names without an equal one are joined below
    assert "Join" not in above and "Exchange" not in above
    matches = J.match_citations(c, r)
    used = {(m.doc_id, m.ref_idx) for m in matches.collect() if m.ref_idx is not None}
    every = {(x[0], x[1]) for x in refs}
    assert {(x.doc_id, x.ref_idx) for x in J.cited_references(r, matches).collect()} == used
    assert {(x.doc_id, x.ref_idx) for x in J.uncited_references(r, matches).collect()} == every - used
    plans = J.uncited_references(r, matches)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plans


def test_marks_are_the_citations_and_primary_references(spark):
    lines = [
        ("body", "As Smith (2020) and (Doe & Roe, 2019; Lee, 2018a) say (1, 4–6), see (Fig. 1)."),
        ("body", "No citation (here)."),
        ("abstract_body", "Only (3)."),
        ("title", "Smith (2020)"),
        ("reference_entry", "Smith, J. (2020). On"),
        ("reference_entry", "parts. J Parts, 1(2), 3-4."),
        ("reference_entry", "   "),
        ("reference_entry", "2. x"),
        ("reference_entry", None),
        ("body", None),
    ]
    rows = elements(spark, [(d, i, "paragraph", role, s) for d in (1, 2) for i, (role, s) in enumerate(lines[d - 1 :])])
    marks = C.citation_marks(rows)
    names = ["doc_id", "idx", "cit_no", "text", "citation_type", "author", "year"]
    assert C.citations_in(marks).columns == names
    want = C.extract_citations(rows).select(*names)
    assert want.count() == 6 and sorted(map(repr, C.citations_in(marks).collect())) == sorted(map(repr, want.collect()))
    refs = C.primary_references(C.references_of(rows))
    kept = ["doc_id", "ref_idx", "content", "ref.year", "ref.original_number", F.slice("ref.authors", 1, 1).alias("a")]
    got = C.references_in(marks).select(*kept).collect()
    assert len(got) == 4 and sorted(map(repr, got)) == sorted(map(repr, refs.select(*kept).collect()))
