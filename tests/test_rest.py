import zipfile

import pytest
from compare import connect, difference, duck_rows, spark_rows
from pyspark.sql import functions as F

from quire.functions import predicates, register_functions
from quire.operators import citations, edits, formatting, latex, structure
from quire.operators.styles import every_style
from quire.plans.catalog import QUERIES
from quire.plans.pipeline import analyse
from quire.sources.docx import read_docx_corpus
from quire.sources.exports import write_reports
from quire.sources.styles import builtin_style_specs, read_style_specs
from quire.sources.text import from_lines, read_text_files, read_text_manuscripts
from quire.streaming.incremental import TABLES, incremental_pipeline, result_table

SF = "/root/testdata/sf0.001"
CHECKED = [
    "apa_title_case",
    "strip_html",
    "recover_sections",
    "number_headings",
    "check_headings",
    "chunk_sections",
    "postprocess_latex",
    "sanitize_latex",
    "format_matching_text",
    "export_html",
    "append_table",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    query, sql = QUERIES[name]
    assert difference(spark_rows(query(spark, SF)), duck_rows(connect(SF), sql)) is None


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_text_helpers(spark):
    names = register_functions(spark, "t_")
    assert "word_count" in names
    row = spark.sql(
        "select t_apa_title_case('the art of: the war') a, t_text_case('DNA of the AND cell', 'title_case') b, "
        "t_text_case('DNA IS here', 'sentence_case') c, t_truncate_text('abcdefghij', 8) d, t_emu_to_inches(457200) e, "
        "t_pt_to_emu(12.0D) f, t_strip_heading_number('IV. Results') g, t_word_count('  a  b ') h"
    ).collect()[0]
    assert tuple(row) == ("The Art of: the War", "DNA of the and Cell", "Dna IS here", "abcde...", 0.5, 152400, "Results", 2)


def test_docx(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    styles = (
        '<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/><w:rPr>'
        '<w:rFonts w:ascii="Times"/><w:sz w:val="24"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="H1">'
        '<w:name w:val="heading 1"/><w:rPr><w:sz w:val="28"/></w:rPr></w:style>'
    )
    body = (
        '<w:p><w:pPr><w:pStyle w:val="H1"/><w:jc w:val="both"/><w:ind w:left="720" w:hanging="720"/></w:pPr>'
        '<w:r><w:rPr><w:b/></w:rPr><w:t>Intro</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t> c1 </w:t></w:r></w:p>'
        "</w:tc></w:tr></w:tbl><w:p><w:r><w:drawing/><w:drawing/></w:r></w:p>"
    )
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{ns}">{styles}</w:styles>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    a, b, c = read_docx_corpus(spark, str(tmp_path)).orderBy("idx").collect()
    assert (a.content, a.style_name, a.fmt.font_name, a.fmt.font_size_pt, a.fmt.bold) == ("Intro", "Heading 1", "Times", 14.0, True)
    assert (a.fmt.alignment, a.fmt.first_line_indent_inches, a.fmt.left_indent_inches) == ("justify", -0.5, 0.5)
    assert (b.type, b.role, b.cells[0][0].text, b.table_number, c.figure_number) == ("table", "table", "c1", 1, 2)


def test_text_files_and_styles(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("Title line\n\nBody")
    rows = read_text_files(spark, str(tmp_path / "t")).orderBy("idx").collect()
    assert [r.content for r in rows] == ["Title line", "", "Body"]
    (tmp_path / "s.json").write_text('{"style_id": "own",\n "page_layout": {"columns": 2}}')
    s = read_style_specs(spark, str(tmp_path / "s.json")).collect()[0]
    assert (s.style_id, s.page_layout.columns, s.abstract.label, s.headings.level_3.italic) == ("own", 2, "Abstract", True)


def test_heading_numbers(spark):
    rows = [("heading_1", "Intro"), ("heading_2", "A. First"), ("heading_2", "Second"), ("heading_3", "x"), ("heading_4", "y"),
            ("heading_1", "References"), ("heading_1", "2. Methods"), ("heading_3", "z")]
    df = spark.createDataFrame([(1, i, t) for i, (_, t) in enumerate(rows)], "doc_id long, idx int, content string")
    roles = F.array(*[F.lit(r) for r, _ in rows])
    e = from_lines(df).withColumn("role", F.get(roles, F.col("idx")))
    got = {r.idx: r.prefix for r in formatting.number_headings(e).collect()}
    assert got == {0: "I.", 1: "A.", 2: "B.", 3: "1)", 4: "2)", 6: "II.", 7: "1)"}
    ieee = builtin_style_specs(spark).filter("style_id = 'ieee'")
    text = {r.idx: r.new_text for r in formatting.heading_text(e, ieee, every_style(e, ["ieee"])).collect()}
    assert text[1] == "A. First" and text[6] == "II. METHODS" and text[5] == "REFERENCES"


def test_latex_postprocess(spark):
    body = "\\title{A {b}}x\\title{C {d}}y\n\\section{Abstract}\n hi \n\\section{I}\n\\textit{Index Terms}— a, b"
    df = spark.createDataFrame([(body, "ieee")], "b string, s string")
    got = df.select(latex.postprocess_latex(F.col("b"), F.col("s"))).collect()[0][0]
    assert got == (
        "\\title{A {b}}xy\n\\begin{abstract}\nhi\n\\end{abstract}\\section{I}\n"
        "\\begin{IEEEkeywords}\na, b\n\\end{IEEEkeywords}"
    )


def test_pipeline_and_reports(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    specs = builtin_style_specs(spark).filter("style_id in ('apa7', 'ieee')")
    out = analyse(read_text_manuscripts(docs, by_document=True), specs, every_style(docs, ["apa7", "ieee"]))
    assert out.summary.count() == docs.count()
    write_reports(out.report, str(tmp_path / "r"), mode="overwrite")
    assert spark.read.parquet(str(tmp_path / "r")).groupBy("style_id").count().count() == 2
    assert out.changes.filter("category = 'title_page'").count() > 0


def test_incremental(spark, tmp_path):
    """Arrivals in two batches, repeated arrivals, a restart and a batch that is played again."""
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    names = ("elements", "summary", "citations")

    def arrive():
        stream = spark.readStream.schema(docs.schema).parquet(source)
        incremental_pipeline(stream, out, cp, tables=names).awaitTermination()
        return {n: sorted(map(repr, result_table(spark, out, n).collect())) for n in names}

    for part in (docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 3 = 0")):
        part.union(part).coalesce(1).write.mode("append").parquet(source)
        got = arrive()
    wanted = docs.filter("doc_id % 2 = 0 or doc_id % 3 = 0")
    assert result_table(spark, out, "elements").count() == read_text_manuscripts(wanted).count()
    assert len(got["summary"]) == result_table(spark, out, "summary").select("doc_id").distinct().count() * len(got["summary"]) // wanted.count()
    assert arrive() == got  # nothing new has arrived
    (tmp_path / "cp" / "commits" / "1").unlink()
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert arrive() == got and set(names) < set(TABLES)


def test_repeated_edits_and_ties(spark):
    e = from_lines(spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, idx int, content string"))
    twice = spark.createDataFrame([(1, 0, "x", 1), (1, 0, "w", 2)], "doc_id long, idx int, new_text string, seq int")
    assert [r.content for r in edits.edit_text(e, twice).orderBy("idx").collect()] == ["w", "b"]
    styles = spark.createDataFrame([(1, 1, "Title"), (1, 1, "Quote")], "doc_id long, idx int, style string")
    assert [r.style_name for r in edits.set_style(e, styles).orderBy("idx").collect()][1] == "Title"
    added = spark.createDataFrame([(1, 0, t, None) for t in "dce"], "doc_id long, idx int, text string, style string")
    for _ in range(2):
        got = [r.content for r in edits.insert_after(e, added.repartition(3)).orderBy("idx").collect()]
        assert got == ["a", "c", "d", "e", "b"]
    wanted = spark.createDataFrame([(1, 0, "title", 0.6), (1, 0, "heading_1", 0.9), (1, 0, "nonsense", 1.0)], "doc_id long, idx int, role string, confidence double")
    fixed = structure.apply_corrections(e, wanted).orderBy("idx").collect()
    assert [r.role for r in fixed][0] == "heading_1" and len(fixed) == 2


def test_patterns_know_all_letters(spark):
    df = spark.createDataFrame([("Müller et al. PNAS",), ("Müller writes",)], "content string")
    assert [r[0] for r in df.select(predicates.is_page_artifact("content")).collect()] == [True, False]
    text = "3. García ML (2010) On parts. Revista Española Médica 12(3): 45-67."
    ref = citations.parse_references(spark.createDataFrame([(text,)], "text string")).collect()[0].ref
    assert (ref.container_title, ref.volume, ref.issue, ref.pages) == ("Revista Española Médica", "12", "3", "45-67")


def test_links_in_order_and_unreadable_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = "<w:r><w:t xml:space='preserve'>{}</w:t></w:r>"
    body = "<w:p>" + run.format("See ") + "<w:hyperlink>" + run.format("the link") + "</w:hyperlink>" + run.format(" for more.") + "</w:p>"
    with zipfile.ZipFile(tmp_path / "good.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}/>")
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    rows = {r.type: r.content for r in read_docx_corpus(spark, str(tmp_path)).collect()}
    assert rows["paragraph"] == "See the link for more." and rows["error"].startswith("BadZipFile")
