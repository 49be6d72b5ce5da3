"""Sections, chunks and LaTeX text (O-L), exports (O-S7, O-S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import latex as L
from quire.plans.catalog.inputs import (
    DOC_LINES,
    MANUSCRIPT_LINES,
    doc_elements,
    doc_lines,
    manuscript_lines,
    table,
)
from quire.sources.exports import export_html, export_text

_HEAD = L.SECTION_START
_SECTIONS = f"""with {MANUSCRIPT_LINES}, q0 as (select *, regexp_matches(trim(content), '{_HEAD}') as header from lines),
 q1 as (select *, last_value(case when not header then idx end ignore nulls) over (partition by doc_id order by idx) as plain from q0),
 q2 as (select *, header and (idx - coalesce(plain, -2) - 1) % 2 = 0 as opens from q1),
 q3 as (select *, sum(case when opens then 1 else 0 end) over (partition by doc_id order by idx) as section_no from q2),
 sections as (select * from (select doc_id, section_no, coalesce(max(case when opens then trim(content) end), 'Preamble') as title,
   trim(string_agg(case when not opens then content end, chr(10) order by idx)) as content from q3 group by all) where content <> '')"""

# Lines become paragraphs, so that long sections have blank lines to be cut at.
_PARAGRAPHS = "replace(content, chr(10), concat(chr(10), chr(10)))"


def _sections(spark, sf):
    return L.split_sections(manuscript_lines(spark, sf))


def _spaced(df):
    return df.withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))


def _chunks(spark, sf):
    return L.chunk_sections(_spaced(_sections(spark, sf)), 150)


def _latex(spark, sf):
    body = L.escape_fallback(F.col("title"), F.col("content"))
    style = F.when(F.col("doc_id") % 3 == 0, "ieee").when(F.col("doc_id") % 3 == 1, "apa7").otherwise("other")
    return L.assemble_latex(_chunks(spark, sf).withColumn("latex", body).withColumn("style", style))


def _marked(df):
    """LaTeX with planted repairs to make."""
    return df.withColumn(
        "latex",
        F.concat(
            F.lit("```latex\n\\documentclass[a]{b}\n\\usepackage{c}\n\\begin{document}\\maketitle "),
            F.col("text"),
            F.lit(" \\printbibliography\\end{document}\n```"),
        ),
    )


def _repaired(spark, sf):
    df = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.lit("\\title{A {x}}"), F.lit("\\title{B {y} z}"), F.lit("\\begin{abstract} \\end{abstract}\n\\section{Abstract}\n  "),
            F.replace("text", F.lit("*"), F.lit("")), F.lit("\n\\section{Body}\n**bold** and *slanted*\n\n\n\n\nend\\maketitle x\\maketitle y\\bibliography{z}"),
        ).alias("body"),
    )
    return df.select("doc_id", L.postprocess_latex(F.col("body"), F.lit("apa7")).alias("latex"))


def _plain_text(c: str) -> str:
    return f"concat('\\title{{A {{x}}}}', chr(10), '\\begin{{abstract}}', chr(10), trim({c}, concat(' ', chr(10))), chr(10), '\\end{{abstract}}', '\\section{{Body}}', chr(10), '\\textbf{{bold}} and \\textit{{slanted}}', chr(10), chr(10), chr(10), 'end\\maketitle x y')"


_NO_STARS = "replace(text, '*', '')"
_PACK_LIMIT = 400


def _guideline(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return L.chunk_guideline(docs, limit=_PACK_LIMIT)


def _sanitised(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.lit("\\documentclass{IEEEtran}\n\\usepackage{times}\n\\usepackage{cite}\n\\usepackage{cite}\n\\documentclass{b}\n"
                  "\\usepackage{natbib}\n\\begin{document}\n\\usepackage{extra}\n"),
            F.col("text"),
            F.lit("\n\\end{document}"),
        ).alias("latex"),
    )
    return L.sanitize_latex(docs)


# Greedy packing, one paragraph at a time.
_CHUNKS_SQL = f"""{_SECTIONS.replace('with ', 'with recursive ', 1)}, sec as (select doc_id, section_no, title, {_PARAGRAPHS} as content from sections),
 par as (select doc_id, section_no, title, length(content) as total, list_filter(string_split(content, concat(chr(10), chr(10))), lambda x: true) as ps from sec),
 walk as (select doc_id, section_no, title, total, ps, 1 as i, 1 as part, length(ps[1]) as size from par
   union all select doc_id, section_no, title, total, ps, i + 1, case when total > 150 and size + length(ps[i + 1]) + 2 > 150 then part + 1 else part end,
   case when total > 150 and size + length(ps[i + 1]) + 2 > 150 then length(ps[i + 1]) else size + 2 + length(ps[i + 1]) end from walk where i < len(ps)),
 packed as (select doc_id, section_no, title, part, string_agg(ps[i], concat(chr(10), chr(10)) order by i) as content from walk group by all),
 chunks as (select doc_id, section_no, part, case when max(part) over (partition by doc_id, section_no) > 1 then concat(title, ' (Part ', part, ')') else title end as title,
  trim(content) as content from packed)"""


def _preamble(style: str) -> str:
    return "'" + "\n".join(L.PREAMBLES[style]) + "\n" + "'"


# The one repair these texts need: a section Abstract becomes the environment, next to what follows.
_LATEX_SQL = f"""{_CHUNKS_SQL}, pieces as (
  select doc_id, section_no, part, title, replace(replace(replace(replace(content, '&', '\\&'), '%', '\\%'), '#', '\\#'), '_', '\\_') as text from chunks),
 bodies as (select doc_id, rtrim(string_agg(case when title = 'Abstract'
    then concat('\\begin{{abstract}}', chr(10), text, chr(10), '\\end{{abstract}}')
    else concat('\\section{{', title, '}}', chr(10), chr(10), text, chr(10), chr(10)) end, '' order by section_no, part), chr(10)) as body
  from pieces group by doc_id),
 latex as (select doc_id, case doc_id % 3 when 0 then 'ieee' when 1 then 'apa7' else 'other' end as style,
   concat(case doc_id % 3 when 0 then {_preamble('ieee')} when 1 then {_preamble('apa7')} else {_preamble('default')} end,
   chr(10), '\\begin{{document}}', chr(10), chr(10), body, chr(10), chr(10), '\\end{{document}}', chr(10)) as latex from bodies)"""


QUERIES = {
    "split_sections": (_sections, f"{_SECTIONS} select doc_id, section_no, title, content from sections"),
    "split_sections_documents": (
        lambda spark, sf: L.split_sections(doc_lines(spark, sf)),
        _SECTIONS.replace(MANUSCRIPT_LINES, DOC_LINES) + " select doc_id, section_no, title, content from sections",
    ),
    "chunk_sections": (_chunks, f"{_CHUNKS_SQL} select * from chunks"),
    "chunk_guideline": (
        _guideline,
        f"""with recursive par as (select doc_id, length(replace(text, chr(10), concat(chr(10), chr(10)))) as total, string_split(text, chr(10)) as ps from documents),
 walk as (select doc_id, total, ps, 1 as i, 1 as part, length(ps[1]) as size from par
   union all select doc_id, total, ps, i + 1, case when total > {_PACK_LIMIT} and size + length(ps[i + 1]) + 2 > {_PACK_LIMIT} then part + 1 else part end,
   case when total > {_PACK_LIMIT} and size + length(ps[i + 1]) + 2 > {_PACK_LIMIT} then length(ps[i + 1]) else size + 2 + length(ps[i + 1]) end from walk where i < len(ps))
 select doc_id, cast(part - 1 as int) as chunk_no, trim(string_agg(ps[i], concat(chr(10), chr(10)) order by i)) as chunk from walk group by doc_id, part""",
    ),
    "clean_latex_chunk": (
        lambda spark, sf: _marked(table(spark, sf, "documents").select("doc_id", "text")).select(
            "doc_id", L.clean_latex_chunk(F.col("latex")).alias("latex")
        ),
        "select doc_id, trim(text, concat(' ', chr(10))) as latex from documents",
    ),
    "postprocess_latex": (
        _repaired,
        f"select doc_id, {_plain_text(_NO_STARS)} as latex from documents",
    ),
    "escape_fallback": (
        lambda spark, sf: table(spark, sf, "pages").select(
            "page_id", L.escape_fallback(F.col("url"), F.col("html")).alias("latex")
        ),
        "select page_id, concat('\\section{', url, '}', chr(10), chr(10), replace(replace(replace(replace(html, '&', '\\&'), '%', '\\%'), '#', '\\#'), '_', '\\_')) as latex from pages",
    ),
    "assemble_latex": (_latex, f"{_LATEX_SQL} select doc_id, style, latex from latex"),
    "sanitize_latex": (
        _sanitised,
        "select doc_id, concat('\\documentclass{IEEEtran}', chr(10), '\\usepackage{cite}', chr(10), chr(10), '\\usepackage{extra}', chr(10), chr(10), "
        "'\\begin{document}', chr(10), regexp_replace(concat(chr(10), chr(10), text, chr(10)), '\\n{4,}', concat(chr(10), chr(10), chr(10)), 'g'), "
        "chr(10), '\\end{document}') as latex from documents",
    ),
    "latex_outline": (
        lambda spark, sf: L.latex_outline(_latex(spark, sf)),
        f"""{_LATEX_SQL}, cut as (select doc_id, unnest(string_split(latex, chr(10))) as row, generate_subscripts(string_split(latex, chr(10)), 1) as line from latex)
 select doc_id, regexp_extract(row, '^\\\\section\\{{([^}}]+)\\}}', 1) as title, 1 as level, cast(line as int) as line from cut where starts_with(row, '\\section{{')""",
    ),
    "export_text": (
        lambda spark, sf: export_text(doc_elements(spark, sf)),
        "select doc_id, 0 as part, text from documents",
    ),
    "export_html": (
        lambda spark, sf: export_html(doc_elements(spark, sf).withColumn("style_name", F.expr("if(idx = 0, 'Title', 'Normal')"))),
        f"""with {DOC_LINES}, p as (select doc_id, idx, replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as t from lines),
 h as (select doc_id, idx, case when idx = 0 then concat('<h1 style="margin:0.5em 0 0.3em;color:#202124;" data-para-index="0">', case when t = '' then '&nbsp;' else t end, '</h1>')
  else concat('<p style="margin:0.25em 0;line-height:1.6;" data-para-index="', idx, '">', case when t = '' then '&nbsp;' else t end, '</p>') end as b from p)
 select doc_id, 0 as kind, 0 as part, concat('<div style="font-family:''Segoe UI'',Calibri,sans-serif;font-size:11pt;color:#202124;max-width:100%;padding:0.5em;">', chr(10),
  string_agg(b, chr(10) order by idx), chr(10), '</div>') as html from h group by doc_id""",
    ),
}
