"""Sections, chunks and LaTeX text (O-L1..L8)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.base import strip
from quire.functions.citation_text import gathered, py_strip
from quire.ordering import Limit, latest, over_documents, total

# Names that open a section, and chunk sizes.
SECTION_START = (
    r"(?i)^(Abstract|Introduction|Background|Results|Discussion|Materials and Methods|Methods|"
    r"Significance|Conclusion|Conclusions|Acknowledgments|ACKNOWLEDGMENTS|References|Appendix|"
    r"Supplementary|Supporting Information)"
)
MAX_SECTION_CHUNK, MAX_GUIDELINE_CHUNK = 5000, 6000
STRETCH = 1000


def split_sections(lines: DataFrame, max_rows: Limit = None) -> DataFrame:
    """O-L1: ``(doc_id, idx, content)`` lines to ``(doc_id, section_no, title, content)``.

    A line that starts with a section name opens a section unless the current one has no
    line yet, so of several such lines in a row every other one does.
    """
    rows = lines.select("doc_id", "idx", "content", F.expr(strip("content")).alias("line"))
    rows = rows.withColumn("header", F.col("line").rlike(SECTION_START))

    def number(df, scan):
        df = scan.running(df, _plain=latest(F.when(~F.col("header"), F.col("idx"))))
        # Lines since the last ordinary one; a run at the very top is one line ahead.
        nth = F.col("idx") - F.coalesce("_plain", F.lit(-2)) - 1
        opens = F.col("header") & (nth % 2 == 0)
        return scan.running(df.withColumn("opens", opens), section_no=total(F.col("opens").cast("int")))

    marked = over_documents(rows, number, max_rows)
    stretch = F.floor(F.col("idx") / STRETCH).alias("stretch")
    ordered = F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("idx", "content"))))
    pieces = marked.groupBy("doc_id", "section_no", stretch).agg(
        F.max(F.when(F.col("opens"), F.col("line"))).alias("title"),
        F.count_if(~F.col("opens")).alias("n"),
        F.array_join(F.transform(ordered, lambda r: r["content"]), "\n").alias("text"),
    )
    ordered = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("stretch", "text"))))
    whole = pieces.groupBy("doc_id", "section_no").agg(
        F.max("title").alias("title"),
        F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("content"),
    )
    named = whole.select(
        "doc_id",
        "section_no",
        F.when(F.col("section_no") == 0, "Preamble").otherwise(F.col("title")).alias("title"),
        F.expr(strip("content")).alias("content"),
    )
    return named.filter("content <> ''")


def _pack(paragraphs: Column, limit: int, restart: bool = False) -> Column:
    """Greedy packing: chunks of paragraphs whose text with separators stays within ``limit``.

    With ``restart`` an empty chunk is as good as none.
    """
    def step(acc: Column, p: Column) -> tuple[dict[str, Column], Column]:
        opened = F.nullif(acc["open"], F.lit("")) if restart else acc["open"]
        full = F.length(opened) + F.length(p) + 2 > limit
        longer = F.when(opened.isNull() | full, p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        return {"open": longer}, F.when(p.isNull() | full, acc["open"])

    # A null after the last paragraph closes the chunk that is open.
    ended = F.concat(paragraphs, F.array(F.lit(None).cast("string")))
    return gathered(ended, {"open": F.lit(None).cast("string")}, "string", step)


def chunk_sections(sections: DataFrame, limit: int = MAX_SECTION_CHUNK) -> DataFrame:
    """O-L2: long sections cut at blank lines into parts of at most ``limit`` characters."""
    content = F.col("content")
    long = F.length(content) > limit
    chunks = F.when(long, _pack(F.split(content, "\n\n", -1), limit)).otherwise(F.array(content))
    rows = sections.withColumn("_chunks", chunks).select(
        "doc_id", "section_no", "title", F.size("_chunks").alias("n"), F.posexplode("_chunks").alias("part", "chunk")
    )
    part = F.col("part") + 1
    title = F.when(
        F.col("n") > 1, F.concat("title", F.lit(" (Part "), part.cast("string"), F.lit(")"))
    ).otherwise(F.col("title"))
    return rows.select(
        "doc_id", "section_no", part.alias("part"), title.alias("title"), F.expr(strip("chunk")).alias("content")
    )


def chunk_guideline(texts: DataFrame, column: str = "text", limit: int = MAX_GUIDELINE_CHUNK) -> DataFrame:
    """O-L2, guideline form: the whole text in chunks of at most ``limit`` characters."""
    text = F.col(column)
    parts = F.filter(
        F.transform(_pack(F.split(text, "\n\n", -1), limit, restart=True), py_strip), lambda c: c != ""
    )
    chunks = F.when(F.length(text) <= limit, F.array(text)).otherwise(parts)
    others = [c for c in texts.columns if c != column]
    return texts.select(*others, F.posexplode(chunks).alias("chunk_no", "chunk"))


# LaTeX fragments that a body must not carry.
_CLASS = r"\\documentclass(\[.*?\])?\{.*?\}"
_PACKAGE = r"\\usepackage(\[.*?\])?\{.*?\}"
_ABSTRACT_END = r"(?=\\section(?:\*?\{)|\\begin\{thebibliography\}|\z)"
_BLANK_RUN = r"\n{4,}"


def _drop(c: Column, *patterns: str) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


def clean_latex_chunk(c: Column) -> Column:
    """O-L3: body text of one chunk, without fences, preamble and document tags."""
    text = py_strip(c)
    unfenced = py_strip(_drop(text, r"\A```[a-zA-Z]*\n?", r"\n?```\z"))
    text = F.when(text.startswith("```"), unfenced).otherwise(text)
    return py_strip(
        _drop(text, _CLASS, _PACKAGE, r"\\begin\{document\}", r"\\end\{document\}", r"\\maketitle", r"\\printbibliography")
    )


@F.pandas_udf(T.StringType())
def _single_title(bodies: pd.Series) -> pd.Series:
    """Drop every ``\\title{…}`` but the first, matching braces."""

    def one(body: str) -> str:
        first = body.find("\\title{")
        at = body.rfind("\\title{")
        while at > first:
            depth = 0
            for end in range(at, len(body)):
                depth += (body[end] == "{") - (body[end] == "}")
                if body[end] == "}" and depth == 0:
                    body = body[:at] + body[end + 1 :]
                    break
            at = body.rfind("\\title{", 0, at)
        return body

    return bodies.map(one, na_action="ignore")


def postprocess_latex(c: Column, style: Column) -> Column:
    """O-L4: repairs of a merged body."""
    body = _drop(c, r"\\begin\{abstract\}\s*\\end\{abstract\}")
    body = _drop(body, r"(?i)\\section\*?\{Abstract\}\s*\n\s*" + _ABSTRACT_END)
    body = F.regexp_replace(
        body,
        r"(?is)\\section\*?\{Abstract\}\s*\n\s*(.*?)\s*" + _ABSTRACT_END,
        "\\\\begin{abstract}\n$1\n\\\\end{abstract}",
    )
    cut = F.instr(body, "\\maketitle") + F.length(F.lit("\\maketitle")) - 1
    body = F.when(
        body.contains("\\maketitle"),
        F.concat(
            F.substring(body, F.lit(1), cut),
            F.replace(F.substring(body, cut + 1, F.length(body)), F.lit("\\maketitle"), F.lit("")),
        ),
    ).otherwise(body)
    body = F.regexp_replace(body, r"\*\*(.+?)\*\*", "\\\\textbf{$1}")
    body = F.regexp_replace(body, r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "\\\\textit{$1}")
    body = _drop(body, r"\\begin\{document\}", r"\\end\{document\}")
    # Only bodies with a second title go to Python.
    twice = F.regexp_count(body, F.lit(r"\\title\{")) > 1
    body = F.coalesce(_single_title(F.when(twice, body)), body)
    body = F.regexp_replace(body, _BLANK_RUN, "\n\n\n")
    keywords = F.regexp_replace(
        body,
        r"(?m)^\\textit\{Index Terms\}[—–-]+\s*(.+)$",
        "\\\\begin{IEEEkeywords}\n$1\n\\\\end{IEEEkeywords}",
    )
    body = F.when(F.lower(style) == "ieee", keywords).otherwise(body)
    return py_strip(_drop(body, r"\\bibliography\{[^}]*\}", r"\\bibliographystyle\{[^}]*\}"))


def escape_fallback(title: Column, content: Column) -> Column:
    """O-L5: plain text as a LaTeX section."""
    escaped = content
    for ch in "&%#_":
        escaped = F.replace(escaped, F.lit(ch), F.lit("\\" + ch))
    return F.concat(F.lit("\\section{"), title, F.lit("}\n\n"), escaped)


# The preamble of each style, line by line.
PREAMBLES = {
    "ieee": [
        "\\documentclass[conference]{IEEEtran}",
        "\\usepackage{cite}",
        "\\usepackage{amsmath,amssymb,amsfonts}",
        "\\usepackage{graphicx}",
        "\\usepackage{textcomp}",
        "\\usepackage{xcolor}",
        "\\usepackage{hyperref}",
        "\\usepackage{float}",
        "\\usepackage[utf8]{inputenc}",
        "\\usepackage[T1]{fontenc}",
    ],
    "apa7": [
        "\\documentclass[12pt]{article}",
        "\\usepackage[margin=1in]{geometry}",
        "\\usepackage{times}",
        "\\usepackage{setspace}",
        "\\doublespacing",
        "\\usepackage{amsmath}",
        "\\usepackage{graphicx}",
        "\\usepackage{hyperref}",
        "\\usepackage{float}",
        "\\usepackage{natbib}",
        "\\usepackage{caption}",
        "\\usepackage[utf8]{inputenc}",
        "\\usepackage[T1]{fontenc}",
        "\\usepackage{indentfirst}",
        "\\setlength{\\parindent}{0.5in}",
    ],
    "mla": [
        "\\documentclass[12pt]{article}",
        "\\usepackage[margin=1in]{geometry}",
        "\\usepackage{times}",
        "\\usepackage{setspace}",
        "\\doublespacing",
        "\\usepackage{amsmath}",
        "\\usepackage{graphicx}",
        "\\usepackage{hyperref}",
        "\\usepackage{float}",
        "\\usepackage[utf8]{inputenc}",
        "\\usepackage[T1]{fontenc}",
        "\\usepackage{indentfirst}",
        "\\setlength{\\parindent}{0.5in}",
    ],
    "chicago": [
        "\\documentclass[12pt]{article}",
        "\\usepackage[margin=1in]{geometry}",
        "\\usepackage{times}",
        "\\usepackage{setspace}",
        "\\doublespacing",
        "\\usepackage{amsmath}",
        "\\usepackage{graphicx}",
        "\\usepackage{hyperref}",
        "\\usepackage{float}",
        "\\usepackage{caption}",
        "\\usepackage[utf8]{inputenc}",
        "\\usepackage[T1]{fontenc}",
        "\\usepackage{indentfirst}",
        "\\setlength{\\parindent}{0.5in}",
    ],
    "vancouver": [
        "\\documentclass[12pt]{article}",
        "\\usepackage[margin=1in]{geometry}",
        "\\usepackage{times}",
        "\\usepackage{setspace}",
        "\\doublespacing",
        "\\usepackage{amsmath}",
        "\\usepackage{graphicx}",
        "\\usepackage{hyperref}",
        "\\usepackage{float}",
        "\\usepackage{caption}",
        "\\usepackage[utf8]{inputenc}",
        "\\usepackage[T1]{fontenc}",
    ],
    "default": [
        "\\documentclass[12pt]{article}",
        "\\usepackage[margin=1in]{geometry}",
        "\\usepackage{amsmath}",
        "\\usepackage{amssymb}",
        "\\usepackage{graphicx}",
        "\\usepackage{hyperref}",
        "\\usepackage{float}",
        "\\usepackage{caption}",
        "\\usepackage{natbib}",
        "\\usepackage{times}",
        "\\usepackage[utf8]{inputenc}",
        "\\usepackage[T1]{fontenc}",
    ],
}


def preambles(spark: SparkSession) -> DataFrame:
    rows = [(style, "\n".join(lines) + "\n") for style, lines in PREAMBLES.items()]
    return spark.createDataFrame(rows, "style string, preamble string")


def assemble_latex(chunks: DataFrame) -> DataFrame:
    """O-L6: ``(doc_id, style, section_no, part, latex)`` to one document per ``doc_id`` and style.

    The document is one text value; its parts are joined per section first.
    """
    spark = chunks.sparkSession
    ordered = F.array_sort(F.collect_list(F.struct("part", "latex")))
    sections = chunks.groupBy("doc_id", "style", "section_no").agg(
        F.array_join(F.transform(ordered, lambda r: r["latex"]), "\n\n").alias("latex")
    )
    ordered = F.array_sort(F.collect_list(F.struct("section_no", "latex")))
    bodies = sections.groupBy("doc_id", "style").agg(
        F.array_join(F.transform(ordered, lambda r: r["latex"]), "\n\n").alias("body")
    )
    table = preambles(spark)
    default = "\n".join(PREAMBLES["default"]) + "\n"
    known = F.broadcast(table.select(F.col("style").alias("_style"), "preamble"))
    df = bodies.join(known, F.lower("style") == F.col("_style"), "left")
    df = df.withColumn("body", postprocess_latex(F.col("body"), F.col("style")))
    latex = F.concat(
        F.coalesce("preamble", F.lit(default)),
        F.lit("\n\\begin{document}\n\n"),
        "body",
        F.lit("\n\n\\end{document}\n"),
    )
    return df.select("doc_id", "style", latex.alias("latex"))


# What the conference class does by itself and must not be loaded again.
_IEEE_DROPS = ("geometry", "natbib", "setspace", "indentfirst", "times", "subcaption")


def _package(name: str) -> str:
    return r"\\usepackage(\[.*?\])?\{" + name + r"\}"


def sanitize_latex(documents: DataFrame, column: str = "latex") -> DataFrame:
    """O-L7: one class line, no package conflicts or duplicates, packages hoisted from the body."""
    code = F.col(column)
    begin = "\\begin{document}"
    at = F.instr(code, begin)
    df = documents.withColumns(
        {
            "_lines": F.split(F.substring(code, F.lit(1), at - 1), "\n", -1),
            "_body": F.substring(code, at, F.length(code)),
        }
    )

    def is_class(line: Column) -> Column:
        return py_strip(line).startswith("\\documentclass")

    lines = F.col("_lines")
    first = F.array_position(F.transform(lines, is_class), True)
    kept = F.filter(lines, lambda line, i: ~is_class(line) | (i + 1 == first))
    has = first > 0
    pre = F.array_join(kept, "\n")
    df = df.withColumns(
        {
            "_pre": F.when(has, pre).otherwise(F.concat(F.lit("\\documentclass{article}\n"), pre)),
            "_ieee": F.when(has, F.try_element_at(lines, first.cast("int")).contains("IEEEtran")).otherwise(False),
        }
    )
    pre = F.col("_pre")
    natbib, biblatex = pre.rlike(_package("natbib")), pre.rlike(_package("biblatex"))
    df = df.withColumns({"_natbib": natbib, "_biblatex": biblatex})
    both = F.col("_natbib") & F.col("_biblatex")
    pre = F.when(both, _drop(pre, _package("biblatex") + r"\n?")).otherwise(pre)
    lean = _drop(pre, *[_package(p) + r"\n?" for p in _IEEE_DROPS], r"\\doublespacing\n?")
    df = df.withColumn("_pre", F.when(F.col("_ieee"), lean).otherwise(pre))
    names = F.transform(
        F.split("_pre", "\n", -1),
        lambda line: F.struct(
            line.alias("line"),
            F.regexp_extract(py_strip(line), r"^\\usepackage(\[.*?\])?\{(.+?)\}$", 2).alias("name"),
        ),
    )
    df = df.withColumn("_named", names)
    named = F.col("_named")
    unique = F.filter(
        named,
        lambda r, i: (r["name"] == "") | (F.array_position(F.transform(named, lambda x: x["name"]), r["name"]) == i + 1),
    )
    df = df.withColumn("_pre", F.array_join(F.transform(unique, lambda r: r["line"]), "\n"))
    body = _drop(F.col("_body"), r"\\begin\{document\}", r"\\end\{document\}", _CLASS)
    body = F.when(F.col("_natbib") & ~F.col("_biblatex"), _drop(body, r"\\printbibliography")).otherwise(body)
    body = _drop(body, r"\\begin\{abstract\}\s*\\end\{abstract\}")
    df = df.withColumn("_body", body)
    section = r"(?is)\A(.*?)\\section\*?\{Abstract\}\s*\n\s*(.*?)\s*(?=\\section(?:\*?\{)|\\begin\{thebibliography|\z)"
    wrapped = F.regexp_replace("_body", section, "$1\\\\begin{abstract}\n$2\n\\\\end{abstract}\n\n")
    emptied = F.regexp_replace("_body", section, "$1")
    df = df.withColumn(
        "_body", F.when(F.regexp_extract("_body", section, 2) == "", emptied).otherwise(wrapped)
    )
    trapped = r"\\(usepackage|usetikzlibrary)(\[.*?\])?\{.*?\}"
    command = r"\\(setlength|setcounter|renewcommand)\{[^}]*\}\{[^}]*\}"
    packages = F.regexp_extract_all("_body", F.lit(trapped), F.lit(0))
    df = df.withColumns({"_hoist": packages, "_body": _drop(F.col("_body"), trapped)})
    commands = F.expr(f"filter(regexp_extract_all(_body, r'{command}', 0), m -> instr(_body, m) <= 200)")
    top = _drop(F.substring("_body", 1, 200), command)
    rest = F.expr("substr(_body, 201)")
    df = df.withColumns({"_hoist": F.concat("_hoist", commands), "_body": F.concat(top, rest)})
    body = F.regexp_replace("_body", _BLANK_RUN, "\n\n\n")
    hoisted = F.array_join(F.transform("_hoist", lambda m: F.concat(m, F.lit("\n"))), "")
    full = F.concat("_pre", F.lit("\n"), hoisted, F.lit(f"\n{begin}\n"), body, F.lit("\n\\end{document}"))
    snippet = F.concat(F.lit(f"\\documentclass{{article}}\n{begin}\n"), code, F.lit("\n\\end{document}"))
    out = F.when(at == 0, snippet).otherwise(full)
    return df.select(*[out.alias(column) if c == column else c for c in documents.columns])


def latex_outline(documents: DataFrame, column: str = "latex") -> DataFrame:
    """O-L8: section lines with title, level (1, or 2 for any depth below) and 1-based line."""
    lines = documents.select("doc_id", F.posexplode(F.split(column, "\n", -1)).alias("_n", "_line"))
    line = py_strip(F.col("_line"))
    pattern = r"^\\(sub)*section\*?\{([^}]+)\}"
    return lines.filter(line.rlike(pattern)).select(
        "doc_id",
        F.regexp_extract(line, pattern, 2).alias("title"),
        F.when(line.startswith("\\sub"), 2).otherwise(1).alias("level"),
        (F.col("_n") + 1).alias("line"),
    )
