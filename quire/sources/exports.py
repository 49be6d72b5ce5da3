"""Exports (O-S7..S10): text, HTML, report bundles and CSL-JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.formatting import runs_of

PART_ROWS = 10_000


def _joined(rows: DataFrame, keys: list[str], line: str, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("idx", line)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r[line]), "\n").alias(name))


def export_text(elements: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """O-S7: document text, newline-joined, in parts of ``part_rows`` rows.

    A document of up to ``part_rows`` rows is one part; the parts of a longer one,
    joined with a newline in order, are its text.
    """
    rows = elements.filter(F.col("type") == "paragraph").withColumn(
        "part", F.floor(F.col("idx") / part_rows).cast("int")
    )
    return _joined(rows, ["doc_id", "part"], "content", "text")


def _escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _run_html(r: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    text = _escape(r["text"])
    text = F.when(yes(r["bold"]), F.concat(F.lit("<b>"), text, F.lit("</b>"))).otherwise(text)
    text = F.when(yes(r["italic"]), F.concat(F.lit("<i>"), text, F.lit("</i>"))).otherwise(text)
    # A null part is left out by concat_ws.
    css = F.concat_ws(
        ";",
        F.when(yes(r["underline"]), "text-decoration:underline"),
        F.when(yes(r["strike"]), "text-decoration:line-through"),
        F.concat(F.lit("font-size:"), r["font_size_pt"].cast("string"), F.lit("pt")),
        F.concat(F.lit("font-family:'"), r["font_name"], F.lit("'")),
        F.concat(F.lit("color:#"), r["color"]),
    )
    styled = F.when(css != "", F.concat(F.lit('<span style="'), css, F.lit('">'), text, F.lit("</span>"))).otherwise(text)
    return F.when(F.coalesce(r["text"], F.lit("")) == "", F.lit("")).otherwise(styled)


# Tag and base style by style name, first match wins; lists override.
_TAGS = [
    ("heading 1", "h2", "margin:0.4em 0 0.2em;color:#1a73e8;"),
    ("heading 2", "h3", "margin:0.3em 0 0.15em;color:#1a73e8;"),
    ("heading 3", "h4", "margin:0.25em 0 0.1em;color:#555;"),
    ("title", "h1", "margin:0.5em 0 0.3em;color:#202124;"),
]
_PLAIN = ("p", "margin:0.25em 0;line-height:1.6;")
_ITEM = ("li", "margin-left:1.5em;")
_PAGE = (
    "<div style=\"font-family:'Segoe UI',Calibri,sans-serif;font-size:11pt;color:#202124;"
    'max-width:100%;padding:0.5em;">'
)
_TABLE = '<table style="border-collapse:collapse;width:100%;margin:0.5em 0;font-size:10pt;">'
_CELL = "border:1px solid #ddd;padding:6px 10px;"
_HEAD_CELL = _CELL + "background:#f1f3f4;font-weight:600;"


def paragraph_html(elements: DataFrame) -> DataFrame:
    """One HTML block per paragraph: ``(doc_id, idx, html)``."""
    name = F.lower(F.coalesce("style_name", F.lit("Normal")))
    is_item = name.contains("list") | name.contains("bullet")

    def choose(k: int) -> Column:
        c = F.when(is_item, _ITEM[k])
        for key, *values in _TAGS:
            c = c.when(name.contains(key), values[k])
        return c.otherwise(_PLAIN[k])

    tag, style = choose(0), choose(1)
    align = F.coalesce(F.concat(F.lit("text-align:"), F.col("fmt.alignment"), F.lit(";")), F.lit(""))
    inner = F.array_join(F.transform("runs", _run_html), "")
    inner = F.when(inner != "", inner).when(F.col("content") != "", _escape(F.col("content"))).otherwise("&nbsp;")
    html = F.concat(
        F.lit("<"), tag, F.lit(' style="'), style, align, F.lit('" data-para-index="'), F.col("idx").cast("string"),
        F.lit('">'), inner, F.lit("</"), tag, F.lit(">"),
    )
    rows = runs_of(elements.filter(F.col("type") == "paragraph"))
    return rows.select("doc_id", "idx", html.alias("html"))


def table_html(elements: DataFrame) -> DataFrame:
    """One HTML table per table element; the first row is the head."""

    def cell(c: Column, head: Column) -> Column:
        text = _escape(c["text"])
        th = F.concat(F.lit(f'<th style="{_HEAD_CELL}">'), text, F.lit("</th>"))
        td = F.concat(F.lit(f'<td style="{_CELL}">'), text, F.lit("</td>"))
        return F.when(head, th).otherwise(td)

    def row(r: Column, i: Column) -> Column:
        return F.concat(F.array(F.lit("<tr>")), F.transform(r, lambda c: cell(c, i == 0)), F.array(F.lit("</tr>")))

    lines = F.flatten(F.transform("cells", row))
    html = F.array_join(F.concat(F.array(F.lit(_TABLE)), lines, F.array(F.lit("</table>"))), "\n")
    return elements.filter(F.col("type") == "table").select("doc_id", "idx", html.alias("html"))


def export_html(elements: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """O-S8: HTML per document in parts, paragraphs first and tables after them."""
    blocks = paragraph_html(elements).withColumn("kind", F.lit(0)).unionByName(
        table_html(elements).withColumn("kind", F.lit(1))
    )
    blocks = blocks.withColumn("part", F.floor(F.col("idx") / part_rows).cast("int"))
    parts = _joined(blocks, ["doc_id", "kind", "part"], "html", "html")
    ends = parts.groupBy("doc_id").agg(
        F.min(F.struct("kind", "part")).alias("first"), F.max(F.struct("kind", "part")).alias("last")
    )
    here = F.struct("kind", "part")
    opened = F.when(here == F.col("first"), F.lit(_PAGE + "\n")).otherwise("")
    closed = F.when(here == F.col("last"), F.lit("\n</div>")).otherwise("")
    return parts.join(ends, "doc_id").select(
        "doc_id", "kind", "part", F.concat(opened, "html", closed).alias("html")
    )


def write_reports(reports: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """O-S9: result rows under ``path``, one folder per style."""
    reports.write.mode(mode).partitionBy("style_id").format(fmt).save(path)


def csl_json(references: DataFrame) -> DataFrame:
    """O-S10: references as CSL-JSON; absent keys are left out, the year is a number."""
    family = F.coalesce(F.get("ref.authors", F.lit(0))["family"], F.lit("unknown"))
    key = F.concat(F.lower(family), F.lit("-"), F.coalesce("ref.year", F.lit("0000")))
    authors = F.when(
        F.size("ref.authors") > 0,
        F.transform(
            "ref.authors",
            lambda a: F.struct(a["family"].alias("family"), F.coalesce(a["given"], F.lit("")).alias("given")),
        ),
    )
    year = F.when(
        F.col("ref.year").isNotNull(), F.struct(F.array(F.array(F.col("ref.year").cast("int"))).alias("date-parts"))
    )
    item = F.struct(
        F.coalesce("ref.ref_type", F.lit("article-journal")).alias("type"),
        key.alias("id"),
        authors.alias("author"),
        year.alias("issued"),
        F.col("ref.title").alias("title"),
        F.col("ref.container_title").alias("container-title"),
        F.col("ref.volume").alias("volume"),
        F.col("ref.issue").alias("issue"),
        F.col("ref.pages").alias("page"),
        F.col("ref.doi").alias("DOI"),
        F.col("ref.url").alias("URL"),
        F.col("ref.publisher").alias("publisher"),
        F.col("ref.edition").alias("edition"),
    )
    return references.select("doc_id", "ref_idx", F.to_json(item).alias("csl"))
