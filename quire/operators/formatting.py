"""Format planning (O-F1..F13): what a style asks of every row, as tables.

A styles argument is the small dimension of ``quire.sources.styles``; it is broadcast.
Results carry ``style_id``, one plan per style passed in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.base import strip
from quire.functions.text import strip_heading_number, text_case
from quire.operators.styles import heading_specs, in_styles
from quire.ordering import Limit, latest, over_documents, reindex, total
from quire.schemas import HEADING_ROLES, ROLES

ALIGNMENTS = ("left", "center", "right", "justify")

# Heading labels that are never numbered.
UNNUMBERED = (
    "abstract",
    "references",
    "bibliography",
    "acknowledgments",
    "acknowledgements",
    "appendix",
    "appendices",
    "supplementary material",
    "supplementary materials",
    "supporting information",
)
# Roman numerals of the first twenty sections.
ROMAN = [
    "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV",
    "XVI", "XVII", "XVIII", "XIX", "XX",
]
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FRONT_ROLES = ("title", "author_info", "abstract_label", "abstract_body", "keywords")

TARGET_FIELDS = (
    "alignment",
    "first_line_indent",
    "left_indent",
    "line_spacing",
    "space_before",
    "space_after",
    "font_name",
    "font_size_pt",
    "bold",
    "italic",
)


def _aligned(c: str, default: str) -> Column:
    return F.when(F.col(c).isin(*ALIGNMENTS), F.col(c)).otherwise(default)


def _target(role: str, **over) -> Column:
    typo = "default_typography"
    fields = {
        "alignment": _aligned(f"{typo}.paragraph_alignment", "left"),
        "first_line_indent": F.lit(0.0),
        "left_indent": F.lit(0.0),
        "line_spacing": F.col(f"{typo}.line_spacing"),
        "space_before": F.lit(0.0),
        "space_after": F.lit(0.0),
        "font_name": F.col(f"{typo}.font_name"),
        "font_size_pt": F.col(f"{typo}.font_size_pt"),
        "bold": F.lit(None),
        "italic": F.lit(None),
        **over,
    }
    types = {"alignment": "string", "font_name": "string", "bold": "boolean", "italic": "boolean"}
    return F.struct(
        F.lit(role).alias("role"),
        *[fields[k].cast(types.get(k, "double")).alias(k) for k in TARGET_FIELDS],
    )


def _element_target(role: str, path: str) -> Column:
    return _target(
        role,
        alignment=_aligned(f"{path}.alignment", "center"),
        font_size_pt=F.col(f"{path}.font_size_pt"),
        bold=F.col(f"{path}.bold"),
        italic=F.col(f"{path}.italic"),
    )


def _heading_target(level: int) -> Column:
    h = f"headings.level_{level}"
    indented = F.col(f"{h}.alignment") == "indented"
    known = F.col(f"{h}.alignment").isin("center", "left", "indented")
    indent = F.coalesce(F.nullif(F.col(f"{h}.indent_inches"), F.lit(0.0)), F.lit(0.5))
    return _target(
        f"heading_{level}",
        alignment=F.when(indented, "left").when(known, F.col(f"{h}.alignment")),
        first_line_indent=F.when(indented, indent).when(known, 0.0),
        left_indent=F.when(known, 0.0),
        font_size_pt=F.col(f"{h}.font_size_pt"),
        bold=F.col(f"{h}.bold"),
        italic=F.col(f"{h}.italic"),
    )


def role_format(specs: DataFrame) -> DataFrame:
    """The format dimension: one row per style and role."""
    typo, refs = "default_typography", "references"
    hanging = (F.col(f"{refs}.entry_indent_type") == "hanging") & (
        F.col(f"{refs}.hanging_indent_inches") > 0
    )
    none = F.lit(None)
    body = {
        "first_line_indent": F.col(f"{typo}.first_line_indent_inches"),
        "space_before": F.col(f"{typo}.space_before_paragraph_pt"),
        "space_after": F.col(f"{typo}.space_after_paragraph_pt"),
    }
    special = {
        "title": _element_target("title", "title_page.title"),
        "author_info": _element_target("author_info", "title_page.author_name"),
        "abstract_label": _target(
            "abstract_label",
            alignment=_aligned("abstract.label_alignment", "center"),
            space_before=none,
            bold=F.col("abstract.label_bold"),
        ),
        "abstract_body": _target(
            "abstract_body",
            first_line_indent=F.when(
                F.col("abstract.paragraph_indent"), F.col(f"{typo}.first_line_indent_inches")
            ).otherwise(0.0),
            bold=F.lit(False),
        ),
        "keywords": _target(
            "keywords", first_line_indent=F.when(F.col("abstract.keywords_indent"), 0.5).otherwise(0.0)
        ),
        "reference_label": _target(
            "reference_label",
            alignment=_aligned(f"{refs}.label_alignment", "center"),
            space_before=none,
            bold=F.col(f"{refs}.label_bold"),
        ),
        "reference_entry": _target(
            "reference_entry",
            left_indent=F.when(hanging, F.col(f"{refs}.hanging_indent_inches")).otherwise(0.0),
            first_line_indent=F.when(hanging, -F.col(f"{refs}.hanging_indent_inches")).otherwise(0.0),
            line_spacing=F.col(f"{refs}.line_spacing"),
            bold=F.lit(False),
        ),
        "table_caption": _target("table_caption"),
        "figure_caption": _target("figure_caption"),
        **{f"heading_{n}": _heading_target(n) for n in range(1, 6)},
    }
    rows = [special.get(r) if r in special else _target(r, **body) for r in ROLES]
    return specs.select("style_id", F.inline(F.array(*rows)))


def _paragraphs(elements: DataFrame) -> DataFrame:
    return elements.filter(F.col("type") == "paragraph").withColumn("text", F.expr(strip("content")))


def _suppressed() -> Column:
    return (F.col("role") == "unknown") & (F.col("text") == "")


def target_format(elements: DataFrame, specs: DataFrame, doc_styles: DataFrame) -> DataFrame:
    """O-F1: the format every paragraph should have; suppressed rows are left out."""
    rows = _paragraphs(elements).filter(~_suppressed()).select("doc_id", "idx", "role")
    return in_styles(rows, doc_styles, role_format(specs), "role").select("style_id", "doc_id", "idx", "role", *TARGET_FIELDS)


def runs_of(elements: DataFrame) -> DataFrame:
    """Elements whose ``runs`` are filled: text without runs is one plain run."""
    run_type = elements.schema["runs"].dataType.elementType
    plain = F.struct(
        *[
            (F.col("content") if f.name == "text" else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in run_type.fields
        ]
    )
    return elements.withColumn("runs", F.coalesce("runs", F.array(plain)))


def _restyled(run: Column, bold: Column, italic: Column) -> Column:
    return (
        run.withField("font_name", F.col("_font"))
        .withField("font_size_pt", F.col("_size"))
        .withField("bold", bold)
        .withField("italic", italic)
    )


def caption_run_format(elements: DataFrame, specs: DataFrame, doc_styles: DataFrame) -> DataFrame:
    """O-F2: runs that open with the number label take its flags, others the title's."""
    rules = specs.select(
        "style_id",
        F.col("default_typography.font_name").alias("_font"),
        F.col("default_typography.font_size_pt").alias("_size"),
        F.inline(
            F.array(
                F.expr(
                    "struct('table_caption' as role, lower(tables.number_label) as _label, "
                    "tables.number_bold as _nb, tables.number_italic as _ni, tables.title_italic as _ti)"
                ),
                F.expr(
                    "struct('figure_caption' as role, lower(figures.number_label) as _label, "
                    "figures.number_bold as _nb, figures.number_italic as _ni, figures.title_italic as _ti)"
                ),
            )
        ),
    )
    rows = runs_of(elements.filter(F.col("role").isin("table_caption", "figure_caption")))
    joined = in_styles(rows, doc_styles, rules, "role")

    def one(run: Column) -> Column:
        number = F.lower(F.trim(run["text"])).startswith(F.col("_label"))
        return _restyled(
            run,
            F.when(number, F.col("_nb")).otherwise(False),
            F.when(number, F.col("_ni")).otherwise(F.col("_ti")),
        )

    return joined.select("style_id", "doc_id", "idx", F.transform("runs", one).alias("runs"))


def keyword_run_format(elements: DataFrame, specs: DataFrame, doc_styles: DataFrame) -> DataFrame:
    """O-F3: the run with the word ``keyword`` is italic, the others plain."""
    fonts = specs.select(
        "style_id",
        F.col("default_typography.font_name").alias("_font"),
        F.col("default_typography.font_size_pt").alias("_size"),
    )
    rows = runs_of(elements.filter(F.col("role") == "keywords"))
    joined = in_styles(rows, doc_styles, fonts)
    return joined.select(
        "style_id",
        "doc_id",
        "idx",
        F.transform(
            "runs",
            lambda r: _restyled(r, F.lit(False), F.lower(r["text"]).contains("keyword")),
        ).alias("runs"),
    )


def _level() -> Column:
    return F.substring("role", 9, 1).cast("int")


def number_headings(elements: DataFrame, max_rows: Limit = None) -> DataFrame:
    """O-F4: ``prefix`` of every heading that gets a number: ``I.``, ``A.``, ``1)``."""
    clean = strip_heading_number.sql(strip("content"))
    label = F.expr(f"lower({strip_heading_number.sql(clean)})")
    rows = elements.filter((F.col("type") == "paragraph") & F.col("role").isin(*HEADING_ROLES))
    rows = rows.filter(~label.isin(*UNNUMBERED)).select("doc_id", "idx", _level().alias("level"))
    level = F.col("level")

    def count(df, scan):
        df = scan.running(
            df,
            _n1=total((level == 1).cast("int")),
            _n2=total((level == 2).cast("int")),
            _n3=total((level >= 3).cast("int")),
        )
        return scan.running(
            df,
            _base2=latest(F.when(level == 1, F.col("_n2"))),
            _base3=latest(F.when(level <= 2, F.col("_n3"))),
        )

    df = over_documents(rows, count, max_rows)
    n1 = F.col("_n1")
    n2 = F.col("_n2") - F.coalesce("_base2", F.lit(0))
    n3 = F.col("_n3") - F.coalesce("_base3", F.lit(0))
    roman = F.array(*[F.lit(r) for r in ROMAN])

    def plain(n: Column) -> Column:
        return n.cast("string")

    prefix = (
        F.when(
            level == 1,
            F.concat(F.when(n1 <= len(ROMAN), F.try_element_at(roman, n1.cast("int"))).otherwise(plain(n1)), F.lit(".")),
        )
        .when(
            level == 2,
            F.concat(
                F.when(n2 <= len(LETTERS), F.substring(F.lit(LETTERS), n2.cast("int"), F.lit(1))).otherwise(plain(n2)),
                F.lit("."),
            ),
        )
        .otherwise(F.concat(plain(n3), F.lit(")")))
    )
    return df.select("doc_id", "idx", "level", prefix.alias("prefix"))


def heading_text(
    elements: DataFrame, specs: DataFrame, doc_styles: DataFrame, max_rows: Limit = None
) -> DataFrame:
    """O-F5: heading text in the document's style: old number off, case set, new number on."""
    cases = heading_specs(specs).select("style_id", "level", F.col("case").alias("_case"), "description")
    numbered = specs.select("style_id", (F.col("headings.numbering_style") == "ieee").alias("_numbered"))
    dim = cases.join(numbered, "style_id")
    rows = _paragraphs(elements).filter(F.col("role").isin(*HEADING_ROLES))
    rows = rows.select("doc_id", "idx", "text", _level().alias("level"), strip_heading_number("text").alias("_clean"))
    prefixes = number_headings(elements, max_rows).select("doc_id", "idx", "prefix")
    df = in_styles(rows.join(prefixes, ["doc_id", "idx"], "left"), doc_styles, dim, "level")
    cased = text_case("_clean", "_case")
    new = F.when(
        F.col("_numbered") & F.col("prefix").isNotNull(), F.concat("prefix", F.lit(" "), cased)
    ).otherwise(cased)
    return df.select("style_id", "doc_id", "idx", "level", "description", F.col("text").alias("old_text"), new.alias("new_text"))


def _document_marks(elements: DataFrame) -> DataFrame:
    """Per document: which labels exist and where the front, abstract and references start."""
    role, idx = F.col("role"), F.col("idx")
    abstract = role.isin("abstract_body", "abstract_label")
    marks = elements.groupBy("doc_id").agg(
        F.coalesce(F.bool_or(role == "abstract_label"), F.lit(False)).alias("has_abstract_label"),
        F.coalesce(F.bool_or(role == "reference_label"), F.lit(False)).alias("has_reference_label"),
        F.min(F.when(abstract, idx)).alias("abstract_idx"),
        F.min(F.when(role == "reference_entry", idx)).alias("reference_idx"),
        F.max(F.when(role.isin(*FRONT_ROLES), idx)).alias("front_idx"),
    )
    return marks


def _body_start(elements: DataFrame, marks: DataFrame) -> DataFrame:
    """First body or heading row after the abstract."""
    rows = elements.filter(F.col("role").isin("body", "heading_1", "heading_2", "heading_3"))
    joined = rows.select("doc_id", "idx").join(
        marks.filter("abstract_idx is not null").select("doc_id", "abstract_idx"), "doc_id"
    )
    return joined.filter("idx > abstract_idx").groupBy("doc_id").agg(F.min("idx").alias("body_idx"))


def insert_missing_labels(
    elements: DataFrame, specs: DataFrame, doc_styles: DataFrame, max_rows: Limit = None
) -> DataFrame:
    """O-F6: an abstract or reference label row in front of its first row, where none exists.

    ``doc_styles`` has one row per document: the labels become rows of the document.
    """
    marks = _document_marks(elements)
    labels = specs.select(
        "style_id", F.col("abstract.label").alias("_abstract"), F.col("references.section_label").alias("_references")
    ).filter("_abstract is not null")
    wanted = in_styles(marks, doc_styles, labels).select(
        "doc_id",
        F.inline(
            F.array(
                F.struct(
                    F.when(~F.col("has_abstract_label"), F.col("abstract_idx")).alias("before"),
                    F.col("_abstract").alias("content"),
                    F.lit("abstract_label").alias("role"),
                ),
                F.struct(
                    F.when(~F.col("has_reference_label"), F.col("reference_idx")).alias("before"),
                    F.col("_references").alias("content"),
                    F.lit("reference_label").alias("role"),
                ),
            )
        ),
    ).filter("before is not null")
    # Positions are doubled so that a new row fits in front of an old one.
    have = {"idx", "doc_id", "content", "role", "type"}
    old = elements.withColumn("idx", F.col("idx") * 2)
    new = wanted.select(
        "doc_id",
        (F.col("before") * 2 - 1).alias("idx"),
        "content",
        "role",
        F.lit("paragraph").alias("type"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in elements.schema.fields if f.name not in have],
    ).select(*elements.columns)
    return reindex(old.unionByName(new), max_rows)


def page_breaks(elements: DataFrame, specs: DataFrame, doc_styles: DataFrame) -> DataFrame:
    """O-F7: rows that start a page; ``inserted`` if the break sits on an inserted label row."""
    marks = _document_marks(elements)
    marks = marks.join(_body_start(elements, marks), "doc_id", "left")
    df = in_styles(marks, doc_styles, specs.select("style_id", F.col("title_page.required").alias("_page")))
    page = F.col("_page")
    breaks = F.array(
        F.struct(
            F.lit("abstract").alias("reason"),
            F.when(page, F.col("abstract_idx")).alias("idx"),
            (~F.col("has_abstract_label")).alias("inserted"),
        ),
        F.struct(
            F.lit("body").alias("reason"), F.when(page, F.col("body_idx")).alias("idx"), F.lit(False).alias("inserted")
        ),
        F.struct(
            F.lit("references").alias("reason"),
            F.col("reference_idx").alias("idx"),
            (~F.col("has_reference_label")).alias("inserted"),
        ),
    )
    return df.select("style_id", "doc_id", F.inline(breaks)).filter("idx is not null")


def running_head(elements: DataFrame, specs: DataFrame, doc_styles: DataFrame) -> DataFrame:
    """O-F8: the joined title in capitals, cut to the style's length, where a style has one.

    From the first non-blank title line on every line adds at least one character, so no
    more lines than characters are gathered per document.
    """
    styles = specs.filter("running_head.enabled").select("style_id", F.col("running_head.max_characters").alias("_max"))
    titles = elements.filter(F.col("role") == "title").select("doc_id", "idx", "content")
    first = titles.filter(F.expr(strip("content")) != "").groupBy("doc_id").agg(F.min("idx").alias("_first"))
    lines = titles.join(first, "doc_id").filter("idx >= _first").drop("_first")
    rank = F.row_number().over(Window.partitionBy("style_id", "doc_id").orderBy("idx"))
    lines = in_styles(lines, doc_styles, styles).withColumn("_n", rank).filter("_n <= _max")
    ordered = F.array_sort(F.collect_list(F.struct("idx", "content")))
    joined = F.array_join(F.transform(ordered, lambda r: r["content"]), " ")
    heads = lines.groupBy("style_id", "doc_id", "_max").agg(joined.alias("_title"))
    head = F.expr(f"left(upper({strip('_title')}), _max)")
    return heads.select("style_id", "doc_id", head.alias("running_head"))


def column_sections(elements: DataFrame, specs: DataFrame, doc_styles: DataFrame) -> DataFrame:
    """O-F9: for styles with columns, the section and column count of every paragraph."""
    styles = specs.filter("page_layout.columns > 1").select("style_id", F.col("page_layout.columns").alias("_columns"))
    marks = _document_marks(elements).select("doc_id", "front_idx")
    rows = elements.filter(F.col("type") == "paragraph").select("doc_id", "idx").join(marks, "doc_id")
    front = F.coalesce(F.col("idx") <= F.col("front_idx"), F.lit(False))
    section = F.when(F.col("front_idx").isNull() | front, 1).otherwise(2)
    df = in_styles(rows, doc_styles, styles)
    return df.select(
        "style_id",
        "doc_id",
        "idx",
        section.alias("section"),
        F.when(front, 1).otherwise(F.col("_columns")).alias("columns"),
    )


def reference_label_text(elements: DataFrame, specs: DataFrame, doc_styles: DataFrame) -> DataFrame:
    """O-F10: the label the style wants on the reference section."""
    styles = specs.select("style_id", F.col("references.section_label").alias("_label"))
    rows = _paragraphs(elements).filter(F.col("role") == "reference_label").select("doc_id", "idx", "text")
    df = in_styles(rows, doc_styles, styles)
    differs = F.lower("text") != F.lower("_label")
    return df.select(
        "style_id", "doc_id", "idx", F.col("text").alias("old_text"), F.when(differs, F.col("_label")).otherwise(F.col("text")).alias("new_text")
    )


def _flag(path: str, yes: str, no: str) -> str:
    return f"if({path}, '{yes}', '{no}')"


# Change descriptions by role, over the columns of a specification.
_ROLE_CHANGES = {
    "title": (
        "title_page",
        f"concat('Title: ', title_page.title.alignment, ', ', {_flag('title_page.title.bold', 'bold', 'plain')}, "
        "', ', title_page.title.font_size_pt, 'pt')",
        "title formatting",
    ),
    "author_info": (
        "title_page",
        "concat('Author info: ', title_page.author_name.alignment, ', ', title_page.author_name.font_size_pt, 'pt')",
        "author formatting",
    ),
    "abstract_label": (
        "abstract",
        f"concat('Abstract label: ', abstract.label_alignment, ', ', {_flag('abstract.label_bold', 'bold', 'plain')})",
        "abstract formatting",
    ),
    "abstract_body": (
        "abstract",
        "concat('Abstract body: ', default_typography.paragraph_alignment, ', no indent, ', "
        "default_typography.line_spacing, 'x spacing')",
        "abstract formatting",
    ),
    "keywords": (
        "abstract",
        f"concat('Keywords: ', {_flag('abstract.keywords_indent', 'indented 0.5\"', 'flush left')}, ', ', "
        f"{_flag('abstract.keywords_italic', 'italic prefix', 'plain prefix')})",
        "keywords formatting",
    ),
    "reference_label": (
        "references",
        "concat('\"', references.section_label, '\" label: ', references.label_alignment, ', ', "
        f"{_flag('references.label_bold', 'bold', 'plain')})",
        "reference list formatting",
    ),
    "table_caption": (
        "tables_figures",
        f"concat('Table caption formatted: ', tables.number_label, ' ', {_flag('tables.number_bold', 'bold', 'plain')}, "
        f"', title ', {_flag('tables.title_italic', 'italic', 'plain')})",
        "table formatting",
    ),
    "figure_caption": (
        "tables_figures",
        f"concat('Figure caption formatted: ', figures.number_label, ' ', {_flag('figures.number_bold', 'bold', 'plain')}, "
        f"', title ', {_flag('figures.title_italic', 'italic', 'plain')})",
        "figure formatting",
    ),
}

_CHANGE = ["style_id", "doc_id", "idx", "category", "description", "old_value", "new_value", "rule_reference", "status", "severity"]


def _changes(df: DataFrame, category, description, rule, idx="idx", old=None, new=None) -> DataFrame:
    null = F.lit(None).cast("string")
    return df.select(
        "style_id",
        "doc_id",
        (F.col(idx) if idx else F.lit(None)).cast("int").alias("idx"),
        (F.lit(category) if isinstance(category, str) else category).alias("category"),
        description.alias("description"),
        (null if old is None else old).alias("old_value"),
        (null if new is None else new).alias("new_value"),
        rule.alias("rule_reference"),
        F.lit("applied").alias("status"),
        F.lit("info").alias("severity"),
    )


def format_changes(
    elements: DataFrame, specs: DataFrame, doc_styles: DataFrame, max_rows: Limit = None
) -> DataFrame:
    """O-F11: what formatting changes: rows for single paragraphs, one summary row for body and
    references, and the document-wide settings."""
    name = F.col("style_name")
    by_role = [
        F.expr(f"struct('{role}' as role, '{cat}' as category, {text} as description, '{rule}' as rule)")
        for role, (cat, text, rule) in _ROLE_CHANGES.items()
    ]
    dim = specs.select("style_id", "style_name", F.inline(F.array(*by_role)))
    rule = F.concat(name, F.lit(" "), F.col("rule"))
    rows = _paragraphs(elements).filter(~_suppressed())
    single = in_styles(rows.select("doc_id", "idx", "role"), doc_styles, dim, "role")
    parts = [_changes(single, F.col("category"), F.col("description"), rule)]

    names = specs.select("style_id", "style_name")
    headings = heading_text(elements, specs, doc_styles, max_rows).join(names, "style_id")
    shown = F.when(
        F.col("new_text") != F.col("old_text"), F.concat(F.lit(" ["), F.substring("new_text", 1, 40), F.lit("]"))
    ).otherwise("")
    level = F.col("level").cast("string")
    parts.append(
        _changes(
            headings,
            "headings",
            F.concat(F.lit("Level "), level, F.lit(": "), F.col("description"), shown),
            F.concat(name, F.lit(" heading level "), level),
            old=F.col("old_text"),
            new=F.col("new_text"),
        )
    )

    counts = rows.groupBy("doc_id").agg(
        F.count_if(F.col("role") == "body").alias("n_body"),
        F.count_if(F.col("role") == "reference_entry").alias("n_refs"),
    )
    marks = _document_marks(elements)
    marks = marks.join(_body_start(elements, marks), "doc_id", "left").join(counts, "doc_id", "left")
    wide = in_styles(marks, doc_styles, specs)
    t = "default_typography"
    inch = "'\"'"
    whole = [
        (
            None,
            "page_layout",
            f"concat('Margins: ', page_layout.margin_top_inches, {inch}, ' T/B/L/R, page ', "
            f"page_layout.page_width_inches, {inch}, '×', page_layout.page_height_inches, {inch})",
            "page layout",
            f"concat(page_layout.margin_top_inches, {inch}, ' all sides')",
        ),
        (
            None,
            "typography",
            f"concat('Normal style → ', {t}.font_name, ' ', {t}.font_size_pt, 'pt, ', {t}.line_spacing, '× spacing')",
            "typography",
            f"concat({t}.font_name, ' ', {t}.font_size_pt, 'pt')",
        ),
        (
            "n_body > 0",
            "body",
            f"concat(n_body, ' body paragraphs formatted: ', {t}.font_name, ' ', {t}.font_size_pt, 'pt, ', "
            f"{t}.line_spacing, 'x spacing, ', {t}.first_line_indent_inches, {inch}, ' indent')",
            "body typography",
            None,
        ),
        (
            "n_refs > 0",
            "references",
            "concat(n_refs, ' reference entries formatted: ', if(references.hanging_indent_inches > 0, "
            f"concat('hanging indent ', references.hanging_indent_inches, {inch}), 'no indent'), ', ', "
            "references.line_spacing, 'x spacing')",
            "reference list formatting",
            None,
        ),
        (
            "not has_abstract_label and abstract_idx is not null",
            "abstract",
            "concat('Inserted \"', abstract.label, '\" label (', abstract.label_alignment, ', ', "
            "if(abstract.label_bold, 'bold', 'plain'), ')', if(title_page.required, ' on new page', ''))",
            "abstract formatting",
            None,
        ),
        (
            "not has_reference_label and reference_idx is not null",
            "references",
            "concat('Inserted \"', references.section_label, '\" label (', references.label_alignment, ', ', "
            "if(references.label_bold, 'bold', 'plain'), ') on new page')",
            "reference list formatting",
            None,
        ),
        (
            "title_page.required and body_idx is not null",
            "page_layout",
            "'Body text starts on new page (after abstract)'",
            "section breaks",
            None,
        ),
        (
            "not running_head.enabled",
            "page_layout",
            "'Page number added (top-right, every page)'",
            "page numbering",
            None,
        ),
        (
            "page_layout.columns > 1",
            "page_layout",
            "concat(page_layout.columns, '-column layout applied (single-column front matter → ', "
            "page_layout.columns, '-column body)')",
            "column layout",
            None,
        ),
    ]
    rows_of = F.array(
        *[
            F.expr(
                f"struct({when or 'true'} as applies, '{cat}' as category, {text} as description, "
                f"'{rule_name}' as rule, cast({new or 'null'} as string) as new_value)"
            )
            for when, cat, text, rule_name, new in whole
        ]
    )
    summary = wide.select("style_id", "style_name", "doc_id", F.inline(rows_of)).filter("applies")
    parts.append(_changes(summary, F.col("category"), F.col("description"), rule, None, new=F.col("new_value")))

    enabled = specs.filter("running_head.enabled").select("style_id", "style_name")
    heads = in_styles(elements.select("doc_id").distinct(), doc_styles, enabled)
    heads = heads.join(running_head(elements, specs, doc_styles), ["style_id", "doc_id"], "left")
    text = F.concat(F.lit('Running head: "'), F.coalesce("running_head", F.lit("")), F.lit('" + page number'))
    parts.append(_changes(heads, "running_head", text, F.concat(name, F.lit(" running head")), None))
    return reduce(DataFrame.unionByName, parts).select(*_CHANGE)


def font_violations(elements: DataFrame, specs: DataFrame, doc_styles: DataFrame) -> DataFrame:
    """O-F12: runs whose font or size is not the style's."""
    rows = runs_of(_paragraphs(elements).filter(~_suppressed()))
    runs = rows.select("doc_id", "idx", "role", F.posexplode("runs").alias("run_no", "run"))
    dim = role_format(specs).select(
        "style_id", "role", F.col("font_name").alias("want_font"), F.col("font_size_pt").alias("want_size")
    )
    font, size = F.col("run.font_name"), F.col("run.font_size_pt")
    wrong = ~font.eqNullSafe(F.col("want_font")) | ~size.eqNullSafe(F.col("want_size"))
    return (
        in_styles(runs, doc_styles, dim, "role")
        .filter(wrong)
        .select("style_id", "doc_id", "idx", "run_no", font.alias("font_name"), size.alias("font_size_pt"), "want_font", "want_size")
    )


def replace_reference_text(
    elements: DataFrame, bibliography: DataFrame, max_rows: Limit = None
) -> DataFrame:
    """O-F13: the nth reference entry takes the nth formatted text ``(doc_id, n, text)``, if not blank."""

    def rank(df, scan):
        return scan.running(df, _n=total(F.lit(1)))

    entries = elements.filter((F.col("role") == "reference_entry") & (F.col("type") == "paragraph"))
    ranked = over_documents(entries.select("doc_id", "idx"), rank, max_rows)
    texts = bibliography.select("doc_id", (F.col("n") + 1).alias("_n"), F.expr(strip("text")).alias("_text"))
    texts = ranked.join(texts.filter("_text <> ''"), ["doc_id", "_n"]).drop("_n")
    df = elements.join(texts, ["doc_id", "idx"], "left")
    content = F.coalesce("_text", "content").alias("content")
    return df.select(*[content if c == "content" else c for c in elements.columns])
