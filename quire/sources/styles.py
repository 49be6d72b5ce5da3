"""Style specifications as a table (O-S5): one row per style, nested like the JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK_STYLE = "apa7"
SECTIONS = (
    "page_layout",
    "default_typography",
    "title_page",
    "abstract",
    "headings",
    "running_head",
    "references",
    "tables",
    "figures",
    "in_text_citations",
)

# The leaves of a specification, their types and defaults.
_PAGE_LAYOUT = [
    ("margin_top_inches", "double", 1.0),
    ("margin_bottom_inches", "double", 1.0),
    ("margin_left_inches", "double", 1.0),
    ("margin_right_inches", "double", 1.0),
    ("page_width_inches", "double", 8.5),
    ("page_height_inches", "double", 11.0),
    ("orientation", "string", "portrait"),
    ("columns", "int", 1),
    ("column_spacing_inches", "double", 0.25),
]
_TYPOGRAPHY = [
    ("font_name", "string", "Times New Roman"),
    ("font_size_pt", "double", 12.0),
    ("line_spacing", "double", 2.0),
    ("line_spacing_type", "string", "double"),
    ("paragraph_alignment", "string", "left"),
    ("first_line_indent_inches", "double", 0.5),
    ("space_after_paragraph_pt", "double", 0.0),
    ("space_before_paragraph_pt", "double", 0.0),
]


def _title_element(bold: bool = False) -> list:
    return [
        ("font_size_pt", "double", 12.0),
        ("bold", "boolean", bold),
        ("italic", "boolean", False),
        ("alignment", "string", "center"),
        ("position", "string", None),
    ]


def _heading(alignment, italic, description, standalone=True, period=False) -> list:
    return [
        ("alignment", "string", alignment),
        ("bold", "boolean", True),
        ("italic", "boolean", italic),
        ("font_size_pt", "double", 12.0),
        ("case", "string", "title_case"),
        ("standalone_line", "boolean", standalone),
        ("ends_with_period", "boolean", period),
        ("indent_inches", "double", None),
        ("description", "string", description),
    ]


LEAVES = [
    ("style_name", "string", "APA 7th Edition"),
    ("style_id", "string", "apa7"),
    ("csl_style", "string", "apa"),
    ("page_layout", _PAGE_LAYOUT),
    ("default_typography", _TYPOGRAPHY),
    (
        "title_page",
        [
            ("required", "boolean", True),
            ("title", _title_element(bold=True)),
            ("author_name", _title_element()),
            ("affiliation", _title_element()),
            ("course_info", _title_element()),
            ("instructor", _title_element()),
            ("date", _title_element()),
        ],
    ),
    (
        "abstract",
        [
            ("label", "string", "Abstract"),
            ("label_bold", "boolean", True),
            ("label_alignment", "string", "center"),
            ("paragraph_indent", "boolean", False),
            ("max_words", "int", 250),
            ("keywords_label", "string", "Keywords:"),
            ("keywords_italic", "boolean", True),
            ("keywords_indent", "boolean", True),
        ],
    ),
    (
        "headings",
        [
            ("numbering_style", "string", "none"),
            ("level_1", _heading("center", False, "Centered, Bold, Title Case")),
            ("level_2", _heading("left", False, "Flush Left, Bold, Title Case")),
            ("level_3", _heading("left", True, "Flush Left, Bold Italic, Title Case")),
            (
                "level_4",
                _heading(
                    "indented", False, "Indented, Bold, Title Case, Period. Text on same line.",
                    standalone=False, period=True,
                ),
            ),
            (
                "level_5",
                _heading(
                    "indented", True, "Indented, Bold Italic, Title Case, Period. Text on same line.",
                    standalone=False, period=True,
                ),
            ),
        ],
    ),
    (
        "running_head",
        [
            ("enabled", "boolean", False),
            ("content", "string", "SHORTENED TITLE"),
            ("alignment", "string", "left"),
            ("page_number_alignment", "string", "right"),
            ("font_size_pt", "double", 12.0),
            ("all_caps", "boolean", True),
            ("max_characters", "int", 50),
        ],
    ),
    (
        "references",
        [
            ("section_label", "string", "References"),
            ("label_bold", "boolean", True),
            ("label_alignment", "string", "center"),
            ("entry_indent_type", "string", "hanging"),
            ("hanging_indent_inches", "double", 0.5),
            ("order", "string", "alphabetical_by_first_author"),
            ("line_spacing", "double", 2.0),
            ("csl_style_name", "string", "apa"),
        ],
    ),
    (
        "tables",
        [
            ("number_label", "string", "Table"),
            ("number_bold", "boolean", True),
            ("number_italic", "boolean", False),
            ("title_italic", "boolean", True),
            ("title_below_number", "boolean", True),
            ("note_prefix", "string", "Note."),
            ("note_italic_prefix", "boolean", True),
            ("horizontal_lines_only", "boolean", True),
        ],
    ),
    (
        "figures",
        [
            ("number_label", "string", "Figure"),
            ("number_bold", "boolean", True),
            ("number_italic", "boolean", True),
            ("title_italic", "boolean", True),
            ("title_below_number", "boolean", True),
            ("note_prefix", "string", "Note."),
            ("note_italic_prefix", "boolean", True),
        ],
    ),
    (
        "in_text_citations",
        [
            ("style", "string", "author-date"),
            ("parenthetical_format", "string", "(Author, Year)"),
            ("narrative_format", "string", "Author (Year)"),
            ("et_al_threshold", "int", 3),
            ("ampersand_in_parenthetical", "boolean", True),
            ("and_in_narrative", "boolean", True),
        ],
    ),
]


def _ddl(leaves: list) -> str:
    parts = []
    for name, *kind in leaves:
        inner = f"struct<{_ddl(kind[0])}>" if len(kind) == 1 else kind[0]
        parts.append(f"{name}:{inner}")
    return ",".join(parts)


SPEC = f"struct<{_ddl(LEAVES)}>"


def leaf_paths(leaves: list = LEAVES, prefix: str = "") -> list[tuple[str, str, object]]:
    """``(path, type, default)`` of every leaf."""
    out = []
    for name, *kind in leaves:
        if len(kind) == 1:
            out += leaf_paths(kind[0], f"{prefix}{name}.")
        else:
            out.append((prefix + name, kind[0], kind[1]))
    return out


def _filled(leaves: list, prefix: str) -> list:
    cols = []
    for name, *kind in leaves:
        path = prefix + name
        if len(kind) == 1:
            inner = F.struct(*_filled(kind[0], path + "."))
            cols.append(inner.alias(name))
        else:
            default = F.lit(kind[1]).cast(kind[0])
            cols.append(F.coalesce(F.col(path).cast(kind[0]), default).alias(name))
    return cols


def with_defaults(specs: DataFrame) -> DataFrame:
    """O-Y1: every missing leaf takes its default."""
    return specs.select(*_filled(LEAVES, ""))


def parse_specs(documents: DataFrame, column: str = "json") -> DataFrame:
    """Rows of JSON text to specifications with defaults."""
    return with_defaults(documents.select(F.from_json(column, SPEC).alias("s")).select("s.*"))


def read_style_specs(spark: SparkSession, path: str) -> DataFrame:
    """O-S5: specification files, one JSON document each."""
    return with_defaults(spark.read.schema(_schema()).json(path, multiLine=True))


def _schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(SPEC)


def builtin_style_specs(spark: SparkSession) -> DataFrame:
    """The five styles of this package."""
    from quire.sources.style_values import STYLE_DOCUMENTS

    return parse_specs(spark.createDataFrame([(d,) for d in STYLE_DOCUMENTS], "json string"))


def style_for(requests: DataFrame, specs: DataFrame) -> DataFrame:
    """Requests ``(…, style_id)`` with the specification; an unknown id falls back to apa7."""
    known = specs.select(F.col("style_id").alias("_known"))
    wanted = requests.join(known, F.col("style_id") == F.col("_known"), "left")
    resolved = F.coalesce("_known", F.lit(FALLBACK_STYLE))
    spec = specs.select("style_id", F.struct("*").alias("spec"))
    return (
        wanted.withColumn("resolved_style", resolved)
        .drop("_known")
        .join(
            spec.withColumnRenamed("style_id", "resolved_style"), "resolved_style"
        )
    )
