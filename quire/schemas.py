"""Table schemas and enumerations of the manuscript model."""

from __future__ import annotations

from pyspark.sql import types as T

# Element types.
ELEMENT_TYPES = ("paragraph", "table", "image", "page_break", "section_break")

# Element roles.
ROLES = (
    "title",
    "author_info",
    "abstract_label",
    "abstract_body",
    "keywords",
    "heading_1",
    "heading_2",
    "heading_3",
    "heading_4",
    "heading_5",
    "body",
    "block_quote",
    "reference_label",
    "reference_entry",
    "table_caption",
    "figure_caption",
    "table",
    "figure",
    "appendix",
    "unknown",
)

HEADING_ROLES = ("heading_1", "heading_2", "heading_3", "heading_4", "heading_5")
SECTION_ROLES = (*HEADING_ROLES, "reference_label", "abstract_label", "appendix")

RUN = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("bold", T.BooleanType()),
        T.StructField("italic", T.BooleanType()),
        T.StructField("underline", T.BooleanType()),
        T.StructField("strike", T.BooleanType()),
        T.StructField("font_name", T.StringType()),
        T.StructField("font_size_pt", T.DoubleType()),
        T.StructField("color", T.StringType()),
        T.StructField("superscript", T.BooleanType()),
        T.StructField("subscript", T.BooleanType()),
    ]
)

PARAGRAPH_FORMAT = T.StructType(
    [
        T.StructField("font_name", T.StringType()),
        T.StructField("font_size_pt", T.DoubleType()),
        T.StructField("bold", T.BooleanType()),
        T.StructField("italic", T.BooleanType()),
        T.StructField("alignment", T.StringType()),
        T.StructField("line_spacing", T.DoubleType()),
        T.StructField("line_spacing_rule", T.StringType()),
        T.StructField("space_before_pt", T.DoubleType()),
        T.StructField("space_after_pt", T.DoubleType()),
        T.StructField("first_line_indent_inches", T.DoubleType()),
        T.StructField("left_indent_inches", T.DoubleType()),
        T.StructField("right_indent_inches", T.DoubleType()),
        T.StructField("keep_together", T.BooleanType()),
        T.StructField("keep_with_next", T.BooleanType()),
        T.StructField("widow_control", T.BooleanType()),
    ]
)

CELL = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("bold", T.BooleanType())]
)

ELEMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType(), False),
        T.StructField("idx", T.IntegerType(), False),
        T.StructField("elem_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("content", T.StringType()),
        T.StructField("style_name", T.StringType()),
        T.StructField("fmt", PARAGRAPH_FORMAT),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("cells", T.ArrayType(T.ArrayType(CELL))),
        T.StructField("figure_number", T.IntegerType()),
        T.StructField("table_number", T.IntegerType()),
    ]
)

AUTHOR = "struct<family:string,given:string>"

REFERENCE = (
    f"struct<authors:array<{AUTHOR}>,year:string,title:string,container_title:string,"
    "volume:string,issue:string,pages:string,doi:string,url:string,publisher:string,"
    "edition:string,ref_type:string,original_number:int>"
)
