"""DOCX manuscripts (O-S2, O-S3).

Files are read in parallel as binary rows; one small helper per file opens the archive
and emits one raw row per paragraph or table.  Everything after that - style and default
fonts, dominant formatting, figure numbers - is column work on the raw rows.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.base import SPACES
from quire.schemas import ELEMENTS, PARAGRAPH_FORMAT

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

_TEXT, _BOOL, _INT = pa.string(), pa.bool_(), pa.int32()
_RUN_TYPE = pa.struct(
    [
        ("text", _TEXT),
        ("bold", _BOOL),
        ("italic", _BOOL),
        ("underline", _BOOL),
        ("strike", _BOOL),
        ("font_name", _TEXT),
        ("half_points", _INT),
        ("color", _TEXT),
        ("superscript", _BOOL),
        ("subscript", _BOOL),
    ]
)
_CELL_TYPE = pa.struct([("text", _TEXT), ("bold", _BOOL)])
_RAW_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("filename", _TEXT),
        ("idx", _INT),
        ("type", _TEXT),
        ("style_name", _TEXT),
        ("style_font", _TEXT),
        ("style_half_points", _INT),
        ("default_font", _TEXT),
        ("default_half_points", _INT),
        ("alignment", _TEXT),
        ("line", _INT),
        ("line_rule", _TEXT),
        ("before", _INT),
        ("after", _INT),
        ("first_line", _INT),
        ("hanging", _INT),
        ("left_indent", _INT),
        ("right_indent", _INT),
        ("drawings", _INT),
        ("runs", pa.list_(_RUN_TYPE)),
        ("cells", pa.list_(pa.list_(_CELL_TYPE))),
    ]
)
RAW = (
    "doc_id bigint, filename string, idx int, type string, style_name string, style_font string, "
    "style_half_points int, default_font string, default_half_points int, alignment string, line int, "
    "line_rule string, before int, after int, first_line int, hanging int, left_indent int, "
    "right_indent int, drawings int, runs array<struct<text:string,bold:boolean,italic:boolean,"
    "underline:boolean,strike:boolean,font_name:string,half_points:int,color:string,"
    "superscript:boolean,subscript:boolean>>, cells array<array<struct<text:string,bold:boolean>>>"
)

_FLAG_OFF = ("0", "false", "off", "none")


def _val(node, tag: str, attr: str = "val"):
    child = None if node is None else node.find(_W + tag)
    return None if child is None else child.get(_W + attr)


def _int(value):
    try:
        return None if value is None else int(float(value))
    except ValueError:
        return None


def _flag(props, tag: str):
    child = None if props is None else props.find(_W + tag)
    return None if child is None else (child.get(_W + "val") or "1").lower() not in _FLAG_OFF


def _run_text(run) -> str:
    out = []
    for node in run:
        if node.tag == _W + "t":
            out.append(node.text or "")
        elif node.tag == _W + "tab":
            out.append("\t")
        elif node.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def _run(run) -> dict:
    props = run.find(_W + "rPr")
    vertical = _val(props, "vertAlign")
    return {
        "text": _run_text(run),
        "bold": _flag(props, "b"),
        "italic": _flag(props, "i"),
        "underline": _flag(props, "u"),
        "strike": _flag(props, "strike"),
        "font_name": _val(props, "rFonts", "ascii"),
        "half_points": _int(_val(props, "sz")),
        "color": _val(props, "color"),
        "superscript": None if vertical is None else vertical == "superscript",
        "subscript": None if vertical is None else vertical == "subscript",
    }


def _styles(archive: zipfile.ZipFile) -> dict:
    """Style id to (name, font, half points, is the default paragraph style)."""
    if "word/styles.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(archive.read("word/styles.xml"))
    own = {}
    for style in root.iter(_W + "style"):
        props = style.find(_W + "rPr")
        own[style.get(_W + "styleId")] = (
            _val(style, "name"),
            _val(props, "rFonts", "ascii"),
            _int(_val(props, "sz")),
            style.get(_W + "type") == "paragraph" and style.get(_W + "default") in ("1", "true"),
        )
    return own


def _paragraph(node, styles: dict, normal: str | None) -> dict:
    props = node.find(_W + "pPr")
    style_id = _val(props, "pStyle") or normal
    name, font, size, _ = styles.get(style_id, (None, None, None, False))
    runs = []
    for child in node:
        if child.tag == _W + "r":
            runs.append(_run(child))
        elif child.tag == _W + "hyperlink":
            runs += [_run(r) for r in child.findall(_W + "r")]
    return {
        "type": "paragraph",
        # The built-in names are stored in lower case and shown capitalised.
        "style_name": name[:1].upper() + name[1:] if name else name,
        "style_font": font,
        "style_half_points": size,
        "alignment": {"both": "justify", "start": "left", "end": "right"}.get(_val(props, "jc"), _val(props, "jc")),
        "line": _int(_val(props, "spacing", "line")),
        "line_rule": _val(props, "spacing", "lineRule"),
        "before": _int(_val(props, "spacing", "before")),
        "after": _int(_val(props, "spacing", "after")),
        "first_line": _int(_val(props, "ind", "firstLine")),
        "hanging": _int(_val(props, "ind", "hanging")),
        "left_indent": _int(_val(props, "ind", "left") or _val(props, "ind", "start")),
        "right_indent": _int(_val(props, "ind", "right") or _val(props, "ind", "end")),
        "drawings": len(list(node.iter(_W + "drawing"))),
        "runs": runs,
        "cells": None,
    }


def _table(node) -> dict:
    rows = []
    for tr in node.findall(_W + "tr"):
        cells = []
        for tc in tr.findall(_W + "tc"):
            paragraphs = [[_run(r) for r in p.iter(_W + "r")] for p in tc.findall(_W + "p")]
            text = "\n".join("".join(r["text"] for r in runs) for runs in paragraphs)
            bold = paragraphs[0][0]["bold"] if paragraphs and paragraphs[0] else None
            cells.append({"text": text.strip(), "bold": bold})
        rows.append(cells)
    return {"type": "table", "drawings": 0, "runs": None, "cells": rows}


def _read_one(doc_id: int, path: str, content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        styles = _styles(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(_W + "body")
    normal = next((k for k, v in styles.items() if v[3]), None)
    _, font, size, _ = styles.get(normal, (None, None, None, False))
    rows = []
    for child in body:
        if child.tag == _W + "p":
            rows.append(_paragraph(child, styles, normal))
        elif child.tag == _W + "tbl":
            rows.append(_table(child))
    shared = {
        "doc_id": doc_id,
        "filename": path.rsplit("/", 1)[-1],
        "default_font": font,
        "default_half_points": size,
    }
    return [{**row, **shared, "idx": i} for i, row in enumerate(rows)]


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):  # one archive at a time
            file = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
            try:
                rows = _read_one(file["doc_id"], file["path"], file["content"])
            except (zipfile.BadZipFile, zlib.error, KeyError, ElementTree.ParseError, TypeError) as why:
                rows = [_unreadable(file["doc_id"], file["path"], why)]
            yield pa.RecordBatch.from_pylist(rows, schema=_RAW_ARROW)


def _unreadable(doc_id: int, path: str, why: Exception) -> dict:
    """The row of a file that is no readable document: type ``error`` with the reason as its text."""
    text = {"text": f"{type(why).__name__}: {why}"}
    return {"doc_id": doc_id, "filename": path.rsplit("/", 1)[-1], "idx": 0, "type": "error", "drawings": 0, "runs": [text]}


def read_docx_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of every DOCX file under ``path``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.docx")
        .load(path)
        .select(F.xxhash64("path").alias("doc_id"), "path", "content")
    )
    return files.mapInArrow(_read_files, RAW)


def _points(half_points: Column) -> Column:
    return half_points / 2


def resolve_fonts(raw: DataFrame) -> DataFrame:
    """O-S3: run font and size, else the style's, else the document default's."""

    def one(r: Column) -> Column:
        return F.struct(
            r["text"].alias("text"),
            r["bold"].alias("bold"),
            r["italic"].alias("italic"),
            r["underline"].alias("underline"),
            r["strike"].alias("strike"),
            F.coalesce(r["font_name"], F.col("style_font"), F.col("default_font")).alias("font_name"),
            _points(F.coalesce(r["half_points"], F.col("style_half_points"), F.col("default_half_points"))).alias(
                "font_size_pt"
            ),
            r["color"].alias("color"),
            r["superscript"].alias("superscript"),
            r["subscript"].alias("subscript"),
        )

    return raw.withColumn("runs", F.transform("runs", one))


def to_elements(raw: DataFrame) -> DataFrame:
    """Raw rows to the element schema; the first text-bearing value is dominant."""
    df = resolve_fonts(raw)
    inked = F.filter("runs", lambda r: F.btrim(r["text"], F.expr(SPACES)) != "")

    def dominant(field: str) -> Column:
        return F.get(F.filter(F.transform(inked, lambda r: r[field]), lambda v: v.isNotNull()), F.lit(0))

    def inches(twips: Column) -> Column:
        return F.bround(twips / 1440, 3)

    spacing = F.when(F.coalesce("line_rule", F.lit("auto")) == "auto", F.col("line") / 240).otherwise(
        F.col("line") * 635.0
    )
    given = {
        "font_name": dominant("font_name"),
        "font_size_pt": dominant("font_size_pt"),
        "bold": dominant("bold"),
        "italic": dominant("italic"),
        "alignment": F.when(F.col("alignment").isin("left", "center", "right", "justify"), F.col("alignment")),
        "line_spacing": spacing,
        "line_spacing_rule": F.when(F.col("line").isNotNull(), F.coalesce("line_rule", F.lit("auto"))),
        "space_before_pt": F.bround(F.col("before") / 20, 1),
        "space_after_pt": F.bround(F.col("after") / 20, 1),
        "first_line_indent_inches": inches(F.coalesce(F.col("first_line"), -F.col("hanging"))),
        "left_indent_inches": inches(F.col("left_indent")),
        "right_indent_inches": inches(F.col("right_indent")),
    }
    fmt = F.struct(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PARAGRAPH_FORMAT.fields]
    )
    paragraph, table, failed = (F.col("type") == kind for kind in ("paragraph", "table", "error"))
    # A file is one archive read whole, so its rows are bounded by it.
    so_far = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    cols = {
        "elem_id": F.format_string("elem_%04d", F.col("idx") + 1),
        "role": F.when(paragraph | failed, "unknown").otherwise("table"),
        "confidence": F.lit(0.0),
        "content": F.when(paragraph | failed, F.array_join(F.transform("runs", lambda r: r["text"]), "")).otherwise(""),
        "fmt": F.when(paragraph, fmt),
        "figure_number": F.when(F.col("drawings") > 0, F.sum("drawings").over(so_far)),
        "table_number": F.when(table, F.sum(table.cast("int")).over(so_far)),
    }
    return df.select(
        *[cols.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in ELEMENTS.fields]
    )


def read_docx_corpus(spark: SparkSession, path: str) -> DataFrame:
    """O-S2: paragraphs and tables of every DOCX file, in document order."""
    return to_elements(read_docx_raw(spark, path))
