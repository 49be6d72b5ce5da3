"""Plain-text manuscripts (O-S1, O-S4, O-S6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.schemas import CELL, PARAGRAPH_FORMAT, RUN


def read_text_manuscripts(documents: DataFrame, text: str = "text", by_document: bool = False) -> DataFrame:
    """One element per line of ``documents(doc_id, text)``, in document order.

    ``by_document`` moves the whole texts to their document's partition before they are
    split into lines; ordered passes that follow then need no exchange of their own.
    """
    if by_document:
        documents = documents.select("doc_id", text).repartition("doc_id")
    lines = documents.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("idx", "content"))
    return from_lines(lines)


def from_lines(lines: DataFrame) -> DataFrame:
    """Elements from ``(doc_id, idx, content)`` rows."""
    null = F.lit(None)
    return lines.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("idx").cast("int").alias("idx"),
        F.format_string("elem_%04d", F.col("idx").cast("int") + 1).alias("elem_id"),
        F.lit("paragraph").alias("type"),
        F.lit("unknown").alias("role"),
        F.lit(0.0).alias("confidence"),
        "content",
        null.cast("string").alias("style_name"),
        null.cast(PARAGRAPH_FORMAT).alias("fmt"),
        null.cast(T.ArrayType(RUN)).alias("runs"),
        null.cast(T.ArrayType(T.ArrayType(CELL))).alias("cells"),
        null.cast("int").alias("figure_number"),
        null.cast("int").alias("table_number"),
    )


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Text files, one manuscript each; ``doc_id`` is a 64-bit hash of the file path."""
    files = spark.read.text(path, wholetext=True).select(
        F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text")
    )
    return read_text_manuscripts(files)


def manuscript_metadata(elements: DataFrame) -> DataFrame:
    """O-S4: paragraph, table and figure counts per document."""
    return elements.groupBy("doc_id").agg(
        F.count_if(F.col("type") == "paragraph").alias("total_paragraphs"),
        F.count_if(F.col("type") == "table").alias("total_tables"),
        F.coalesce(F.max("figure_number"), F.lit(0)).alias("total_figures"),
    )


def read_cells(elements: DataFrame) -> DataFrame:
    """O-S6: one row per table cell."""
    rows = elements.filter(F.col("type") == "table").select(
        "doc_id", "idx", F.posexplode("cells").alias("row", "line")
    )
    return rows.select("doc_id", "idx", "row", F.posexplode("line").alias("col", "cell")).select(
        "doc_id", "idx", "row", "col", "cell.text", "cell.bold"
    )


def table_rows(cells: DataFrame) -> DataFrame:
    """Cells put back together, one array of texts per table row."""
    ordered = F.array_sort(F.collect_list(F.struct("col", "text")))
    return cells.groupBy("doc_id", "idx", "row").agg(
        F.transform(ordered, lambda c: c["text"]).alias("texts")
    )
