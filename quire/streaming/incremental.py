"""Arriving manuscripts, analysed once each (O-X1)."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.plans.pipeline import Analysis, analyse
from quire.sources.styles import builtin_style_specs
from quire.sources.text import read_text_manuscripts

TABLES = tuple(f.name for f in fields(Analysis))
_DONE = "_batches"


def incremental_pipeline(
    documents: DataFrame,
    output: str,
    checkpoint: str,
    specs: DataFrame | None = None,
    doc_styles: DataFrame | None = None,
    tables: tuple[str, ...] = TABLES,
    available_now: bool = True,
) -> StreamingQuery:
    """A stream of ``(doc_id, text)`` rows to all result tables under ``output``.

    The ids that have arrived are keyed state of the stream, so a document is analysed in the batch
    of its first arrival and in no other, also after a restart from ``checkpoint``.  Each batch
    writes every table to the folder of its own number and replaces it if the batch is repeated;
    a batch is named as done when all its tables are there, and ``result_table`` reads no other.
    Documents without a row in ``doc_styles`` are set in apa7.
    """
    names = [n for n in TABLES if n in tables]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        styles = spark.createDataFrame([], "doc_id bigint, style_id string") if doc_styles is None else doc_styles
        # A batch is read by several tables; the arrivals it stands for are fixed once.
        arrived = batch.select("doc_id", "text").persist()
        rules = builtin_style_specs(spark) if specs is None else specs
        found = analyse(read_text_manuscripts(arrived, by_document=True), rules, styles, tables=tables)
        for name in names:
            getattr(found, name).write.mode("overwrite").parquet(f"{output}/{name}/batch={batch_id}")
        done = spark.range(1).select(F.lit(batch_id).cast("bigint").alias("done"))
        done.write.mode("overwrite").parquet(f"{output}/{_DONE}/batch={batch_id}")
        for df in (arrived, found.elements, found.citations, found.references):
            df.unpersist()

    first = documents.dropDuplicates(["doc_id"])
    writer = first.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def result_table(spark: SparkSession, output: str, name: str) -> DataFrame:
    """One result table of all batches that are done."""
    done = spark.read.parquet(f"{output}/{_DONE}").select(F.col("done").alias("batch"))
    rows = spark.read.parquet(f"{output}/{name}").withColumn("batch", F.col("batch").cast("bigint"))
    return rows.join(F.broadcast(done), "batch", "left_semi").drop("batch")
