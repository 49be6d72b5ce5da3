"""Helpers shared by the corpus operators: lineage cuts, batch functions, label folds."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType, StructType

WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared checkpoint folder, so that later steps read files.

    The folder is the session's ``spark.checkpoint.dir``.  Only a session on one machine that
    names none gets a temporary folder of its own; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows, unless the session sets their size: rows are whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default
        spark.conf.set(name, "1000")


def map_batches(df: DataFrame, schema: str, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Apply a function of column lists to each Arrow batch of ``df``.

    ``start`` runs once per task and returns a function that takes one Python list per input
    column and returns one list or array per column of ``schema``.  Texts of a batch are the
    only rows held at a time.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                columns = step(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return df.mapInArrow(run, schema)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold -1, which nothing holds out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts, F.lit(-1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_function(returns: str, start: Callable[[], Callable[[list], list]]) -> Callable[[Column], Column]:
    """A scalar column function over lists of values; ``start`` runs once per task."""
    kind = to_arrow_type(DataType.fromDDL(returns))
    bound_batches(SparkSession.active())

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = start()
        for array in arrays:
            yield pa.array(step(array.to_pylist()), type=kind)

    return F.arrow_udf(run, returns)


KEYS = 1 << 30


def key_of(id_col: str) -> Column:
    """A pseudorandom key of an id, below ``KEYS``."""
    return F.pmod(F.xxhash64(id_col), F.lit(KEYS))


def low_keys(wanted: int, there: int) -> int:
    """A bound that about twice ``wanted`` of ``there`` keys lie below; all, if there are few."""
    return KEYS if there <= 4 * wanted or wanted < 1000 else 2 * wanted * KEYS // there


def labelled_sample(
    docs: DataFrame, labels: DataFrame, rows: int, label_col: str = "quality", where: Column | None = None
) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents, chosen by a hash of the id.

    The ids are chosen before texts are read; ``rows`` bounds what is broadcast.  Labels of one
    id that disagree count as the smallest; rows without an id or a label are left out.  Of rows
    that repeat an id the smallest text counts, so ``rows`` bounds the sample too.
    Ids are counted first, so that only about twice ``rows`` of them meet in one place.
    """
    ids = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    if where is not None:
        ids = ids.filter(where)
    ids = ids.groupBy("doc_id").agg(F.min("label").alias("label"))
    most = F.lit(low_keys(rows, ids.count()))
    chosen = ids.withColumn("key", key_of("doc_id")).filter(F.col("key") < most)
    chosen = chosen.orderBy("key", "doc_id").limit(rows).drop("key")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the rows' numbers from 1 in a total order, found without one task for all rows.

    Rows are sorted within ranges of the order and written once; the sizes of the ranges, one row
    each, give the number before each range.
    """
    low = 33  # bits of the number within a partition
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = cut(parts.withColumn("_at", F.monotonically_increasing_id()))
    sizes = parts.groupBy(F.shiftright("_at", low).alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("_part", before.alias("_before")))
    within = F.col("_at").bitwiseAND(F.lit((1 << low) - 1))
    placed = parts.withColumn("_part", F.shiftright("_at", low)).join(sizes, "_part")
    return placed.withColumn(name, F.col("_before") + within + 1).drop("_part", "_before", "_at")
