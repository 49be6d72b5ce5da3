"""Ordered passes over the rows of each document.

A pass is written once, against the small interface below, and runs in one of
two ways:

* ``WindowScan`` - one window partition per document.  One exchange on
  ``doc_id`` serves every pass that follows.
* ``BlockScan`` - for callers that know of documents too long for one task and say so.  Rows are grouped into
  blocks of ``(doc_id, idx div block_rows)``; each block is summarised to one
  row, the summaries are scanned per document, and the carried value is joined
  back on the block key, so no task ever holds a whole document.

Operators use the window form unless they are given a row limit or the ids of the long
documents; windows stream and spill, so a long document costs time, not memory.  With a
limit ``over_documents`` writes its input once before it branches, so that chained passes
do not repeat each other's work or plans.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOC, IDX = "doc_id", "idx"
BLOCK_ROWS = 100_000

Agg = tuple[str, Column]


def least(x: Column) -> Agg:
    return ("min", x)


def greatest(x: Column) -> Agg:
    return ("max", x)


def total(x: Column) -> Agg:
    return ("sum", x)


def latest(x: Column) -> Agg:
    """Last non-null value in document order."""
    return ("last", x)


_PLAIN = {"min": F.min, "max": F.max, "sum": F.sum}


class WindowScan:
    """Every document is one window partition."""

    def _w(self):
        return Window.partitionBy(DOC).orderBy(IDX)

    def _apply(self, df: DataFrame, frame, aggs: dict[str, Agg]) -> DataFrame:
        cols = {}
        for name, (kind, x) in aggs.items():
            cols[name] = F.last(x, True).over(frame) if kind == "last" else _PLAIN[kind](x).over(frame)
        return df.withColumns(cols)

    def whole(self, df: DataFrame, **aggs: Agg) -> DataFrame:
        """Aggregate over the whole document."""
        return self._apply(
            df, self._w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), aggs
        )

    def running(self, df: DataFrame, **aggs: Agg) -> DataFrame:
        """Aggregate over the rows up to and including this one."""
        return self._apply(df, self._w().rowsBetween(Window.unboundedPreceding, 0), aggs)

    def before(self, df: DataFrame, **aggs: Agg) -> DataFrame:
        """Aggregate over the rows strictly before this one."""
        return self._apply(df, self._w().rowsBetween(Window.unboundedPreceding, -1), aggs)

    def both(self, df: DataFrame, whole: dict[str, Agg], running: dict[str, Agg]) -> DataFrame:
        """``whole`` and ``running`` aggregates of the same rows, in one pass."""
        cols = {}
        for aggs, end in ((whole, Window.unboundedFollowing), (running, 0)):
            frame = self._w().rowsBetween(Window.unboundedPreceding, end)
            for name, (kind, x) in aggs.items():
                cols[name] = F.last(x, True).over(frame) if kind == "last" else _PLAIN[kind](x).over(frame)
        return df.withColumns(cols)

    def grouped(self, df: DataFrame, **aggs: Column) -> DataFrame:
        """Any aggregate functions over the whole document."""
        frame = self._w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns({name: agg.over(frame) for name, agg in aggs.items()})


class BlockScan:
    """Documents are cut into blocks of rows; only block summaries meet."""

    def __init__(self, block_rows: int = BLOCK_ROWS):
        self.block_rows = block_rows

    def _blocked(self, df: DataFrame) -> DataFrame:
        # The rows are read twice (summary and join), so the lineage is cut first.
        return checkpoint(df).withColumn("_block", F.floor(F.col(IDX) / self.block_rows).cast("long"))

    def _summary(self, df: DataFrame, aggs: dict[str, Agg]) -> DataFrame:
        outs = []
        for name, (kind, x) in aggs.items():
            if kind == "last":
                x = F.when(x.isNotNull(), F.struct(F.col(IDX).alias("i"), x.alias("v")))
                outs.append(F.max(x).alias(f"_s_{name}"))
            else:
                outs.append(_PLAIN[kind](x).alias(f"_s_{name}"))
        return df.groupBy(DOC, "_block").agg(*outs)

    @staticmethod
    def _over(kind: str, name: str, frame) -> Column:
        col = F.col(f"_s_{name}")
        if kind == "last":
            return F.max(col).over(frame)["v"]
        return _PLAIN[kind](col).over(frame)

    def whole(self, df: DataFrame, **aggs: Agg) -> DataFrame:
        rows = self._blocked(df)
        frame = Window.partitionBy(DOC)
        carry = self._summary(rows, aggs).select(
            DOC, "_block", *[self._over(k, n, frame).alias(n) for n, (k, _) in aggs.items()]
        )
        return rows.join(carry, [DOC, "_block"]).drop("_block")

    def grouped(self, df: DataFrame, **aggs: Column) -> DataFrame:
        rows = checkpoint(df)
        return rows.join(rows.groupBy(DOC).agg(*[a.alias(n) for n, a in aggs.items()]), DOC)

    def running(self, df: DataFrame, **aggs: Agg) -> DataFrame:
        return self._prefix(df, aggs, 0)

    def both(self, df: DataFrame, whole: dict[str, Agg], running: dict[str, Agg]) -> DataFrame:
        return self.whole(self.running(df, **running), **whole)

    def before(self, df: DataFrame, **aggs: Agg) -> DataFrame:
        return self._prefix(df, aggs, -1)

    def _prefix(self, df: DataFrame, aggs: dict[str, Agg], end: int) -> DataFrame:
        rows = self._blocked(df)
        earlier = Window.partitionBy(DOC).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carry = self._summary(rows, aggs).select(
            DOC, "_block", *[self._over(k, n, earlier).alias(f"_c_{n}") for n, (k, _) in aggs.items()]
        )
        local = (
            Window.partitionBy(DOC, "_block").orderBy(IDX).rowsBetween(Window.unboundedPreceding, end)
        )
        out = {}
        for name, (kind, x) in aggs.items():
            c = F.col(f"_c_{name}")
            if kind == "last":
                out[name] = F.coalesce(F.last(x, True).over(local), c)
            elif kind == "sum":
                here = F.sum(x).over(local)
                out[name] = F.when(
                    here.isNotNull() | c.isNotNull(),
                    F.coalesce(here, F.lit(0)) + F.coalesce(c, F.lit(0)),
                )
            else:
                here = _PLAIN[kind](x).over(local)
                out[name] = (F.least if kind == "min" else F.greatest)(here, c)
        joined = rows.join(carry, [DOC, "_block"]).withColumns(out)
        return joined.drop("_block", *[f"_c_{n}" for n in aggs])


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the cluster's checkpoint folder.

    A session on one machine without that setting gets a temporary folder until it ends.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            folder = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


Pass = Callable[[DataFrame, "WindowScan | BlockScan"], DataFrame]


# How a caller bounds documents: None if every document fits one task, a row limit to check,
# or the table of long documents that an earlier check found.
Limit = int | None | DataFrame


def long_documents(rows: DataFrame, max_rows: Limit) -> DataFrame | None:
    """The ids of documents of more than ``max_rows`` rows, written once, or None.

    Row counts are pre-aggregated before they are shuffled.  A job that runs several
    ordered passes checks its source once and hands the answer on.
    """
    if max_rows is None or isinstance(max_rows, DataFrame):
        return max_rows
    counts = rows.groupBy(DOC).agg(F.count(F.lit(1)).alias("n"))
    return checkpoint(counts.filter(F.col("n") > max_rows).select(DOC))


def over_documents(
    elements: DataFrame, ordered_pass: Pass, max_rows: Limit = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Run ``ordered_pass`` over every document, the long ones of a given limit block by block."""
    if max_rows is None:
        return ordered_pass(elements, WindowScan())
    elements = checkpoint(elements)
    long_docs = long_documents(elements, max_rows)
    short = ordered_pass(elements.join(long_docs, DOC, "left_anti"), WindowScan())
    long = ordered_pass(elements.join(long_docs, DOC, "left_semi"), BlockScan(block_rows))
    return short.unionByName(long)


def reindex(elements: DataFrame, max_rows: Limit = None) -> DataFrame:
    """Renumber ``idx`` densely from 0 within each document (O-M7)."""

    def number(df, scan):
        ranked = scan.running(df, _rank=total(F.lit(1)))
        return ranked.withColumn(IDX, (F.col("_rank") - 1).cast("int")).drop("_rank")

    return over_documents(elements, number, max_rows)
