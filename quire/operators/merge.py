"""Paragraph reconstruction (O-M1..M7): lines cut by format conversion become paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.functions.base import SPACES, strip
from quire.ordering import Limit, latest, long_documents, over_documents, reindex, total

# Roles whose consecutive lines may belong together, and thresholds.
MERGEABLE = ("body", "abstract_body", "title", "author_info", "keywords", "reference_entry", "figure_caption")
ALWAYS = ("title", "author_info", "keywords")
MIN_LINES, SHORT_LINE, SHORT_SHARE, MEDIAN_LIMIT = 20, 100, 0.60, 80
DEFAULT_MEDIAN, FULL_LINE_SHARE = 65.0, 0.82


def _lines(elements: DataFrame) -> DataFrame:
    return elements.filter(F.col("type") == "paragraph").withColumn("line", F.expr(strip("content")))


def _statistics() -> dict[str, Column]:
    n = F.when(F.col("line") != "", F.length("line"))
    return {
        "n_lines": F.count(n),
        "median_length": F.percentile(n, F.lit(0.5)),
        "n_short": F.count_if(n < SHORT_LINE),
        "median": F.percentile(F.when(n > 10, n), F.lit(0.5)),
    }


def _is_fragmented() -> Column:
    short = F.col("n_short") / F.col("n_lines") > SHORT_SHARE
    enough = F.col("n_lines") >= MIN_LINES
    return F.coalesce(enough & short & (F.col("median_length") < MEDIAN_LIMIT), F.lit(False))


def is_fragmented(elements: DataFrame) -> DataFrame:
    """O-M1: per document, whether most non-blank paragraphs are short lines."""
    aggs = [a.alias(n) for n, a in _statistics().items() if n != "median"]
    return _lines(elements).groupBy("doc_id").agg(*aggs).withColumn("fragmented", _is_fragmented())


def median_line_length(elements: DataFrame) -> DataFrame:
    """O-M2: median length of lines longer than 10, 65 where there are none."""
    return _lines(elements).groupBy("doc_id").agg(
        F.coalesce(_statistics()["median"], F.lit(DEFAULT_MEDIAN)).alias("median")
    )


def should_merge(prev: str, cur: str, role: str, median: str) -> Column:
    """O-M4: whether ``cur`` continues ``prev``; column names, both lines of the same role."""
    p, t, r = F.col(prev), F.col(cur), F.col(role)
    sentence_end = p.rlike(r"[.!?:;]\s*$")
    starts_entry = t.rlike(r"^\d{1,3}[.)]\s") | (
        t.rlike(r"^[A-Z][a-zà-ÿ]+[\s,]") & t.rlike(r"\(\d{4}")
    )
    short_end = (F.length(p) < F.col(median) * FULL_LINE_SHARE) & t.rlike(r"^\p{Lu}")
    prose = (
        F.when(p.rlike(r"-\s*$") | ~sentence_end | t.rlike("^[a-z]"), True)
        .when(P.looks_like_new_paragraph(cur) | short_end, False)
        .otherwise(True)
    )
    return (
        F.when(r.isin(*ALWAYS), True)
        .when(r == "reference_entry", ~starts_entry)
        .when(r == "figure_caption", ~P.is_figure_caption(cur))
        .otherwise(prose)
    )


def merge_groups(
    elements: DataFrame, force: bool = True, max_rows: Limit = None
) -> DataFrame:
    """O-M3: paragraphs with ``grp``; rows of one document with the same ``grp`` belong together.

    ``grp`` is null on rows that never merge; ``starts`` marks the first row of a group.
    With ``force=False`` only fragmented documents have groups.
    """
    keep, text = F.col("role").isin(*MERGEABLE), F.col("line")

    def group(df, scan):
        df = scan.grouped(df, **_statistics()).fillna(DEFAULT_MEDIAN, ["median"])
        member = keep & (text != "")
        # A blank row of a mergeable role is transparent inside body text only.
        breaks = ~keep
        df = scan.before(
            df,
            _last=latest(F.when(member, F.struct("role", F.col("line").alias("text")))),
        )
        prose = F.col("_last.role").isin("body", "abstract_body")
        breaks = breaks | (keep & (text == "") & ~F.coalesce(prose, F.lit(False)))
        df = scan.running(df, _breaks=total(breaks.cast("int")))
        df = scan.before(df, _break_then=latest(F.when(member, F.col("_breaks"))))
        df = df.withColumns({"_prev": F.col("_last.text")})
        joins = (
            member
            & (F.col("_break_then") == F.col("_breaks"))
            & (F.col("_last.role") == F.col("role"))
            & should_merge("_prev", "line", "role", "median")
        )
        starts = member & ~F.coalesce(joins, F.lit(False))
        df = scan.running(df.withColumn("_starts", starts), _grp=total(starts.cast("int")))
        merges = member if force else member & _is_fragmented()
        return df.withColumns({"grp": F.when(merges, F.col("_grp")), "starts": F.col("_starts")})

    out = over_documents(_lines(elements), group, max_rows)
    return out.select(*elements.columns, "line", "grp", "starts")


def _artifact_free(t: Column) -> Column:
    return F.btrim(F.translate(t, "\u200b\u200f\ufeff\u00ad", ""), F.expr(SPACES))


def join_fragments(texts: Column) -> Column:
    """O-M5: fold lines into one text; ``x-`` before a lower-case line loses its hyphen."""
    clean = F.filter(F.transform(texts, _artifact_free), lambda t: t != "")
    return F.aggregate(
        clean,
        F.lit(""),
        lambda acc, t: F.when(acc == "", t)
        .when(acc.endswith("-") & t.rlike(r"^\p{Ll}"), F.concat(_chop(acc), t))
        .otherwise(F.concat(acc, F.lit(" "), t)),
    )


def _chop(s: Column) -> Column:
    return F.substring(s, F.lit(1), F.length(s) - 1)


def apply_merge(groups: DataFrame) -> DataFrame:
    """O-M6: the first row of each group takes the joined text; the others are removed.

    ``groups`` is the result of ``merge_groups``.  The text is joined in two steps, first
    within stretches of 1,000 rows, so that a very long paragraph is not gathered line by
    line in one task.
    """
    columns = [c for c in groups.columns if c not in ("line", "grp", "starts")]
    # Rows outside any group are groups of their own.
    key = F.coalesce(F.col("grp"), -(F.col("idx") + 1)).alias("_key")
    stretch = F.floor(F.col("idx") / 1000).alias("_stretch")
    ordered = F.array_sort(F.collect_list(F.struct("idx", "line")))
    pieces = groups.groupBy("doc_id", key, stretch).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.struct(*columns), "idx").alias("_head"),
        join_fragments(F.transform(ordered, lambda r: r["line"])).alias("_text"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("_stretch", "_text")))
    merged = pieces.groupBy("doc_id", "_key").agg(
        F.sum("_n").alias("_n"),
        F.min_by("_head", "_stretch").alias("_head"),
        join_fragments(F.transform(ordered, lambda r: r["_text"])).alias("_text"),
    )
    content = F.when(F.col("_n") > 1, F.col("_text")).otherwise(F.col("_head.content")).alias("content")
    return merged.select(*[content if c == "content" else F.col(f"_head.{c}") for c in columns])


def merge_citations(citations: DataFrame, groups: DataFrame) -> DataFrame:
    """Citations moved to the first row of the group their row went into."""
    member = groups.filter("grp is not null")
    first = member.filter("starts").select("doc_id", "grp", F.col("idx").alias("_first"))
    target = member.select("doc_id", "idx", "grp").join(first, ["doc_id", "grp"]).drop("grp")
    moved = citations.join(target, ["doc_id", "idx"], "left")
    idx = F.coalesce("_first", "idx").alias("idx")
    return moved.select(*[idx if x == "idx" else x for x in citations.columns])


def merge(elements: DataFrame, force: bool = False, max_rows: Limit = None) -> DataFrame:
    """Fragmented documents (or all, with ``force``) merged and renumbered densely."""
    limit = long_documents(elements, max_rows)
    merged = apply_merge(merge_groups(elements, force, limit))
    return reindex(merged.unionByName(elements.filter(F.col("type") != "paragraph")), limit)
