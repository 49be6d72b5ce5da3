"""Batch edits of element tables (O-E1..E15): each takes a table of edits keyed ``(doc_id, idx)``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.predicates import search_text as _contains
from quire.functions.text import word_count
from quire.operators.formatting import runs_of
from quire.ordering import Limit, reindex
from quire.schemas import CELL

NORMAL = "Normal"
ALIGNMENTS = ("left", "center", "right", "justify")
RUN_FLAGS = ("bold", "italic", "underline", "strike", "font_name", "font_size_pt", "color")


def _style() -> Column:
    return F.coalesce("style_name", F.lit(NORMAL))


def _is_paragraph() -> Column:
    return F.col("type") == "paragraph"


# --- reading ------------------------------------------------------------------------


def list_documents(manuscripts: DataFrame) -> DataFrame:
    """O-E1: names and sizes, by name."""
    return manuscripts.select("doc_id", "filename", "size_bytes").orderBy("filename", "doc_id")


def document_info(elements: DataFrame) -> DataFrame:
    """O-E2: paragraph, word and table counts and the styles used."""
    para = _is_paragraph()
    return elements.groupBy("doc_id").agg(
        F.count_if(para).alias("paragraph_count"),
        F.sum(F.when(para, word_count("content")).otherwise(0)).alias("word_count"),
        F.count_if(F.col("type") == "table").alias("table_count"),
        F.array_sort(F.collect_set(F.when(para, _style()))).alias("styles_used"),
    )


def read_page(elements: DataFrame, start: int = 0, limit: int = 30) -> DataFrame:
    """O-E3: rows ``start`` to ``start + limit`` of every document, with the total and ``has_more``."""
    totals = elements.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_paragraphs"))
    page = elements.filter(F.col("idx").between(start, start + limit - 1))
    return page.join(totals, "doc_id").select(
        "doc_id",
        "idx",
        F.col("content").alias("text"),
        _style().alias("style"),
        "total_paragraphs",
        (F.col("total_paragraphs") > start + limit).alias("has_more"),
    )


def read_paragraph(elements: DataFrame, idx: int) -> DataFrame:
    """O-E4: row ``idx`` of every document that has one."""
    align = F.coalesce("fmt.alignment", F.lit("left"))
    return elements.filter(F.col("idx") == idx).select(
        "doc_id", "idx", _style().alias("style"), F.col("content").alias("text"), align.alias("alignment")
    )


def search_text(elements: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """O-P7 over a table: paragraphs that contain ``query``."""
    literal = "'" + query.replace("\\", "\\\\").replace("'", "\\'") + "'"
    hit = _contains("content", literal, str(case_sensitive).lower())
    return elements.filter(_is_paragraph() & hit).select(
        "doc_id", "idx", _style().alias("style"), F.col("content").alias("text")
    )


def snapshot(elements: DataFrame, last: int = 5, chars: int = 200) -> DataFrame:
    """O-E5: counts and the ``last`` rows, ``chars`` characters each."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("idx")))
    tail = elements.select("doc_id", "idx", _style().alias("style"), F.substring("content", 1, chars).alias("text"))
    tail = tail.withColumn("_n", rank).filter(F.col("_n") <= last)
    rows = tail.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "style", "text"))).alias("last_paragraphs")
    )
    return document_info(elements).drop("styles_used").join(rows, "doc_id")


# --- text edits ---------------------------------------------------------------------


def _last(edits: DataFrame, *values: str) -> DataFrame:
    """One row per (doc_id, idx): of each value the last that is given.

    Later means a larger ``seq``, if the edits have one, and then the larger value.
    """
    order = [F.col("seq")] if "seq" in edits.columns else []
    last = [F.max(F.when(F.col(v).isNotNull(), F.struct(*order, F.col(v).alias("v"))))["v"].alias(v) for v in values]
    return edits.groupBy("doc_id", "idx").agg(*last)


def search_and_replace(elements: DataFrame, find: str, replace: str, case_sensitive: bool = False) -> DataFrame:
    """O-E6: replace inside runs; ``n_replaced`` counts runs if case-sensitive, else occurrences."""
    f = F.lit(find)
    if case_sensitive:
        new = lambda t: F.replace(t, f, F.lit(replace))
        count = lambda t: F.contains(t, f).cast("int")
    else:
        pattern = "(?iu)" + "".join(c if c.isalnum() else "\\" + c for c in find)
        safe = re.sub(r"([\\$])", r"\\\1", replace)
        new = lambda t: F.regexp_replace(t, pattern, safe)
        count = lambda t: F.regexp_count(t, F.lit(pattern))
    filled = runs_of(elements)
    hits = F.when(
        _is_paragraph(), F.aggregate("runs", F.lit(0), lambda acc, r: acc + F.coalesce(count(r["text"]), F.lit(0)))
    ).otherwise(0)
    df = filled.withColumn("n_replaced", hits)
    changed = F.transform("runs", lambda r: r.withField("text", new(r["text"])))
    df = df.withColumn("runs", F.when(F.col("n_replaced") > 0, changed).otherwise(F.col("runs")))
    joined = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    return df.withColumn("content", F.when(F.col("n_replaced") > 0, joined).otherwise(F.col("content")))


def _with_text(runs: Column, text: Column) -> Column:
    return F.transform(runs, lambda r, i: r.withField("text", F.when(i == 0, text).otherwise(F.lit(""))))


def edit_text(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """O-E7: ``edits(doc_id, idx, new_text[, seq])``; the first run takes the text, later runs are emptied.

    Of several edits of one row the last counts.
    """
    df = elements.join(_last(edits, "new_text"), ["doc_id", "idx"], "left")
    hit = F.col("new_text").isNotNull()
    df = df.withColumns(
        {
            "content": F.coalesce("new_text", "content"),
            "runs": F.when(hit, _with_text(F.col("runs"), F.col("new_text"))).otherwise(F.col("runs")),
        }
    )
    return df.select(*elements.columns)


def _rows_like(elements: DataFrame, rows: DataFrame, **given: Column) -> DataFrame:
    """New element rows with their ``_nth``: given columns, paragraph defaults, nulls elsewhere."""
    fixed = {
        "type": F.lit("paragraph"),
        "role": F.lit("unknown"),
        "confidence": F.lit(0.0),
        "content": F.lit(""),
        **given,
    }
    cols = []
    for f in elements.schema.fields:
        c = fixed.get(f.name, F.col("doc_id") if f.name == "doc_id" else F.lit(None))
        cols.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*cols, fixed.get("_nth", F.lit(1)).cast("bigint").alias("_nth"))


def _insert(elements: DataFrame, rows: DataFrame, max_rows: Limit) -> DataFrame:
    """``rows`` put in after the row ``idx``, in the order of ``_nth``: places are exact decimals."""
    both = elements.withColumn("_nth", F.lit(0).cast("bigint")).unionByName(rows)
    place = F.concat(F.col("idx").cast("string"), F.lit("."), F.lpad(F.col("_nth").cast("string"), 18, "0"))
    return reindex(both.withColumn("idx", place.cast("decimal(38,18)")).drop("_nth"), max_rows)


def _ranked(edits: DataFrame, *keys: str) -> DataFrame:
    """Edits with ``_rank`` from 0 within their keys: by ``seq``, if there is one, then by their values."""
    rest = sorted(c for c in edits.columns if c not in (*keys, "seq"))
    order = [*(["seq"] if "seq" in edits.columns else []), *rest] or list(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return edits.withColumn("_rank", rank)


def insert_after(elements: DataFrame, edits: DataFrame, max_rows: Limit = None) -> DataFrame:
    """O-E8: ``edits(doc_id, idx, text, style[, seq])`` put after existing rows."""
    known = edits.join(elements.select("doc_id", "idx"), ["doc_id", "idx"], "left_semi")
    known = _ranked(known, "doc_id", "idx")
    rows = _rows_like(
        elements, known, idx=F.col("idx"), _nth=F.col("_rank") + 1, content=F.col("text"), style_name=F.col("style")
    )
    return _insert(elements, rows, max_rows)


def _ends(elements: DataFrame) -> DataFrame:
    return elements.groupBy("doc_id").agg(F.max("idx").alias("_last"))


def append_paragraphs(elements: DataFrame, edits: DataFrame, max_rows: Limit = None) -> DataFrame:
    """O-E8: ``edits(doc_id, text, style[, seq])`` at the end."""
    at = _ranked(edits, "doc_id").join(_ends(elements), "doc_id")
    rows = _rows_like(
        elements, at, idx=F.col("_last"), _nth=F.col("_rank") + 1, content=F.col("text"), style_name=F.coalesce("style", F.lit(NORMAL))
    )
    return _insert(elements, rows, max_rows)


def append_headings(elements: DataFrame, edits: DataFrame, max_rows: Limit = None) -> DataFrame:
    """O-E8: ``edits(doc_id, text, level[, seq])``; levels 1 to 4."""
    ok = edits.filter(F.col("level").between(1, 4))
    style = F.concat(F.lit("Heading "), F.col("level").cast("string"))
    return append_paragraphs(elements, ok.withColumn("style", style), max_rows)


def append_page_breaks(elements: DataFrame, edits: DataFrame, max_rows: Limit = None) -> DataFrame:
    """O-E8: a page break at the end of the document for every row of ``edits(doc_id)``."""
    at = _ranked(edits.select("doc_id"), "doc_id").join(_ends(elements), "doc_id")
    rows = _rows_like(
        elements, at, idx=F.col("_last"), _nth=F.col("_rank") + 1, type=F.lit("page_break"), style_name=F.lit(NORMAL)
    )
    return _insert(elements, rows, max_rows)


def append_list(
    elements: DataFrame, edits: DataFrame, numbered: bool = False, max_rows: Limit = None
) -> DataFrame:
    """O-E9: ``edits(doc_id, items)`` with a JSON array of strings; other JSON adds nothing."""
    style = "List Number" if numbered else "List Bullet"
    ranked = _ranked(edits, "doc_id")
    listed = ranked.withColumn("_items", F.from_json("items", "array<string>"))
    before = Window.partitionBy("doc_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumn("_before", F.coalesce(F.sum(F.greatest(F.size("_items"), F.lit(0))).over(before), F.lit(0)))
    items = listed.select("doc_id", "_before", F.posexplode("_items").alias("_n", "_item"))
    at = items.join(_ends(elements), "doc_id")
    rows = _rows_like(
        elements, at, idx=F.col("_last"), _nth=F.col("_before") + F.col("_n") + 1, content=F.col("_item"), style_name=F.lit(style)
    )
    return _insert(elements, rows, max_rows)


def append_table(elements: DataFrame, edits: DataFrame, max_rows: Limit = None) -> DataFrame:
    """O-E10: ``edits(doc_id, n_rows, n_cols, data[, seq])``; cells outside the table are ignored."""
    values = F.from_json("data", "array<array<string>>")
    row_nos = F.sequence(F.lit(0), F.col("n_rows") - 1)
    col_nos = F.sequence(F.lit(0), F.col("n_cols") - 1)

    def cell(r: Column, c: Column) -> Column:
        value = F.get(F.get(values, r), c)
        return F.struct(F.coalesce(value, F.lit("")).alias("text"), F.lit(None).cast("boolean").alias("bold"))

    cells = F.transform(row_nos, lambda r: F.transform(col_nos, lambda c: cell(r, c)))
    numbers = elements.groupBy("doc_id").agg(
        F.max("idx").alias("_last"), F.count_if(F.col("type") == "table").alias("_tables")
    )
    at = _ranked(edits.filter("n_rows > 0 and n_cols > 0"), "doc_id").join(numbers, "doc_id")
    rows = _rows_like(
        elements,
        at,
        idx=F.col("_last"),
        _nth=F.col("_rank") + 1,
        type=F.lit("table"),
        role=F.lit("table"),
        style_name=F.lit("Table Grid"),
        cells=cells.cast(T.ArrayType(T.ArrayType(CELL))),
        table_number=F.col("_tables") + 1 + F.col("_rank"),
    )
    return _insert(elements, rows, max_rows)


def delete_paragraphs(elements: DataFrame, edits: DataFrame, max_rows: Limit = None) -> DataFrame:
    """O-E11: rows named in ``edits(doc_id, idx)`` removed, the rest renumbered."""
    return reindex(elements.join(edits.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti"), max_rows)


# --- documents ----------------------------------------------------------------------


def safe_filename(title: Column) -> Column:
    """Characters that file names cannot hold become ``_``."""
    return F.concat(F.regexp_replace(title, r'[<>:"/\\|?*]', "_"), F.lit(".docx"))


def create_documents(manuscripts: DataFrame, elements: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-E12: ``titles(doc_id, title)`` as new documents with one heading."""
    new = titles.select(
        "doc_id", safe_filename(F.col("title")).alias("filename"), F.lit(0).cast("bigint").alias("size_bytes")
    )
    rows = _rows_like(
        elements, titles, idx=F.lit(0), content=F.col("title"), style_name=F.lit("Heading 1")
    ).drop("_nth")
    return manuscripts.unionByName(new), elements.unionByName(rows)


def duplicate_documents(elements: DataFrame, copies: DataFrame) -> DataFrame:
    """O-E12: ``copies(doc_id, new_doc_id)`` added as further documents."""
    c = copies.select("doc_id", "new_doc_id")
    rows = elements.join(c, "doc_id").drop("doc_id").withColumnRenamed("new_doc_id", "doc_id")
    return elements.unionByName(rows.select(*elements.columns))


def delete_documents(elements: DataFrame, gone: DataFrame) -> DataFrame:
    """O-E12: documents named in ``gone(doc_id)`` removed."""
    return elements.join(gone.select("doc_id"), "doc_id", "left_anti")


# --- formatting ---------------------------------------------------------------------


def _set_flags(run: Column, flags: dict[str, Column]) -> Column:
    for name, value in flags.items():
        run = run.withField(name, F.coalesce(value, run[name]))
    return run


def format_matching_text(elements: DataFrame, query: str, **flags) -> DataFrame:
    """O-E13: runs are split around the first match in each paragraph and the middle is formatted."""
    values = {k: F.lit(v) for k, v in flags.items() if v is not None}
    bad = set(values) - set(RUN_FLAGS)
    if bad:
        raise ValueError(f"unknown run flags {sorted(bad)}")
    df = runs_of(elements).withColumn("_full", F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    start = F.instr(F.col("_full"), query) - 1
    df = df.withColumn("_at", F.when(_is_paragraph() & (start >= 0), start))
    end = F.col("_at") + len(query)

    def split(run: Column, i: Column) -> Column:
        lo = F.aggregate(F.slice("runs", 1, i), F.lit(0), lambda a, r: a + F.length(r["text"]))
        n = F.length(run["text"])
        a = F.greatest(F.lit(0), F.least(n, F.col("_at") - lo))
        b = F.greatest(F.lit(0), F.least(n, end - lo))
        text = run["text"]
        before = run.withField("text", F.substring(text, F.lit(1), a))
        middle = _set_flags(run.withField("text", F.substring(text, a + 1, b - a)), values)
        after = run.withField("text", F.substring(text, b + 1, n - b))
        pieces = F.filter(F.array(before, middle, after), lambda p: F.length(p["text"]) > 0)
        return F.when(a < b, pieces).otherwise(F.array(run))

    new = F.flatten(F.transform("runs", split))
    df = df.withColumn("runs", F.when(F.col("_at").isNotNull(), new).otherwise(F.col("runs")))
    return df.withColumn("formatted", F.col("_at").isNotNull()).drop("_full", "_at")


def format_paragraphs(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """O-E14: ``edits(doc_id, idx[, alignment, style, bold, ..., seq])``; an unknown alignment is ignored.

    Of several edits of one row the last value of each kind counts.
    """
    wanted = [c for c in ("alignment", "style", *RUN_FLAGS) if c in edits.columns]
    last = _last(edits, *wanted)
    e = last.select("doc_id", "idx", *[F.col(c).alias(f"_{c}") for c in wanted])
    df = elements.join(e, ["doc_id", "idx"], "left")
    if "alignment" in wanted:
        align = F.lower("_alignment")
        new = F.when(align.isin(*ALIGNMENTS), align)
        empty = F.from_json(F.lit("{}"), elements.schema["fmt"].dataType)
        fmt = F.coalesce("fmt", empty).withField("alignment", new)
        df = df.withColumn("fmt", F.when(new.isNotNull(), fmt).otherwise(F.col("fmt")))
    if "style" in wanted:
        df = df.withColumn("style_name", F.coalesce("_style", "style_name"))
    flags = {c: F.col(f"_{c}") for c in wanted if c in RUN_FLAGS}
    if flags:
        hit = F.lit(False)
        for f in flags.values():
            hit = hit | f.isNotNull()
        df = df.withColumn("_plain", F.col("runs"))
        runs = F.transform("runs", lambda r: _set_flags(r, flags))
        df = runs_of(df).withColumn("runs", F.when(hit, runs).otherwise(F.col("_plain")))
    return df.select(*elements.columns)


def _seq(edits: DataFrame) -> list[str]:
    return ["seq"] if "seq" in edits.columns else []


def set_style(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """O-E14: ``edits(doc_id, idx, style)``."""
    return format_paragraphs(elements, edits.select("doc_id", "idx", "style", *_seq(edits)))


def set_alignment(elements: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-E14: ``edits(doc_id, idx, alignment)``; also the edits rejected for an unknown alignment."""
    ok = F.coalesce(F.lower("alignment").isin(*ALIGNMENTS), F.lit(False))
    done = format_paragraphs(elements, edits.filter(ok).select("doc_id", "idx", "alignment", *_seq(edits)))
    rejected = edits.filter(~ok).select(
        "doc_id", "idx", F.concat(F.lit("Unknown alignment '"), "alignment", F.lit("'.")).alias("error")
    )
    return done, rejected


def edit_errors(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """O-E15: edits whose row does not exist."""
    missing = edits.join(elements.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")
    sizes = elements.groupBy("doc_id").agg(F.max("idx").alias("_last"))
    known = missing.select("doc_id", "idx").join(sizes, "doc_id", "left")
    text = F.concat(
        F.lit("Index "), F.col("idx").cast("string"), F.lit(" out of range (0-"),
        F.coalesce("_last", F.lit(-1)).cast("string"), F.lit(")."),
    )
    return known.select("doc_id", "idx", text.alias("error"))
