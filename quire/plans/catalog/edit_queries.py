"""Batch edits (O-E) of the element tables derived from documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import edits as E
from quire.plans.catalog.inputs import DOC_LINES, doc_elements, table
from quire.sources.text import from_lines, read_cells, table_rows


def _turns(spark, sf):
    """Conversations as documents: one row per turn."""
    return from_lines(
        table(spark, sf, "conversations").select(
            F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("idx"), F.col("text").alias("content")
        )
    )


_TURNS = "turns as (select conv_id as doc_id, cast(turn as int) as idx, text as content from conversations)"


def _ids(spark, sf):
    return table(spark, sf, "labels").select("doc_id")


def _targets(spark, sf, idx=1):
    """One edit per labelled document."""
    return table(spark, sf, "labels").select(
        "doc_id",
        F.lit(idx).alias("idx"),
        F.concat(F.lit("Quality "), F.col("quality").cast("string")).alias("text"),
        F.when(F.col("toxic") == 1, "Quote").otherwise("Normal").alias("style"),
    )


def _base(spark, sf):
    return doc_elements(spark, sf, by_document=True)


def _out(df):
    return df.select("doc_id", "idx", "content", F.coalesce("style_name", F.lit("-")).alias("style"))


_L = "select doc_id, idx, content, '-' as style from lines"
_EDIT = "select l.doc_id, concat('Quality ', quality) as text, case when toxic = 1 then 'Quote' else 'Normal' end as style from labels l"
_NUMBERED = "select doc_id, cast(row_number() over (partition by doc_id order by p) - 1 as int) as idx, content, style from u"
_ENDS = "ends as (select doc_id, max(idx) as last from lines group by doc_id)"


def _appended(rows: str) -> str:
    return f"with {DOC_LINES}, {_ENDS}, u as (select doc_id, idx as p, content, style from ({_L}) union all {rows}) {_NUMBERED}"


def _formatted(spark, sf):
    df = E.format_matching_text(_base(spark, sf), "the", bold=True)
    runs = F.transform("runs", lambda r: F.concat(F.coalesce(r["bold"].cast("string"), F.lit("-")), F.lit(":"), r["text"]))
    return df.select("doc_id", "idx", F.array_join(runs, "|").alias("runs"), "formatted")


def _replaced(spark, sf):
    df = E.search_and_replace(_base(spark, sf), "the", "[$1]")
    return df.select("doc_id", "idx", "content", "n_replaced")


def _tables(spark, sf):
    """A table for every labelled document, and a second one for the toxic ones."""
    labels = table(spark, sf, "labels")
    first = labels.select(
        "doc_id",
        F.lit(2).alias("n_rows"),
        F.lit(2).alias("n_cols"),
        F.concat(F.lit('[["id","'), F.col("quality").cast("string"), F.lit('","beyond"],["last"]]')).alias("data"),
        F.lit(0).alias("seq"),
    )
    second = labels.filter("toxic = 1").select(
        "doc_id", F.lit(1).alias("n_rows"), F.lit(1).alias("n_cols"), F.lit('[["second"]]').alias("data"), F.lit(1).alias("seq")
    )
    return E.append_table(_base(spark, sf), first.union(second))


def _with_tables(spark, sf):
    row = F.transform("cells", lambda cells: F.array_join(F.transform(cells, lambda c: c["text"]), "|"))
    return _tables(spark, sf).select("doc_id", "idx", "type", "content", "table_number", F.array_join(row, ";").alias("cells"))


def _paragraph_format(spark, sf):
    edits = table(spark, sf, "labels").select(
        "doc_id",
        F.lit(0).alias("idx"),
        F.when(F.col("quality") == 1, "CENTER").otherwise("sideways").alias("alignment"),
        F.when(F.col("toxic") == 1, "Quote").alias("style"),
        F.when(F.col("toxic") == 1, True).alias("bold"),
    )
    out = E.format_paragraphs(_base(spark, sf), edits)
    return out.select(
        "doc_id",
        "idx",
        F.coalesce("fmt.alignment", F.lit("-")).alias("alignment"),
        F.coalesce("style_name", F.lit("-")).alias("style"),
        F.coalesce(F.get("runs", F.lit(0))["bold"], F.lit(False)).alias("bold"),
    )


def _rejected(spark, sf):
    edits = table(spark, sf, "labels").select(
        "doc_id", F.lit(0).alias("idx"), F.when(F.col("quality") == 1, "Center").otherwise("sideways").alias("alignment")
    )
    done, rejected = E.set_alignment(_base(spark, sf), edits)
    kept = done.select("doc_id", "idx", F.coalesce("fmt.alignment", F.lit("-")).alias("result"))
    return kept.unionByName(rejected.select("doc_id", "idx", F.col("error").alias("result")))


def _created(spark, sf):
    base = _base(spark, sf)
    names = table(spark, sf, "documents").select(
        "doc_id", F.concat("source", F.lit(".docx")).alias("filename"), F.col("n_chars").alias("size_bytes")
    )
    titles = table(spark, sf, "pages").select((F.col("page_id") + 10_000_000).alias("doc_id"), F.col("url").alias("title"))
    names, elements = E.create_documents(names, base, titles)
    rows = elements.select("doc_id", "idx", "content", F.coalesce("style_name", F.lit("-")).alias("style"))
    return E.list_documents(names).join(rows, "doc_id")


QUERIES = {
    "list_documents": (
        lambda spark, sf: E.list_documents(
            table(spark, sf, "documents").select(
                "doc_id", F.concat("source", F.lit("-"), "lang").alias("filename"), F.col("n_chars").alias("size_bytes")
            )
        ),
        "select doc_id, concat(source, '-', lang) as filename, n_chars as size_bytes from documents",
    ),
    "document_info": (
        lambda spark, sf: E.document_info(_base(spark, sf)).withColumn("styles_used", F.array_join("styles_used", ",")),
        f"with {DOC_LINES} select doc_id, count(*) as paragraph_count, sum(len(regexp_extract_all(content, '\\S+'))) as word_count, "
        "0 as table_count, 'Normal' as styles_used from lines group by doc_id",
    ),
    "read_page": (
        lambda spark, sf: E.read_page(_turns(spark, sf), 1, 2),
        f"with {_TURNS} select doc_id, idx, content as text, 'Normal' as style, n as total_paragraphs, n > 3 as has_more from "
        "(select *, count(*) over (partition by doc_id) as n from turns) where idx between 1 and 2",
    ),
    "read_paragraph": (
        lambda spark, sf: E.read_paragraph(_turns(spark, sf), 1),
        f"with {_TURNS} select doc_id, idx, 'Normal' as style, content as text, 'left' as alignment from turns where idx = 1",
    ),
    "snapshot": (
        lambda spark, sf: E.snapshot(_turns(spark, sf)).select(
            "doc_id",
            "paragraph_count",
            "word_count",
            "table_count",
            F.array_join(F.transform("last_paragraphs", lambda r: F.concat(r["idx"].cast("string"), F.lit(":"), r["text"])), "|").alias("last"),
        ),
        f"with {_TURNS}, r as (select *, row_number() over (partition by doc_id order by idx desc) as k from turns) select doc_id, count(*) as paragraph_count, "
        "sum(len(regexp_extract_all(content, '\\S+'))) as word_count, 0 as table_count, "
        "string_agg(case when k <= 5 then concat(idx, ':', content[1:200]) end, '|' order by idx) as \"last\" from r group by doc_id",
    ),
    "search_and_replace": (
        _replaced,
        f"with {DOC_LINES} select doc_id, idx, regexp_replace(content, '(?i)the', '[$1]', 'g') as content, "
        "len(regexp_extract_all(content, '(?i)the')) as n_replaced from lines",
    ),
    "search_and_replace_case": (
        lambda spark, sf: E.search_and_replace(_base(spark, sf), "The", "x", case_sensitive=True).select("doc_id", "idx", "content", "n_replaced"),
        f"with {DOC_LINES} select doc_id, idx, replace(content, 'The', 'x') as content, case when contains(content, 'The') then 1 else 0 end as n_replaced from lines",
    ),
    "edit_text": (
        lambda spark, sf: _out(E.edit_text(_base(spark, sf), _targets(spark, sf).withColumnRenamed("text", "new_text"))),
        f"with {DOC_LINES}, e as ({_EDIT}) select lines.doc_id, idx, coalesce(e.text, content) as content, '-' as style from lines left join e on e.doc_id = lines.doc_id and idx = 1",
    ),
    "insert_after": (
        lambda spark, sf: _out(E.insert_after(_base(spark, sf), _targets(spark, sf))),
        f"with {DOC_LINES}, e as ({_EDIT}), u as (select doc_id, cast(idx as double) as p, content, style from ({_L}) union all "
        f"select e.doc_id, 1.5, e.text, e.style from e join lines on lines.doc_id = e.doc_id and lines.idx = 1) {_NUMBERED}",
    ),
    "append_paragraphs": (
        lambda spark, sf: _out(E.append_paragraphs(_base(spark, sf), _targets(spark, sf).drop("idx"))),
        _appended(f"select e.doc_id, last + 1, e.text, e.style from ({_EDIT}) e join ends using (doc_id)"),
    ),
    "append_headings": (
        lambda spark, sf: _out(
            E.append_headings(
                _base(spark, sf), _targets(spark, sf).drop("idx", "style").withColumn("level", (F.col("doc_id") % 6).cast("int"))
            )
        ),
        _appended(
            f"select e.doc_id, last + 1, e.text, concat('Heading ', e.doc_id % 6) from ({_EDIT}) e join ends using (doc_id) where e.doc_id % 6 between 1 and 4"
        ),
    ),
    "append_page_breaks": (
        lambda spark, sf: E.append_page_breaks(_base(spark, sf), _ids(spark, sf)).select("doc_id", "idx", "type", "content"),
        f"with {DOC_LINES}, {_ENDS} select doc_id, idx, 'paragraph' as type, content from lines union all "
        "select doc_id, last + 1, 'page_break', '' from ends where doc_id in (select doc_id from labels)",
    ),
    "append_list": (
        lambda spark, sf: _out(
            E.append_list(
                _base(spark, sf),
                table(spark, sf, "labels").select(
                    "doc_id", F.expr("case when toxic = 1 then 'not json' else concat('[\"first\",\"', quality, '\"]') end").alias("items")
                ),
                numbered=True,
                
            )
        ),
        _appended(
            "select doc_id, last + 1, 'first', 'List Number' from labels join ends using (doc_id) where toxic <> 1 union all "
            "select doc_id, last + 2, cast(quality as varchar), 'List Number' from labels join ends using (doc_id) where toxic <> 1"
        ),
    ),
    "append_table": (
        _with_tables,
        f"with {DOC_LINES}, {_ENDS} select doc_id, idx, 'paragraph' as type, content, cast(null as int) as table_number, cast(null as varchar) as cells from lines "
        "union all select doc_id, last + 1, 'table', '', 1, concat('id|', quality, ';last|') from labels join ends using (doc_id) "
        "union all select doc_id, last + 2, 'table', '', 2, 'second' from labels join ends using (doc_id) where toxic = 1",
    ),
    "read_cells": (
        lambda spark, sf: read_cells(_tables(spark, sf)).drop("bold"),
        f"with {DOC_LINES}, {_ENDS}, c as (select doc_id, last + 1 as idx, quality, toxic from labels join ends using (doc_id)) "
        "select doc_id, idx, 0 as \"row\", 0 as col, 'id' as text from c union all select doc_id, idx, 0, 1, cast(quality as varchar) from c "
        "union all select doc_id, idx, 1, 0, 'last' from c union all select doc_id, idx, 1, 1, '' from c "
        "union all select doc_id, idx + 1, 0, 0, 'second' from c where toxic = 1",
    ),
    "table_rows": (
        lambda spark, sf: table_rows(read_cells(_tables(spark, sf))).withColumn("texts", F.array_join("texts", "|")),
        f"with {DOC_LINES}, {_ENDS}, c as (select doc_id, last + 1 as idx, quality, toxic from labels join ends using (doc_id)) "
        "select doc_id, idx, 0 as \"row\", concat('id|', quality) as texts from c union all select doc_id, idx, 1, 'last|' from c "
        "union all select doc_id, idx + 1, 0, 'second' from c where toxic = 1",
    ),
    "delete_paragraphs": (
        lambda spark, sf: _out(E.delete_paragraphs(_base(spark, sf), _targets(spark, sf))),
        f"with {DOC_LINES}, u as (select doc_id, idx as p, content, style from ({_L}) where not (idx = 1 and doc_id in (select doc_id from labels))) {_NUMBERED}",
    ),
    "create_documents": (
        _created,
        f"with {DOC_LINES} select doc_id, concat(source, '.docx') as filename, n_chars as size_bytes, idx, content, '-' as style from documents join lines using (doc_id) union all "
        "select page_id + 10000000, concat(regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g'), '.docx'), 0, 0, url, 'Heading 1' from pages",
    ),
    "duplicate_documents": (
        lambda spark, sf: E.duplicate_documents(
            _base(spark, sf), _ids(spark, sf).withColumn("new_doc_id", F.col("doc_id") + 1_000_000)
        ).select("doc_id", "idx", "content"),
        f"with {DOC_LINES} select doc_id, idx, content from lines union all select doc_id + 1000000, idx, content from lines where doc_id in (select doc_id from labels)",
    ),
    "delete_documents": (
        lambda spark, sf: E.delete_documents(_base(spark, sf), _ids(spark, sf)).select("doc_id", "idx", "content"),
        f"with {DOC_LINES} select doc_id, idx, content from lines where doc_id not in (select doc_id from labels)",
    ),
    "format_matching_text": (
        _formatted,
        f"with {DOC_LINES} select doc_id, idx, case when not contains(content, 'the') then concat('-:', content) else concat(case when strpos(content, 'the') > 1 then concat('-:', content[1:strpos(content, 'the') - 1], '|') else '' end, "
        "'true:the', case when length(content) > strpos(content, 'the') + 2 then concat('|-:', content[strpos(content, 'the') + 3:]) else '' end) end as runs, "
        "contains(content, 'the') as formatted from lines",
    ),
    "format_paragraphs": (
        _paragraph_format,
        f"with {DOC_LINES} select lines.doc_id, idx, case when quality = 1 then 'center' else '-' end as alignment, case when toxic = 1 then 'Quote' else '-' end as style, "
        "coalesce(toxic = 1, false) as bold from lines left join labels on labels.doc_id = lines.doc_id and idx = 0",
    ),
    "set_style": (
        lambda spark, sf: _out(E.set_style(_base(spark, sf), _targets(spark, sf).select("doc_id", "idx", "style"))),
        f"with {DOC_LINES}, e as ({_EDIT}) select lines.doc_id, idx, content, coalesce(e.style, '-') as style from lines left join e on e.doc_id = lines.doc_id and idx = 1",
    ),
    "set_alignment": (
        _rejected,
        f"with {DOC_LINES} select lines.doc_id, idx, case when quality = 1 then 'center' else '-' end as result from lines "
        "left join labels on labels.doc_id = lines.doc_id and idx = 0 union all "
        "select doc_id, 0, 'Unknown alignment ''sideways''.' from labels where quality is distinct from 1",
    ),
    "edit_errors": (
        lambda spark, sf: E.edit_errors(_base(spark, sf), _targets(spark, sf, 7)),
        f"with {DOC_LINES}, {_ENDS} select doc_id, 7 as idx, concat('Index 7 out of range (0-', coalesce(last, -1), ').') as error from labels left join ends using (doc_id) "
        "where coalesce(last, -1) < 7",
    ),
}
