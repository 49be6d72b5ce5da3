"""Style specifications and format planning (O-S5, O-Y, O-F)."""

from __future__ import annotations


from pyspark.sql import functions as F

from quire.operators import formatting as F_
from quire.operators import styles as Y
from quire.plans.catalog.inputs import (
    DOC_LINES,
    MANUSCRIPT_LINES,
    assigned,
    builtin_style_specs,
    doc_elements,
    document_styles,
    labelled_manuscripts,
    table,
)
from quire.plans.catalog.structure_queries import chain
from quire.plans.compliance_inputs import styles_values_sql
from quire.sources.style_values import STYLES
from quire.sources.styles import leaf_paths, parse_specs, style_for

_T = "default_typography"
_LEAVES = {p: d for p, _, d in leaf_paths()}
_TYPES = {p: t for p, t, _ in leaf_paths()}


def _leaf(style: str, path: str):
    return STYLES[style].get(path, _LEAVES[path])


def _as_text(path: str, v) -> str:
    if v is None:
        return "null"
    if _TYPES[path] == "boolean":
        return "'true'" if v else "'false'"
    return "'" + str(v).replace("'", "''") + "'"


def _spec_values(*paths: str) -> str:
    return styles_values_sql({p.replace(".", "_"): p for p in paths})


_FILL = chain("fill", MANUSCRIPT_LINES)


def _styled(spark, sf):
    return labelled_manuscripts(spark, sf).persist(), builtin_style_specs(spark), document_styles(spark, sf)


def _plain(build):
    return lambda spark, sf: build(*_styled(spark, sf))


# --- requests derived from customers --------------------------------------------------

_REQUEST = """select c_custkey as request_id,
  case c_custkey % 7 when 0 then 'apa7' when 1 then 'mla' when 2 then 'ieee' when 3 then 'vancouver' when 4 then 'chicago' when 5 then 'nature' else null end as style_id,
  case when c_custkey % 5 = 0 then 'Use wide margins.' when c_custkey % 5 = 1 then '  ' else null end as guidelines_text,
  case when c_custkey % 3 = 0 then 'Manuscripts must be double spaced, with numbered headings throughout.' when c_custkey % 3 = 1 then 'Not found' else null end as url_text from {0}"""


def _requests(spark, sf):
    return spark.sql(_REQUEST.format("{customer}"), customer=table(spark, sf, "customer"))


def _resolve(spark, sf):
    made = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("request_id"), F.concat(F.lit("custom-"), F.col("c_custkey").cast("string")).alias("spec_id")
    )
    return Y.resolve_style(_requests(spark, sf), made, builtin_style_specs(spark))


def _style_for(spark, sf):
    out = style_for(_requests(spark, sf).select("request_id", "style_id"), builtin_style_specs(spark))
    return out.select("request_id", "resolved_style", F.col("spec.page_layout.columns").alias("columns"))


def _levels(spark, sf):
    asked = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_custkey") % 2 == 0, "ieee").otherwise("vancouver").alias("style_id"),
        (F.col("c_custkey") % 8).cast("int").alias("level"),
    )
    return Y.heading_level_spec(asked, builtin_style_specs(spark)).select(
        "request_id", "style_id", "level", "used_level", "alignment", "bold", "italic", "font_size_pt", "case"
    )


def _level_rows() -> str:
    rows = []
    for s in ("ieee", "vancouver"):
        for n in range(1, 6):
            h = f"headings.level_{n}."
            vals = [_leaf(s, h + k) for k in ("alignment", "bold", "italic", "font_size_pt", "case")]
            rows.append(f"('{s}', {n}, '{vals[0]}', {vals[1]}, {vals[2]}, cast({vals[3]} as double), '{vals[4]}')")
    return f"select * from (values {', '.join(rows)}) as t(style_id, used_level, alignment, bold, italic, font_size_pt, \"case\")"


# --- partial specifications derived from customers ------------------------------------


def _partial(spark, sf):
    """Specification documents with a valid and, for every third customer, an invalid section."""
    text = F.expr(
        "concat('{\"style_id\":\"c', c_custkey, '\",\"abstract\":{\"label\":\"Summary\",\"max_words\":', "
        "if(c_custkey % 3 = 0, '\"many\"', cast(100 + c_custkey % 50 as string)), '},\"page_layout\":{\"margin_top_inches\":', "
        "0.5 + c_custkey % 4, '}}')"
    )
    return table(spark, sf, "customer").select(text.alias("json"))


def _section_values(df):
    return df.select(
        "style_id",
        F.col("abstract.label").alias("label"),
        F.col("abstract.max_words").alias("max_words"),
        F.col("page_layout.margin_top_inches").alias("margin_top"),
        F.col("page_layout.columns").alias("columns"),
    )


def _parsed(spark, sf):
    """All of them; an invalid leaf is null and then has its default."""
    return parse_specs(_partial(spark, sf))


def _merged(spark, sf):
    k = F.col("c_custkey")
    override = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("style_id"),
        F.when(k % 4 == 1, "abstract.label").when(k % 4 == 2, "headings.level_1.case").otherwise("custom.note").alias("path"),
        F.when(k % 4 != 2, F.concat(F.lit("note "), k.cast("string"))).alias("value"),
    )
    return Y.deep_merge(Y.flatten_specs(_parsed(spark, sf)), override)


_DEFAULT_ROWS = ", ".join(
    f"('{p}', {_as_text(p, d)})" for p, d in _LEAVES.items()
)
_CUSTOM_LEAVES = f"""select concat('c', c_custkey) as style_id, path, case path when 'style_id' then concat('c', c_custkey)
  when 'abstract.label' then 'Summary' when 'abstract.max_words' then case when c_custkey % 3 = 0 then value else cast(100 + c_custkey % 50 as varchar) end
  when 'page_layout.margin_top_inches' then cast(cast(0.5 + c_custkey % 4 as double) as varchar) else value end as value, c_custkey
  from customer, (values {_DEFAULT_ROWS}) as t(path, value)"""


_MOST_WORDS = f"cast(case when c_custkey % 3 = 0 then {_LEAVES['abstract.max_words']} else 100 + c_custkey % 50 end as int)"
_SECTION_SQL = (
    f"select concat('c', c_custkey) as style_id, 'Summary' as label, {_MOST_WORDS} as max_words, "
    "cast(0.5 + c_custkey % 4 as double) as margin_top, 1 as columns from customer"
)


_TARGET_PATHS = [
    f"{_T}.font_name",
    f"{_T}.font_size_pt",
    f"{_T}.line_spacing",
    f"{_T}.paragraph_alignment",
    f"{_T}.first_line_indent_inches",
    "title_page.title.alignment",
    "title_page.title.font_size_pt",
    "title_page.title.bold",
    "title_page.title.italic",
    "title_page.author_name.alignment",
    "title_page.author_name.font_size_pt",
    "title_page.author_name.bold",
    "title_page.author_name.italic",
    "abstract.label_alignment",
    "abstract.label_bold",
    "abstract.keywords_indent",
    "headings.level_1.alignment",
    "headings.level_1.font_size_pt",
    "headings.level_1.bold",
    "headings.level_1.italic",
    "references.label_alignment",
    "references.label_bold",
    "references.entry_indent_type",
    "references.hanging_indent_inches",
    "references.line_spacing",
]
_D = "default_typography"
_TARGET_SQL = f"""{_FILL}, s as ({_spec_values(*_TARGET_PATHS)}),
 e as (select * from fill where not (role = 'unknown' and text = ''))
 select style_id, doc_id, idx, role,
  case role when 'title' then title_page_title_alignment when 'author_info' then title_page_author_name_alignment
   when 'abstract_label' then abstract_label_alignment when 'reference_label' then references_label_alignment
   when 'heading_1' then headings_level_1_alignment else {_D}_paragraph_alignment end as alignment,
  cast(case when role in ('body', 'unknown') then {_D}_first_line_indent_inches when role = 'keywords' and abstract_keywords_indent then 0.5
   when role = 'reference_entry' and references_entry_indent_type = 'hanging' then -references_hanging_indent_inches else 0.0 end as double) as first_line_indent,
  cast(case when role = 'reference_entry' and references_entry_indent_type = 'hanging' then references_hanging_indent_inches else 0.0 end as double) as left_indent,
  case when role = 'reference_entry' then references_line_spacing else {_D}_line_spacing end as line_spacing,
  cast(case when role in ('abstract_label', 'reference_label') then null else 0.0 end as double) as space_before, cast(0.0 as double) as space_after,
  {_D}_font_name as font_name,
  case role when 'title' then title_page_title_font_size_pt when 'author_info' then title_page_author_name_font_size_pt
   when 'heading_1' then headings_level_1_font_size_pt else {_D}_font_size_pt end as font_size_pt,
  case role when 'title' then title_page_title_bold when 'author_info' then title_page_author_name_bold when 'abstract_label' then abstract_label_bold
   when 'heading_1' then headings_level_1_bold when 'reference_label' then references_label_bold when 'abstract_body' then false
   when 'reference_entry' then false end as bold,
  case role when 'title' then title_page_title_italic when 'author_info' then title_page_author_name_italic when 'heading_1' then headings_level_1_italic end as italic
 from e, s"""


# Headings of several levels, planted on the documents by position.
_PLANTED = "case when idx % 9 = 0 then 'heading_1' when idx % 9 in (2, 5) then 'heading_2' when idx % 9 in (3, 4, 7) then concat('heading_', 3 + idx % 3) else 'body' end"


def _planted(spark, sf):
    return doc_elements(spark, sf, by_document=True).withColumn("role", F.expr(_PLANTED))


_NUM_SQL = f"""with {DOC_LINES}, h as (select doc_id, idx, content, {_PLANTED} as role from lines),
 n as (select *, cast(role[9:9] as int) as level from h where role <> 'body' and lower(trim(regexp_replace(trim(content), '^(?:[IVXLC]+[.)]\\s*|[A-Za-z][.)]\\s*|\\d+[.)]\\s*)', '')))
   not in ({", ".join(repr(u) for u in F_.UNNUMBERED)})),
 c as (select *, sum(case when level = 1 then 1 else 0 end) over w as a, sum(case when level = 2 then 1 else 0 end) over w as b0,
   sum(case when level >= 3 then 1 else 0 end) over w as c0 from n window w as (partition by doc_id order by idx)),
 d as (select *, b0 - coalesce(max(case when level = 1 then b0 end) over w, 0) as b, c0 - coalesce(max(case when level <= 2 then c0 end) over w, 0) as c
   from c window w as (partition by doc_id order by idx))
 select doc_id, idx, level, case when level = 1 then concat(case when a <= 20 then list_extract([{", ".join(repr(r) for r in F_.ROMAN)}], cast(a as int)) else cast(a as varchar) end, '.')
  when level = 2 then concat(case when b <= 26 then chr(cast(64 + b as int)) else cast(b as varchar) end, '.') else concat(c, ')') end as prefix from d"""


def _marks(role: str) -> str:
    return f"min(case when role in ({role}) then idx end)"


_MARKS_SQL = f"""{_FILL}, m as (select doc_id, bool_or(role = 'abstract_label') as has_abs, bool_or(role = 'reference_label') as has_ref,
  {_marks("'abstract_body', 'abstract_label'")} as abs_idx, {_marks("'reference_entry'")} as ref_idx,
  max(case when role in ('title', 'author_info', 'abstract_label', 'abstract_body', 'keywords') then idx end) as front_idx from fill group by doc_id),
 b as (select f.doc_id, min(f.idx) as body_idx from fill f join m on m.doc_id = f.doc_id where f.idx > abs_idx
  and role in ('body', 'heading_1', 'heading_2', 'heading_3') group by f.doc_id)"""


def _without_labels(spark, sf):
    rows = labelled_manuscripts(spark, sf).persist().filter("role not in ('abstract_label', 'reference_label')")
    one_style = document_styles(spark, sf).withColumn("style_id", F.lit("chicago"))
    return F_.insert_missing_labels(rows, builtin_style_specs(spark), one_style).select(
        "doc_id", "idx", "role", "content"
    )


def _bibliography(spark, sf):
    rows = labelled_manuscripts(spark, sf)
    texts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min("l_partkey").alias("k"))
    texts = texts.select("doc_id", F.lit(0).alias("n"), F.concat(F.lit("Entry "), F.col("k").cast("string")).alias("text")).unionByName(
        texts.select("doc_id", F.lit(1).alias("n"), F.lit("  ").alias("text"))
    )
    return F_.replace_reference_text(rows, texts).select("doc_id", "idx", "content")


def _runs_text(df):
    one = lambda r: F.concat_ws("/", r["text"], r["bold"].cast("string"), r["italic"].cast("string"), r["font_name"], r["font_size_pt"].cast("string"))
    return df.select("style_id", "doc_id", "idx", F.array_join(F.transform("runs", one), ";").alias("runs"))


def _size(c: str) -> str:
    return f"concat(cast({c} as int), '.0')"


def _changes(spark, sf):
    rows = labelled_manuscripts(spark, sf).select("doc_id", "idx", "type", "role", "content").persist()
    return F_.format_changes(rows, builtin_style_specs(spark), document_styles(spark, sf))


# Fonts of the runs, by position: some are the style's, some are not, some are not stated.
_HAVE_FONT = "case (doc_id + idx) % 3 when 0 then 'Times New Roman' when 1 then 'Arial' else null end"
_HAVE_SIZE = "cast(case (doc_id + 2 * idx) % 5 when 0 then null when 1 then 10 else 12 end as double)"


def _font_violations(spark, sf):
    rows, specs, doc_styles = _styled(spark, sf)
    rows = F_.runs_of(rows)
    run = F.transform(
        "runs",
        lambda r: r.withField("font_name", F.expr(_HAVE_FONT)).withField("font_size_pt", F.expr(_HAVE_SIZE)),
    )
    return F_.font_violations(rows.withColumn("runs", run), specs, doc_styles)


QUERIES = {
    "flatten_specs": (
        lambda spark, sf: Y.flatten_specs(_parsed(spark, sf)),
        f"select style_id, path, value from ({_CUSTOM_LEAVES})",
    ),
    "nest_leaves": (
        lambda spark, sf: _section_values(Y.nest_leaves(Y.flatten_specs(_parsed(spark, sf)))),
        _SECTION_SQL,
    ),
    "style_for": (
        _style_for,
        f"with r as ({_REQUEST.format('customer')}), s as ({_spec_values('page_layout.columns')}) select request_id, "
        "coalesce(s.style_id, 'apa7') as resolved_style, coalesce(page_layout_columns, 1) as columns from r left join s using (style_id)",
    ),
    "with_defaults": (
        lambda spark, sf: _section_values(_parsed(spark, sf)),
        _SECTION_SQL,
    ),
    "recover_sections": (
        lambda spark, sf: _section_values(Y.recover_sections(_partial(spark, sf))),
        "select concat('c', c_custkey) as style_id, case when c_custkey % 3 = 0 then 'Abstract' else 'Summary' end as label, "
        "cast(case when c_custkey % 3 = 0 then 250 else 100 + c_custkey % 50 end as int) as max_words, "
        "cast(0.5 + c_custkey % 4 as double) as margin_top, 1 as columns from customer",
    ),
    "deep_merge": (
        _merged,
        f"select style_id, path, case when c_custkey % 4 = 1 and path = 'abstract.label' then concat('note ', c_custkey) else value end as value "
        f"from ({_CUSTOM_LEAVES}) union all select concat('c', c_custkey), 'custom.note', concat('note ', c_custkey) from customer "
        "where c_custkey % 4 in (0, 3)",
    ),
    "compare_specs": (
        lambda spark, sf: Y.compare_specs(parse_specs(_partial(spark, sf)), Y.recover_sections(_partial(spark, sf))),
        "select concat('c', c_custkey) as style_id, 'abstract.label' as path, 'Summary' as a, 'Abstract' as b from customer where c_custkey % 3 = 0",
    ),
    "resolve_style": (
        _resolve,
        f"with r as ({_REQUEST.format('customer')}), w as (select *, case when trim(coalesce(guidelines_text, '')) <> '' then 'text' "
        "when length(trim(url_text)) >= 50 then 'url' else 'style' end as wants from r) "
        "select request_id, case when wants <> 'style' and request_id % 2 = 0 then wants else 'style' end as source, "
        "case when wants <> 'style' and request_id % 2 = 0 then concat('custom-', request_id) "
        "when style_id in ('apa7', 'mla', 'ieee', 'vancouver', 'chicago') then style_id else 'apa7' end as spec_id from w",
    ),
    "heading_level_spec": (
        _levels,
        f"with s as ({_level_rows()}), q as (select c_custkey as request_id, case when c_custkey % 2 = 0 then 'ieee' else 'vancouver' end as style_id, "
        "cast(c_custkey % 8 as int) as level from customer) select request_id, q.style_id, level, used_level, alignment, bold, italic, font_size_pt, \"case\" "
        "from q join s on s.style_id = q.style_id and s.used_level = case when level between 1 and 5 then level else 1 end",
    ),
    "target_format": (_plain(F_.target_format), assigned(_TARGET_SQL)),
    "caption_run_format": (
        _plain(lambda e, s, d: _runs_text(F_.caption_run_format(e, s, d))),
        assigned(f"{_FILL}, s as ({_spec_values('tables.number_label', 'tables.number_bold', 'tables.number_italic', 'tables.title_italic', 'figures.number_label', 'figures.number_bold', 'figures.number_italic', 'figures.title_italic', f'{_T}.font_name', f'{_T}.font_size_pt')}), "
        "c as (select *, starts_with(lower(content), lower(case when role = 'table_caption' then tables_number_label else figures_number_label end)) as hit from fill, s "
        "where role in ('table_caption', 'figure_caption')) select style_id, doc_id, idx, concat_ws('/', content, "
        "cast(case when not hit then false when role = 'table_caption' then tables_number_bold else figures_number_bold end as varchar), "
        "cast(case when role = 'table_caption' then (case when hit then tables_number_italic else tables_title_italic end) "
        "else (case when hit then figures_number_italic else figures_title_italic end) end as varchar), "
        f"{_D}_font_name, {_size(f'{_D}_font_size_pt')}) as runs from c"),
    ),
    "keyword_run_format": (
        _plain(lambda e, s, d: _runs_text(F_.keyword_run_format(e, s, d))),
        assigned(f"{_FILL}, s as ({_spec_values(f'{_T}.font_name', f'{_T}.font_size_pt')}) select style_id, doc_id, idx, concat_ws('/', content, 'false', "
        f"case when contains(lower(content), 'keyword') then 'true' else 'false' end, {_D}_font_name, {_size(f'{_D}_font_size_pt')}) as runs from fill, s where role = 'keywords'"),
    ),
    "number_headings": (lambda spark, sf: F_.number_headings(_planted(spark, sf), None), _NUM_SQL),
    "heading_text": (
        _plain(lambda e, s, d: F_.heading_text(e, s, d).select("style_id", "doc_id", "idx", "level", "old_text", "new_text")),
        assigned(f"{_FILL}, s as ({_spec_values('headings.level_1.case', 'headings.numbering_style')}) select style_id, doc_id, idx, 1 as level, text as old_text, "
        "concat(case when headings_numbering_style = 'ieee' then 'I. ' else '' end, case when headings_level_1_case = 'upper' then upper(text) else text end) as new_text "
        "from fill, s where role = 'heading_1'"),
    ),
    "insert_missing_labels": (
        _without_labels,
        f"{_FILL}, k as (select * from fill where role not in ('abstract_label', 'reference_label')), f as (select doc_id, {_marks(chr(39) + 'abstract_body' + chr(39))} as a, "
        f"{_marks(chr(39) + 'reference_entry' + chr(39))} as r from k group by doc_id), u as (select doc_id, idx * 2 as p, role, content from k union all select doc_id, a * 2 - 1, "
        "'abstract_label', 'Abstract' from f where a is not null union all select doc_id, r * 2 - 1, 'reference_label', 'Bibliography' from f where r is not null) "
        "select doc_id, cast(row_number() over (partition by doc_id order by p) - 1 as int) as idx, role, content from u",
    ),
    "page_breaks": (
        _plain(F_.page_breaks),
        assigned(f"{_MARKS_SQL}, s as ({_spec_values('title_page.required')}), j as (select * from m left join b using (doc_id), s) "
        "select style_id, doc_id, 'abstract' as reason, abs_idx as idx, not has_abs as inserted from j where title_page_required and abs_idx is not null "
        "union all select style_id, doc_id, 'body', body_idx, false from j where title_page_required and body_idx is not null "
        "union all select style_id, doc_id, 'references', ref_idx, not has_ref from j where ref_idx is not null"),
    ),
    "running_head": (
        _plain(F_.running_head),
        assigned(f"{_FILL} select 'mla' as style_id, doc_id, upper(trim(string_agg(content, ' ' order by idx)))[1:50] as running_head from fill where role = 'title' group by doc_id"),
    ),
    "column_sections": (
        _plain(F_.column_sections),
        assigned(f"{_MARKS_SQL} select 'ieee' as style_id, f.doc_id, f.idx, case when front_idx is null or idx <= front_idx then 1 else 2 end as section, "
        "case when idx <= front_idx then 1 else 2 end as columns from fill f join m using (doc_id)"),
    ),
    "reference_label_text": (
        _plain(F_.reference_label_text),
        assigned(f"{_FILL}, s as ({_spec_values('references.section_label')}) select style_id, doc_id, idx, text as old_text, case when lower(text) <> lower(references_section_label) "
        "then references_section_label else text end as new_text from fill, s where role = 'reference_label'"),
    ),
    "format_changes": (_changes, None),
    "font_violations": (
        _font_violations,
        "select style_id, doc_id, idx, cast(0 as int) as run_no, have_font as font_name, have_size as font_size_pt, "
        f"font_name as want_font, font_size_pt as want_size from (select *, {_HAVE_FONT} as have_font, {_HAVE_SIZE} as have_size "
        f"from ({assigned(_TARGET_SQL)})) where have_font is distinct from font_name or have_size is distinct from font_size_pt",
    ),
    "replace_reference_text": (
        _bibliography,
        f"{_FILL}, t as (select l_orderkey as doc_id, concat('Entry ', min(l_partkey)) as entry from lineitem group by 1), "
        "n as (select *, row_number() over (partition by doc_id, role order by idx) as r from fill) select n.doc_id, idx, "
        "case when role = 'reference_entry' and r = 1 then entry else content end as content from n join t using (doc_id)",
    ),
}
