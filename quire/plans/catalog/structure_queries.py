"""Structure detection and paragraph reconstruction (O-D, O-M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.operators import merge as M
from quire.operators import structure as S
from quire.ordering import reindex
from quire.plans.catalog.inputs import (
    DOC_LINES,
    MANUSCRIPT_LINES,
    NOISY_LINES,
    SECTION_NAMES,
    UNLABELLED_LINES,
    doc_elements,
    labelled_documents,
    labelled_manuscripts,
    manuscript_elements,
    noisy_elements,
    unlabelled_elements,
)
from quire.plans.catalog.text_queries import _ARTIFACT_SQL, _AUTHOR_SQL, _PIPE_SQL, _WORDS
from quire.schemas import SECTION_ROLES
from quire.sources.docx import resolve_fonts

_W = "(partition by doc_id order by idx)"
_BEFORE = "(partition by doc_id order by idx rows between unbounded preceding and 1 preceding)"
_DOC = "(partition by doc_id)"
_SECTIONS = ", ".join(f"'{r}'" for r in SECTION_ROLES)
_FRONT_SECTIONS = ", ".join(f"'{r}'" for r in SECTION_ROLES if r != "abstract_label")
_SAFE = ", ".join(f"'{r}'" for r in S.SAFE_ROLES)
_T = "text"


def _on_text(sql: str) -> str:
    return sql.replace("trim(content)", "text").replace("(content", "(text")


_STATE = "doc_id, idx, content, text, role, conf"

# One common table expression per pass; each reads the one before it.
PASSES = {
    "keyword": f"""k0 as (select doc_id, idx, content, trim(content) as text,
        rtrim(lower(trim(content)), '.') as key from lines),
      keyword as (select doc_id, idx, content, text, coalesce(krole, 'unknown') as role,
        case when krole is null then 0.0 else 0.85 end as conf
        from k0 left join kw on key = keyword and {_WORDS.format('text')} <= 8)""",
    "reference": f"""r0 as (select *, text <> '' as line, regexp_matches(text, '{P.NUMBERED_REFERENCE}') as num,
        rtrim(lower(text), '.') as key from keyword),
      r1 as (select *, sum(case when line then 1 else 0 end) over {_W} as line_no,
        sum(case when line and not num and key in (select keyword from kw) then 1 else 0 end) over {_W} as names,
        min(case when role = 'reference_label' then idx end) over {_DOC} as label from r0),
      r2 as (select *, last_value(case when num then line_no end ignore nulls) over {_BEFORE} as prev_line,
        last_value(case when num then names end ignore nulls) over {_BEFORE} as prev_names from r1),
      r3 as (select *, coalesce(max(case when num and (line_no - prev_line > 7 or names > prev_names) then idx end) over {_DOC},
        min(case when num then idx end) over {_DOC}) as list_start from r2),
      r4 as (select *, sum(case when num and idx >= list_start then 1 else 0 end) over {_DOC} as entries,
        min(case when idx between list_start - 5 and list_start - 1 and key in ('references', 'bibliography', 'works cited')
          then idx end) over {_DOC} as near from r3),
      r5 as (select doc_id, idx, content, text, line,
        case when label is null and entries >= 3 and idx = near then 'reference_label' else role end as role,
        case when label is null and entries >= 3 and idx = near then 0.8 else conf end as conf,
        coalesce(label, case when entries >= 3 then coalesce(near, list_start - 1) end) as list_label from r4),
      r6 as (select *, min(case when idx > list_label and line and role in ('heading_1', 'heading_2', 'appendix', 'abstract_label')
        then idx end) over {_DOC} as list_end from r5),
      reference as (select doc_id, idx, content, text,
        case when hit then 'reference_entry' else role end as role, case when hit then 0.75 else conf end as conf
        from (select *, coalesce(role = 'unknown' and line and idx > list_label and (list_end is null or idx < list_end), false) as hit from r6))""",
    "title": f"""t0 as (select *, least(15, coalesce(min(case when role in ({_SECTIONS}) then idx end) over {_DOC}, 15)) as zone_end,
        max(case when role = 'title' then 1 else 0 end) over {_DOC} as titled, {_on_text(_AUTHOR_SQL)} as author from reference),
      t1 as (select *, role = 'unknown' and idx < zone_end and titled = 0 as zone from t0),
      t2 as (select *, sum(case when zone and text <> '' then 1 else 0 end) over {_W} as nth from t1),
      t3 as (select *, max(case when (zone and text <> '' and author) or (zone and text = '' and nth > 0)
        or (zone and text <> '' and nth > 1 and ({_WORDS.format('text')} > 20 or regexp_matches(text, '^[0-9]')))
        then 1 else 0 end) over {_W} as ended from t2),
      title as (select doc_id, idx, content, text, case when hit then 'title' else role end as role,
        case when hit and nth = 1 then 0.7 when hit then 0.6 else conf end as conf
        from (select *, zone and text <> '' and ended = 0 as hit from t3))""",
    "author": f"""a0 as (select *, max(case when role = 'title' then idx end) over {_DOC} as title_end from title),
      a1 as (select *, min(case when idx > title_end and role in ({_SECTIONS}) then idx end) over {_DOC} as section from a0),
      a2 as (select *, coalesce(role = 'unknown' and text <> '' and idx > title_end and idx < title_end + 30
        and (section is null or idx < section), false) as zone from a1),
      a3 as (select *, case when not zone then null when {_on_text(_AUTHOR_SQL)} then 0.6
        when starts_with(text, ',') or starts_with(text, 'and ') then 0.55 when regexp_matches(text, '{P.AFFILIATION}') then 0.55
        when regexp_matches(text, '{S.FRONT_META}') then 0.5 when contains(text, '@') or contains(lower(text), 'orcid') then 0.5
        when regexp_matches(text, '{S.YEAR_END}') and {_WORDS.format('text')} <= 8 then 0.45 end as found from a2),
      a4 as (select *, last_value(case when zone then found is null end ignore nulls) over {_BEFORE} as missed from a3),
      a5 as (select *, max(case when zone and found is null and missed then 1 else 0 end) over {_W} as ended from a4),
      author as (select doc_id, idx, content, text, case when found is not null and ended = 0 then 'author_info' else role end as role,
        case when found is not null and ended = 0 then found else conf end as conf from a5)""",
    "abstract": f"""b0 as (select *, coalesce(max(case when role in ('title', 'author_info') then idx end) over {_DOC}, 0) as front from author),
      b1 as (select *, min(case when idx > front and role in ({_FRONT_SECTIONS}) then idx end) over {_DOC} as section from b0),
      b2 as (select *, idx > front and (section is null or idx < section) as inside from b1),
      b3 as (select *, min(case when inside and role = 'abstract_label' then idx end) over {_DOC} as label from b2),
      b4 as (select *, role = 'unknown' and text <> '' and inside and (label is null or idx > label)
        and not regexp_matches(text, '(?i)^keywords?\\s*[:–-]') as line from b3),
      b5 as (select *, min(case when line and {_WORDS.format('text')} >= 4 then idx end) over {_DOC} as start from b4),
      abstract as (select doc_id, idx, content, text, case when hit then 'abstract_body' else role end as role,
        case when hit and label is not null then 0.55 when hit then 0.45 else conf end as conf
        from (select *, coalesce(line and idx >= start, false) as hit from b5))""",
    "artifact": f"""c0 as (select *, role not in ({_SAFE}) and text <> '' and ({_on_text(_ARTIFACT_SQL)}) as hit from abstract),
      c1 as (select *, not hit and (role in ({_SAFE}) or conf >= 0.7 or (text <> '' and not (length(text) <= 200
        and (regexp_matches(text, '{P.CONTRIBUTION}') or (length(text) < 100 and conf < 0.5))))) as stops from c0),
      c2 as (select *, max(case when hit then idx end) over {_W} as last_hit, max(case when stops then idx end) over {_W} as last_stop from c1),
      artifact as (select doc_id, idx, case when gone then '' else content end as content, case when gone then '' else text end as text,
        case when gone then 'unknown' else role end as role, case when gone then 0.95 else conf end as conf
        from (select *, coalesce(hit or (text <> '' and idx - last_hit <= 5 and (last_stop is null or last_stop < last_hit)), false) as gone from c2))""",
    "keywords": f"""keywords as (select doc_id, idx, content, text, case when labelled or piped then 'keywords' else role end as role,
        case when labelled then 0.85 when piped then 0.6 else conf end as conf from (select *,
        text <> '' and regexp_matches(text, '(?i)^keywords?\\s*[:–-]') as labelled,
        role in ('unknown', 'abstract_body') and {_on_text(_PIPE_SQL)} as piped from artifact))""",
    "captions": f"""captions as (select doc_id, idx, content, text, case when fig then 'figure_caption' when tab then 'table_caption' else role end as role,
        case when fig or tab then 0.85 else conf end as conf from (select *,
        role in ('unknown', 'body') and regexp_matches(text, '{P.FIGURE_CAPTION}') as fig,
        role in ('unknown', 'body') and regexp_matches(text, '{P.TABLE_CAPTION}') as tab from keywords))""",
    "front": f"""f0 as (select *, max(case when role in ('title', 'author_info') then idx end) over {_DOC} as front from captions),
      f1 as (select *, coalesce(text <> '' and idx > front and idx <= front + 8, false) as zone from f0),
      f2 as (select *, max(case when zone and (conf >= 0.6 or role not in ('unknown', 'body') or not (starts_with(text, ',')
        or starts_with(text, 'and ') or {_WORDS.format('text')} <= 3 or regexp_matches(text, '{S.FRONT_YEAR_END}') or contains(text, '@')
        or regexp_matches(text, '{S.FRONT_CONTACT}'))) then 1 else 0 end) over {_W} as ended from f1),
      front as (select doc_id, idx, content, text, case when zone and ended = 0 then 'author_info' else role end as role,
        case when zone and ended = 0 then 0.5 else conf end as conf from f2)""",
    "fill": f"""g0 as (select *, last_value(case when role = 'reference_label' then 1 when role in ('heading_1', 'heading_2', 'appendix')
        then 0 end ignore nulls) over {_W} as inside from front),
      fill as (select doc_id, idx, content, text, case when role <> 'unknown' or text = '' then role when inside = 1 then 'reference_entry' else 'body' end as role,
        case when role <> 'unknown' then conf when text = '' then 0.0 when inside = 1 then 0.6 else 0.3 end as conf from g0)""",
}


def chain(upto: str, lines: str) -> str:
    """The common table expressions of every pass up to and including ``upto``."""
    steps = []
    for name, sql in PASSES.items():
        steps.append(sql)
        if name == upto:
            break
    return f"with {lines}, {SECTION_NAMES}, " + ", ".join(steps)


_OUT = "doc_id, idx, role, cast(conf as double) as confidence, content"


def labelled_sql(lines: str, upto: str = "fill") -> str:
    return f"{chain(upto, lines)} select {_OUT} from {upto}"


def _out(df):
    return df.select("doc_id", "idx", "role", "confidence", "content")


_STEPS = [
    ("keyword", S.role_from_keyword),
    ("reference", S.reference_section),
    ("title", S.title_detection),
    ("author", S.author_affiliation),
    ("abstract", S.abstract_detection),
    ("artifact", S.suppress_zone),
    ("keywords", S.keyword_lines),
    ("captions", S.caption_lines),
    ("front", S.extend_front_matter),
    ("fill", S.fill_remaining),
]



def _upto(name: str, source):
    """Operators applied one by one up to ``name``."""

    def run(spark, sf):
        df = source(spark, sf)
        for step, op in _STEPS:
            df = op(df)
            if step == name:
                return _out(df)
        raise KeyError(name)

    return run


_STYLES = "case idx % 7 when 0 then 'Title' when 1 then 'Heading 2' when 2 then 'Heading 9' when 3 then 'Subtitle' when 4 then 'Abstract Text' else null end"


def _styled(spark, sf):
    return S.role_from_style(doc_elements(spark, sf).withColumn("style_name", F.expr(_STYLES)))


_LEN = "select doc_id, length(trim(content)) as n from lines where trim(content) <> ''"


def _corrections(spark, sf):
    labelled = labelled_documents(spark, sf)
    fixes = doc_elements(spark, sf).filter("idx % 3 = 0").select(
        "doc_id",
        "idx",
        F.expr("case when idx % 2 = 0 then 'footnote' else 'block_quote' end").alias("role"),
        F.lit(0.5).alias("confidence"),
    )
    return S.apply_corrections(labelled, fixes)


def _review(spark, sf):
    return S.review_candidates(labelled_documents(spark, sf))


def _context(spark, sf):
    labelled = labelled_documents(spark, sf).persist()
    wanted = S.review_candidates(labelled).select("doc_id", "idx").distinct()
    return S.review_context(labelled, wanted)


_M = f"{chain('fill', DOC_LINES)}, e as (select doc_id, idx, role, trim(content) as line from fill)"
_MERGE_LIST = ", ".join(f"'{r}'" for r in M.MERGEABLE)
_MERGE_SQL = f"""{_M},
 med as (select doc_id, coalesce(median(length(line)) filter (where length(line) > 10), 65.0) as median from e group by doc_id),
 m0 as (select e.*, median, role in ({_MERGE_LIST}) as keep, role in ({_MERGE_LIST}) and line <> '' as member from e join med using (doc_id)),
 m1 as (select *, last_value(case when member then role end ignore nulls) over {_BEFORE} as last_role,
   last_value(case when member then line end ignore nulls) over {_BEFORE} as prev from m0),
 m2 as (select *, sum(case when not keep or (keep and line = '' and coalesce(last_role not in ('body', 'abstract_body'), true)) then 1 else 0 end) over {_W} as breaks from m1),
 m3 as (select *, last_value(case when member then breaks end ignore nulls) over {_BEFORE} as last_breaks from m2),
 m4 as (select *, member and not coalesce(last_breaks = breaks and last_role = role and case
    when role in ('title', 'author_info', 'keywords') then true
    when role = 'reference_entry' then not (regexp_matches(line, '^\\d{{1,3}}[.)]\\s') or (regexp_matches(line, '^[A-Z][a-zà-ÿ]+[\\s,]') and regexp_matches(line, '\\(\\d{{4}}')))
    when role = 'figure_caption' then not regexp_matches(line, '{P.FIGURE_CAPTION}')
    when regexp_matches(prev, '-\\s*$') or not regexp_matches(prev, '[.!?:;]\\s*$') or regexp_matches(line, '^[a-z]') then true
    when regexp_matches(line, '^[(\\[]?(?:\\d+|[a-z])[.)]\\s|^[•–▪◦-]') then false
    when length(prev) < median * 0.82 and regexp_matches(line, '^\\p{{Lu}}') then false
    else true end, false) as starts from m3),
 m5 as (select *, sum(case when starts then 1 else 0 end) over {_W} as g from m4),
 groups as (select doc_id, idx, role, line, case when member then g end as grp, starts from m5)"""


def _merge_groups(spark, sf):
    return M.merge_groups(labelled_documents(spark, sf)).select("doc_id", "idx", "grp", "starts")


def _merged(spark, sf):
    return M.merge(labelled_documents(spark, sf), force=True).select("doc_id", "idx", "role", "content")


_JOINED_SQL = f"""{_MERGE_SQL},
 kept as (select doc_id, min(idx) as first, min_by(role, idx) as role,
   array_to_string(list(line order by idx), ' ') as content from groups where grp is not null group by doc_id, grp
   union all select doc_id, idx, role, line from groups where grp is null)
 select doc_id, cast(row_number() over (partition by doc_id order by first) - 1 as int) as idx, role, content from kept"""



def _merged_by_default(spark, sf):
    """Every second document is cut into short lines, so that it is fragmented where it is long."""
    rows = _cut_lines(spark, sf)
    return M.merge(rows).select("doc_id", "idx", "role", "content")


_SHORT = "case when doc_id % 2 = 0 then substr(content, 1, 70) else content end"


def _cut_lines(spark, sf):
    return labelled_documents(spark, sf).withColumn("content", F.expr(_SHORT))


_CUT_SQL = _MERGE_SQL.replace("trim(content) as line", f"trim({_SHORT}) as line")
_DEFAULT_SQL = f"""{_CUT_SQL},
 broken as (select doc_id, count(*) filter (where line <> '') >= 20 and count(*) filter (where line <> '' and length(line) < 100) / count(*) filter (where line <> '') > 0.6
   and median(length(line)) filter (where line <> '') < 80 as fragmented from groups group by doc_id),
 grouped as (select g.*, case when fragmented then grp end as own from groups g join broken using (doc_id)),
 kept as (select doc_id, min(idx) as first, min_by(role, idx) as role, case when count(*) > 1 then array_to_string(list(line order by idx), ' ')
     else min({_SHORT}) end as content from grouped join (select doc_id, idx, content from lines) using (doc_id, idx) where own is not null group by doc_id, own
   union all select doc_id, idx, role, {_SHORT} from grouped join (select doc_id, idx, content from lines) using (doc_id, idx) where own is null)
 select doc_id, cast(row_number() over (partition by doc_id order by first) - 1 as int) as idx, role, content from kept"""


def _moved_citations(spark, sf):
    """A citation on every line, moved with the paragraph that the line becomes part of."""
    rows = labelled_documents(spark, sf)
    citations = rows.select("doc_id", "idx", F.lit(0).alias("cit_no"), F.col("idx").alias("line"))
    return M.merge_citations(citations, M.merge_groups(rows))


_MOVED_SQL = f"""{_MERGE_SQL}
 select g.doc_id, coalesce(first, idx) as idx, 0 as cit_no, idx as line from groups g
 left join (select doc_id, grp, min(idx) as first from groups where grp is not null group by all) f on f.doc_id = g.doc_id and f.grp = g.grp"""


# Runs, paragraph styles and document defaults; each states a font or size for some rows only.
_RUN = "case (doc_id + idx) % 3 when 0 then 'Arial' end as font_name, cast(case (doc_id + 2 * idx) % 4 when 0 then 21 end as double) as half_points"
_STYLE = "case idx % 5 when 0 then 'Georgia' end as style_font, cast(case idx % 3 when 0 then 28 end as double) as style_half_points"
_DEFAULT = "case when doc_id % 4 <> 0 then 'Times New Roman' end as default_font, cast(case when doc_id % 3 <> 0 then 24 end as double) as default_half_points"


def _fonts(spark, sf):
    lines = doc_elements(spark, sf).select("doc_id", "idx", "content")
    null = {n: F.lit(None).cast("boolean").alias(n) for n in ("bold", "italic", "underline", "strike", "superscript", "subscript")}
    fields = [F.col("content").alias("text"), *null.values(), "font_name", "half_points", F.lit(None).cast("string").alias("color")]
    runs = lines.selectExpr("*", *_RUN.split(", ", 1)).select("doc_id", "idx", F.array(F.struct(*fields)).alias("runs"))
    styles = lines.select("idx").distinct().selectExpr("idx", *_STYLE.split(", ", 1))
    defaults = lines.select("doc_id").distinct().selectExpr("doc_id", *_DEFAULT.split(", ", 1))
    out = resolve_fonts(runs.join(styles, "idx").join(defaults, "doc_id"))
    return out.select("doc_id", "idx", F.inline("runs")).select("doc_id", "idx", "text", "font_name", "font_size_pt")


QUERIES = {
    "resolve_fonts": (
        _fonts,
        f"with {DOC_LINES}, r as (select *, {_RUN}, {_STYLE}, {_DEFAULT} from lines) select doc_id, idx, content as text, "
        "coalesce(font_name, style_font, default_font) as font_name, coalesce(half_points, style_half_points, default_half_points) / 2 as font_size_pt from r",
    ),
    "role_from_style": (
        lambda spark, sf: _styled(spark, sf).select("doc_id", "idx", "role", "confidence"),
        f"with {DOC_LINES} select doc_id, idx, case idx % 7 when 0 then 'title' when 1 then 'heading_2' when 2 then 'heading_1' "
        "when 4 then 'abstract_body' else 'unknown' end as role, cast(case idx % 7 when 0 then 0.92 when 1 then 0.88 "
        "when 2 then 0.88 when 4 then 0.85 else 0.0 end as double) as confidence from lines",
    ),
    "role_from_keyword": (_upto("keyword", manuscript_elements), labelled_sql(MANUSCRIPT_LINES, "keyword")),
    "reference_section": (_upto("reference", manuscript_elements), labelled_sql(MANUSCRIPT_LINES, "reference")),
    "reference_block_without_label": (
        _upto("reference", unlabelled_elements),
        labelled_sql(UNLABELLED_LINES, "reference"),
    ),
    "title_detection": (_upto("title", doc_elements), labelled_sql(DOC_LINES, "title")),
    "author_affiliation": (_upto("author", doc_elements), labelled_sql(DOC_LINES, "author")),
    "author_affiliation_manuscripts": (
        _upto("author", manuscript_elements),
        labelled_sql(MANUSCRIPT_LINES, "author"),
    ),
    "abstract_detection": (_upto("abstract", doc_elements), labelled_sql(DOC_LINES, "abstract")),
    "suppress_artifacts": (
        lambda spark, sf: S.suppress_artifacts(noisy_elements(spark, sf)).select("doc_id", "idx", "role", "confidence", "content"),
        f"with {NOISY_LINES}, a as (select *, trim(content) <> '' and ({_ARTIFACT_SQL}) as hit from lines) select doc_id, idx, "
        "'unknown' as role, cast(case when hit then 0.95 else 0.0 end as double) as confidence, "
        "case when hit then '' else content end as content from a",
    ),
    "suppress_zone": (_upto("artifact", noisy_elements), labelled_sql(NOISY_LINES, "artifact")),
    "keyword_lines": (_upto("keywords", doc_elements), labelled_sql(DOC_LINES, "keywords")),
    "caption_lines": (_upto("captions", manuscript_elements), labelled_sql(MANUSCRIPT_LINES, "captions")),
    "extend_front_matter": (_upto("front", noisy_elements), labelled_sql(NOISY_LINES, "front")),
    "fill_remaining": (_upto("fill", noisy_elements), labelled_sql(NOISY_LINES)),
    "detect_structure": (lambda spark, sf: _out(labelled_documents(spark, sf)), labelled_sql(DOC_LINES)),
    "detect_structure_manuscripts": (
        lambda spark, sf: _out(labelled_manuscripts(spark, sf)),
        labelled_sql(MANUSCRIPT_LINES),
    ),
    "detect_structure_noisy": (
        lambda spark, sf: _out(S.detect_structure(noisy_elements(spark, sf))),
        labelled_sql(NOISY_LINES),
    ),
    "role_counts_by_language": (
        lambda spark, sf: labelled_documents(spark, sf)
        .join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
        .groupBy("lang", "role")
        .agg(F.count(F.lit(1)).alias("n")),
        f"{chain('fill', DOC_LINES)} select lang, role, count(*) as n from fill join documents using (doc_id) group by lang, role",
    ),
    "structure_summary": (
        lambda spark, sf: S.structure_summary(labelled_manuscripts(spark, sf)),
        f"{chain('fill', MANUSCRIPT_LINES)} select doc_id, role, count(*) as n from fill group by doc_id, role",
    ),
    "structure_summary_map": (
        lambda spark, sf: S.structure_summary_map(labelled_documents(spark, sf)).select(
            "doc_id", F.to_json("structure_summary").alias("summary")
        ),
        f"{chain('fill', DOC_LINES)}, n as (select doc_id, role, count(*) as n from fill group by doc_id, role) select doc_id, "
        "concat('{', string_agg(concat('\"', role, '\":', n), ',' order by role), '}') as summary from n group by doc_id",
    ),
    "review_candidates": (
        _review,
        f"{chain('fill', DOC_LINES)}, n as (select *, trim(content) as t, row_number() over (partition by doc_id order by idx) as r, "
        "count(*) over (partition by doc_id) as total from fill where trim(content) <> ''), "
        "low as (select *, row_number() over (partition by doc_id order by idx) as k from n where r > 40 and conf < 0.4 "
        "and role in ('body', 'unknown') and total >= 10) "
        "select doc_id, 'front' as batch, r - 1 as seq, idx, role, cast(conf as double) as confidence, t[1:150] as preview from n "
        "where r <= 40 and total >= 10 union all select doc_id, 'low_confidence', k - 1, idx, role, cast(conf as double), t[1:150] from low where k <= 30",
    ),
    "review_context": (
        _context,
        f"{chain('fill', DOC_LINES)}, n as (select *, row_number() over (partition by doc_id order by idx) as r, "
        "count(*) over (partition by doc_id) as total from fill where trim(content) <> ''), "
        "low as (select *, row_number() over (partition by doc_id order by idx) as k from n where r > 40 and conf < 0.4 "
        "and role in ('body', 'unknown') and total >= 10), "
        "want as (select doc_id, idx from n where r <= 40 and total >= 10 union select doc_id, idx from low where k <= 30) "
        "select w.doc_id, w.idx, string_agg(concat(case when f.idx = w.idx then '>>> ' else '    ' end, '[', f.role, '] ', "
        "f.content[1:100]), chr(10) order by f.idx) as context from want w join fill f on f.doc_id = w.doc_id and "
        "f.idx between w.idx - 2 and w.idx + 2 group by w.doc_id, w.idx",
    ),
    "apply_corrections": (
        lambda spark, sf: _corrections(spark, sf).select("doc_id", "idx", "role", "confidence"),
        f"{chain('fill', DOC_LINES)} select doc_id, idx, case when hit then 'block_quote' else role end as role, "
        "cast(case when hit then 0.5 else conf end as double) as confidence from (select *, idx % 3 = 0 and idx % 2 = 1 "
        "and conf < 0.5 as hit from fill)",
    ),
    "title_of": (
        lambda spark, sf: S.title_of(labelled_documents(spark, sf)),
        f"{chain('fill', DOC_LINES)} select doc_id, min_by(content, idx) as title from fill where role = 'title' group by doc_id",
    ),
    "abstract_of": (
        lambda spark, sf: S.abstract_of(labelled_documents(spark, sf)),
        f"{chain('fill', DOC_LINES)} select doc_id, min_by(content, idx) as abstract from fill where role = 'abstract_body' group by doc_id",
    ),
    "elements_by_role": (
        lambda spark, sf: S.elements_by_role(
            labelled_manuscripts(spark, sf), *S.HEADING_ROLES, "reference_entry", "body"
        ).select("doc_id", "idx", "role"),
        f"{chain('fill', MANUSCRIPT_LINES)} select doc_id, idx, role from fill where role in "
        "('heading_1', 'heading_2', 'heading_3', 'heading_4', 'heading_5', 'reference_entry', 'body')",
    ),
    "is_fragmented": (
        lambda spark, sf: M.is_fragmented(doc_elements(spark, sf)),
        f"with {DOC_LINES}, n as ({_LEN}) select doc_id, count(*) as n_lines, median(n) as median_length, "
        "count(*) filter (where n < 100) as n_short, count(*) >= 20 and count(*) filter (where n < 100) / count(*) > 0.6 "
        "and median(n) < 80 as fragmented from n group by doc_id",
    ),
    "median_line_length": (
        lambda spark, sf: M.median_line_length(doc_elements(spark, sf)),
        f"with {DOC_LINES} select doc_id, cast(coalesce(median(length(trim(content))) filter (where length(trim(content)) > 10), "
        "65.0) as double) as median from lines group by doc_id",
    ),
    "merge_groups": (_merge_groups, f"{_MERGE_SQL} select doc_id, idx, grp, starts from groups"),
    "merge_paragraphs": (_merged, _JOINED_SQL),
    "merge_default": (_merged_by_default, _DEFAULT_SQL),
    "merge_citations": (_moved_citations, _MOVED_SQL),
    "reindex": (
        lambda spark, sf: reindex(doc_elements(spark, sf).filter("content not like '%a%'")).select("doc_id", "idx", "content"),
        f"with {DOC_LINES} select doc_id, cast(row_number() over (partition by doc_id order by idx) - 1 as int) as idx, content "
        "from lines where content not like '%a%'",
    ),
}
