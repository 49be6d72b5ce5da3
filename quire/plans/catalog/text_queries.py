"""Text functions, predicates, text source (O-S1, O-T, O-P, O-X2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.functions import register_functions
from quire.functions import text as X
from quire.functions.citation_text import expand_citation_numbers, indel_ratio
from quire.operators.edits import search_text
from quire.plans.catalog.inputs import (
    DOC_LINES,
    MANUSCRIPT_LINES,
    NOISY_LINES,
    doc_elements,
    doc_lines,
    manuscript_lines,
    noisy_elements,
    table,
)
from quire.sources.text import manuscript_metadata

_WORDS = "len(regexp_extract_all({0}, '\\S+'))"
_LIST = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
_CAP = "concat(replace(replace(upper(w[1:1]), 'ẞ', 'Ss'), 'ß', 'Ss'), lower(w[2:]))"


def _in(word: str, choices: list[str]) -> str:
    return f"{word} in ({', '.join(repr(c) for c in choices)})"


def _lines(column, source=doc_lines):
    """A query of one value per line; ``column`` builds it."""
    return lambda spark, sf: source(spark, sf).select("doc_id", "idx", column().alias("value"))


def _sql(expr: str, lines: str = DOC_LINES) -> str:
    return f"with {lines} select doc_id, idx, {expr} as value from lines"


def _pair(column, expr: str, source=doc_lines, lines: str = DOC_LINES):
    return _lines(column, source), _sql(expr, lines)


def _manuscript(column, expr: str):
    return _pair(column, expr, manuscript_lines, MANUSCRIPT_LINES)


def _noisy(column, expr: str):
    source = lambda spark, sf: noisy_elements(spark, sf).select("doc_id", "idx", "content")
    return _pair(column, expr, source, NOISY_LINES)


_AUTHOR_SQL = (
    f"case when length(t) <= 2 then true when {_WORDS.format('t')} > 25 then false "
    "when regexp_matches(t, '[A-Z][a-z]+,?\\s+[A-Z]\\.') then true "
    f"when regexp_matches(t, '[a-z]\\s*,\\s*[A-Z]') and {_WORDS.format('t')} <= 15 then true "
    f"when regexp_matches(t, '[A-Z][a-z]+\\s+[a-z]$') and {_WORDS.format('t')} between 2 and 8 then true "
    f"when contains(t, ' and ') and {_WORDS.format('t')} <= 15 "
    "then regexp_matches(t, '[A-Z][a-z]+ (?:and|&) [A-Z][a-z]+') else false end"
).replace("(t,", "(trim(content),").replace("(t)", "(trim(content))")

_TITLE_SQL = (
    f"array_to_string(list_transform({_LIST.format('content')}, lambda w, i: case when i > 1 and "
    f"i < len({_LIST.format('content')}) and {_in('lower(trim(w, ' + chr(39) + '.:;,!?()' + chr(39) + '))', X.APA_MINOR_WORDS)} "
    f"then lower(w) else {_CAP} end), ' ')"
)
_KEEP = "length(w) > 1 and upper(w) = w and lower(w) <> w"
_HEADING_TITLE_SQL = (
    f"array_to_string(list_transform({_LIST.format('content')}, lambda w, i: case when i > 1 and "
    f"i < len({_LIST.format('content')}) and {_in('lower(w)', X.HEADING_MINOR_WORDS)} "
    f"then lower(w) when {_KEEP} then w else {_CAP} end), ' ')"
)
_SENTENCE_SQL = (
    "case when length(content) <= 1 then upper(content) else "
    f"array_to_string(list_transform({_LIST.format('content')}, lambda w, i: case when i = 1 then {_CAP} "
    f"when {_KEEP} then w else lower(w) end), ' ') end"
)

_HTML_SQL = "html"
for _tag in ("script", "style", "nav", "footer", "header", "aside"):
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', ' ', 'g')"
_HTML_SQL = f"trim(regexp_replace(regexp_replace({_HTML_SQL}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"

_FENCED = "concat('```json\\n', props, '\\n```')"
_ARTIFACT_SQL = " or ".join(
    f"regexp_matches(trim(content), '{p}')"
    for p in (P.PAGE_ARTIFACT, P.ALL_CAPS_ARTIFACT, P.FOOTNOTE_ARTIFACT, P.FOOTNOTE_MARKER, P.CONTRIBUTION)
)
_PARTS = "string_split(trim(content), '|')"
_PIPE_SQL = (
    f"contains(content, '|') and len({_PARTS}) between 3 and 12 and "
    f"len(list_filter({_PARTS}, lambda p: {_WORDS.format('p')} > 6)) = 0"
)


def _sql_functions(spark, sf):
    """Registered functions called from SQL."""
    register_functions(spark, "ms_")
    return spark.sql(
        "select doc_id, idx, ms_word_count(content) as n_words, ms_truncate_text(content, 40) as short, "
        "ms_looks_like_author(trim(content)) as author, ms_has_citations(content) as cites from {lines}",
        lines=manuscript_lines(spark, sf),
    )


# The longest common subsequence row by row: up to each place of b, the best of the row before and
# of a match with the next character of a.
_RATIO_SQL = """with recursive names as (select distinct p_name, lower(p_brand) as p_brand from part),
 chars as (select *, string_split(p_name, '') as a, string_split(p_brand, '') as b from names),
 rows as (
  select p_name, p_brand, a, b, 0 as i, list_transform(range(len(b) + 1), lambda j: 0) as best from chars
  union all
  select p_name, p_brand, a, b, i + 1, list_transform(range(len(b) + 1), lambda j: greatest(best[j + 1],
    coalesce(list_max(list_transform(range(1, j + 1), lambda k: case when b[k] = a[i + 1] then best[k] + 1 else 0 end)), 0)))
  from rows where i < len(a))
 select p_name, p_brand, cast(round_even(200.0 * best[len(b) + 1] / (len(a) + len(b)), 0) as int) as ratio from rows where i = len(a)"""


QUERIES = {
    "read_text_manuscripts": (
        lambda spark, sf: doc_elements(spark, sf).select("doc_id", "idx", "elem_id", "type", "role", "content"),
        f"with {DOC_LINES} select doc_id, idx, concat('elem_', case when idx + 1 < 10000 then "
        "lpad(cast(idx + 1 as varchar), 4, '0') else cast(idx + 1 as varchar) end) as elem_id, "
        "'paragraph' as type, 'unknown' as role, content from lines",
    ),
    "manuscript_metadata": (
        lambda spark, sf: manuscript_metadata(doc_elements(spark, sf)),
        "select doc_id, len(string_split(text, chr(10))) as total_paragraphs, 0 as total_tables, "
        "0 as total_figures from documents",
    ),
    "strip_invisible": _pair(
        lambda: X.strip_invisible("replace(content, ' ', '\\u200b \\ufeff')"),
        "regexp_replace(replace(content, ' ', concat(chr(8203), ' ', chr(65279))), '[\\x{200b}\\x{feff}]', '', 'g')",
    ),
    "strip_artifacts": _pair(
        lambda: X.strip_artifacts("concat('  ', replace(content, 'a', 'a\\u00ad\\u200f'), ' \\u200b ')"),
        "trim(content)",
    ),
    "clean_text": _pair(
        lambda: X.clean_text("concat('\\u0007 ', replace(content, ' ', '   '))"),
        "trim(regexp_replace(content, ' +', ' ', 'g'))",
    ),
    "normalise_guideline": (
        lambda spark, sf: table(spark, sf, "documents").select(
            "doc_id",
            X.normalise_guideline("concat(replace(text, '\\n', '\\n\\n\\n\\n'), '\\n══════')").alias("value"),
        ),
        "select doc_id, trim(replace(text, chr(10), concat(chr(10), chr(10))), concat(' ', chr(10))) as value "
        "from documents",
    ),
    "word_count": _pair(lambda: X.word_count("content"), _WORDS.format("content")),
    "truncate_text": _pair(
        lambda: X.truncate_text("content", 50),
        "case when length(content) <= 50 then content else concat(content[1:47], '...') end",
    ),
    "apa_title_case": _pair(lambda: X.apa_title_case("content"), _TITLE_SQL),
    "text_case_upper": _pair(lambda: X.text_case("content", "'upper'"), "replace(replace(upper(content), 'ẞ', 'SS'), 'ß', 'SS')"),
    "text_case_title": _pair(lambda: X.text_case("content", "'title_case'"), _HEADING_TITLE_SQL),
    "text_case_sentence": _pair(lambda: X.text_case("content", "'sentence_case'"), _SENTENCE_SQL),
    "unit_conversions": (
        lambda spark, sf: table(spark, sf, "part").select(
            "p_partkey",
            X.inches_to_emu("p_size / 8").alias("emu_from_inches"),
            X.pt_to_emu("p_size / 4").alias("emu_from_points"),
            X.emu_to_inches("p_partkey * 1001").alias("inches"),
            X.emu_to_pt("p_partkey * 1001").alias("points"),
        ),
        "select p_partkey, cast(p_size / 8 * 914400 as bigint) as emu_from_inches, "
        "cast(p_size / 4 * 12700 as bigint) as emu_from_points, "
        "round_even(p_partkey * 1001 / 914400, 3) as inches, round_even(p_partkey * 1001 / 12700, 1) as points from part",
    ),
    "strip_html": (
        lambda spark, sf: table(spark, sf, "pages").select("page_id", X.strip_html("html").alias("value")),
        f"select page_id, {_HTML_SQL} as value from pages",
    ),
    "strip_heading_number": _pair(
        lambda: X.strip_heading_number(
            "concat(case idx % 4 when 0 then 'IV. ' when 1 then 'a) ' when 2 then '12. ' else '' end, content)"
        ),
        "trim(regexp_replace(concat(case idx % 4 when 0 then 'IV. ' when 1 then 'a) ' when 2 then '12. ' else '' end, "
        "content), '^(?:[IVXLC]+[.)]\\s*|[A-Za-z][.)]\\s*|\\d+[.)]\\s*)', ''))",
    ),
    "strip_json_fence": (
        lambda spark, sf: table(spark, sf, "events").select(
            "event_id", F.from_json(X.strip_json_fence(_FENCED), "k int")["k"].alias("k")
        ),
        "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events",
    ),
    "has_citations": (
        lambda spark, sf: manuscript_lines(spark, sf).select(
            "doc_id",
            "idx",
            P.has_citations("content").alias("any_kind"),
            P.has_author_date_citations("content").alias("author_date"),
            P.has_numeric_citations("content").alias("numbered"),
        ),
        f"with {MANUSCRIPT_LINES}, f as (select doc_id, idx, regexp_matches(content, '{P.CITATION_AUTHOR_DATE}') as author_date, "
        f"regexp_matches(content, '{P.CITATION_NUMERIC}') as numbered from lines) "
        "select doc_id, idx, author_date or numbered as any_kind, author_date, numbered from f",
    ),
    "is_figure_reference": _manuscript(
        lambda: P.is_figure_reference("replace(content, 'widget', 'Table')", "instr(replace(content, 'widget', 'Table'), '(') - 1"),
        "regexp_matches(substr(replace(content, 'widget', 'Table'), greatest(1, strpos(replace(content, 'widget', 'Table'), '(') - 10), "
        "least(10, greatest(strpos(replace(content, 'widget', 'Table'), '(') - 1, 0))), "
        "'(?i)(?:Fig\\.?|Figure|Table|Tab\\.?|Eq\\.?|Equation)\\s*$')",
    ),
    "looks_like_author": _pair(lambda: P.looks_like_author("trim(content)"), _AUTHOR_SQL),
    "looks_like_author_manuscripts": _manuscript(lambda: P.looks_like_author("trim(content)"), _AUTHOR_SQL),
    "is_heading_like": _manuscript(
        lambda: P.is_heading_like("case when idx = 3 then 'abstract_label' else 'body' end", "doc_id % 2 = 0", "content"),
        f"idx = 3 or (doc_id % 2 = 0 and {_WORDS.format('content')} <= 10)",
    ),
    "is_page_artifact": _noisy(lambda: P.is_page_artifact("trim(content)"), _ARTIFACT_SQL),
    "looks_like_new_paragraph": _manuscript(
        lambda: P.looks_like_new_paragraph("content"),
        "regexp_matches(content, '^[(\\[]?\\d+[.)]\\s|^[(\\[]?[a-z][.)]\\s|^[•–▪◦-]')",
    ),
    "line_kinds": (
        lambda spark, sf: manuscript_lines(spark, sf).select(
            "doc_id",
            "idx",
            P.is_affiliation("content").alias("affiliation"),
            P.is_keyword_line("content").alias("keyword_line"),
            P.is_numbered_reference("content").alias("numbered"),
            P.is_figure_caption("content").alias("figure"),
            P.is_table_caption("content").alias("table_"),
        ),
        f"with {MANUSCRIPT_LINES} select doc_id, idx, regexp_matches(content, '{P.AFFILIATION}') as affiliation, "
        "regexp_matches(content, '(?i)^keywords?\\s*[:–-]') as keyword_line, "
        f"regexp_matches(content, '{P.NUMBERED_REFERENCE}') as numbered, regexp_matches(content, '{P.FIGURE_CAPTION}') as figure, "
        f"regexp_matches(content, '{P.TABLE_CAPTION}') as table_ from lines",
    ),
    "is_pipe_list": _pair(lambda: P.is_pipe_list("trim(content)"), _PIPE_SQL),
    "search_text": (
        lambda spark, sf: search_text(doc_elements(spark, sf), "The ").select("doc_id", "idx", "text"),
        f"with {DOC_LINES} select doc_id, idx, content as text from lines where contains(lower(content), 'the ')",
    ),
    "search_text_counts": (
        lambda spark, sf: search_text(doc_elements(spark, sf), "The ", case_sensitive=True)
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("matches")),
        f"with {DOC_LINES} select doc_id, count(*) as matches from lines where contains(content, 'The ') group by doc_id",
    ),
    "expand_citation_numbers": (
        lambda spark, sf: table(spark, sf, "orders").select(
            "o_orderkey",
            F.array_join(
                expand_citation_numbers(
                    "concat('(', o_orderkey % 9, ', ', o_custkey % 7, case when o_orderkey % 2 = 0 then '-' else '–' end, "
                    "o_orderkey % 11, '; ', o_custkey % 5, ' - ', 3, ')')"
                ),
                ",",
            ).alias("numbers"),
        ),
        "select o_orderkey, concat_ws(',', cast(o_orderkey % 9 as varchar), "
        "nullif(array_to_string(list_transform(range(o_custkey % 7, o_orderkey % 11 + 1), lambda x: cast(x as varchar)), ','), ''), "
        "cast(o_custkey % 5 as varchar), '3') as numbers from orders",
    ),
    "indel_ratio": (
        lambda spark, sf: table(spark, sf, "part")
        .select("p_name", F.lower("p_brand").alias("p_brand"))
        .distinct()
        .select("p_name", "p_brand", indel_ratio("p_name", "p_brand").alias("ratio")),
        _RATIO_SQL,
    ),
    "sql_functions": (
        _sql_functions,
        f"with {MANUSCRIPT_LINES} select doc_id, idx, {_WORDS.format('content')} as n_words, "
        "case when length(content) <= 40 then content else concat(content[1:37], '...') end as short, "
        f"{_AUTHOR_SQL} as author, regexp_matches(content, '{P.CITATION_AUTHOR_DATE}') or "
        f"regexp_matches(content, '{P.CITATION_NUMERIC}') as cites from lines",
    ),
}
