"""Citations, references and their reconciliation (O-C, O-J, O-S10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import citation_text as T
from quire.operators import citations as C
from quire.operators import compliance as V
from quire.operators import matching as J
from quire.operators.structure import detect_structure
from quire.ordering import checkpoint
from quire.plans.catalog.inputs import (
    MANUSCRIPT_LINES,
    assigned,
    builtin_style_specs,
    document_styles,
    labelled_manuscripts,
    manuscript_elements,
)
from quire.plans.catalog.structure_queries import chain
from quire.plans.compliance_inputs import styles_values_sql
from quire.sources.exports import csl_json


def citations_and_references(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Citations and references, computed once and written in one table.

    It is a checkpoint and not a cache, as many steps follow: a cached table holds executor memory, and keeps
    the plans of all its passes, which every step after it analyses and compares again.
    """
    marks = checkpoint(C.citation_marks(labelled_manuscripts(spark, sf)))
    return C.citations_in(marks), C.references_in(marks)


def wrapped_references(spark, sf) -> DataFrame:
    """Reference entries broken into two lines, as conversion does."""
    rows = labelled_manuscripts(spark, sf).filter(F.col("role") == "reference_entry")
    at = F.instr("content", " On the ")
    lines = F.array(
        F.struct(F.lit(0).alias("part"), F.substring("content", F.lit(1), at - 1).alias("line")),
        F.struct(F.lit(1).alias("part"), F.substring("content", at + 1, F.length("content")).alias("line")),
    )
    return rows.select("doc_id", "idx", "role", F.inline(lines)).select(
        "doc_id", (F.col("idx") * 2 + F.col("part")).alias("idx"), "role", F.col("line").alias("content")
    )


_NARR = T.NARRATIVE
_START = (
    "list_sum(list_transform(g[1:k], lambda x: length(x))) + "
    "coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)"
)


def _found(name: str, pattern: str) -> str:
    return f"""{name}0 as (select *, regexp_extract_all(content, '{pattern}') as m, string_split_regex(content, '{pattern}') as g from cited_lines),
 {name}1 as (select doc_id, idx, content, unnest(m) as mt, generate_subscripts(m, 1) as k, m, g from {name}0),
 {name} as (select doc_id, idx, content, mt, k, cast({_START} as int) as "start" from {name}1)"""


_FIRST = "trim(split_part(split_part({0}, ' & ', 1), ' and ', 1))"
_CITED = f"""{chain('fill', MANUSCRIPT_LINES)},
 cited_lines as (select doc_id, idx, content from fill where role in ('body', 'abstract_body') and contains(content, '(')),
 {_found('num', T.NUMERIC)}, {_found('par', T.PARENTHETICAL)}, {_found('nar', _NARR)},
 numeric_cits as (select doc_id, idx, 1 as kind, k, 0 as part, mt as text, 'parenthetical' as citation_type, cast(null as varchar) as author,
   cast(null as varchar) as year, "start", "start" + length(mt) as "end" from num
   where not regexp_matches(substr(content, greatest(1, "start" - 7), least(8, "start")), '{T.CROSS_REFERENCE}')),
 par_parts as (select *, trim(p) as piece from (select *, unnest(string_split(mt[2:-2], ';')) as p,
   generate_subscripts(string_split(mt[2:-2], ';'), 1) as part from par)),
 paren_cits as (select doc_id, idx, 2 as kind, k, part, concat('(', piece, ')') as text, 'parenthetical' as citation_type,
   {_FIRST.format(f"regexp_extract(piece, '{T.PART}', 1)")} as author, regexp_extract(piece, '{T.PART}', 2) as year,
   "start", "start" + length(mt) as "end" from par_parts where regexp_matches(piece, '{T.PART}')),
 earlier as (select * from numeric_cits union all select * from paren_cits),
 narr_cits as (select doc_id, idx, 3 as kind, k, 0 as part, concat(regexp_extract(mt, '{_NARR}', 1), ' (', regexp_extract(mt, '{_NARR}', 2), ')') as text,
   'narrative' as citation_type, {_FIRST.format(f"regexp_extract(mt, '{_NARR}', 1)")} as author, regexp_extract(mt, '{_NARR}', 2) as year,
   "start", "start" + length(mt) as "end" from nar n where not exists (select 1 from earlier e where e.doc_id = n.doc_id and e.idx = n.idx
     and e."start" <= n."start" and n."start" < e."end")),
 citations as (select doc_id, idx, cast(row_number() over (partition by doc_id, idx order by kind, k, part) - 1 as int) as cit_no,
   text, citation_type, author, year, "start", "end" from (select * from earlier union all select * from narr_cits))"""


def _only(kind: str) -> str:
    return f"""{_CITED} select doc_id, idx, cast(row_number() over (partition by doc_id, idx order by k, part) - 1 as int) as cit_no,
 text, citation_type, author, year, "start", "end" from {kind}"""


def _x(p: str, k: int) -> str:
    return f"regexp_extract(text, '{p}', {k})"


_APA, _NUM = T.APA_JOURNAL, T.NUMBERED_JOURNAL
_IS_APA, _IS_NUM = f"regexp_matches(text, '{_APA}')", f"regexp_matches(text, '{_NUM}')"
# Every reference of these manuscripts is a journal article with one author.
_REFS = f"""entries as (select doc_id, idx as ref_idx, content, trim(content) as text from fill where role = 'reference_entry'),
 parsed as (select doc_id, ref_idx, content,
  case when {_IS_APA} then concat({_x(_APA, 1)}) else {_x(_NUM, 2)} end as names,
  case when {_IS_APA} then {_x(_APA, 2)} else {_x(_NUM, 3)} end as year,
  case when {_IS_APA} then {_x(_APA, 3)} else {_x(_NUM, 4)} end as title,
  case when {_IS_APA} then {_x(_APA, 4)} else {_x(_NUM, 5)} end as container_title,
  case when {_IS_APA} then {_x(_APA, 5)} else {_x(_NUM, 6)} end as volume,
  case when {_IS_APA} then {_x(_APA, 6)} else {_x(_NUM, 7)} end as issue,
  case when {_IS_APA} then {_x(_APA, 7)} else {_x(_NUM, 8)} end as pages,
  case when {_IS_APA} then null else cast({_x(_NUM, 1)} as int) end as original_number from entries),
 refs2 as (select *, case when contains(names, ',') then split_part(names, ',', 1) else regexp_extract(names, '^(.*) ([A-Z.]+)$', 1) end as family,
  case when contains(names, ',') then trim(names[strpos(names, ',') + 1:]) else regexp_extract(names, '^(.*) ([A-Z.]+)$', 2) end as given from parsed)"""


def _flat(df: DataFrame) -> DataFrame:
    authors = F.array_join(
        F.transform("ref.authors", lambda a: F.concat(a["family"], F.lit("|"), F.coalesce(a["given"], F.lit("")))), ";"
    )
    fields = ["year", "title", "container_title", "volume", "issue", "pages", "original_number"]
    have = [f for f in fields if f in df.schema["ref"].dataType.names]
    return df.select("doc_id", "ref_idx", authors.alias("authors"), *[f"ref.{f}" for f in have])


_FLAT = "doc_id, ref_idx, concat(family, '|', given) as authors, year, title, container_title, volume, issue, pages"

_MATCH = f"""{_CITED}, {_REFS},
 systems as (select doc_id, case when count(*) filter (where year is null) > count(*) filter (where year is not null)
   then 'numeric' else 'author-date' end as system from citations group by doc_id),
 numbers as (select doc_id, original_number as number, max(ref_idx) as ref_idx from refs2 where original_number is not null group by doc_id, original_number),
 by_number as (select c.doc_id, c.idx, c.cit_no, c.text, cast(trim(c.text, '()') as int) as number from citations c
   join systems s on s.doc_id = c.doc_id and s.system = 'numeric' where c.year is null),
 number_matches as (select b.*, n.ref_idx, case when n.ref_idx is not null then 'number' end as method from by_number b
   left join numbers n on n.doc_id = b.doc_id and n.number = b.number),
 dated as (select c.* from citations c join systems s on s.doc_id = c.doc_id where c.year is not null or s.system <> 'numeric'),
 exact as (select d.doc_id, d.idx, d.cit_no, d.text, lower(d.author) as author, d.year, min(r.ref_idx) as ref_idx from dated d left join refs2 r
   on r.doc_id = d.doc_id and lower(r.family) = lower(d.author) and r.year = d.year group by all),
 -- Cited names of these manuscripts are a family name or one with an e added; only those pairs reach a ratio of 85.
 fuzzy as (select e.doc_id, e.idx, e.cit_no, min(r.ref_idx) as ref_idx from exact e join refs2 r on r.doc_id = e.doc_id and r.year = e.year
   and e.author = concat(lower(r.family), 'e') where e.ref_idx is null group by all),
 name_matches as (select e.doc_id, e.idx, e.cit_no, e.text, cast(null as int) as number, coalesce(e.ref_idx, f.ref_idx) as ref_idx,
   case when e.ref_idx is not null then 'exact' when f.ref_idx is not null then 'fuzzy' end as method from exact e left join fuzzy f
   on f.doc_id = e.doc_id and f.idx = e.idx and f.cit_no = e.cit_no),
 matches as (select * from number_matches union all select * from name_matches),
 used as (select distinct doc_id, ref_idx from matches where ref_idx is not null),
 styles as ({styles_values_sql({'amp': 'in_text_citations.ampersand_in_parenthetical', 'word': 'in_text_citations.and_in_narrative'})}),
 issues as (select style_id, doc_id, idx, cit_no, text, case when amp and citation_type = 'parenthetical' and contains(text, ' and ')
    and not contains(text, ' & ') then '{J.USE_AMPERSAND}' when word and citation_type = 'narrative' and contains(text, ' & ')
    and not contains(lower(text), ' and ') then '{J.USE_AND}' end as issue from citations, styles)"""

REPORT_SQL = f"""{_MATCH},
 c as (select doc_id, count(*) as n from citations group by doc_id), r as (select doc_id, count(*) as n from refs2 group by doc_id),
 mm as (select doc_id, count(*) filter (where ref_idx is not null) as matched, count(*) filter (where ref_idx is null) as orphans from matches group by doc_id),
 u as (select doc_id, count(*) as n from used group by doc_id),
 fi as (select doc_id, style_id, count(*) as n from issues where issue is not null group by all),
 counted as (select d.doc_id, s.style_id, coalesce(c.n, 0) as total_citations, coalesce(r.n, 0) as total_references, coalesce(matched, 0) as matched,
   coalesce(orphans, 0) as orphan_citations, coalesce(r.n, 0) - coalesce(u.n, 0) as uncited_references, coalesce(fi.n, 0) as format_issues
   from (select distinct doc_id from lines) d cross join styles s left join c using (doc_id) left join r using (doc_id)
   left join mm using (doc_id) left join u using (doc_id) left join fi on fi.doc_id = d.doc_id and fi.style_id = s.style_id),
 report as (select *, case when total_citations + total_references = 0 then 100.0 else greatest(0.0, round_even(cast((1 - cast(orphan_citations
   + uncited_references + format_issues as double) / (total_citations + total_references)) * 100 as double), 1)) end as consistency_score from counted)"""


def report(spark, sf) -> DataFrame:
    citations, references = citations_and_references(spark, sf)
    documents = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id")).distinct()
    return J.citation_report(documents, citations, references, builtin_style_specs(spark), document_styles(spark, sf))


def report_and_issues(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The report, and its first issue texts; the matches of both are computed once."""
    citations, references = citations_and_references(spark, sf)
    specs, doc_styles = builtin_style_specs(spark), checkpoint(document_styles(spark, sf))
    documents = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id")).distinct()
    matches = checkpoint(J.match_citations(citations, references))
    found = J.citation_report(documents, citations, references, specs, doc_styles, matches=matches)
    odd = J.format_issues(citations, specs, doc_styles)
    issues = V.top_issues(J.orphan_citations(matches), J.uncited_references(references, matches), odd, specs, doc_styles)
    return found, issues


ISSUES_SQL = """
 ranked as (
   select doc_id, null as sid, 1 as kind, row_number() over (partition by doc_id order by idx, cit_no, number) as n, concat('Orphan: ', text) as t
   from matches where ref_idx is null
   union all select doc_id, null, 2, row_number() over (partition by doc_id order by ref_idx), concat('Uncited: ', substr(content, 1, 60))
   from refs2 anti join used using (doc_id, ref_idx)
   union all select doc_id, style_id, 3, row_number() over (partition by doc_id, style_id order by idx, cit_no), concat('Format: ', substr(issue, 1, 60))
   from issues where issue is not null),
 citation_issues as (select r.doc_id, s.style_id, list(t order by kind, n) as listed from ranked r join styles s on coalesce(sid, s.style_id) = s.style_id
   where n <= 5 group by all)"""


def _with_matches(build):
    def run(spark, sf):
        citations, references = citations_and_references(spark, sf)
        return build(citations, references)

    return run


_PARTS_OF_NAMES = "case when contains(names, ',') then 'apa' else 'initials' end"

QUERIES = {
    "extract_numeric": (lambda spark, sf: C.extract_numeric(labelled_manuscripts(spark, sf)), _only("numeric_cits")),
    "extract_parenthetical": (
        lambda spark, sf: C.extract_parenthetical(labelled_manuscripts(spark, sf)),
        _only("paren_cits"),
    ),
    "extract_narrative": (lambda spark, sf: C.extract_narrative(labelled_manuscripts(spark, sf)), _only("narr_cits")),
    "extract_citations": (
        lambda spark, sf: C.extract_citations(labelled_manuscripts(spark, sf)),
        f"{_CITED} select * from citations",
    ),
    "extract_citations_engine": (
        lambda spark, sf: C.extract_citations(labelled_manuscripts(spark, sf), engine=True),
        f"{_CITED} select * from citations where year is not null",
    ),
    "merge_reference_lines": (
        lambda spark, sf: C.merge_reference_lines(wrapped_references(spark, sf)).select(
            "doc_id", "ref_idx", "n_lines", "text"
        ),
        f"{chain('fill', MANUSCRIPT_LINES)} select doc_id, idx * 2 as ref_idx, 2 as n_lines, content as text from fill "
        "where role = 'reference_entry'",
    ),
    "parse_references": (
        lambda spark, sf: _flat(C.references_of(labelled_manuscripts(spark, sf))),
        f"{chain('fill', MANUSCRIPT_LINES)}, {_REFS} select {_FLAT}, original_number from refs2",
    ),
    "parse_references_simple": (
        lambda spark, sf: _flat(
            C.parse_references_simple(C.merge_reference_lines(labelled_manuscripts(spark, sf)))
        ),
        # Numbered entries only have a year, and what stands before it, for the simple parser.
        f"{chain('fill', MANUSCRIPT_LINES)}, {_REFS} select doc_id, ref_idx, case when original_number is null then concat(family, '|', given) "
        "else concat(original_number, '. ', names, '|') end as authors, year, title, case when original_number is null then container_title end as container_title, "
        "case when original_number is null then volume end as volume, case when original_number is null then issue end as issue, "
        "case when original_number is null then pages end as pages from refs2",
    ),
    "parse_authors": (
        lambda spark, sf: spark.read.parquet(f"{sf}/orders.parquet")
        .select("o_orderkey", F.expr("case o_orderkey % 4 when 0 then concat('Smith, J., & Jones, A. ', chr(65 + cast(o_custkey % 26 as int)), '.') "
            "when 1 then concat('Nataro J', chr(65 + cast(o_custkey % 26 as int)), ', Kaper JB, et al.') when 2 then 'van Berg P and Lee, K.' "
            "else 'A, P., B, M.' end").alias("names"))
        .select("o_orderkey", F.transform(T.parse_authors(F.col("names")), lambda a: F.concat_ws("|", a["family"], a["given"])).alias("a"))
        .select("o_orderkey", F.array_join("a", ";").alias("authors")),
        "select o_orderkey, case o_orderkey % 4 when 0 then concat('Smith|J.;Jones|A. ', chr(65 + cast(o_custkey % 26 as int)), '.') "
        "when 1 then concat('Nataro|J', chr(65 + cast(o_custkey % 26 as int)), ';Kaper|JB') when 2 then 'van Berg P;Lee|K.' "
        "else 'A|P., B, M.' end as authors from orders",
    ),
    "primary_references": (
        lambda spark, sf: C.primary_references(
            C.references_of(labelled_manuscripts(spark, sf))
        ).select("doc_id", "ref_idx"),
        f"{chain('fill', MANUSCRIPT_LINES)}, {_REFS} select doc_id, ref_idx from refs2 where year <> ''",
    ),
    "references_parse_rate": (
        lambda spark, sf: C.references_parse_rate(
            C.references_of(labelled_manuscripts(spark, sf))
        ),
        f"{chain('fill', MANUSCRIPT_LINES)}, {_REFS} select doc_id, count(*) filter (where year <> '') as parsed_ok, count(*) as n_references, "
        "count(*) as n_lines from refs2 group by doc_id",
    ),
    "csl_json": (
        lambda spark, sf: csl_json(C.references_of(labelled_manuscripts(spark, sf))),
        f"{chain('fill', MANUSCRIPT_LINES)}, {_REFS} select doc_id, ref_idx, concat('{{\"type\":\"article-journal\",\"id\":\"', lower(family), '-', year, "
        "'\",\"author\":[{\"family\":\"', family, '\",\"given\":\"', given, '\"}],\"issued\":{\"date-parts\":[[', year, ']]},\"title\":\"', title, "
        "'\",\"container-title\":\"', container_title, '\",\"volume\":\"', volume, '\",\"issue\":\"', issue, '\",\"page\":\"', pages, '\"}') as csl from refs2",
    ),
    "citation_system": (
        lambda spark, sf: J.citation_system(C.extract_citations(labelled_manuscripts(spark, sf))),
        f"{_MATCH} select * from systems",
    ),
    "match_numeric": (_with_matches(J.match_numeric), f"{_MATCH} select * from number_matches"),
    "match_author_date": (_with_matches(J.match_author_date), f"{_MATCH} select * from name_matches"),
    "match_author_date_exact": (
        _with_matches(lambda c, r: J.match_author_date_exact(c, r)),
        f"{_MATCH} select distinct doc_id, author, year, ref_idx from exact where ref_idx is not null",
    ),
    "match_author_date_substring": (
        _with_matches(lambda c, r: J.match_author_date(c, r, "substring")),
        f"{_MATCH} select * from name_matches",
    ),
    "match_citations": (_with_matches(J.match_citations), f"{_MATCH} select * from matches"),
    "orphan_citations": (
        _with_matches(lambda c, r: J.orphan_citations(J.match_citations(c, r))),
        f"{_MATCH} select doc_id, idx, cit_no, text, number from matches where ref_idx is null",
    ),
    "uncited_references": (
        _with_matches(lambda c, r: J.uncited_references(r, J.match_citations(c, r), chars=100)),
        f"{_MATCH} select doc_id, ref_idx, content[1:100] as reference_text from refs2 where (doc_id, ref_idx) not in (select (doc_id, ref_idx) from used)",
    ),
    "cited_references": (
        _with_matches(lambda c, r: J.cited_references(r, J.match_citations(c, r)).select("doc_id", "ref_idx")),
        f"{_MATCH} select * from used",
    ),
    "format_issues": (
        lambda spark, sf: J.format_issues(
            C.extract_joining(detect_structure(C.joining_documents(manuscript_elements(spark, sf)))),
            builtin_style_specs(spark),
            document_styles(spark, sf),
        ),
        assigned(f"{_MATCH} select * from issues where issue is not null"),
    ),
    "citation_report": (report, assigned(f"{REPORT_SQL} select * from report")),
}
