"""Line predicates (O-P1..P8)."""

from __future__ import annotations

from quire.functions.base import matches, raw, sql_function
from quire.functions.text import word_count

# Patterns that decide what a line is.
CITATION_AUTHOR_DATE = r"\([A-Z][a-z]+.*?\d{4}\)|[A-Z][a-z]+\s*\(\d{4}\)"
CITATION_NUMERIC = r"\(\d{1,3}(?:\s*[-–,]\s*\d{1,3})*\)"
FIGURE_PREFIX = r"(?i)(?:Fig\.?|Figure|Table|Tab\.?|Eq\.?|Equation)\s*$"
KEYWORD_LINE = r"(?i)^keywords?\s*[:\-–]"
AFFILIATION = (
    r"(?i)(?:university|department|school|institute|college|laboratory|center|centre|faculty|"
    r"hospital|academy|national\s+institutes?|research\s+council)"
)
NUMBERED_REFERENCE = r"^\d{1,3}[.)]\s*[A-Z]"
FIGURE_CAPTION = r"(?i)^(?:Fig\.?|Figure)\s*\d+"
TABLE_CAPTION = r"(?i)^(?:Table|Tab\.?)\s*\d+"
AUTHOR_INITIAL = r"[A-Z][a-z]+,?\s+[A-Z]\."
AUTHOR_COMMA = r"[a-z]\s*,\s*[A-Z]"
AUTHOR_MARKER = r"[A-Z][a-z]+\s+[a-z]$"
AUTHOR_PAIR = r"[A-Z][a-z]+ (?:and|&) [A-Z][a-z]+"
PAGE_ARTIFACT = (
    r"(?i)(?:^\d{3,6}\s*\|.*(?:pnas|doi|org)"
    r"|^www\.\w+\.org/cgi/doi"
    r"|^\d{3,6}\s+\w+\s+et\s+al\.?\s*$"
    r"|^Downloaded\s+(?:from|by)\s"
    r"|^(?:This\s+article|Freely\s+available).*(?:www\.\w+\.org|open\s+access)"
    r"|^\d{4}/pnas\.\d+"
    r"|^\w[\w\s]{0,30}\s+et\s+al\.?\s+(?:PNAS|Proc|Nature|Science|Cell|Lancet|BMJ|JAMA|\|))"
)
ALL_CAPS_ARTIFACT = r"^[A-Z]{5,}\s*$"
FOOTNOTE_ARTIFACT = (
    r"(?i)(?:^Author\s+contributions?:"
    r"|^The\s+authors?\s+declare\s+no\s+(?:competing\s+)?(?:conflict|interest)"
    r"|^This\s+article\s+is\s+a\s+\w+\s+Direct\s+Submission"
    r"|^(?:\d+\s+)?To\s+whom\s+correspondence\s+should"
    r"|^(?:Data\s+deposition|Data\s+availability)"
    r"|^(?:Published\s+(?:online|under)|Received\s+for\s+publication)"
    r"|^(?:Supporting\s+Information|Supplementary\s+Material|See\s+Commentary)\s"
    r"|^(?:This\s+article\s+contains\s+supporting\s+information)"
    r"|^(?:Copyright|©|\(c\))\s+\d{4}"
    r"|^Corresponding\s+author"
    r"|^Conflict\s+of\s+interest\s+statement"
    r"|^Funding[:\s]"
    r"|^Acknowledgments?[:\s].*(?:grant|funded|supported|NIH|NSF))"
)
FOOTNOTE_MARKER = r"^\d{1,2}\s*$"
# How any line that these rules take opens, in five characters, but for the one with "et al."
ARTIFACT_OPENING = (
    r"(?i)^(?:\d|www\.|Down|This|Free|Auth|The\s|To\s|Data|Publ|Rece|Supp|See\s|Copy|©|\(c\)|Corr|Conf|Fund|Ackn"
    r"|[A-Z]\.|(?-i:[A-Z]{5}))"
)
ET_AL = r"(?i)\set\s+al"
# An initial, then anything, then a contribution phrase: the linear form of the rule.
CONTRIBUTION = (
    r"(?i)^[A-Z]\..*(?:performed\s+research|contributed|analyzed\s+data|wrote\s+the\s+paper|"
    r"designed\s+research|analytic\s+tools|reagents)"
)
NEW_PARAGRAPH = r"^[(\[]?(?:\d+|[a-z])[.)]\s|^[•–\-▪◦]"
HEADING_LIKE_ROLES = (
    "heading_1",
    "heading_2",
    "heading_3",
    "heading_4",
    "heading_5",
    "reference_label",
    "abstract_label",
)


@sql_function("s STRING", "BOOLEAN")
def has_author_date_citations(s):
    """Text holds something like (Smith, 2023) or Smith (2023)."""
    return matches(s, CITATION_AUTHOR_DATE)


@sql_function("s STRING", "BOOLEAN")
def has_numeric_citations(s):
    """Text holds something like (1) or (2, 4-6)."""
    return matches(s, CITATION_NUMERIC)


@sql_function("s STRING", "BOOLEAN")
def has_citations(s):
    """Either kind of citation."""
    return f"({matches(s, CITATION_AUTHOR_DATE)} or {matches(s, CITATION_NUMERIC)})"


@sql_function("s STRING, start INT", "BOOLEAN")
def is_figure_reference(s, start):
    """The ten characters before the 0-based start end in a figure, table or equation word."""
    look_back = f"substr({s}, greatest(1, {start} - 9), least(10, {start}))"
    return matches(look_back, FIGURE_PREFIX)


@sql_function("s STRING", "BOOLEAN")
def looks_like_author(s):
    """Author-name line, on stripped text."""
    n = word_count.sql(s)
    return (
        f"case when length({s}) <= 2 then true when {n} > 25 then false "
        f"when {matches(s, AUTHOR_INITIAL)} then true "
        f"when {n} <= 15 and {matches(s, AUTHOR_COMMA)} then true "
        f"when {n} between 2 and 8 and {matches(s, AUTHOR_MARKER)} then true "
        f"else contains({s}, ' and ') and {n} <= 15 and {matches(s, AUTHOR_PAIR)} end"
    )


@sql_function("role STRING, bold BOOLEAN, s STRING", "BOOLEAN")
def is_heading_like(role, bold, s):
    """A heading role, or bold text of at most ten words."""
    roles = ", ".join(repr(r) for r in HEADING_LIKE_ROLES)
    return f"(coalesce({role} in ({roles}), false) or (coalesce({bold}, false) and {word_count.sql(s)} <= 10))"


@sql_function("s STRING", "BOOLEAN")
def is_contribution_line(s):
    """Initials followed by what those authors did."""
    return f"(substr({s}, 2, 1) = '.' and {matches(s, CONTRIBUTION)})"


@sql_function("s STRING", "BOOLEAN")
def is_page_artifact(s):
    """Page header, footer, footnote or marker left over from page layout, on stripped text."""
    rules = (PAGE_ARTIFACT, ALL_CAPS_ARTIFACT, FOOTNOTE_ARTIFACT, FOOTNOTE_MARKER, CONTRIBUTION)
    may_be = f"({matches(f'left({s}, 5)', ARTIFACT_OPENING)} or {matches(s, ET_AL)})"
    return f"({may_be} and (" + " or ".join(matches(s, r) for r in rules) + "))"


@sql_function("s STRING", "BOOLEAN")
def looks_like_new_paragraph(s):
    """List item or bullet."""
    return matches(s, NEW_PARAGRAPH)


@sql_function("s STRING, query STRING, case_sensitive BOOLEAN", "BOOLEAN")
def search_text(s, query, case_sensitive="false"):
    """Literal containment."""
    return (
        f"if({case_sensitive}, contains({s}, {query}), contains(lower({s}), lower({query})))"
    )


@sql_function("s STRING", "BOOLEAN")
def is_affiliation(s):
    """Names an institution."""
    return matches(s, AFFILIATION)


@sql_function("s STRING", "BOOLEAN")
def is_keyword_line(s):
    """Starts with a keywords label."""
    # The Kelvin sign is a k without its case.
    return f"(left({s}, 1) in ('k', 'K', '\\u212a') and {matches(s, KEYWORD_LINE)})"


@sql_function("s STRING", "BOOLEAN")
def is_numbered_reference(s):
    """Starts with a reference number."""
    first = f"left({s}, 1)"
    return f"(({first} between '0' and '9' or octet_length({first}) > 1) and {matches(s, NUMBERED_REFERENCE)})"


@sql_function("s STRING", "BOOLEAN")
def is_figure_caption(s):
    """Starts with a figure number."""
    return f"(left({s}, 1) in ('f', 'F') and {matches(s, FIGURE_CAPTION)})"


@sql_function("s STRING", "BOOLEAN")
def is_table_caption(s):
    """Starts with a table number."""
    return f"(left({s}, 1) in ('t', 'T') and {matches(s, TABLE_CAPTION)})"


@sql_function("s STRING", "BOOLEAN")
def is_pipe_list(s):
    """Three to twelve parts between pipes, none longer than six words."""
    parts = f"split({s}, {raw('\\|')})"
    return (
        f"(contains({s}, '|') and size({parts}) between 3 and 12 "
        f"and forall({parts}, p -> {word_count.sql('p')} <= 6))"
    )
