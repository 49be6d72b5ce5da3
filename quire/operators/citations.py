"""Citation extraction and reference parsing over element tables (O-C1..C11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.base import every_script
from quire.functions import citation_text as C
from quire.functions.base import strip
from quire.functions.text import strip_invisible
from quire.ordering import Limit, greatest, over_documents, total

STRUCTURE_ROLES = ("body", "abstract_body")
ENGINE_ROLES = ("body", "abstract_body", "unknown")
ENTRY_NUMBER = r"^\d{1,3}[.)]\s"
SURNAME_START = r"^[A-Z][a-zà-ÿ]+[\s,]"
YEAR_OPEN = r"\(\d{4}"
_SEP = "\u0001"


def _rows(elements: DataFrame, roles: tuple[str, ...], found: Column) -> DataFrame:
    # A citation needs an opening bracket; lines without one skip the pattern work.
    lines = elements.filter(F.col("role").isin(*roles) & F.col("content").contains("("))
    hits = lines.select("doc_id", "idx", F.posexplode(found).alias("cit_no", "c"))
    return hits.select("doc_id", "idx", "cit_no", "c.*")


def extract_numeric(elements: DataFrame) -> DataFrame:
    """O-C1."""
    return _rows(elements, STRUCTURE_ROLES, C.numeric_citations(F.col("content")))


def extract_parenthetical(elements: DataFrame) -> DataFrame:
    """O-C2."""
    return _rows(elements, STRUCTURE_ROLES, C.parenthetical_citations(F.col("content")))


def extract_narrative(elements: DataFrame) -> DataFrame:
    """O-C3: narrative citations that do not start inside another citation."""
    s = F.col("content")
    earlier = F.concat(C.numeric_citations(s), C.parenthetical_citations(s))
    return _rows(elements, STRUCTURE_ROLES, C.drop_overlaps(C.narrative_citations(s), earlier))


def _citations(s: Column) -> Column:
    """All citations of a text, in extraction order."""
    earlier = F.concat(C.numeric_citations(s), C.parenthetical_citations(s))
    return C.bound(earlier, lambda e: F.concat(e, C.drop_overlaps(C.narrative_citations(s), e)))


def extract_citations(elements: DataFrame, engine: bool = False) -> DataFrame:
    """O-C4: all citations of each element, numbered in extraction order.

    ``engine=True`` is the second extractor: it also reads rows without a role, knows
    no numeric citations, and drops a narrative one only if wholly inside another.
    """
    s = F.col("content")
    if engine:
        paren, narrative = C.parenthetical_citations(s), C.narrative_citations(s)
        found = C.bound(paren, lambda p: F.concat(p, C.drop_overlaps(narrative, p, contained=True)))
        return _rows(elements, ENGINE_ROLES, found)
    return _rows(elements, STRUCTURE_ROLES, _citations(s))


def _joins_names() -> Column:
    """Whether a line can hold a citation with ``and`` or ``&``: a citation's text is part of its line.

    Invisible characters count as deleted, as detection deletes them.
    """
    line = strip_invisible("content")
    return F.coalesce(line.contains("(") & (line.contains(" and ") | line.contains(" & ")), F.lit(False))


def joining_documents(elements: DataFrame, max_rows: Limit = None) -> DataFrame:
    """All rows of the documents that have a line with ``and`` or ``&`` beside a bracket, before detection.

    Detection reads each document by itself, so for citations of this form it needs no other ones.
    """

    def mark(df, scan):
        return scan.whole(df, _joining=greatest(_joins_names().cast("int")))

    return over_documents(elements, mark, max_rows).filter("_joining = 1").drop("_joining")


def extract_joining(elements: DataFrame) -> DataFrame:
    """The citations of ``extract_citations`` from lines that hold ``and`` or ``&``; the only ones O-J9 reads."""
    return extract_citations(elements.filter(_joins_names()))


def _entry_lines(elements: DataFrame) -> DataFrame:
    lines = elements.filter(F.col("role") == "reference_entry")
    return lines.select("doc_id", "idx", "content", F.expr(strip("content")).alias("line")).filter("line <> ''")


def _gathered(lines: DataFrame, max_rows: Limit, *others: str) -> DataFrame:
    """One row per reference of ``lines``; rows without a ``line`` are left as they are, with columns ``others``."""
    line = F.col("line")
    starts = line.rlike(ENTRY_NUMBER) | (line.rlike(SURNAME_START) & line.rlike(YEAR_OPEN))

    def number(df, scan):
        return scan.running(df, entry=total(starts.cast("int")))

    numbered = over_documents(lines, number, max_rows).withColumn("entry", F.when(line.isNotNull(), F.col("entry")))
    entry = Window.partitionBy("doc_id", "entry").orderBy("idx", "line")
    whole = entry.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gathered = numbered.select(
        "doc_id",
        F.col("idx").alias("ref_idx"),
        "content",
        line.isNull().alias("_other"),
        *others,
        F.row_number().over(entry).alias("_at"),
        F.count(F.lit(1)).over(whole).alias("n_lines"),
        F.collect_list("line").over(whole).alias("_lines"),
    )
    text = F.when(~F.col("_other"), F.array_join("_lines", " ")).alias("text")
    return gathered.filter("_other or _at = 1").select("doc_id", "ref_idx", "content", "n_lines", text, *others)


def merge_reference_lines(elements: DataFrame, max_rows: Limit = None) -> DataFrame:
    """O-C6: one row per reference, continuation lines joined with a space.

    Nearly every entry is one line, so lines are gathered by a window over each entry, which streams;
    an aggregate would hold or sort one buffer per entry.
    """
    return _gathered(_entry_lines(elements), max_rows)


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All groups of one match as an array, or null; the pattern runs once."""
    joined = F.regexp_replace(text, pattern, _SEP.join(f"${i}" for i in range(1, n + 1)))
    parts = F.split(joined, _SEP, -1)
    return F.when(F.size(parts) == n, parts)


def _text(c: Column) -> Column:
    return F.nullif(C.py_strip(c), F.lit(""))


def _drop_dots(c: Column) -> Column:
    return F.nullif(F.rtrim(C.py_strip(c), F.lit(".")), F.lit(""))


def _after_year(df: DataFrame, text: Column) -> DataFrame:
    """Fallback fields around the first ``(year)``."""
    cut = F.when(text.rlike(r"\(\d{4}\)"), _groups(text, r"(?s)^(.*?)\((\d{4})\)(.*)$", 3))
    df = df.withColumn("_cut", cut)
    tail = C.py_strip(F.ltrim(C.py_strip(F.col("_cut")[2]), F.lit(".")))
    df = df.withColumn("_tail", tail)
    return df.withColumn("_titled", _groups(F.col("_tail"), r"(?s)^(.[^\n]*?)\.(.*)$", 2))


def parse_references(entries: DataFrame, text: str = "text") -> DataFrame:
    """O-C7: adds ``ref`` - journal article, then numbered article, then what can be found.

    The four-group patterns are only tried on text that has the ``(year)`` they need.
    """
    t = F.col(text)
    cols = entries.columns
    df = entries.withColumns(
        {
            "_apa": F.when(t.rlike(r"\(\d{4}\)\."), _groups(t, every_script(C.APA_JOURNAL), 8)),
        }
    )
    # Later patterns are tried on what the earlier ones leave.
    numbered = F.col("_apa").isNull() & t.rlike(every_script(r"^\d{1,3}[.)].*\(\d{4}\)"))
    df = df.withColumn("_num", F.when(numbered, _groups(t, every_script(C.NUMBERED_JOURNAL) + r"[\s\S]*$", 8)))
    left = F.col("_apa").isNull() & F.col("_num").isNull()
    df = df.withColumn("_plain", F.when(left, F.regexp_replace(t, r"^\d{1,3}[.)]\s*", "")))
    df = _after_year(df, F.col("_plain"))
    df = df.withColumn(
        "_journal",
        F.when(
            F.col("_titled").isNotNull(),
            _groups(C.py_strip(F.col("_titled")[1]), r"(?s)^(.+?)\s*(\d+)(.*)$", 3),
        ),
    )
    apa, num, cut = F.col("_apa"), F.col("_num"), F.col("_cut")
    is_apa, is_num = apa.isNotNull(), apa.isNull() & num.isNotNull()

    def pick(a: Column | None, n: Column | None, f: Column | None) -> Column:
        null = F.lit(None).cast("string")
        a, n, f = (null if x is None else x for x in (a, n, f))
        return F.when(is_apa, a).when(is_num, n).otherwise(f)

    rest = F.nullif(C.py_strip(F.rtrim(C.py_strip(cut[0]), F.lit(","))), F.lit(""))
    df = df.withColumn("_names", pick(apa[0], num[1], rest))
    number = F.regexp_extract(t, r"^(\d{1,3})[.)]\s*", 1)
    doi = F.nullif(F.regexp_extract(t, C.DOI, 1), F.lit(""))
    null = F.lit(None).cast("string")
    ref = F.struct(
        C.parse_authors(F.col("_names")).alias("authors"),
        pick(apa[1], num[2], cut[1]).alias("year"),
        pick(_text(apa[2]), _drop_dots(num[3]), _text(F.col("_titled")[0])).alias("title"),
        pick(
            _text(apa[3]), _text(num[4]), F.nullif(F.rtrim(_text(F.col("_journal")[0]), F.lit(",")), F.lit(""))
        ).alias("container_title"),
        pick(apa[4], num[5], F.col("_journal")[1]).alias("volume"),
        pick(F.nullif(apa[5], F.lit("")), F.nullif(num[6], F.lit("")), None).alias("issue"),
        pick(_drop_dots(apa[6]), _text(num[7]), None).alias("pages"),
        F.coalesce(F.when(is_apa, _text(apa[7])), doi).alias("doi"),
        null.alias("url"),
        null.alias("publisher"),
        null.alias("edition"),
        F.lit("article-journal").alias("ref_type"),
        F.when(~is_apa, F.nullif(number, F.lit("")).cast("int")).alias("original_number"),
    )
    return df.select(*cols, ref.alias("ref"))


def parse_references_simple(entries: DataFrame, text: str = "text") -> DataFrame:
    """O-C8: the stricter journal pattern, then year, authors and title."""
    cols = entries.columns
    df = entries.withColumn("_t", F.expr(strip(text)))
    t = F.col("_t")
    df = df.withColumn("_m", F.when(t.rlike(r"\(\d{4}\)\."), _groups(t, every_script(C.SIMPLE_JOURNAL), 8)))
    df = _after_year(df, t)
    m, cut = F.col("_m"), F.col("_cut")
    hit = m.isNotNull()
    rest = C.py_strip(F.rtrim(C.py_strip(cut[0]), F.lit(",")))
    none = F.lit("")

    def only(c: Column) -> Column:
        return F.when(hit, F.nullif(c, none))

    ref = F.struct(
        C.parse_authors_simple(F.when(hit, m[0]).otherwise(rest)).alias("authors"),
        F.when(hit, m[1]).otherwise(cut[1]).alias("year"),
        F.when(hit, _text(m[2])).otherwise(_text(F.col("_titled")[0])).alias("title"),
        only(C.py_strip(m[3])).alias("container_title"),
        only(m[4]).alias("volume"),
        only(m[5]).alias("issue"),
        only(m[6]).alias("pages"),
        only(C.py_strip(m[7])).alias("doi"),
        F.lit("article-journal").alias("ref_type"),
    )
    return df.select(*cols, ref.alias("ref"))


def references_of(elements: DataFrame, max_rows: Limit = None) -> DataFrame:
    """References of labelled elements: ``(doc_id, ref_idx, content, n_lines, text, ref)``."""
    return parse_references(merge_reference_lines(elements, max_rows))


def _is_primary() -> Column:
    content = F.expr(strip("content"))
    return (
        F.col("ref.year").isNotNull()
        | (F.size("ref.authors") > 0)
        | F.col("ref.original_number").isNotNull()
        | ((F.length(content) > 30) & content.rlike(r"^\d{1,3}[.)]"))
    )


def primary_references(references: DataFrame) -> DataFrame:
    """O-C10: references with a year, authors or a number, or long numbered text."""
    return references.filter(_is_primary())


def citation_marks(elements: DataFrame, max_rows: Limit = None) -> DataFrame:
    """The citations and primary references of labelled elements in one table, so that they are labelled once.

    ``c`` is set in the rows of citations, ``ref`` in those of references; both have what is matched and
    reported.  ``citations_in`` and ``references_in`` give the two tables, by document as the elements are.
    """
    role, s = F.col("role"), F.col("content")
    entry = role == "reference_entry"
    found = F.when(role.isin(*STRUCTURE_ROLES) & s.contains("("), _citations(s))
    named = F.transform(found, lambda c: F.struct(*[c[k].alias(k) for k in ("text", "citation_type", "author", "year")]))
    rows = elements.filter(role.isin(*STRUCTURE_ROLES, "reference_entry")).select(
        "doc_id", "idx", F.when(entry, s).alias("entry"), named.alias("found")
    )
    rows = rows.select(
        "doc_id",
        "idx",
        F.col("entry").alias("content"),
        F.expr(strip("entry")).alias("line"),
        F.posexplode_outer("found").alias("cit_no", "c"),
    )
    # A line of body text without a citation is left out, as is an empty entry.
    rows = rows.filter(F.col("c").isNotNull() | (F.col("line") != ""))
    parsed = parse_references(_gathered(rows, max_rows, "cit_no", "c"))
    ref = F.struct("ref.original_number", F.slice("ref.authors", 1, 1).alias("authors"), "ref.year")
    cited = F.col("c").isNotNull()
    kept = parsed.filter(cited | _is_primary())
    return kept.select("doc_id", F.col("ref_idx").alias("idx"), "cit_no", "c", "content", F.when(~cited, ref).alias("ref"))


def citations_in(marks: DataFrame) -> DataFrame:
    """The citations of ``citation_marks``: those of ``extract_citations`` without their place in the line."""
    return marks.filter("c is not null").select("doc_id", "idx", "cit_no", "c.*")


def references_in(marks: DataFrame) -> DataFrame:
    """The references of ``citation_marks``: those of ``primary_references`` with one author, year and number."""
    return marks.filter("ref is not null").select("doc_id", F.col("idx").alias("ref_idx"), "content", "ref")


def references_parse_rate(references: DataFrame) -> DataFrame:
    """O-C11: parsed, merged and raw line counts per document."""
    ok = F.col("ref.year").isNotNull() | (F.size("ref.authors") > 0)
    return references.groupBy("doc_id").agg(
        F.count_if(ok).alias("parsed_ok"),
        F.count(F.lit(1)).alias("n_references"),
        F.sum("n_lines").alias("n_lines"),
    )
