"""Structure detection: every line of a manuscript gets a role (O-D1..D18).

Input is an ``elements`` table whose ``idx`` is the 0-based position in the
document (see ``quire.ordering.reindex``).  Each pass changes ``role``,
``confidence`` and, for suppressed artifacts, ``content``.  Passes that look
along the document are written against ``quire.ordering`` so that they hold for
documents of any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.functions.base import strip_column
from quire.functions.text import strip_invisible, word_count
from quire.ordering import Limit, greatest, latest, least, over_documents, total
from quire.schemas import HEADING_ROLES, ROLES, SECTION_ROLES

# Section names and the role each stands for.
SECTION_KEYWORDS = {
    "abstract_label": ["abstract"],
    "heading_1": [
        "introduction",
        "background",
        "literature review",
        "related work",
        "theoretical framework",
        "methods",
        "methodology",
        "materials and methods",
        "experimental methods",
        "experimental procedures",
        "results",
        "findings",
        "results and discussion",
        "discussion",
        "general discussion",
        "conclusion",
        "conclusions",
        "summary",
        "significance",
        "acknowledgements",
        "acknowledgments",
    ],
    "heading_2": [
        "study design",
        "participants",
        "procedure",
        "measures",
        "data analysis",
        "data collection",
        "implications",
        "limitations",
        "future work",
        "future directions",
        "future research",
        "data availability",
        "ethical considerations",
    ],
    "reference_label": ["references", "bibliography", "works cited"],
    "appendix": [
        "appendix",
        "appendix a",
        "appendix b",
        "appendix c",
        "appendices",
        "supplementary material",
        "supplementary materials",
        "supporting information",
    ],
}
REFERENCE_LABELS = SECTION_KEYWORDS["reference_label"]

# Look-ahead distances and bounds of the passes.
TITLE_ROWS = 15
AUTHOR_ROWS = 30
FRONT_MATTER_ROWS = 8
ZONE_ROWS = 5
REFERENCE_GAP = 6
LABEL_ROWS = 5

SAFE_ROLES = ("title", "heading_1", "heading_2", "heading_3", "abstract_label")
REFERENCE_STOPS = ("heading_1", "heading_2", "appendix", "abstract_label")
FRONT_META = (
    r"(?i)^(Edited by|Received|Approved|Accepted|Submitted|Published|Revised|To whom|"
    r"Corresponding|\*|†)"
)
YEAR_END = r"^.*\b\d{4}\)?\.?\s*$"
FRONT_YEAR_END = r"^.*\d{4}\)?$"
FRONT_CONTACT = r"(?i)^(To whom|Corresponding|E-mail|Email)"

class _Columns:
    """Columns every pass reads; built on use, when a session exists."""

    role = property(lambda _: F.col("role"))
    conf = property(lambda _: F.col("confidence"))
    idx = property(lambda _: F.col("idx"))
    text = property(lambda _: F.col("text"))
    is_paragraph = property(lambda _: F.col("type") == "paragraph")
    has_text = property(lambda _: F.col("text") != "")
    unknown = property(lambda _: F.col("role") == "unknown")
    eligible = property(lambda self: self.is_paragraph & self.unknown & self.has_text)


c = _Columns()


def _set(df: DataFrame, rules: list[tuple[Column, str | Column, float | Column]]) -> DataFrame:
    """First rule that holds gives the new role and confidence."""
    new_role, new_conf = c.role, c.conf
    for when, to, sure in reversed(rules):
        to = F.lit(to) if isinstance(to, str) else to
        sure = F.lit(sure) if isinstance(sure, float) else sure
        new_role = F.when(when, to).otherwise(new_role)
        new_conf = F.when(when, sure).otherwise(new_conf)
    return df.withColumns({"role": new_role, "confidence": new_conf})


def _with_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.coalesce(F.expr(strip_column("content")), F.lit("")))


def section_keywords(spark: SparkSession) -> DataFrame:
    """The section-name dictionary as a table ``(keyword, keyword_role)``."""
    rows = [(k, r) for r, ks in SECTION_KEYWORDS.items() for k in ks]
    return spark.createDataFrame(rows, "keyword string, keyword_role string")


_LONGEST_NAME = max(len(k) for ks in SECTION_KEYWORDS.values() for k in ks)


def _keyword_key() -> Column:
    """The text as it would stand in the dictionary; null if too long to be there."""
    bare = "rtrim('.', text)"
    return F.expr(f"if(length({bare}) <= {_LONGEST_NAME}, lower({bare}), null)")


# --- row-local passes ---------------------------------------------------------------


def clean_content(elements: DataFrame) -> DataFrame:
    """Pass 0: delete invisible characters from paragraphs."""
    return elements.withColumn(
        "content", F.when(c.is_paragraph, strip_invisible("content")).otherwise(F.col("content"))
    )


def role_from_style(elements: DataFrame) -> DataFrame:
    """O-D1: roles from built-in style names."""
    style = F.lower(F.coalesce("style_name", F.lit("")))
    level = F.coalesce(F.nullif(F.regexp_extract(style, r"(\d)", 1), F.lit("")), F.lit("1"))
    heading = F.concat(F.lit("heading_"), F.when(level.between("1", "5"), level).otherwise("1"))
    return _set(
        elements,
        [
            (c.is_paragraph & style.contains("title") & ~style.contains("subtitle"), "title", 0.92),
            (c.is_paragraph & style.contains("heading"), heading, 0.88),
            (c.is_paragraph & style.contains("abstract"), "abstract_body", 0.85),
        ],
    )


def role_from_keyword(elements: DataFrame) -> DataFrame:
    """O-D2: section names standing alone, by a lookup in a fixed 46-row dictionary."""
    df = _with_text(elements).withColumn("keyword", _keyword_key())
    df = df.join(F.broadcast(section_keywords(df.sparkSession)), "keyword", "left")
    named = F.col("keyword_role").isNotNull() & c.eligible & (word_count("text") <= 8)
    out = _set(df, [(named, F.col("keyword_role"), 0.85)])
    return out.select(*elements.columns)


def suppress_artifacts(elements: DataFrame) -> DataFrame:
    """O-D8: page headers, footers and footnotes are blanked."""
    df = _with_text(elements).withColumn("hit", _artifact())
    return _blank(df, F.col("hit")).select(*elements.columns)


def _artifact() -> Column:
    return c.is_paragraph & ~c.role.isin(*SAFE_ROLES) & c.has_text & P.is_page_artifact("text")


def _blank(df: DataFrame, hit: Column) -> DataFrame:
    df = df.withColumn("content", F.when(hit, "").otherwise(F.col("content")))
    return _set(df, [(hit, "unknown", 0.95)])


def _keyword_rules() -> list:
    line = c.is_paragraph & c.has_text
    open_role = c.role.isin("unknown", "abstract_body")
    return [
        (line & P.is_keyword_line("text"), "keywords", 0.85),
        (line & open_role & P.is_pipe_list("text"), "keywords", 0.60),
    ]


def keyword_lines(elements: DataFrame) -> DataFrame:
    """O-D10: keyword lines, labelled or as a pipe list."""
    return _set(_with_text(elements), _keyword_rules()).select(*elements.columns)


def _caption_rules() -> list:
    candidate = c.is_paragraph & c.role.isin("unknown", "body") & c.has_text
    return [
        (candidate & P.is_figure_caption("text"), "figure_caption", 0.85),
        (candidate & P.is_table_caption("text"), "table_caption", 0.85),
    ]


def caption_lines(elements: DataFrame) -> DataFrame:
    """O-D11: figure and table captions."""
    return _set(_with_text(elements), _caption_rules()).select(*elements.columns)


# --- passes along the document ------------------------------------------------------


def _reference_pass(df, scan):
    """O-D3 and O-D4: the reference section, labelled or found by its numbering."""
    line = c.is_paragraph & c.has_text
    numbered = line & P.is_numbered_reference("text")
    key = _keyword_key()
    names = [k for ks in SECTION_KEYWORDS.values() for k in ks]
    cols = df.columns
    is_name, is_label = F.coalesce(key.isin(*names), F.lit(False)), F.coalesce(key.isin(*REFERENCE_LABELS), F.lit(False))
    df = df.withColumns({"_num": numbered, "_name": is_name, "_label_text": is_label})
    num = F.col("_num")

    # A stop between the start and a row, which only rows before the start may change, is the last
    # stop up to the row if that lies behind the start.
    df = scan.running(
        df,
        _line_no=total(F.when(line, 1).otherwise(0)),
        _names=total(F.when(c.is_paragraph & ~num & F.col("_name"), 1).otherwise(0)),
        _stop=greatest(F.when(line & c.role.isin(*REFERENCE_STOPS), c.idx)),
    )
    df = scan.before(df, _prev=latest(F.when(num, F.struct("_line_no", "_names"))))
    # A numbered line starts a new block if too many other lines, or a section name,
    # separate it from the numbered line before it; the last block is the list.
    cut = num & (
        (F.col("_line_no") - F.col("_prev._line_no") - 1 > REFERENCE_GAP)
        | (F.col("_names") > F.col("_prev._names"))
    )
    df = scan.whole(
        df,
        _label=least(F.when(c.role == "reference_label", c.idx)),
        _cut=greatest(F.when(cut, c.idx)),
        _first_num=least(F.when(num, c.idx)),
    )
    first = F.coalesce("_cut", "_first_num")
    df = df.withColumn("_first", F.when(F.col("_label").isNull(), first))
    near = c.idx.between(F.col("_first") - LABEL_ROWS, F.col("_first") - 1)
    df = scan.whole(
        df,
        _entries=total(F.when(num & (c.idx >= F.col("_first")), 1).otherwise(0)),
        _near=least(F.when(near & F.col("_label_text"), c.idx)),
    )
    found = F.col("_entries") >= 3
    df = _set(df, [(found & (c.idx == F.col("_near")), "reference_label", 0.80)])
    start = F.coalesce("_label", F.when(found, F.coalesce(F.col("_near"), F.col("_first") - 1)))
    df = df.withColumn("_start", start)
    inside = (c.idx > F.col("_start")) & (F.col("_stop").isNull() | (F.col("_stop") <= F.col("_start")))
    return _set(df, [(c.eligible & inside, "reference_entry", 0.75)]).select(*cols)


def _title_pass(df, scan):
    """O-D5: the title and its wrapped lines, near the top."""
    cols = df.columns
    # Up to the first section, lines without a role are those of the zone; ``_n`` is read only there.
    df = scan.both(
        df,
        whole={"_title": greatest((c.role == "title").cast("int"))},
        running={
            "_section": greatest(F.when(c.role.isin(*SECTION_ROLES), c.idx)),
            "_n": total(F.when(c.eligible & (c.idx < TITLE_ROWS), 1).otherwise(0)),
        },
    )
    above = F.col("_section").isNull() & (c.idx < TITLE_ROWS)
    zone = c.is_paragraph & c.unknown & above & (F.col("_title") == 0)
    df = df.withColumns({"_zone": zone, "_author": F.when(zone & c.has_text, P.looks_like_author("text"))})
    first = F.col("_zone") & c.has_text & (F.col("_n") == 1)
    later = F.col("_zone") & c.has_text & (F.col("_n") > 1)
    ends = (
        (first & F.col("_author"))
        | (F.col("_zone") & ~c.has_text & (F.col("_n") > 0))
        | (later & (F.col("_author") | (word_count("text") > 20) | c.text.rlike(r"^\p{Nd}")))
    )
    df = scan.running(df, _ended=greatest(ends.cast("int")))
    go = F.col("_ended") == 0
    return _set(df, [(first & go, "title", 0.70), (later & go, "title", 0.60)]).select(*cols)


def _author_pass(df, scan):
    """O-D6: author names and affiliations below the title."""
    cols = df.columns
    df = scan.both(
        df,
        whole={"_title": greatest(F.when(c.role == "title", c.idx))},
        running={"_section": greatest(F.when(c.role.isin(*SECTION_ROLES), c.idx))},
    )
    title = F.col("_title")
    below = (c.idx > title) & (c.idx < title + AUTHOR_ROWS) & (F.col("_section").isNull() | (F.col("_section") <= title))
    zone = F.coalesce(c.eligible & below, F.lit(False))
    sure = (
        F.when(P.looks_like_author("text"), 0.60)
        .when(c.text.startswith(",") | c.text.startswith("and "), 0.55)
        .when(P.is_affiliation("text"), 0.55)
        .when(c.text.rlike(FRONT_META), 0.50)
        .when(c.text.contains("@") | F.lower(c.text).contains("orcid"), 0.50)
        .when(c.text.rlike(YEAR_END) & (word_count("text") <= 8), 0.45)
    )
    df = df.withColumns({"_zone": zone, "_conf": F.when(zone, sure)})
    miss = F.col("_zone") & F.col("_conf").isNull()
    df = scan.before(df, _missed=latest(F.when(F.col("_zone"), F.col("_conf").isNull())))
    df = scan.running(df, _ended=greatest((miss & F.coalesce("_missed", F.lit(False))).cast("int")))
    hit = F.col("_conf").isNotNull() & (F.col("_ended") == 0)
    return _set(df, [(hit, "author_info", F.col("_conf"))]).select(*cols)


def _abstract_pass(df, scan):
    """O-D7: abstract text between the front matter and the first section."""
    cols = df.columns
    sections = c.role.isin(*[r for r in SECTION_ROLES if r != "abstract_label"])
    df = scan.both(
        df,
        whole={"_front": greatest(F.when(c.role.isin("title", "author_info"), c.idx))},
        running={"_section": greatest(F.when(sections, c.idx))},
    )
    df = df.withColumn("_front", F.coalesce("_front", F.lit(0)))
    inside = (c.idx > F.col("_front")) & (F.col("_section").isNull() | (F.col("_section") <= F.col("_front")))
    df = scan.whole(df, _label=least(F.when(inside & (c.role == "abstract_label"), c.idx)))
    line = (
        c.eligible
        & inside
        & (F.col("_label").isNull() | (c.idx > F.col("_label")))
        & ~P.is_keyword_line("text")
    )
    df = df.withColumn("_line", line)
    df = scan.running(df, _start=least(F.when(F.col("_line") & (word_count("text") >= 4), c.idx)))
    sure = F.when(F.col("_label").isNotNull(), 0.55).otherwise(0.45)
    hit = F.coalesce(F.col("_line") & F.col("_start").isNotNull(), F.lit(False))
    return _set(df, [(hit, "abstract_body", sure)]).select(*cols)


def _artifact_pass(df, scan):
    """O-D8 and O-D9: artifacts, and short lines of low confidence right after one."""
    cols = df.columns
    df = df.withColumn("_hit", _artifact())
    low = (F.length("text") < 100) & (c.conf < 0.50)
    carries_on = (F.length("text") <= 200) & (low | P.is_contribution_line("text"))
    stops = (
        c.is_paragraph
        & ~F.col("_hit")
        & (c.role.isin(*SAFE_ROLES) | (c.conf >= 0.70) | (c.has_text & ~carries_on))
    )
    df = scan.running(
        df,
        _last_hit=greatest(F.when(F.col("_hit"), c.idx)),
        _last_stop=greatest(F.when(stops, c.idx)),
    )
    zone = (
        c.is_paragraph
        & c.has_text
        & (c.idx - F.col("_last_hit") <= ZONE_ROWS)
        & (F.col("_last_stop").isNull() | (F.col("_last_stop") < F.col("_last_hit")))
    )
    gone = F.coalesce(F.col("_hit") | zone, F.lit(False))
    df = _set(df.withColumn("_now", gone), [(F.col("_now"), "unknown", 0.95)])
    text = F.when(F.col("_now"), "").otherwise(c.text)
    return df.withColumns({"text": text, "_gone": F.col("_now")}).select(*cols)


def _front_matter_pass(df, scan):
    """O-D12: fragments right after the last title or author line."""
    cols = df.columns
    df = scan.whole(df, _front=greatest(F.when(c.role.isin("title", "author_info"), c.idx)))
    zone = F.coalesce(
        c.is_paragraph & c.has_text & (c.idx > F.col("_front")) & (c.idx <= F.col("_front") + FRONT_MATTER_ROWS),
        F.lit(False),
    )
    fragment = (
        c.text.startswith(",")
        | c.text.startswith("and ")
        | (word_count("text") <= 3)
        | c.text.rlike(FRONT_YEAR_END)
        | c.text.contains("@")
        | c.text.rlike(FRONT_CONTACT)
    )
    stops = zone & ((c.conf >= 0.60) | ~c.role.isin("unknown", "body") | ~fragment)
    df = scan.running(df.withColumn("_zone", zone), _ended=greatest(stops.cast("int")))
    hit = F.col("_zone") & (F.col("_ended") == 0)
    return _set(df, [(hit, "author_info", 0.50)]).select(*cols)


def _fill_pass(df, scan):
    """O-D13: what is left becomes reference entries or body."""
    cols = df.columns
    event = F.when(c.role == "reference_label", 1).when(c.role.isin("heading_1", "heading_2", "appendix"), 0)
    df = scan.running(df, _inside=latest(event))
    left = c.is_paragraph & c.unknown
    return _set(
        df,
        [
            (left & ~c.has_text, "unknown", 0.0),
            (left & (F.coalesce("_inside", F.lit(0)) == 1), "reference_entry", 0.60),
            (left, "body", 0.30),
        ],
    ).select(*cols)


def _pack(elements: DataFrame) -> DataFrame:
    """The columns, with the content kept beside its stripped text only where they differ.

    Windows copy their rows, so rows are kept short; columns stay apart, so that those nobody reads are left out.
    """
    df = _with_text(elements)
    odd = F.when(~F.col("content").eqNullSafe(F.col("text")), F.struct("content"))
    rest = [x for x in elements.columns if x not in (*_READ, "content")]
    return df.select(*_READ, "text", F.lit(False).alias("_gone"), odd.alias("_odd"), *rest)


def _unpack(df: DataFrame, columns: list[str]) -> DataFrame:
    kept = F.when(F.col("_odd").isNotNull(), F.col("_odd.content")).otherwise(F.col("text"))
    content = F.when(F.col("_gone"), "").otherwise(kept).alias("content")
    return df.select(*[content if x == "content" else F.col(x) for x in columns])


_READ = ("doc_id", "idx", "type", "role", "confidence")


def _run(elements: DataFrame, passes, max_rows: Limit) -> DataFrame:
    def chained(df, scan):
        return reduce(lambda d, p: p(d, scan), passes, df)

    return _unpack(over_documents(_pack(elements), chained, max_rows), elements.columns)


def _operator(ordered_pass):
    def op(elements: DataFrame, max_rows: Limit = None) -> DataFrame:
        return _run(elements, [ordered_pass], max_rows)

    op.__doc__ = ordered_pass.__doc__
    return op


reference_section = _operator(_reference_pass)
title_detection = _operator(_title_pass)
author_affiliation = _operator(_author_pass)
abstract_detection = _operator(_abstract_pass)
suppress_zone = _operator(_artifact_pass)
extend_front_matter = _operator(_front_matter_pass)
fill_remaining = _operator(_fill_pass)


def detect_structure(elements: DataFrame, max_rows: Limit = None) -> DataFrame:
    """O-D16: all passes in order; one exchange on ``doc_id`` for ordinary documents."""
    labelled = role_from_keyword(role_from_style(clean_content(elements)))

    def line_rules(df, scan):
        # Both read the text as it is after suppression.
        return _set(_set(df, _keyword_rules()), _caption_rules())

    passes = [
        _reference_pass,
        _title_pass,
        _author_pass,
        _abstract_pass,
        _artifact_pass,
        line_rules,
        _front_matter_pass,
        _fill_pass,
    ]
    return _run(labelled, passes, max_rows)


# --- review, corrections, summaries -------------------------------------------------


def review_candidates(
    elements: DataFrame,
    front: int = 40,
    scattered: int = 30,
    leftovers: int = 20,
    max_rows: Limit = None,
    chars: int = 150,
) -> DataFrame:
    """O-D14: the rows worth a second look, per document, with a preview of ``chars`` characters.

    Batches are ``front`` (the first rows), ``low_confidence`` (further uncertain rows)
    and ``unknown`` (rows without a role).
    """
    lines = _with_text(elements).filter(c.is_paragraph & c.has_text)
    rows = lines.select("doc_id", "idx", "role", "confidence", F.substring("text", 1, chars).alias("preview"))

    def rank(df, scan):
        df = scan.running(df, _nth=total(F.lit(1)), _unknown=total(c.unknown.cast("int")))
        weak = (F.col("_nth") > front) & (c.conf < 0.40) & c.role.isin("body", "unknown")
        df = scan.running(df.withColumn("_weak", weak), _low=total(F.col("_weak").cast("int")))
        return scan.whole(df, _lines=total(F.lit(1)))

    enough = F.col("_lines") >= 10

    def batch(name: str, applies: Column, seq: str) -> Column:
        return F.when(applies, F.struct(F.lit(name).alias("batch"), (F.col(seq) - 1).alias("seq")))

    batches = F.array(
        batch("front", enough & (F.col("_nth") <= front), "_nth"),
        batch("low_confidence", enough & F.col("_weak") & (F.col("_low") <= scattered), "_low"),
        batch("unknown", c.unknown & (F.col("_unknown") <= leftovers), "_unknown"),
    )
    ranked = over_documents(rows, rank, max_rows)
    chosen = ranked.select(
        "doc_id", "idx", "role", "confidence", "preview", F.inline(F.filter(batches, lambda b: b.isNotNull()))
    )
    return chosen.select("doc_id", "batch", "seq", "idx", "role", "confidence", "preview")


def review_context(elements: DataFrame, candidates: DataFrame, reach: int = 2, chars: int = 100) -> DataFrame:
    """Each candidate with the rows within ``reach`` of it, ``chars`` characters each, as one text block."""
    want = candidates.select("doc_id", F.col("idx").alias("target"), F.explode(
        F.sequence(F.col("idx") - reach, F.col("idx") + reach)).alias("idx"))
    rows = want.join(elements.select("doc_id", "idx", "role", "content"), ["doc_id", "idx"])
    mark = F.when(c.idx == F.col("target"), ">>> ").otherwise("    ")
    shown = F.concat(mark, F.lit("["), c.role, F.lit("] "), F.substring("content", 1, chars))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "line")))
    joined = F.array_join(F.transform(ordered, lambda r: r["line"]), "\n")
    grouped = rows.withColumn("line", shown).groupBy("doc_id", "target").agg(joined.alias("context"))
    return grouped.withColumnRenamed("target", "idx")


def apply_corrections(elements: DataFrame, corrections: DataFrame) -> DataFrame:
    """O-D15: take a proposed ``(role, confidence)`` if valid and surer, or if the old one is weak.

    Of several proposals for one row the surest valid one counts, of equally sure ones the last role.
    """
    valid = corrections.filter(F.col("role").isin(*ROLES))
    surest = F.max(F.struct(F.coalesce("confidence", F.lit(0.5)).alias("c"), F.col("role").alias("r")))
    proposed = valid.groupBy("doc_id", "idx").agg(surest.alias("p"))
    proposed = proposed.select("doc_id", "idx", F.col("p.r").alias("_role"), F.col("p.c").alias("_conf"))
    df = elements.join(proposed, ["doc_id", "idx"], "left")
    take = F.col("_role").isin(*ROLES) & ((F.col("_conf") > c.conf) | (c.conf < 0.50))
    take = F.coalesce(take, F.lit(False))
    return _set(df, [(take, F.col("_role"), F.col("_conf"))]).select(*elements.columns)


def structure_summary(elements: DataFrame) -> DataFrame:
    """O-D17: how many rows of each role a document has."""
    return elements.groupBy("doc_id", "role").agg(F.count(F.lit(1)).alias("n"))


def structure_summary_map(elements: DataFrame) -> DataFrame:
    """O-D17 as one ``MAP<role, count>`` per document."""
    counts = structure_summary(elements)
    entries = F.array_sort(F.collect_list(F.struct("role", "n")))
    return counts.groupBy("doc_id").agg(F.map_from_entries(entries).alias("structure_summary"))


def elements_by_role(elements: DataFrame, *roles: str) -> DataFrame:
    """O-D18: rows of the given roles."""
    return elements.filter(c.role.isin(*roles))


def _first_of(elements: DataFrame, which: str, name: str) -> DataFrame:
    return elements_by_role(elements, which).groupBy("doc_id").agg(F.min_by("content", "idx").alias(name))


def title_of(elements: DataFrame) -> DataFrame:
    return _first_of(elements, "title", "title")


def abstract_of(elements: DataFrame) -> DataFrame:
    return _first_of(elements, "abstract_body", "abstract")


def headings_of(elements: DataFrame) -> DataFrame:
    return elements_by_role(elements, *HEADING_ROLES)


def reference_entries_of(elements: DataFrame) -> DataFrame:
    return elements_by_role(elements, "reference_entry")


def body_of(elements: DataFrame) -> DataFrame:
    return elements_by_role(elements, "body")
